"""A table store on plain Parquet: atomic versions, MERGE, time travel; no external table format.

``<root>/<db>/<table>/data/stratum_commit=<n>-.../`` holds what commit n wrote, ``_log/<n>.json`` says which directories make up
version n. A commit is the exclusive creation of its log file, so of two writers of one version the second
fails and may retry. Nothing is overwritten in place. A partitioned table's log lists single partitions, and a
merge whose keys hold the partition columns reads and rewrites only the partitions that its source touches.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Names the directories of commits; as a partition column it must differ from any column of a table.
COMMIT = "stratum_commit"


class TableMissing(Exception):
    """No such table."""


class ConcurrentCommit(Exception):
    """Another writer committed this version first."""


class AmbiguousMerge(Exception):
    """Several source rows match one key."""


@dataclass
class Version:
    number: int
    schema: StructType
    paths: list[str]
    partition_by: list[str] = field(default_factory=list)
    properties: dict = field(default_factory=dict)
    operation: str = ""
    metrics: dict = field(default_factory=dict)


class TableStore:
    """Tables named ``db.table`` under a root folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # files

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _dir(self, name: str) -> str:
        return f"{self.root}/{name.replace('.', '/')}"

    def _list(self, p: str) -> list[str]:
        path = self._path(p)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def create_exclusive(self, p: str, text: str) -> bool:
        """Whether the file was made now; False if it was there."""
        try:
            out = self._fs.create(self._path(p), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read_text(self, p: str) -> str:
        stream = self._fs.open(self._path(p))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, p: str) -> None:
        self._fs.delete(self._path(p), True)

    def rename(self, p: str, to: str) -> bool:
        """Whether this call moved the file; of several that try, one does."""
        try:
            return bool(self._fs.rename(self._path(p), self._path(to)))
        except Py4JJavaError:
            return False

    def modified(self, p: str) -> float:
        """Seconds since the epoch at which a file changed last."""
        return self._fs.getFileStatus(self._path(p)).getModificationTime() / 1000

    # versions

    def exists(self, name: str) -> bool:
        return bool(self._list(f"{self._dir(name)}/_log"))

    def versions(self, name: str) -> list[int]:
        return sorted(int(f.removesuffix(".json")) for f in self._list(f"{self._dir(name)}/_log") if f.endswith(".json"))

    def version(self, name: str, number: int | None = None) -> Version:
        have = self.versions(name)
        if not have or (number is not None and number not in have):
            raise TableMissing(f"{name}" + (f" version {number}" if number is not None else ""))
        v = json.loads(self.read_text(f"{self._dir(name)}/_log/{have[-1] if number is None else number}.json"))
        return Version(v["number"], StructType.fromJson(v["schema"]), v["paths"], v["partition_by"], v["properties"], v["operation"], v["metrics"])

    def read(self, name: str, version: int | None = None, paths: list[str] | None = None) -> DataFrame:
        """A version of a table, the latest by default."""
        v = self.version(name, version)
        use = v.paths if paths is None else paths
        if not use:
            return self.spark.createDataFrame([], v.schema)
        base = f"{self._dir(name)}/data"
        reader = self.spark.read.schema(v.schema).option("basePath", base)
        return reader.parquet(*[f"{base}/{p}" for p in use]).select(*[f"`{c}`" for c in v.schema.names])

    def _write(self, name: str, number: int, df: DataFrame, partition_by: list[str]) -> list[str]:
        """Writes a commit's rows under an attempt of its own, and returns the directories, by partition."""
        tag = f"{COMMIT}={number}-{time.time_ns():x}"
        writer = df.write
        if partition_by:
            writer = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)  # splits a value of very many rows
        target = f"{self._dir(name)}/data/{tag}"
        writer.parquet(target)
        found = [tag]
        for _ in partition_by:
            found = [f"{d}/{x}" for d in found for x in self._list(f"{self._dir(name)}/data/{d}") if "=" in x]
        return found

    def _commit(self, name: str, v: Version) -> int:
        body = {"number": v.number, "schema": v.schema.jsonValue(), "paths": v.paths, "partition_by": v.partition_by, "properties": v.properties, "operation": v.operation, "metrics": v.metrics}
        if not self.create_exclusive(f"{self._dir(name)}/_log/{v.number}.json", json.dumps(body)):
            raise ConcurrentCommit(f"{name} version {v.number}")
        return v.number

    # writes

    def create(self, name: str, df: DataFrame, partition_by: list[str] | None = None, properties: dict | None = None, if_absent: bool = False) -> int:
        """The first version of a table; its partition columns come last in the schema."""
        if self.exists(name):
            if if_absent:
                return self.versions(name)[-1]
            raise ConcurrentCommit(f"{name} exists")
        parts = partition_by or []
        df = df.select(*[f"`{c}`" for c in df.columns if c not in parts], *parts)
        return self._commit(name, Version(0, df.schema, self._write(name, 0, df, parts), parts, properties or {}, "create"))

    def create_empty(self, name: str, schema: str | StructType, **options) -> int:
        return self.create(name, self.spark.createDataFrame([], schema), **options)

    def _fitted(self, df: DataFrame, schema: StructType) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def append(self, name: str, df: DataFrame, retries: int = 5) -> int:
        """Adds rows, matched by column name; missing columns are null."""
        for k in range(retries + 1):
            v = self.version(name)
            try:
                new = self._write(name, v.number + 1, self._fitted(df, v.schema), v.partition_by)
                return self._commit(name, Version(v.number + 1, v.schema, v.paths + new, v.partition_by, v.properties, "append"))
            except ConcurrentCommit:
                if k == retries:
                    raise
        raise AssertionError

    def overwrite(self, name: str, df: DataFrame) -> int:
        v = self.version(name)
        new = self._write(name, v.number + 1, self._fitted(df, v.schema), v.partition_by)
        return self._commit(name, Version(v.number + 1, v.schema, new, v.partition_by, v.properties, "overwrite"))

    def delete(self, name: str, condition: str) -> int:
        """Removes the rows for which the condition is true."""
        return self.overwrite(name, self.read(name).where(~F.coalesce(F.expr(condition), F.lit(False))))

    def merge(self, name: str, source: DataFrame, keys: list[str], matched: str | dict[str, str] | None = "all", condition: str | None = None, insert: bool = True, null_safe: bool = False) -> int:
        """MERGE: see :func:`merged`; one new version, or none if another writer was first."""
        v = self.version(name)
        touched, kept = v.paths, []
        if v.partition_by and set(v.partition_by) <= set(keys):
            values = source.select(*v.partition_by).distinct().collect()  # a row for each touched partition
            ends = {"/".join(f"{c}={self._partition_text(r[c])}" for c in v.partition_by) for r in values}
            touched = [p for p in v.paths if p.split("/", 1)[1] in ends]
            kept = [p for p in v.paths if p not in touched]
        now = merged(self.read(name, v.number, touched), source, keys, matched, condition, insert, null_safe)
        new = self._write(name, v.number + 1, self._fitted(now, v.schema), v.partition_by)
        return self._commit(name, Version(v.number + 1, v.schema, kept + new, v.partition_by, v.properties, "merge"))

    def _partition_text(self, x) -> str:
        if x is None:
            return "__HIVE_DEFAULT_PARTITION__"
        return self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(x))

    def vacuum(self, name: str, keep_versions: int = 5) -> list[str]:
        """Removes logs of all but the last versions, and the data that no kept log names."""
        numbers = self.versions(name)
        used = {p.split("/")[0] for n in numbers[-keep_versions:] for p in self.version(name, n).paths}
        for n in numbers[:-keep_versions]:
            self.remove(f"{self._dir(name)}/_log/{n}.json")
        gone = [d for d in self._list(f"{self._dir(name)}/data") if d not in used]
        for d in gone:
            self.remove(f"{self._dir(name)}/data/{d}")
        return gone

    def compact(self, name: str, files: int = 1) -> int:
        """The same rows in fewer files."""
        v = self.version(name)
        return self.overwrite(name, self.read(name).coalesce(files) if not v.partition_by else self.read(name))


def merged(target: DataFrame, source: DataFrame, keys: list[str], matched: str | dict[str, str] | None = "all", condition: str | None = None, insert: bool = True, null_safe: bool = False) -> DataFrame:
    """The target after a MERGE, as one join.

    ``matched``: "all" takes the source's row, a dict sets columns to SQL expressions over t and s, None leaves the
    row; only where ``condition`` (over t and s) is true. ``insert`` adds source rows that match nothing. Null keys
    match only if ``null_safe``. Several source rows for one key raise :class:`AmbiguousMerge`.
    """
    valid = source if null_safe else source.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    if not valid.groupBy(*keys).count().where("count > 1").isEmpty():
        raise AmbiguousMerge(", ".join(keys))
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    s = source.withColumn("_in_s", F.lit(True)).alias("s")
    same: Column = F.lit(True)
    for k in keys:
        a, b = F.col(f"t.`{k}`"), F.col(f"s.`{k}`")
        same = same & (a.eqNullSafe(b) if null_safe else a == b)
    joined = t.join(s, same, "full_outer" if insert else "left")
    both = F.coalesce(F.col("t._in_t"), F.lit(False)) & F.coalesce(F.col("s._in_s"), F.lit(False))
    change = both & F.coalesce(F.expr(condition), F.lit(False)) if condition else both
    out = []
    for c in target.columns:
        old = F.col(f"t.`{c}`")
        offered = F.col(f"s.`{c}`") if c in source.columns else F.lit(None)
        if matched == "all":
            value = offered if c in source.columns else old
        elif isinstance(matched, dict):
            value = F.expr(matched[c]) if c in matched else old
        else:
            value = old
        out.append(F.when(F.col("t._in_t").isNull(), offered).when(change, value).otherwise(old).cast(target.schema[c].dataType).alias(c))
    return joined.select(*out)
