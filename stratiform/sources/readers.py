"""Sources: Kafka and its replay from files, incremental JSON and CSV, JDBC slices, batch JSON."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .schemas import ENVELOPE

Secrets = Callable[[str, str], str]


def env_secrets(scope: str, key: str) -> str:
    """A secret from the environment: SCOPE_KEY in upper case."""
    return os.environ[f"{scope}_{key}".upper().replace("-", "_")]


def kafka_options(servers: str, topic: str, starting_offsets: str = "latest", max_offsets: int = 100_000, plain: bool = True) -> dict[str, str]:
    out = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "kafka.security.protocol": "SASL_SSL",
        "startingOffsets": starting_offsets,
        "maxOffsetsPerTrigger": str(max_offsets),
    }
    return out | ({"kafka.sasl.mechanism": "PLAIN"} if plain else {})


def read_kafka(spark: SparkSession, servers: str, topic: str, starting_offsets: str = "latest", max_offsets: int = 100_000) -> DataFrame:
    """The raw envelope of a topic; needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, starting_offsets, max_offsets)).load()


def replay_envelopes(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """A stream of envelopes from Parquet files, ``max_files`` for each trigger."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", max_files).parquet(path)


def replayed_by_name(spark: SparkSession, path: str) -> None:
    """Gives Parquet files modification times in order of their names, by which a stream reads them one after another.

    Files of parallel tasks are otherwise replayed in the order in which the tasks ended.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().endswith(".parquet")), key=lambda p: p.getName())
    first = int(time.time()) - len(files)
    for k, f in enumerate(files):
        fs.setTimes(f, (first + k) * 1000, -1)
    if [fs.getFileStatus(f).getModificationTime() for f in files] != [(first + k) * 1000 for k in range(len(files))]:
        raise OSError(f"modification times can't be set at {path}")


def payloads(envelopes: DataFrame, ts_name: str = "kafka_ingest_ts") -> DataFrame:
    """The envelope's value as text, and its time."""
    return envelopes.selectExpr("CAST(value AS STRING) AS payload", f"timestamp AS {ts_name}")


def registered_schema(spark: SparkSession, path: str, location: str) -> StructType:
    """The schema kept at ``location``, with columns added that the files at ``path`` have gained.

    Types that are known stay; the schema is written again only when it grew.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{location}/schema.json")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = StructType([])
    if fs.exists(target):
        known = StructType.fromJson(json.loads("\n".join(r.value for r in spark.read.text(target.toString()).collect())))
    seen = spark.read.json(path).schema
    have = {f.name for f in known}
    grown = StructType([*known.fields, *[f for f in seen if f.name not in have]])
    if len(grown) > len(known):
        out = fs.create(target, True)
        out.write(bytearray(json.dumps(grown.jsonValue()).encode()))
        out.close()
    return grown


def read_incremental_json(spark: SparkSession, path: str, schema: StructType | str | None = None, schema_location: str | None = None, max_files: int = 1000) -> DataFrame:
    """New JSON files as a stream: by a contract, or by the schema that grows at ``schema_location``."""
    if (schema is None) == (schema_location is None):
        raise ValueError("give either a schema or a schema location")
    schema = schema if schema is not None else registered_schema(spark, path, schema_location)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def read_rescued_csv(spark: SparkSession, path: str, schema: StructType | str, rescue: str = "_rescued_data", stream: bool = True) -> DataFrame:
    """CSV files with a header by a contract; rows that don't fit keep what fits and their raw line in ``rescue``."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([*schema.fields, StructField(rescue, StringType())])
    reader = spark.readStream if stream else spark.read
    return reader.schema(full).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).option("columnNameOfCorruptRecord", rescue).csv(path)


def read_rescued_json(spark: SparkSession, path: str, schema: StructType | str, rescue: str = "_rescued_data") -> DataFrame:
    """JSON lines by a contract; lines with keys beyond it, or that aren't objects, are kept whole in ``rescue``."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path)
    known = F.array(*[F.lit(f.name) for f in schema])
    keys = F.json_object_keys("value")
    odd = keys.isNull() | (F.size(F.array_except(keys, known)) > 0)
    parsed = lines.select(F.from_json("value", schema).alias("r"), F.when(odd, F.col("value")).alias(rescue))
    return parsed.select("r.*", rescue)


def jdbc_query(table: str, watermark_col: str | None = None, watermark_value: str | None = None) -> str:
    """The slice of a table past a watermark; quotes in the value are doubled, names are checked."""
    for name in filter(None, (table, watermark_col)):
        if not all(p.replace("_", "").isalnum() for p in name.split(".")):
            raise ValueError(f"not a name: {name}")
    where = "1=1"
    if watermark_col and watermark_value is not None:
        value = str(watermark_value).replace("'", "''")
        where = f"{watermark_col} > '{value}'"
    return f"SELECT * FROM {table} WHERE {where}"


def read_jdbc(spark: SparkSession, url: str, table: str, scope: str, user_key: str, password_key: str, watermark_col: str | None = None, watermark_value: str | None = None, secrets: Secrets = env_secrets, fetch_size: int = 10_000, **partitioning: str) -> DataFrame:
    """A table's slice by JDBC; ``partitioning`` (partitionColumn, lowerBound, ...) spreads the read over tasks."""
    options = {"url": url, "user": secrets(scope, user_key), "password": secrets(scope, password_key), "fetchsize": str(fetch_size)}
    query = jdbc_query(table, watermark_col, watermark_value)
    options |= {"dbtable": f"({query}) AS slice", **partitioning} if partitioning else {"query": query}
    return spark.read.format("jdbc").options(**options).load()


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
