"""What the operators of this package share: tables, shared folders, row numbers.

Executors may be lost and do not share local folders, so whatever outlives a stage is
either a checkpoint or a file under the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of words as the operators cut them: ASCII other than letters and digits parts words.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named and not sc._jsc.sc().getCheckpointDir().isDefined():
        named = "file://" + tempfile.mkdtemp(prefix="stratiform-")
    if named and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared one."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared folder or file, also on an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def fresh(df: DataFrame, name: str) -> str:
    """A column name near ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, keys: list[str | Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """Rows with their global number from 0 in ascending order of ``keys`` (nulls first), and their count.

    One range shuffle of the given columns, so pass no texts. The sorted rows are checkpointed, since
    range bounds are sampled anew in another run of the plan; only a count for each partition
    reaches the driver. Rows with equal keys are in any order among themselves.
    """
    spark = df.sparkSession
    placed = kept(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    part, idx = fresh(placed, "_part"), fresh(placed, "_idx")
    at = F.monotonically_increasing_id()
    split = placed.withColumns({part: F.shiftright(at, 33), idx: at.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted(split.groupBy(part).agg(F.count("*")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    base = fresh(split, "_base")
    offsets = spark.createDataFrame(starts, f"{part} long, {base} long")
    out = split.join(F.broadcast(offsets), part).withColumn(name, F.col(base) + F.col(idx))
    return out.drop(part, idx, base), total


#: The order of an absent id: before all others.
LOWEST = -(1 << 63)


def range_bucket(rows: DataFrame, key: str, tie: str, n: int) -> tuple[Column, int]:
    """The bucket from 0 of each row in ascending order of the long columns ``key`` (null first) and ``tie``; how many there are.

    Bounds are quantiles of ``key`` alone, so only that column is read for them. A key that fills several buckets is
    dealt over them by ``tie``, which should be a hash.
    """
    at = F.coalesce(F.col(key), F.lit(LOWEST))
    cuts = sorted(rows.agg(F.percentile_approx(at, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [])
    width = max(1, int(len(cuts) ** 0.5))
    coarse = F.lit(cuts[width - 1 :: width]).cast("array<bigint>")

    def count(under) -> Column:
        """How many cuts are ``under``: by whole runs of ``width``, then by single ones."""
        runs = F.size(F.filter(coarse, under))
        rest = F.slice(F.lit(cuts).cast("array<bigint>"), runs * width + 1, F.lit(width))
        return runs * width + F.size(F.filter(rest, under))

    low, high = count(lambda c: c < at), count(lambda c: c <= at)
    share = F.col(tie).cast("double") / float(1 << 64) + 0.5
    return (low + F.least(high - low, F.floor(share * (high - low + 1)))).cast("int"), len(cuts) + 1


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds the bytes of the batches that go to Python workers, where the session has Spark's default.

    Texts may be long, and a batch is held by the executor's JVM and by its worker at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(key, most)


def remove(uri: str) -> None:
    """Deletes a folder of the shared store; absent ones are no error."""
    f, path = filesystem(uri)
    try:
        f.delete_dir(path)
    except FileNotFoundError:
        pass


def slices(texts: list, most: int = 1 << 21) -> Iterator[slice]:
    """Slices of about ``most`` characters, of one text at least."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield slice(a, i + 1)
            a, held = i + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def arrow_slices(batch, most: int = 1 << 22) -> Iterator:
    """An Arrow batch cut by the bytes of its ``text`` column, into slices of one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    a, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most or i == len(sizes) - 1:
            yield batch.slice(a, i + 1 - a)
            a, held = i + 1, 0


def text_slices(batch, most: int = 1 << 21) -> Iterator[tuple[object, list]]:
    """The slices of an Arrow batch, each with its texts as Python strings.

    Only one slice's texts are Python objects at a time; the other columns stay in Arrow.
    """
    for part in arrow_slices(batch, most):
        yield part, part.column("text").to_pylist()


def distinct_of(lists):
    """A list array's different elements, the index of each element in them, and where each list ends."""
    import numpy as np

    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices, ends - ends[0]


def joined(values, at, ends):
    """One binary for each list: ``values`` at its elements' indices ``at``, one after another, copied in Arrow."""
    import numpy as np
    import pyarrow as pa

    run = values.take(at)
    size = np.frombuffer(run.buffers()[1], np.int64, len(run) + 1, 8 * run.offset) if len(run) else np.zeros(1, np.int64)
    offsets = (size[ends] - size[0]).astype(np.int32)
    data = run.buffers()[2] if len(run) else None
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), data.slice(int(size[0])) if data is not None else pa.py_buffer(b"")])


class Remembered:
    """What was made of pieces of text met lately, in Arrow columns: two generations of about ``keep`` pieces.

    ``make`` takes a list of new pieces and gives a list of binaries for each of ``width`` columns. Pieces of over
    ``longest`` bytes aren't kept.
    """

    def __init__(self, make, width: int, keep: int, longest: int = 64):
        import pyarrow as pa

        self.make, self.keep, self.longest = make, keep, longest
        self.none = [pa.array([], pa.string())] + [pa.array([], pa.large_binary()) for _ in range(width)]
        self.now, self.older = self.none, self.none

    def get(self, wanted) -> tuple[list, object]:
        """Columns of values, and where in them those of each of the different pieces ``wanted`` are."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.now[0]) > self.keep:
            self.now, self.older = self.none, self.now
        at = pc.fill_null(pc.index_in(wanted, self.now[0]), -1).to_numpy().copy()
        lack = np.flatnonzero(at < 0)
        if not len(lack):
            return self.now[1:], at
        missing = wanted.take(pa.array(lack))
        old = pc.fill_null(pc.index_in(missing, self.older[0]), -1).to_numpy()
        back, fresh = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
        n = len(self.now[0])
        at[lack[back]] = n + np.arange(len(back))
        at[lack[fresh]] = n + len(back) + np.arange(len(fresh))
        new = missing.take(pa.array(fresh))
        made = [pa.array(x, pa.large_binary()) for x in self.make(new.to_pylist())] if len(new) else self.none[1:]
        came = pa.array(old[back])
        full = [pa.concat_arrays([a, b.take(came), c]) for a, b, c in zip(self.now, self.older, [new, *made], strict=True)]
        long = pc.binary_length(full[0]).to_numpy() > self.longest
        self.now = [c.filter(pa.array(~long)) for c in full] if long.any() else full
        return full[1:], at


def carried(docs: DataFrame, extra: list[str]) -> tuple[DataFrame, str, list[str]]:
    """doc_id, text and the ``extra`` columns for a pass through Arrow; the schema of the extras; their names there.

    Columns are carried under names of our own (c0, c1, ...), so theirs can't clash with a result's; the text
    itself goes once.
    """
    bounded_batches(docs.sparkSession)
    names = ["text" if c == "text" and docs.schema[c].dataType.simpleString() == "string" else f"c{i}" for i, c in enumerate(extra)]
    own = [(F.col(f"`{c}`").alias(n)) for c, n in zip(extra, names, strict=True) if n != "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own)
    return rows, "".join(f", {n} {rows.schema[n].dataType.simpleString()}" for n in names), names


def with_extras(out: DataFrame, own: list[str], extra: list[str], names: list[str]) -> DataFrame:
    """The ``own`` result columns; with ``extra`` ones, these and the results as one struct ``result``.

    The struct's name gains underscores where ``extra`` has it already.
    """
    if not extra:
        return out.select(*own)
    back = out.select(*[F.col(n).alias(c) for c, n in zip(extra, names, strict=True)])
    return out.select(F.struct(*own).alias(fresh(back, "result")), *[F.col(n).alias(c) for c, n in zip(extra, names, strict=True)])


_RESIDENT: dict = {}


def resident(key: tuple, make):
    """What a worker process keeps between tasks, such as caches: that of one operator at a time.

    Workers serve many operators in turn, so what the last one kept is let go when another begins.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        release()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def release() -> None:
    """Gives freed memory back to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
