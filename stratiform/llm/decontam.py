"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. Every run of GRAM words is hashed,
and of every WINDOW hashes in a row the least is kept; a shared run of GRAM + WINDOW - 1 = 13 words therefore
always shares a kept hash. A document's kept hashes meet the benchmark's in a bitmap of bounded size; each
that passes is extended to the 13-word windows around it, which are joined with the benchmark's windows word for
word. The bitmap decides which windows are looked up, never what counts as a hit, so a large benchmark costs
time only. Items of fewer than 13 words are one window; for each such length all runs of that many words are
hashed (winnowing with a window of one).

Documents are read once and not shuffled by text: the only shuffle carries row numbers, counts and hits.

Defined cases: null text has no words (no hits, not contaminated); null or wordless items have no windows; items
of one item_id count as one item; null item_ids are left out; repeated rows of documents each get a row; empty
tables give no rows or no hits; extra columns are kept out of the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, fresh, kept

SPAN, GRAM = 13, 5
WINDOW = SPAN - GRAM + 1
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEWEST_BITS, MOST_BITS = 12, 24


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def gram_hashes(w: Column, n: int) -> Column:
    """The hash of every run of n words."""
    one = lambda i: F.xxhash64(*[w[i + k] for k in range(n)])
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), one)).otherwise(F.array().cast("array<bigint>"))


def winnowed(g: Column) -> Column:
    """The least of every WINDOW hashes in a row, without repeats."""
    least = lambda i: F.array_min(F.slice(g, i, WINDOW))
    return F.when(F.size(g) >= WINDOW, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - (WINDOW - 1)), least))).otherwise(F.array().cast("array<bigint>"))


class Bitmap:
    """Whether a hash may be in a set: 16 bits or more a member, up to 2^24 bits."""

    def __init__(self, hashes: DataFrame):
        n = hashes.count()
        self.bits = min(MOST_BITS, max(FEWEST_BITS, (16 * n).bit_length()))
        self.cells = 1 << (self.bits - 6)
        parts = hashes.select(self._cell(F.col("h")).alias("cell"), self._mask(F.col("h")).alias("mask"))
        table = [0] * self.cells
        for cell, mask in parts.groupBy("cell").agg(F.bit_or("mask")).collect():  # at most 2^18 rows
            table[cell] = mask
        self.table = F.from_json(F.lit(str(table)), "array<bigint>")

    def _cell(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(self.cells - 1)).cast("int")

    @staticmethod
    def _mask(h: Column) -> Column:
        masks = [(1 << k) - (1 << 64 if k == 63 else 0) for k in range(64)]
        return F.from_json(F.lit(str(masks)), "array<bigint>")[h.bitwiseAND(F.lit(63)).cast("int")]

    def has(self, h: Column) -> Column:
        return self.table[self._cell(h)].bitwiseAND(self._mask(h)) != 0


def run_text(w: Column, start: Column, n: int) -> Column:
    return F.array_join(F.slice(w, start + 1, n), " ")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Each different window with its length and item_ids: text, n, items."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(SPAN))
    starts = items.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("s"))
    return starts.select("item", "n", F.array_join(F.slice("w", F.col("s") + 1, F.col("n")), " ").alias("text")).groupBy("text", "n").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """A row for each document: doc_id, text_hash, n_words, n_hit, items (sorted as strings), contaminated."""
    windows = kept(benchmark_windows(benchmark))
    lengths = sorted(n for (n,) in windows.select("n").distinct().collect())  # 13 rows at most
    w, g = F.col("w"), F.col("g")
    rows = docs.select(
        F.col("doc_id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"),
        F.monotonically_increasing_id().alias("rid"),
        words(F.col("text")).alias("w"),
    )
    found = []
    for n in lengths:
        own = windows.where(F.col("n") == n).select(F.split("text", " ").alias("w"))
        if n == SPAN:
            marks = own.select(gram_hashes(w, GRAM).alias("g")).select(F.explode(winnowed(g)).alias("h"))
        else:
            marks = own.select(F.explode(gram_hashes(w, n)).alias("h"))
        bitmap = Bitmap(marks.distinct())
        if n == SPAN:
            rows = rows.withColumn("g", gram_hashes(w, GRAM))
            rows = rows.withColumn("m", F.filter(winnowed(g), bitmap.has)).withColumn("_at", _starts_around(F.col("m"), g, F.size(w)))
            rows = rows.drop("m", "g")
        else:
            rows = rows.withColumn("g", gram_hashes(w, n))
            rows = rows.withColumn("_at", F.when(F.size(g) > 0, F.filter(F.sequence(F.lit(0), F.size(g) - 1), _has_at(bitmap, g))).otherwise(F.array().cast("array<int>"))).drop("g")
        name = f"c{n}"
        rows = rows.withColumn(name, F.transform("_at", _window_at(w, n))).drop("_at")
        found.append(name)
    near = F.concat(*found) if found else F.array().cast("array<struct<s:int,n:int,text:string>>")
    rows = rows.select("doc_id", "text_hash", "rid", F.size(w).cast("long").alias("n_words"), F.explode_outer(near).alias("c"))
    rows = rows.select("doc_id", "text_hash", "rid", "n_words", "c.s", "c.n", "c.text")
    side = windows.select("text", "items")
    side = F.broadcast(side) if fits_broadcast(side, broadcast_rows) else side.hint("merge")
    hits = rows.join(side, "text", "left").withColumn("hit", F.when(F.col("items").isNotNull(), F.struct("s", "n")))
    per = hits.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_hash").alias("text_hash"),
        F.first("n_words").alias("n_words"),
        F.collect_set("hit").alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["s"], h["s"] + h["n"] - 1))))
    per = per.withColumn("n_hit", F.size(covered).cast("long"))
    return per.select("doc_id", "text_hash", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def _has_at(bitmap: Bitmap, g: Column):
    return lambda i: bitmap.has(g[i])


def _window_at(w: Column, n: int):
    return lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), run_text(w, s, n).alias("text"))


def _starts_around(marks: Column, g: Column, n_words: Column) -> Column:
    """Starts of the 13-word windows that hold a run whose hash is in ``marks``."""
    at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda p: F.array_contains(marks, g[p]))
    around = F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(F.lit(0), p - (WINDOW - 1)), F.least(p, n_words - SPAN))))
    return F.when(F.size(marks) > 0, F.array_distinct(around)).otherwise(F.array().cast("array<int>"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    at, name = fresh(docs, "bad_id"), fresh(docs, "bad_hash")
    bad = kept(contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(at), F.col("text_hash").alias(name)).distinct())
    side = F.broadcast(bad) if fits_broadcast(bad, broadcast_rows) else bad
    same = F.col("doc_id").eqNullSafe(F.col(at)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(name))
    return docs.join(side, same, "left_anti")


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT item_id::VARCHAR AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
    SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS win
    FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0))),
dw AS (
    SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT rid, s, dw.n, item FROM dw JOIN bw USING (n, win)),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS pos FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN i USING (rid)
"""
