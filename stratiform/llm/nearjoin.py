"""Near-duplicate join on word n-grams by chosen paths.

Each text is a set of hashed runs of five words (a shorter text is one run). Equal sets are one node, so copies
cost no pairs. For each run of the join a node picks the tokens whose shared hash lies under 2/|set|; each pick
is a path, and every path picks on in the same way, so two similar sets keep a common path with a known chance
at any depth. Buckets of one path are split by the next picks while they are large; small ones, and those
at the last depth, are compared by brute force on sketches (128 minima of 16 bits). Runs are repeated until the
chance of missing a pair at the threshold is under 1 - ``recall``. A bucket at the last depth that is still large is
dealt out in chunks, and every pair of chunks is compared as a block, so no task gets a whole hot group and no pair
of a bucket is left out.

What passes joins nodes to candidate groups; inside each, all pairs of sets are compared exactly, in blocks of
bounded size, which gives every node's number of links and the true classes. Pairs are never written out: blocks
return counts and a spanning forest.

Defined cases: null text is empty; texts without words are copies of each other; a class's id is its least
doc_id (null only if all are null); repeated rows are copies; an empty table gives no rows; extra columns are
left out of the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fits_broadcast, fresh, kept, release, scratch, slices, words_of
from .components import components

BINS = 128
DEPTH = 3
PICKS = 2.0
#: Buckets up to this size are compared whole.
SMALL = 48
#: Size of the chunks of larger buckets at the last depth, and after how many rows of a block those that are tied
#: together by then aren't compared with each other any more.
CHUNK, PIVOTS = 1024, 32
#: Hashed runs in one chunk of the exact comparison; smaller groups are cut into chunks of FEW sets, up to SPREAD of them.
BLOCK = 1_000_000
FEW, SPREAD = 256, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xBF58476D1CE4E5B9)


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is missed with a chance under 1 - recall, even at full depth.

    Common picks are 2 * intersection / larger set, least where one set holds the other.
    """
    common = PICKS * threshold
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-common * p)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _STEP
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of hashed runs of words."""

    def __init__(self, size: int = 5, keep: int = 300_000):
        import xxhash

        self.size, self.keep = size, keep
        self.hash, self.digest = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        self.seen: tuple[dict, dict] = ({}, {})

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct hashes of each text's runs."""
        now, older = self.seen if len(self.seen[0]) <= self.keep else ({}, self.seen[0])
        self.seen = now, older
        split = [words_of(t) for t in texts]
        for w in set().union(*split) - now.keys():
            now[w] = older[w] if w in older else self.hash(w)
        out, get = [], now.__getitem__
        for ws in split:
            h = np.fromiter(map(get, ws), dtype=np.uint64, count=len(ws))
            n = min(self.size, len(h))
            g = np.zeros(len(h) - n + 1 if n else 0, dtype=np.uint64)
            for k in range(n):
                g = (g + h[k : k + len(g)]) * _ODD
            out.append(np.unique(_mix(g)))
        return out

    def key(self, s: np.ndarray) -> bytes:
        return self.digest(s.tobytes())


def sketch(s: np.ndarray) -> bytes:
    """For each of 128 ranges of the hash, 16 bits of its least member; 0 if it has none."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
    at = np.searchsorted(s, edges)
    out = np.zeros(BINS, dtype=np.uint16)
    ok = at < len(s)
    first = s[at[ok]]
    inside = (first >> np.uint64(57)) == np.flatnonzero(ok).astype(np.uint64)
    out[np.flatnonzero(ok)[inside]] = ((first[inside] & np.uint64(0xFFFF)) | np.uint64(1)).astype(np.uint16)
    return out.tobytes()


def paths(s: np.ndarray, runs: int, seed: int) -> list[list[int]]:
    """For each depth the picked paths; from the second on as parent, child, parent, child, ..."""
    out: list[list[int]] = [[] for _ in range(DEPTH)]
    if not len(s):
        return out
    under = np.uint64(min((1 << 64) - 1, int((1 << 64) * PICKS / len(s))))
    level = _mix(np.arange(1, runs + 1, dtype=np.uint64) * _ODD + np.uint64(seed))
    for depth in range(DEPTH):
        if not len(level):
            break
        parents, children = [], []
        for p in level:
            picked = s[s * (p | np.uint64(1)) <= under]
            parents.append(np.full(len(picked), p))
            children.append(_mix((picked ^ p) * _ODD))
        children, parents = np.concatenate(children), np.concatenate(parents)
        signed = children.view(np.int64)
        out[depth] = (signed if not depth else np.stack([parents.view(np.int64), signed], axis=1).ravel()).tolist()
        level = children
    return out


SIGNATURES = "doc_id long, text_hash long, sid binary, n int, sketch binary, p1 array<long>, p2 array<long>, p3 array<long>"


def signatures(docs: DataFrame, runs: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh = Shingler()
        for batch in batches:
            texts = batch["text"].tolist()
            for part in slices(texts):
                sets = sh.sets(texts[part])
                deep = [paths(s, runs, seed) for s in sets]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].astype("Int64"), "text_hash": batch["text_hash"].iloc[part], "sid": [sh.key(s) for s in sets], "n": [len(s) for s in sets], "sketch": [sketch(s) for s in sets], **{f"p{k + 1}": [d[k] for d in deep] for k in range(DEPTH)}})

        del sh
        release()

    return _texts(docs).withColumn("text_hash", text_hash(F.col("text"))).mapInPandas(run, SIGNATURES)


def text_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def leaf_buckets(sig: DataFrame) -> DataFrame:
    """(path, a, b, own, sid) of the blocks to compare, each of one chunk (a = b) or of two chunks of a bucket.

    No bucket is a singleton, none is large before the last depth.
    """
    leaves, hot = [], None
    for depth in range(1, DEPTH + 1):
        if depth == 1:
            rows = sig.select("sid", F.explode("p1").alias("path")).distinct()
        else:
            step = F.transform(F.sequence(F.lit(0), F.size(f"p{depth}") - 2, F.lit(2)), _pair_at(f"p{depth}"))
            rows = sig.where(F.size(f"p{depth}") > 0).select("sid", F.explode(step).alias("e")).select("sid", "e.parent", "e.path").distinct()
            rows = rows.join(hot, "parent").select("sid", "path").distinct()
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        placed = kept(rows.join(sizes, "path"))
        last = depth == DEPTH
        leaves.append(placed if last else placed.where(F.col("size") <= SMALL))
        if not last:
            hot = kept(placed.where(F.col("size") > SMALL).select(F.col("path").alias("parent")).distinct())
            hot = F.broadcast(hot) if fits_broadcast(hot, 500_000) else hot
    found = leaves[0].union(leaves[1]).union(leaves[2])
    chunks = F.when(F.col("size") > CHUNK, F.ceil(F.col("size") / CHUNK)).otherwise(1).cast("int")
    dealt = found.distinct().withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("path", "sid"), F.col("chunks")).cast("int"))
    each = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return each.select("path", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), "own", "sid")


def _pair_at(name: str):
    return lambda i: F.struct(F.col(name)[i].alias("parent"), F.col(name)[i + 1].alias("path"))


def _groups(batches: Iterator[pd.DataFrame], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns."""
    at, rows = None, []
    for batch in batches:
        for r in batch.itertuples(index=False, name=None):
            if r[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = r[:keys], []
            rows.append(r)
    if rows:
        yield at, rows


class Forest:
    """Union-find over 0..n-1 that remembers the joins that mattered."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.joins: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.joins.append((i, j))


def _candidates(rows: list[tuple], threshold: float) -> list[tuple[bytes, bytes]]:
    """A forest over the members of a block whose sketches may belong to sets at the threshold.

    Rows are (path, a, b, own, sid, n, sketch), sorted by own; of a block of two chunks, only pairs across are compared.
    """
    sids = [bytes(r[4]) for r in rows]
    sk = np.frombuffer(b"".join(bytes(r[6]) for r in rows), dtype=np.uint16).reshape(len(rows), BINS)
    n = np.array([r[5] for r in rows])
    _, a, b = rows[0][:3]
    first = len(rows) if a == b else sum(r[3] == a for r in rows)  # rows that are compared with later ones
    forest, tied = Forest(len(rows)), np.arange(len(rows))
    for i in range(min(first, len(rows) - 1)):
        if i == PIVOTS:
            tied = np.array([forest.root(j) for j in range(len(rows))])
        after = i + 1 if a == b else first
        fits = np.minimum(n[i], n[after:]) >= threshold * np.maximum(n[i], n[after:]) - 1e-9
        fits &= tied[after:] != tied[i]
        if not fits.any():
            continue
        others = np.flatnonzero(fits) + after
        same = ((sk[i] == sk[others]) & (sk[i] > 0)).sum(axis=1)
        used = ((sk[i] > 0) | (sk[others] > 0)).sum(axis=1)
        least = threshold - 4 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
        for j in others[same >= least * used].tolist():
            forest.join(i, j)
    return [(sids[i], sids[j]) for i, j in forest.joins]


def candidate_edges(buckets: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) pairs of sids that hold each bucket's candidates together."""
    rows = buckets.join(nodes.select("sid", "n", "sketch"), "sid").select("path", "a", "b", "own", "sid", "n", "sketch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: set[tuple[bytes, bytes]] = set()
        for _, group in _groups(batches, 3):
            if len(group) > 1:
                out.update((min(e), max(e)) for e in _candidates(group, threshold))
            if len(out) > 20_000:
                yield pd.DataFrame(sorted(out), columns=["a", "b"])
                out.clear()
        if out:
            yield pd.DataFrame(sorted(out), columns=["a", "b"])

    return rows.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b", "own", "sid").mapInPandas(run, "a binary, b binary").distinct()


COMPARED = "sid binary, other binary, links long, linked_docs long, label long, whole boolean"


def _compare(key: tuple, rows: list[tuple], threshold: float) -> list[tuple]:
    """Exact links inside a block, or between its two chunks: counts for each member, and a forest."""
    _, a, b, g = key
    seen: dict[bytes, tuple] = {}
    for r in rows:
        seen.setdefault(bytes(r[4]), r)
    rows = list(seen.values())
    m = len(rows)
    sets = [np.frombuffer(bytes(r[5]), dtype=np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    copies = np.array([r[6] for r in rows], dtype=np.int64)
    chunk = np.array([r[8] for r in rows], dtype=np.int64)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(len(names), dtype=np.int32)
    links, docs, forest = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), Forest(m)
    for i in range(m - 1):
        mine = ids[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[mine] = 0
        ok = both >= threshold * (sizes[i] + sizes[i + 1 :] - both) - 1e-9
        if a != b:
            ok &= chunk[i + 1 :] != chunk[i]
        j = np.flatnonzero(ok) + i + 1
        links[i] += len(j)
        docs[i] += copies[j].sum()
        links[j] += 1
        docs[j] += copies[i]
        for x in j.tolist():
            forest.join(i, x)
    out = []
    if g == 1:
        least: dict[int, int] = {}
        for i in range(m):
            if not pd.isna(rows[i][7]):
                r = forest.root(i)
                least[r] = min(least.get(r, int(rows[i][7])), int(rows[i][7]))
        out = [(bytes(rows[i][4]), None, int(links[i]), int(docs[i]), least.get(forest.root(i)), True) for i in range(m)]
    else:
        out = [(bytes(rows[i][4]), None, int(links[i]), int(docs[i]), None, False) for i in range(m) if links[i]]
        out += [(bytes(rows[i][4]), bytes(rows[j][4]), 0, 0, None, False) for i, j in forest.joins]
    return out


def exact_links(docs: DataFrame, members: DataFrame, threshold: float, broadcast_rows: int = 400_000) -> DataFrame:
    """Compares all pairs inside each candidate group, block by block.

    ``members``: sid, component, n, copies, rep and rep_text (doc_id and text hash of a row with that set). The texts
    of the representatives are read again; they aren't shuffled while their list is small enough to send to
    every executor.
    """
    chunks = F.greatest(F.ceil(F.sum("n") / BLOCK), F.least(F.ceil(F.count("*") / FEW), F.lit(SPREAD)), F.lit(1)).cast("int")
    stats = members.groupBy("component").agg(chunks.alias("g"))
    wanted = kept(members.join(stats, "component").select("component", "g", F.col("sid").alias("want"), "copies", "rep", "rep_text"))
    side = F.broadcast(wanted) if fits_broadcast(wanted, broadcast_rows) else wanted.hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (text_hash(F.col("text")) == F.col("rep_text"))
    texts = _texts(docs).join(side, same).select("component", "g", "want", "copies", "rep", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh, done = Shingler(), set()
        for batch in batches:
            new = [w not in done and not done.add(w) for w in map(bytes, batch["want"])]  # repeated rows go once
            batch = batch[new]
            body = batch.pop("text").tolist()
            for part in slices(body):
                out = batch.iloc[part].copy()
                out["set"] = [s.tobytes() for s in sh.sets(body[part])]
                yield out
        del sh
        release()

    one = texts.mapInPandas(sets, "component long, g int, want binary, copies long, rep long, set binary")
    own = F.pmod(F.xxhash64("want"), F.col("g")).cast("int")
    each = one.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    blocks = each.select("component", F.least("own", "o").alias("a"), F.greatest("own", "o").alias("b"), "g", F.col("want").alias("sid"), "set", "copies", "rep", "own")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        cols = [c.split()[0] for c in COMPARED.split(", ")]
        for key, group in _groups(batches, 4):
            out += _compare(key, group, threshold)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=cols).astype({"label": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=cols).astype({"label": "Int64"})

    placed = blocks.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "g", "sid")
    return placed.mapInPandas(run, COMPARED)


def near_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.998, seed: int = 7) -> DataFrame:
    """A row for each document: doc_id, text_hash, class_id, n_links (other documents at the threshold or above),
    n_copies (documents with an equal set, itself included), n_near (different sets linked)."""
    spark = docs.sparkSession
    where = scratch(spark, "near")
    signatures(docs, runs_for(recall, threshold), seed).write.parquet(where)
    sig = spark.read.schema(SIGNATURES).parquet(where)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    nodes = sig.groupBy("sid").agg(first.alias("at"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = kept(nodes.select("sid", F.col("at.doc_id").alias("rep"), F.col("at.text_hash").alias("rep_text"), "copies", "n", "sketch"))
    edges = kept(candidate_edges(leaf_buckets(sig), nodes, threshold))
    groups = components(edges.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")))
    members = nodes.withColumn("node", F.xxhash64("sid")).join(groups, "node").select("sid", "component", "n", "copies", "rep", "rep_text")
    compared = kept(exact_links(docs, members, threshold))
    counts = compared.where("other is null").groupBy("sid").agg(F.sum("links").alias("n_near"), F.sum("linked_docs").alias("linked"), F.min("label").alias("label"))
    split = kept(compared.where("other is not null").select(F.col("sid").alias("u"), F.col("other").alias("v")))
    if not split.isEmpty():
        tied = components(split).withColumnRenamed("node", "sid").join(nodes.select("sid", "rep"), "sid")
        names = tied.groupBy("component").agg(F.min("rep").alias("least"))
        wide = tied.join(names, "component").select("sid", "least")
        counts = counts.join(wide, "sid", "left").withColumn("label", F.coalesce("least", "label")).drop("least")
    classes = nodes.select("sid", "rep", "copies").join(counts, "sid", "left").select(
        "sid",
        F.coalesce("label", "rep").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.col("copies").alias("n_copies"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    return sig.select("doc_id", "text_hash", "sid").join(kept(classes), "sid").select("doc_id", "text_hash", "class_id", "n_links", "n_copies", "n_near")


def one_of_each(docs: DataFrame, classes: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """The documents without those that aren't their class's first; all columns stay.

    Where several rows carry the kept doc_id, the one of least text hash stays, once. Rows without a doc_id
    stay unless their class has a document with one.
    """
    seen = kept(classes.select("doc_id", "text_hash", "class_id"))
    twice = kept(seen.where(F.col("doc_id") == F.col("class_id")).groupBy("class_id").agg(F.count("*").alias("n"), F.min("text_hash").alias("first")).where("n > 1"))
    gone = seen.where("class_id is not null and (doc_id is null or doc_id <> class_id)").select("doc_id", "text_hash")
    repeated = not twice.isEmpty()
    if repeated:
        more = seen.where(F.col("doc_id") == F.col("class_id")).join(twice, "class_id").where("text_hash <> first")
        gone = gone.union(more.select("doc_id", "text_hash"))
    at, name = fresh(docs, "gone_id"), fresh(docs, "gone_text")
    gone = kept(gone.toDF(at, name).distinct())
    side = F.broadcast(gone) if fits_broadcast(gone, broadcast_rows) else gone
    left = docs.join(side, F.col("doc_id").eqNullSafe(F.col(at)) & (text_hash(F.col("text")) == F.col(name)), "left_anti")
    if not repeated:
        return left
    more = fresh(docs, "twice_id")
    again = twice.select(F.col("class_id").alias(more))
    one = F.col("doc_id") == F.col(more)
    return left.join(again, one, "left_anti").unionByName(left.join(again, one, "left_semi").dropDuplicates(["doc_id"]))
