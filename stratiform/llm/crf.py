"""Toxic spans and scores by a linear-chain conditional random field.

Training, on the driver, from a bounded sample (``per_class`` labelled documents of each class, none longer than
``longest`` characters, taken by a hash of doc_id): words and word beginnings that stand in toxic documents far more
often than chance allows label the sample's tokens, since labels are given for documents only. A chain with
two states is fitted to segments of these token sequences by gradient steps on the exact likelihood. A
logistic curve over the greatest marginal and the sum of those that stand out gives the document's score, weighted to the share
of toxic rows among all usable labels.

Scoring: every whole text goes through forward and backward recursions; the marginals give the expected number
of toxic tokens, the score, and the offending spans in code points. Nothing but the text enters a score.

Defined cases: null text is empty and scores as the fitted curve says of no tokens; null labels are left out;
repeated labels of a document count once each; of documents that share a doc_id, one is learnt from; without labels of both classes every score is the share of toxic
labels (0 without any); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, release, text_slices, with_extras, words_of

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SEGMENT = 48
#: Marginals under this aren't added up for a document's score.
STANDS_OUT = 0.25


def features(word: bytes) -> tuple[bytes, ...]:
    """What a token shows: itself and its beginnings."""
    return (b"w" + word, b"4" + word[:4], b"5" + word[:5], b"6" + word[:6])


@dataclass
class Model:
    """Weights of the chain and of the document's curve."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -4.0
    #: Log weights of the steps between the states: [from][to].
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray | None = None
    prior: float = 0.0
    keep: int = 150_000
    #: Emissions of words met lately, and of those before them.
    seen: list[dict] = field(default_factory=lambda: [{}, {}], repr=False)

    def emissions(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """For each token the log odds of the toxic state that it gives by itself."""
        if len(self.seen[0]) > self.keep:
            self.seen[:] = {}, self.seen[0]
        now, older = self.seen
        get = self.weights.get
        for w in set().union(*docs) - now.keys():
            if (e := older.get(w)) is None:
                e = self.bias + sum(get(f, 0.0) for f in features(w))
            now[w] = e
        return [np.fromiter(map(now.__getitem__, d), dtype=np.float64, count=len(d)) for d in docs]

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of the toxic state for each token, by forward and backward recursions.

        The ratio of the two states' weights is all that either recursion needs. Texts go on side by side,
        longest first, so each step works on those that are long enough.
        """
        order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
        sizes = np.array([len(emissions[i]) for i in order], dtype=np.int64)
        longest = int(sizes[0]) if len(sizes) else 0
        going = np.searchsorted(-sizes, -np.arange(longest), side="left")
        offs = np.concatenate([[0], np.cumsum(going)])
        flat = np.empty(int(offs[-1]))
        for k, i in enumerate(order):
            n = int(sizes[k])
            flat[offs[:n] + k] = emissions[i]
        odds = np.exp(np.clip(flat, -30, 30))
        (a, b), (c, d) = np.exp(self.steps)
        ends, forward = offs.tolist(), np.empty_like(odds)
        r = np.zeros(0)
        for t in range(longest):
            lo, hi = ends[t], ends[t + 1]
            r = odds[lo:hi] * ((b + d * r[: hi - lo]) / (a + c * r[: hi - lo])) if t else odds[lo:hi].copy()
            forward[lo:hi] = r
        q = np.ones(len(order))
        for t in range(longest - 1, -1, -1):
            lo, hi = ends[t], ends[t + 1]
            now = q[: hi - lo]
            e = odds[lo:hi] * now
            forward[lo:hi] *= now
            q[: hi - lo] = (c + d * e) / (a + b * e)
        p = forward / (1 + forward)
        out: list = [None] * len(order)
        for k, i in enumerate(order):
            out[i] = p[offs[: int(sizes[k])] + k]
        return out

    @staticmethod
    def summary(marginals: list[np.ndarray]) -> np.ndarray:
        """What the document's curve sees: the greatest marginal, and the sum of those that stand out.

        Small marginals are left out of the sum, or a long clean text would gather them up to a toxic score.
        """
        rows = []
        for p in marginals:
            hot = p[p >= STANDS_OUT]
            total = float(hot.sum())
            rows.append((1.0, float(p.max()) if len(p) else 0.0, math.log1p(total), min(total, 3.0)))
        return np.array(rows).reshape(-1, 4)

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(marginals), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.summary(marginals) @ self.curve, -30, 30)))


def usable_labels(labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, toxic) rows that may be learnt from."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training: CRC-32 of its id as text, modulo 4, is 2."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, longest: int = 20_000, seed: int = 11) -> Model:
    """The model from a sample of at most ``per_class`` labelled documents of each class."""
    rows = usable_labels(labels, held_out())
    counts = {k: n for k, n in rows.groupBy("toxic").count().collect()}  # two rows at most
    model = Model(prior=counts.get(1, 0) / max(1, sum(counts.values())))
    if len(counts) < 2:
        return model
    picks = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = picks[0].union(picks[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= longest)
    wanted = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    one = wanted.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))  # a row for each chosen document
    sample = sorted((r.doc_id, r.toxic, r.text) for r in one.select("doc_id", "x.text").join(F.broadcast(chosen), "doc_id").collect())
    toxic = np.array([y for _, y, _ in sample], dtype=np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return model
    pool: dict[bytes, bytes] = {}
    tokens = [[pool.setdefault(w, w) for w in words_of(t)] for _, _, t in sample]
    del sample
    fit_chain(model, tokens, toxic, seed)
    fit_curve(model, tokens, toxic)
    return model


def markers(tokens: list[list[bytes]], toxic: np.ndarray, chance: float = 1e-8) -> set[bytes]:
    """Features in toxic documents so often that the chance of it, were classes mixed, is under ``chance``.

    What counts at last is the number of different neighbourhoods (word before and word after), since
    copies of one text are no further evidence.
    """
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    share = n1 / (n1 + n0)

    def often(k: int, others: int) -> bool:
        n = k + others
        rate = k / n
        if k / n1 < 9 * (others + 0.5) / n0:
            return False
        # Chernoff bound of the binomial tail
        bits = n * (rate * math.log(rate / share) + (0 if rate == 1 else (1 - rate) * math.log((1 - rate) / (1 - share))))
        return bits > -math.log(chance)

    seen = (Counter(), Counter())
    for ws, y in zip(tokens, toxic, strict=True):
        seen[int(y)].update({f for w in set(ws) for f in features(w)[:3]})
    likely = {f for f, k in seen[1].items() if often(k, seen[0][f])}
    around: tuple[dict, dict] = ({}, {})
    for ws, y in zip(tokens, toxic, strict=True):
        for before, w, after in zip([b"", *ws], ws, [*ws[1:], b""], strict=False):
            for f in features(w)[:3]:
                if f in likely:
                    around[int(y)].setdefault(f, set()).add((before, after))
    return {f for f, where in around[1].items() if often(len(where), len(around[0].get(f, ())))}


def fit_chain(model: Model, tokens: list[list[bytes]], toxic: np.ndarray, seed: int, rounds: int = 60) -> None:
    """Weights of the chain by AdaGrad on the likelihood of the tokens' labels, over segments of the texts."""
    marks = markers(tokens, toxic)
    rng = np.random.default_rng(seed)
    segments, tags = [], []
    for ws, y in zip(tokens, toxic, strict=True):
        tag = [int(bool(y) and not marks.isdisjoint(features(w)[:3])) for w in ws]
        starts = list(range(0, len(ws), SEGMENT))
        hot = [a for a in starts if any(tag[a : a + SEGMENT])]
        cold = [a for a in starts if not any(tag[a : a + SEGMENT])] if not y else []
        if cold:
            cold = [cold[i] for i in sorted(rng.choice(len(cold), min(8, len(cold)), replace=False))]
        for a in hot + cold:
            segments.append(ws[a : a + SEGMENT])
            tags.append(tag[a : a + SEGMENT])
    if not segments:
        return
    seen = Counter(f for s in segments for w in s for f in features(w))
    index = {f: i for i, f in enumerate(f for f, n in seen.items() if n >= 3)}
    size = len(index)
    of_word: dict[bytes, list[int]] = {}
    for s in segments:
        for w in s:
            if w not in of_word:
                of_word[w] = [index.get(f, size) for f in features(w)]
    n = len(segments)
    ids = np.full((n, SEGMENT, 4), size, dtype=np.int32)
    gold = np.zeros((n, SEGMENT))
    live = np.zeros((n, SEGMENT), dtype=bool)
    for k, (s, t) in enumerate(zip(segments, tags, strict=True)):
        ids[k, : len(s)] = [of_word[w] for w in s]
        gold[k, : len(s)], live[k, : len(s)] = t, True
    pairs = live[:, 1:] & live[:, :-1]
    gold_steps = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & pairs).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    w, bias, steps = np.zeros(size + 1), -3.0, np.zeros((2, 2))
    past = [np.full(size + 1, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    flat = ids[live].ravel()
    for _ in range(rounds):
        w[size] = 0
        odds = np.exp(np.clip(bias + w[ids].sum(axis=2), -30, 30))
        p, two = _expected(odds, live, pairs, steps)
        diff = np.where(live, gold - p, 0.0)
        g = [np.bincount(flat, np.repeat(diff[live], 4), size + 1) - 0.05 * w, diff.sum(), gold_steps - two - 0.05 * steps]
        for i in range(3):
            past[i] = past[i] + g[i] ** 2
        w = w + 0.3 * g[0] / np.sqrt(past[0])
        bias = bias + 0.3 * g[1] / math.sqrt(past[1])
        steps = steps + 0.1 * g[2] / np.sqrt(past[2])
    model.weights = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}
    model.bias, model.steps = float(bias), steps


def _expected(odds: np.ndarray, live: np.ndarray, pairs: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the tokens, and the expected number of each step, over segments side by side."""
    (a, b), (c, d) = np.exp(steps)
    n, m = odds.shape
    f, q = np.zeros((n, m)), np.ones((n, m))
    f[:, 0] = odds[:, 0]
    for t in range(1, m):
        f[:, t] = odds[:, t] * (b + d * f[:, t - 1]) / (a + c * f[:, t - 1])
    for t in range(m - 1, 0, -1):
        e = odds[:, t] * q[:, t]
        q[:, t - 1] = np.where(live[:, t], (c + d * e) / (a + b * e), 1.0)
    p = f * q / (1 + f * q)
    r, e = f[:, :-1], odds[:, 1:] * q[:, 1:]
    parts = [np.broadcast_to(a, r.shape), b * e, c * r, d * r * e]
    whole = parts[0] + parts[1] + parts[2] + parts[3]
    two = np.array([(x / whole)[pairs].sum() for x in parts]).reshape(2, 2)
    return p, two


def fit_curve(model: Model, tokens: list[list[bytes]], toxic: np.ndarray) -> None:
    """The document's curve by Newton steps, with classes weighted to the share among all labels."""
    x = model.summary(model.marginals(model.emissions(tokens)))
    share = toxic.mean()
    weight = np.where(toxic == 1, model.prior / share, (1 - model.prior) / (1 - share))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (toxic - p)) - 0.1 * beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    model.curve = beta


def spans_of(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Runs of neighbouring tokens with marginals of ``least`` or more, in code points."""
    hot = p >= least
    if not hot.any():
        return []
    out: list[list[int]] = []
    last = -2
    for k, m in enumerate(_WORD.finditer(text)):
        if hot[k]:
            if last == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = k
    return [(a, b) for a, b in out]


SCORED = "doc_id long, score double, expected_tokens double, spans array<struct<start:int,end:int>>"


def score_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    p = model.marginals(model.emissions([words_of(t) for t in texts]))
    return model.scores(p), np.array([x.sum() for x in p]), [spans_of(t or "", x) for t, x in zip(texts, p, strict=True)]


def score_documents(docs: DataFrame, model: Model, extra: list[str] | None = None) -> DataFrame:
    """doc_id, score, expected_tokens and spans of every document; with ``extra`` columns, see ``with_extras``."""
    spark, extra = docs.sparkSession, extra or []
    model.seen = [{}, {}]
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    rows, kinds, names = carried(docs, extra)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        m = shared.value
        for batch in batches:
            for part, texts in text_slices(batch):
                score, total, spans = score_texts(m, texts)
                own = [part.column("doc_id"), pa.array(score, pa.float64()), pa.array(total, pa.float64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], found)]
                yield pa.RecordBatch.from_arrays([*own, *[part.column(n) for n in names]], ["doc_id", "score", "expected_tokens", "spans", *names])
        m.seen = [{}, {}]
        release()

    out = rows.mapInArrow(run, SCORED + kinds)
    return with_extras(out, ["doc_id", "score", "expected_tokens", "spans"], extra, names)
