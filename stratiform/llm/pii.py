"""Personal data: base patterns, and identifiers found by bootstrapped contexts, in DataFrame functions only.

The base kinds are regular expressions with a check for each (address parts, Luhn digits, digit counts). Their
finds are seeds, and so are tokens in well-known forms of keys and digests (``SECRETS``), which are no spans by
themselves. Every other token that looks like an identifier (5 characters or more with a digit) is a candidate.
Seeds and candidates give edges of a graph between instances and lexical patterns. These are made of the words
beside the instance and of what stands between, punctuation included: the word before where punctuation follows it,
also with the instance's shape (kinds of characters, length by powers of two), the two words before, and the word
before with the word after. Words of over 64 characters, or further away than 16 others, give no pattern.

In each round a pattern's confidence is the summed score of its known instances over all its instances plus a prior
of ``doubt`` unknown ones, patterns with enough support and confidence are high, and an instance's score is the
noisy-or of its high patterns; scores of one round are the next one's knowledge. Seeds and candidates outside base
spans that stand in a high pattern at the end are added spans of kind ``ctx``; base spans always stay.

Spans are in code points. Java's matcher would recurse once for each repetition of a group, so repetitions are
possessive where nothing that follows could make them give back; a start inside a run that was already tried is
ruled out by a look-behind. Both leave the matches as they are.

Defined cases: null text is empty; equal texts get equal spans; a null doc_id stays null; an empty table gives no
rows; repeated rows each get a row; extra columns are kept by :func:`redact` and ignored elsewhere, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, fresh, kept, scratch

KINDS = ("email", "ip", "card", "phone")
#: Matches the same spans as the plain patterns, without deep recursion or quadratic retries.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
QUICK = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CANDIDATE = r"(?<![A-Za-z0-9._@/+-])(?=[A-Za-z._@/+-]*+[0-9])[A-Za-z0-9._@/+-]{4,}[A-Za-z0-9](?![A-Za-z0-9])"
#: Well-known forms of digests, unique ids, access keys and signed tokens.
SECRETS = (
    r"(?=[0-9a-f]*[a-f])[0-9a-f]{32,}",
    r"(?=[0-9A-F]*[A-F])[0-9A-F]{32,}",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"A(?:KI|SI)A[0-9A-Z]{16}",
    r"gh[oprsu]_[0-9A-Za-z]{36,}",
    r"eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+",
)
_WORD, _OTHER = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
#: The word before with what follows it, the two words before, and the word after with what precedes it.
BEFORE_1 = rf"(?<!{_WORD})({_WORD}{{1,64}}{_OTHER}{{0,16}})$"
BEFORE_2 = rf"(?<!{_WORD})({_WORD}{{1,64}}{_OTHER}{{1,16}}{_WORD}{{1,64}}{_OTHER}{{0,16}})$"
AFTER = rf"^({_OTHER}{{0,16}}{_WORD}{{1,64}})(?!{_WORD})"
#: More characters than any context holds.
BESIDE = 256
BLOCK = 256
_SPANS = "array<struct<k:int,s:int,e:int>>"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.when(F.regexp_replace(p, "^0+", "") == "", 0).otherwise(256)) <= 255
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        d = F.translate(m, " -", "")
        n = F.length(d)

        def add(total: Column, i: Column) -> Column:
            x = d.substr(n - i, F.lit(1)).cast("int")
            return total + F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

        luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0
        return F.when((n >= 16) & (n <= 19), luhn).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _before(lens: Column, blocks: Column, i: Column) -> Column:
    """The sum of the first i lengths, by blocks, so many matches in one text don't cost their square."""
    whole = (i / BLOCK).cast("int")
    return _sum(F.slice(blocks, F.lit(1), whole)) + _sum(F.slice(lens, whole * BLOCK + 1, i % BLOCK))


def _prepared(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Adds the matches m_, the texts between g_, the lengths l_ and their sums by blocks b_ of one pattern."""
    text, m, g, lens = F.col("text"), F.col(f"m_{name}"), F.col(f"g_{name}"), F.col(f"l_{name}")
    none = F.array().cast("array<string>")
    ints = F.array().cast("array<int>")
    df = df.withColumn(f"m_{name}", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(f"g_{name}", F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn(f"l_{name}", F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: F.length(g[i]) + F.length(m[i]))).otherwise(ints))
    block = lambda b: _sum(F.slice(lens, b * BLOCK + 1, BLOCK))
    return df.withColumn(f"b_{name}", F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(m) / BLOCK).cast("int") - 1), block)).otherwise(ints))


def shape(v: Column) -> Column:
    """The kinds of characters in an instance, and its length by powers of two."""
    kinds = [F.when(v.rlike(pattern), name).otherwise("") for name, pattern in (("d", "[0-9]"), ("l", "[a-z]"), ("u", "[A-Z]"), ("s", "[^A-Za-z0-9]"))]
    return F.concat(*kinds, F.floor(F.log2(F.length(v))).cast("string"))


def _patterns(left: Column, v: Column, right: Column) -> Column:
    """The lexical patterns of an instance between two texts."""
    tail, head = F.lower(F.right(left, F.lit(BESIDE))), F.lower(F.left(right, F.lit(BESIDE)))
    one, two, after = F.regexp_extract(tail, BEFORE_1, 1), F.regexp_extract(tail, BEFORE_2, 1), F.regexp_extract(head, AFTER, 1)
    marked = F.when(one.rlike(r"[^\p{L}\p{N}_\s]"), F.concat(F.lit("1 "), one))
    shaped = F.concat(marked, F.lit("\u2026"), shape(v))
    both = F.when((one != "") & (after != ""), F.concat(F.lit("3 "), one, F.lit("\u2026"), after))
    contexts = F.array(marked, shaped, F.when(two != "", F.concat(F.lit("2 "), two)), both)
    return F.transform(F.array_compact(contexts), lambda c: F.regexp_replace(c, r"\s+", " "))


def _finds(name: str, valid, contexts: bool) -> Column:
    """Structs v, s, e (and p, its patterns) of a pattern's valid matches."""
    m, g, lens, blocks = (F.col(f"{x}_{name}") for x in "mglb")

    def one(i: Column) -> Column:
        start = _before(lens, blocks, i) + F.length(g[i])
        parts = [m[i].alias("v"), start.alias("s"), (start + F.length(m[i])).alias("e")]
        return F.struct(*parts, *([_patterns(g[i], m[i], g[i + 1]).alias("p")] if contexts else []))

    kind = "array<struct<v:string,s:int,e:int" + (",p:array<string>" if contexts else "") + ">>"
    at = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: valid(m[i]))
    return F.when(F.size(m) > 0, F.transform(at, one)).otherwise(F.array().cast(kind)).cast(kind)


def extract(docs: DataFrame) -> DataFrame:
    """A row for each document: rid, doc_id, text_hash, base spans, seeds, and other candidates (``known`` where they look like secrets), with their patterns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    df = df.withColumn("rid", F.monotonically_increasing_id()).withColumn("text_hash", F.xxhash64("text"))
    for k in KINDS:
        guard = F.contains(F.col("text"), F.lit(QUICK[k])) if QUICK[k] else F.col("digit")
        df = _prepared(df, k, PATTERNS[k], guard if k == "email" else guard & F.col("digit"))
    df = _prepared(df, "other", CANDIDATE, F.col("digit"))
    for k in KINDS:
        df = df.withColumn(f"f_{k}", _finds(k, _checker(k), True))
    df = df.withColumn("f_other", _finds("other", lambda m: F.lit(True), True))
    base = F.concat(*[F.transform(f"f_{k}", _as_span(i)) for i, k in enumerate(KINDS)]).cast(_SPANS)
    df = df.withColumn("base", base)
    secret = "^(?:" + "|".join(SECRETS) + ")$"
    bare = lambda x: F.struct(x["v"].alias("v"), x["p"].alias("p"))
    seeds = F.concat(*[F.transform(f"f_{k}", bare) for k in KINDS])
    apart = lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"]))
    return df.select("rid", "doc_id", "text_hash", "base", seeds.alias("seeds"), F.transform(F.filter("f_other", apart), lambda x: x.withField("known", x["v"].rlike(secret))).alias("cands"))


def _checker(kind: str):
    return lambda m: _valid(kind, m)


def _as_span(k: int):
    return lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def graph(found: DataFrame) -> DataFrame:
    """The edges (p, v, known) of patterns and instances in ``found``, each once."""
    seeds = found.select(F.explode("seeds").alias("x")).select("x.v", F.explode("x.p").alias("p"), F.lit(1).alias("known"))
    cands = found.select(F.explode("cands").alias("x")).select("x.v", F.explode("x.p").alias("p"), F.col("x.known").cast("int").alias("known"))
    return seeds.union(cands).groupBy("p", "v").agg(F.max("known").alias("known"))


def learn_patterns(edges: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.75, doubt: float = 2.0) -> DataFrame:
    """(p, confidence) of the patterns that are high after ``rounds`` rounds over the graph ``edges``."""
    edges = kept(edges)
    scores = edges.where("known = 1").select("v", F.lit(1.0).alias("score")).distinct()
    high = None
    for _ in range(rounds):
        scored = edges.join(scores, "v", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        stats = scored.groupBy("p").agg(F.sum("score").alias("known"), F.count("*").alias("n"), F.sum((F.col("score") >= 0.9).cast("int")).alias("sure"))
        rate = F.col("known") / (F.col("n") + doubt)
        high = kept(stats.where((F.col("sure") >= support) & (rate >= confidence)).select("p", rate.alias("confidence")))
        news = edges.join(high, "p").groupBy("v").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        seeds = edges.where("known = 1").select("v", F.lit(1.0).alias("score"))
        scores = kept(news.union(seeds).groupBy("v").agg(F.max("score").alias("score")))
    return high


def private_spans(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_hash, base and added spans (arrays of k, s, e; k is the index in KINDS, 4 for ``ctx``)."""
    where = scratch(docs.sparkSession, "pii")
    extract(docs).write.parquet(where)
    found = docs.sparkSession.read.parquet(where)
    high = learn_patterns(graph(found), **options)
    if high.isEmpty():
        return found.select("doc_id", "text_hash", "base", F.array().cast(_SPANS).alias("added"))
    side = high.select("p")
    side = F.broadcast(side) if fits_broadcast(side, 100_000) else side
    spans = found.select("rid", F.explode("cands").alias("c")).select("rid", "c.s", "c.e", F.explode("c.p").alias("p")).join(side, "p").select("rid", F.struct(F.lit(len(KINDS)).alias("k"), "s", "e").alias("x"))
    added = spans.groupBy("rid").agg(F.array_sort(F.collect_set("x")).alias("added"))
    return found.join(added, "rid", "left").select("doc_id", "text_hash", "base", F.coalesce("added", F.array().cast(_SPANS)).cast(_SPANS).alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, "ctx")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, longest first where they overlap, replaced by its kind in angle brackets."""
    names = F.array(*map(F.lit, (*KINDS, "ctx")))
    kind = "struct<at:int,out:array<string>>"

    def add(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        piece = F.array(text.substr(acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("<"), names[x["k"]], F.lit(">")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out")).cast(kind)

    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), x["k"].alias("k"), x["e"].alias("e"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(kind)
    return F.aggregate(order, start, add, lambda a: F.concat(F.array_join(a["out"], ""), text.substr(a["at"] + 1, F.length(text))))


def redact(docs: DataFrame, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """The documents with their private spans replaced in ``text``; all columns stay, in order."""
    found = private_spans(docs, **options).select("doc_id", "text_hash", F.concat("base", "added").alias("spans")).where(F.size("spans") > 0)
    at, name, spans = (fresh(docs, n) for n in ("pii_id", "pii_hash", "pii_spans"))
    found = kept(found.dropDuplicates(["doc_id", "text_hash"]).toDF(at, name, spans))
    side = F.broadcast(found) if fits_broadcast(found, broadcast_rows) else found
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col(at)) & (F.xxhash64(text) == F.col(name))
    out = docs.join(side, same, "left")
    clean = F.when(F.col(spans).isNotNull(), redacted(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return out.select(*[clean.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
