"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam
from .common import fits_broadcast, kept, table


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_shard_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op1_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearjoin import near_classes

    return near_classes(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.private_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.span_text(F.concat("base", "added")).alias("spans"),
    )


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    found = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenfiles import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_turns, read_back

    trap = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_turns(rows)).drop("n_attachments")


def op10_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the search's results on rows whose doc_id is divisible by 100, the queries against all documents."""
    from .editembed import fingerprint_documents, nearest_texts

    docs = table(spark, sf_dir, "documents")
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    found = kept(nearest_texts(docs, docs.where(asked)).withColumnRenamed("text_hash", "found_hash"))
    side = F.broadcast(found) if fits_broadcast(found, 500_000) else found
    out = fingerprint_documents(docs).join(side, asked & (F.col("text_hash") == F.col("found_hash")), "left")
    return out.drop("text_hash", "found_hash")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf import held_out, score_documents, train

    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "expected_tokens",
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("toxic_spans"),
    )


QUERIES = {
    "op1_chosen_path_join": op1_chosen_path_join,
    "op2_context_pii": op2_context_pii,
    "op3_warc_salvage": op3_warc_salvage,
    "op4_winnowing": op4_winnowing,
    "op5_shard_permutation": op5_shard_permutation,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_toxicity_crf": op7_toxicity_crf,
    "op8_elias_fano_ids": op8_elias_fano_ids,
    "op9_typed_chat": op9_typed_chat,
    "op10_edit_embedding": op10_edit_embedding,
}

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
n AS (
    SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS s
    FROM d),
g AS (SELECT s, len(s) AS k, min(doc_id) AS rep, count(*) AS copies, row_number() OVER () AS gid FROM n GROUP BY s),
tok AS (SELECT gid, k, unnest(s) AS t FROM g),
pairs AS (
    SELECT a.gid AS x, b.gid AS y FROM tok a JOIN tok b ON a.t = b.t AND a.gid < b.gid
    GROUP BY a.gid, b.gid, a.k, b.k HAVING 9 * count(*) >= 4 * (a.k + b.k)),
e AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT gid AS node, gid AS origin FROM g UNION SELECT y, origin FROM reach JOIN e ON x = node),
class AS (SELECT node AS gid, min(rep) AS class_id FROM reach JOIN g ON origin = gid GROUP BY node),
near AS (SELECT x AS gid, count(*) AS n_near, sum(copies) AS linked FROM e JOIN g ON y = gid GROUP BY x)
SELECT doc_id, class_id, (copies - 1 + coalesce(linked, 0))::BIGINT AS n_links, copies AS n_copies, coalesce(n_near, 0)::BIGINT AS n_near
FROM n JOIN g USING (s) JOIN class USING (gid) LEFT JOIN near USING (gid)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
h AS (SELECT *, sha1(body) AS hex FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + (5 * i) // 4, 2))::INTEGER >> (3 - (5 * i) % 4)::INTEGER) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM h
"""

CHAT = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
    SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 WHEN 'system' THEN 13 ELSE 21 + length(role) END + length(text)
        + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|ANS\]|SYS\]|ROLE\]|TURN\]|IMG\]|AUD\]|DOC\])')) AS formatted
    FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(formatted)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_chosen_path_join": NEAR,
    "op3_warc_salvage": WARC,
    "op4_winnowing": decontam.ORACLE,
    "op9_typed_chat": CHAT,
}
