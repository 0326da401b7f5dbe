"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs`` with the columns of ``docs``; the last
one adds the token ids' count and digest and the decoded text's digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.llm import bpe, crf, decontam, nearjoin, pii
from stratiform.llm.common import fresh, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, limit: float = 0.3) -> DataFrame:
    """Documents whose toxicity score is under ``limit``; learnt from the labels that aren't held out."""
    model = crf.train(docs, table(spark, sf_dir, "labels"))
    scored = crf.score_documents(docs, model, extra=docs.columns)
    result = F.col(scored.columns[0])
    return scored.where(result["score"] < limit).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each class of near copies (five words, similarity 0.8)."""
    return nearjoin.one_of_each(docs, nearjoin.near_classes(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens, ids_sha256 and decoded_sha256 of their byte-level BPE."""
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, extra=docs.columns)
    result = F.col(coded.columns[0])
    added = {
        "n_tokens": (F.octet_length(result["ids"]) / 4).cast("long"),
        "ids_sha256": F.sha2(result["ids"], 256),
        "decoded_sha256": F.sha2(result["decoded"], 256),
    }
    return coded.select(*[F.col(f"`{c}`") for c in docs.columns], *[x.alias(fresh(docs, n)) for n, x in added.items()])


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("private data", redact_private),
    ("tokens", tokenize),
]

#: SQL can express neither the fitted scores nor the byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
