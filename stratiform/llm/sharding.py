"""Reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking.

Row i of the n rows in ascending doc_id order gets the rank p(i), where p permutes 0..n-1;
shard = p mod k and slot = p div k. Both can be computed from (i, n, seed) alone, and the inverse gives
the row that a shard's slot holds, so a reader can seek without an index. Shard sizes differ by
one at most. Equal rows and hot sources need no care: only numbers are permuted.

Defined cases: null text has no bytes (size 1, crc32 0); null doc_ids come first; repeated doc_ids are
numbered after each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered

#: Odd multipliers of the round function, one for each of the six rounds (fixed values).
ROUND_MULTIPLIERS = (0x2545F491, 0x1B873593, 0x19660D1D, 0x2C9277B5, 0x3C6EF35F, 0x27D4EB2D)


class FeistelPermutation:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, seed: int = 17):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keys = [(seed * 0x9E3779B1 + k * 0x85EBCA6B) & 0x3FFFFFFF for k in range(len(ROUND_MULTIPLIERS))]

    def _round(self, k: int, x: np.ndarray) -> np.ndarray:
        y = ((x + self.keys[k]) & 0x3FFFFFFF) * ROUND_MULTIPLIERS[k]
        return (y ^ (y >> 17) ^ (y >> 31)) & self.mask

    def _once(self, v: np.ndarray, back: bool) -> np.ndarray:
        left, right = v >> self.half, v & self.mask
        if back:
            for k in reversed(range(len(self.keys))):
                left, right = right ^ self._round(k, left), left
        else:
            for k in range(len(self.keys)):
                left, right = right, left ^ self._round(k, right)
        return (left << self.half) | right

    def _walk(self, v, back: bool) -> np.ndarray:
        v = self._once(np.asarray(v, dtype=np.int64), back)
        while (out := v >= self.n).any():  # under 4 steps on average: the domain has less than 4n values
            v[out] = self._once(v[out], back)
        return v

    def forward(self, rows) -> np.ndarray:
        return self._walk(rows, False)

    def inverse(self, ranks) -> np.ndarray:
        return self._walk(ranks, True)

    def place(self, rows, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of row numbers."""
        r = self.forward(rows)
        return r % shards, r // shards

    def row_at(self, shard, slot, shards: int) -> np.ndarray:
        """The row number that a shard's slot holds."""
        return self.inverse(np.asarray(slot, dtype=np.int64) * shards + shard)


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, row_no, shard and slot for every document (law: rows)."""
    bytes_ = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    slim = docs.select(
        F.col("doc_id"),
        (F.octet_length(bytes_) + 1).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
    )
    rows, total = numbered(slim, ["doc_id", "text_crc32", "size"])
    perm = FeistelPermutation(total, seed)

    @F.pandas_udf("long")
    def rank(no: pd.Series) -> pd.Series:
        return pd.Series(perm.forward(no.to_numpy()))

    return rows.withColumn("_rank", rank("row_no")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_rank") % shards).cast("int").alias("shard"),
        F.expr(f"_rank div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )


def crc32_of(text: str | None) -> int:
    """The unsigned CRC-32 of a text's UTF-8 bytes."""
    return zlib.crc32((text or "").encode())
