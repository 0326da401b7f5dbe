"""Binary token output: every document's ids in ascending doc_id order, in Elias-Fano files.

Texts are tokenised where they lie, and only ids are shuffled: into ranges of doc_id (then of a hash of the text, so
repeated or absent doc_ids don't end up in one task), each written as one file under the shared folder. The
manifest has a row for each file; running sums over it give each file's first global offset, so a document's start
is that plus one select.

Equal words are encoded once: white space always ends a token and is dropped, so a text's ids are its words'
ids in order, put together in Arrow. Words that a worker hasn't met lately are encoded together, parted by a
special token's string.

Defined cases: null text is empty (only the end id); null doc_ids come first; rows of one doc_id are ordered by their
text's hash, then by their ids; an empty table writes no file; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, arrow_slices, bounded_batches, default_parallelism, distinct_of, filesystem, joined, kept, range_bucket, resident, scratch
from .eliasfano import TokenFile, TokenFileWriter

MANIFEST = "part int, path string, n_docs long, n_ids long"
#: A letter or digit before a stop or the like: the tokenizer certainly cuts between them.
_STOP = r"([A-Za-z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}])([,.;:!?)])"
#: Words encoded as one text.
TOGETHER = 64


class WordEncoder:
    """Ids of texts as little-endian 16- or 32-bit integers, by the tokenizers library, with words remembered."""

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.specials = [x for x in special if x]
        self.firsts = {x[0] for x in self.specials}
        norm = self.tok.normalizer
        self.lowers = norm is not None and norm.normalize_str("AZ") == "az"
        self.mark = self.specials[-1] if self.specials else None
        self.mark_id = self.tok.token_to_id(self.mark) if self.mark else None
        self.words = Remembered(lambda words: [self.code(words)], 1, keep)

    def _plain(self, words: list[str]) -> dict[str, bytes]:
        ids = self.tok.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.asarray(x.ids, self.dtype).tobytes() for w, x in zip(words, ids, strict=True)}

    def code(self, words: list[str]) -> list[bytes]:
        """The ids of each word. ASCII words are lowered first, where the tokenizer does so itself."""
        low = [w.lower() if self.lowers and w.isascii() and self.firsts.isdisjoint(w) else w for w in words]
        new = list(dict.fromkeys(low))
        odd = [w for w in new if self.mark is None or (not self.firsts.isdisjoint(w) and any(s in w for s in self.specials))]
        out = self._plain(odd) if odd else {}
        new = [w for w in new if w not in out]
        texts = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        coded = self.tok.encode_batch_fast([self.mark.join(some) for some in texts], add_special_tokens=False) if texts else []
        for some, x in zip(texts, coded, strict=True):
            ids = np.asarray(x.ids, dtype=np.int64)
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            if len(ends) != len(some):
                out |= self._plain(some)
                continue
            raw, w, a = ids.astype(self.dtype).tobytes(), self.width, 0
            for word, b in zip(some, ends, strict=True):
                out[word] = raw[a * w : b * w]
                a = b + 1
        return [out[w] for w in low]

    def encode(self, texts):
        """An Arrow binary for each text (an Arrow string array without nulls)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        apart = pc.replace_substring_regex(pc.replace_substring_regex(texts, r"[\t\n\r]", " "), _STOP, r"\1 \2")
        words, at, ends = distinct_of(pc.split_pattern(apart, " "))
        (ids,), where = self.words.get(words)
        return joined(ids, pa.array(where).take(at), ends)


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process."""
    return resident(("words", path), lambda: WordEncoder(path))


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """doc_id, text_hash, width (bytes of an id) and ids (with the end id) of every document; no shuffle."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        enc = encoder(vocabulary)
        end = np.asarray([end_id], enc.dtype).tobytes()
        for batch in batches:
            for part in arrow_slices(batch):
                ids = pc.binary_join_element_wise(enc.encode(part.column("text")), pa.scalar(end, pa.binary()), pa.scalar(b"", pa.binary()))
                width = pa.array(np.full(len(ids), enc.width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), width, ids], ["doc_id", "text_hash", "width", "ids"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, width int, ids binary")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the files and returns the manifest: part, path, n_docs and n_ids, a row for each file."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    bucket, n = range_bucket(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "text_hash", default_parallelism(spark))
    coded = encode_documents(docs, vocabulary, end_id).withColumn("bucket", bucket)
    rows = coded.repartitionById(n, "bucket").sortWithinPartitions("doc_id", "text_hash", "ids")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, root = filesystem(folder)
        ctx, out = TaskContext.get(), None
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.ids"
                    out = TokenFileWriter(fs.open_output_stream(f"{root}/{path}", compression=None), batch.column("width")[0].as_py())
                out.add(doc, ids.as_buffer())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([ctx.partitionId()], pa.int32()), "path": [f"{folder}/{path}"], "n_docs": [out.n_docs], "n_ids": [out.n_ids]})

    return kept(rows.select("doc_id", "width", "ids").mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and file of every document, from the files by selects."""
    spark = manifest.sparkSession
    files, start = [], 0
    for x in sorted(manifest.collect()):  # a row for each file
        files.append((x.path, start))
        start += x.n_ids
    named = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in batch.itertuples(index=False):
                fs, at = filesystem(path)
                with fs.open_input_file(at) as f:
                    rows = [(doc, base + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path) for doc, a, ids in TokenFile(f).scan()]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "file"])
                yield out.astype({"doc_id": "Int64"})

    return named.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
