"""Byte-level BPE by DuckDB recursive queries, run inside each partition.

A merge table holds every pair of tokens whose bytes together are a token. The recursive query starts from a
word's single bytes; each round lists the token positions of the words still going on, joins them with the merge
table, and contracts each word's leftmost pair of minimum rank, until no pair is left (a word of over 2,048 bytes is
contracted by the same rule with a heap). A word that is itself a
token is that token. Decoding joins (word, position, id) rows with the vocabulary and gathers the bytes in
position order.

The pattern cuts texts into words. A single space between two other characters starts a new word under every
pattern whose words may begin with a space, and a letter ends its word before a stop or comma, so texts are
first cut there in Arrow; only different pieces reach Python, and only new ones the pattern and the queries. A
text's ids and bytes are its pieces' ids and decoded bytes, put together in Arrow again.

Defined cases: null text is empty (no ids, no bytes); special tokens' strings are ordinary text; texts of any
length are decoded in runs of ids; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import Remembered, arrow_slices, carried, distinct_of, joined, resident, with_extras

ENCODE = """
WITH RECURSIVE going(word, tokens, done) AS (
    SELECT word, tokens, false FROM fresh
    UNION ALL
    SELECT going.word,
           CASE WHEN best IS NULL THEN tokens
                ELSE list_concat(list_append(tokens[1 : (best & 4294967295)::INT - 1], (best >> 32)::INT), tokens[(best & 4294967295)::INT + 2 :]) END,
           best IS NULL
    FROM going LEFT JOIN (
        SELECT word, min(merged::BIGINT << 32 | pos) AS best
        FROM (
            SELECT word, unnest(tokens[1 : len(tokens) - 1]) AS a, unnest(tokens[2 :]) AS b, unnest(range(1, len(tokens))) AS pos
            FROM going WHERE NOT done
        ) AS positions
        JOIN merges ON pair = (a::BIGINT << 32 | b)
        GROUP BY word
    ) AS least ON least.word = going.word
    WHERE NOT done
)
SELECT word, tokens FROM going WHERE done ORDER BY word
"""
DECODE = """
SELECT doc, array_to_string(list(bytes ORDER BY pos), '') AS bytes
FROM positions JOIN vocabulary USING (id) GROUP BY doc
"""
#: Words of more bytes are contracted with a heap: rounds over them would cost the square of their length.
LONG = 2048
#: Most words that one encoding query takes.
BATCH = 10_000
#: Most ids that one decoding query takes.
RUN = 1 << 18
#: Parts pieces in a text that doesn't hold it.
PART = "\x1f"
_BLANK = r"\x00-\x20\x7F-\x{A0}\x{1680}\x{2000}-\x{206F}\x{3000}"
#: Texts in which cutting before every space, or at PART, may not be safe.
_UNSAFE = f"\x1f|[{_BLANK}] (?:[{_BLANK}]|$)|  | $"
#: A letter, then a stop or the like and a space: that is a word of its own under the pattern.
_STOP = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([,.;:!?)] )"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class DuckBpe:
    """Encoder and decoder of one worker, with its own in-memory DuckDB."""

    def __init__(self, path: str, pattern: str, keep: int = 150_000):
        import duckdb
        import pyarrow as pa
        import regex

        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back sooner than Arrow's own
        self.pa = pa
        self.cut = regex.compile(pattern).findall
        self.ranks = ranks = read_ranks(path)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "150MB", "temp_directory": "", "allocator_flush_threshold": "1MB", "allocator_bulk_deallocation_flush_threshold": "1MB"})
        self._load("merges", pair=pa.array(pairs, pa.int64()), merged=pa.array(merged, pa.int32()))
        self._load("vocabulary", id=pa.array(ranks.values(), pa.int32()), bytes=pa.array([t.decode("latin-1") for t in ranks]))
        self.merge_of: dict[int, int] | None = None
        self.pieces = Remembered(self.code, 2, keep)

    def _load(self, name: str, **columns) -> None:
        self.db.register("incoming", self.pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of the pattern, each as little-endian 32-bit integers."""
        pa, raw = self.pa, [w.encode() for w in words]
        coded: dict[bytes, bytes] = {}
        hard = []
        for b in raw:
            if (rank := self.ranks.get(b)) is not None:
                coded[b] = rank.to_bytes(4, "little")
            elif len(b) > LONG:
                coded[b] = self._by_heap(b)
            else:
                hard.append(b)
        for a in range(0, len(hard), BATCH):
            some = hard[a : a + BATCH]
            tokens = pa.ListArray.from_arrays(_starts(map(len, some), len(some)), self.single[np.frombuffer(b"".join(some), dtype=np.uint8)])
            self.db.register("fresh", pa.table({"word": np.arange(len(some), dtype=np.int32), "tokens": tokens}))
            got = self.db.sql(ENCODE).to_arrow_table()["tokens"].combine_chunks()
            self.db.unregister("fresh")
            ends = ((got.offsets.to_numpy() - got.offsets[0].as_py()) * 4).tolist()
            ids = got.flatten().to_numpy().astype("<u4").tobytes()
            coded.update((w, ids[i:j]) for w, i, j in zip(some, ends[:-1], ends[1:], strict=True))
        return [coded[b] for b in raw]

    def _by_heap(self, word: bytes) -> bytes:
        """The same contractions for one very long word, with a heap instead of a round for each."""
        import heapq

        if self.merge_of is None:
            self.merge_of = dict(self.db.sql("SELECT pair, merged FROM merges").fetchall())
        get = self.merge_of.get
        ids = self.single[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or get(ids[i] << 32 | ids[j]) != m:
                continue  # one of the pair has been merged meanwhile
            ids[i], ids[j], after[i] = m, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (x := get(ids[a] << 32 | ids[after[a]])) is not None:
                    heapq.heappush(heap, (x, a))
        return b"".join(x.to_bytes(4, "little") for x in ids if x is not None)

    def code(self, pieces: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids, and the bytes decoded from them, of pieces of text as :meth:`cut_texts` makes them."""
        parts = {w: self.cut(w) for w in pieces if not (w[1:] if w[:1] == " " else w).isalpha()}
        words = list({p for w in pieces for p in parts.get(w, (w,))})
        ids = self.encode_words(words)
        of = dict(zip(words, zip(ids, self.decode(ids), strict=True), strict=True))
        both = [of[w] if w not in parts else (b"".join([of[p][0] for p in parts[w]]), b"".join([of[p][1] for p in parts[w]])) for w in pieces]
        return [x for x, _ in both], [x for _, x in both]

    def cut_texts(self, texts):
        """A list array of the pieces of each text (an Arrow string array without nulls)."""
        import pyarrow.compute as pc

        pa = self.pa
        odd = pc.match_substring_regex(texts, _UNSAFE)
        plain = pc.replace_substring(pc.replace_substring_regex(texts.filter(pc.invert(odd)), _STOP, "\\1" + PART + "\\2"), " ", PART + " ")
        plain = pc.split_pattern(plain, PART)
        if not pc.any(odd).as_py():
            return plain
        rest = pa.array([self.cut(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
        is_odd = odd.to_numpy(zero_copy_only=False)
        place = np.where(is_odd, len(plain) + np.cumsum(is_odd) - 1, np.cumsum(~is_odd) - 1)
        return pa.concat_arrays([plain, rest]).take(pa.array(place))

    def encode_decode(self, texts):
        """Arrow binaries: each text's ids as little-endian 32-bit integers, and the bytes decoded from them."""
        pieces, at, ends = distinct_of(self.cut_texts(texts))
        columns, where = self.pieces.get(pieces)
        at = self.pa.array(where).take(at)
        return tuple(joined(c, at, ends) for c in columns)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        return self.encode_decode(self.pa.array([t or "" for t in texts], self.pa.string()))[0].to_pylist()

    def decode(self, coded: list[bytes]) -> list[bytes]:
        """The bytes of each run of little-endian 32-bit ids."""
        ids = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)
        starts = _starts((len(x) // 4 for x in coded), len(coded))
        of = np.repeat(np.arange(len(coded), dtype=np.int32), np.diff(starts))
        out: list[bytes] = [b""] * len(coded)
        for a in range(0, len(ids), RUN):
            part = slice(a, a + RUN)
            self.db.register("positions", self.pa.table({"doc": of[part], "pos": np.arange(len(ids[part]), dtype=np.int32), "id": ids[part]}))
            for k, text in self.db.sql(DECODE).fetchall():
                out[k] += text.encode("latin-1")
            self.db.unregister("positions")
        return out


def _starts(sizes, n: int) -> np.ndarray:
    out = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.fromiter(sizes, dtype=np.int32, count=n), out=out[1:])
    return out


def coder(path: str, pattern: str) -> DuckBpe:
    """The coder of this worker process."""
    return resident(("bpe", path, pattern), lambda: DuckBpe(path, pattern))


def encode_decode(docs: DataFrame, path: str, pattern: str, extra: list[str] | None = None) -> DataFrame:
    """doc_id, ids (little-endian 32-bit) and decoded (bytes from the ids) of every document; no shuffle.

    With ``extra`` columns of the documents, see ``with_extras``.
    """
    extra = extra or []
    rows, kinds, names = carried(docs, extra)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        bpe = coder(path, pattern)
        for batch in batches:
            for part in arrow_slices(batch, 1 << 20):
                own = [part.column("doc_id"), *bpe.encode_decode(pc.fill_null(part.column("text"), ""))]
                yield pa.RecordBatch.from_arrays([*own, *[part.column(n) for n in names]], ["doc_id", "ids", "decoded", *names])

    out = rows.mapInArrow(run, "doc_id long, ids binary, decoded binary" + kinds)
    return with_extras(out, ["doc_id", "ids", "decoded"], extra, names)
