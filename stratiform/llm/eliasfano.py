"""Token-id files with Elias-Fano document boundaries.

A file holds the concatenated ids of its documents (16 or 32 bits each), then two Elias-Fano sequences: the
n+1 document boundaries and the ascending doc_ids. A sequence of n values below u takes about
n * (2 + log2(u / n)) bits: the low bits lie packed side by side, the high parts are unary in a bit vector in
which select(i) finds the i-th value from a sampled 32-bit position and a scan of a few bytes. No table of
64-bit offsets is written or needed.
"""

from __future__ import annotations

import io
import json
import struct

import numpy as np

MAGIC = b"SFEF1\n"
SAMPLE = 256
#: Values packed together; a multiple of 8, so blocks of packed bits meet at bytes.
BLOCK = 1 << 15
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class EliasFano:
    """A non-decreasing sequence of integers, from packed parts."""

    def __init__(self, n: int, low_bits: int, base: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.base, self.low, self.high, self.samples = n, low_bits, base, low, high, samples

    @classmethod
    def build(cls, values) -> EliasFano:
        n = len(values)
        base, last = (int(values[0]), int(values[-1])) if n else (0, 0)
        return cls.from_blocks(n, base, last, ([int(x) for x in values[a : a + BLOCK]] for a in range(0, n, BLOCK)))

    @classmethod
    def from_blocks(cls, n: int, base: int, last: int, blocks) -> EliasFano:
        """From lists of ``BLOCK`` values each (the last may be shorter), of which one is held at a time."""
        u = last - base + 1
        low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
        high = np.zeros((((u - 1 >> low_bits) + n + 7) >> 3) if n else 0, dtype=np.uint8)
        low, samples, i, before = [], [], 0, base
        for block in blocks:
            if block[0] < before or any(x > y for x, y in zip(block, block[1:], strict=False)):
                raise ValueError("values must not decrease")
            before = block[-1]
            v = np.array([x - base for x in block], dtype=np.uint64)
            bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)).astype(np.uint8) & 1
            low.append(np.packbits(bits.ravel(), bitorder="little"))
            ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(i, i + len(v))
            np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
            samples.append(ones[-i % SAMPLE :: SAMPLE].astype(np.uint32))
            i += len(v)
        none = np.zeros(0, np.uint8)
        return cls(n, low_bits, base, np.concatenate([none, *low]), high, np.concatenate([none.astype(np.uint32), *samples]))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The i-th value by select: from the last sampled one, by bytes, then by bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        pos, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = pos >> 3
        word = int(self.high[byte]) >> (pos & 7) << (pos & 7)
        while (c := int(_POP[word])) <= left:
            left -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        upper = (byte << 3) + (word & -word).bit_length() - 1 - i
        return self.base + ((upper << self.low_bits) | self._low(i))

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        chunk = int.from_bytes(self.low[a >> 3 : (b + 7) >> 3].tobytes(), "little")
        return (chunk >> (a & 7)) & ((1 << self.low_bits) - 1)

    def parts(self) -> tuple[dict, bytes]:
        blobs = [x.tobytes() for x in (self.low, self.high, self.samples)]
        return {"n": self.n, "low_bits": self.low_bits, "base": self.base, "sizes": [len(b) for b in blobs]}, b"".join(blobs)

    @classmethod
    def load(cls, head: dict, blob: bytes) -> EliasFano:
        a, b, c = head["sizes"]
        return cls(head["n"], head["low_bits"], head["base"], np.frombuffer(blob, np.uint8, a), np.frombuffer(blob, np.uint8, b, a), np.frombuffer(blob, np.uint32, c // 4, a + b))


class Rising:
    """A non-decreasing sequence as the differences of its values, 7 bits a byte."""

    def __init__(self):
        self.n, self.base, self.last, self.raw = 0, 0, 0, bytearray()

    def add(self, value: int) -> None:
        if not self.n:
            self.base = self.last = value
        d = value - self.last
        if d < 0:
            raise ValueError("values must not decrease")
        while d > 127:
            self.raw.append(d & 127 | 128)
            d >>= 7
        self.raw.append(d)
        self.n, self.last = self.n + 1, value

    def blocks(self):
        out, at, d, shift = [], self.base, 0, 0
        for b in self.raw:
            d |= (b & 127) << shift
            shift += 7
            if b < 128:
                at += d
                out.append(at)
                d = shift = 0
                if len(out) == BLOCK:
                    yield out
                    out = []
        if out:
            yield out

    def packed(self) -> EliasFano:
        return EliasFano.from_blocks(self.n, self.base, self.last, self.blocks())


class TokenFileWriter:
    """Streams documents into one file; a few bytes for each document stay in memory."""

    def __init__(self, out, width: int = 2):
        self.out, self.width = out, width
        self.ids, self.bounds, self.n_ids, self.nulls = Rising(), Rising(), 0, 0
        self.bounds.add(0)
        out.write(MAGIC)

    @property
    def n_docs(self) -> int:
        return self.bounds.n - 1

    def add(self, doc_id: int | None, ids) -> None:
        """``ids``: the document's ids as little-endian integers of the file's width."""
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.add(doc_id)
        self.n_ids += len(ids) // self.width
        self.bounds.add(self.n_ids)
        self.out.write(ids)

    def close(self) -> None:
        (bh, bb), (dh, db) = self.bounds.packed().parts(), self.ids.packed().parts()
        foot = json.dumps({"width": self.width, "n_ids": self.n_ids, "nulls": self.nulls, "bounds": bh, "docs": dh}).encode()
        self.out.write(bb + db + foot + struct.pack("<I", len(foot)) + MAGIC)
        self.out.close()


class TokenFile:
    """Random access to one file (a seekable binary file object)."""

    def __init__(self, f):
        self.f = f
        f.seek(0, io.SEEK_END)
        end = f.tell()
        f.seek(end - len(MAGIC) - 4)
        tail = f.read(len(MAGIC) + 4)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack("<I", tail[:4])
        f.seek(end - len(tail) - n)
        self.head = json.loads(f.read(n))
        self.dtype = np.dtype(f"<u{self.head['width']}")
        at = len(MAGIC) + self.head["n_ids"] * self.dtype.itemsize
        self.bounds = EliasFano.load(self.head["bounds"], self._at(at, sum(self.head["bounds"]["sizes"])))
        at += sum(self.head["bounds"]["sizes"])
        self.docs = EliasFano.load(self.head["docs"], self._at(at, sum(self.head["docs"]["sizes"])))

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_id(self, i: int) -> int | None:
        return None if i < self.head["nulls"] else self.docs[i - self.head["nulls"]]

    def read(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        a, b = self.bounds[i], self.bounds[i + 1]
        w = self.dtype.itemsize
        return np.frombuffer(self._at(len(MAGIC) + a * w, (b - a) * w), self.dtype)

    def scan(self):
        """(doc_id, start, ids) of every document in order, by one select each, reading the ids as a stream."""
        w, a = self.dtype.itemsize, 0
        self.f.seek(len(MAGIC))
        for i in range(len(self)):
            b = self.bounds[i + 1]
            yield self.doc_id(i), a, np.frombuffer(self.f.read((b - a) * w), self.dtype)
            a = b
