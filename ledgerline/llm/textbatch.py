"""Words and word-window hashes of Arrow text batches, vectorised over raw UTF-8 bytes.

A word is a run of bytes outside an ASCII separator set, so UTF-8 sequences never
split. A word's hash runs through its blocks of 8 bytes in two lanes, scrambled at every
block; words of more than 64 bytes take a BLAKE2 digest. A window's hash joins those of
its halves, scrambled at every join. No step is linear, so equal hashes of different
texts have to be searched for like those of any 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: temporaries stay near the cache and are bounded.
CHUNK_BYTES = 1 << 20
#: Documents handled at once.
CHUNK_DOCS = 4096

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACE)] = False

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
#: Low bytes of a block, by their number.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Blocks of 8 bytes that are hashed in lanes; longer spans are digested one by one.
BLOCKS = 8


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two things in this order, from theirs."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + ((b << np.uint64(25)) | (b >> np.uint64(39))))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def heads(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes, or all of fewer, of each span."""
    return _eights(data)[start] & _MASK[np.minimum(size, 8)]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of ``data``."""
    size = end - start
    eight = _eights(data)
    one = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    two = ~one
    at = np.flatnonzero(size <= 8 * BLOCKS)
    left = size[at]
    for k in range(BLOCKS):
        block = eight[start[at] + 8 * k] & _MASK[np.minimum(left, 8)]
        one[at] = mix(one[at] ^ block)
        if k:
            two[at] = mix(two[at] + block)
        else:
            two[at] += block
        more = left > 8
        if not more.any():
            break
        at, left = at[more], left[more] - 8
    out = join(one, two)
    for k in np.flatnonzero(size > 8 * BLOCKS).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


class Words:
    """The words of consecutive documents: byte spans, document numbers, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD, fold: bool = False):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        self._fold = fold
        size = len(data)
        inside = is_word[data]
        begin, stop = inside.copy(), inside.copy()
        if size:
            begin[1:] &= ~inside[:-1]
            stop[:-1] &= ~inside[1:]
            edge = offsets[:-1][offsets[:-1] < size]
            begin[edge] = inside[edge]
            edge = offsets[1:][offsets[1:] > 0] - 1
            stop[edge] = inside[edge]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self._hash: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, with A-Z as a-z if the words are folded."""
        return span_hash(_FOLDED[self.data] if self._fold else self.data, start, end)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.span_hash(self.start, self.end)
        return self._hash

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word's number and hash of each run of ``size`` words in one document."""
        n = len(self.start) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        part, width = self.hash, 1  # hashes of ``width`` words from each word on
        total, done = np.full(n, size, dtype=np.uint64), 0
        while True:
            if size & width:
                total = join(total, part[done : done + n])
                done += width
            if 2 * width > size:
                return at, total[at]
            part = join(part[:-width], part[width:])
            width *= 2

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(document numbers, hashes) of the distinct shingles, sorted by both.

        A document of fewer words has its whole sequence as its one shingle.
        """
        at, found = self.windows(size)
        doc = self.doc[at]
        short = np.flatnonzero((self.counts > 0) & (self.counts < size))
        if len(short):
            whole = self.counts[short].astype(np.uint64)
            for k in range(size - 1):
                has = self.counts[short] > k
                whole[has] = join(whole[has], self.hash[self.first[short[has]] + k])
            doc, found = np.concatenate((doc, short)), np.concatenate((found, whole))
            order = np.argsort(doc, kind="stable")
            doc, found = doc[order], found[order]
        ends = np.cumsum(np.bincount(doc, minlength=self.n_docs)).tolist()
        for low, high in zip([0, *ends], ends, strict=False):
            found[low:high].sort()
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
        return doc[new], found[new]

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES, max_docs: int = CHUNK_DOCS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; each has one row at least."""
    data, offsets = text_buffers(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + max_bytes, "right")) - 1
        high = min(max(high, low + 1), low + max_docs, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def ragged(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column of consecutive runs of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)
