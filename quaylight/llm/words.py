"""Words, shingles and windows of Arrow text columns as numpy arrays.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  The separators are ASCII, so UTF-8 bytes are enough to find words.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step holds; a longer text makes a step of its own.
STEP_BYTES = 2 << 20
#: A word longer than this gets a cryptographic hash: polynomial hashes modulo 2**64 have known collisions there.
LONG_WORD = 64
#: Powers that a Python worker keeps; what a longer text needs is made for it alone.
KEPT_POWERS = STEP_BYTES + (1 << 16)

_U = np.uint64
_LIBC = ctypes.CDLL(None)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: spreads each bit over all 64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64; those that a usual step needs are kept."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            up, down = (np.concatenate([[_U(1)], np.cumprod(np.full(size, x, dtype=_U), dtype=_U)]) for x in (self.base, self.inverse))
        if size <= KEPT_POWERS:
            self.up, self.down = up, down
        return up[:n], down[:n]


_BYTES = _Powers(0x9E3779B97F4A7C15 | 1)
_WORDS = (_Powers(0xD1342543DE82EF95 | 1), _Powers(0xC2B2AE3D27D4EB4F | 1))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n + 1 offsets from 0, bytes) of a string array; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if where is None or len(texts) == 0:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(where, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    body = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return offsets - offsets[0], body


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its tasks and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have ``limit`` bytes at most, or that hold one row; then memory is given back."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


class Words:
    """The words of some texts.

    ``start``, ``end``: byte positions in ``data``.  ``doc``: index of each word's text.  ``first``: n + 1 positions,
    the words of text ``i`` are ``first[i]:first[i + 1]``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.offsets, data = buffers(texts)
        self.data = _LOWER[data] if lower else data
        self.n_docs = len(self.offsets) - 1
        n = len(data)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~_SEPARATOR[data]
        step = np.diff(inside)
        start, end = step[:-1] == 1, step[1:] == -1
        # a text's last word ends with it even where the next text begins with a word
        joint = self.offsets[1:-1]
        joint = joint[(joint > 0) & (joint < n)]
        both = joint[(inside[joint] == 1) & (inside[joint + 1] == 1)]
        start[both] = True
        end[both - 1] = True
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=self.n_docs))]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        if not len(self.start):
            return np.zeros(0, _U)
        up, down = _BYTES.upto(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([[_U(0)], np.cumsum(_BYTE_VALUE[self.data] * up[:-1], dtype=_U)])
            out = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(_U))
        for i in np.flatnonzero(self.end - self.start > LONG_WORD):
            word = self.data[self.start[i] : self.end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def code_points(self) -> np.ndarray:
        """Code points of each word."""
        heads = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return heads[self.end] - heads[self.start]


def window_hashes(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """64 bits for each run of ``size`` consecutive values; runs across texts are included and are the caller's to skip."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = _WORDS[which].upto(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[_U(0)], np.cumsum(values * up[:-1], dtype=_U)])
        return mix((total[size:] - total[:-size]) * down[:n] + _U(size))


def inside_windows(words: Words, size: int) -> np.ndarray:
    """True for each start of ``size`` consecutive words of one text, as long as ``window_hashes``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    return words.doc[:n] == words.doc[size - 1 :]


def distinct_shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct ``size``-word shingles, sorted; fewer words are one shingle, none are none."""
    values = words.hashes()
    good = inside_windows(words, size)
    hashes = window_hashes(values, size)[good]
    docs = words.doc[: len(good)][good]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        # the whole sequence, with its length: never equal to a full shingle
        more = np.empty(len(short), _U)
        for n in range(1, size):
            of = np.flatnonzero(counts[short] == n)
            if len(of):
                more[of] = window_hashes(values, n)[words.first[short[of]]]
        hashes, docs = np.concatenate([hashes, more]), np.concatenate([docs, short])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])])
        hashes, docs = hashes[new], docs[new]
    return docs, hashes
