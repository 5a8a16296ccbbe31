"""Byte-level BPE encoding and decoding with padded numpy matrices.

Distinct pieces of a step are bucketed by length and put in one matrix per bucket.  In each round every row merges its
leftmost pair of least rank; rows without a pair leave the matrix.  Pairs are found in an open-addressing hash table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.words import steps

#: Pieces over so many bytes are merged with a heap: rounds over a matrix would take quadratic time.
LONG_PIECE = 512
#: Cells of a matrix at most; a bucket with more rows is encoded in parts.
MATRIX_CELLS = 1 << 20
#: Pieces that a Python worker remembers; long ones are not kept.
REMEMBERED = 400_000
#: White space of the Unicode property, which ``\s`` means in the ranks' pattern.
SPACE = r"\t-\r \x85\xa0  -     　"

_NONE = np.iinfo(np.int32).max


def with_plain_space(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelt out, so that all regex engines agree on them."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two in (r"\s", r"\S"):
            out.append(SPACE if inside else f"[{'^' if two == r'\S' else ''}{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = {"[": True, "]": False}.get(two[0], inside)
            out.append(two[0])
            at -= 1
        at += 2
    return "".join(out)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(with_plain_space(pattern)).findall
        self.of_byte = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        self.n = max(ranks.values()) + 1
        tokens = [b""] * self.n
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self._build_pairs()
        self.known: dict[str, bytes] = {}

    def _build_pairs(self) -> None:
        """Each token's cuts into two tokens: a pair merges wherever the joined bytes are a token."""
        ranks = self.ranks
        found = [(a, b, rank) for token, rank in ranks.items() for cut in range(1, len(token)) if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None]
        pairs = np.array(found, np.uint64).reshape(-1, 3)
        keys = (pairs[:, 0] << np.uint64(32)) | pairs[:, 1]
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full((1 << self.bits) + 1, ~np.uint64(0))
        self.values = np.full((1 << self.bits) + 1, _NONE, np.int32)
        slots, left, mask = self._slot(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(left):
            free = self.keys[slots[left]] == ~np.uint64(0)
            _, first = np.unique(slots[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slots[placed]], self.values[slots[placed]] = keys[placed], pairs[placed, 2].astype(np.int32)
            left = np.setdiff1d(left, placed, assume_unique=True)
            slots[left] = (slots[left] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair; the largest integer where there is none or a side is padding (-1)."""
        shape = a.shape
        a, b = a.ravel(), b.ravel()
        out = np.full(a.shape, _NONE, np.int32)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a[left].astype(np.uint64) << np.uint64(32)) | b[left].astype(np.uint64)
        slots, mask = self._slot(keys), (1 << self.bits) - 1
        while len(left):
            there = self.keys[slots]
            hit = there == keys
            out[left[hit]] = self.values[slots[hit]]
            on = ~hit & (there != ~np.uint64(0))
            left, keys, slots = left[on], keys[on], (slots[on] + 1) & mask
        return out.reshape(shape)

    def _merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Rows of ids, padded at the end with -1, after all merges."""
        done: list[np.ndarray | None] = [None] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), _NONE, np.int32)
            over = least == _NONE
            if over.any():
                for r, x in zip(rows[over].tolist(), ids[over], strict=True):
                    done[r] = x[x >= 0]
                on = ~over
                rows, ids, ranks, best, least = rows[on], ids[on], ranks[on], best[on], least[on]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            width = ids.shape[1] - 1
            ids[at, best] = least
            # the columns after the merged pair move one to the left
            take = np.arange(width) + (np.arange(width) > best[:, None])
            ids = np.take_along_axis(ids, take, 1)
            if width == 1:
                ranks = np.empty((len(rows), 0), np.int32)
                continue
            take = np.arange(width - 1) + (np.arange(width - 1) >= best[:, None])
            ranks = np.take_along_axis(ranks, np.minimum(take, width - 1), 1)
            for first in (best - 1, best):
                ok = np.flatnonzero((first >= 0) & (first + 1 < width))
                ranks[ok, first[ok]] = self.pair_ranks(ids[ok, first[ok]], ids[ok, first[ok] + 1])
        return done  # type: ignore[return-value]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order by a heap of (rank, position) over a linked list."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        rank = lambda i: self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[after[i]]]) if after[i] < n else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue
            gone = after[i]
            ids[i], alive[gone], after[i] = r, False, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (q := rank(k)) is not None:
                    heapq.heappush(heap, (q, k, ids[k], ids[after[k]]))
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        todo = []
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > LONG_PIECE:
                out[i] = self._merge_long(p).astype("<u4").tobytes()
            elif p:
                todo.append(i)
        todo_ = np.array(todo, np.int64)
        widths = np.where(sizes[todo_] <= 16, -(-sizes[todo_] // 2) * 2, 1 << np.ceil(np.log2(np.maximum(sizes[todo_], 2))).astype(np.int64))
        for width in np.unique(widths).tolist():
            members = todo_[widths == width]
            for k in range(0, len(members), max(1, MATRIX_CELLS // width)):
                part = members[k : k + max(1, MATRIX_CELLS // width)].tolist()
                padded = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8).reshape(-1, width)
                ids = np.where(np.arange(width) < sizes[part][:, None], self.of_byte[padded], -1).astype(np.int32)
                for i, x in zip(part, self._merge_matrix(ids), strict=True):
                    out[i] = x.astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        found = [self.find(t) for t in texts]
        known = self.known
        fresh = {p for pieces in found for p in pieces if p not in known}
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = {p for pieces in found for p in pieces}
        new = list(fresh)
        known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in found]
        for p in new:
            if len(p) > LONG_PIECE:
                del known[p]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)]


@lru_cache(2)
def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file, once in each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def encode_column(df: DataFrame, ranks: str, pattern: str, column: str = "text", to: str = "ids") -> DataFrame:
    """Adds ``to``: the ids of each text as little-endian unsigned 32-bit integers in a binary column.

    ``ranks`` is a rank file that every executor can open.  A null text has no ids (an empty value), as has an empty one.
    A column already named ``to`` is replaced.
    """
    kept = df.drop(to) if to != column else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{to}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        for batch in batches:
            for part in steps(batch, column):
                ids = bpe.encode([t or "" for t in part.column(column).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, to])

    return kept.mapInArrow(run, schema)


def decode_column(df: DataFrame, ranks: str, pattern: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds ``to``: the bytes of each row's ids.  Null ids give null; a column already named ``to`` is replaced."""
    kept = df.drop(to) if to != column else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", `{to}` binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.frombuffer(x, "<u4")).tobytes() for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, to])

    return kept.mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each text; a null text is empty, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks, pattern)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            for part in steps(batch):
                ids = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                decoded = [hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids]
                columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
