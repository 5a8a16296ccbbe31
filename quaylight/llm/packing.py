"""Packing along a space-filling curve.

A document's hashed token vector is projected to a few dimensions; its place on the Hilbert curve through them orders the
documents.  The ordered documents form one stream of tokens that is cut every ``sequence_tokens``: neighbours on the curve
share sequences, and only the end of the stream leaves room.  That end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.byte_bpe import SPACE
from quaylight.llm.words import give_back, mix, steps
from quaylight.sources.scratch import Scratch

#: Dimensions of the projection, and bits of each one's coordinate on the curve.
DIMENSIONS, BITS = 4, 15
#: Stretches the middle of the range of mean projections, where nearly all documents lie.
STRETCH = 6.0
#: Pieces that a Python worker remembers.
REMEMBERED = 400_000
#: Bytes of text in a step: the more, the fewer fragments are distinct.
STEP = 4 << 20


class FragmentTokenizer:
    """Ids of texts by a ``tokenizers`` file, encoding no more than it must.

    The file's pre-tokenizer must keep runs of letters, single digits and runs of other signs apart, never join text
    across white space, and end each such piece with a token that ends in its word-end mark.  Texts are cut at blanks and
    line feeds, each distinct fragment of a step is looked up once, and fragments of Latin-1 characters, which no
    normalisation joins, are cut into the pre-tokenizer's pieces.  What is new goes to the library; pieces are remembered.
    The file's added tokens, where a text spells them, are tokens of their own, as the library has it by default.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("an added token that isn't matched as it is spelt")
        self.added = {t.content for t in added}
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        mark = self.tokenizer.model.end_of_word_suffix or "</w>"
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+|\n").findall
        self.known: dict[str, bytes] = {"\n": b""}

    def forget(self) -> None:
        """Drops the remembered pieces, so that a worker doesn't hold them between tasks."""
        self.known = {"\n": b""}

    def _learn(self, pieces: list[str]) -> None:
        """Pieces of the pre-tokenizer: the library's ids of all in one text, cut after each word end."""
        for at in range(0, len(pieces), 8192):
            part = pieces[at : at + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(part):
                raise ValueError("a piece isn't one word of this tokenizer")
            self.known.update((f, ids[a:b].tobytes()) for f, a, b in zip(part, [0, *stops[:-1]], stops, strict=True))

    def _latin(self, fragments: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each fragment has) of fragments of Latin-1 characters, each with a line feed after it."""
        found = pa.array(self.pieces(fragments.lower()), pa.string()).dictionary_encode()
        pieces = found.dictionary.to_pylist()
        self._learn([p for p in pieces if p not in self.known])
        out, sizes = _gather([self.known[p] for p in pieces], found.indices.to_numpy(), self.kind)
        stops = np.flatnonzero(found.indices.to_numpy() == pieces.index("\n")) if pieces else np.zeros(0, np.int64)
        return out, np.diff(np.cumsum(sizes)[stops], prepend=0)

    def _others(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for at in range(0, len(fragments), 4096):
            part = fragments[at : at + 4096]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, self.kind))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _fragments(self, fragments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(fragments)], fragments), "\n")[0].as_py() + "\n"
        if not len(fragments) or (max(joined) < "\u0100" and not any(t in joined for t in self.added)):
            return self._latin(joined if len(fragments) else "")
        split = fragments.to_pylist()
        latin = np.array([not f or (max(f) < "\u0100" and f not in self.added) for f in split])
        ids, sizes = self._latin("".join(f"{f}\n" for f, x in zip(split, latin, strict=True) if x))
        more_ids, more_sizes = self._others([f for f, x in zip(split, latin, strict=True) if not x])
        ids, sizes = np.concatenate([ids, more_ids]), np.concatenate([sizes, more_sizes])
        order = np.argsort(np.concatenate([np.flatnonzero(latin), np.flatnonzero(~latin)]))
        return _take(ids, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); a null text has none."""
        apart = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        for token in self.added:
            apart = pc.replace_substring(apart, token, f" {token} ")
        split = pc.split_pattern(apart, " ")
        found = split.flatten().dictionary_encode()
        flat, sizes = self._fragments(found.dictionary)
        which = found.indices.to_numpy()
        starts, sizes = (np.cumsum(sizes) - sizes)[which], sizes[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return _take(flat, starts, sizes), np.diff(total[split.offsets.to_numpy() - split.offsets[0].as_py()])


def _take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _gather(parts: list[bytes], which: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(parts), kind)
    sizes = np.array([len(x) for x in parts], np.int64) // flat.itemsize
    starts, sizes = (np.cumsum(sizes) - sizes)[which], sizes[which]
    return _take(flat, starts, sizes), sizes


@lru_cache(2)
def _tokenizer(path: str) -> FragmentTokenizer:
    return FragmentTokenizer(path)


@lru_cache(2)
def projection(vocabulary: int) -> np.ndarray:
    """(vocabulary, DIMENSIONS) of -1 and 1, by a hash of each token: the same everywhere."""
    bits = mix(np.arange(1, vocabulary + 1, dtype=np.uint64))
    return np.stack([1 - 2 * ((bits >> np.uint64(7 * d)) & np.uint64(1)).astype(np.float32) for d in range(DIMENSIONS)], 1)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of (n, d) coordinates below ``2 ** bits``; d * bits is 63 at most.

    Bit planes are undone from the highest to the lowest: an axis whose bit is set inverts the lower bits of the first
    axis, else it trades them with it; a Gray code over the axes and planes follows.
    """
    x = points.T.astype(np.int64).copy()
    d = len(x)
    for plane in range(bits - 1, 0, -1):
        bit, low = np.int64(1) << plane, (np.int64(1) << plane) - 1
        for axis in range(d):
            is_set = (x[axis] & bit) != 0
            trade = np.where(is_set, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(is_set, low, trade)
            x[axis] ^= trade
    for axis in range(1, d):
        x[axis] ^= x[axis - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        flips ^= np.where((x[d - 1] >> plane) & 1, (np.int64(1) << plane) - 1, 0)
    x ^= flips
    key = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, -1, -1):
        for axis in range(d):
            key = (key << 1) | ((x[axis] >> plane) & 1)
    return key


def curve_keys(ids: np.ndarray, starts: np.ndarray, vocabulary: int) -> np.ndarray:
    """Hilbert key of each document's mean projected token; no document is empty."""
    sizes = np.diff(np.append(starts, len(ids)))
    mean = np.add.reduceat(projection(vocabulary)[ids], starts, axis=0) / sizes[:, None]
    level = (np.tanh(STRETCH * mean) + 1) / 2 * ((1 << BITS) - 1)
    return hilbert_keys(np.rint(level).astype(np.int64), BITS)


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """``uid, doc_id, key, n_tokens, ids``: a number of the row, its place on the curve, and its ids with the end's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_file)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in steps(batch, limit=STEP):
                ids, sizes = tokenizer.encode(part.column("text"))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                ends = np.cumsum(sizes + 1)
                keys = curve_keys(ids, ends - sizes - 1, tokenizer.vocabulary)
                bodies = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]) * ids.itemsize), pa.py_buffer(ids)])
                columns = [pa.array(np.arange(uid, uid + len(ends))), part.column("doc_id"), pa.array(keys), pa.array(sizes + 1), bodies.cast(pa.binary())]
                uid += len(ends)
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "key", "n_tokens", "ids"])
        tokenizer.forget()
        give_back()

    return docs.mapInArrow(run, "uid long, doc_id long, key long, n_tokens long, ids binary")


def stream_starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``uid, at``: where each row begins in the stream of all rows by (key, doc_id, uid).

    Rows are range-sorted without their ids; each partition sums its own, and the partitions' totals, one number for
    each, are summed on the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            ends = total + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(sizes), part)), pa.array(ends - sizes), batch.column(1)], names=["uid", "part", "before", "n_tokens"])
            total = int(ends[-1]) if len(ends) else total

    ordered = rows.select("key", "doc_id", "uid", "n_tokens").repartitionByRange("key", "doc_id", "uid").sortWithinPartitions("key", "doc_id", "uid")
    placed = scratch.put("placed", ordered.select("uid", "n_tokens").mapInArrow(run, "uid long, part long, before long, n_tokens long"))
    totals = sorted((r["part"], r["total"]) for r in placed.groupBy("part").agg(F.sum("n_tokens").alias("total")).collect())
    begins, total = [], 0
    for part, more in totals:
        begins.append((part, total))
        total += more
    spark = rows.sparkSession
    parts = spark.createDataFrame(begins, "part long, begins long")
    return placed.join(F.broadcast(parts), "part").select("uid", (F.col("before") + F.col("begins")).alias("at"), F.lit(total).alias("total"))


def cuts(at: int, size: int, total: int, sequence_tokens: int) -> Iterator[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset there) of each piece of a document at ``at`` of the stream."""
    full = total // sequence_tokens
    tail = []
    place, bit = full * sequence_tokens, sequence_tokens
    while bit:
        if (total - full * sequence_tokens) & bit:
            tail.append((place, bit))
            place += bit
        bit >>= 1
    done = 0
    while done < size:
        here = at + done
        if here < full * sequence_tokens:
            number, begin, room = here // sequence_tokens, here // sequence_tokens * sequence_tokens, sequence_tokens
        else:
            k = next(k for k, (p, n) in enumerate(tail) if p <= here < p + n)
            number, (begin, room) = full + k, tail[k]
        length = min(size - done, begin + room - here)
        yield done, length, number, here - begin
        done += length


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, sequence_tokens: int = 2048) -> DataFrame:
    """One row for each piece of a document: where it lies in its document and in its sequence, its ids and their CRC.

    ``docs`` has ``doc_id`` and ``text``; other columns are left out.  A null or empty text is its end id alone.  Repeated
    rows are packed each on its own.  A text of any length is cut at the sequences' ends.  An empty table has no pieces.
    """
    if sequence_tokens < 1 or sequence_tokens & (sequence_tokens - 1):
        raise ValueError("sequence_tokens must be a power of two")
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = scratch.put("tokens", tokenize(rows, tokenizer_file, end_id))
    starts = stream_starts(tokens, scratch)
    placed = tokens.select("uid", "doc_id", "n_tokens", "ids").join(starts, "uid").select("doc_id", "n_tokens", "ids", "at", "total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [*[pa.int64()] * 7, pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            docs_, sizes, bodies, ats, totals = (batch.column(k) for k in range(5))
            for doc_id, size, body, at, total in zip(docs_.to_pylist(), sizes.to_pylist(), bodies, ats.to_pylist(), totals.to_pylist(), strict=True):
                raw = body.as_buffer()
                ids = np.frombuffer(raw, "<u2" if raw.size == 2 * size else "<u4").astype("<u4")
                for start, length, number, offset in cuts(at, size, total, sequence_tokens):
                    piece = ids[start : start + length].tobytes()
                    out.append((doc_id, start, length, zlib.crc32(piece), size, number, offset, piece))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=names)

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, doc_ids, ids``: the pieces of each sequence joined; a sequence's size is bounded."""
    one = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return one.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"), F.col("p.doc_id").alias("doc_ids"), joined.alias("ids"))
