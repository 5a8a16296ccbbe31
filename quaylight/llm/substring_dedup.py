"""Substring dedup with difference-cover anchors.

A difference cover of a period ``v`` holds two members at any distance modulo ``v``.  So of two equal runs of words, at
any positions, some offset below ``v`` brings both to cover positions: it is enough to hash short windows, the anchors,
at cover positions.  Around anchors that occur twice the windows of full length are hashed, and of equal ones all but
the earliest are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.llm.spread import by_lots, unused
from quaylight.llm.words import Words, inside_windows, mix, steps, window_hashes
from quaylight.sources.scratch import Scratch

#: Perfect difference sets by period: fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Words of an anchor at least.
LEAST_ANCHOR = 8

_U = np.uint64
_CHECK = _U(0xFFFFFFFF)


def cover_for(window: int, least: int = LEAST_ANCHOR) -> tuple[int, np.ndarray]:
    """(period, whether each residue is in the cover): the longest period that leaves anchors of ``least`` words."""
    period = max(v for v in COVERS if v == 1 or v - 1 + least <= window)
    inside = np.zeros(period, bool)
    inside[list(COVERS[period])] = True
    return period, inside


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether each is the first of its key in this order, its key's number of members); last key first."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(order)))
    return order, new, np.repeat(sizes, sizes)


def text_hashes(words: Words, values: np.ndarray) -> np.ndarray:
    """64 bits for each text's sequence of words."""
    ends = words.first
    found = [int.from_bytes(hashlib.blake2b(values[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return np.array(found, np.int64)


def whole_copies(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """``copy_id, whole``: hashes of those texts whose words are those of a document of smaller id.

    All windows of such a text start earlier elsewhere, so none has to be looked for.  Two hashes of a text, of its words
    by two mixes, tell texts apart; one of them finds a copy again among the texts of its id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                words = Words(part.column("text"))
                values = words.hashes()
                some = np.flatnonzero(words.counts() >= window)
                prints = [pa.array(text_hashes(words, v)[some]) for v in (values, mix(values ^ _CHECK))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), *prints], names=["doc_id", "f1", "f2"])

    prints = scratch.put("prints", docs.mapInArrow(run, "doc_id long, f1 long, f2 long"))
    several = prints.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last")
    copies = by_lots(prints, several, ["f1", "f2"], "doc_id").filter("doc_id > least")
    return scratch.put("copies", copies.groupBy(F.col("doc_id").alias("copy_id")).agg(F.collect_set("f1").alias("whole")))


def is_whole_copy(words: Words, values: np.ndarray, whole: pa.Array) -> np.ndarray:
    """True for each text whose hash is listed for its document."""
    out = np.zeros(words.n_docs, bool)
    listed = whole.to_pylist() if whole.null_count < len(whole) else []
    if listed:
        hashes = text_hashes(words, values).tolist()
        out[:] = [x is not None and h in x for h, x in zip(hashes, listed, strict=True)]
    return out


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """``key, doc_id, at``: each anchor's hash and twice its place, in words, odd where it is known to be repeated.

    Of an anchor that a step holds several times one row keeps its hash; the others get a key of their own, so that no
    frequent passage meets in one task as often as it occurs.  Anchors only propose places, so 48 bits are enough; rows
    stay in text order, in which they compress best.
    """
    period, cover = cover_for(window)
    size = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                words = Words(part.column("text"))
                keys = window_hashes(words.hashes(), size)
                n = len(keys)
                doc = words.doc[:n]
                at = np.arange(n) - words.first[doc]
                some = np.flatnonzero(inside_windows(words, size) & cover[at % period] & (words.counts()[doc] >= window))
                order, new, sizes = _runs(keys[some])
                key, known = keys[some], np.zeros(len(some), bool)
                again = order[~new]
                key[again] = mix(key[again] + mix(some[again].astype(_U) + _U(1)))
                known[order] = sizes > 1
                columns = [pa.array((key >> _U(16)).view(np.int64)), part.column("doc_id").take(pa.array(doc[some])), pa.array((2 * at[some] + known).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "at"])

    return docs.mapInArrow(run, "key long, doc_id long, at int")


def _listed(places: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, value) of each value in a list column."""
    offsets = places.offsets.to_numpy()
    values = places.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return np.repeat(np.arange(len(places)), np.diff(offsets)), values


def windows(docs: DataFrame, window: int) -> DataFrame:
    """``h1, h2, doc_id, at`` of each window around the anchors listed in ``places``: 96 bits of hash and twice its start.

    Texts that ``whole`` lists as copies are left out.

    Of equal windows in a step only the earliest keeps its ``h1``; the others are known to have an earlier one, which an
    odd ``at`` tells.  Rows stay in text order.
    """
    period, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                words = Words(part.column("text"))
                values = words.hashes()
                of, places = _listed(part.column("places"))
                ok = places < words.counts()[of]
                at, begin = words.first[of[ok]] + places[ok], words.first[of[ok]]
                near = np.zeros(len(words) + 1, bool)
                copy = is_whole_copy(words, values, part.column("whole"))
                at, begin = at[~copy[words.doc[at]]], begin[~copy[words.doc[at]]]
                for back in range(period):
                    near[(at - back)[at - back >= begin]] = True
                some = inside_windows(words, window)
                some = np.flatnonzero(some & near[: len(some)])
                h1, h2 = (window_hashes(values, window, k)[some] for k in (0, 1))
                h2 = (h2 & _CHECK).astype(np.uint32)
                doc = words.doc[some]
                ids = part.column("doc_id").to_numpy()[doc]
                start = some - words.first[doc]
                order = np.lexsort((start, ids, h2, h1))
                new = np.ones(len(order), bool)
                new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
                head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(new) else order
                known = np.zeros(len(order), bool)
                known[order] = (ids[order] != ids[head]) | (start[order] != start[head])
                h1 = np.where(known, mix(h1 + mix(start.astype(_U) + mix(ids.view(_U)))), h1)
                columns = [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array(ids), pa.array((2 * start + known).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc_id", "at"])

    return docs.mapInArrow(run, "h1 long, h2 int, doc_id long, at int")


def repeated_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """``repeat_id, marks, whole``: each document's windows that also start earlier, and its texts that are whole copies.

    A mark is a start in the high and ``h2`` in the low half.
    """
    rows = docs.filter("doc_id is not null and text is not null")
    copies = whole_copies(rows, window, scratch)
    same = F.count("*").over(Window.partitionBy("key"))
    twice = anchors(rows, window).withColumn("n", same).filter("at % 2 = 1 or n > 1")
    places = scratch.put("places", twice.groupBy(F.col("doc_id").alias("repeat_id")).agg(F.collect_list(F.expr("at div 2").cast("int")).alias("places")))
    places = places.join(copies, F.col("repeat_id") == F.col("copy_id"), "left")
    scratch.release()
    found = windows(rows.join(places, F.col("doc_id") == F.col("repeat_id")).select("doc_id", "text", "places", "whole"), window)
    start = F.shiftright("at", 1)
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", start))
    later = found.withColumn("place", place).filter("at % 2 = 1 or place > 1")
    mark = F.shiftleft(start.cast("long"), 32).bitwiseOR(F.col("h2").cast("long").bitwiseAND(0xFFFFFFFF))
    marks = scratch.put("windows", later.groupBy(F.col("doc_id").alias("repeat_id")).agg(F.collect_list(mark).alias("marks")))
    marks = marks.join(copies, F.col("repeat_id") == F.col("copy_id"), "full_outer").select(F.coalesce("repeat_id", "copy_id").alias("repeat_id"), "marks", "whole")
    marks = scratch.put("marks", marks)
    scratch.drop("prints", "places", "windows", "copies")
    scratch.release()
    return marks


def removed_words(words: Words, part: pa.RecordBatch, window: int, marks: str = "marks", whole: str = "whole") -> np.ndarray:
    """True for each word covered by a listed window; a mark of another text with the same id doesn't count."""
    of, values = _listed(part.column(marks))
    hashes = words.hashes()
    copy = is_whole_copy(words, hashes, part.column(whole))[words.doc]
    edge = np.zeros(len(words) + 1, np.int64)
    if not len(values) or len(words) < window:
        return copy
    start, check = values >> 32, values.view(_U) & _CHECK
    ok = start + window <= words.counts()[of]
    at, check = words.first[of[ok]] + start[ok], check[ok]
    at = np.unique(at[window_hashes(hashes, window, 1)[at] & _CHECK == check])
    edge[at] += 1
    edge[at + window] -= 1
    return copy | (np.cumsum(edge[:-1]) > 0)


def kept_words(words: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n + 1 offsets, bytes): each text's words that stay, with one blank between two."""
    keep = np.flatnonzero(~removed)
    starts, sizes, doc = words.start[keep], words.end[keep] - words.start[keep], words.doc[keep]
    joined = np.ones(len(keep), np.int64)
    joined[np.append(np.flatnonzero(doc[1:] != doc[:-1]), len(keep) - 1) if len(keep) else []] = 0
    ends = np.cumsum(sizes + joined)
    out = np.full(int(ends[-1]) if len(keep) else 0, 0x20, np.uint8)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(ends - joined - sizes, sizes) + within] = words.data[np.repeat(starts, sizes) + within]
    lengths = np.bincount(doc, weights=sizes + joined, minlength=words.n_docs).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), out


def _cut(words: Words, removed: np.ndarray) -> list[str]:
    """Each text without its removed words and the white space after them; other white space stays."""
    drop = np.zeros(len(words.data) + 1, np.int64)
    gone = np.flatnonzero(removed)
    to = np.append(words.start[1:], len(words.data))[gone]
    to = np.minimum(to, words.offsets[words.doc[gone] + 1])
    drop[words.start[gone]] += 1
    np.add.at(drop, to, -1)
    stay = np.cumsum(drop[:-1]) == 0
    sizes = np.concatenate([[0], np.cumsum(stay)])[words.offsets]
    body = words.data[stay].tobytes()
    return [body[a:b].decode() for a, b in zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)]


def _with_marks(docs: DataFrame, window: int, name: str, whole: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = unused("repeat_id", docs.columns)
    marks = repeated_windows(rows, window, Scratch(docs.sparkSession, "substrings")).withColumnsRenamed({"repeat_id": key, "marks": name, "whole": whole})
    return docs.join(marks, F.col("doc_id").cast("long") == F.col(key), "left").drop(key).withColumn(name, F.coalesce(name, F.array().cast("array<long>")))


def removal_digests(docs: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row.

    A word goes if a window of ``window`` words over it occurs, as the same words, at an earlier place: in a document of
    smaller ``doc_id``, or earlier in the same one.  Rows that share a ``doc_id`` share places: what starts at the same
    word of both isn't earlier.  A row without ``doc_id`` or text neither loses words nor takes any.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                words = Words(part.column("text"))
                removed = removed_words(words, part, window)
                at, body = kept_words(words, removed)
                digests = [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                gone = np.bincount(words.doc[removed], minlength=words.n_docs).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts()), pa.array(gone), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_marks(rows, window, "marks", "whole").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 20, length: str | None = None) -> DataFrame:
    """``docs`` with repeated windows cut from ``text``; ``length`` names a column of code points to keep in step.

    All other columns and all rows stay; a text that was repeated whole becomes empty.  See ``removal_digests``.
    """
    marks, whole = unused("repeat_marks", docs.columns), unused("repeat_whole", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                words = Words(part.column("text"))
                removed = removed_words(words, part, window, marks, whole)
                place = part.schema.get_field_index("text")
                if removed.any():
                    texts = pa.array(_cut(words, removed), part.schema.field(place).type)
                    touched = pa.array(np.bincount(words.doc[removed], minlength=words.n_docs) > 0)
                    part = part.set_column(place, "text", pc.if_else(touched, texts, part.column(place)))
                yield part.drop_columns([marks, whole])

    out = _with_marks(docs, window, marks, whole)
    schema = docs.schema
    cut = out.mapInArrow(run, schema)
    return cut.withColumn(length, F.coalesce(F.length("text").cast(schema[length].dataType), length)) if length in docs.columns else cut

