"""Source divergence audit: which terms set a source apart from its language, and which sources differ most.

Sort-based streaming.  A map task sorts the words of its texts by (lang, term, source, document) and reads off document
frequencies and counts run by run, so that what is shuffled has one row for a term and source of a task.  Those rows are
dealt by (lang, term), each task sorts its own by source, and a second scan adds them up; a run is one term of a language.
Its counts against the sizes of all the language's sources give partial sums for pairs of sources and the term's own
values, run by run again.  A pair's sum starts from what it would be if no source had any term, which is one product;
a run adds the difference that the sources with the term make.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaylight.llm.words import buffers, give_back, steps
from quaylight.sources.scratch import Scratch

#: A share of all terms is given in parts of this.
UNIT = 1_000_000_000
#: Documents of a language that a kept term is in, at least, and the terms that a source's list holds.
LEAST_DOCS, TOP_TERMS = 3, 200
#: Bytes of text that are sorted at once, and rows that a map task adds up before it passes them on.
STEP, HELD_ROWS = 4 << 20, 400_000
#: Sums of pairs that a task holds, and values that it computes at once.
HELD_PAIRS, CELLS = 1_000_000, 1 << 20

_PART = np.ones(256, bool)
_PART[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])


def _terms(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(index of the text, term) of each term of some texts."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _PART[data]
    step = np.diff(inside)
    start, end = step[:-1] == 1, step[1:] == -1
    # a term ends with its text
    joint = offsets[1:-1]
    joint = joint[(joint > 0) & (joint < len(data))]
    both = joint[(inside[joint] == 1) & (inside[joint + 1] == 1)]
    start[both], end[both - 1] = True, True
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    ends = np.concatenate([[0], np.cumsum(last - first)])
    letters = _LOWER[data[inside[1:-1] == 1]]
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters.tobytes()))
    return np.searchsorted(offsets, first, "right") - 1, words


def _scanned(part: pa.RecordBatch) -> pa.Table:
    """``lang, source, term, docs, n`` of some texts: their words sorted, then read off run by run."""
    offsets, data = buffers(part.column("text"))
    doc, words = _terms(offsets, data)
    words = words.dictionary_encode()
    kinds = pa.StructArray.from_arrays([part.column("lang").cast(pa.string()), part.column("source").cast(pa.string())], names=["lang", "source"])
    keys = pa.table({"lang": kinds.field(0), "source": kinds.field(1)}).group_by(["lang", "source"], use_threads=False).aggregate([])
    known = {x: i for i, x in enumerate(zip(keys["lang"].to_pylist(), keys["source"].to_pylist(), strict=True))}
    group = np.array([known[x] for x in zip(kinds.field(0).to_pylist(), kinds.field(1).to_pylist(), strict=True)], np.int64)
    n_terms, n_docs = max(1, len(words.dictionary)), max(1, part.num_rows)
    order = np.sort((group[doc] * n_terms + words.indices.to_numpy()) * n_docs + doc)
    new_doc = np.concatenate([[True], order[1:] != order[:-1]]) if len(order) else np.zeros(0, bool)
    run = order // n_docs
    at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    docs = np.add.reduceat(new_doc.astype(np.int64), at) if len(at) else at
    n = np.diff(np.append(at, len(run)))
    which = run[at]
    return pa.table([keys["lang"].take(pa.array(which // n_terms)), keys["source"].take(pa.array(which // n_terms)), words.dictionary.take(pa.array(which % n_terms)).cast(pa.string()), pa.array(docs), pa.array(n)], schema=_COUNTS)


def _long_text(part: pa.RecordBatch) -> pa.Table:
    """``_scanned`` for one long text, in pieces that end where a term does; the text stays one document."""
    _, data = buffers(part.column("text"))
    at, total = 0, _COUNTS.empty_table()
    while at < len(data):
        to = min(len(data), at + STEP)
        if to < len(data):
            gaps = np.flatnonzero(~_PART[data[to : to + STEP]])
            while not len(gaps) and to + STEP < len(data):
                to += STEP
                gaps = np.flatnonzero(~_PART[data[to : to + STEP]])
            to = to + int(gaps[0]) if len(gaps) else len(data)
        text = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, to - at], np.int64)), pa.py_buffer(data[at:to].tobytes()))
        piece = _scanned(pa.RecordBatch.from_arrays([part.column("lang"), part.column("source"), text], names=["lang", "source", "text"]))
        total, at = _added([total, piece]), to
    return total.set_column(3, "docs", pa.array(np.ones(len(total), np.int64)))


def _added(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
    return pa.table([sums["lang"], sums["source"], sums["term"], sums["docs_sum"], sums["n_sum"]], schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for part in steps(batch, limit=STEP):
            long = part.num_rows == 1 and len(buffers(part.column("text"))[1]) > STEP
            held.append(_long_text(part) if long else _scanned(part))
            rows += len(held[-1])
            if rows > 2 * HELD_ROWS:
                held = [_added(held)]
                rows = len(held[0])
                if rows > HELD_ROWS:
                    yield from held[0].combine_chunks().to_batches()
                    held, rows = [], 0
                give_back()
    if held:
        yield from _added(held).combine_chunks().to_batches()


def _starts(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """True where a row's columns differ from those of the row before; the first row's are new."""
    out = np.ones(len(rows), bool)
    out[1:] = False
    for c in columns:
        values = rows[c].combine_chunks()
        out[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return out


def _scanned_runs(rows: pa.Table, least_docs: int) -> pa.RecordBatch:
    """Whole runs of sorted rows: a row for each in ``least_docs`` documents or more."""
    new_run = _starts(rows, ["lang", "term"])
    new_source = new_run | _starts(rows, ["source"])
    run, source = np.flatnonzero(new_run), np.flatnonzero(new_source)
    kept = np.add.reduceat(rows["docs"].to_numpy(), run) >= least_docs
    counts = np.add.reduceat(rows["n"].to_numpy(), source)
    mine = kept[np.cumsum(new_run)[source] - 1]
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(new_source.astype(np.int64), run)[kept])]).astype(np.int32)
    first, each = pa.array(run[kept]), pa.array(source[mine])
    lists = [pa.ListArray.from_arrays(ends, x) for x in (rows["source"].combine_chunks().take(each), pa.array(counts[mine]))]
    return pa.RecordBatch.from_arrays([rows["lang"].combine_chunks().take(first), rows["term"].combine_chunks().take(first), *lists], names=["lang", "term", "sources", "counts"])


def _sum_runs(least_docs: int):
    """Rows sorted by ``lang, term, source`` to one row a run of (lang, term) in ``least_docs`` documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _COUNTS.empty_table()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(_COUNTS)])
            # the last run may go on in the next batch; a row for each of its sources is enough of it
            last = int(np.flatnonzero(_starts(rows, ["lang", "term"]))[-1])
            held = _added([rows.slice(last)]).sort_by("source")
            if last:
                yield _scanned_runs(rows.slice(0, last), least_docs)
        if len(held):
            yield _scanned_runs(held, least_docs)

    return run


def _share(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / size)``, exactly."""
    if len(count) and int(count.max()) >= (1 << 63) // UNIT - 1:
        return np.array([1 + UNIT * (int(c) + 1) // int(s) for c, s in zip(count, np.broadcast_to(size, count.shape), strict=True)], np.int64)
    return 1 + UNIT * (count + 1) // size


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q) ** 2 / q)``; shares are at most ``UNIT + 1``, so the square is below ``2 ** 63``."""
    d = p - q
    return d * d // q


class _Language:
    """Sums of one language for some of its sources, ``first`` to ``last``, against all of them."""

    def __init__(self, lang: str, sources: list[str], sizes: np.ndarray, terms: int, first: int, last: int):
        self.lang, self.sources, self.first, self.last = lang, pa.array(sources, pa.string()), first, last
        self.size = sizes + terms
        self.whole = int(sizes.sum()) + terms
        self.none = _share(np.zeros(len(sizes), np.int64), self.size)
        self.base = _gap(self.none[first:last, None], self.none[None, :])
        self.sums = np.zeros((last - first, len(sizes)), np.int64)
        self.top: list[pa.Table] = []

    def add(self, terms: pa.Array, run: np.ndarray, source: np.ndarray, count: np.ndarray) -> None:
        """Runs of terms; ``run, source, count``: which sources have them how often, in the order of ``run``."""
        total = np.bincount(run, count, len(terms)).astype(np.int64) if int(count.sum()) < 1 << 53 else np.array([sum(int(c) for c in count[run == r]) for r in range(len(terms))], np.int64)
        share = _share(count, self.size[source])
        mine = (source >= self.first) & (source < self.last)
        over = _share(total, np.array([self.whole]))[run]
        good = mine & (share > over)
        self.top.append(pa.table({"source": pa.array(source[good]), "item": terms.take(pa.array(run[good])), "value": pa.array(_gap(share, over)[good])}))
        if sum(map(len, self.top)) > 2 * TOP_TERMS * (self.last - self.first) + 100_000:
            self.trim()
        width = len(self.none)
        per = max(1, CELLS // width)
        for lo in range(0, len(terms), per):
            at = slice(*np.searchsorted(run, [lo, lo + per]))
            r, s, p, m = run[at] - lo, source[at], share[at], mine[at]
            shares = np.broadcast_to(self.none, (min(per, len(terms) - lo), width)).copy()
            shares[r, s] = p
            # sources of this block that have the term, against all
            a = s[m] - self.first
            for some in np.array_split(np.arange(len(a)), max(1, -(-len(a) // per))):
                np.add.at(self.sums, a[some], _gap(p[m][some, None], shares[r[m][some]]) - self.base[a[some]])
            # those that lack it, against sources that have it
            block = slice(self.first, self.last)
            present = np.zeros(shares.shape, bool)
            present[r, s] = True
            for some in np.array_split(np.arange(len(s)), max(1, -(-len(s) // per))):
                change = _gap(self.none[None, block], p[some, None]) - self.base[:, s[some]].T
                change[present[r[some], block]] = 0
                np.add.at(self.sums.T, s[some], change)

    def trim(self) -> None:
        """The first ``TOP_TERMS`` of each source stay."""
        rows = pa.concat_tables(self.top)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("source", "ascending"), ("value", "descending"), ("item", "ascending")]))
        source = rows["source"].to_numpy()
        place = np.arange(len(source)) - np.searchsorted(source, source)
        self.top = [rows.filter(pa.array(place < TOP_TERMS))]

    def rows(self) -> Iterator[pa.RecordBatch]:
        a, b = np.nonzero(self.sums)
        names = ["lang", "source", "part", "item", "value"]
        yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(a), pa.string()), self.sources.take(pa.array(a + self.first)), pa.array(["pair"] * len(a), pa.string()), self.sources.take(pa.array(b)), pa.array(self.sums[a, b])], names=names)
        if self.top:
            self.trim()
            top = self.top[0].combine_chunks()
            for part in top.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(part), pa.string()), self.sources.take(part.column("source")), pa.array(["term"] * len(part), pa.string()), part.column("item"), part.column("value")], names=names)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of pairs and the first terms of sources, from runs sorted by language and block of sources."""
    now: _Language | None = None
    key = None
    for batch in batches:
        langs, blocks = batch.column("lang").to_pylist(), batch.column("block").to_numpy()
        new = [i for i in range(len(langs)) if i == 0 or langs[i] != langs[i - 1] or blocks[i] != blocks[i - 1]]
        for at, to in zip(new, [*new[1:], len(langs)], strict=True):
            part = batch.slice(at, to - at)
            if key != (langs[at], blocks[at]):
                if now:
                    yield from now.rows()
                key = langs[at], blocks[at]
                first = part.slice(0, 1)
                groups, width = first.column("groups")[0].as_py(), first.column("width")[0].as_py()
                low = int(blocks[at]) * width
                now = _Language(langs[at], [g["source"] for g in groups], np.array([g["n"] for g in groups], np.int64), first.column("kept")[0].as_py(), low, min(low + width, len(groups)))
                numbers = {g["source"]: i for i, g in enumerate(groups)}
            lists = part.column("sources")
            source = np.array([numbers[x] for x in lists.flatten().to_pylist()], np.int64)
            run = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy())
            now.add(part.column("term"), run, source, part.column("counts").flatten().to_numpy())
        give_back()
    if now:
        yield from now.rows()


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` over the (lang, source) groups of ``docs``.

    Terms are runs of letters, non-ASCII signs among them, lower-cased in A-Z; a language keeps those in ``least_docs``
    of its rows.  A group's share of a term is ``p = 1 + floor(UNIT * (count + 1) / (N + V))`` with ``N`` occurrences of
    the ``V`` kept terms.  Rows of part ``pair`` rank a source's companions in the language by the summed
    ``floor((p - q) ** 2 / q)`` with the companion's share ``q``; rows of part ``term`` rank the terms that a source uses
    more than its language does, up to ``top_terms``.  Ties go by the item's bytes.

    A null text, language or source is ``''``; a text without terms still makes its group occur.  Each row is one document,
    repeated rows and ids too.  An empty table gives no rows; a language with one source has no pairs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = text.mapInArrow(_count, "lang string, source string, term string, docs long, n long")
    ordered = counted.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    runs = scratch.put("runs", ordered.mapInArrow(_sum_runs(least_docs), "lang string, term string, sources array<string>, counts array<long>"))
    sizes = runs.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = text.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["n"])
    kept = runs.groupBy("lang").agg(F.count("*").alias("kept"))
    # the sources of a language: it has a row of the result for each pair of them
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups")).join(kept, "lang", "left").fillna(0, ["kept"])
    width = F.least(F.size("groups"), F.greatest(F.lit(1), F.floor(HELD_PAIRS / F.size("groups")))).cast("int")
    langs = scratch.put("langs", langs.withColumn("width", width))
    dealt = runs.join(langs, "lang").withColumn("block", F.explode(F.expr("sequence(0, cast(ceil(size(groups) / width) as int) - 1)")))
    partial = dealt.sortWithinPartitions("lang", "block").select("lang", "block", "width", "groups", "kept", "term", "sources", "counts")
    partial = scratch.put("partial", partial.mapInArrow(_partials, "lang string, source string, part string, item string, value long"))
    # what each pair would be without any term: V times the value of two empty sources
    empty = langs.filter("size(groups) > 1").select("lang", "kept", F.explode("groups").alias("a"), "groups").select("lang", "kept", "a", F.explode("groups").alias("b")).filter("a.source <> b.source")
    p, q = (F.expr(f"if(kept > 0, 1 + {UNIT} div ({x}.n + kept), null)") for x in "ab")
    base = F.coalesce(F.col("kept") * F.expr("(p - q) * (p - q) div q"), F.lit(0))
    pairs = empty.withColumns({"p": p, "q": q}).select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), base.cast("long").alias("value"))
    pairs = pairs.unionByName(partial.filter("part = 'pair' and source <> item").select("lang", "source", "item", "value"))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = partial.filter("part = 'term'")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    columns = ["lang", "source", "part", "item", "value", F.row_number().over(best).alias("rank")]
    return pairs.select(*columns).unionByName(terms.select(*columns).filter(F.col("rank") <= top_terms))
