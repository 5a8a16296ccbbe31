"""Language identification by error-correcting output codes.

Each language has a codeword.  For each bit of the code a naive Bayes classifier on hashed byte n-grams tells the
languages with that bit from those without.  The bits' losses, weighted by how well each classifier does on rows it was
not fitted on, choose the nearest codeword; a small distance to the next one marks an ambiguous text.  Whether a text is in
that language at all is told by the mean log probability of its n-grams there, held against texts that were left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.words import buffers, mix, steps

#: Orders of the byte n-grams and cells of their hash table.
ORDERS = (1, 2, 3)
CELLS = 1 << 13
#: Rows that are fitted on, of each language, on average; the sample is chosen by a hash of the document's id.
SAMPLE_ROWS = 800
#: Rows of all languages together: many languages share them, each with LEAST_ROWS or more.
SAMPLE_TOTAL, LEAST_ROWS = 16_000, 20
#: Positions of a text that one numpy step holds.
BLOCK = 1 << 18
#: Less than this between the losses of the two nearest codewords marks a text as ambiguous.
MARGIN = 0.35
UNDETERMINED = "und"
#: Share of an n-gram that a language was not seen with.
UNSEEN = 2e-6
#: A text is in no language if its evidence lies more than FAR times as deep under its language's median as that of the
#: lowest tenth of left-out texts; that depth grows by SHORT / sqrt(n) for a text of n n-grams.  Languages with fewer
#: sampled rows than JUDGED reject nothing.
FAR, SHORT, JUDGED = 30.0, 8.0, 8

_U = np.uint64
#: Letters and the bytes of longer code points as they are, all else a space.
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def codewords(n: int) -> np.ndarray:
    """(n languages, bits) of -1 and 1: all splits of up to seven languages; else the best of several random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if row and split >> (row - 1) & 1 else -1 for split in splits] for row in range(n)], np.int8)
    bits = int(np.ceil(10 * np.log2(n)))
    best, gap = None, -1
    for seed in range(64):
        code = (mix(np.arange(n * bits, dtype=_U) + _U(seed * 1_000_003)).reshape(n, bits) & _U(1)).astype(np.int8) * 2 - 1
        mixed = (np.abs(code.sum(0)) < n).all()
        least = int(((bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(n, dtype=int)).min())
        if mixed and least > gap:
            best, gap = code, least
    return best if best is not None else np.where(np.eye(n), 1, -1).astype(np.int8)


def cells(data: np.ndarray, ends: np.ndarray, order: int, at: int, to: int) -> np.ndarray:
    """Table cells of the n-grams that begin at positions ``at`` to ``to``; CELLS where one would leave its text."""
    n = len(data)
    key = np.full(to - at, order, np.uint32)
    for k in range(order):
        stop = min(to + k, n)
        key[: stop - at - k] = key[: stop - at - k] * np.uint32(257) + data[at + k : stop]
    found = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - CELLS.bit_length() + 1)).astype(np.int64)
    for k in range(1, order):
        over = ends - k
        over = over[(over >= at) & (over < to)]
        found[over - at] = CELLS
    return found


def counted() -> np.ndarray:
    """Whether a cell is evidence of a language: not if it holds n-grams with two blanks, which all signs turn into."""
    blank, found = 0x20, np.ones(CELLS + 1, bool)
    for gram in [(blank,), (blank, blank), *((int(b), blank, blank) for b in np.unique(_PLAIN)), *((blank, blank, int(b)) for b in np.unique(_PLAIN))]:
        found[cells(np.array(gram, np.uint8), np.array([len(gram)]), len(gram), 0, 1)] = False
    found[CELLS] = False
    return found


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = buffers(pc.utf8_lower(texts))
    return offsets, _PLAIN[data]


def _counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: the cells that occur and how often."""
    offsets, data = plain(texts)
    for i in range(len(texts)):
        body = data[offsets[i] : offsets[i + 1]]
        total = np.zeros(CELLS + 1, np.int64)
        for order in ORDERS:
            for at in range(0, len(body), BLOCK):
                total += np.bincount(cells(body, np.array([len(body)]), order, at, min(at + BLOCK, len(body))), minlength=CELLS + 1)
        some = np.flatnonzero(total[:CELLS])
        yield some, total[some]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray
    #: (CELLS + 1, bits): log odds of each cell; the last is for n-grams that leave their text.
    weights: np.ndarray
    #: Slope and intercept that turn a text's mean log odds into a logit, and each bit's weight.
    slope: np.ndarray
    intercept: np.ndarray
    trust: np.ndarray
    #: (languages, CELLS + 1): log probability of each cell, 0 where it is no evidence; the median of each language's texts
    #: and the depth under it that is still in the language.
    typical: np.ndarray
    median: np.ndarray
    depth: np.ndarray

    def logits(self, texts: pa.Array) -> np.ndarray:
        offsets, data = plain(texts)
        total = np.zeros((len(texts), self.weights.shape[1]))
        n, filled = len(data), np.flatnonzero(np.diff(offsets))
        starts, ends = offsets[:-1][filled], offsets[1:]
        sizes = np.zeros(len(texts))
        for order in ORDERS:
            for at in range(0, n, BLOCK):
                to = min(at + BLOCK, n)
                rows = self.weights[cells(data, ends, order, at, to)]
                first, last = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, to, "left")
                cut = np.maximum(starts[first:last], at) - at
                np.add.at(total, filled[first:last], np.add.reduceat(rows, cut, axis=0))
            sizes += np.maximum(np.diff(offsets) - order + 1, 0)
        return total / np.maximum(sizes, 1)[:, None] * self.slope + self.intercept

    def above(self, texts: pa.Array, language: np.ndarray) -> np.ndarray:
        """How far the evidence of each text for the given language is above the least that texts of it have."""
        offsets, data = plain(texts)
        is_counted = counted()
        total, size = np.zeros(len(texts)), np.zeros(len(texts))
        for order in ORDERS:
            for at in range(0, len(data), BLOCK):
                to = min(at + BLOCK, len(data))
                found = cells(data, offsets[1:], order, at, to)
                of = np.searchsorted(offsets, np.arange(at, to), "right") - 1
                total += np.bincount(of, self.typical[language[of], found], minlength=len(texts))
                size += np.bincount(of, is_counted[found], minlength=len(texts))
        size = np.maximum(size, 1)
        return total / size - self.median[language] + self.depth[language] * (1 + SHORT / np.sqrt(size))

    def known(self, texts: pa.Array) -> np.ndarray:
        """Whether each text is in a language: the nearest one, or the next if the two are close."""
        best, _, ambiguous = self.decode(texts)
        known = best >= 0
        if known.any():
            known[known] = self.above(texts.filter(pa.array(known)), best[known]) >= 0
        again = ambiguous & ~known
        if again.any():
            some = texts.filter(pa.array(again))
            known[again] = self.above(some, np.argsort(self.losses(some), axis=1)[:, 1]) >= 0
        return known

    def losses(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages): a bit has one loss where a codeword has it and another where it doesn't."""
        z = self.logits(texts)
        return np.logaddexp(0, -z) @ (self.trust * (self.code == 1)).T + np.logaddexp(0, z) @ (self.trust * (self.code == -1)).T

    def decode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, or -1; score; whether the two nearest codewords are close) of each text."""
        with_letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
        loss = self.losses(texts)
        part = np.exp(loss.min(1, keepdims=True) - loss)
        best = loss.argmin(1)
        score = part[np.arange(len(best)), best] / part.sum(1)
        gap = np.diff(np.sort(loss, axis=1)[:, :2], axis=1)[:, 0] if len(self.languages) > 1 else np.full(len(best), np.inf)
        return np.where(with_letter, best, -1), np.where(with_letter, score, 0.0), with_letter & (gap < MARGIN)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one feature, with a small ridge, by Newton steps."""
    scale = float(np.abs(x).mean()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 0.05 * w
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), grad)
        w = np.clip(w, -50, 50)
    return float(w[0] / scale), float(w[1])


class _Sample:
    """Sparse n-gram shares of the sampled texts: text, cell and value of each, and the texts' labels."""

    def __init__(self, table: pa.Table, languages: tuple[str, ...]):
        numbers = {x: k for k, x in enumerate(languages)}
        label = [numbers[x] for x in table.column("lang").to_pylist()]
        some, often = table.column("cells").to_pylist(), table.column("counts").to_pylist()
        # the order in which tasks end must not change sums
        order = sorted(range(len(label)), key=lambda i: (some[i], label[i], often[i]))
        self.n, self.label = len(languages), np.array([label[i] for i in order], np.int64)
        self.cell = np.frombuffer(b"".join(some[i] for i in order), "<u2").astype(np.int64)
        self.count = np.frombuffer(b"".join(often[i] for i in order), "<u4").astype(np.float64)
        self.row = np.repeat(np.arange(len(order)), [len(some[i]) // 2 for i in order])

    def per_row(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, minlength=len(self.label))

    def shares(self, values: np.ndarray) -> np.ndarray:
        return values / np.maximum(self.per_row(values), 1)[self.row]

    def per_language(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(languages, CELLS) sums over the texts that ``rows`` marks."""
        on = rows[self.row]
        at = self.label[self.row[on]] * CELLS + self.cell[on]
        return np.bincount(at, values[on], minlength=self.n * CELLS).reshape(self.n, CELLS)


def _evidence(sample: _Sample) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """typical, median and depth of each language; each text is held against the other texts of its language."""
    is_counted, label, n = counted()[:CELLS], sample.label, sample.n
    evident = sample.count * is_counted[sample.cell]
    sizes, x = sample.per_row(evident), sample.shares(evident)
    own = sample.per_language(x, np.ones(len(label), bool))
    totals, rests = own.sum(1), sample.per_row(x)
    typical = np.zeros((n, CELLS + 1), np.float32)
    typical[:, :CELLS] = np.where(is_counted, np.log(own / np.maximum(totals, 1e-9)[:, None] + UNSEEN), 0)
    of = label[sample.row]
    others = np.maximum(own[of, sample.cell] - x, 0) / np.maximum(totals[of] - rests[sample.row], 1e-9)
    left_out = sample.per_row(x * np.log(others + UNSEEN))
    judged = np.bincount(label, minlength=n) >= JUDGED
    median = np.array([np.median(left_out[label == c]) for c in range(n)])
    under = ((median[label] - left_out) / (1 + SHORT / np.sqrt(np.maximum(sizes, 1))))[judged[label]]
    depth = FAR * max(float(np.quantile(under, 0.9)), 1e-3) if len(under) else 0.0
    return typical, median, np.where(judged, depth, np.inf)


def fit_language(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_total: int = SAMPLE_TOTAL, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Fits on a sample of about ``sample_rows`` rows of each language, fewer where all would be over ``sample_total``.

    The sample is chosen by a hash of ``key``; each language that it holds has a codeword.  Rows without text or language
    are left out; without any labelled row, all texts are undetermined.  Only sparse n-gram counts of the sample reach the
    driver.
    """
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).cast("string").alias("key"))
    rows = rows.filter("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel((), codewords(0), np.zeros((CELLS + 1, 1), np.float32), np.ones(1), np.zeros(1), np.ones(1), np.zeros((0, CELLS + 1), np.float32), np.zeros(0), np.zeros(0))
    each = min(sample_rows, max(LEAST_ROWS, sample_total // len(counts)))
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, share double")
    place = F.abs(F.xxhash64(F.coalesce("key", F.lit("")))) % (1 << 30) / float(1 << 30)
    # one row for each language
    chosen = rows.join(F.broadcast(shares), "lang").filter(place < F.col("share")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                some, often = zip(*_counts(part.column("text")), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([x.astype("<u2").tobytes() for x in some], pa.binary()), pa.array([x.astype("<u4").tobytes() for x in often], pa.binary())], names=["lang", "cells", "counts"])

    table = chosen.mapInArrow(run, "lang string, cells binary, counts binary").toArrow()
    languages = tuple(sorted(set(table.column("lang").to_pylist())))
    sample, code = _Sample(table, languages), codewords(len(languages))
    label, x = sample.label, sample.shares(sample.count)
    held = np.arange(len(label)) % 4 == 0 if len(label) >= 40 else np.zeros(len(label), bool)
    own, fitted = sample.per_language(x, np.ones(len(label), bool)), sample.per_language(x, ~held)
    alone = np.bincount(label[~held], minlength=len(languages)) == 0
    fitted[alone] = own[alone]
    share_ = fitted / np.maximum(fitted.sum(1, keepdims=True), 1e-9) + UNSEEN
    bits = code.shape[1]
    weights = np.zeros((CELLS + 1, bits), np.float32)
    slope, intercept, trust = np.ones(bits), np.zeros(bits), np.ones(bits)
    for b in range(bits):
        up, down = share_[code[:, b] == 1], share_[code[:, b] == -1]
        if not len(up) or not len(down):
            continue
        weights[:CELLS, b] = np.log(up.mean(0)) - np.log(down.mean(0))
        z, y = sample.per_row(x * weights[sample.cell, b]), (code[label, b] == 1).astype(float)
        slope[b], intercept[b] = _calibrate(z, y)
        judged = held if held.any() else ~held
        wrong = ((z * slope[b] + intercept[b] > 0) != (y > 0))[judged].mean()
        trust[b] = max(0.05, 1 - 2 * wrong)
    return LanguageModel(languages, code, weights, slope, intercept, trust / trust.mean(), *_evidence(sample))


def predict_language(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score, ambiguous`` of each row: ``und`` and 0 where a text is null or has no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            for part in steps(batch):
                best, score, ambiguous = model.decode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(ambiguous)], names=["key", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("key", key)


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.0, text: str = "text") -> DataFrame:
    """The rows whose text is in a language of the model, by a score of ``least`` or more, with all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text):
                texts = part.column(text)
                known = model.known(texts)
                yield part.filter(pa.array(known & (model.decode(texts)[1] >= least) if least > 0 else known))

    return docs.mapInArrow(run, docs.schema)
