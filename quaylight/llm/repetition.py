"""Quality rules on repetition within a text, by suffix arrays over its words.

Suffixes are ranked by prefix doubling, text by text, for many texts at once.  The longest common prefixes of neighbours
in suffix order bound the LCP intervals: a suffix's deepest interval is the longest repeated run of words that begins at
it.  The union of these runs is the union of all maximal repeated substrings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylight.llm.words import Words, steps

#: Characters that count as symbols; fixed values.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Limits:
    #: Words in a text at least.
    min_words: int = 10
    #: Words of the windows behind ``n_repeat_words``, and the per cent of words they may cover.
    window: int = 5
    max_repeat_percent: int = 20
    #: Shortest maximal repeat that counts, the fraction of the words' characters that such repeats may cover (first
    #: occurrences included), and the words that the longest may have.
    min_repeat: int = 8
    max_covered: float = 0.2
    max_longest: int = 100


def suffix_levels(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of all texts, one after the other, and the ranks after 1, 2, 4 ... words.

    Two suffixes of a text have the same rank at level ``k`` if and only if they share ``2 ** k`` words.
    """
    n = len(values)
    order = np.lexsort((values, docs))
    new = np.ones(n, bool)
    new[1:] = (values[order[1:]] != values[order[:-1]]) | (docs[order[1:]] != docs[order[:-1]])
    ranks = np.empty(n, np.int64)
    heads = np.flatnonzero(new)
    ranks[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    levels, span = [ranks], 1
    left = np.sort(order[_shared(new)])
    while len(left):
        ranks = ranks.copy()
        then = np.minimum(left + span, n - 1)
        second = np.where((left + span < n) & (docs[then] == docs[left]), ranks[then] + 1, 0)
        by = np.argsort(ranks[left] * np.int64(n + 1) + second, kind="stable")
        left, second = left[by], second[by]
        first = ranks[left]
        group = np.ones(len(left), bool)
        group[1:] = first[1:] != first[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(left))
        begin = np.maximum.accumulate(np.where(group, at, 0))
        ranks[left] = first + np.maximum.accumulate(np.where(new, at, 0)) - begin
        levels.append(ranks)
        left = np.sort(left[_shared(new)])
        span *= 2
    return np.argsort(ranks), levels


def _shared(new: np.ndarray) -> np.ndarray:
    """True for the members of groups of two or more, given the first of each group in order."""
    last = np.append(new[1:], True)
    return ~(new & last)


def longest_repeats(values: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on occur elsewhere in its text: its deepest LCP interval."""
    n = len(values)
    if n < 2:
        return np.zeros(n, np.int64)
    order, levels = suffix_levels(values, docs)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, common = a[live], b[live], np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        ok = (np.maximum(i, j) < n) & (docs[np.minimum(i, n - 1)] == docs[a]) & (docs[np.minimum(j, n - 1)] == docs[b])
        ok &= levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]
        common += np.where(ok, 1 << k, 0)
    lcp[live] = common
    out = np.zeros(n, np.int64)
    out[order[:-1]] = lcp
    out[order[1:]] = np.maximum(out[order[1:]], lcp)
    return out


def covered(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """True for each of ``n`` positions in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes, -1)
    return np.cumsum(edge[:-1]) > 0


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    words = Words(texts)
    n, docs = words.n_docs, words.doc
    per_doc = lambda flags: np.bincount(docs, weights=flags, minlength=n).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.data])])[words.offsets]
    points = words.code_points()
    repeats = longest_repeats(words.hashes(), docs)
    window = np.flatnonzero(repeats >= limits.window)
    in_window = covered(window, np.full(len(window), limits.window), len(words))
    runs = np.flatnonzero(repeats >= limits.min_repeat)
    in_run = covered(runs, repeats[runs], len(words))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, docs[runs], repeats[runs])
    # a run is left-maximal if the run one word earlier isn't the same run, longer by that word
    before = np.where(runs > 0, repeats[runs - 1] == repeats[runs] + 1, False)
    out = {
        "n_words": words.counts(),
        "word_chars": per_doc(points),
        "n_symbols": np.diff(symbols),
        "n_dup_lines": np.array([duplicate_lines(t or "") for t in texts.to_pylist()], np.int64),
        "n_repeat_words": per_doc(in_window),
        "repeated_chars": per_doc(points * in_run),
        "longest_repeat_words": longest,
        "n_maximal_repeats": np.bincount(docs[runs[~before]], minlength=n).astype(np.int64),
    }
    out["base_failed"] = (out["n_words"] < limits.min_words) | (100 * out["n_repeat_words"] > limits.max_repeat_percent * out["n_words"])
    good = (out["repeated_chars"] <= limits.max_covered * out["word_chars"]) & (longest <= limits.max_longest)
    out["kept"] = ~out["base_failed"] & good
    return out


NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeated_chars", "longest_repeat_words", "n_maximal_repeats"]


def repetition_verdicts(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row for each document: its measures, ``base_failed`` and ``kept``.

    A null or empty text has no words, so it fails.  Repeated rows are judged each on its own.  Texts are judged whole.
    """
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                found = measure(part.column("text"), limits)
                names = [*NUMBERS, "base_failed", "kept"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[c]) for c in names)], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", base_failed boolean, kept boolean"
    return rows.mapInArrow(run, schema)


def keep_good(docs: DataFrame, limits: Limits | None = None, column: str = "text") -> DataFrame:
    """The rows whose text the rules keep, with all columns as they are."""
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, column):
                yield part.filter(pa.array(measure(part.column(column), limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
