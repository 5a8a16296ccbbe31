"""The manifest, the divergence audit and the fingerprint index against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import plain
from tests.llm.test_documents import EDGE, SF

from quaylight.llm import divergence, manifest, simhash
from quaylight.sources.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["tree", "n", "place", "leaf", "root", "slots", "at", "task", "block", "term", "item", "value", "docs", "part", "key", "print", "rep", "mask", "node", "changed", "is_changed", "lot"]


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(d, t, lang, f"s{d % 3}" if d % 5 else None, len(t) if t else None) for d, t, lang in EDGE]
    return made(spark, rows).cache()


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.mark.parametrize("which", ["edge", "table"])
def test_manifest(which, request):
    docs = request.getfixturevalue(which)
    got = manifest.dataset_manifest(docs, manifest.changed_third(), manifest.small_letters())
    want = plain.manifest([r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9, 1], [64, 65, 513], [1] * 9 + [7]])
def test_trees_of_many_shapes(spark, sizes):
    """A lone leaf is its subroot, a last run may have one node, and a tree of trees has levels too."""
    rows = [(1000 * k + i, f"Text {i} of {k}", f"l{k}" if k else None, "s", 3) for k, n in enumerate(sizes) for i in range(n)]
    docs = made(spark, rows)
    got = manifest.dataset_manifest(docs, manifest.changed_third(), manifest.small_letters())
    want = plain.manifest([r.asDict() for r in docs.collect()])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert manifest.dataset_manifest(docs).filter("not verified").count() == 0


def test_manifest_of_repeated_rows(spark):
    """Equal rows and null ids are leaves of their own, in the order of their digests."""
    rows = [(None, "a B", "x", "s", 1)] * 5 + [(3, "c D", "x", "s", 1)] * 12 + [(3, "another", "x", None, None), (None, None, None, None, None)]
    docs = made(spark, rows)
    got = manifest.dataset_manifest(docs, manifest.changed_third(), manifest.small_letters())
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain.manifest([r.asDict() for r in docs.collect()])))
    assert manifest.dataset_manifest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["edge", "table"])
def test_divergence(which, request):
    docs = request.getfixturevalue(which)
    got = {tuple(r) for r in divergence.source_divergence(docs).collect()}
    assert got == plain.divergence([tuple(r) for r in docs.select("lang", "source", "text").collect()])


def test_divergence_of_small_steps(spark, monkeypatch):
    """Whole and cut texts, held and passed-on counts, blocks of sources: all give the same."""
    rng = np.random.default_rng(1)
    words = [f"W{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(300)]
    rows = [(i, " ".join(words[k] for k in rng.zipf(1.4, int(rng.integers(0, 400))) % 300), "en" if i % 3 else "", f"s{int(rng.zipf(1.5)) % 12}", 1) for i in range(150)]
    rows += [(i, None if i % 2 else " 12 - ", "fr", f"t{i % 4}", 1) for i in range(8)]
    docs = made(spark, rows)
    want = plain.divergence([(r[2], r[3], r[1]) for r in rows], 3, 20)
    assert {tuple(r) for r in divergence.source_divergence(docs, top_terms=20).collect()} == want
    monkeypatch.setattr(divergence, "HELD_PAIRS", 24)
    assert {tuple(r) for r in divergence.source_divergence(docs, top_terms=20).collect()} == want
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_long_text_is_one_document():
    import pyarrow as pa

    text = "".join(f"word{chr(97 + i % 26)} Ünï " for i in range(2000)) + "z" * 5000
    part = pa.RecordBatch.from_arrays([pa.array(["l"]), pa.array(["s"]), pa.array([text])], names=["lang", "source", "text"])
    whole = sorted(map(tuple, (r.values() for r in divergence._scanned(part).to_pylist())))
    step, divergence.STEP = divergence.STEP, 700
    try:
        pieces = sorted(map(tuple, (r.values() for r in divergence._long_text(part).to_pylist())))
    finally:
        divergence.STEP = step
    assert pieces == whole


def test_exact_shares():
    counts = np.array([0, 5, 10**10, 10**13], np.int64)
    assert divergence._share(counts, np.array([10**14 + 7])).tolist() == [1 + 10**9 * (c + 1) // (10**14 + 7) for c in counts.tolist()]


@pytest.mark.parametrize("which", ["edge", "table"])
def test_fingerprints(which, request):
    docs = request.getfixturevalue(which)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_fingerprint_groups(docs).collect()}
    prints = [(d, plain.simhash(t, 4)) for d, t in docs.select("doc_id", "text").collect()]
    near = plain.near_prints(prints, 4)
    assert got == {d: (f"{p:016x}", near[d]) for d, p in prints}


def test_fingerprint_of_pieces(monkeypatch):
    text = " ".join(f"W{i * i % 91}" for i in range(3000)) + " " + "y" * 400 + "\x0b" + "ß 漢字 \x85 x"
    want = plain.simhash(text, 4)
    for piece in (1, 7, 50, 1000):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text, 4) == want
        assert simhash.fingerprint("a  B\tc", 4) == plain.simhash("a b c", 4)


def balls(rng, centres, members, flips, bits=64):
    out = set()
    for _ in range(centres):
        c = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(members):
            x = c
            for b in rng.choice(bits, int(rng.integers(0, flips)), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("centres", "members", "flips", "bits"), [(1, 600, 9, 64), (30, 20, 7, 64), (600, 1, 1, 64), (1, 400, 5, 6), (3, 200, 12, 24)])
def test_links_of_fingerprints(spark, centres, members, flips, bits):
    """Dense groups, many groups, none, and buckets that several tasks hold."""
    prints = balls(np.random.default_rng(3), centres, members, flips, bits)
    want = plain.near_prints(list(enumerate(prints)), 4)
    array = np.array(prints, np.uint64)
    order = np.argsort(simhash.gray_rank(array), kind="stable")
    labels = simhash.GrayIndex(array[order]).groups(4)
    assert [want[int(order[i])] == want[int(order[labels[i]])] for i in range(len(order))].count(False) == 0
    assert len(set(labels.tolist())) == len(set(want.values()))
    classes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "print long, rep long")
    for task_rows in (100, 100_000):
        links = simhash.near_links(classes, 4, Scratch(spark, "test"), task_rows)
        found = {r["node"]: r["component"] for r in simhash.components(links, Scratch(spark, "test")).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_index_compares_few_nodes():
    """Far fingerprints part in upper nodes: of all pairs of them, three in ten are compared or fewer, nodes included."""
    array = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64))
    array = array[np.argsort(simhash.gray_rank(array))]
    compared, count = 0, np.bitwise_count

    def counted(x):
        nonlocal compared
        compared += x.size
        return count(x)

    np.bitwise_count = counted
    try:
        simhash.GrayIndex(array).groups(4)
    finally:
        np.bitwise_count = count
    assert compared < 0.3 * 20_000**2 / 2


def test_ids_of_fingerprints(spark):
    """Blank texts share the zero fingerprint, a null id has no component, rows of an id are linked by any text."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = made(spark, [(1, a, "", "", 1), (2, b, "", "", 1), (3, a, "", "", 1), (3, b, "", "", 1), (4, None, "", "", 1), (5, " ", "", "", 1), (None, a, "", "", 1), (7, a, "", "", 1), (7, a, "", "", 1)])
    got = sorted(((r["doc_id"] or 0), r["component_id"]) for r in simhash.near_fingerprint_groups(docs).collect())
    assert got[1:] == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (5, 4), (7, 1), (7, 1)] and got[0] == (0, None)
    assert simhash.near_fingerprint_groups(docs.limit(0)).count() == 0
