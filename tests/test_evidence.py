"""Candidate groups, sections, excerpts and pending rows against plain Python, over edge rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quaylight.operators import evidence
from quaylight.sources import sinks
from quaylight.sources.scratch import Scratch

ITEMS = "id long, origin string, is_claim boolean, at long, source string, story string, entities array<string>, industries array<string>, terms array<string>"


def plain_groups(rows, least, sources):
    """key -> ids, in the order of a reader who holds all rows."""
    pairs = lambda t: {f"phrase:{a}-{b}" for a, b in zip(t, t[1:]) if a != b}
    spread = {r[0]: ({f"term:{t}" for t in r[8] or []}, pairs(r[8] or [])) for r in rows}
    frequent = set()
    for kind in (0, 1):
        n = {}
        for r in rows:
            for key in spread[r[0]][kind]:
                n.setdefault(key, set()).add(r[1])
        frequent |= set(sorted((k for k in n if len(n[k]) >= 2), key=lambda k: (-len(n[k]), k))[:120])
    blocks = {}
    for r in sorted(rows):
        found = {k for s in spread[r[0]] for k in s if k in frequent}
        if r[5] and r[5].strip():
            found.add("story:" + r[5].strip().lower())
        found |= {f"entity:{e}" for e in r[6] or []} | {f"industry:{e}" for e in r[7] or []}
        for key in sorted(found)[:20]:
            block = blocks.setdefault(key, {})
            if r[1] not in block or (block[r[1]][2] and not r[2]):
                block[r[1]] = r
    groups = []
    for key, block in blocks.items():
        items = sorted(block.values(), key=lambda r: (r[3], r[0]), reverse=True)[:20]
        names = {r[4] for r in items} - {None}
        if len(items) >= least and len(names) >= sources:
            kind = key.partition(":")[0]
            size = -len(items) if kind in ("term", "phrase") else len(items)
            groups.append(((evidence.KINDS[kind], len(names), size, items[0][3], key), {r[1] for r in items}, sorted(r[0] for r in items)))
    out, covered = {}, []
    for rank, origins, ids in sorted(groups, reverse=True, key=lambda g: g[0]):
        if not any(origins <= c for c in covered):
            covered.append(origins)
            out[rank[-1]] = ids
    return out


def test_candidate_groups(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(300):
        terms = [str(x) for x in rng.choice(words, int(rng.integers(0, 7)))]
        rows.append((k, f"o{k % 170}", bool(k % 3 == 0), int(rng.integers(0, 50)), None if k % 11 == 0 else f"s{k % 4}", [None, "", " A "][k % 3] if k % 7 else "b", [f"concept:c{k % 9}"] if k % 2 else None, ["steel"] if k % 40 == 0 else [], None if k % 50 == 0 else terms))
    df = spark.createDataFrame(rows, ITEMS)
    got = {r["key"]: r["ids"] for r in evidence.candidate_groups(df, 3, 2).collect()}
    assert got == plain_groups(rows, 3, 2) and len(got) > 10
    assert evidence.candidate_groups(df.limit(0), 3, 2).count() == 0


def test_filing_deltas(spark):
    first = "Head\nOutlook: sales up 4%.\nRisk Factors\nwar"
    rows = [(1, "a", "q", 1, 1, first), (2, "a", "q", 2, 1, first.replace("4%", "5.5 %") + " Dividends none"), (3, "a", "q", 2, 2, "Outlook: sales  UP 4%."), (4, "a", "q", 3, 1, None), (5, None, "q", 1, 1, ""), (6, "a", "q", None, 1, "risk factor x")]
    df = spark.createDataFrame(rows, "document_id long, company string, document_type string, report_date long, created_at long, text string")
    got = {(r["document_id"], r["category"]): (r["previous_id"], r["change"], r["excerpt"], r["percents"]) for r in evidence.filing_deltas(df).collect()}
    assert got[1, "guidance"] == (None, "new", ": sales up 4%.", ["4%"]) and got[1, "risk_language"][2] == "war"
    assert got[2, "guidance"] == (1, "changed", "5.5 %.", ["5.5 %"]) and got[2, "risk_language"][1] == "unchanged" and got[2, "capital_allocation"][1] == "new"
    assert got[3, "guidance"][:2] == (1, "unchanged") and got[3, "risk_language"][:3] == (1, "removed", None)
    assert got[4, "guidance"][:2] == (3, "removed") and got[6, "risk_language"][:2] == (None, "new") and len(got) == 9
    assert evidence.filing_deltas(df.limit(0)).count() == 0


def test_excerpts(spark):
    long = "\n".join(["Intro", "Item 1", "x" * 50, "revenue " * 5, "y" * 400, "Signatures", "revenue", "z" * 100])
    df = spark.createDataFrame([(1, "short"), (2, ""), (3, None), (4, long)], "doc_id long, text string")
    got = sorted(tuple(r) for r in evidence.excerpts(df, [(3, "^item"), (-1, "^signature")], "revenue", 200, 10, 10, 30, 150).collect())
    # the opening of the item, the keyword's line near by, then the weaker section's line
    assert got[0] == (1, 0, 5) and [g[0] for g in got] == [1, 4, 4]
    assert long[got[1][1] : got[1][2]].startswith("Item 1") and "revenue revenue" in long[got[1][1] : got[1][2]] and "revenue" in long[got[2][1] : got[2][2]]
    assert sum(b - a for k, a, b in got if k == 4) <= 200


def test_pending(spark):
    windows = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00", "pending", None), (2, "a", "2024-01-03 10:00:00", "pending", None), (3, "b", "2024-01-01 10:00:00", "pending", None), (4, "a", "2024-01-01 10:00:00", "resolved", 9.0)], "id long, symbol string, t string, status string, price double")
    windows = windows.select("id", "symbol", F.col("t").cast("timestamp_ntz").alias("target_at"), "status", "price")
    ticks = spark.createDataFrame([("a", "2024-01-01 09:59:00", 1.0), ("a", "2024-01-01 10:00:01", 2.0), ("b", "2024-01-01 09:00:00", 3.0)], "symbol string, t string, close double").select("symbol", F.col("t").cast("timestamp_ntz").alias("ts"), "close")
    got = {r["id"]: (r["status"], r["price"]) for r in evidence.resolve_due(windows, ticks, ["symbol"], F.lit("2024-01-02").cast("timestamp_ntz"), 600).collect()}
    assert got == {1: ("resolved", 1.0), 2: ("pending", None), 3: ("pending", None), 4: ("resolved", 9.0)}


def test_manifest(spark):
    both = sinks.Manifest(spark, Scratch(spark, "manifest").path("t"))
    frame = lambda k: spark.createDataFrame([(k,)], "k int")
    assert both.read("a") is None
    both.write({"a": frame(1), "b": frame(2)}, {"a": "k int"})
    both.write({"b": frame(3)}, {})
    try:
        both.write({"b": frame(4), "a": frame(5)}, {"a": "k long"})
        raise AssertionError("a wrong schema was written")
    except ValueError:
        pass
    assert [both.read(n).first()["k"] for n in ("a", "b")] == [1, 3]
