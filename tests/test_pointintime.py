"""Adapters, cutoffs, leakage and comparison of runs on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quaylight.operators import pointintime
from quaylight.operators.pointintime import Adapter
from quaylight.plans import replay

SF = "/root/testdata/sf0.001"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_conditions_reach_the_scan(spark):
    orders = next(a for a in replay.ADAPTERS if a.table == "orders")
    at = F.lit("2001-06-01").cast("timestamp_ntz")
    rows = pointintime.collected(spark.read.parquet(f"{SF}/orders.parquet"), orders, at - F.expr("INTERVAL 30 DAYS"), at)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(o_orderdate,2001-05-02" in plan and "LessThanOrEqual(o_orderdate,2001-06-01" in plan
    assert "o_totalprice" not in plan and "Exchange" not in plan


def test_versions_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 1, day(1), day(2), "a"), (1, 2, day(1), day(9), "b"), (2, 1, day(3), day(3), None), (3, 1, None, day(1), "x"), (4, 1, day(-400), day(1), "x")], "k int, v int, at timestamp_ntz, seen timestamp_ntz, x string")
    a = Adapter("f", "t", ["k"], "at", ["seen"], ["x"], "x", {"e": "x"}, identity=["k"], version="v")
    got = {r["ref"]: (r["available_at"], r["entities"], r["content"]) for r in pointintime.collect({"t": rows}, [a], "2024-01-05", 30).collect()}
    assert got == {"f:1": (day(2), ["e:a"], '{"x":"a"}'), "f:2": (day(3), [], '{"x":null}')}
    live = {r["ref"]: r["content"] for r in pointintime.collect({"t": rows}, [a], "2024-01-05", 30, replay=False).collect()}
    assert live == {"f:1": '{"x":"b"}', "f:2": '{"x":null}'}
    twice = Adapter("f", "t", ["k"], "at", ["seen"], ["x"], "x")
    assert sorted(r["content"] for r in pointintime.collect({"t": rows}, [twice], "2024-02-01", 60, limit=10).collect()) == ['{"x":"b"}', '{"x":null}']
    with pytest.raises(ValueError, match="differ"):
        pointintime.collect({"t": rows}, [a, a], "2024-01-05", 30)
    assert pointintime.collect({"t": rows.limit(0)}, [a], "2024-01-05", 30, limit=5).count() == 0


def evidence(spark, rows):
    schema = "ref string, event_at timestamp_ntz, available_at timestamp_ntz, valid_from timestamp_ntz, valid_to timestamp_ntz, revision_at timestamp_ntz, ends_at timestamp_ntz, safe boolean, content_hash string"
    return spark.createDataFrame(rows, schema)


def test_admission(spark):
    ok = lambda ref, **kw: tuple({"ref": ref, "event_at": day(0), "available_at": day(1), "valid_from": None, "valid_to": None, "revision_at": None, "ends_at": None, "safe": True, "content_hash": "0" * 63 + ref[-1]} | kw for _ in (0,))[0]
    cases = [ok("a"), ok("b", safe=False), ok("c", available_at=day(6)), ok("d", valid_from=day(6)), ok("e", valid_to=day(5)), ok("f", revision_at=day(6)), ok("1", ends_at=day(6)), ok("2", valid_to=day(6)), ok("3", available_at=day(5)), ok("x", event_at=day(6), available_at=day(1))]
    decided = pointintime.admitted(evidence(spark, [tuple(c.values()) for c in cases]), "2024-01-06")
    assert {r["ref"]: r["category"] for r in decided.collect()} == {"a": None, "b": "integrity", "c": "future", "d": "version", "e": "version", "f": "revision", "1": "reaction", "2": None, "3": None, "x": "future"}
    told = pointintime.audit(decided.unionByName(decided)).first()
    assert (told["considered"], told["included"], told["excluded_future"], told["latest"]) == (10, 3, 2, day(5))
    empty = pointintime.audit(decided.limit(0)).first()
    assert (empty["considered"], empty["earliest"]) == (0, None) and empty["evidence_fingerprint"] != told["evidence_fingerprint"]


def test_leaks_through_cycles_and_unknown_rows(spark):
    decided = spark.createDataFrame([("e1", None, None, day(1)), ("e2", "future", "late", day(9)), ("e3", "future", "late", day(9))], "ref string, category string, reason string, available_at timestamp_ntz")
    edges = [("o1", "n1"), ("n1", "n2"), ("n2", "n1"), ("n2", "e2"), ("n1", "e1"), ("o2", "e1"), ("o3", "ghost"), ("o4", "o1"), ("o4", "e3"), ("o1", None), (None, "e2"), ("other", "e3"), ("o5", "o5")]
    lineage = spark.createDataFrame(edges, "node string, parent string")
    outputs = spark.createDataFrame([("o1",), ("o2",), ("o3",), ("o4",), ("o5",), ("o6",), ("o1",)], "output_id string")
    tainted, rows = pointintime.leaks(outputs, lineage, decided)
    assert {r["output_id"]: (r["ref"], r["steps"], r["reason"]) for r in tainted.collect()} == {"o1": ("e2", 3, "late"), "o3": ("ghost", 1, "unknown evidence"), "o4": ("e3", 1, "late")}
    assert {r["ref"]: r["category"] for r in rows.collect()} == {"e2": "future", "e3": "future", "ghost": "unknown"}
    none, no_rows = pointintime.leaks(outputs.limit(0), lineage, decided)
    assert none.count() == 0 and no_rows.count() == 0


def test_planted_late_row(spark):
    """A row that becomes known a day late is the one that is reported."""
    tables = {a.table: spark.read.parquet(f"{SF}/{a.table}.parquet") for a in replay.ADAPTERS}
    known = pointintime.collect(tables, replay.ADAPTERS, replay.AS_OF, replay.DAYS)
    clean = pointintime.admitted(known, replay.AS_OF).filter("category is null")
    planted = clean.limit(1).withColumns({"ref": F.lit("planted:1"), "available_at": F.lit("2001-06-02").cast("timestamp_ntz")}).drop("category", "reason")
    decided = pointintime.admitted(clean.drop("category", "reason").unionByName(planted), replay.AS_OF)
    edges = clean.select(F.concat(F.lit("case:"), "family").alias("node"), F.col("ref").alias("parent")).unionByName(spark.createDataFrame([("case:orders", "planted:1")], "node string, parent string"))
    tainted, rows = pointintime.leaks(edges.select(F.col("node").alias("output_id")).distinct(), edges, decided)
    assert [tuple(r) for r in tainted.collect()] == [("case:orders", "planted:1", pointintime.REASONS["future"], 1)]
    assert [r["ref"] for r in rows.collect()] == ["planted:1"]


def test_bitemporal_reads(spark):
    rows = spark.createDataFrame([("k", day(0), day(10), day(1), 1.0), ("k", day(0), day(10), day(4), 2.0), ("k", day(10), None, day(4), 3.0), ("j", day(0), None, day(9), 4.0)], "k string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded timestamp_ntz, x double")
    at = lambda as_of, valid=None: sorted((r["k"], r["x"]) for r in pointintime.versions_at(rows, ["k"], "recorded", as_of, valid).collect())
    assert at("2024-01-03") == [("k", 1.0)] and at("2024-01-06") == [("k", 2.0), ("k", 3.0)]
    assert at("2024-01-20", "2024-01-05") == [("j", 4.0), ("k", 2.0)] and at("2024-01-20", "2024-01-11") == [("j", 4.0), ("k", 3.0)]


def test_comparison_needs_one_input(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1), (4, None, None)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 2), (2, "q", 3), (4, None, None), (5, "n", 1)], "k int, s string, n int")
    got = {r["k"]: (r["change"], r["columns"]) for r in pointintime.compare_runs(a, b, ["k"], ["s", "n"], ("f", "f")).collect()}
    assert got == {1: ("changed", ["n"]), 2: ("changed", ["s", "n"]), 3: ("removed", None), 5: ("added", None)}
    with pytest.raises(ValueError, match="identical"):
        pointintime.compare_runs(a, b, ["k"], ["s"], ("f", "g"))
