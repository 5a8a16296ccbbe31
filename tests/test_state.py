"""Bucketed tables, the quote source, windows that wait, components of graphs and correlations by blocks."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylight.operators import graphs, market
from quaylight.sources import quotes
from quaylight.sources.buckets import Buckets
from quaylight.streaming import streams
from quaylight.streaming.windows import PendingWindows


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and "__bucket" in d}


def test_untouched_buckets_stay(spark, tmp_path):
    table = Buckets(spark, f"file://{tmp_path}/t", ["k"], 8)
    rows = lambda pairs: spark.createDataFrame(pairs, "k long, v string")
    assert table.read() is None
    table.upsert(rows([(i, "a") for i in range(40)]), writer="w", batch=0)
    before, folders = files(tmp_path), table.folders()
    touched = table.upsert(rows([(3, "b"), (100, "n")]), writer="w", batch=1)
    assert 1 <= len(touched) <= 2
    after = table.folders()
    assert all(after[k] == where for k, where in folders.items() if k not in touched) and all(after[k] != folders[k] for k in touched if k in folders)
    assert all(files(tmp_path)[f] == t for f, t in before.items())
    want = {**{i: "a" for i in range(40)}, 3: "b", 100: "n"}
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    # a batch that is run again, and one without rows
    assert table.upsert(rows([(3, "x")]), writer="w", batch=1) == [] and table.upsert(rows([]), writer="w", batch=2) == []
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    table.keep_latest(rows([(3, "a"), (4, "c")]), [F.desc("v")])
    assert {r["v"] for r in table.read().filter("k in (3, 4)").collect()} == {"b", "c"}
    assert table.vacuum() >= len(touched) and {r["k"]: r["v"] for r in table.read().collect()} == {**want, 4: "c"}
    assert len(files(tmp_path)) == len(table.folders())
    table.delete(rows([(i, "") for i in (*range(40), 100)]))
    assert table.read() is None and table.folders() == {}


def line(name, at, bid, ask, kind="PRICE"):
    return json.dumps({"type": kind, "instrument": name, "time": at, "bids": [{"price": bid}] if bid else [], "asks": [{"price": ask}] if ask else []})


def test_quotes_after_a_restart(spark, tmp_path):
    """Logs are read once each, also when a stream ends and begins again; a log that was read and not yet committed is read again."""
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()
    put = lambda name, *lines: (log / name).write_text("\n".join(lines) + "\n")
    run = lambda: quotes.quotes(spark, f"file://{log}", {"EUR_USD": "EURUSD"}).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{out}").awaitTermination()
    got = lambda: sorted((r["log"], r["line"], r["symbol"], r["price"]) for r in spark.read.schema(quotes.SCHEMA).parquet(f"file://{out}").collect())
    put("001", line("EUR_USD", "2024-01-02T10:00:00.123456789Z", "1.0", "1.2"), line("GBP_USD", "2024-01-02T10:00:00Z", "1", "1"), line("EUR_USD", "2024-01-02T10:00:01Z", "1.1", None), "{broken", line("EUR_USD", "x", "1", "2", "HEARTBEAT"))
    put("_hidden", line("EUR_USD", "2024-01-02T10:00:00Z", "9", "9"))
    run()
    assert got() == [("001", 0, "EURUSD", 1.1)]
    run()
    put("002", line("EUR_USD", "2024-01-02T11:00:00Z", "2.0", "2.0"))
    put("003", "", line("EUR_USD", "2024-01-02T12:00:00Z", "3.0", "3.0"))
    run()
    assert got() == [("001", 0, "EURUSD", 1.1), ("002", 0, "EURUSD", 2.0), ("003", 1, "EURUSD", 3.0)]
    # the commit of the last batch is lost: it runs again over the same logs, and the file sink keeps its rows once
    last = max((tmp_path / "state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (tmp_path / "state/commits").glob(f".{last.name}.crc"):
        crc.unlink()
    run()
    assert got() == [("001", 0, "EURUSD", 1.1), ("002", 0, "EURUSD", 2.0), ("003", 1, "EURUSD", 3.0)]
    assert quotes.quotes(spark, f"file://{log}", stream=False).count() == 4
    latest = Buckets(spark, f"file://{tmp_path}/latest", ["symbol"], 2)
    streams.keep_last(quotes.quotes(spark, f"file://{log}"), latest, [F.desc("at")], f"file://{tmp_path}/state2")
    assert {r["symbol"]: r["price"] for r in latest.read().collect()} == {"EUR_USD": 3.0, "GBP_USD": 1.0}


def test_snapshots(spark):
    price = lambda name, bid, ask, at="2024-01-02T10:00:00Z": {"instrument": name, "time": at, "bids": [{"price": bid}], "asks": [{"price": ask}]}
    payload = json.dumps({"prices": [price("A", "1", "3"), price("B", "1", "3"), price("A", "x", "3"), price("A", "1", "NaN"), price("A", "1", "1", "then"), {"instrument": "A", "time": "2024-01-02"}]})
    rows = quotes.price_snapshots(spark.createDataFrame([(payload,), ("no",), (None,)], "payload string"), {"A": "AA"}).collect()
    assert [(r["symbol"], r["open"], r["close"], r["volume"], r["timeframe"]) for r in rows] == [("AA", 2.0, 2.0, None, "PRICE")]


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def plain_windows(ticks, windows, seconds):
    out = {}
    for w, symbol, target in windows:
        found = [(t, p) for s, t, p in ticks if s == symbol and target - dt.timedelta(seconds=seconds) <= t <= target]
        out[w] = max(found) if found else (None, None)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_windows_in_any_order_of_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    ticks = [(rng.choice("ab"), at(rng.randrange(0, 4000)), float(rng.randrange(50))) for _ in range(120)]
    windows = [(i, rng.choice("abc"), at(rng.randrange(0, 5000))) for i in range(30)]
    rows = [("t", x) for x in ticks] + [("w", x) for x in windows]
    rng.shuffle(rows)
    state = PendingWindows(spark, f"file://{tmp_path}/s", 300, 10_000, 2)
    for k in range(3):
        part = rows[k::3]
        give = lambda: (spark.createDataFrame([x for kind, x in part if kind == "t"], "symbol string, ts timestamp_ntz, close double"), spark.createDataFrame([x for kind, x in part if kind == "w"], "window_id long, symbol string, target_at timestamp_ntz"))  # noqa: B023, E731
        state.advance(k, *give())
        if k == 1:
            state.advance(k, *give())
    got = {r["window_id"]: (r["tick_at"], r["price"]) for r in state.result().collect()}
    assert got == plain_windows(ticks, windows, 300) and {r["status"] for r in state.result().collect()} == {"pending"}


def test_windows_end_and_their_ticks_go(spark, tmp_path):
    state = PendingWindows(spark, f"file://{tmp_path}/s", 100, 50, 2)
    ticks = lambda *x: spark.createDataFrame([("a", at(t), p) for t, p in x], "symbol string, ts timestamp_ntz, close double")
    windows = lambda *x: spark.createDataFrame([(i, "a", at(t)) for i, t in x], "window_id long, symbol string, target_at timestamp_ntz")
    told = lambda: {r["window_id"]: (r["status"], r["price"]) for r in state.result().collect()}
    state.advance(0, ticks((0, 1.0)), windows((1, 40), (2, 500)))
    assert told() == {1: ("pending", 1.0), 2: ("pending", None)}
    state.advance(1, ticks((80, 2.0)), windows())
    assert told()[1] == ("pending", 1.0)
    state.advance(2, ticks((200, 3.0), (30, 1.5)), windows((1, 9999)))
    assert told() == {1: ("resolved", 1.5), 2: ("pending", None)} and state.waiting.read().count() == 1
    state.advance(3, ticks((1000, 9.0), (20, 7.0)), windows((3, 150)))
    assert told() == {1: ("resolved", 1.5), 2: ("unresolved", None), 3: ("resolved", 2.0)}
    assert state.waiting.read() is None and {r["price"] for r in state.ticks.read().collect()} == {9.0}


def plain_components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {t for f, t in edges if f == n} for n in nodes}
    for k, i in itertools.product(nodes, nodes):
        if k in reach[i]:
            reach[i] |= reach[k]
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("edges", [
    [], [(1, 2), (2, 3)], [(1, 1), (1, 2)], [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 5), (1, 2)], [(i, (i + 1) % 12) for i in range(12)] + [(3, 20), (20, 21), (21, 20), (30, 3)],
    [(int(a), int(b)) for a, b in np.random.default_rng(4).integers(0, 60, (75, 2))],
])
def test_components(spark, edges):
    rows = spark.createDataFrame([*edges, (None, 1), (1, None)], "from_node long, to_node long")
    assert {r["node"]: r["component"] for r in graphs.strong_components(rows).collect()} == plain_components(edges)


@pytest.mark.parametrize(("symbols", "times"), [(256, 8192), (2, 8192), (3, 4)])
def test_correlation_blocks(spark, symbols, times):
    """Blocks of any size give the same as one; no join of all symbols at each time is in the plan."""
    rng = np.random.default_rng(2)
    series = {f"s{k}": {int(t): float(1e6 + rng.normal()) for t in rng.choice(40, 30, replace=False)} for k in range(7)} | {"flat": {t: 5.0 for t in range(40)}, "few": {1: 1.0, 2: 4.0}, "none": {99: 1.0}}
    rows = [(s, t, v) for s, of in series.items() for t, v in of.items()] + [("s0", 41, float("nan")), ("s1", 41, None)]
    got = market.pair_correlations(spark.createDataFrame(rows, "symbol string, bucket_s long, ret double"), symbols=symbols, times=times)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().replace("Join Inner, (symbol", "")
    found = {(r["a"], r["b"]): (r["n"], r["correlation"], r["reason"]) for r in got.collect()}
    want = set()
    for a, b in itertools.combinations(sorted(series), 2):
        shared = sorted(series[a].keys() & series[b].keys())
        if not shared:
            continue
        want.add((a, b))
        n, value, reason = found[a, b]
        assert n == len(shared)
        if n < 5 or "flat" in (a, b):
            assert value is None and reason == ("insufficient_paired_samples" if n < 5 else "constant_returns")
        else:
            assert value == pytest.approx(np.corrcoef([series[a][t] for t in shared], [series[b][t] for t in shared])[0, 1], abs=1e-9)
    assert found.keys() == want
