"""The nearest tick against plain Python, over buckets of several widths."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from quaylight.operators import asof


@pytest.mark.parametrize("bucket_seconds", [7, 60, 86_400])
@pytest.mark.parametrize(("seconds", "offset"), [(5, 0), (40, 10), (1000, -30), (0, 0)])
def test_nearest_tick(spark, seconds, offset, bucket_seconds):
    rng = random.Random(seconds + bucket_seconds)
    at = lambda n: dt.datetime(1969, 12, 31, 23, 59, 0) + dt.timedelta(seconds=n)
    ticks = [(rng.choice("ab"), rng.randrange(0, 200, 3), float(rng.randrange(5))) for _ in range(60)] + [(None, 50, 9.0)]
    events = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(0, 200)) for i in range(40)] + [(1, "a", 3), (1, "a", 3)]
    rows = asof.nearest(
        spark.createDataFrame([(i, s, at(t)) for i, s, t in events], "id int, symbol string, ts timestamp_ntz"), spark.createDataFrame([(s, at(t), p) for s, t, p in ticks], "symbol string, ts timestamp_ntz, close double"),
        ["symbol"], "ts", ["close"], seconds, offset, bucket_seconds=bucket_seconds,
    )
    want = []
    for i, s, t in events:
        near = [(abs(x - t - offset), x, p) for q, x, p in ticks if q == s and abs(x - t - offset) <= seconds]
        best = min(near) if near else (None, None, None)
        want.append((i, s, at(t), None if best[1] is None else at(best[1]), best[2]))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows.collect()), key=key) == sorted(want, key=key)
