"""Operators of the desk against plain Python, over edge rows."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from quaylight.operators import keys, research


def test_nfkc_tokens(spark):
    texts = [None, "", "ＦＵＬＬ width ﬁnance ﬁnance 12345 a1b2", "Straße Ⅷ ²³ über-lang", "x" * 100_000 + " tail", "tail tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r[0]: r[1] for r in df.select("id", research.nfkc_tokens("text")).collect()}
    for k, t in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", unicodedata.normalize("NFKC", t or "").casefold())
        assert got[k] == list(dict.fromkeys(w for w in words if len(w) >= 4 and not w.isdigit())), t


def test_case_match(spark):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(40)]
    some = lambda: [str(x) for x in rng.choice(words, int(rng.integers(0, 9)), replace=False)]
    cases = [(k, None if k % 9 == 0 else f"p{k % 50}", [some(), some()]) for k in range(150)]
    asked = [(k, f"p{k}" if k % 3 == 0 else None, some()) for k in range(80)]
    found = research.match_cases(spark.createDataFrame(asked, "id long, fingerprint string, tokens array<string>"), spark.createDataFrame(cases, "case_id long, fingerprint string, names array<array<string>>"), 0.3)
    got = {r["id"]: (r["case_id"], r["how"], round(r["score"], 9)) for r in found.collect()}
    want = {}
    for k, fingerprint, tokens in asked:
        same = [c for c, p, _ in cases if fingerprint is not None and p == fingerprint]
        scores = [(max((len(set(tokens) & set(n)) / len(set(tokens) | set(n)) if tokens and n else 0.0) for n in names), -c) for c, _, names in cases]
        best, case = max(scores)
        if same:
            want[k] = (min(same), "fingerprint", 1.0)
        elif best >= 0.3:
            want[k] = (-case, "similarity", round(best, 9))
    assert got == want and {x[1] for x in want.values()} == {"fingerprint", "similarity"}


def test_claim_faults(spark):
    evidence = spark.createDataFrame([(1, "Sales  rose\n7.5% to 1,200."), (2, None)], "evidence_id long, text string")
    claims = spark.createDataFrame([
        (1, "a", "p", "7.5%", "pct", "UP", "sales ROSE 7.5%"), (9, "a", "p", None, None, None, "x"), (1, " ", "p", None, None, None, "Sales"), (1, "a", "p", None, None, "left", "Sales"), (1, "a", "p", None, None, None, None),
        (1, "a", "p", None, None, None, "sales fell"), (1, "a", "p", "8%", None, None, "rose 7.5%"), (1, "a", "p", None, "EUR", None, "Sales"), (2, "a", "p", None, None, None, "Sales"), (1, "a", "p", "1,200.", None, None, "to 1,200."),
    ], "evidence_id long, subject string, predicate string, object_value string, unit string, direction string, source_span string")
    got = [r["fault"] for r in research.claim_faults(claims.withColumn("n", F.monotonically_increasing_id()), evidence, ("up", "down")).orderBy("n").collect()]
    assert got == [None, "unknown_evidence", "missing_text", "invalid_direction", "missing_span", "span_absent", "number_absent", "unit_without_value", "span_absent", None]


def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    groups = {"even": rng.normal(size=1001), "one": np.array([3.0]), "same": np.full(50, 2.0), "heavy": np.concatenate([np.zeros(900), rng.exponential(1e6, 101)]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in keys.exact_percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.95, "c": 1.0}).collect()}
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v, [0.5, 0.95, 1.0])), g
    assert keys.exact_percentiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0
