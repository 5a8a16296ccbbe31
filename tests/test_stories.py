"""Story scores of more asked items than a task could be sent."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaylight.operators import stories


def test_many_asked(spark):
    n = 100_050
    k = F.col("id")
    items = spark.range(n).select("id", (k * 1000).alias("at"), F.array(F.concat(F.lit("t"), F.floor(k / 2)), F.concat(F.lit("u"), F.floor(k / 2))).alias("tokens"), F.array(F.lit("e")).alias("entities"), F.array(F.lit("m")).alias("markets"))
    found = stories.score_against(items, items, 2000.0, 0.0)
    got = found.agg(F.count("*"), F.countDistinct("a"), F.count_if((F.col("a") - F.col("b") == 1) & (F.col("a") % 2 == 1)), F.min("score"), F.max("score")).first()
    assert tuple(got) == (n // 2, n // 2, n // 2, 0.975, 0.975)
