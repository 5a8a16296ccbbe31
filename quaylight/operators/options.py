"""Option chains: at-the-money volatility, straddles, skew, totals, unusual activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylight.functions.numeric import ratio

BY = ("symbol", "dte")


def occ_symbol(symbol: Column) -> Column:
    """``{root, expiration, kind, strike}`` of an option's 21-character or packed symbol; null where it has another form."""
    form = r"^([A-Z]{1,6}) *([0-9]{6})([CP])([0-9]{8})$"
    part = lambda k: F.regexp_extract(symbol, form, k)
    found = F.struct(
        part(1).alias("root"), F.try_to_date(F.concat(F.lit("20"), part(2)), "yyyyMMdd").alias("expiration"), F.when(part(3) == "C", "call").otherwise("put").alias("kind"),
        (F.try_divide(part(4).try_cast("double"), F.lit(1000.0))).alias("strike"),
    )
    return F.when(symbol.rlike(form), found)


def mid(bid: str = "bid", ask: str = "ask", last: str = "last") -> Column:
    return F.coalesce((F.col(bid) + F.col(ask)) / 2, F.col(last))


def at_the_money(chain: DataFrame) -> DataFrame:
    """``symbol, dte, strike, iv, sides``: the strike nearest to ``spot`` with a volatility, and the mean of its sides.

    The nearest contract is found by an aggregate; its strike's sides are then averaged.
    """
    some = chain.filter("iv is not null and spot is not null")
    near = some.groupBy(*BY).agg(F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("gap"), F.col("strike").alias("atm"))).alias("near"))
    at = some.join(near.select(*BY, F.col("near.atm").alias("atm")), list(BY)).filter("strike = atm")
    sides = at.groupBy(*BY, "strike", "kind").agg(F.avg("iv").alias("iv"))
    return sides.groupBy(*BY, "strike").agg(F.avg("iv").alias("iv"), F.count("*").alias("sides"))


def straddles(chain: DataFrame, atm: DataFrame) -> DataFrame:
    """``symbol, dte, straddle, implied_move_percent, iv_move_percent``; null where a side has no price."""
    at = chain.join(atm.select(*BY, F.col("strike").alias("__atm"), F.col("iv").alias("__iv")), list(BY)).withColumn("__mid", mid())
    side = lambda k: F.max(F.when((F.col("kind") == k) & (F.col("strike") == F.col("__atm")), F.col("__mid")))
    g = at.groupBy(*BY).agg((side("call") + side("put")).alias("straddle"), F.max("spot").alias("spot"), F.max("__iv").alias("iv"))
    return g.select(*BY, "straddle", (100 * ratio("straddle", "spot")).alias("implied_move_percent"), F.when(F.col("dte") > 0, F.col("iv") * F.sqrt(F.col("dte") / 365.0) * 100).alias("iv_move_percent"))


def put_skew(chain: DataFrame, atm: DataFrame, offset: float = 0.05) -> DataFrame:
    """``symbol, dte, otm_strike, skew``: volatility of the put nearest to ``spot * (1 - offset)`` less that at the money."""
    puts = chain.filter("kind = 'put' and strike < spot and iv is not null")
    gap = F.abs(F.col("strike") - F.col("spot") * (1 - offset))
    near = puts.groupBy(*BY).agg(F.min_by(F.struct("strike", "iv"), F.struct(gap, "strike", "iv")).alias("p"))
    return near.join(atm.select(*BY, F.col("iv").alias("__iv")), list(BY)).select(*BY, F.col("p.strike").alias("otm_strike"), (F.col("p.iv") - F.col("__iv")).alias("skew"))


def totals(chain: DataFrame) -> DataFrame:
    """Volume of each expiry over contracts that have one, and whether all have."""
    return chain.groupBy(*BY).agg(F.count("*").alias("contracts"), F.sum("volume").alias("volume"), (F.count("volume") == F.count("*")).alias("complete"))


def unusual(snapshots: DataFrame, value: str, least: int = 5, threshold: float = 0.95) -> DataFrame:
    """``symbol, state, percentile, unusual``: each symbol's last total among its earlier ones.

    ``snapshots``: ``symbol, captured_at`` and the total; nulls are left out of history.
    """
    last = snapshots.groupBy("symbol").agg(F.max("captured_at").alias("__last"), F.max_by(value, "captured_at").alias("__now"))
    both = snapshots.join(last, "symbol")
    earlier = (F.col("captured_at") < F.col("__last")) & F.col(value).isNotNull()
    g = both.groupBy("symbol", "__now").agg(F.count_if(earlier).alias("n"), F.count_if(earlier & (F.col(value) <= F.col("__now"))).alias("below"))
    ok = (F.col("n") >= least) & F.col("__now").isNotNull()
    share = F.when(ok, F.col("below") / F.col("n"))
    return g.select("symbol", F.when(ok, "ok").otherwise("insufficient_history").alias("state"), share.alias("percentile"), (share >= threshold).alias("unusual"))
