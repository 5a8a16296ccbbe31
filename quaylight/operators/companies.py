"""Company figures: discounted cash flows, peers, industries, regions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lots among which the companies of one industry are dealt, and distances that a task holds at once.
LOTS, CELLS = 16, 2_000_000
#: Metrics that two companies must have for a distance.
LEAST_METRICS = 3


def dcf(cash: Column, growth: Column, discount: Column, terminal: Column, years: int = 5) -> Column:
    """Present value of ``years`` growing cash flows and of all after them, by the sum of a geometric series.

    Null without a positive cash flow, or where the discount rate isn't above the terminal growth.
    """
    q = (1 + growth) / (1 + discount)
    series = F.when(F.abs(q - 1) < 1e-12, F.lit(float(years))).otherwise(q * F.try_divide(1 - F.pow(q, F.lit(years)), 1 - q))
    last = F.pow(q, F.lit(years)) * (1 + terminal)
    ok = (cash > 0) & growth.isNotNull() & (discount > terminal) & (discount > 0) & (terminal >= 0)
    return F.when(ok, cash * (series + F.try_divide(last, discount - terminal)))


def sensitivity(companies: DataFrame, key: str, discount_step: float = 0.01, terminal_step: float = 0.005) -> DataFrame:
    """``key, low, high, cells``: values over a 3 by 3 grid of discount rates and terminal growths."""
    grid = companies.sparkSession.createDataFrame([(d * discount_step, t * terminal_step) for d in (-1, 0, 1) for t in (-1, 0, 1)], "__d double, __t double")
    all_ = companies.crossJoin(F.broadcast(grid))
    value = dcf(F.col("cash"), F.col("growth"), F.col("discount") + F.col("__d"), F.col("terminal") + F.col("__t"))
    return all_.withColumn("__v", value).groupBy(key).agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.count("__v").alias("cells"))


def peer_distance(metrics: dict[str, float], least: int = LEAST_METRICS) -> Column:
    """Mean of scaled differences of ``metrics`` (name: least scale) between ``s_`` and ``p_`` columns.

    The scale is the larger magnitude, a part is 2 at most, each missing metric adds 0.15; with fewer than ``least``
    known metrics the distance is 10.
    """
    total, known = F.lit(0.0), F.lit(0)
    for name, floor in metrics.items():
        a, b = F.col(f"s_{name}"), F.col(f"p_{name}")
        part = F.least(F.lit(2.0), F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor)))
        total, known = total + F.coalesce(part, F.lit(0.0)), known + F.when(part.isNotNull(), 1).otherwise(0)
    return F.when(known < least, 10.0).otherwise(F.try_divide(total, known.cast("double")) + (len(metrics) - known) * 0.15)


def _nearest(metrics: dict[str, float], nearest: int, types: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The nearest peers of each subject in two blocks, by ``peer_distance`` and the peer's key."""

    def run(subjects: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        others = others.sort_values("peer")
        found = []
        step = max(1, CELLS // max(1, len(others)))
        for k in range(0, len(subjects) if len(others) else 0, step):
            part = subjects.iloc[k : k + step]
            total = np.zeros((len(part), len(others)))
            for name, floor in metrics.items():
                a, b = (x.to_numpy(dtype=float)[i] for x, i in ((part[f"s_{name}"], np.s_[:, None]), (others[f"p_{name}"], np.s_[None, :])))
                with np.errstate(all="ignore"):
                    # as in Spark, the least of a number and null is the number
                    total += np.fmin(2.0, np.abs(a - b) / np.maximum(np.maximum(np.abs(a), np.abs(b)), floor))
            distance = total / len(metrics) if len(metrics) >= LEAST_METRICS else np.full_like(total, 10.0)
            distance[part["subject"].to_numpy()[:, None] == others["peer"].to_numpy()[None, :]] = np.inf
            last = min(nearest, len(others)) - 1
            row, col = np.nonzero(distance <= np.partition(distance, last, axis=1)[:, last, None])
            value = distance[row, col]
            order = np.lexsort((col, value, row))
            row, col, value = row[order], col[order], value[order]
            kept = (np.arange(len(row)) - np.searchsorted(row, row) < nearest) & (value < np.inf)
            row, col = row[kept], col[kept]
            left, right = part.iloc[row].reset_index(drop=True), others.iloc[col].reset_index(drop=True)
            found.append(pd.concat([left, right.drop(columns=["__industry"])], axis=1).assign(distance=value[kept])[types])
        return pd.concat(found) if found else subjects.iloc[:0].reindex(columns=types)

    return run


def peers(companies: DataFrame, subjects: DataFrame, industry: str, key: str, metrics: dict[str, float], nearest: int = 8) -> DataFrame:
    """``subject, peer, distance, place``: each subject's nearest companies of its industry.

    ``subjects`` may be all companies, or a part of them.  Subjects and companies of an industry are dealt to ``LOTS`` lots
    each, and each pair of lots meets in a task that keeps its nearest, so pairs are never written.  All pairs of an industry
    are compared: the work grows with the square of its size, memory and what is shuffled with its size.
    """
    lot = lambda c: F.pmod(F.xxhash64(c), F.lit(LOTS)).cast("int")
    every = F.explode(F.array(*[F.lit(k) for k in range(LOTS)]))
    kind = companies.schema[key].dataType.simpleString()
    s = subjects.filter(F.col(industry).isNotNull()).select(F.col(key).alias("subject"), F.col(industry).alias("__industry"), *[F.col(m).cast("double").alias(f"s_{m}") for m in metrics])
    p = companies.filter(F.col(industry).isNotNull()).select(F.col(key).alias("peer"), F.col(industry).alias("__industry"), *[F.col(m).cast("double").alias(f"p_{m}") for m in metrics])
    s = s.filter("subject is not null").withColumn("__lot", lot("subject")).withColumn("__other", every)
    p = p.filter("peer is not null").withColumn("__other", lot("peer")).withColumn("__lot", every)
    types = {"__industry": companies.schema[industry].dataType.simpleString(), "subject": kind, "peer": kind, **{f"{x}_{m}": "double" for x in "sp" for m in metrics}, "distance": "double"}
    by = ["__industry", "__lot", "__other"]
    found = s.groupBy(*by).cogroup(p.groupBy(*by)).applyInPandas(_nearest(metrics, nearest, list(types)), ", ".join(f"`{n}` {t}" for n, t in types.items()))
    w = Window.partitionBy("subject").orderBy("distance", "peer")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= nearest)


def compare_with_peers(near: DataFrame, metric: str) -> DataFrame:
    """``subject, value, median, percentile, sample``: a metric among its peers', by the middle of equal ranks."""
    a, b = F.col(f"s_{metric}"), F.col(f"p_{metric}")
    g = near.groupBy("subject").agg(F.max(a).alias("value"), F.median(b).alias("median"), F.count(b).alias("sample"), F.count_if(b < a).alias("__less"), F.count_if(b == a).alias("__equal"))
    share = F.when((F.col("sample") >= 2) & F.col("value").isNotNull(), (F.col("__less") + F.col("__equal") * 0.5) / F.col("sample") * 100)
    return g.select("subject", "value", "median", share.alias("percentile"), "sample")


def leave_one_out(near: DataFrame, metric: str) -> DataFrame:
    """``subject, low, high``: extremes of the peers' median with one peer left out; three peers at least.

    A subject has few peers, so their values fit in an array.
    """
    values = near.groupBy("subject").agg(F.array_sort(F.collect_list(f"p_{metric}")).alias("v"))
    n = F.size("v") - 1
    at = lambda i, k: F.col("v")[F.when(k >= i, k + 1).otherwise(k).cast("int")]
    half = lambda i: F.when(n % 2 == 1, at(i, F.floor(n / 2))).otherwise((at(i, F.floor(n / 2) - 1) + at(i, F.floor(n / 2))) / 2)
    medians = F.transform(F.sequence(F.lit(0), F.size("v") - 1), half)
    return values.filter(F.size("v") >= 3).select("subject", F.array_min(medians).alias("low"), F.array_max(medians).alias("high"))


def regions(companies: DataFrame, all_regions: DataFrame, key: str, score: str) -> DataFrame:
    """Companies and mean score of every configured region; one without companies has 0."""
    g = companies.groupBy(key).agg(F.count("*").alias("companies"), F.avg(score).alias("score"))
    return all_regions.join(g, key, "left").select(key, F.coalesce("companies", F.lit(0)).alias("companies"), F.coalesce("score", F.lit(0.0)).alias("score"))


def annual_facts(facts: DataFrame, concepts: Sequence[str], units: Sequence[str]) -> DataFrame:
    """``company, concept, unit, period_end, value, prior`` of each company's newest annual period.

    Of the listed concepts the first one with data counts, then the first unit; of filings for one period the latest.
    ``facts``: ``company, concept, unit, period_start, period_end, filed, value``; annual: 270 to 550 days.
    """
    place = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    days = F.datediff("period_end", "period_start")
    some = facts.filter(F.col("concept").isin(*concepts) & F.col("unit").isin(*units) & days.between(270, 550) & F.col("value").isNotNull())
    some = some.withColumns({"__c": place("concept", concepts), "__u": place("unit", units)})
    best = some.groupBy("company").agg(F.min(F.struct("__c", "__u")).alias("__best"))
    some = some.join(best, "company").filter(F.struct("__c", "__u") == F.col("__best"))
    once = some.groupBy("company", "concept", "unit", "period_end").agg(F.max_by("value", "filed").alias("value"))
    w = Window.partitionBy("company").orderBy(F.desc("period_end"))
    two = once.withColumn("__rank", F.row_number().over(w)).withColumn("prior", F.lead("value").over(w))
    return two.filter("__rank = 1").drop("__rank")


def ratios(m: dict[str, Column]) -> dict[str, Column]:
    """Ratios of a company's metrics by name; a missing or zero denominator gives null.

    Prices over something take a positive one; a price, value or result of zero counts as missing.
    """
    over = lambda a, b: F.when(m[b] != 0, m[a] / m[b])
    some = lambda c: F.when(c != 0, c)
    price, shares = some(m["price"]), some(m["shares"])
    cap = F.coalesce(m["market_cap"], price * shares)
    value = cap + some(m["net_debt"])
    per = lambda a, b: F.when((a != 0) & (b > 0), a / b)
    return {
        "roe": over("net_income", "equity"), "roa": over("net_income", "assets"), "debt_to_equity": over("debt", "equity"), "current_ratio": over("current_assets", "current_liabilities"),
        "fcf_conversion": over("fcf", "net_income"), "net_margin_pct": over("net_income", "revenue") * 100, "pe": F.coalesce(per(price, m["eps"]), F.when(~F.coalesce((price != 0) & (m["eps"] > 0), F.lit(False)), per(cap, m["net_income"]))),
        "pfcf": per(cap, m["fcf"]), "ev_ebitda": per(value, m["ebitda"]), "ev_revenue": per(value, m["revenue"]),
    }


def signals(m: dict[str, Column], strength: dict[str, Column], guidance: Column) -> dict[str, Column]:
    """The eleven rule signals of a report.  ``m``: metrics and, as ``prior_``, those before; ``strength``: how a report speaks of a topic."""
    change = lambda x: F.when(m[f"prior_{x}"] != 0, (m[x] - m[f"prior_{x}"]) / F.abs(m[f"prior_{x}"]) * 100)
    steps = lambda c, high: F.when(c.isNull(), 0).when(c >= high, 2).when(c > 0, 1).when(c < -10, -2).otherwise(-1)
    revenue, inventory, backlog = change("revenue"), change("inventory"), change("backlog")
    margin, before = m["fcf_margin"], m["prior_fcf_margin"]
    gross, gross_before = m["gross_margin"], m["prior_gross_margin"]
    grown = (m["fcf"] != 0) & (m["prior_fcf"] != 0) & (m["fcf"] > m["prior_fcf"])
    said = lambda x, usual: F.when(strength[x] == "strong", 2).when(strength[x].isin("present", "moderate", "high", "raised"), usual).otherwise(0)
    return {
        "revenue": steps(revenue, 10), "capex": steps(change("capex"), 15), "fcf": F.when(margin > before, 2).when(grown, 1).when(margin < before, -2).otherwise(0),
        "gross_margin_delta": F.when((gross >= 60) | (gross > gross_before), 1).when(gross < gross_before, -1).otherwise(0),
        "inventory_vs_revenue": F.when(inventory > revenue + 10, -2).when(inventory <= revenue, 1).otherwise(0), "backlog": F.when(backlog > 0, 1).when(backlog < 0, -1).otherwise(0),
        "ai_demand": said("ai_demand", 2), "data_centre_demand": said("data_centre_demand", 1), "supply_constraints": said("supply_constraints", 1), "pricing_power": said("pricing_power", 1),
        "guidance_direction": F.when(guidance == "up", 2).when(guidance == "down", -2).otherwise(0),
    }


def stage(score: Column, comparable: Column, analyses: Column, news: Column, pe: Column) -> Column:
    """Stage of a company by its score of 0 to 10; the high ones take comparable figures, maturity a history and a price."""
    base = F.when(score < 2, "monitor").when((score < 5) | ~comparable, "forming").when(score < 8, "confirmed").otherwise("accelerating")
    return F.when(base.isin("confirmed", "accelerating") & (analyses >= 2) & (news >= 3) & F.coalesce(pe >= 25, F.lit(False)), "mature").otherwise(base)
