"""Stories: pair scores, online clusters, aliases, feeds, blocking, graphs of claims."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaylight.functions.text import jaccard, title_tokens

#: Shares of a pair's score; fixed values.
SHARES = {"title": 0.65, "entity": 0.20, "market": 0.10, "time": 0.05}
#: Words of a headline that deny another, tags that do, and the topics of lanes by word; fixed values.
DENIALS = ("denies report", "denied report", "report is false", "not true")
DENIAL_TAGS = ("contradiction", "denial", "denied", "false_report")
FILING_WORDS = ("filing", "sec", "regulator", "antitrust", "lawsuit", "investigation")
MACRO_WORDS = ("fed", "ecb", "boj", "boe", "central", "bank", "inflation", "gdp", "payrolls", "rates")
#: Live stories that an item is held against at most, the ones seen last, and the share of new words that makes news.
CANDIDATES, NEWS = 100, 0.25
#: Evidence, days and snapshots from which a case is in a state; fixed values.
LIFECYCLE = {"forming_evidence": 3, "corroborated_evidence": 5, "corroborated_days": 7, "research_ready_evidence": 6, "mature_evidence": 10, "mature_snapshots": 3, "weakening_days": 45, "archive_days": 120, "sources": 2}
#: Parts that the items of one time bucket and token are dealt into; the asked items go to each part.
SALTS = 4


def pair_score(title: Column, entity: Column, market: Column, seconds_apart: Column, window_seconds: float) -> Column:
    """Blend of three overlaps and of nearness in time, to 12 places."""
    near = F.greatest(F.lit(0.0), 1 - F.abs(seconds_apart) / window_seconds)
    return F.round(title * SHARES["title"] + entity * SHARES["entity"] + market * SHARES["market"] + near * SHARES["time"], 12)


def rare_tokens(items: DataFrame, overlap: float) -> DataFrame:
    """``items`` with ``rare``: the rarest of each one's tokens, of which two items of such a title overlap share one."""
    if overlap <= 0:
        return items.withColumn("rare", F.array_distinct("tokens"))
    flat = items.select("id", F.explode(F.array_distinct("tokens")).alias("token"))
    counted = flat.join(flat.groupBy("token").agg(F.count("*").alias("n")), "token")
    ordered = counted.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all"))
    few = F.slice(F.col("all.token"), F.lit(1), (F.size("all") - F.ceil(F.size("all") * overlap - 1e-9) + 1).cast("int"))
    return items.join(ordered.select("id", few.alias("rare")), "id")


def score_against(asked: DataFrame, items: DataFrame, window_seconds: float, least: float) -> DataFrame:
    """``a, b, score`` of each asked item with the earlier items inside the window that reach ``least``.

    Both have ``id, at`` (seconds), ``tokens, entities, markets``.  Only pairs that share a token are compared: both sides
    meet by time bucket and token, so neither is broadcast, and only ids meet; sets are joined to distinct pairs.
    The overlap of titles that ``least`` takes leaves only each item's rarest tokens to meet at.
    """
    overlap = (least - (1 - SHARES["title"])) / SHARES["title"]
    ranked = rare_tokens(items, overlap)
    asked, items = (rare_tokens(asked, 0) if overlap <= 0 else asked.join(ranked.select("id", "rare"), "id")), ranked
    bucket = lambda at: F.floor(at / window_seconds)
    side = lambda x, p: x.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "at", "tokens", "entities", "markets")])
    a = asked.select(F.col("id").alias("a_id"), F.col("at").alias("a_at"), F.explode("rare").alias("token"))
    a = a.withColumn("bucket", F.explode(F.sequence(bucket(F.col("a_at") - window_seconds), bucket(F.col("a_at"))))).withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    b = items.select(F.col("id").alias("b_id"), F.col("at").alias("b_at"), bucket(F.col("at")).alias("bucket"), F.pmod(F.hash("id"), F.lit(SALTS)).alias("salt"), F.explode("rare").alias("token"))
    near = (F.col("b_at") <= F.col("a_at")) & (F.col("a_at") - F.col("b_at") <= window_seconds) & (F.col("a_id") != F.col("b_id"))
    pairs = b.join(a, ["bucket", "token", "salt"]).filter(near).select("a_id", "b_id").distinct()
    both = pairs.join(side(asked, "a"), "a_id").join(side(items, "b"), "b_id")
    score = pair_score(jaccard(F.col("a_tokens"), F.col("b_tokens")), jaccard(F.col("a_entities"), F.col("b_entities")), jaccard(F.col("a_markets"), F.col("b_markets")), F.col("a_at") - F.col("b_at"), window_seconds)
    return both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), score.alias("score")).filter(F.col("score") >= least)


def is_denial(title: Column, tags: Column | None = None) -> Column:
    """Whether a title says so in one of the phrases, or a tag does."""
    plain = F.array_join(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), 0), " ")
    found = F.lit(False) if tags is None else F.arrays_overlap(tags, F.array(*[F.lit(t) for t in DENIAL_TAGS]))
    for phrase in DENIALS:
        found = found | F.contains(plain, F.lit(phrase))
    return found


def lane(tokens: Column, tags: Column, watched: Column, confidence: Column, sources: Column, importance: Column) -> Column:
    """The first lane whose rule a story fits; tags count as words, ``watched`` tells of listed entities or markets."""
    has = lambda words: F.arrays_overlap(F.array_union(tokens, tags), F.array(*[F.lit(w) for w in words]))
    return (
        F.when((confidence < 0.55) | (sources <= 1), "low_confidence").when(has(FILING_WORDS), "filings_regulators").when(has(MACRO_WORDS), "macro_central_banks")
        .when(watched, "watchlist_related").when(importance >= 0.75, "market_moving").otherwise("developing")
    )


def story_key(title: Column, day: Column, entities: Column, markets: Column) -> Column:
    """``story:`` and the hash of a story's day, up to 16 of its sorted words, and its sorted entities and markets."""
    ids = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda x: x.isNotNull() & (x != "")), F.lower)))
    identity = F.struct(day.cast("string").alias("date"), ids(entities).alias("entities"), ids(markets).alias("markets"), F.slice(F.array_sort(title_tokens(title)), 1, 16).alias("tokens"))
    return F.concat(F.lit("story:"), F.sha2(F.to_json(identity), 256))


class Clusters:
    """Stories of one block in order of arrival; those whose last item has left the window are dropped.

    An item joins the best of the stories seen last from the threshold on, of equal ones that with the least name; else it
    founds one.  What it adds: a denial contradicts, a new source confirms, enough new words or any new entity or market
    is news, all else repeats.
    """

    def __init__(self, window: float, threshold: float, stories: list | None = None):
        self.window, self.threshold = window, threshold
        self.stories = stories or []

    def add(self, id_: int, at: float, tokens: frozenset, source: str, denial: bool = False, entities: frozenset = frozenset(), markets: frozenset = frozenset()) -> tuple[int, str, float]:
        """(cluster, contribution, score) of an item."""
        self.stories = [s for s in self.stories if at - s["seen"] <= self.window]
        overlap = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        best, top = None, -1.0
        for s in sorted(self.stories, key=lambda s: (-s["seen"], -s["id"]))[:CANDIDATES]:
            near = max(0.0, 1 - abs(at - s["seen"]) / max(1.0, self.window))
            parts = overlap(tokens, s["tokens"]) * SHARES["title"], overlap(entities, s["entities"]) * SHARES["entity"], overlap(markets, s["markets"]) * SHARES["market"], near * SHARES["time"]
            score = round(sum(parts), 12)
            if score >= self.threshold and (score > top or (score == top and str(s["id"]) < str(best["id"]))):
                best, top = s, score
        if best is None:
            self.stories.append({"id": id_, "seen": at, "tokens": tokens, "sources": {source}, "entities": entities, "markets": markets})
            return id_, "origin", 1.0
        fresh = len(tokens - best["tokens"]) / max(1, len(tokens | best["tokens"]))
        news = fresh >= NEWS or entities - best["entities"] or markets - best["markets"]
        kind = "contradiction" if denial else "cross_source_confirmation" if source not in best["sources"] else "material_update" if news else "repeated_coverage"
        best["seen"] = max(best["seen"], at)
        best["sources"].add(source)
        best["entities"], best["markets"] = best["entities"] | entities, best["markets"] | markets
        return best["id"], kind, top


#: What a story item consists of beside its block.
ITEM = ("id", "at", "tokens", "source", "denial", "entities", "markets")


def add_item(stories: Clusters, row: object) -> tuple:
    """``id, cluster, contribution, score`` of a row with the columns of ``ITEM``."""
    return (row.id, *stories.add(int(row.id), float(row.at), frozenset(row.tokens), row.source, bool(row.denial), frozenset(row.entities), frozenset(row.markets)))


def cluster_blocks(items: DataFrame, block: Sequence[str], window_seconds: float, threshold: float) -> DataFrame:
    """``id, cluster, contribution, score``: items join stories of their block in order of (at, id).

    ``items``: the columns of ``ITEM`` and the block's.  The order decides, so a block is one ordered stream of rows; it is
    read in Arrow batches and holds only the stories inside the window.
    """
    schema = "id long, cluster long, contribution string, score double"
    keys = list(block)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, Clusters(window_seconds, threshold)
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                of = tuple(getattr(row, k) for k in keys)
                if of != now:
                    now, state = of, Clusters(window_seconds, threshold)
                out.append(add_item(state, row))
            yield pd.DataFrame(out, columns=["id", "cluster", "contribution", "score"])

    ordered = items.repartition(*keys).sortWithinPartitions(*keys, "at", "id")
    return ordered.select(*dict.fromkeys([*ITEM, *keys])).mapInPandas(run, schema)


def prefer_primary(records: DataFrame, key: str, primary: str, order: str, alias: str) -> DataFrame:
    """The primary record of each key, else the first one, with the sorted aliases of the others.

    A key's aliases are the names of its sources: a short list, kept distinct before they are gathered.
    """
    w = Window.partitionBy(key).orderBy(F.desc(primary), order)
    first = records.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
    names = records.select(key, F.col(alias).alias("__alias")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("__alias")).alias("__all"))
    return first.join(names, key).withColumn("aliases", F.array_join(F.array_remove("__all", F.col(alias)), ",")).drop("__all")


def block_keys(items: DataFrame, keys: Column, least: int, most_per_item: int = 20) -> DataFrame:
    """``key, items, sources, first_id, last_id`` of keys that ``least`` items share, two sources among them."""
    flat = items.select("id", "source", F.explode(F.slice(F.array_sort(F.array_distinct(keys)), 1, most_per_item)).alias("key"))
    g = flat.groupBy("key").agg(F.count("*").alias("items"), F.countDistinct("source").alias("sources"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return g.filter((F.col("items") >= least) & (F.col("sources") > 1))


def paths(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """``path, depth``: simple paths from stated starts over ``from_node, to_node``, as node lists joined by ``>``.

    Each step is one join on the last node; nodes already on the path are left out.
    """
    edges = edges.select("from_node", "to_node").distinct()
    now = starts.select(F.array(F.col("node").cast("string")).alias("path"), F.col("node").alias("last"))
    out = None
    for depth in range(1, steps + 1):
        now = now.join(edges, F.col("last") == F.col("from_node")).filter(~F.array_contains("path", F.col("to_node").cast("string")))
        now = now.select(F.concat("path", F.array(F.col("to_node").cast("string"))).alias("path"), F.col("to_node").alias("last"))
        found = now.select(F.array_join("path", ">").alias("path"), F.lit(depth).alias("depth"))
        out = found if out is None else out.unionByName(found)
    return out


def next_lifecycle(current: Column, evidence: Column, sources: Column, persistence_days: Column, snapshots: Column, complete: Column, quiet_days: Column) -> Column:
    """State of a case: archived stays, then long silence, then the highest state whose counts are reached.

    ``complete``: the case has a causal chain, value capture, an adversarial review and a deliverable.
    """
    t = LIFECYCLE
    many = sources >= t["sources"]
    return (
        F.when((current == "archived") | (quiet_days >= t["archive_days"]), "archived").when(quiet_days >= t["weakening_days"], "weakening")
        .when((evidence >= t["mature_evidence"]) & (snapshots >= t["mature_snapshots"]) & complete, "mature").when((evidence >= t["research_ready_evidence"]) & many & complete, "research_ready")
        .when((evidence >= t["corroborated_evidence"]) & many & (persistence_days >= t["corroborated_days"]), "corroborated").when(evidence >= t["forming_evidence"], "forming").otherwise("candidate")
    )
