"""Predicates, joins, aggregates, windows, sorts, sets, scalar, array and JSON functions, sinks, accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.functions import text
from quaylight.functions.numeric import finite, is_finite, percent_change, ratio, sign_state
from quaylight.operators import graphs, keys
from quaylight.plans.base import SERIES_SQL, query, series, table
from quaylight.sources import readers, sinks


@query("""SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'error') AND user_id = 7""")
def flt01_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error") & (F.col("user_id") == 7)).select("event_id", "event_type", "value")


@query("""SELECT event_id, event_type FROM events WHERE event_type IN (SELECT json_extract_string(j.value, '$') FROM json_each('["view","signup"]') j) AND value > 90""")
def flt02_json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([('["view","signup"]',)], "j string").select(F.explode(F.from_json("j", "array<string>")).alias("event_type"))
    return table(spark, sf_dir, "events").filter("value > 90").join(F.broadcast(wanted), "event_type", "left_semi").select("event_id", "event_type")


@query("""SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'""")
def flt03_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("ts >= TIMESTAMP_NTZ'2024-01-10' AND ts < TIMESTAMP_NTZ'2024-01-11'").select("event_id", "ts")


@query("""SELECT event_type, count(*) FILTER (x IS NOT NULL AND isfinite(x)) AS finite, round(sum(x) FILTER (isfinite(x)), 6) AS total FROM (SELECT event_type, CASE event_id % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN NULL ELSE value END AS x FROM events) GROUP BY 1""")
def flt04_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k != 2, F.col("value"))
    return table(spark, sf_dir, "events").withColumn("x", x).groupBy("event_type").agg(F.count_if(is_finite("x")).alias("finite"), F.round(F.sum(finite("x")), 6).alias("total"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def flt05_optional(spark: SparkSession, sf_dir: str, status: str | None = "F", custkey: int | None = None) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    for column, wanted in (("o_orderstatus", status), ("o_custkey", custkey)):
        o = o if wanted is None else o.filter(F.col(column) == wanted)
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BLUE%' OR lower(coalesce(p_brand, '')) IN ('brand#11', 'brand#23')""")
def flt06_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%BLUE%") | F.lower(F.coalesce("p_brand", F.lit(""))).isin("brand#11", "brand#23")).select("p_partkey", "p_name")


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def jon02_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")


@query("""SELECT c_custkey, p.o_totalprice AS previous FROM customer LEFT JOIN LATERAL (SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1 OFFSET 1) p ON true""")
def jon10_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = keys.top_n(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderdate", "o_orderkey"), ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, rank="rn")
    return table(spark, sf_dir, "customer").select("c_custkey").join(two.filter("rn = 2").select("c_custkey", F.col("o_totalprice").alias("previous")), "c_custkey", "left")


@query("""SELECT c_custkey, a.n, a.first_price, a.last_price FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM orders WHERE o_custkey = c_custkey) a ON true""")
def jon11_lateral_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.min_by("o_totalprice", at).alias("first_price"), F.max_by("o_totalprice", at).alias("last_price"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(g, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_discount), 8) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def agg01_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ'1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return li.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.round(F.avg("l_discount"), 8).alias("discount"))


@query("""SELECT o_custkey, '[' || array_to_string(list('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' ORDER BY o_orderkey), ',') || ']' AS orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def agg08_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))))
    return o.groupBy("o_custkey").agg(F.to_json(rows).alias("orders"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def agg14_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = keys.exact_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return p.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, turn FROM r ORDER BY turn, lang NULLS FIRST, source NULLS FIRST, doc_id LIMIT 40""")
def win07_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    ranked = keys.top_n(d, ["lang", "source"], [F.asc("doc_id")], 40, rank="turn")
    return ranked.orderBy("turn", "lang", "source", "doc_id").limit(40).select("doc_id", "turn")


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity - 25), l_linenumber) AS nearest FROM lineitem""")
def win08_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.abs(F.col("l_quantity") - 25), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("nearest"))


@query("""SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 50) DESC NULLS LAST, p_partkey) AS place FROM part""")
def win09_nulls_last_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.nullif("p_size", F.lit(50)).desc_nulls_last(), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.row_number().over(w).alias("place"))


@query("""SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 50""")
def srt03_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").offset(50).limit(25).select("c_custkey", "c_name")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100""")
def srt04_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_orderkey, o_custkey, o_orderstatus FROM r WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 30""")
def srt05_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = keys.latest_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ["o_custkey", "o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return first.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""WITH g AS (SELECT l_suppkey, list_sort(list_distinct(list(l_partkey))) AS s FROM lineitem GROUP BY 1)
SELECT l_suppkey FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.l_suppkey < a.l_suppkey AND list_has_all(b.s, a.s))""")
def srt06_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose members no earlier group holds all of; two groups meet on their members, counted by a join."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("m")).distinct()
    sizes = li.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    # the rarest members of a group must all be in any group that holds it all, so few pairs are left to be counted
    often = li.groupBy("m").agg(F.count("*").alias("df"))
    rare = keys.top_n(li.join(often, "m"), ["l_suppkey"], [F.asc("df"), F.asc("m")], 4).select("l_suppkey", "m")
    met = rare.join(li.withColumnRenamed("l_suppkey", "b"), "m").filter("b < l_suppkey").groupBy("l_suppkey", "b").agg(F.count("*").alias("met"))
    pairs = met.join(sizes, "l_suppkey").filter("met = least(n, 4)").select("l_suppkey", "b")
    shared = pairs.join(li, "l_suppkey").join(li.withColumnRenamed("l_suppkey", "b"), ["b", "m"]).groupBy("l_suppkey", "b").agg(F.count("*").alias("shared"))
    gone = shared.join(sizes, "l_suppkey").filter("shared = n").select("l_suppkey").distinct()
    return sizes.join(gone, "l_suppkey", "left_anti").select("l_suppkey")


@query("""SELECT '1d' AS resolution, ts::DATE::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT '1h', date_trunc('hour', ts), count(*) FROM events GROUP BY ALL""")
def set02_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarser resolution is rolled up from the finer one, not read again."""
    hours = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))
    days = hours.groupBy(F.date_trunc("day", "bucket").cast("timestamp_ntz").alias("bucket")).agg(F.sum("n").alias("n"))
    return hours.withColumn("resolution", F.lit("1h")).unionByName(days.withColumn("resolution", F.lit("1d")))


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_orderdate::DATE AS due FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'line', l_orderkey, l_shipdate::DATE FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49""")
def set03_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("due"))
    b = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("due"))
    return a.unionByName(b)


@query("""SELECT p_partkey, coalesce(nullif(p_size, 1), -1) AS size, greatest(p_size, 10) AS at_least, least(p_size, 40) AS at_most, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class,
  lower(trim(p_brand)) || ':' || p_type AS tag, floor(p_retailprice)::BIGINT AS whole, round(pow(p_size, 2), 4) AS square FROM part""")
def fn01_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(-1)).alias("size"), F.greatest(s, F.lit(10)).alias("at_least"), F.least(s, F.lit(40)).alias("at_most"), F.when(s < 10, "small").when(s < 30, "middle").otherwise("large").alias("class"),
        F.concat_ws(":", F.lower(F.trim("p_brand")), "p_type").alias("tag"), F.floor("p_retailprice").alias("whole"), F.round(F.pow(s, F.lit(2)), 4).alias("square"),
    )


@query("""SELECT event_id, timezone('Europe/Berlin', timezone('UTC', ts)) AS berlin, timezone('America/New_York', timezone('UTC', ts)) AS new_york FROM events""")
def fn07_local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = lambda zone: F.convert_timezone(F.lit("UTC"), F.lit(zone), "ts")
    return table(spark, sf_dir, "events").select("event_id", local("Europe/Berlin").alias("berlin"), local("America/New_York").alias("new_york"))


@query(f"""WITH {SERIES_SQL}, p AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY observed_at) AS prev FROM series)
SELECT series_id, observed_at, round(value / nullif(prev, 0) - 1, 8) AS simple, round(100 * (value - prev) / nullif(abs(prev), 0), 6) AS percent, CASE WHEN prev IS NULL THEN NULL WHEN 100 * (value - prev) / abs(prev) > 0.05 THEN 'up' WHEN 100 * (value - prev) / abs(prev) < -0.05 THEN 'down' ELSE 'flat' END AS way FROM p""")
def fn10_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series(spark, sf_dir).withColumn("prev", F.lag("value").over(Window.partitionBy("series_id").orderBy("observed_at")))
    change = percent_change("value", "prev")
    return p.select("series_id", "observed_at", F.round(ratio(F.col("value") - F.col("prev"), "prev"), 8).alias("simple"), F.round(change, 6).alias("percent"), sign_state(change, 0.05, ("up", "down", "flat")).alias("way"))


@query("""SELECT p_partkey, round(CASE WHEN len(list_intersect(a, b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 8) AS overlap FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)""")
def fn14_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.array_distinct(F.split("p_name", " ")), F.array_distinct(F.split(F.lower("p_type"), " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.jaccard(a, b), 8).alias("overlap"))


@query("""SELECT doc_id, substring(trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' '), 1, 120) AS excerpt FROM documents WHERE text IS NOT NULL""")
def fn17_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.substring(text.collapse_space(F.col("text")), 1, 120).alias("excerpt"))


_TAXONOMY = (("metal", ("steel", "copper", "tin", "brass", "nickel")), ("plain", ("standard", "economy")), ("special", ("promo", "large")))


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_type), '(^|[^a-z0-9_])({'|'.join(words)})([^a-z0-9_]|$)') THEN '{name}'" for name, words in _TAXONOMY) + " ELSE 'other' END AS industry FROM part")
def fn18_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.lit("other")
    for name, words in reversed(_TAXONOMY):
        found = F.when(F.lower("p_type").rlike(rf"(?<!\w)({'|'.join(words)})(?!\w)"), name).otherwise(found)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("industry"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k, '{"event":' || event_id || ',"type":"' || event_type || '"}' AS row FROM events""")
def arr04_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.from_json("props", "map<string,long>")
    return table(spark, sf_dir, "events").select("event_id", m["k"].alias("k"), F.map_contains_key(m, "k").alias("has_k"), F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("type"))).alias("row"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda w: upper(w)))), '|') AS words, len(list_distinct(string_split(p_name, ' '))) AS n, list_contains(string_split(p_name, ' '), 'blue') AS blue FROM part""")
def arr08_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.transform(w, F.upper))), "|").alias("words"), F.size(F.array_distinct(w)).alias("n"), F.array_contains(w, "blue").alias("blue"))


@query("""WITH old AS (SELECT l_orderkey AS k, l_linenumber AS v FROM lineitem WHERE l_orderkey % 3 <> 0), new AS (SELECT l_orderkey AS k, l_linenumber * 10 AS v FROM lineitem WHERE l_orderkey % 10 = 0)
SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new""")
def snk05_replace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("v"))
    old, new = li.filter("k % 3 <> 0"), li.filter("k % 10 = 0").withColumn("v", F.col("v") * 10)
    return old.join(new.select("k").distinct(), "k", "left_anti").unionByName(new)


@query("""SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN NULL ELSE props END AS props FROM events""")
def snk10_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.scrub(table(spark, sf_dir, "events"), "ts", "2024-01-15", ["props"]).select("event_id", "props")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS a, CASE o_orderkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'P' ELSE 'F' END AS b FROM orders) SELECT o_orderkey, b AS state FROM o WHERE a <> b AND NOT (a = 'O' AND b IN ('P', 'F') OR a = 'P' AND b = 'F')""")
def snk11_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    k = F.col("o_orderkey") % 3
    new = o.select("o_orderkey", F.when(k == 0, "O").when(k == 1, "P").otherwise("F").alias("state"))
    return sinks.illegal_transitions(o, new, ["o_orderkey"], "state", {"O": ["P", "F"], "P": ["F"]}).select("o_orderkey", "state")


@query("""WITH t AS (SELECT l_suppkey AS issuer, l_shipdate::DATE AS day, l_partkey AS owner, l_orderkey AS accession, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'M' END AS code, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'D' ELSE 'A' END AS side, l_quantity AS q FROM lineitem)
SELECT issuer, day, count(DISTINCT owner) AS owners, count(DISTINCT accession) AS filings, coalesce(sum(q) FILTER (code = 'P' AND side = 'A'), 0) AS bought, coalesce(sum(q) FILTER (code = 'S' AND side = 'D'), 0) AS sold, count(*) FILTER (code = 'M' OR code = 'S' AND side = 'A') AS other FROM t GROUP BY ALL""")
def src23_insider_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    t = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("issuer"), F.to_date("l_shipdate").alias("day"), F.col("l_partkey").alias("owner"), F.col("l_orderkey").alias("accession"), F.when(flag == "A", "P").when(flag == "R", "S").otherwise("M").alias("code"),
        F.when((F.col("l_linestatus") == "F") & (flag == "R"), "D").otherwise("A").alias("acquired"), F.col("l_quantity").alias("shares"), F.lit(1.0).alias("price"),
    )
    return readers.insider_days(t).select("issuer", "day", "owners", "filings", "bought", "sold", "other")


@query("""WITH g AS (SELECT 'S' || (c_custkey % 60) AS symbol, max(c_acctbal) AS score FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), m AS (SELECT symbol, row_number() OVER (ORDER BY score DESC NULLS LAST, symbol) + 2 AS place FROM g WHERE symbol NOT IN ('S1', 'S2'))
SELECT 'S1' AS symbol, 1 AS place UNION ALL SELECT 'S2', 2 UNION ALL SELECT symbol, place FROM m WHERE place <= 12""")
def src25_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select(F.concat(F.lit(" s"), (F.col("c_custkey") % 60).cast("string")).alias("symbol"), F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise("closed").alias("status"), F.col("c_acctbal").alias("score"))
    return readers.universe(t, ["s1", "S2"], 10)


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'high' END AS impact, source, lang FROM documents), r AS (SELECT unnest(['src1', 'src2', 'src3']) AS source, unnest(['EUR', 'USD', 'USD']) AS asset)
SELECT doc_id, asset, place FROM (SELECT doc_id, asset, row_number() OVER (PARTITION BY asset ORDER BY impact NULLS LAST, doc_id) AS place FROM a JOIN r USING (source)) WHERE place <= 6""")
def sty10_matched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("src1", "EUR"), ("src2", "USD"), ("src3", "USD")], "source string, asset string")
    a = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 10 == 0, "high").alias("impact")).join(F.broadcast(rules), "source")
    return keys.top_n(a, ["asset"], [F.col("impact").asc_nulls_last(), F.asc("doc_id")], 6, rank="place").select("doc_id", "asset", "place")


@query("""WITH w AS (SELECT c_custkey AS entity, c_acctbal / 10000 AS score FROM customer WHERE c_custkey % 3 = 0) SELECT o_orderkey, coalesce(max(score), 0) AS relevance FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS entity FROM orders) LEFT JOIN w USING (entity) GROUP BY 1""")
def mat03_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("entity"), (F.col("c_acctbal") / 10000).alias("score"))
    e = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array("o_custkey", F.col("o_custkey") + 1)).alias("entity"))
    return e.join(w, "entity", "left").groupBy("o_orderkey").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("relevance"))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (o_orderpriority < '3') AS high FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01 06:00:00' AND o_orderdate < TIMESTAMP '1996-06-01 06:00:00' + INTERVAL 240 HOUR GROUP BY 1""")
def mac11_next_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP_NTZ'1996-06-01 06:00:00' AND o_orderdate < TIMESTAMP_NTZ'1996-06-01 06:00:00' + INTERVAL 240 HOUR")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.count_if(F.col("o_orderpriority") < "3").alias("high"))


@query(f"""WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY observed_at DESC) AS rn FROM series) SELECT series_id, sha256(array_to_string(list(strftime(observed_at, '%Y-%m-%d') || '=' || n ORDER BY rn), ',')) AS fingerprint FROM r WHERE rn <= 15 GROUP BY 1""")
def mac13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = keys.top_n(series(spark, sf_dir), ["series_id"], [F.desc("observed_at")], 15, rank="rn")
    part = F.concat(F.date_format("observed_at", "yyyy-MM-dd"), F.lit("="), F.col("n").cast("string"))
    return r.groupBy("series_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("rn", part.alias("p"))))["p"], ","), 256).alias("fingerprint"))


@query("""WITH d AS (SELECT source, doc_id // 50 AS day, count(*) AS reports, count(DISTINCT lang) AS langs, round(avg(n_chars), 4) AS score FROM documents GROUP BY ALL) SELECT source, day, reports, langs, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS rn FROM d) WHERE rn <= 48""")
def inv09_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source", F.expr("doc_id div 50").alias("day")).agg(F.count("*").alias("reports"), F.countDistinct("lang").alias("langs"), F.round(F.avg("n_chars"), 4).alias("score"))
    return keys.top_n(d, ["source"], [F.desc("day")], 48)


@query("""SELECT n_name, s_suppkey, s_acctbal, last_price FROM (SELECT DISTINCT ON (s_nationkey) s_nationkey, s_suppkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) JOIN nation ON n_nationkey = s_nationkey
LEFT JOIN (SELECT l_suppkey, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS last_price FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def inv10_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = keys.latest_by(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")])
    price = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("last_price"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return s.join(n, "s_nationkey").join(price, "s_suppkey", "left").select("n_name", "s_suppkey", "s_acctbal", "last_price")


@query("""SELECT l_suppkey, arg_max(l_orderkey, (l_discount > 0.05, l_shipdate, l_quantity, l_orderkey)) AS best FROM lineitem GROUP BY 1""")
def inv13_best_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = F.struct(F.col("l_discount") > 0.05, "l_shipdate", "l_quantity", "l_orderkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", quality).alias("best"))


@query("""WITH s AS (SELECT doc_id, i * 400 AS a, i * 400 + CASE WHEN i % 3 = 0 THEN 500 ELSE 250 END AS b FROM documents, (SELECT unnest(range(6)) AS i) WHERE (doc_id + i) % 4 <> 0),
g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 150 THEN 0 ELSE 1 END AS fresh FROM s), n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS island FROM g)
SELECT doc_id, min(a) AS a, max(b) AS b FROM n GROUP BY doc_id, island""")
def inv20_span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).filter("(doc_id + i) % 4 <> 0")
    s = s.select("doc_id", (F.col("i") * 400).alias("a"), (F.col("i") * 400 + F.when(F.col("i") % 3 == 0, 500).otherwise(250)).alias("b"))
    w = Window.partitionBy("doc_id").orderBy("a")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = s.withColumn("fresh", F.when(F.col("a") <= before + 150, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w))
    return n.groupBy("doc_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


@query("""WITH f AS (SELECT l_suppkey, l_orderkey, max(l_quantity) FILTER (l_linenumber = 1) AS operating, max(l_quantity) FILTER (l_linenumber = 2) AS capital, max(l_returnflag) FILTER (l_linenumber = 1) AS u1, max(l_returnflag) FILTER (l_linenumber = 2) AS u2 FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_orderkey, operating - capital AS free_cash FROM f WHERE u1 = u2""")
def inv23_free_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, k: F.max(F.when(F.col("l_linenumber") == k, F.col(c)))
    f = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(at("l_quantity", 1).alias("operating"), at("l_quantity", 2).alias("capital"), at("l_returnflag", 1).alias("u1"), at("l_returnflag", 2).alias("u2"))
    return f.filter("u1 = u2").select("l_suppkey", "l_orderkey", (F.col("operating") - F.col("capital")).alias("free_cash"))


@query("""WITH c AS (SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer WHERE c_mktsegment = 'BUILDING') SELECT * FROM c ORDER BY CASE WHEN n > 10 THEN 0 ELSE 1 END, last DESC NULLS LAST, c_custkey LIMIT 50""")
def res08_case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name").join(o, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.orderBy(F.when(F.col("n") > 10, 0).otherwise(1), F.col("last").desc_nulls_last(), "c_custkey").limit(50)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS t FROM lineitem), inner_ AS (SELECT f, t FROM e WHERE t IN (SELECT f FROM e)), r(f, t) AS (SELECT f, t FROM inner_ UNION SELECT r.f, e.t FROM r JOIN inner_ e ON r.t = e.f)
SELECT a.f AS node, min(a.t) AS component FROM r a JOIN r b ON a.f = b.t AND a.t = b.f GROUP BY a.f""")
def res05_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on a cycle of all links from suppliers to parts, numbers being nodes, with the component they are in."""
    return graphs.strong_components(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS f, (o_custkey * 7 + o_orderkey) % 2000 AS t FROM orders), r(f, t) AS (SELECT f, t FROM e UNION SELECT r.f, e.t FROM r JOIN e ON r.t = e.f)
SELECT a.f AS node, min(a.t) AS component FROM r a JOIN r b ON a.f = b.t AND a.t = b.f GROUP BY a.f""")
def res05_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a sparser graph: each order is a link from its customer to another."""
    moves = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("from_node"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 2000).alias("to_node"))
    return graphs.strong_components(moves)


@query("""WITH n AS (SELECT DISTINCT c_custkey, unnest(regexp_extract_all(c_name, '[0-9]+'))::BIGINT AS x FROM customer) SELECT c_custkey, x FROM n WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = x AND o_orderstatus = 'P')""")
def res13_ungrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").select("c_custkey", F.explode(text.numeric_tokens(F.col("c_name"))).alias("x")).select("c_custkey", F.col("x").cast("long").alias("x")).distinct()
    known = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("x")).distinct()
    return n.join(known, "x", "left_anti").select("c_custkey", "x")


@query("""SELECT o_custkey, count(DISTINCT o_orderpriority) >= 3 AS satisfied, count(DISTINCT o_orderpriority) AS sources FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30' GROUP BY 1""")
def res12_data_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").filter("o_orderdate <= TIMESTAMP_NTZ'1995-06-30'").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("sources"))
    return g.select("o_custkey", (F.col("sources") >= 3).alias("satisfied"), "sources")


@query("""SELECT o_orderdate::DATE AS day, round(sum(greatest(o_totalprice - CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.9 ELSE 0 END, 0)), 4) AS spend, sum(o_totalprice) > 500000 AS over FROM orders GROUP BY 1""")
def ops04_daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 0.9).otherwise(0.0)
    g = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    return g.agg(F.round(F.sum(F.greatest(F.col("o_totalprice") - settled, F.lit(0.0))), 4).alias("spend"), (F.sum("o_totalprice") > 500000).alias("over"))


@query("""SELECT DISTINCT ON (event_type, user_id % 10) event_type, user_id % 10 AS worker, event_id, ts FROM events ORDER BY event_type, user_id % 10, ts DESC, event_id DESC""")
def ops05_last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("worker"), "event_id", "ts")
    return keys.latest_by(e, ["event_type", "worker"], [F.desc("ts"), F.desc("event_id")])


@query("""SELECT event_type, date_diff('minute', ts, TIMESTAMP '2024-01-31') // 60 AS age, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY ALL""")
def ops13_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.expr("timestampdiff(MINUTE, date_trunc('MINUTE', ts), TIMESTAMP_NTZ'2024-01-31 00:00:00') div 60")
    return table(spark, sf_dir, "events").filter("ts >= TIMESTAMP_NTZ'2024-01-29'").groupBy("event_type", age.alias("age")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, lang, CASE WHEN list_has_any(string_split(lower(coalesce(text, '')), ' '), ['the', 'and']) THEN 'english' WHEN lang IS NULL THEN 'unknown' ELSE 'other' END AS lane FROM documents""")
def sty11_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), " ")
    lane = F.when(F.arrays_overlap(words, F.array(F.lit("the"), F.lit("and"))), "english").when(F.col("lang").isNull(), "unknown").otherwise("other")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", lane.alias("lane"))


