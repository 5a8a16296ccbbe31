"""Text, arrays, stories, research and operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaylight.functions import text
from quaylight.functions.times import micros
from quaylight.operators import keys, stories
from quaylight.plans.base import query, table

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
#: A title is the whole first line of a document; its time, an hour for each number.
TITLES_SQL = f"""titles AS (SELECT doc_id AS id, source, lang, string_split(text, chr(10))[1] AS title, doc_id * 3600 AS at FROM documents WHERE text IS NOT NULL),
tok AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP}))) AS tokens FROM titles)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "source", "lang", F.substring_index("text", "\n", 1).alias("title"), (F.col("doc_id") * 3600).alias("at"))
    return d.withColumn("tokens", text.title_tokens(F.col("title")))


@query(f"WITH {TITLES_SQL} SELECT id, array_to_string(list_sort(tokens), ' ') AS tokens, len(tokens) AS n FROM tok")
def fn12_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("id", F.array_join(F.array_sort("tokens"), " ").alias("tokens"), F.size("tokens").alias("n"))


WINDOW = 259200.0
SCORES_SQL = TITLES_SQL + """, j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.tokens, b.tokens)) AS shared, len(list_distinct(list_concat(a.tokens, b.tokens))) AS whole, a.at - b.at AS apart, a.source = b.source AS same, a.lang = b.lang AS tongue
  FROM tok a JOIN tok b ON a.id <> b.id AND b.at <= a.at AND a.at - b.at <= 259200 AND list_has_any(a.tokens, b.tokens)),
scores AS (SELECT a, b, round(0.65 * shared / whole + CASE WHEN same THEN 0.2 ELSE 0 END + CASE WHEN coalesce(tongue, false) THEN 0.1 ELSE 0 END + 0.05 * greatest(0, 1 - apart / 259200), 8) AS score FROM j)"""


def story_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = titles(spark, sf_dir).withColumns({"entities": F.array("source"), "markets": F.array_compact(F.array("lang"))})
    return t.withColumns({"at": F.col("at").cast("double"), "denial": stories.is_denial(F.col("title")), "block": F.coalesce("lang", F.lit(""))})


@query(f"WITH {SCORES_SQL} SELECT * FROM scores WHERE a % 100 = 0")
def sty01_pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = story_items(spark, sf_dir)
    return stories.score_against(t.filter("id % 100 = 0"), t, WINDOW, 0.0).withColumn("score", F.round("score", 8))


@query(f"WITH {SCORES_SQL} SELECT a, arg_min(b, (-score, b)) AS b, max(score) AS score FROM scores WHERE score >= 0.55 GROUP BY a")
def sty02_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best story of three days for each item; a pair that reaches the threshold shares a word, as all else gives 0.35."""
    t = story_items(spark, sf_dir)
    s = stories.score_against(t, t, WINDOW, 0.5).withColumn("score", F.round("score", 8)).filter("score >= 0.55")
    return s.groupBy("a").agg(F.min_by("b", F.struct(-F.col("score"), "b")).alias("b"), F.max("score").alias("score"))


@query()
def sty02_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of all sources by order of arrival, a language at a time: each item depends on those before it."""
    return stories.cluster_blocks(story_items(spark, sf_dir), ["block"], WINDOW, 0.55)


_LANE_SQL = ", ".join(f"'{w}'" for w in stories.FILING_WORDS), ", ".join(f"'{w}'" for w in stories.MACRO_WORDS)


@query(f"""WITH {TITLES_SQL}, c AS (SELECT *, (id % 10) / 10.0 AS confidence, id % 4 AS sources, (id % 7) / 7.0 AS importance, CASE WHEN id % 11 = 0 THEN ['denied', 'sec'] WHEN id % 6 = 0 THEN ['rates'] ELSE [] END AS tags FROM tok)
SELECT id, CASE WHEN confidence < 0.55 OR sources <= 1 THEN 'low_confidence' WHEN list_has_any(tokens || tags, [{_LANE_SQL[0]}]) THEN 'filings_regulators' WHEN list_has_any(tokens || tags, [{_LANE_SQL[1]}]) THEN 'macro_central_banks'
  WHEN coalesce(source IN ('src1', 'src2'), false) THEN 'watchlist_related' WHEN importance >= 0.75 THEN 'market_moving' ELSE 'developing' END AS lane, contains(array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' '), 'not true') OR list_contains(tags, 'denied') AS denial FROM c""")
def sty03_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    tags = F.when(k % 11 == 0, F.array(F.lit("denied"), F.lit("sec"))).when(k % 6 == 0, F.array(F.lit("rates"))).otherwise(F.array().cast("array<string>"))
    watched = F.coalesce(F.col("source").isin("src1", "src2"), F.lit(False))
    return titles(spark, sf_dir).select(k, stories.lane(F.col("tokens"), tags, watched, (k % 10) / 10.0, k % 4, (k % 7) / 7.0).alias("lane"), stories.is_denial(F.col("title"), tags).alias("denial"))


@query(f"""WITH {TITLES_SQL} SELECT id, 'story:' || sha256('{{"date":"' || (DATE '2024-01-01' + (id // 100)::INT) || '","entities":[' || array_to_string(list_transform(list_sort(list_filter([source, 'lang:' || lang], lambda x: x IS NOT NULL)), lambda w: '"' || w || '"'), ',')
  || '],"markets":[' || coalesce('"' || lang || '"', '') || '],"tokens":[' || array_to_string(list_transform(list_slice(list_sort(tokens), 1, 16), lambda w: '"' || w || '"'), ',') || ']}}') AS story_key FROM tok""")
def sty04_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of stories: two of a day with the same words but other entities or markets differ."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 100).cast("int"))
    key = stories.story_key(F.col("title"), day, F.array("source", F.concat(F.lit("lang:"), "lang"), F.col("source")), F.array("lang"))
    return titles(spark, sf_dir).select("id", key.alias("story_key"))


@query("""WITH r AS (SELECT md5(coalesce(text, '')) AS h, doc_id, source, source IN ('src1', 'src2', 'src3') AS prim FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY prim DESC, doc_id) AS rn FROM r),
a AS (SELECT h, list_sort(list_distinct(list(source))) AS names FROM r GROUP BY h)
SELECT doc_id, source, array_to_string(list_filter(names, lambda n: n <> source), ',') AS aliases FROM f JOIN a USING (h) WHERE rn = 1""")
def dup01_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("h"), "doc_id", "source", F.col("source").isin("src1", "src2", "src3").alias("prim"))
    return stories.prefer_primary(r, "h", "prim", "doc_id", "source").select("doc_id", "source", "aliases")


@query("""WITH f AS (SELECT md5(text) AS item, doc_id, source FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT item, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM f GROUP BY item""")
def dup02_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").filter("text is not null and source is not null").select(F.md5("text").alias("item"), "doc_id", "source")
    return f.groupBy("item").agg(F.max("doc_id").alias("doc_id"), F.max_by("source", "doc_id").alias("source"))


#: Words of whole texts.
WORDS_SQL = f"words AS (SELECT doc_id AS id, source, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP}))) AS tokens FROM documents WHERE text IS NOT NULL)"


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "source", text.title_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH {WORDS_SQL}, k AS (SELECT id, source, unnest(list_slice(list_sort(list_distinct(tokens)), 1, 20)) AS key FROM words)
SELECT key, count(*) AS items, count(DISTINCT source) AS sources, min(id) AS first_id, max(id) AS last_id FROM k GROUP BY key HAVING count(*) >= 3 AND count(DISTINCT source) > 1""")
def res02_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.block_keys(whole_texts(spark, sf_dir), F.col("tokens"), 3)


@query(f"""WITH {WORDS_SQL}, k AS (SELECT id, source, unnest(tokens) AS key FROM words), m AS (SELECT key, (min(id) + max(id)) / 2 AS mid FROM k GROUP BY key)
SELECT key, count(*) AS mentions, count(*) FILTER (id > mid) - count(*) FILTER (id <= mid) AS acceleration FROM k JOIN m USING (key) GROUP BY key""")
def res03_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = whole_texts(spark, sf_dir).select("id", F.explode("tokens").alias("key"))
    m = k.groupBy("key").agg(((F.min("id") + F.max("id")) / 2).alias("mid"))
    late = F.count_if(F.col("id") > F.col("mid")) - F.count_if(F.col("id") <= F.col("mid"))
    return k.join(m, "key").groupBy("key").agg(F.count("*").alias("mentions"), late.alias("acceleration"))


#: A link is a line of the largest quantity; the starts are the suppliers with the largest balances.
EDGES_SQL = "edges AS (SELECT DISTINCT l_suppkey AS f, l_partkey % 500 + 1 AS t FROM lineitem WHERE l_quantity >= 50)"


@query(f"""WITH RECURSIVE {EDGES_SQL}, p(path, last, depth) AS (SELECT '|' || s || '|' || t || '|', t, 1 FROM (SELECT DISTINCT f AS s FROM edges JOIN supplier ON s_suppkey = f WHERE s_acctbal > 9000) JOIN edges ON f = s WHERE t <> s
  UNION ALL SELECT path || t || '|', t, depth + 1 FROM p JOIN edges ON f = last WHERE depth < 3 AND NOT contains(path, '|' || t || '|'))
SELECT replace(trim(path, '|'), '|', '>') AS path, depth FROM p""")
def res06_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_suppkey").alias("from_node"), (F.col("l_partkey") % 500 + 1).alias("to_node")).distinct()
    starts = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("node"))
    return stories.paths(e, starts, 3)


@query("""WITH g AS (SELECT o_custkey, count(*) AS evidence, count(DISTINCT o_orderpriority) AS sources, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS persistence,
  count(DISTINCT date_trunc('month', o_orderdate)) AS snapshots, bool_or(o_orderstatus = 'P') AND bool_or(o_totalprice > 150000) AND bool_or(o_orderstatus = 'F') AND bool_or(o_orderpriority = '1-URGENT') AS complete,
  greatest(0, date_diff('day', max(o_orderdate)::DATE, DATE '1998-08-01')) AS quiet FROM orders GROUP BY 1)
SELECT o_custkey, evidence, sources, CASE WHEN o_custkey % 29 = 0 OR quiet >= 120 THEN 'archived' WHEN quiet >= 45 THEN 'weakening' WHEN evidence >= 10 AND snapshots >= 3 AND complete THEN 'mature'
  WHEN evidence >= 6 AND sources >= 2 AND complete THEN 'research_ready' WHEN evidence >= 5 AND sources >= 2 AND persistence >= 7 THEN 'corroborated' WHEN evidence >= 3 THEN 'forming' ELSE 'candidate' END AS state FROM g""")
def res07_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, status = F.to_date("o_orderdate"), F.col("o_orderstatus")
    complete = F.bool_or(status == "P") & F.bool_or(F.col("o_totalprice") > 150000) & F.bool_or(status == "F") & F.bool_or(F.col("o_orderpriority") == "1-URGENT")
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("evidence"), F.countDistinct("o_orderpriority").alias("sources"), F.datediff(F.max(day), F.min(day)).alias("persistence"), F.countDistinct(F.trunc(day, "month")).alias("snapshots"),
        complete.alias("complete"), F.greatest(F.lit(0), F.datediff(F.lit("1998-08-01"), F.max(day))).alias("quiet"),
    )
    current = F.when(F.col("o_custkey") % 29 == 0, "archived").otherwise("candidate")
    return g.select("o_custkey", "evidence", "sources", stories.next_lifecycle(current, *[F.col(c) for c in ("evidence", "sources", "persistence", "snapshots", "complete", "quiet")]).alias("state"))


@query("""SELECT l_orderkey, median(l_quantity) AS overall, min(l_quantity) AS lowest, arg_min(l_linenumber, (l_quantity, l_linenumber)) AS weakest, median(l_quantity) >= 20 AND min(l_quantity) >= 5 AS passed FROM lineitem GROUP BY 1""")
def res14_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.median("l_quantity").alias("overall"), F.min("l_quantity").alias("lowest"), F.min_by("l_linenumber", F.struct("l_quantity", "l_linenumber")).alias("weakest"))
    return g.withColumn("passed", (F.col("overall") >= 20) & (F.col("lowest") >= 5))


@query("""WITH s AS (SELECT doc_id, lang, source, sha256(coalesce(text, '')) AS h, n_chars FROM documents)
SELECT doc_id, lag(doc_id) OVER w AS previous, CASE WHEN lag(h) OVER w IS NULL THEN 'first' WHEN lag(h) OVER w = h THEN 'unchanged' ELSE 'changed' END AS delta, n_chars - lag(n_chars) OVER w AS growth FROM s WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)""")
def inv08_filing_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "n_chars")
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    before = F.lag("h").over(w)
    return s.select("doc_id", F.lag("doc_id").over(w).alias("previous"), F.when(before.isNull(), "first").when(before == F.col("h"), "unchanged").otherwise("changed").alias("delta"), (F.col("n_chars") - F.lag("n_chars").over(w)).alias("growth"))


@query("""SELECT conv_id, turn, length(text) AS chars, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY len(regexp_extract_all(lower(text), '[a-z0-9]+')) DESC, turn) AS place FROM conversations WHERE text IS NOT NULL""")
def res15_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))
    c = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.length("text").alias("chars"), words.alias("words"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("words"), "turn")))


@query("""SELECT page_id, sha256(page_id || '') AS id_hash, trim(regexp_replace(url, '#.*$', '')) AS no_fragment FROM pages""")
def src15_page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("page_id").cast("string"), 256).alias("id_hash"), F.trim(F.regexp_replace("url", "#.*$", "")).alias("no_fragment"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g') AS u FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(u, '&{2,}', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '') AS u FROM a)
SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z]+://[^/?]*)', 1)) || substring(u, length(regexp_extract(u, '^([a-zA-Z]+://[^/?]*)', 1)) + 1) AS url FROM b""")
def src15_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


@query()
def src16_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of pages: tags are cut by patterns whose back references DuckDB lacks; tests hold it to an HTML parser."""
    return table(spark, sf_dir, "pages").select("page_id", text.visible_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)[ ]?%', 1), ',') AS percents, array_to_string(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')), ' ') AS numbers FROM documents WHERE text IS NOT NULL""")
def fn19_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.array_join(text.percent_mentions(F.col("text")), ",").alias("percents"), F.array_join(text.numeric_tokens(F.col("text")), " ").alias("numbers"))


@query("""SELECT doc_id, sha256('{"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS hash, concat_ws(':', 'doc', source, lang) AS dedupe_key FROM documents""")
def fn15_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash("source", "lang").alias("hash"), F.concat_ws(":", F.lit("doc"), "source", "lang").alias("dedupe_key"))


@query("""SELECT event_type, coalesce(array_to_string(list_sort(list_distinct(list(CAST(json_extract_string(props, '$.k') AS INT)) FILTER (value > 20))), ','), '') AS ks, count(DISTINCT json_extract_string(props, '$.k')) AS n FROM events GROUP BY event_type""")
def agg07_array_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    e = table(spark, sf_dir, "events").select("event_type", k.alias("k"), "value")
    g = e.groupBy("event_type").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 20, F.col("k")))).alias("ks"), F.countDistinct("k").alias("n"))
    return g.select("event_type", F.array_join(F.col("ks").cast("array<string>"), ",").alias("ks"), "n")


@query("""SELECT event_id, name, CAST(json_extract_string(props, '$.' || name) AS INT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS name FROM events)""")
def jon17_map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,int>")).alias("name", "value"))


@query("""SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'""")
def jon03_left_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "o_orderkey")


@query("""SELECT n_name, c_custkey, s_suppkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 5000""")
def jon01_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return table(spark, sf_dir, "nation").join(c, "n_nationkey").join(s, "n_nationkey").select("n_name", "c_custkey", "s_suppkey")


@query("""SELECT c_nationkey, array_to_string(list_slice(list_sort(list_distinct(list(c_mktsegment || ':' || (c_custkey % 20)))), 1, 10), ',') AS tags FROM customer GROUP BY 1""")
def jon19_first_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").select("c_nationkey", F.concat_ws(":", "c_mktsegment", (F.col("c_custkey") % 20).cast("string")).alias("tag")).distinct()
    top = keys.top_n(one, ["c_nationkey"], [F.asc("tag")], 10)
    return top.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, event_id, ts, value FROM events) SELECT a.event_id, count(b.event_id) AS runs, max(b.value) AS best FROM d a JOIN d b ON a.user_id = b.user_id AND a.day = b.day AND b.ts <= a.ts WHERE a.event_type IS NULL OR true GROUP BY a.event_id""".replace(" WHERE a.event_type IS NULL OR true", ""))
def jon21_day_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each row's user did up to it on the same day: a running window instead of a join of all pairs."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("runs"), F.max("value").over(w).alias("best"))


@query("""WITH b AS (SELECT unnest(['blue', 'red', 'green', 'steel']) AS word, unnest([1, 1, 2, 2]) AS book), w AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part)
SELECT DISTINCT p_partkey, book FROM w JOIN b USING (word)""")
def jon22_playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = spark.createDataFrame([("blue", 1), ("red", 1), ("green", 2), ("steel", 2)], "word string, book int")
    w = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    return w.join(F.broadcast(books), "word").select("p_partkey", "book").distinct()


@query("""SELECT c_custkey, CASE WHEN n >= 12 THEN 'satisfied' ELSE c_mktsegment END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def jon23_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.countDistinct("o_orderdate").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(n, "c_custkey", "left").select("c_custkey", F.when(F.col("n") >= 12, "satisfied").otherwise(F.col("c_mktsegment")).alias("status"))


@query("""SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_type, user_id, ts::DATE AS day FROM events) GROUP BY 1""")
def set04_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").alias("day")).distinct().groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', count(*) FROM (SELECT k FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT * FROM b)""")
def set06_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    g = table(spark, sf_dir, "orders").filter(s.isin("O", "P")).groupBy("o_custkey").agg(F.bool_or(s == "O").alias("a"), F.bool_or(s == "P").alias("b"))
    one = g.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only"), F.count("*").alias("any"))
    return one.unpivot([], ["both", "only", "any"], "part", "n")


@query("""SELECT event_id AS id, ts, 'signup' AS kind FROM events WHERE event_type = 'signup' AND ts > TIMESTAMP '2024-01-25' UNION ALL SELECT event_id, ts, 'large' FROM events WHERE value > 95 AND ts > TIMESTAMP '2024-01-25'
UNION ALL SELECT event_id, ts, 'error' FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-25'""")
def ops06_since_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan: each row is told apart by the feeds that it belongs to."""
    e = table(spark, sf_dir, "events").filter("ts > TIMESTAMP_NTZ'2024-01-25'")
    kinds = F.array_compact(F.array(F.when(F.col("event_type") == "signup", "signup"), F.when(F.col("value") > 95, "large"), F.when(F.col("event_type") == "error", "error")))
    return e.select(F.col("event_id").alias("id"), "ts", F.explode(kinds).alias("kind"))


@query("""SELECT o_orderstatus AS state, count(*) AS n, min(o_orderdate) FILTER (o_orderpriority = '1-URGENT') AS oldest_urgent, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-07-01') AS last_day FROM orders GROUP BY 1""")
def ops01_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state"))
    return g.agg(F.count("*").alias("n"), F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).alias("oldest_urgent"), F.count_if(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp_ntz")).alias("last_day"))


@query("""SELECT o_orderpriority AS job_type, count(*) AS jobs, count(*) FILTER (o_orderstatus = 'O') AS queued, round(sum(greatest(o_totalprice - CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END, 0)), 2) AS reserved FROM orders GROUP BY 1""")
def ops02_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("job_type"))
    return g.agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "O").alias("queued"), F.round(F.sum(F.greatest(F.col("o_totalprice") - settled, F.lit(0.0))), 2).alias("reserved"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY place LIMIT 25""")
def ops_claimable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["o_orderpriority", "o_orderdate", "o_orderkey"]
    jobs = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O' and o_orderdate <= TIMESTAMP_NTZ'1998-01-01'").select(*order).orderBy(*order).limit(25)
    return jobs.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("""SELECT user_id, arg_max(event_type, ts) AS last_type, max(ts) AS last_ts, CASE WHEN max(ts) < TIMESTAMP '2024-01-29' THEN 'orphan' ELSE 'live' END AS state FROM events GROUP BY 1""")
def ops07_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("last_type"), F.max("ts").alias("last_ts"))
    return g.withColumn("state", F.when(F.col("last_ts") < F.lit("2024-01-29").cast("timestamp_ntz"), "orphan").otherwise("live"))


@query("""WITH a AS (SELECT event_id, user_id, ts, value, ts + CASE WHEN value > 50 THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END AS expires FROM events WHERE event_type = 'view')
SELECT user_id, count(*) AS atoms, count(*) FILTER (expires > TIMESTAMP '2024-01-30') AS current, max(expires) AS last_expiry FROM a GROUP BY 1""")
def ops08_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.when(F.col("value") > 50, 1).otherwise(7)
    a = table(spark, sf_dir, "events").filter("event_type = 'view'").withColumn("expires", F.col("ts") + F.make_dt_interval(days))
    return a.groupBy("user_id").agg(F.count("*").alias("atoms"), F.count_if(F.col("expires") > F.lit("2024-01-30").cast("timestamp_ntz")).alias("current"), F.max("expires").alias("last_expiry"))


@query("""SELECT min(event_id) FILTER (ts > TIMESTAMP '2024-01-15 12:00:00') AS any_next, arg_min(event_id, ts) FILTER (ts > TIMESTAMP '2024-01-15 12:00:00' AND event_type = 'signup') AS next_event,
  round((epoch_us(min(ts) FILTER (ts > TIMESTAMP '2024-01-15 12:00:00' AND event_type = 'signup')) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 60000000, 6) AS minutes FROM events""")
def ops12_countdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("ts > TIMESTAMP_NTZ'2024-01-15 12:00:00'")
    mine = F.when(F.col("event_type") == "signup", F.col("ts"))
    g = e.agg(F.min("event_id").alias("any_next"), F.min_by("event_id", mine).alias("next_event"), F.min(mine).alias("at")).withColumn("now", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return g.select("any_next", "next_event", F.round((micros("at") - micros("now")) / 60_000_000, 6).alias("minutes"))
