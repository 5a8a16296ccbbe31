"""Evidence as of a moment, and replays of it, over six of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.operators import pointintime
from quaylight.operators.pointintime import Adapter
from quaylight.plans.base import query, table

AS_OF, DAYS = "2001-06-01", 730
ADAPTERS = (
    Adapter("orders", "orders", ["o_orderkey"], "o_orderdate", ["o_orderdate + make_dt_interval(cast(o_orderkey % 5 AS int))"], ["o_orderstatus", "o_orderpriority", "o_custkey"], "concat('order ', o_orderkey)", {"customer": "o_custkey"},
            valid_to="if(o_orderstatus = 'F', o_orderdate + INTERVAL 30 DAYS, null)"),
    Adapter("shipments", "lineitem", ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_shipdate + make_dt_interval(l_linenumber)"], ["l_returnflag", "l_linestatus", "l_partkey"], "concat('part ', l_partkey)", {"part": "l_partkey", "supplier": "l_suppkey"},
            identity=["l_orderkey"], version="l_linenumber", revision_at="if(l_returnflag = 'R', l_shipdate + make_dt_interval(cast(l_orderkey % 90 AS int)), null)"),
    Adapter("clicks", "events", ["event_id"], "ts - INTERVAL 23 YEARS", [], ["event_type", "user_id"], "event_type", {"user": "user_id"}, where="event_type <> 'error'", ends_at="if(event_type = 'signup', ts - INTERVAL 23 YEARS + make_dt_interval(cast(event_id % 300 AS int)), null)"),
    Adapter("documents", "documents", ["doc_id"], "TIMESTAMP_NTZ '2000-06-01' + make_dt_interval(cast(doc_id % 500 AS int))", ["TIMESTAMP_NTZ '2000-06-01' + make_dt_interval(cast(doc_id % 500 + n_chars % 20 AS int))"], ["lang", "source", "n_chars"], "concat('text in ', lang)", {"source": "source"}, safe="lang <> 'de'"),
    Adapter("pages", "pages", ["page_id"], "TIMESTAMP_NTZ '2000-01-01' + make_dt_interval(cast(page_id % 600 AS int))", [], ["url"], "url"),
    Adapter("turns", "conversations", ["conv_id", "turn"], "TIMESTAMP_NTZ '2001-01-01' + make_dt_interval(cast(conv_id % 200 AS int))", [], ["conv_id", "turn", "role"], "role", valid_from="if(turn > 2, TIMESTAMP_NTZ '2001-01-01' + make_dt_interval(cast(conv_id % 200 + turn AS int)), null)"),
)

#: All evidence in the window, before any cutoff; the newest shipment of an order by then is the last of all.
EVERY_SQL = f"""raw AS (
  SELECT 'orders:' || o_orderkey AS ref, 'orders' AS family, o_orderdate AS event_at, o_orderdate + to_days((o_orderkey % 5)::INT) AS available_at, NULL::TIMESTAMP AS valid_from, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAYS END AS valid_to, NULL::TIMESTAMP AS revision_at, NULL::TIMESTAMP AS ends_at, true AS safe,
    'order ' || o_orderkey AS title, 'customer:' || o_custkey AS entities, '{{"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '","o_custkey":' || o_custkey || '}}' AS content, NULL::BIGINT AS thing, 0 AS version FROM orders
  UNION ALL SELECT 'shipments:' || l_orderkey || ':' || l_linenumber, 'shipments', l_shipdate, l_shipdate + to_days(l_linenumber::INT), NULL, NULL, CASE WHEN l_returnflag = 'R' THEN l_shipdate + to_days((l_orderkey % 90)::INT) END, NULL, true,
    'part ' || l_partkey, 'part:' || l_partkey || ',supplier:' || l_suppkey, '{{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '","l_partkey":' || l_partkey || '}}', l_orderkey, l_linenumber FROM lineitem
  UNION ALL SELECT 'clicks:' || event_id, 'clicks', ts - INTERVAL 23 YEARS, ts - INTERVAL 23 YEARS, NULL, NULL, NULL, CASE WHEN event_type = 'signup' THEN ts - INTERVAL 23 YEARS + to_days((event_id % 300)::INT) END, true,
    event_type, 'user:' || user_id, '{{"event_type":"' || event_type || '","user_id":' || user_id || '}}', NULL, 0 FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'documents:' || doc_id, 'documents', TIMESTAMP '2000-06-01' + to_days((doc_id % 500)::INT), TIMESTAMP '2000-06-01' + to_days((doc_id % 500 + n_chars % 20)::INT), NULL, NULL, NULL, NULL, lang <> 'de',
    'text in ' || lang, 'source:' || source, '{{"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}}', NULL, 0 FROM documents
  UNION ALL SELECT 'pages:' || page_id, 'pages', TIMESTAMP '2000-01-01' + to_days((page_id % 600)::INT), TIMESTAMP '2000-01-01' + to_days((page_id % 600)::INT), NULL, NULL, NULL, NULL, true, url, '', '{{"url":"' || url || '"}}', NULL, 0 FROM pages
  UNION ALL SELECT 'turns:' || conv_id || ':' || turn, 'turns', TIMESTAMP '2001-01-01' + to_days((conv_id % 200)::INT), TIMESTAMP '2001-01-01' + to_days((conv_id % 200)::INT), CASE WHEN turn > 2 THEN TIMESTAMP '2001-01-01' + to_days((conv_id % 200 + turn)::INT) END, NULL, NULL, NULL, true,
    role, '', '{{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}}', NULL, 0 FROM conversations),
inside AS (SELECT *, sha256(family || '|' || content) AS content_hash FROM raw WHERE event_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAYS),
every AS (SELECT * FROM inside QUALIFY thing IS NULL OR row_number() OVER (PARTITION BY thing ORDER BY event_at DESC, version DESC) = 1),
known AS (SELECT * FROM inside WHERE event_at <= TIMESTAMP '{AS_OF}' AND available_at <= TIMESTAMP '{AS_OF}' QUALIFY thing IS NULL OR row_number() OVER (PARTITION BY thing ORDER BY event_at DESC, version DESC) = 1),
decided AS (SELECT *, CASE WHEN NOT safe THEN 'integrity' WHEN event_at > TIMESTAMP '{AS_OF}' OR available_at > TIMESTAMP '{AS_OF}' THEN 'future' WHEN valid_from > TIMESTAMP '{AS_OF}' OR valid_to <= TIMESTAMP '{AS_OF}' THEN 'version'
  WHEN revision_at > TIMESTAMP '{AS_OF}' THEN 'revision' WHEN ends_at > TIMESTAMP '{AS_OF}' THEN 'reaction' END AS category FROM every)"""


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {a.table: table(spark, sf_dir, a.table) for a in ADAPTERS}


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a live run would see, with what a cutoff says of it."""
    return pointintime.admitted(pointintime.collect(_tables(spark, sf_dir), ADAPTERS, AS_OF, DAYS, replay=False), AS_OF)


@query(f"WITH {EVERY_SQL} SELECT ref, family, event_at, available_at, title, entities, content_hash FROM known")
def res01_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that was known of six tables at a moment, in one form."""
    found = pointintime.collect(_tables(spark, sf_dir), ADAPTERS, AS_OF, DAYS)
    return found.select("ref", "family", "event_at", "available_at", "title", F.array_join("entities", ",").alias("entities"), "content_hash")


@query(f"""WITH {EVERY_SQL}, newest AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY family ORDER BY event_at DESC, ref) <= 100)
SELECT ref, family, available_at FROM newest ORDER BY available_at DESC, ref DESC LIMIT 595""")
def res01_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's share of each family, the newest rows; the whole is cut to its limit."""
    return pointintime.collect(_tables(spark, sf_dir), ADAPTERS, AS_OF, DAYS, limit=595).select("ref", "family", "available_at")


@query(f"WITH {EVERY_SQL} SELECT ref, category, CASE category WHEN 'integrity' THEN 'point-in-time integrity cannot be established' WHEN 'future' THEN 'evidence became available after replay cutoff' WHEN 'version' THEN 'evidence version was not valid at replay cutoff' WHEN 'revision' THEN 'later revision has no usable vintage at replay cutoff' WHEN 'reaction' THEN 'reaction window extends beyond replay cutoff' END AS reason FROM decided")
def res11_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every(spark, sf_dir).select("ref", "category", "reason")


_PART_SQL = "sum(('0x' || substr(content_hash, {0}, 12))::BIGINT) FILTER (category IS NULL)"
_FINGERPRINT_SQL = "sha256(count(*) FILTER (category IS NULL) || '|' || " + " || '|' || ".join(f"coalesce({_PART_SQL.format(a)}, 0)::VARCHAR" for a in (1, 13, 25, 37)) + ")"


@query(f"""WITH {EVERY_SQL}, each AS (SELECT content_hash, arg_min(available_at, ref) AS available_at, arg_min(coalesce(category, '-'), ref) AS c, nullif(c, '-') AS category FROM decided GROUP BY content_hash)
SELECT count(*) AS considered, count(*) FILTER (category IS NULL) AS included, {", ".join(f"count(*) FILTER (category = '{c}') AS excluded_{c}" for c in pointintime.REASONS)},
  min(available_at) FILTER (category IS NULL) AS earliest, max(available_at) FILTER (category IS NULL) AS latest, {_FINGERPRINT_SQL} AS evidence_fingerprint FROM each""")
def res11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointintime.audit(_every(spark, sf_dir))


_CITED_SQL = f"""{EVERY_SQL}, cites AS (SELECT o_custkey AS c, 'orders:' || o_orderkey AS ref FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' UNION SELECT o_custkey, 'shipments:' || l_orderkey || ':' || l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '2001-01-01'),
verdicts AS (SELECT t.*, CASE WHEN d.ref IS NULL THEN 'unknown' ELSE d.category END AS category, d.available_at FROM cites t LEFT JOIN decided d ON d.ref = t.ref)"""
_REASON_SQL = "CASE category WHEN 'unknown' THEN 'unknown evidence' " + " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in pointintime.REASONS.items()) + " END"


def _lineage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cases and the reports made of them, what each is made from): reports of cases, cases of claims, claims of evidence."""
    orders = table(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '2001-01-01'")
    name = lambda kind, *c: F.concat_ws(":", F.lit(kind), *[F.col(x).cast("string") for x in c])
    case, claim = name("case", "o_custkey"), name("claim", "o_orderkey")
    shipped = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    clients = table(spark, sf_dir, "customer").join(orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")
    edges = [
        (name("report", "c_nationkey"), name("case", "c_custkey"), clients), (case, claim, orders), (claim, name("orders", "o_orderkey"), orders), (name("claim", "l_orderkey"), name("shipments", "l_orderkey", "l_linenumber"), shipped),
    ]
    made = edges[0][2].select(edges[0][0].alias("node"), edges[0][1].alias("parent"))
    for a, b, rows in edges[1:]:
        made = made.unionByName(rows.select(a.alias("node"), b.alias("parent")))
    outputs = orders.select(case.alias("output_id")).unionByName(clients.select(name("report", "c_nationkey").alias("output_id"))).distinct()
    return outputs, made


@query(f"""WITH {_CITED_SQL}, uses AS (SELECT 'case:' || c AS output_id, ref, category, 2 AS steps FROM verdicts UNION ALL SELECT 'report:' || c_nationkey, ref, category, 3 FROM verdicts JOIN customer ON c_custkey = c)
SELECT output_id, ref, {_REASON_SQL} AS reason, steps FROM uses WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY output_id ORDER BY ref) = 1""")
def res11_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and reports that rest on evidence that a replay mustn't know, each with the nearest such row."""
    outputs, made = _lineage(spark, sf_dir)
    return pointintime.leaks(outputs, made, _every(spark, sf_dir))[0]


@query(f"WITH {_CITED_SQL} SELECT DISTINCT ref, category, {_REASON_SQL} AS reason, available_at FROM verdicts WHERE category IS NOT NULL")
def res11_leaked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that such outputs use."""
    outputs, made = _lineage(spark, sf_dir)
    return pointintime.leaks(outputs, made, _every(spark, sf_dir))[1]


_RUN_SQL = "SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_at, max(o_orderpriority) AS priority FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01' AND o_orderdate + to_days((o_orderkey % 5)::INT) <= TIMESTAMP '{0}' AND o_orderkey % 7 <> {1} GROUP BY o_custkey"


@query(f"""WITH a AS ({_RUN_SQL.format("2001-03-01", 0)}), b AS ({_RUN_SQL.format("2001-06-01", 1)}), j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.o_custkey IS NULL AS na, b.o_custkey IS NULL AS nb, a.n <> b.n AS dn, a.last_at <> b.last_at AS dl, a.priority <> b.priority AS dp FROM a FULL JOIN b ON a.o_custkey = b.o_custkey)
SELECT o_custkey, CASE WHEN na THEN 'added' WHEN nb THEN 'removed' ELSE 'changed' END AS change, CASE WHEN NOT na AND NOT nb THEN array_to_string(list_filter([CASE WHEN dn THEN 'n' END, CASE WHEN dl THEN 'last_at' END, CASE WHEN dp THEN 'priority' END], lambda x: x IS NOT NULL), ',') END AS columns FROM j WHERE na OR nb OR dn OR dl OR dp""")
def res11_run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs at two cutoffs, each without a part of the orders: what one has and the other hasn't, and what differs."""

    def run(as_of: str, without: int) -> DataFrame:
        known = table(spark, sf_dir, "orders").filter(f"o_orderdate >= TIMESTAMP_NTZ '2000-06-01' AND o_orderdate + make_dt_interval(cast(o_orderkey % 5 AS int)) <= TIMESTAMP_NTZ '{as_of}' AND o_orderkey % 7 <> {without}")
        return known.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_at"), F.max("o_orderpriority").alias("priority"))

    found = pointintime.compare_runs(run("2001-03-01", 0), run("2001-06-01", 1), ["o_custkey"], ["n", "last_at", "priority"], ("orders", "orders"))
    return found.withColumn("columns", F.array_join("columns", ","))


@query("""SELECT o_custkey, date_trunc('month', o_orderdate) AS valid_from, o_orderkey, o_totalprice FROM (SELECT *, o_orderdate + to_days((o_orderkey % 90)::INT) AS recorded FROM orders) WHERE recorded <= TIMESTAMP '1999-06-01'
QUALIFY row_number() OVER (PARTITION BY o_custkey, valid_from ORDER BY recorded DESC, o_orderkey DESC) = 1""")
def res11_versions_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly figures that later records revise, as they were known at a moment."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.struct(F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 90 AS int))").alias("at"), "o_orderkey").alias("recorded"), "o_orderkey", "o_totalprice")
    known = rows.filter("recorded.at <= TIMESTAMP_NTZ '1999-06-01'").withColumn("recorded_at", F.col("recorded.at"))
    # records of one moment: the larger key is the later one
    last = known.groupBy("o_custkey", "valid_from", "valid_to", "recorded_at").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("v"))
    return pointintime.versions_at(last, ["o_custkey"], "recorded_at", "1999-06-01").select("o_custkey", "valid_from", "v.*")


_EVENT_NAMES = [*pointintime.MILESTONES, "noted", "closed"]
_RUNS_SQL = """runs AS (SELECT 'r' || r AS run_id, 'b' || (r % 2) AS benchmark, TIMESTAMP '1996-01-01' + to_days((r * 30)::INT) AS replay_as_of, 'v' || (r // 2 % 2) AS variant, CASE WHEN r % 3 > 0 THEN 'g' END AS comparison, CASE WHEN r % 7 = 0 THEN 'failed' WHEN r % 5 = 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM (SELECT DISTINCT o_orderkey % 60 AS r FROM orders)),
happened AS (SELECT 'r' || (o_orderkey % 60) AS run_id, CASE WHEN o_orderkey % 50 = 0 THEN '__episode__' ELSE 'c' || o_custkey END AS "case", [{0}][(o_orderkey // 60 % 8)::INT + 1] AS event, CASE WHEN o_orderkey % 11 = 0 THEN TIMESTAMP '1996-01-01' + to_days((o_orderkey % 60 * 30)::INT) ELSE o_orderdate END AS moment FROM orders)""".format(", ".join(f"'{x}'" for x in _EVENT_NAMES))


@query(f"""WITH {_RUNS_SQL}, a AS (SELECT * FROM runs WHERE run_id = 'r52'),
seen AS (SELECT h."case", [{", ".join(f"'{x}'" for x in pointintime.MILESTONES.values())}][list_position([{", ".join(f"'{x}'" for x in pointintime.MILESTONES)}], h.event)] AS milestone, h.moment, r.replay_as_of, a.replay_as_of AS until
  FROM happened h JOIN runs r ON r.run_id = h.run_id JOIN a ON a.benchmark = r.benchmark AND a.variant = r.variant AND a.comparison IS NOT DISTINCT FROM r.comparison WHERE r.replay_as_of <= a.replay_as_of AND r.status <> 'failed'),
each AS (SELECT "case", milestone, min(moment) AS first_at, count(DISTINCT replay_as_of) AS n, max(moment) AS last_at, max(until) AS until FROM seen WHERE milestone IS NOT NULL GROUP BY ALL),
cases AS (SELECT "case", milestone, first_at, coalesce(max(CASE WHEN milestone = 'first_candidate' THEN n END) OVER (PARTITION BY "case"), 0) AS observations, coalesce(max(CASE WHEN milestone = 'first_candidate' THEN last_at END) OVER (PARTITION BY "case") = until, false) AS survived FROM each)
SELECT * FROM cases WHERE "case" <> '__episode__' UNION ALL SELECT '__episode__', milestone, min(first_at), NULL, NULL FROM each GROUP BY milestone""")
def res11_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    r, begin = F.col("r"), F.lit("1996-01-01").cast("timestamp_ntz")
    after = lambda n: begin + F.make_dt_interval((n * 30).cast("int"))
    runs = orders.select((k % 60).alias("r")).distinct().select(
        F.concat(F.lit("r"), r).alias("run_id"), F.concat(F.lit("b"), r % 2).alias("benchmark"), after(r).alias("replay_as_of"), F.concat(F.lit("v"), F.floor(r / 2) % 2).alias("variant"), F.when(r % 3 > 0, "g").alias("comparison"),
        F.when(r % 7 == 0, "failed").when(r % 5 == 0, "completed_with_errors").otherwise("completed").alias("status"),
    )
    names = F.array(*[F.lit(x) for x in _EVENT_NAMES])
    events = orders.select(F.concat(F.lit("r"), k % 60).alias("run_id"), F.when(k % 50 == 0, pointintime.EPISODE).otherwise(F.concat(F.lit("c"), "o_custkey")).alias("case"), names[(F.floor(k / 60) % 8).cast("int")].alias("event"), F.when(k % 11 == 0, after(k % 60)).otherwise(F.col("o_orderdate")).alias("at"))
    return pointintime.milestones(runs, events, "r52")
