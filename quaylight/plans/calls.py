"""Calls: links to transcripts, turns and segments, made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.operators import transcripts
from quaylight.plans.base import query, table

_TITLES = ("Earnings call Q{} transcript", "Press release on earnings", "Conference call", "About us", "Share this transcript", "", "Annual financial results 2023", "Press release")
_LINKS = ("/calls/{}", "https://other.example/{}?a=1", "call-{}.html", "http://plain.example/{}", "#top-{}", "//cdn.example/transcript/{}", "/calls/{}#part", "mailto:x{}@example.com")
_TITLE_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN " + f"'{t}'".replace("{}", "' || (o_orderkey % 4 + 1) || '") for k, t in enumerate(_TITLES)) + " END"
_URLS = ("https://ir.example/calls/{}", "https://other.example/{}?a=1", "https://ir.example/n/call-{}.html", None, None, "https://cdn.example/transcript/{}", "https://ir.example/calls/{}#part", None)
_URL_SQL = "CASE o_orderkey % 80 // 10 " + " ".join(f"WHEN {k} THEN " + ("NULL" if u is None else f"'{u}'".replace("{}", "' || (o_orderkey // 2) || '")) for k, u in enumerate(_URLS)) + " END"


@query(f"""WITH a AS (SELECT o_custkey AS page_id, o_orderkey AS i, {_URL_SQL} AS url, {_TITLE_SQL} AS shown FROM orders), b AS (SELECT *, regexp_replace(url, '#.*$', '') AS address FROM a WHERE url IS NOT NULL),
f AS (SELECT page_id, i, url, CASE WHEN shown = '' THEN url ELSE shown END AS title FROM b QUALIFY row_number() OVER (PARTITION BY page_id, address ORDER BY i) = 1),
s AS (SELECT *, lower(url || ' ' || title) AS x FROM f WHERE NOT starts_with(lower(title), 'share ')), h AS (SELECT *, contains(x, 'transcript')::INT + contains(x, 'earnings call')::INT + contains(x, 'conference call')::INT AS hits, contains(x, 'earnings') OR contains(x, 'financial results') AS around FROM s),
c AS (SELECT *, CASE WHEN hits = 0 AND (contains(x, 'press release') OR NOT around) THEN 0 ELSE 2 * hits + CASE WHEN around THEN 2 ELSE 0 END + regexp_matches(x, '\\b(q[1-4]|fy\\s*\\d{{2,4}}|[12]\\d{{3}})\\b')::INT END AS score FROM h)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, i) AS place, url, title, score FROM c WHERE score > 0 QUALIFY place <= 5""")
def src17_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of links for each customer, in the order of the orders."""
    k = F.col("o_orderkey")
    pick = lambda forms, of, n: F.element_at(F.array(*[F.concat(*[x for part in f.split("{}") for x in (F.lit(part), n.cast("string"))][:-1]) for f in forms]), (of + 1).cast("int"))
    title, href = pick(_TITLES, k % 8, k % 4 + 1), pick(_LINKS, F.floor(k % 80 / 10), F.floor(k / 2))
    anchor = F.concat(F.lit("<li><A class='x' href=\""), href, F.lit('"> <b>'), title, F.lit("</b></A></li>"))
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", anchor.alias("a")))).alias("all"))
    pages = pages.select("page_id", F.lit("https://ir.example/n/events.html?x=1").alias("url"), F.concat(F.lit("<html><ul>"), F.array_join("all.a", "\n"), F.lit("</ul></html>")).alias("html"))
    return transcripts.transcript_links(pages, most=5)


_NAME_SQL = "CASE role WHEN 'user' THEN 'Ann B. Analyst' WHEN 'assistant' THEN 'Operator' ELSE 'note' END"
_TALK_SQL = f"""talk AS (SELECT conv_id, string_agg(CASE WHEN turn = 2 AND conv_id % 2 = 0 THEN 'Questions and Answers Session:' || chr(10) ELSE '' END || CASE WHEN turn % 5 = 4 THEN '' ELSE {_NAME_SQL} || ': ' END || coalesce(text, '') || CASE WHEN conv_id % 3 = 0 THEN chr(10) ELSE '' END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: two speakers, a label that is none, turns without a label, a heading in every other one."""
    name = F.when(F.col("role") == "user", "Ann B. Analyst").when(F.col("role") == "assistant", "Operator").otherwise("note")
    line = F.concat(
        F.when((F.col("turn") == 2) & (F.col("conv_id") % 2 == 0), "Questions and Answers Session:\n").otherwise(""), F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat(name, F.lit(": "))),
        F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 3 == 0, "\n").otherwise(""),
    )
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("all"))
    return turns.select("conv_id", F.array_join("all.line", "\n").alias("text"))


_SPEAKER_SQL = transcripts.SPEAKER.replace("'", "''")
_QUESTIONS_SQL = transcripts.QUESTIONS.replace("'", "''")
_NONE_SQL = ", ".join(f"'{x}'" for x in transcripts.NO_SPEAKERS)


@query(f"""WITH {_TALK_SQL}, l AS (SELECT conv_id, unnest(range(len(ls))) AS i, trim(regexp_replace(unnest(ls), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS line FROM (SELECT conv_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS ls FROM talk)),
m AS (SELECT *, trim(regexp_extract(line, '{_SPEAKER_SQL}', 1)) AS name, regexp_matches(line, '{_QUESTIONS_SQL}') AS heading FROM l WHERE line <> ''),
b AS (SELECT *, CASE WHEN name <> '' AND regexp_replace(lower(name), '[.:]+$', '') NOT IN ({_NONE_SQL}) THEN name END AS begins FROM m),
t AS (SELECT *, count(begins) OVER w AS turn, bool_or(heading) OVER w AS after FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
n AS (SELECT conv_id, turn, max(begins) AS own, CASE WHEN arg_min(after, i) THEN 'qa' ELSE 'opening' END AS part, string_agg(CASE WHEN begins IS NULL THEN line ELSE trim(regexp_extract(line, '{_SPEAKER_SQL}', 2)) END, ' ' ORDER BY i) AS said, count(*) AS n_lines FROM t WHERE NOT heading GROUP BY conv_id, turn),
o AS (SELECT conv_id, turn, own AS speaker, part, trim(said) AS said, n_lines FROM n)
SELECT conv_id, turn, speaker, part, sha256(said) AS said, n_lines FROM o WHERE conv_id IN (SELECT conv_id FROM o GROUP BY conv_id HAVING count(DISTINCT speaker) >= 2)""")
def src17_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.transcript_turns(_talks(spark, sf_dir), "conv_id").withColumn("said", F.sha2("said", 256))


#: Words of the invented prose in place of those of business.
WORDS = ("the", "de", "risk", "data", "que", "margin", "time")
_COUNT_SQL = " + ".join(f"len(regexp_extract_all(' ' || regexp_replace(lower(excerpt), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') || ' ', '[^\\p{{L}}\\p{{N}}_]{w}[^\\p{{L}}\\p{{N}}_]'))" for w in WORDS)


@query(f"""WITH RECURSIVE bare AS (SELECT doc_id, regexp_replace(text, '^[ \\t\\r\\n\\f\\v]+|[ \\t\\r\\n\\f\\v]+$', '', 'g') AS t FROM documents), long_ AS (SELECT doc_id, t, length(t) AS n FROM bare WHERE t <> ''),
head_ AS (SELECT doc_id, t, n, left(t, 1500) AS h FROM long_), opened AS (SELECT doc_id, t, n, CASE WHEN n <= 1500 THEN n
  WHEN contains(substr(h, 2), chr(10) || chr(10)) THEN 1500 - strpos(reverse(h), chr(10) || chr(10)) + 1 WHEN contains(substr(h, 2), chr(10)) THEN 1500 - strpos(reverse(h), chr(10)) + 1 ELSE 1500 END AS e FROM head_),
w(doc_id, t, n, s, e) AS (SELECT doc_id, t, n, 0, e FROM opened UNION ALL SELECT doc_id, t, n, e, CASE WHEN e + 1500 >= n THEN n WHEN contains(substr(t, e + 2, 1499), chr(10)) THEN e + 1500 - strpos(reverse(substr(t, e + 1, 1500)), chr(10)) + 1 ELSE e + 1500 END FROM w WHERE e < n),
x AS (SELECT doc_id, CASE WHEN s = 0 THEN 'opening' ELSE 'body' END AS kind, s AS start, e AS "end", substr(t, s + 1, e - s) AS excerpt FROM w), y AS (SELECT *, {_COUNT_SQL} AS signal FROM x)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY kind <> 'opening', CASE WHEN kind = 'opening' THEN 0 ELSE -signal END, start) AS place, kind, start, "end", signal, doc_id || ':' || kind || ':' || start || ':' || "end" AS segment_id, sha256(excerpt) AS excerpt FROM y QUALIFY place <= 8""")
def res15_best_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each whole document its opening and the windows with most of some words."""
    return transcripts.segments(table(spark, sf_dir, "documents"), words=WORDS).withColumn("excerpt", F.sha2("excerpt", 256))
