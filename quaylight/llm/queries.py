"""Queries over the driver's tables, one for each operator of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylight.llm import byte_bpe, chat, divergence, language, licenses, manifest, media, near_dedup, packing, repetition, simhash, substring_dedup, url_filter

#: What both turns of the added conversation say.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
URL_RULES = (
    url_filter.Rule("com/", "allow"),
    url_filter.Rule("example.com/en/", "block"),
    url_filter.Rule("www.example.com/en/", "allow"),
    url_filter.Rule("net/es/", "block"),
    url_filter.Rule("net/fr/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, sequence_tokens=2048).drop("ids")


def op2_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.fit_language(docs.filter(~held_out))
    return language.predict_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_verdicts(_table(spark, sf_dir, "documents"))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.chat_digests(chat.chat_windows(turns))


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op6_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit_urls(url_filter.labelled_urls(spark))
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), model, URL_RULES)


def op7_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(_table(spark, sf_dir, "documents"), window=20)


def op9_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_text_pictures(media.text_pictures(_table(spark, sf_dir, "documents")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.bpe_digests(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.dataset_manifest(_table(spark, sf_dir, "documents"), manifest.changed_third(), manifest.small_letters())


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"), least_docs=3, top_terms=200)


def op13_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprint_groups(_table(spark, sf_dir, "documents"), shingle_words=4, distance=4)


QUERIES = (
    op1_curve_packing, op2_language_codes, op3_suffix_repetition, op4_chat_windows, op5_superminhash, op6_url_model,
    op7_license_sentences, op8_anchor_dedup, op9_media_tiles, op10_byte_bpe,
    op11_merkle_manifest, op12_source_divergence, op13_gray_simhash,
)


#: Words of each document in order, the runs of ``size`` of them, and what is the same or earlier.
_WORDS_SQL = """words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i, len(ws) AS n FROM
  (SELECT doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
runs AS (SELECT doc_id, i, n, word, count(*) OVER w AS size, array_to_string(list(word) OVER w, ' ') AS run FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING))"""

OP5_SQL = f"""WITH RECURSIVE {_WORDS_SQL.format(text=f"translate(text, '{url_filter.UPPER}', '{url_filter.UPPER.lower()}')", last=2)},
sets AS (SELECT DISTINCT doc_id, run FROM runs WHERE size = 3 OR (n < 3 AND i = 0)), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id"""

OP8_SQL = f"""WITH {_WORDS_SQL.format(text="text", last=19)},
full_runs AS (SELECT doc_id, i, run FROM runs WHERE size = 20), firsts AS (SELECT run, min((doc_id, i)) AS place FROM full_runs GROUP BY run),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM full_runs JOIN firsts USING (run), (SELECT unnest(range(20)) AS k) WHERE (doc_id, i) > place),
left_over AS (SELECT w.doc_id, count(*) AS n, count(g.i) AS n_removed, sha256(coalesce(string_agg(w.word, ' ' ORDER BY w.i) FILTER (g.i IS NULL), '')) AS kept
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN left_over l ON l.doc_id = d.doc_id"""


#: Digest of a column's value in a leaf.
_FIELD_SQL = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF_SQL = "sha256(" + " || ".join(_FIELD_SQL.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"

#: The levels of trees whose leaves are in ``{leaves}``: ``tree, level, place, h, n``.
_RISE_SQL = """SELECT tree, 0 AS level, place, h, n FROM {leaves} UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, level, place // 8, n"""

OP11_SQL = f"""WITH RECURSIVE poly AS (SELECT list(v ORDER BY i) AS remainders FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) t(i))),
digits AS (SELECT doc_id, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT) AS codes FROM documents),
sums AS (SELECT doc_id, xor(list_reduce(codes, lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM digits, poly),
rows_ AS (SELECT doc_id, lang AS tree, {_LEAF_SQL.format(text=_FIELD_SQL.format("text"))} AS h,
  CASE WHEN crc % 3 = 0 THEN {_LEAF_SQL.format(text=_FIELD_SQL.format(f"translate(text, '{url_filter.UPPER}', '{url_filter.UPPER.lower()}')"))} END AS changed FROM documents JOIN sums USING (doc_id)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
up AS ({_RISE_SQL.format(leaves="leaves", name="up")}),
trees AS (SELECT tree AS lang, level AS top, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS n, 'all' AS tree FROM up WHERE n = 1),
over AS ({_RISE_SQL.format(leaves="trees", name="over")}),
nodes AS (SELECT tree AS lang, level, place, place // 8 AS run, h FROM up WHERE n > 1
  UNION ALL SELECT t.lang, t.top + o.level, o.place, o.place // 8, o.h FROM trees t JOIN over o ON o.n > 1),
fold AS (SELECT l.doc_id, l.tree AS lang, 0 AS level, l.place, coalesce(l.changed, l.h) AS h, '' AS others FROM leaves l
  UNION ALL SELECT f.doc_id, f.lang, f.level + 1, any_value(CASE WHEN f.level + 1 = t.top THEN t.place ELSE f.place // 8 END),
    sha256(string_agg(CASE WHEN n.place = f.place THEN f.h ELSE n.h END, '' ORDER BY n.place)),
    any_value(f.others) || coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place <> f.place), '')
  FROM (SELECT f.*, CASE WHEN f.level = 0 AND t.top = 0 THEN t.place ELSE f.place END AS at FROM fold f JOIN trees t ON t.lang IS NOT DISTINCT FROM f.lang) f
  JOIN trees t ON t.lang IS NOT DISTINCT FROM f.lang JOIN nodes n ON n.lang IS NOT DISTINCT FROM f.lang AND n.level = f.level AND n.run = f.at // 8
  GROUP BY f.doc_id, f.lang, f.level),
ends AS (SELECT doc_id, arg_max(h, level) AS folded, arg_max(others, level) AS others FROM fold GROUP BY doc_id)
SELECT l.doc_id, l.h AS leaf, t.h AS subroot, r.h AS root, sha256(e.others) AS proof_sha256, e.folded AS folded_root, e.folded = r.h AS verified
FROM leaves l JOIN trees t ON t.lang IS NOT DISTINCT FROM l.tree JOIN ends e ON e.doc_id = l.doc_id, (SELECT h FROM over WHERE n = 1) r"""

OP12_SQL = f"""WITH texts AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS doc FROM documents),
words AS (SELECT lang, source, doc, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{url_filter.UPPER}', '{url_filter.UPPER.lower()}') AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang),
groups_ AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS size FROM (SELECT DISTINCT lang, source FROM texts) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + {divergence.UNIT} * (coalesce(c.n, 0) + 1) // (g.size + l.v))::BIGINT AS p, (1 + {divergence.UNIT} * (k.n + 1) // (l.size + l.v))::BIGINT AS whole
  FROM groups_ g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - whole) * (p - whole) // whole)::BIGINT AS value FROM shares WHERE n > 0 AND p > whole),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_superminhash": OP5_SQL, "op7_license_sentences": licenses.scan_sql(), "op8_anchor_dedup": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_source_divergence": OP12_SQL}
