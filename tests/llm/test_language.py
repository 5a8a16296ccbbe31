"""The pipeline's language stage against planted texts in no language of the corpus."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaylight.llm import language

SF = "/root/testdata/sf0.001"
OTHERS = (
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
)
CODE = "function f(a,b){var q=new Map();for(let i=0;i<b.length;i++){q.set(b[i],a[i]||null);}return q.size>0?q:undefined;}\n" * 5


def test_language_stage_drops_planted_texts(spark):
    r = random.Random(3)
    soup = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (20, 80, 300)]
    key = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(800))]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = [*soup, *key, *OTHERS, CODE, "12345 --- 678", None]
    planted = spark.createDataFrame([(-1 - k, x, None, "planted", len(x or "")) for k, x in enumerate(bad)], "doc_id long, text string, lang string, source string, n_chars long")
    clean = {x["doc_id"]: x["lang"] for x in docs.collect()}
    kept = {x["doc_id"] for x in corpus_pipeline.language_stage(spark, docs.unionByName(planted.select(*docs.columns)), SF).collect()}
    assert {clean[d] for d in kept if d >= 0} == {"de", "en", "es", "fr"}
    assert kept == set(clean)


def test_many_languages(spark):
    """More languages than a small table has: each gets a codeword and is found again, also in rows not fitted on."""
    r = random.Random(8)
    made = {f"l{k:02d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 6))) for _ in range(40)] for k in range(90)}
    rows = [(90 * i + k, " ".join(r.choice(words) for _ in range(60)), name) for k, (name, words) in enumerate(made.items()) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs.filter(f"doc_id < {90 * 25}"))
    assert len(model.languages) == 90 and len({tuple(x) for x in model.code}) == 90
    got = language.predict_language(docs.filter(f"doc_id >= {90 * 25}"), model).join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert got > 0.95


def test_edges(spark):
    rows = [(1, None, "en"), (1, "", None), (2, "same words here", "en"), (2, "same words here", "en"), (3, "12 -- 3", "de"), (None, "ein langer Text " * 9000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("key", "share", "lang_pred", "score", "count")})
    model = language.fit_language(docs)
    got = sorted((x["doc_id"] or 0, x["lang_pred"]) for x in language.predict_language(docs, model).collect())
    assert got == [(0, "de"), (1, "und"), (1, "und"), (2, "en"), (2, "en"), (3, "und")]
    assert language.keep_known(docs, model).columns == docs.columns
    assert language.predict_language(docs.limit(0), model).count() == 0 and language.keep_known(docs.limit(0), model).count() == 0


def test_decoder_by_hand():
    """Losses of each codeword, bit by bit in plain Python, and the nearest one with its share."""
    rng = np.random.default_rng(3)
    code = language.codewords(7)
    bits = code.shape[1]
    weights = rng.normal(size=(language.CELLS + 1, bits)).astype(np.float32)
    trust = rng.random(bits) + 0.1
    none = np.zeros((7, language.CELLS + 1), np.float32)
    model = language.LanguageModel(tuple("abcdefg"), code, weights, rng.random(bits), rng.normal(size=bits), trust, none, np.zeros(7), np.zeros(7))
    texts = pa.array(["some words here", "é", "1 2", "", None, "Other WORDS " * 40])
    z = model.logits(texts)
    want = [[sum(trust[b] * np.log1p(np.exp(-code[c, b] * z[i, b])) for b in range(bits)) for c in range(7)] for i in range(len(texts))]
    assert np.allclose(model.losses(texts), want, rtol=1e-9)
    best, score, _ = model.decode(texts)
    for i, text in enumerate(texts.to_pylist()):
        if any(c.isalpha() for c in text or ""):
            assert best[i] == int(np.argmin(want[i]))
            assert score[i] == pytest.approx(1 / sum(np.exp(min(want[i]) - w) for w in want[i]))
        else:
            assert best[i] == -1 and score[i] == 0


def test_memory_of_many_languages():
    """The losses of a batch take texts times languages and texts times bits, never all three."""
    import tracemalloc

    code = language.codewords(300)
    bits = code.shape[1]
    model = language.LanguageModel(tuple(map(str, range(300))), code, np.ones((language.CELLS + 1, bits), np.float32), np.ones(bits), np.zeros(bits), np.ones(bits), np.zeros((300, 1), np.float32), np.zeros(300), np.zeros(300))
    texts = pa.array([f"text {i}" for i in range(5000)])
    tracemalloc.start()
    model.losses(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * 5000 * (300 + bits) * 8
