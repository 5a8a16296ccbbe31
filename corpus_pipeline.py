"""The corpus pipeline: language, quality, near duplicates, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.  Columns
besides ``doc_id``, ``text``, ``lang`` and ``n_chars`` pass through as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quaylight.llm import language, near_dedup, packing, repetition, substring_dedup
from quaylight.sources.scratch import Scratch

#: Words of a passage that must not occur twice in the corpus.
REPEAT_WINDOW = 50


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those without text or letters go, and so do code, noise and other languages."""
    return language.keep_known(docs, language.fit_language(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat themselves.

    A null, empty or blank text has too few words and goes, and so does a long one of which too much repeats.  Each row is
    judged on its own, so repeated rows and ids fare alike.
    """
    return repetition.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles and a similarity of 0.8.

    The least id of a group stays, so there are no ties; rows that share that id all stay.  A null, empty or blank text and
    a null id are in no group and stay.
    """
    return near_dedup.keep_one_of_each(docs, shingle_words=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur earlier.

    Earlier is by id, then by place in the text; rows of one id share places, so none of them loses what the others have.  A
    null text or id loses nothing.  ``n_chars`` follows the text.
    """
    return substring_dedup.remove_repeats(docs, window=REPEAT_WINDOW, length="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null or empty text is its end token alone.  Rows of one id are packed each on their own; a text longer than a sequence
    is cut.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1).drop("ids")


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: The classifier, the union of groups and the curve are beyond SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all ``documents``; what lies between two stages is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
