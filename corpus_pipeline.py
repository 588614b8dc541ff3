"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.

Defined results of all stages: null and blank texts are rejected by the first
stage (they have no letter), which replaces every language; null ids and sources are kept; rows equal
in id and text are one document after the second stage; extra columns are carried;
an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termgrid.llm import bpe, jaccard, language, mixing, surrogates
from termgrid.llm.common import text_key
from termgrid.llm.queries import SURROGATE_KEY, VOCABULARY
from termgrid.sources.scratch import materialize

NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognisable language go; the language of the others is the recognised one."""
    found = language.predict(docs, language.fit(language.learnable(docs)))
    known = found.where(F.col("lang_pred") != language.UNKNOWN)
    return known.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", text_key())
    keyed = docs.withColumn("_row", row)
    groups = jaccard.jaccard_components(keyed, "_row", n=NEAR_WORDS, percent=NEAR_PERCENT).select(
        F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    ids = keyed.select("_row", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    stays = groups.distinct().join(ids, "_row").groupBy("_group").agg(first.alias("first")).select("first._row")
    return keyed.join(stays, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; the length follows the text."""
    found = surrogates.replace_entities(docs, SURROGATE_KEY)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives the text back."""
    encoded = bpe.encode(docs, public_tokenizers.path(VOCABULARY), exact=True)
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

ORACLE_SQL = None  # SQL can't express the language models


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
