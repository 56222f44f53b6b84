"""The corpus pipeline: each stage calls one operator of chronolens.llm on what the stage before it kept.

Every stage but the last returns the columns of documents (doc_id, text, lang, source, n_chars). Equal texts meet equal decisions, null texts count
as empty, and an empty table goes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolens.llm import bpe, language, mixing, near_dup, pii
from chronolens.llm.common import materialise
from chronolens.llm.queries import BYTE_BPE

#: Words a mix takes of each source are near weights 5, 2, 1 in turn of all; documents whose language is less sure than this go; entries of a worker's map
#: of encodings, few because executors have grown by the last stage.
WEIGHTS, SURE, CACHED = (5, 2, 1), 0.2, 150_000

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; lang is set where it is null. Texts without letters, and mixed ones without a main language, go."""
    model = language.fit(docs.where(~language.held_out()))
    found = language.identify(docs.select(*COLUMNS), model, spans=False)
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= SURE))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id."""
    return near_dup.deduplicate(docs.select(*COLUMNS), name="pipeline-near")


def remove_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced in the texts; n_chars is set anew where a text changed."""
    done = pii.sanitise(docs.select(*COLUMNS, F.xxhash64("text").alias("was")), name="pipeline-pii")
    changed = F.xxhash64("text") != F.col("was")
    return done.select("doc_id", "text", "lang", "source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; what it doesn't take goes, as do texts without words."""
    rows = docs.select(*COLUMNS, mixing.words_in("text").alias("words"), F.xxhash64("text").alias("h"))
    out = mixing.mix(rows, F.array("source"), F.col("words"), ["doc_id", "h"], weights=WEIGHTS, seed=7, name="pipeline-mix")
    times = F.col("taken").cast("double") / F.col("size")
    return out.where("taken > 0").select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("again")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and their bytes decoded again, as digests."""
    return bpe.digests(docs.select(*COLUMNS), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], cached=CACHED)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("private data", remove_private_data),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
