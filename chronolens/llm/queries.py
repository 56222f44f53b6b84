"""One query for each operator of this package, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, language, lm, media, mixing, near_dup, pii, token_counts, topk

#: Tokenizer files by parameter; never copied into the repository.
BYTE_BPE, PIECE_BPE = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as an 8-bit WAV, identified by its signatures and read back."""
    return media.text_digests(documents(spark, sf_dir), keep=["doc_id"])


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of each fiftieth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256, name="op2")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text, and the terms that give it away."""
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"], name="op3")
    spans = F.col("spans")
    counts = [F.size(pii.of_kind(spans, [k])).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(pii.of_kind(spans, pii.KINDS)), 256).alias("base_sha256"), pii.joined(spans).alias("spans"), F.size(pii.of_kind(spans, pii.PROTECTED)).cast("long").alias("n_private"), F.size(pii.of_kind(spans, ["generalised", "removed"])).cast("long").alias("n_terms"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and bytes of every whole text, as digests."""
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, keep=["doc_id"])


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), keep=["page_id", "url"])


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that aren't held out."""
    docs = documents(spark, sf_dir)
    out = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    model = language.fit(docs.where(~language.held_out()))
    return language.identify(out, model, spans=False, keep=["doc_id", "held_out"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(PIECE_BPE), limit=4096, keep=["doc_id"])


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every whole text."""
    return lm.score(documents(spark, sf_dir).select("doc_id", "text"), name="op8")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.classes(documents(spark, sf_dir), name="op9")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed, each in its one source, to weights 5, 2, 1 in turn."""
    docs = documents(spark, sf_dir).select("doc_id", "source", mixing.words_in("text").alias("words"), F.xxhash64("text").alias("h"))
    out = mixing.mix(docs, F.array("source"), F.col("words"), ["doc_id", "h"], weights=(5, 2, 1), seed=7, name="op10")
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media, op2_top_k, op3_pii, op4_byte_bpe, op5_html_text, op6_language, op7_token_counts, op8_lm_scores, op9_near_duplicates, op10_mixing)}

ORACLES: dict[str, str] = {
    "op2_top_k": """
        WITH whole AS (
            SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.row_id AS q_row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.row_id <> c.row_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id) AS place FROM scored
        )
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
    """,
}
