"""The stages of the corpus pipeline: filter, filter, deduplicate, deduplicate, pack.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents for all
stages but the last. Rows that a stage keeps hold their other columns; n_chars follows the text
where a stage changes it. Defined cases (nulls, repeated rows, empty tables) are those of the
operators; tests/llm/test_pipeline.py holds each stage and the whole against plain loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, packing, quality_cnn, quality_rules, repeats
from .common import stored, table
from .tokens import vocabulary

#: Documents that the classifier scores below this go; between this and 0.5 it is unsure.
REJECT_BELOW = 0.3


def _columns(names: list[str], changed: dict[str, Column]) -> list[Column]:
    return [changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in names]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train the byte network on the labelled documents and drop those that it rejects."""
    model = quality_cnn.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.score(docs, model).where(F.col("score") >= REJECT_BELOW)
    return scored.select(_columns(docs.columns, {"text": F.col("text")}))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or are depleted, and frequent lines from the others."""
    return quality_rules.filtered(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; rows without an id are no copies."""
    judged = minhash.near_duplicates(docs, percent=80).where("kept and doc_id is not null")
    kept = stored(judged.groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
    once, often = (kept.where(x).select("doc_id") for x in ("rows = 1", "rows > 1"))
    out = docs.join(once, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    if not often.isEmpty():
        out = out.unionByName(docs.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.select(docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 100 bytes or more that occur earlier in the corpus; a character that is cut goes whole."""
    got = repeats.repeated_spans(docs, as_text=True)
    cut = F.size("spans") > 0
    # a null text stays null: it has no spans
    text = F.when(cut | (F.col("n_bytes") > 0), F.col("kept"))
    n_chars = F.when(cut, F.length("kept").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else F.lit(None)
    return got.select(_columns(docs.columns, {"text": text, "n_chars": n_chars}))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of at most 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_quality_rules),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", remove_repeats),
    ("packing", pack_sequences),
]

#: Models and tokenizers can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
