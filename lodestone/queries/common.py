"""Helpers that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import tfidf
from ..storage import scratch, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STOP_SQL = ", ".join("'" + w.replace("'", "'" * 2) + "'" for w in tfidf.english_stop_words())


def terms_sql(name: str, key: str, source: str, stop: bool = False, bigrams: bool = False) -> str:
    """Words between characters that no word has, apostrophes at either end left out; then pairs of neighbours."""
    base = rf"""{name}0 AS (SELECT {key}, list_filter(list_transform(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}_'']+'), lambda x: trim(x, chr(39))), lambda x: regexp_matches(x, '^[a-z][a-z'']+$')) AS w FROM {source}),
 {name}1 AS (SELECT {key}, {f"list_filter(w, lambda x: x NOT IN ({STOP_SQL}))" if stop else "w"} AS w FROM {name}0)"""
    terms = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))" if bigrams else "w"
    return base + f", {name} AS (SELECT {key}, unnest({terms}) AS term FROM {name}1)"
