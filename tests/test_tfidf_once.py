"""Terms of one text alone are most of a corpus's; their weights are neither written nor fetched, and the scores stay."""

from __future__ import annotations

import pytest
from conftest import SMALL_SF_DIR, rows_of
from pyspark.sql import functions as F

from lodestone import queries as _registered  # noqa: F401
from lodestone import registry
from lodestone.operators import tfidf
from lodestone.queries import matching


@pytest.mark.parametrize("rows", [3000, 100])
def test_terms_of_one_text_are_not_written(spark, monkeypatch, rows):
    """With few weights broadcast, as vectors of references are (3000) or not (100)."""
    kept = {}

    def spied(df, label, stored=tfidf.stored):
        kept[label] = stored(df, label)
        return kept[label]

    query, same = registry.QUERIES["tfidf_confidence"], lambda df: rows_of(df.columns, df.collect())
    want = same(query(spark, SMALL_SF_DIR))
    monkeypatch.setattr(tfidf, "stored", spied)
    monkeypatch.setattr(matching, "stored", spied)
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", rows)
    assert same(query(spark, SMALL_SF_DIR)) == want
    terms = tfidf.Terms(tfidf.english_stop_words(), True)
    read = lambda name, key: tfidf.counts(spark.read.parquet(f"{SMALL_SF_DIR}/{name}.parquet"), key, "text", terms).select("term")
    df = read("documents", "doc_id").unionByName(read("benchmark", "item_id")).groupBy("term").agg(F.count("*").alias("df"))
    often = df.where("df > 1")
    assert kept["idf"].count() == often.count() < 0.5 * df.count()
    assert ("met" in kept) == (kept["vectors"].count() <= rows)
    if "met" in kept:
        far = kept["met"].select(F.explode("_far.term").alias("term"))
        single = far.join(often, "term", "left_anti").count()
        assert 0 < single < 0.2 * df.where("df = 1").count() and far.count() > single
