"""Texts stay dealt out by key while they meet references: no pair of both is shuffled."""

from __future__ import annotations

import pytest
from conftest import SMALL_SF_DIR
from pyspark.sql import functions as F

from lodestone import queries as _registered  # noqa: F401
from lodestone import registry
from lodestone.operators import tfidf
from lodestone.storage import stored


@pytest.mark.parametrize("name", ["tfidf_bigrams", "tfidf_top2_whole", "tfidf_maxdf_stopwords", "tfidf_confidence_whole"])
def test_pairs_with_references_are_not_shuffled(spark, name):
    rows = registry.QUERIES[name](spark, SMALL_SF_DIR)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("item_id" in line and "doc_id" in line for line in exchanges)


def test_pairs_are_no_rows_until_they_are_summed(spark):
    """Products of terms are summed where a text lies, and its words are looked for once, after texts are dealt out."""
    plan = registry.QUERIES["tfidf_bigrams"](spark, SMALL_SF_DIR)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert not any("Aggregate" in line and "doc_id" in line and "item_id" in line for line in lines)
    dealt = next(i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line)
    assert not any("regexp" in line or "Python" in line for line in lines[dealt:])


@pytest.mark.parametrize("joined", [False, True])
def test_rare_terms_count_for_the_length(spark, monkeypatch, joined):
    """With few weights broadcast, those of rare terms are fetched, and the scores stay."""
    texts = spark.createDataFrame([(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + (i * j) % 26)}" for j in range(3 + i % 40))) for i in range(60)] + [(7, "waa own words"), (99, None)], "k int, text string")
    refs = texts.where("k % 10 = 0").select(F.col("k").alias("r"), "text")
    weights = tfidf.Weights(stored(tfidf.fit(tfidf.counts(texts, "k").select("term"), texts.agg(F.count("*").alias("n")), 0.6).idf, "idf"))
    vectors = stored(weights.vectors(tfidf.counts(refs, "r"), "r"), "vectors")
    got = lambda: {(x["k"], x["r"]): round(x["score"], 9) for x in tfidf.scores(texts, weights, vectors, "k", "r").collect()}
    want = got()
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", 5 if joined else vectors.count())
    assert len(want) > 50 and weights.idf.count() > vectors.count() and got() == want
