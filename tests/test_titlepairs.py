"""Pairs of texts are dealt out evenly, and left out only where they can't be alike."""

from __future__ import annotations

import difflib
import random

from pyspark.sql import functions as F

from lodestone.operators import titleindex


def test_pairs_that_meet_lie_in_all_parts(spark):
    texts = spark.range(60).select(F.concat(F.lit("largeringbrand"), "id").alias("c"))
    met = titleindex.similar(texts, texts.withColumnRenamed("c", "t"), 0.78, 2)
    sizes = [r[0] for r in met.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(sizes) == met.count() > 0


def test_letters_in_order_bound_the_similarity(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.choice((1, 2, 5, 20, 62, 63, 64, 80))))
    rows = [(word(), word()) for _ in range(300)]
    rows += [(a, a[: len(a) // 2] + "x" + a[len(a) // 2 + 1 :]) for a, _ in rows]
    pairs = spark.createDataFrame(rows, "a string, b string")
    got = sorted(tuple(r) for r in titleindex.alike(pairs, "a", "b", F.lit(0.6)).collect())
    scored = [(a, b, difflib.SequenceMatcher(None, a, b).ratio()) for a, b in rows]
    assert got == sorted(x for x in scored if x[2] >= 0.6)
