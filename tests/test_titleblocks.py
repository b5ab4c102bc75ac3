"""Titles made of few words: most texts share letter pairs with most titles, and only pairs that could be alike become rows."""

from __future__ import annotations

import difflib
from itertools import product

import pytest

from lodestone.operators import titleindex


@pytest.mark.parametrize("block", [1000, 7])
def test_only_pairs_with_enough_letters_in_order_are_proposed(spark, monkeypatch, block):
    monkeypatch.setattr(titleindex, "BLOCK", block)
    titles = ["".join(w) for w in product(("large", "hot", "blue", "old"), ("ring", "bolt", "plate"), ("promo", "small"), ("brand1", "brand17", "brand23"))]
    texts = sorted({t.replace("o", "0") for t in titles} | {t[4:] for t in titles})
    c, t = spark.createDataFrame([(x,) for x in texts], "c string"), spark.createDataFrame([(x,) for x in titles], "t string")
    got = [tuple(x) for x in titleindex.similar(c, t, 0.78, 2).collect()]
    near = {(a, b) for a in texts for b in titles if abs(len(b) - len(a)) <= max(4, len(b) // 2) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.78}
    assert near <= set(got) and len(got) == len(set(got)) < 1.2 * len(near) < 0.2 * len(texts) * len(titles)
