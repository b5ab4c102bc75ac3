"""Titles inside names: containment joins, verdicts, fuzzy matches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import name_words, norm_title
from ..storage import stored


#: Up to this many titles are broadcast (about 100 bytes each); beyond it, they are joined by a shuffle.
BROADCAST_TITLES = 500_000


def contained(names: DataFrame, key: str, name: str, titles: DataFrame, code: str, title: str, least: int = 8, own: str | None = None, own_least: int = 4) -> DataFrame:
    """key, code, title words and position of each title that a name contains as whole words.

    Titles have `least` characters; the one that a name is kept under (`own`, a code) needs `own_least`. A title is
    looked for where its longest word is: names' distinct words, without the names, meet titles by that word, and
    what they meet is gathered for each name, which then is searched for it in its own row.
    """
    t = titles.select(code, F.trim(name_words(F.col(title))).alias("words")).where(F.length("words") >= (least if own is None else min(least, own_least))).distinct()
    longest = F.array_max(F.transform(F.split("words", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    t = t.withColumn("word", longest)
    # names are dealt out by key once: what they meet is gathered, and met by its name, without another shuffle
    n = names.select(key, *([own] if own else []), name).repartition(F.col(key)).select(key, *([own] if own else []), name_words(F.col(name)).alias("text"))
    words = n.select(key, *([F.col(own).alias("_own")] if own else []), F.explode(F.array_distinct(F.split(F.trim("text"), " "))).alias("word"))
    met = words.join(F.broadcast(t) if t.count() <= BROADCAST_TITLES else t, "word")
    if own is not None:
        met = met.where((F.length("words") >= least) | ((F.col(code) == F.col("_own")) & (F.length("words") >= own_least)))
    some = met.groupBy(key).agg(F.collect_set(F.struct(code, "words")).alias("_met"))
    at = lambda c: F.instr(F.col("text"), F.concat(F.lit(" "), c["words"], F.lit(" "))).cast("long")
    found = F.filter(F.transform("_met", lambda c: F.struct(c[code].alias(code), c["words"].alias("words"), at(c).alias("at"))), lambda c: c["at"] > 0)
    return n.join(some, key).select(key, F.explode(found).alias("_hit")).select(key, f"_hit.{code}", "_hit.words", "_hit.at")


def outermost(hits: DataFrame, key: str, code: str) -> DataFrame:
    """Hits that don't lie inside a longer title of the same name."""
    longer = hits.select(key, F.col("words").alias("long")).distinct()
    inside = F.concat(F.lit(" "), "long", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("words"), F.lit(" "))) & (F.length("long") > F.length("words"))
    nested = hits.join(longer, key).where(inside).select(key, code, "words").distinct()
    return hits.join(nested, [key, code, "words"], "left_anti")


def verdict(hits: DataFrame, names: DataFrame, key: str, code: str, own: str) -> DataFrame:
    """match, other or null for each name: does its longest title belong to the code it is kept under?"""
    best = hits.groupBy(key).agg(F.max_by(F.struct(code, "words"), F.struct(F.length("words"), "words", code)).alias("x"))
    mine = hits.join(names.select(key, own), key).where(F.col(code) == F.col(own)).select(key, F.lit(True).alias("mine"), F.col("words").alias("own_words")).distinct()
    rows = names.select(key, own).join(best, key, "left").join(mine, key, "left")
    # an own title counts unless it is only a part of a longer one
    swallowed = (F.length("x.words") > F.length("own_words")) & F.col("x.words").contains(F.col("own_words"))
    return rows.select(key, F.when(F.col("x").isNull(), None).when(F.col("mine") & ~swallowed, "match").otherwise("other").alias("verdict"))


def _ratio(a: str, b: str) -> float:
    m = difflib.SequenceMatcher(None, a, b)
    return m.ratio() if min(m.real_quick_ratio(), m.quick_ratio()) > 0 else 0.0


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching characters of two strings; the order of arguments counts."""
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def titles_match(a: Column, b: Column, least: float = 0.75) -> Column:
    x, y = norm_title(a), norm_title(b)
    some = (x != "") & (y != "")
    return some & (x.contains(y) | y.contains(x) | (similarity(x, y) >= least))


def fuzzy_pairs(left: DataFrame, right: DataFrame, key: str, ref: str, least: float = 0.85) -> DataFrame:
    """Pairs (key, ref, score) of titles (`norm`) with a similarity of `least` or more.

    A similarity s of lengths x and y allows e = (1 - s) * (x + y) single letters to be put in or left
    out, and each breaks two letter pairs at most: titles meet on letter pairs, and only pairs of
    titles with near lengths and no more missing letter pairs than 2 * e are compared. Empty titles
    match nothing.
    """

    def blocks(d: DataFrame, name: str) -> DataFrame:
        n = F.length("norm")
        grams = F.when(n < 2, F.array("norm")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(F.col("norm"), i, F.lit(2))))
        d = d.where("norm != ''").select(name, F.col("norm").alias(f"{name}_norm"), F.array_distinct(grams).alias("grams"))
        return d.select(name, f"{name}_norm", F.size("grams").alias(f"{name}_n"), F.explode("grams").alias("gram"))

    a, b = blocks(left, key), blocks(right, ref)
    x, y = F.length(f"{key}_norm"), F.length(f"{ref}_norm")
    met = a.join(b, "gram").where(2 * F.least(x, y) >= least * (x + y)).groupBy(key, ref, f"{key}_norm", f"{ref}_norm", f"{key}_n", f"{ref}_n").agg(F.count("*").alias("shared"))
    edits = F.floor((1 - least) * (x + y) + 1e-9)
    met = met.where(F.col("shared") >= F.greatest(f"{key}_n", f"{ref}_n") - 2 * edits)
    return met.select(key, ref, similarity(F.col(f"{key}_norm"), F.col(f"{ref}_norm")).alias("score")).where(F.col("score") >= least)


def greedy_pairs(pairs: DataFrame, group: str, key: str, ref: str) -> DataFrame:
    """One to one assignment within each group, best score first, ties by key and ref.

    In rounds: a pair that is the best one left both for its key and for its ref is what the greedy order takes before
    any other pair of either; all such pairs are taken at once, theirs are left out, until no pair is left. A
    round takes the best pair of each group at least, and each is two aggregates and two joins, whatever the size of a group.
    """
    left = stored(pairs.select(group, key, ref, "score").distinct(), "pairs")
    taken = left.limit(0)
    order = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.col(ref).alias("r"))
    while not left.isEmpty():
        ranked = left.withColumn("_o", order)
        best = ranked.groupBy(group, key).agg(F.min("_o").alias("_a"))
        other = ranked.groupBy(F.col(group).alias("_g"), ref).agg(F.min("_o").alias("_b"))
        both = best.join(other, [F.col("_a") == F.col("_b"), F.col(group).eqNullSafe(F.col("_g"))])
        now = stored(both.select(group, F.col("_a.k").alias(key), F.col("_a.r").alias(ref), (-F.col("_a.s")).alias("score")), "taken")
        taken = taken.unionByName(now)
        free = left.join(now.select(F.col(group).alias("_g"), F.col(key).alias("_k")), F.col(group).eqNullSafe(F.col("_g")) & (F.col(key) == F.col("_k")), "left_anti")
        left = stored(free.join(now.select(F.col(group).alias("_g"), F.col(ref).alias("_r")), F.col(group).eqNullSafe(F.col("_g")) & (F.col(ref) == F.col("_r")), "left_anti"), "pairs")
    return taken


def unique_code(scored: DataFrame, key: str, ref: str, sure: float = 0.92) -> DataFrame:
    """The only reference with an equal title, else the only one at `sure` or more; null if several."""
    exact, near = F.col("score") == 1.0, F.col("score") >= sure
    rows = scored.groupBy(key).agg(F.count_if(exact).alias("e"), F.max(F.when(exact, F.col(ref))).alias("er"), F.count_if(near).alias("n"), F.max(F.when(near, F.col(ref))).alias("nr"))
    return rows.select(key, F.when(F.col("e") == 1, F.col("er")).when((F.col("e") == 0) & (F.col("n") == 1), F.col("nr")).alias(ref))
