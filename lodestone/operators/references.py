"""Reference texts: which to trust, and checks of doubtful ones by the dialogue of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import tfidf


def low_trust(crowd_sourced: Column, numbering_conflict: Column, title_verified: Column) -> Column:
    """A crowd-sourced text whose number is in conflict; where that isn't known, one whose title isn't verified."""
    return crowd_sourced & F.coalesce(numbering_conflict, ~F.coalesce(title_verified, F.lit(True)))


def describe_conflict(code: Column, number: Column, title: Column, title_code: Column, own_title: Column) -> Column:
    """Why a crowd-sourced reference for `code` isn't trusted: its number, or its title, says otherwise."""
    title = F.coalesce(F.when(title != "", title), F.lit("?"))
    quoted = F.concat(F.lit("'"), title, F.lit("'"))
    elsewhere = F.concat(F.lit("the source files it under "), number, F.lit(" "), quoted)
    here = F.concat(F.lit("the source calls "), code, F.lit(" "), quoted, F.coalesce(F.concat(F.lit(" but the catalogue calls it '"), F.when(own_title != "", own_title), F.lit("'")), F.lit("")))
    which = F.when((number != "") & (number != code), elsewhere).otherwise(here)
    really = F.when((title_code != "") & (title_code != code), F.concat(F.lit("; "), quoted, F.lit(" is "), title_code, F.lit(" in the catalogue")))
    return F.concat(which, F.coalesce(really, F.lit("")), F.lit("; it may hold another episode's dialogue"))


def verify_flagged(refs: DataFrame, key: str, same: float = 0.35, other: float = 0.15, like_none: float = 0.25, least: int = 3) -> DataFrame:
    """refs (key, text, flagged, target) -> key and verdict of the flagged ones, held against the others:
    removed if one of these has the same dialogue (`same`); verified if the one that its own title
    points at (target) is there, is unlike it (`other`), and none is like it (`like_none`); else, or
    with fewer than `least` trusted references, it stays flagged. Word weights are those of the trusted."""
    trusted, doubtful = refs.where("not flagged"), refs.where("flagged")
    n = trusted.agg(F.count("*").alias("n"))
    known = tfidf.counts(trusted, key)
    weights = tfidf.Weights(stored(tfidf.fit(known, n, 0.6).idf, "idf"))
    scored = tfidf.scores(doubtful, weights, stored(weights.vectors(known, key).withColumnRenamed(key, "other"), "vectors"), key, "other").where(F.col(key) != F.col("other"))
    best = scored.groupBy(key).agg(F.max("score").alias("best"))
    there = trusted.select(F.col(key).alias("target")).distinct().withColumn("there", F.lit(True))
    rows = doubtful.select(key, "target").join(best, key, "left").join(there, "target", "left").join(scored.select(key, F.col("other").alias("target"), "score"), [key, "target"], "left").crossJoin(F.broadcast(n))
    best, score = F.coalesce("best", F.lit(0.0)), F.coalesce("score", F.lit(0.0))
    sure = F.col("there") & (F.col("target") != F.col(key)) & (score < other) & (best < like_none)
    verdict = F.when(F.col("n") < least, "flagged").when(best >= same, "removed").when(sure, "verified").otherwise("flagged")
    return rows.select(key, verdict.alias("verdict"))
