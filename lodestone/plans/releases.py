"""What a release would bring: its kind, what it covers, fills and has besides, and which ones may be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of releases, the surest first: by the titles in its name, by its numbers, a whole season.
KINDS = ("title", "numbers", "pack")


def meanings(releases: DataFrame) -> DataFrame:
    """releases (named, mapped, want, fill: codes; full_season) that could serve, with kind, kind_rank, covers, extra and fills.

    A name with titles says what the release holds: of that, what is wanted (covers), what is missing elsewhere
    (fills) and what nobody asked for (extra); it has to cover something. A season without titles counts for all that is
    wanted; else its numbers count, if all of them are wanted. Null arrays are empty.
    """
    none = F.array().cast(releases.schema["want"].dataType)
    named, mapped, want, fill = (F.coalesce(c, none) for c in ("named", "mapped", "want", "fill"))
    fill = F.array_except(fill, want)
    by_name = F.size(named) > 0
    kind = F.when(by_name, F.when(F.arrays_overlap(named, want), "title")).when(F.coalesce("full_season", F.lit(False)), "pack").when((F.size(mapped) > 0) & (F.size(F.array_except(mapped, want)) == 0), "numbers")
    covers = F.when(by_name, F.array_intersect(named, want)).when(kind == "pack", F.array_sort(want)).otherwise(F.array_intersect(want, mapped))
    made = {
        "kind": kind, "kind_rank": F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1, "covers": covers,
        "extra": F.when(by_name, F.array_except(F.array_except(named, want), fill)).otherwise(none), "fills": F.when(by_name, F.array_intersect(named, fill)).otherwise(none),
    }
    return releases.withColumns(made).where("kind is not null")


def fetchable(candidates: DataFrame, tried: DataFrame) -> DataFrame:
    """Candidates (guid, norm, kind, covers, extra, hard: rejected for good, imported: came from it before, need) that may be
    fetched next without asking: by title, with nothing besides, all that is needed, and neither they nor a release
    of the same name tried yet (tried: guid, norm)."""
    none = F.array().cast(candidates.schema["covers"].dataType)
    sure = (F.col("kind") == "title") & (F.size("extra") == 0) & ~F.coalesce("hard", F.lit(False)) & ~F.coalesce("imported", F.lit(False)) & (F.size(F.array_except(F.coalesce("need", none), F.col("covers"))) == 0)
    left = candidates.where(sure).join(tried.select("guid").where("guid is not null").distinct(), "guid", "left_anti")
    return left.join(tried.select("norm").where("norm is not null").distinct(), "norm", "left_anti").select(*candidates.columns)


def swaps_since(pairs: DataFrame, done: DataFrame, group: str) -> DataFrame:
    """Pairs (group, x, y, scanned) of references that seem to hold each other's episode, but those that were swapped (done:
    group, x, y, at) at or after the scan: the next scan shows whether that helped."""
    d = done.select(F.col(group).alias("_g"), F.least("x", "y").alias("_x"), F.greatest("x", "y").alias("_y"), "at")
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.least("x", "y") == F.col("_x")) & (F.greatest("x", "y") == F.col("_y")) & (F.col("scanned").isNull() | (F.col("at") >= F.col("scanned")))
    return pairs.join(d, same, "left_anti")
