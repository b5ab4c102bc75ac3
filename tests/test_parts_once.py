"""Part markers are read once for each name, and only where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_chain import EPISODES

from lodestone.functions.text import part_of
from lodestone.plans import build, chain

ITEMS = "file string, expected array<string>, pieces array<struct<code:string>>, duration double"


def test_names_are_read_once(spark):
    items = spark.createDataFrame([("a - Part 2.mkv", ["S01E01"], [("S01E01",)], 600.0), ("a - Part 1.mkv", ["S01E01"], [("S01E01",)], 600.0), ("b.mkv", [], [], None)], ITEMS)
    out = chain.joined_parts(items, spark.createDataFrame([("S01E01", 1, 1, False, True, 30.0)], EPISODES), chain.standard_path)
    assert [(r["file"], r["sources"], r["codes"], r["selected"], r["reason"]) for r in out.collect()] == [("a - Part 1.mkv", ["a - Part 1.mkv", "a - Part 2.mkv"], ["S01E01"], True, "parts")]
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_part_markers(spark):
    want = {"Show Part 1 - Part Two": ("show part 1", 2), "Show, pt. IV S01E02 x": ("show x", 4), "Show (part 3)": ("show", 3), "Show Part 0": (None, None), "Show Part iiii": (None, None), "Partner": (None, None), "": (None, None), None: (None, None)}
    key, n = part_of(F.col("name"))
    rows = spark.createDataFrame([(x,) for x in want], "name string").select("name", key.alias("key"), n.alias("n")).collect()
    assert {r["name"]: (r["key"], r["n"]) for r in rows} == want


def test_items_meet_what_is_settled_once(spark):
    """Nothing but one row a file with all it holds is shuffled by file at the end, and segments are not."""
    files = spark.createDataFrame([("Season 1/a.mkv", "MISMATCH", ["S01E02"], 1300.0, False, [(0.0, 1300.0, "S01E01", 0.4, "high", None, None, False)], 1)], f"file string, status string, expected array<string>, duration double, hold boolean, segments array<{build.SEGMENT}>, season_hint long")
    out = chain.whole_plan(files, spark.createDataFrame([("S01E01", 1, 1, False, True, 30.0), ("S01E02", 1, 2, False, True, 30.0)], EPISODES), spark.createDataFrame([], "file string, codes array<string>"))
    assert [(r["kind"], r["codes"]) for r in out.collect()] == [("rename", ["S01E01"])]
    assert "lodestone-verdicts-" in (plan := out._jdf.queryExecution().executedPlan().toString()) and "segments" not in plan
