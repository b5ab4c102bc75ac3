"""Folders whose title ends with a number that could be a year."""

from __future__ import annotations

from lodestone.sources import probe as S


def test_a_number_before_a_bracketed_year_may_belong_to_the_title(spark):
    rows = [("Show 1984 (2001)", 1, "The Show 1984", "2001", 0), ("Show 1984 (2001)", 2, "Other", "2001", 1), ("Old 1999 (1999)", 3, "Old", "1999", 0), ("Bare 2010", 4, "Bare", "2010", 0), ("Bare 2010", 5, "Bare 2010", "2010", 1)]
    results = spark.createDataFrame(rows, "folder string, id long, name string, year string, place long")
    got = {r["folder"]: (r["id"], r["points"], r["sure"]) for r in S.resolve_folders(results.select("folder").distinct(), results).collect()}
    assert got == {"Show 1984 (2001)": (1, 30, True), "Old 1999 (1999)": (3, 30, True), "Bare 2010": (4, 20, True)}
