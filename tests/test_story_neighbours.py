"""Neighbours of a large group meet in stretches of numbers, not all with all."""

from __future__ import annotations

from conftest import SMALL_SF_DIR

from lodestone import queries as _registered  # noqa: F401
from lodestone import registry
from lodestone.plans import claims


def test_large_groups_meet_in_stretches(spark):
    """One group of 300,000: all its pairs would be 90 milliards."""
    got = claims.near(spark.range(300_000).selectExpr("1 as g", "id as a"), ["g"], "a", "b", 2)
    assert got.count() == 4 * 300_000 - 6
    for name in ("story_neighbours", "story_parts_near"):
        plan = registry.QUERIES[name](spark, SMALL_SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "_at" in next(line for line in plan.splitlines() if "Join" in line)


def test_numbers_below_zero_and_none_apart(spark):
    rows = spark.createDataFrame([(1, x) for x in (-4, -3, -1, 0, 2, 2)] + [(2, -3), (None, 1), (None, 2)], "g int, a int")
    near = lambda within: sorted(tuple(r) for r in claims.near(rows, ["g"], "a", "b", within).collect())
    own = [-4, -3, -1, 0, 2, 2]
    for within in (0, 1, 3, 7):
        assert near(within) == sorted((1, a, b) for a in own for b in own if a != b and abs(a - b) <= within)
