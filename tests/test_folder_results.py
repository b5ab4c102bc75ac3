"""Every order is a search result of its customer's folder, also one that has the folder's catalogue number."""

from __future__ import annotations

from lodestone import queries as _registered  # noqa: F401
from lodestone import registry


def test_no_order_is_left_out(spark, tmp_path):
    rows = [(4, 17), (4, 18), (4, 33), (4, 49), (8, 1), (8, 6), (12, 65), (5, 17), (5, 18)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {tuple(r) for r in registry.QUERIES["folder_resolution"](spark, str(tmp_path)).select("folder", "id", "points", "sure").collect()}
    assert got == {("4", 33, 120, True), ("8", 1, 100, True), ("12", 65, 100, True), ("5", 18, 30, True)}


def test_the_same_as_sql(same_as_sql):
    assert "WHERE" not in registry.ORACLE_SQL["folder_resolution"]
    same_as_sql(registry.QUERIES["folder_resolution"], registry.ORACLE_SQL["folder_resolution"])
