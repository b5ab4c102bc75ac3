"""Queries of state: diffs, versions, mappings, coverage, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as S
from ..operators import views as V
from ..registry import query
from .common import table

_OLD = "SELECT o_orderkey, (o_custkey || ':' || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END) AS sig FROM orders WHERE o_orderkey % 7 != 0"
_NEW = "SELECT o_orderkey, (CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END || ':' || o_orderstatus) AS sig FROM orders WHERE o_orderkey % 5 != 0"


def _versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 7 != 0).select("o_orderkey", F.concat_ws(":", "o_custkey", F.when(k % 11 == 0, "").otherwise(F.col("o_orderstatus"))).alias("sig"))
    new = o.where(k % 5 != 0).select("o_orderkey", F.concat_ws(":", F.when(k % 13 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), "o_orderstatus").alias("sig"))
    return old, new


@query(f"""SELECT o_orderkey, status FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.sig IS NULL THEN 'added' WHEN b.sig IS NULL THEN 'removed'
  WHEN a.sig LIKE '%:' AND split_part(a.sig, ':', 1) != split_part(b.sig, ':', 1) THEN 'changed' WHEN a.sig NOT LIKE '%:' AND a.sig != b.sig THEN 'changed' END AS status
  FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.o_orderkey = b.o_orderkey) WHERE status IS NOT NULL""")
def snapshot_diff(spark, sf_dir):
    return S.snapshot_diff(*_versions(spark, sf_dir), "o_orderkey", "sig")


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS c FROM lineitem WHERE l_orderkey % 3 != 0 GROUP BY 1), b AS (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS c FROM lineitem WHERE l_orderkey % 4 != 0 AND l_linenumber < 6 GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, CASE WHEN b.c IS NULL THEN 'ours_only' WHEN a.c IS NULL THEN 'theirs_only' WHEN a.c != b.c THEN 'differs' END AS status FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey) WHERE status IS NOT NULL""")
def inventory_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    sets = lambda d: d.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("codes"))
    return S.compare_inventories(sets(rows.where("l_orderkey % 3 != 0")), sets(rows.where("l_orderkey % 4 != 0 and l_linenumber < 6")), "l_orderkey", "codes")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS version, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS k FROM lineitem) WHERE k = 1")
def latest_version(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("version"), "l_partkey")
    return S.latest(rows.groupBy("l_orderkey", "version").agg(F.max("l_partkey").alias("l_partkey")), "l_orderkey", "version")


@query("SELECT o_orderkey, o_custkey + 1 AS o_custkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 != 0")
def partial_scan_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return S.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0").withColumn("o_custkey", F.col("o_custkey") + 1), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey <= 1000 THEN 1001 - l_partkey ELSE l_partkey END AS l_partkey FROM lineitem")
def remap_codes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_partkey <= 1000").select(F.col("p_partkey").alias("old"), (1001 - F.col("p_partkey")).alias("new"))
    return S.remap(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey")


_PV = "SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_size || ' ' || p_brand AS title FROM part"


@query(f"WITH t AS ({_PV}), u AS (SELECT title, min(p_partkey) AS p FROM t GROUP BY title HAVING count(*) = 1) SELECT title, p AS old, CASE WHEN p % 3 = 0 THEN p + 5000 ELSE p END AS new FROM u WHERE p % 3 = 0")
def renumber_moves(spark, sf_dir):
    old = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_size", "p_brand").alias("title"))
    new = old.withColumn("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") + 5000).otherwise(F.col("p_partkey")))
    return S.moved_by_unique_name(old, new, "title", "p_partkey")


@query("SELECT user_id, event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1, 2")
def upper_median(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.struct("user_id", "event_type"))
    return S.upper_medians(e, "k", "value").select("k.user_id", "k.event_type", F.col("middle").alias("median"))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2) WHERE k = 1")
def mode_tiebreak(spark, sf_dir):
    return S.usual(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, greatest(1.0, count(*) OVER (PARTITION BY user_id) / 12) AS step FROM events) WHERE floor(k / step) != floor((k - 1) / step)")
def even_sample(spark, sf_dir):
    return S.even_sample(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 12)


@query("""WITH m AS (SELECT event_type, user_id, list_sort(list(value))[count(*) // 2 + 1] AS mid FROM events GROUP BY 1, 2), c AS (SELECT e.event_type, e.user_id FROM events e JOIN (SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS mid FROM events GROUP BY 1) m ON m.event_type = e.event_type AND abs(value - mid) <= 8)
SELECT event_type, count(DISTINCT user_id) AS files FROM c GROUP BY 1 HAVING count(DISTINCT user_id) >= 3""")
def recurring_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mid = S.upper_medians(e, "event_type", "value").withColumnRenamed("middle", "mid")
    near = e.join(F.broadcast(mid), "event_type").where(F.abs(F.col("value") - F.col("mid")) <= 8)  # one row a type
    return near.groupBy("event_type").agg(F.count_distinct("user_id").alias("files")).where("files >= 3")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def missing_anti(spark, sf_dir):
    return V.missing(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0)")
def worklist_anti(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    have, missed = (li.where(c).select(F.col("l_partkey").alias("p_partkey")) for c in ("l_quantity > 45", "l_discount = 0"))
    return V.missing(table(spark, sf_dir, "part"), have, "p_partkey", missed)


@query("""SELECT date_part('year', o_orderdate)::BIGINT AS season, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS have, count(*) FILTER (o_orderstatus = 'O') AS missing,
 bool_and(o_orderstatus = 'F') AS complete FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1""")
def season_completeness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate <= timestamp_ntz '1998-01-01 00:00:00'")  # "today" is a parameter
    f = F.col("o_orderstatus") == "F"
    return o.groupBy(F.year("o_orderdate").cast("long").alias("season")).agg(F.count("*").alias("n"), F.count_if(f).alias("have"), F.count_if(F.col("o_orderstatus") == "O").alias("missing"), F.bool_and(f).alias("complete"))


_COV = "SELECT l_suppkey, l_partkey FROM lineitem WHERE "


@query(f"""WITH w AS (SELECT l_suppkey, list_distinct(list(l_partkey)) AS want FROM ({_COV} l_quantity < 10) GROUP BY 1), b AS (SELECT l_suppkey, list_distinct(list(l_partkey)) AS now FROM ({_COV} l_linenumber = 1) GROUP BY 1), a AS (SELECT l_suppkey, list(l_partkey) AS every, list_distinct(list(l_partkey)) AS after FROM ({_COV} l_linenumber = 2) GROUP BY 1),
r AS (SELECT l_suppkey, want, coalesce(now, []) AS now, coalesce(after, []) AS after, coalesce(every, []) AS every FROM w LEFT JOIN b USING (l_suppkey) LEFT JOIN a USING (l_suppkey))
SELECT l_suppkey, list_sort(now) AS now, list_sort(after) AS after, list_sort(list_filter(now, lambda x: NOT list_contains(after, x))) AS lost, list_sort(list_filter(after, lambda x: NOT list_contains(now, x))) AS gained,
 list_sort(list_filter(want, lambda x: NOT list_contains(after, x))) AS missing, list_sort(list_filter(after, lambda x: len(list_filter(every, lambda y: y = x)) > 1)) AS doubled FROM r""")
def coverage_before_after(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_linenumber")
    return S.coverage(li.where("l_quantity < 10"), li.where("l_linenumber = 1"), li.where("l_linenumber = 2"), "l_suppkey", "l_partkey")


@query("SELECT p_brand, count(*) AS n, count(DISTINCT l_partkey) AS have, round(100.0 * count(DISTINCT l_partkey) / count(DISTINCT p_partkey), 2) AS pct FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) ON l_partkey = p_partkey GROUP BY 1")
def reference_coverage(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey").distinct()
    rows = table(spark, sf_dir, "part").join(have, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.count("l_partkey").alias("have"), F.round(100.0 * F.count("l_partkey") / F.count("*"), 2).alias("pct"))


@query("""SELECT event_id, CASE WHEN 100 + value < 200 - greatest(10, 0.03 * 200) OR event_id % 7 >= 5 THEN 'bad' WHEN event_id % 7 > 0 OR abs(value - 150) > greatest(3, 0.02 * 200) OR event_id % 3 > 1 THEN 'warn' ELSE 'ok' END AS status FROM events""")
def integrity_verdict(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", S.integrity_verdict(F.lit(200.0), 100 + v, e % 7, v, F.lit(150.0), e % 3).alias("status"))


@query("""WITH RECURSIVE l AS (SELECT user_id, list_sort(list(event_id)) AS l FROM events GROUP BY 1), k AS (SELECT user_id, 1 AS i, l[1] AS last, l FROM l UNION ALL SELECT user_id, i + 1, CASE WHEN l[i + 1] - last >= 300 THEN l[i + 1] ELSE last END, l FROM k WHERE i < len(l))
SELECT user_id, list_sort(list(DISTINCT last)) AS kept FROM k GROUP BY 1""")
def problem_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_id").alias("x")).select("user_id", S.spaced(F.col("x"), 300).alias("kept"))


@query("SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_members(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT o_orderkey, sha1(o_custkey || '|' || o_orderpriority) AS key FROM orders WHERE o_orderkey % 2 = 0), s AS (SELECT key, max(o_orderkey) AS result FROM (SELECT o_orderkey, sha1(o_custkey || '|' || o_orderpriority) AS key FROM orders WHERE o_orderkey % 2 = 1) GROUP BY key)
SELECT o_orderkey, result FROM k JOIN s USING (key)""")
def identity_follow(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", V.cache_key("o_custkey", "o_orderpriority").alias("key"), F.col("o_orderkey").cast("string").alias("path"))
    return V.followed(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "result"), "key", "path", "result").select("o_orderkey", "result")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus != 'F' THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus != 'F' THEN o_orderstatus END AS was FROM orders")
def accepted_override(spark, sf_dir):
    """The key stands for a file's size and date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", V.cache_key("o_orderkey", "o_custkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return V.accepted(o, o.where("o_orderkey % 10 = 0"), "key", "status", "F").select("o_orderkey", "status", "was")


@query("SELECT l_shipmode, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_quantity::BIGINT AS bytes FROM lineitem) GROUP BY 1")
def bucket_sums(spark, sf_dir):
    return V.bucket_sums(table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("long")), F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"))


@query("SELECT o_orderkey, sum(greatest(l_quantity::BIGINT, 0)) + greatest(200, 0.05 * sum(l_quantity)) > 300 AS short FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def free_space(spark, sf_dir):
    need = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("need"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(need, "o_orderkey")
    return rows.select("o_orderkey", V.too_little_room(F.col("need"), F.lit(300), 200, 0.05).alias("short"))
