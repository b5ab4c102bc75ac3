"""Queries of getting references, of seasons and of settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fetch as X
from ..registry import query
from .common import table


@query("""WITH e AS (SELECT o_orderkey AS k, o_custkey % 5 > 0 AS wanted, CASE WHEN o_orderkey % 3 = 0 THEN 'crowd' WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'site' END AS source, o_orderkey % 4 = 0 AS tried, o_orderkey % 7 = 0 AS missed FROM orders)
SELECT k AS o_orderkey, CASE WHEN source IS NULL AND NOT missed THEN 'todo' ELSE 'upgrade' END AS task FROM e WHERE wanted AND ((source IS NULL AND NOT missed) OR (source = 'crowd' AND NOT tried))""")
def fetch_worklist(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    have = o.where("o_orderkey % 3 = 0 or (o_orderkey % 3 = 1 and o_orderkey % 2 = 0)").select("o_orderkey", F.when(k % 3 == 0, "crowd").otherwise("site").alias("source"), F.when(k % 4 == 0, True).alias("tried"))
    return X.worklist(o.select("o_orderkey", (F.col("o_custkey") % 5 > 0).alias("wanted")), have, o.where("o_orderkey % 7 = 0"), ["o_orderkey"])


@query("""WITH a AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'error' WHEN 'click' THEN 'error' ELSE 'ok' END AS status FROM events),
l AS (SELECT *, status = 'error' AND lag(status, 1) OVER w = 'error' AND lag(status, 2) OVER w = 'error' AS three FROM a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), f AS (SELECT user_id, min(event_id) AS first FROM l WHERE three GROUP BY 1)
SELECT a.user_id, count(*) AS asked FROM a LEFT JOIN f USING (user_id) WHERE first IS NULL OR event_id <= first GROUP BY 1""")
def circuit_breaker(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type").isin("error", "view", "click"), "error").otherwise("ok").alias("status"))
    return X.broken(e, "user_id", "event_id").where("asked").groupBy("user_id").agg(F.count("*").alias("asked"))


@query("""WITH w AS (SELECT o_orderkey AS k, o_orderkey % 4 != 3 AS todo, CASE o_custkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'ok' ELSE 'missing' END WHEN 2 THEN 'error' ELSE 'missing' END AS status, o_orderkey % 5 < 2 AS crowd FROM orders),
q AS (SELECT k FROM w WHERE todo AND status != 'ok' AND crowd ORDER BY k LIMIT 500)
SELECT k AS o_orderkey, CASE WHEN status = 'ok' THEN CASE WHEN todo THEN 'fetched' ELSE 'upgraded' END WHEN NOT todo THEN CASE WHEN status = 'error' THEN 'deferred' ELSE 'tried' END WHEN k IN (SELECT k FROM q) THEN 'fetched' WHEN status = 'error' OR crowd THEN 'deferred' ELSE 'missed' END AS outcome,
 CASE WHEN status = 'ok' THEN 'site' WHEN todo AND k IN (SELECT k FROM q) THEN 'crowd' END AS source FROM w""")
def reference_refresh(spark, sf_dir):
    """A site that answers for most, a crowd's texts for two fifths, of which 500 are allowed."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    o = table(spark, sf_dir, "orders")
    work = o.select("o_orderkey", F.when(k % 4 == 3, "upgrade").otherwise("todo").alias("task"))
    site = o.where("o_custkey % 4 != 3").select("o_orderkey", F.when(c == 2, "error").otherwise("ok").alias("status"), F.lit("text").alias("text"), ((c == 0) | (k % 2 == 0)).alias("usable"))
    crowd = o.where("o_orderkey % 5 < 2").select("o_orderkey", F.lit("words").alias("text"), k.alias("place"))
    return X.refreshed(work, site, crowd, ["o_orderkey"], 500).select("o_orderkey", "outcome", "source")


@query("SELECT l_partkey, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS value FROM lineitem GROUP BY 1 HAVING arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) != 'R' UNION ALL SELECT p_partkey, 0.0 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def overwrite_by_key(spark, sf_dir):
    new = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(0.0).alias("value"))
    return X.overwritten(old, new, ["l_partkey"], "at")


@query("""WITH e AS (SELECT DISTINCT o_custkey AS series, o_orderkey % 3 AS season, o_orderkey AS number, strftime(o_orderdate, '%Y-%m-%d') AS aired, o_orderstatus AS s FROM orders), t AS (SELECT *, CASE WHEN s = 'F' THEN 'have' WHEN aired > '1997-01-01' THEN 'unaired' WHEN s = 'P' THEN 'blocked' ELSE 'missing' END AS state FROM e),
g AS (SELECT series, season, coalesce(list_sort(list(number) FILTER (state = 'have')), []) AS have, coalesce(list_sort(list(number) FILTER (state = 'missing')), []) AS missing, coalesce(list_sort(list(number) FILTER (state = 'unaired')), []) AS unaired, coalesce(list_sort(list(number) FILTER (state = 'blocked')), []) AS blocked FROM t GROUP BY 1, 2)
SELECT *, len(missing) = 0 AND len(blocked) = 0 AND len(unaired) = 0 AS complete, len(have) = 0 AND len(unaired) = 0 AND len(missing) > 0 AS searchable FROM g""")
def season_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), (F.col("o_orderkey") % 3).alias("season"), F.col("o_orderkey").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("aired"), "o_orderstatus")
    return X.seasons(o.drop("o_orderstatus"), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "series", F.lit("1997-01-01"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'verified' WHEN o_orderkey % 3 = 1 THEN 'removed' ELSE 'flagged' END AS verdict FROM orders WHERE o_custkey % 2 = 0")
def names_checked(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    flagged = o.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 1, True).alias("names_checked"))
    return X.by_names(flagged, o.where("o_orderkey % 3 < 2").select("o_orderkey", F.when(k % 3 == 0, "match").otherwise("other").alias("verdict")), "o_orderkey").select("o_orderkey", "verdict")


@query("SELECT l_orderkey AS file, least(12, len(list_distinct(list(l_partkey))))::INT AS n FROM lineitem WHERE l_orderkey % 4 < 2 GROUP BY 1 HAVING sum(l_quantity) > 60")
def files_to_read_again(spark, sf_dir):
    k = F.col("l_orderkey") % 4
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("candidates"), F.greatest(F.lit(0), F.sum("l_quantity") - 60).alias("words"))
    status = F.when(k == 0, "LOW_CONFIDENCE").when(k == 1, "NO_MATCH").otherwise("OK")
    return X.to_read_again(f.select(F.col("l_orderkey").alias("file"), status.alias("status"), "words", "candidates")).select("file", F.size("candidates").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '********' WHEN p_partkey % 5 = 0 THEN 'env' WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS value, CASE WHEN p_partkey % 5 = 0 THEN 'env' WHEN p_partkey % 3 = 0 THEN 'file' ELSE 'default' END AS origin FROM part")
def settings_masked(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("name", F.concat(k, F.when(k % 4 == 0, "_api_key").otherwise("_style")))
    own = lambda where, v: p.where(where).select("name", v.alias("value"))
    out = X.settings(own("true", F.col("p_type")), own("p_partkey % 3 = 0", F.col("p_brand")), own("p_partkey % 5 = 0", F.lit("env")))
    return out.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("p_partkey"), "value", "origin")
