"""Queries of what is remembered between runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..streaming import memory as M
from .common import scratch, table

_SNAP = "SELECT o_custkey AS series, o_orderkey AS rel, {0} AS sig FROM orders WHERE {1}"


def _snapshots(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), k.cast("string").alias("rel"), "o_orderstatus", "o_orderkey")
    old = o.where("o_orderkey % 7 != 0").select("series", "rel", F.concat(F.lit("1:"), "o_orderstatus").alias("sig"))
    new = o.where("o_orderkey % 5 != 0").select("series", "rel", F.concat(F.lit("1:"), F.when(k % 11 == 0, "x").otherwise(F.col("o_orderstatus"))).alias("sig"))
    return old, new


@query("""WITH d AS (SELECT o_custkey AS series, count(*) FILTER (o_orderkey % 7 = 0 AND o_orderkey % 5 != 0) AS added, count(*) FILTER (o_orderkey % 7 != 0 AND o_orderkey % 5 != 0 AND o_orderkey % 11 = 0) AS changed, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 7 != 0) AS removed FROM orders GROUP BY 1)
SELECT series, added, changed, removed, CASE WHEN series % 2 = 0 THEN '1' ELSE '2' END AS since, added + changed > 0 AND series % 4 != 0 AS fetch FROM d WHERE added + changed + removed > 0""")
def pending_changes(spark, sf_dir):
    """Half of the series had the same changes in the run before, and half of these have fetched for them."""
    old, new = _snapshots(spark, sf_dir)
    none = spark.createDataFrame([], "series long, digest string, since string, fetched boolean")
    first = M.pending_changes(old, new, none, "series", F.lit("1"))
    before = first.select("series", F.when(F.col("series") % 2 == 0, F.col("digest")).alias("digest"), "since", (F.col("series") % 4 == 0).alias("fetched"))
    return M.pending_changes(old, new, before, "series", F.lit("2")).select("series", "added", "changed", "removed", "since", "fetch")


@query("""WITH s AS (SELECT o_custkey AS series, o_orderkey AS rel, 'old' AS sig FROM orders WHERE o_custkey % 3 != 0), n AS (SELECT o_custkey AS series, o_orderkey AS rel, CASE WHEN o_orderkey % 4 != 0 THEN 'new' END AS sig FROM orders WHERE o_orderkey % 2 = 0)
SELECT series, rel::VARCHAR AS rel, sig, 'part' AS kind FROM s WHERE rel % 2 != 0 UNION ALL SELECT series, rel::VARCHAR, sig, 'part' FROM n WHERE sig IS NOT NULL AND series IN (SELECT series FROM s)
UNION ALL SELECT series, rel::VARCHAR, sig, 'full' FROM s WHERE series NOT IN (SELECT series FROM n) UNION ALL SELECT series, rel::VARCHAR, sig, 'full' FROM n WHERE sig IS NOT NULL""")
def recorded_snapshots(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), k.cast("string").alias("rel"), "o_orderkey")
    snapshot = o.where("series % 3 != 0").select("series", "rel", F.lit("old").alias("sig"))
    scanned = o.where("o_orderkey % 2 = 0").select("series", "rel", F.when(k % 4 != 0, "new").alias("sig"))
    part, full = (M.recorded(snapshot, scanned, "series", x).withColumn("kind", F.lit(n)) for x, n in ((False, "part"), (True, "full")))
    return part.unionByName(full)


_OUT = "SELECT user_id, rel, \"at\", status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY \"at\" DESC, rel) AS k FROM (SELECT user_id, event_id % 200 AS rel, max(event_id) AS \"at\", arg_max(event_type, event_id) AS status FROM events GROUP BY 1, 2)) WHERE k <= 30"


@query(_OUT)
def import_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 200).alias("rel"), F.col("event_id").alias("at"), F.col("event_type").alias("status"))
    return M.outcomes(e.where("at % 3 = 0"), e.where("at % 3 != 0"), "user_id")


@query(_OUT)
def stream_import_outcomes(spark, sf_dir):
    """The same rows from a stream of many small batches, with the table of each batch in the shared folder."""
    path = scratch(spark, "outcomes")
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 200).alias("rel"), F.col("event_id").alias("at"), F.col("event_type").alias("status"))
    e.repartition(4).write.parquet(f"{path}/in")
    schema = "user_id long, rel long, at long, status string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = M.remembered(stream, f"{path}/table", lambda before, rows: M.outcomes(before, rows, "user_id"), schema).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return M.latest_version(spark, f"{path}/table", schema)


@query("""WITH m AS (SELECT l_partkey % 50 AS norm, list_sort(list(DISTINCT l_suppkey % 9)) AS codes, min(l_orderkey) AS "at" FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT norm::VARCHAR AS norm, codes, "at" FROM m""")
def imported_releases(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    grabs = li.select((F.col("l_partkey") % 50).cast("string").alias("norm"), F.array(F.col("l_suppkey") % 9).alias("codes"), F.col("l_orderkey").alias("at"), F.when(F.col("l_returnflag") == "R", "imported").otherwise("failed").alias("status"), "l_linenumber")
    memory = M.imported_releases(grabs.where("false").select("norm", "codes", "at"), grabs.where("l_linenumber < 3"))
    return M.imported_releases(memory, grabs.where("l_linenumber >= 3"))


@query("""WITH c AS (SELECT o_custkey AS request, o_orderkey AS place, o_orderkey % 40 IN (SELECT o_orderkey % 40 FROM orders WHERE o_orderkey % 10 = 3) AND o_custkey % 5 = o_orderkey % 5 AS before FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY before, place) AS shown FROM c)
SELECT request, place, shown::INT AS place_shown, before OR shown <= 3 AS offered FROM r""")
def demoted_candidates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    memory = o.where("o_orderkey % 10 = 3").select((k % 40).cast("string").alias("norm"), F.array(*[F.lit(i).cast("long") for i in range(1)]).alias("codes")).distinct()
    covers = F.array(F.when(F.col("o_custkey") % 5 == k % 5, 0).otherwise(1).cast("long"))
    c = o.select(F.col("o_custkey").alias("request"), (k % 40).cast("string").alias("norm"), covers.alias("covers"), F.array().cast("array<bigint>").alias("extra"), k.alias("place"))
    return M.with_memory(c, memory).select("request", "place", *M.demoted("request", "place", 3))


@query("""WITH t AS (SELECT o_custkey AS r, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), c AS (SELECT o_custkey AS r, o_orderkey AS guid, o_orderkey % 30 AS norm FROM orders WHERE o_orderstatus != 'P' AND o_orderkey % 4 != 0 AND o_orderkey % 3 != 0)
SELECT c.r AS request, min(guid) AS guid FROM c LEFT JOIN t USING (r) WHERE coalesce(t.n, 0) < 2 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = c.r AND p.o_orderstatus = 'P' AND p.o_orderkey % 30 = c.norm) GROUP BY 1""")
def next_releases(spark, sf_dir):
    """Orders that are pending were tried already; a quarter of the others holds something else, a third is rejected."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), k.alias("guid"), (k % 30).alias("norm"), k.alias("place"), "o_orderstatus", "o_orderkey")
    code = F.array(F.lit("S01E01"))
    failed = o.select("request", code.alias("needs")).distinct()
    candidates = o.where("o_orderstatus != 'P'").select("request", "guid", "norm", "place", F.lit("title").alias("kind"), (k % 3 == 0).alias("rejected"), F.lit(False).alias("imported_before"), code.alias("covers"), F.when(k % 4 == 0, F.array(F.lit("S01E02"))).otherwise(F.array().cast("array<string>")).alias("extra"))
    return M.retries(failed, o.where("o_orderstatus = 'P'"), candidates, most=2)


@query("SELECT l_partkey AS guid, min(l_orderkey) AS request, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) THEN 'grab' ELSE 'search' END AS act FROM lineitem GROUP BY 1")
def grabbed_once(spark, sf_dir):
    picks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_partkey").alias("guid"))
    return M.grabbed_once(picks, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("guid")))


@query("SELECT o_orderkey AS rel, CASE WHEN o_orderkey % 7 = 0 THEN 'lost' WHEN o_orderkey % 5 = 0 THEN 'taken' WHEN o_custkey % 3 = 0 THEN 'filled' ELSE 'restore' END AS act FROM orders")
def put_back(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("rel"), (k + 1).alias("backup"), F.col("o_custkey").alias("episode"))
    return M.put_back(o, o.where("rel % 7 != 0"), o.where("rel % 5 = 0"), o.where("episode % 3 = 0"))


@query("""SELECT o_orderkey AS rel, CASE WHEN o_orderkey % 3 = 0 THEN 'waiting' WHEN o_orderkey % 3 = 1 AND o_custkey % 4 = 0 THEN 'waiting' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 3 = 0 OR o_custkey % 4 = 0 AND o_orderkey % 3 = 1 THEN 'waiting' ELSE 'failed' END AS first, o_orderkey % 3 = 1 AND o_custkey % 4 = 0 AS recheck_only FROM orders""")
def upgraded_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    reason = F.when(F.col("o_custkey") % 4 == 0, "the history shows no grab since")
    grab = F.struct(F.lit("t").alias("title"), F.when(k % 3 != 0, "failed").alias("status"), reason.alias("reason"), F.when(k % 3 == 2, True).alias("rechecked"))
    rows = table(spark, sf_dir, "orders").select(k.alias("rel"), F.when(k % 3 != 0, "failed").alias("status"), F.array(grab).alias("grabs"))
    return M.upgraded(rows).select("rel", "status", F.get("grabs", F.lit(0))["status"].alias("first"), "recheck_only")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 THEN round(100 * (l_quantity - l_quantity * l_tax * 10) / l_quantity)::BIGINT END AS pct, CASE l_linenumber % 4 WHEN 0 THEN 'import blocked' WHEN 1 THEN 'downloading' WHEN 2 THEN 'paused' ELSE 'odd' END AS state FROM lineitem")
def download_progress(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    size = F.when(F.col("l_quantity") > 5, F.col("l_quantity")).otherwise(0.0)
    pct, state = M.progress(size, F.col("l_quantity") * F.col("l_tax") * 10, F.when(n == 2, "paused").when(n == 3, "odd").otherwise("downloading"), F.when(n == 0, "importBlocked").when(n == 1, "downloading"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pct.alias("pct"), state.alias("state"))


@query("""WITH g AS (SELECT o_orderkey AS k, o_custkey AS c, 200000 - o_orderkey % 9 * 25000 AS age, CASE WHEN o_orderkey % 5 != 0 THEN o_orderkey END AS d FROM orders),
s AS (SELECT *, d % 11 = 0 AS imported, d % 7 = 0 AS failed, d % 3 = 0 AS queued, c % 2 = 0 AS here, CASE WHEN c % 5 = 0 THEN 5000 ELSE 0 END AS gone FROM g)
SELECT k AS "grab", CASE WHEN coalesce(imported, false) THEN 'imported' WHEN coalesce(failed, false) THEN 'failed' WHEN d IS NULL AND age > 1800 THEN 'failed' WHEN d IS NOT NULL AND age >= 300 AND NOT queued AND here THEN 'imported' WHEN d IS NOT NULL AND age >= 300 AND NOT queued AND gone >= 1800 THEN 'failed' WHEN age > 172800 THEN 'stuck' ELSE 'waiting' END AS status FROM s""")
def settled_grabs(spark, sf_dir):
    """Grabs of many ages: in the history, never seen, still queued, gone with and without files."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    now = F.lit(1_000_000)
    grabs = o.select(k.alias("grab"), (now - 200000 + k % 9 * 25000).alias("at"), F.when(k % 5 != 0, k).alias("download"), F.array(k).alias("episodes"), F.when(c % 5 == 0, now - 5000).alias("gone_since"))
    history = o.where("o_orderkey % 11 = 0").select(k.alias("download"), F.lit("imported").alias("kind")).unionByName(o.where("o_orderkey % 7 = 0").select(k.alias("download"), F.lit("failed").alias("kind")))
    queue, have = o.where("o_orderkey % 3 = 0").select(k.alias("download")), o.where("o_custkey % 2 = 0").select(k.alias("episode"))
    return M.settled_grabs(grabs, history, queue, have, now).select("grab", "status")
