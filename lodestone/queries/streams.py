"""Queries of streams and their state; streams run to their end on the tables and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.text import alnum
from ..registry import query
from ..sources import probe
from ..streaming import downloads, grabs
from .common import scratch, table


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now; its batches are files in the shared folder, as is its state."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, "stream")

    def keep(rows: DataFrame, k: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={k}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    if mode == "complete":  # each batch has all rows so far
        out = out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch")
    return out.drop("batch")


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


_SESS = "WITH m AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 1800 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)"


@query(_SESS + " SELECT user_id, count(*) AS n FROM g GROUP BY user_id, s")
def stream_session(spark, sf_dir):
    return _finished(grabs.sessions(_stream(spark, sf_dir, "events"), "user_id", "ts", "30 minutes").select("user_id", "n"), "complete")


@query("SELECT floor(epoch(ts) / 3600)::BIGINT * 3600 - o * 3600 AS start, count(*) AS n FROM events, range(2) t(o) GROUP BY 1")
def stream_hop(spark, sf_dir):
    return _finished(grabs.hops(_stream(spark, sf_dir, "events"), "ts", "2 hours", "1 hour").select(F.unix_timestamp("start").alias("start"), "n"), "complete")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id % 50 AS rel FROM events) GROUP BY 1, 2")
def stream_import_batches(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.concat_ws("/", "event_type", F.col("event_id") % 50).alias("rel"))
    path = scratch(spark, "batches")

    def handle(rows: DataFrame, k: int) -> None:
        rows.groupBy("series", F.split_part("rel", F.lit("/"), F.lit(1)).alias("event_type")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/out/batch={k}")

    grabs.import_batches(e, handle, f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("series long, event_type string, n long, batch long").parquet(f"{path}/out")
    return out.groupBy(F.col("series").alias("user_id"), "event_type").agg(F.sum("n").alias("n"))


_HIST = "SELECT user_id, epoch(ts)::DOUBLE AS \"at\", CASE event_type WHEN 'purchase' THEN CASE WHEN value > 130 THEN 'imported' ELSE 'seen' END WHEN 'error' THEN CASE WHEN value > 130 THEN 'failed' ELSE 'seen' END ELSE 'seen' END AS kind FROM events"


def _history(e):
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 130), "imported").when((F.col("event_type") == "error") & (F.col("value") > 130), "failed").otherwise("seen")
    return e.select("user_id", (F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double") + F.date_format("ts", "0.SSSSSS").cast("double")).alias("at"), kind.alias("kind"))


_GRAB = f"WITH h AS ({_HIST}), e AS (SELECT user_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY \"at\", kind) AS k FROM h WHERE kind != 'seen') WHERE k = 1), s AS (SELECT user_id, min(\"at\") AS since FROM h GROUP BY 1)"


@query(_GRAB + " SELECT user_id, coalesce(kind, 'stuck') AS status FROM s LEFT JOIN e USING (user_id)")
def grab_status(spark, sf_dir):
    return grabs.grab_status(_history(table(spark, sf_dir, "events")), "user_id", now=2e9)


@query(_GRAB + " SELECT user_id, coalesce(kind, CASE WHEN since + 172800 <= (SELECT max(\"at\") - 600 FROM h) THEN 'stuck' ELSE 'waiting' END) AS status FROM s LEFT JOIN e USING (user_id)")
def stream_grab_status(spark, sf_dir):
    """The last status of each grab: a change leads from waiting to stuck to an end, never back."""
    rows = _finished(grabs.grab_stream(_history(_stream(spark, sf_dir, "events")), "user_id"), "update")
    rank = F.array_position(F.array(F.lit("waiting"), F.lit("stuck")), F.col("status"))
    return rows.groupBy("user_id").agg(F.max_by("status", F.when(rank == 0, 3).otherwise(rank)).alias("status"))


@query("""WITH r AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS want FROM orders GROUP BY 1), g AS (SELECT o_custkey, o_orderpriority AS code, CASE o_orderstatus WHEN 'F' THEN 'imported' WHEN 'P' THEN 'stuck' ELSE 'failed' END AS status FROM orders),
a AS (SELECT o_custkey, list(DISTINCT code) FILTER (status = 'imported') AS got, bool_or(status = 'stuck') AS stuck, bool_and(status = 'failed') AS failed FROM g GROUP BY 1)
SELECT o_custkey, CASE WHEN len(list_filter(want, lambda x: NOT list_contains(coalesce(got, []), x))) = 0 THEN 'imported' WHEN len(coalesce(got, [])) > 0 THEN 'partly' WHEN stuck THEN 'stuck' WHEN failed THEN 'failed' ELSE 'waiting' END AS status FROM r JOIN a USING (o_custkey)""")
def request_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "imported").when(F.col("o_orderstatus") == "P", "stuck").otherwise("failed")
    want = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("want"))
    return grabs.rollup(want, o.select("o_custkey", F.col("o_orderpriority").alias("code"), status.alias("status")), "o_custkey")


@query("""WITH q AS (SELECT p_partkey AS item, p_partkey % 50 AS download_id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS norm, p_size AS episode FROM part)
SELECT item, coalesce(CASE WHEN download_id < 10 THEN 'd' || download_id END, CASE WHEN norm < 'm' THEN 't' || norm END, CASE WHEN episode > 25 THEN 'e' || episode END) AS "grab" FROM q""")
def queue_match(spark, sf_dir):
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), (F.col("p_partkey") % 50).alias("download_id"), alnum(F.col("p_name")).alias("norm"), F.col("p_size").alias("episode"))
    one = lambda c, p, name: q.select(c).distinct().select(c, F.concat(F.lit(p), F.col(c).cast("string")).alias(name))
    return grabs.queue_match(q, one("download_id", "d", "grab_by_id").where("download_id < 10"), one("norm", "t", "grab_by_title").where("norm < 'm'"), one("episode", "e", "grab_by_episode").where("episode > 25"))


# ---- streams that are fed piece by piece: each piece is a micro-batch, some rows come a piece late
def _fed(spark, pieces, build, mode: str = "append") -> DataFrame:
    """Write one piece after the other into a folder, and run the stream over it to its end after each."""
    path = scratch(spark, "fed")
    schema = None
    for piece in pieces:
        piece.write.mode("append").parquet(f"{path}/in")
        stream = build(spark.readStream.schema(piece.schema).parquet(f"{path}/in"))
        schema = stream.schema

        def keep(rows: DataFrame, k: int) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/out/batch={k}")

        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out").drop("batch")


def _pieces(events, n: int = 3):
    """Events in pieces of ten days; of the last five minutes of each, every third comes with the next piece."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    start, size = 1704067200, 10 * 86400
    piece = F.floor((at - start) / size)
    late = (F.floor((at + 300 - start) / size) > piece) & (F.col("event_id") % 3 == 0)
    numbered = events.withColumn("_piece", F.greatest(F.lit(0), F.least(F.lit(n - 1), F.when(late, piece + 1).otherwise(piece))))
    return [numbered.where(F.col("_piece") == k).drop("_piece") for k in range(n)]


@query(_SESS + """, c AS (SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n, max(ts) AS last FROM g GROUP BY user_id, s)
SELECT user_id, start, n FROM c WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_closed_sessions(spark, sf_dir):
    """Sessions that the watermark has closed, each once; what is closed is dropped from the state."""
    build = lambda s: grabs.sessions(s, "user_id", "ts", "30 minutes").select("user_id", F.unix_timestamp("start").alias("start"), "n")
    return _fed(spark, _pieces(table(spark, sf_dir, "events")), build)


@query("""SELECT start, count(*) AS n FROM (SELECT floor(epoch(ts) / 3600)::BIGINT * 3600 - o * 3600 AS start FROM events, range(2) t(o)) GROUP BY start
HAVING start + 7200 <= (SELECT epoch(max(ts)) - 600 FROM events)""")
def stream_closed_hops(spark, sf_dir):
    build = lambda s: grabs.hops(s, "ts", "2 hours", "1 hour").select(F.unix_timestamp("start").alias("start"), "n")
    return _fed(spark, _pieces(table(spark, sf_dir, "events")), build)


_MSG = "SELECT user_id % 40 AS series, CASE WHEN event_id % 5 != 0 THEN 'e' || (event_id % 30) || '.mkv' END AS rel, CASE event_type WHEN 'view' THEN 'Test' WHEN 'click' THEN 'Rename' ELSE 'Download' END AS event FROM events"


@query(f"SELECT DISTINCT series, rel FROM ({_MSG}) WHERE event = 'Download' AND series % 3 = 0 AND rel IS NOT NULL")
def stream_imports(spark, sf_dir):
    """JSON messages of imports in pieces, joined with a table of series; a file counts once within 40 days, after which the state forgets it."""
    k = F.col("event_id")
    event = F.when(F.col("event_type") == "view", "Test").when(F.col("event_type") == "click", "Rename").otherwise("Download")
    raw = F.to_json(F.struct(event.alias("eventType"), F.struct((F.col("user_id") % 40).alias("id")).alias("series"), F.struct(F.when(k % 5 != 0, F.concat(F.lit("e"), k % 30, F.lit(".mkv"))).alias("relativePath")).alias("episodeFile")))
    pieces = [p.select(F.col("ts").cast("timestamp").alias("time"), raw.alias("raw")) for p in _pieces(table(spark, sf_dir, "events"))]
    known = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("series")).where("series % 3 = 0").distinct()

    def build(stream):
        read = probe.import_events(stream.withWatermark("time", "40 days"), known, carried=("time",)).where("ignored is null")
        return read.dropDuplicatesWithinWatermark(["series", "rel"]).select("series", "rel")

    return _fed(spark, pieces, build)


@query("""WITH b AS (SELECT o_custkey AS series, CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE 2 END AS batch, o_orderkey % 50 AS rel, o_orderkey % 4 < 2 OR o_custkey % 2 = 0 AS started FROM orders WHERE o_orderkey % 4 != 3 GROUP BY ALL),
l AS (SELECT series, max(batch) AS last, max(batch) FILTER (NOT started) AS open FROM b GROUP BY 1),
a AS (SELECT DISTINCT o_custkey AS series, o_orderkey % 60 AS rel FROM orders WHERE o_orderkey % 3 = 0),
n AS (SELECT a.series, coalesce(open, last + 1, 1) AS batch, rel, false AS started FROM a LEFT JOIN l USING (series) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.series = a.series AND b.rel = a.rel AND NOT started))
SELECT series, batch::BIGINT AS batch, rel, started FROM (SELECT * FROM b UNION ALL SELECT * FROM n)""")
def waiting_batches(spark, sf_dir):
    """Arrivals join the batch of their series that still waits, or open the next."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    b = o.where(k % 4 != 3).select(c.alias("series"), F.when(k % 4 < 2, 1).otherwise(2).cast("long").alias("batch"), (k % 50).alias("rel"), ((k % 4 < 2) | (c % 2 == 0)).alias("started")).distinct()
    return grabs.joined_batches(b, o.where(k % 3 == 0).select(c.alias("series"), (k % 60).alias("rel")))


def _download_events(e):
    kinds = F.array(*map(F.lit, ("queued", "absent", "blocked", "imported", "queued", "absent", "queued", "failed")))
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    grab = F.col("user_id") * 100 + F.floor(F.dayofmonth("ts") / 3)
    kind = F.when(F.col("event_type") == "signup", "grabbed").otherwise(F.get(kinds, (F.col("event_id") % 8).cast("int")))
    return e.select(grab.alias("grab"), at.alias("at"), kind.alias("kind"))


@query()
def followed_downloads(spark, sf_dir):
    """What comes of each download up to ten minutes before the last event, from all events at once."""
    rows = _download_events(table(spark, sf_dir, "events"))
    now = rows.agg(F.max("at")).first()[0] or 0.0
    return downloads.followed(rows, "grab", float(int(now)) - 600)


@query()
def stream_downloads(spark, sf_dir):
    """The same as `followed_downloads`, from a stream in pieces with late rows."""
    events = table(spark, sf_dir, "events")
    buckets = max(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), events.count() // 10_000)
    return _fed(spark, [_download_events(p) for p in _pieces(events)], lambda s: downloads.follow(s, "grab", buckets=buckets))
