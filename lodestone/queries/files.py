"""Queries of files: subtitle files read back, cuts, starts, frames, caches, operations and checks."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from ..operators import library, names, views
from ..plans import claims
from ..registry import query
from ..sources import timedtext
from ..streaming import memory
from .common import scratch, table


def write_subtitles(spark, sf_dir, folder):
    """Each conversation as a subtitle file in one of four encodings and three formats; tasks write them."""
    k, t = F.col("conv_id"), F.col("turn")
    clock = lambda s, point: F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(point))
    said = F.concat(F.lit("Turn "), t, F.lit(" café"))
    ass = F.concat(F.lit("Dialogue: 0,"), clock(t * 5, ".00"), F.lit(","), clock(t * 5 + 4, ".00"), F.lit(",x,,0,0,0,,"), said)
    srt = F.concat(t.cast("string"), F.lit("\n"), clock(t * 5, ",000"), F.lit(" --> "), clock(t * 5 + 4, ",000"), F.lit("\n"), said, F.lit("\n"))
    cue = F.when(k % 3 == 2, ass).otherwise(srt)
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n").alias("body"))
    head = F.when(k % 3 == 1, "WEBVTT\n\n").when(k % 3 == 2, "[Script Info]\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n").otherwise("")
    ext = F.get(F.array(*map(F.lit, ("srt", "vtt", "ass"))), (k % 3).cast("int"))
    code = F.get(F.array(*map(F.lit, ("utf-8", "utf-8-sig", "utf-16", "cp1252"))), (k % 4).cast("int"))

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root)
        for batch in batches:
            for name, encoding, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(text.encode(encoding))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.select(F.concat(F.lit("c"), k, F.lit("."), ext).alias("name"), code.alias("encoding"), F.concat(head, "body").alias("text")).mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


@query("SELECT conv_id, turn * 5.0 AS start, turn * 5.0 + 4 AS \"end\", 'Turn ' || turn || ' café' AS text FROM conversations")
def subtitle_files(spark, sf_dir):
    """Subtitle files in four encodings and three formats, written from the table and read by the data source."""
    folder = scratch(spark, "subtitles")
    write_subtitles(spark, sf_dir, folder)
    cues = timedtext.read_cues(spark, folder)
    return cues.select(F.regexp_extract("path", r"c(\d+)\.\w+$", 1).cast("long").alias("conv_id"), "start", "end", "text")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 != 0 AND (SELECT count(*) FROM nation WHERE n_nationkey < 0) = 0")
def cache_prune(spark, sf_dir):
    """Entries that no file needs, as all roots are there."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    roots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("root"), (F.col("n_nationkey") >= 0).alias("there"))
    return views.pruned(o, o.where("o_orderkey % 3 = 0"), "o_orderkey", roots)


@query("SELECT o_orderkey FROM orders WHERE false")
def cache_prune_refused(spark, sf_dir):
    """Nothing is given up while a root is missing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    roots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("root"), (F.col("n_nationkey") != 3).alias("there"))
    return views.pruned(o, o.where("o_orderkey % 3 = 0"), "o_orderkey", roots)


@query("SELECT 'n' || o_orderkey AS src, 'o' || o_orderkey AS dst FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 != 0")
def undo_conflicts(spark, sf_dir):
    """Names to which an undo would bring files back, but which others have taken in the meantime and no step clears."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    undo = o.select(F.concat(F.lit("n"), k).alias("src"), F.concat(F.lit("o"), k).alias("dst")).unionByName(o.where("o_orderkey % 7 = 0").select(F.concat(F.lit("o"), k).alias("src"), F.concat(F.lit("p"), k).alias("dst")))
    return claims.undo_conflicts(undo, o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("o"), k).alias("path")))


@query("SELECT o_orderkey, 'f' || o_orderkey AS path FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 5 = 0")
def checked_again(spark, sf_dir):
    """Files without a result, and those that are asked for."""
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), k).alias("path"))
    return library.checked_again(files, files.where("o_orderkey % 4 != 0"), files.where("o_orderkey % 5 = 0"), "o_orderkey")


@query("SELECT o_custkey, o_orderkey AS rel, o_orderstatus AS raw FROM orders WHERE o_custkey % 3 != 0 OR o_orderstatus = 'F'")
def after_full_scan(spark, sf_dir):
    """Of what is remembered of imports, a full scan of every third series leaves the good outcomes."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("rel"), F.when(F.col("o_orderstatus") == "F", memory.GOOD[0]).otherwise("MISMATCH").alias("status"), F.col("o_orderstatus").alias("raw"))
    return memory.after_full_scan(o, o.where("o_custkey % 3 = 0"), "o_custkey").select("o_custkey", "rel", "raw")


@query("""WITH f AS (SELECT user_id, event_id::DOUBLE AS t, event_type != 'error' AS big, CASE event_type WHEN 'view' THEN 'full' WHEN 'click' THEN 'partial' END AS hit FROM events),
s AS (SELECT * FROM f WHERE big AND coalesce(hit, '') != 'full' AND NOT EXISTS (SELECT 1 FROM f g WHERE g.user_id = f.user_id AND g.hit = 'full' AND g.t BETWEEN f.t - 40 AND f.t + 40)),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 300 THEN 0 ELSE 1 END AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS run FROM n),
g AS (SELECT user_id, min(t) AS start, max(t) AS "end" FROM r GROUP BY user_id, run)
SELECT user_id, start, "end", rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start - "end", start)::INT AS rank FROM g) WHERE rank <= 3""")
def unmatched_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hit = F.when(F.col("event_type") == "view", "full").when(F.col("event_type") == "click", "partial")
    return library.unmatched_runs(e.select("user_id", F.col("event_id").cast("double").alias("t"), (F.col("event_type") != "error").alias("big"), hit.alias("hit")), "user_id", 300.0, 40.0)


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id AS t, value AS a, (event_id % 50)::DOUBLE AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, k, a, b, t, true AS kept FROM s WHERE k = 1 UNION ALL
 SELECT s.user_id, s.k, CASE WHEN (abs(f.a - s.a) + abs(f.b - s.b)) / 2 >= 20 THEN s.a ELSE f.a END, CASE WHEN (abs(f.a - s.a) + abs(f.b - s.b)) / 2 >= 20 THEN s.b ELSE f.b END, s.t, (abs(f.a - s.a) + abs(f.b - s.b)) / 2 >= 20 FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
SELECT user_id, t AS event_id FROM f WHERE kept""")
def near_dup_frames(spark, sf_dir):
    """Frames that differ from the last one that was kept."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.array("value", (F.col("event_id") % 50).cast("double")).alias("v"))
    return views.kept_frames(e, "user_id", "event_id", "v", 20.0)


@query("""WITH x AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(CASE WHEN p_partkey % 3 = 0 THEN p_name || ' extra' WHEN p_partkey % 3 = 1 THEN 'zzz' ELSE split_part(p_name, ' ', 1) END), '[^a-z0-9]+', ' ', 'g')) AS b FROM part)
SELECT p_partkey, contains(a, b) OR contains(b, a) AS same FROM x""")
def titles_match(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    other = F.when(k % 3 == 0, F.concat(name, F.lit(" extra"))).when(k % 3 == 1, "zzz").otherwise(F.split_part(name, F.lit(" "), F.lit(1)))
    return table(spark, sf_dir, "part").select("p_partkey", names.titles_match(name, other).alias("same"))


@query("""WITH m AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0), c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 1),
p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 2 AND o_orderkey % 8 = 2)
SELECT op, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM (
 SELECT 'move' AS op, 'stands' || k AS src, 'parked/stands' || k AS dst FROM m WHERE k % 3 = 0
 UNION ALL SELECT 'move', 'f' || k, 'f' || k || '.tmp' FROM (SELECT k FROM m UNION ALL SELECT k FROM c UNION ALL SELECT k FROM p UNION ALL SELECT k + 4 FROM p)
 UNION ALL SELECT 'cut', 'f' || k || '.tmp', 'piece' || k || '-' || i FROM c, range(2) t(i)
 UNION ALL SELECT 'join', 'f' || k || '.tmp', 'whole' || j FROM (SELECT k, k AS j FROM p UNION ALL SELECT k + 4, k FROM p)
 UNION ALL SELECT 'move', 'f' || k || '.tmp', 'parked/f' || k FROM (SELECT k FROM c UNION ALL SELECT k FROM p UNION ALL SELECT k + 4 FROM p)
 UNION ALL SELECT 'move', 'f' || k || '.tmp', CASE WHEN k % 3 = 0 THEN 'stands' ELSE 'g' END || k FROM m) GROUP BY op""")
def operation_kinds(spark, sf_dir):
    """Moves, cuts, joins and what is parked for them, counted by kind of operation."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    f = lambda c: F.concat(F.lit("f"), c)
    moves = o.where("o_orderkey % 4 = 0").select(f(k).alias("src"), F.concat(F.when(k % 3 == 0, "stands").otherwise("g"), k).alias("dst"))
    halves = o.where("o_orderkey % 4 = 1").select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    cuts = halves.select(f(k).alias("src"), F.concat(F.lit("piece"), k, F.lit("-"), "i").alias("dst"), (F.col("i") * 100.0).alias("start"), (F.col("i") * 100.0 + 100).alias("end"))
    both = o.where("o_orderkey % 8 = 2").select(k, F.explode(F.array(F.lit(0), F.lit(4))).alias("i"))
    parts = both.select(f(k + F.col("i")).alias("src"), F.concat(F.lit("whole"), k).alias("dst"), F.col("i").alias("place"))
    present = o.select(f(k).alias("path")).unionByName(o.where("o_orderkey % 12 = 0").select(F.concat(F.lit("stands"), k).alias("path")))
    ops = claims.operations(moves, cuts, parts, present)
    return ops.groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))
