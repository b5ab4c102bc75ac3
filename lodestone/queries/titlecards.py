"""Queries of the title-card pass: recurring texts, fused evidence, two-phase reading, over events as what is seen in files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cardpass, fusion, model, titleindex
from ..registry import query
from .common import table

# a file is a user's day, a series a sixth of the users, an event a text on screen
_FILE = "user_id * 100 + day(ts)"


def _seen(spark, sf_dir):
    file = (F.col("user_id") * 100 + F.day("ts")).alias("file")
    code = F.concat(F.lit("c"), (F.col("event_id") % 9).cast("string"))
    return table(spark, sf_dir, "events").select((F.col("user_id") % 6).alias("series"), file, "event_id", F.col("value").alias("time"), code.alias("code"), F.concat(F.lit("text "), code).alias("text"), "event_type")


@query(f"""WITH e AS (SELECT user_id % 6 AS series, {_FILE} AS file, 'c' || (event_id % 9) AS code, value AS v FROM events),
f AS (SELECT series, file, row_number() OVER (PARTITION BY series ORDER BY file) - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM (SELECT DISTINCT series, file FROM e)),
s AS (SELECT series, file, least(12, n) AS sample FROM f WHERE k % greatest(1, n // 12) = 0 AND k < 12 * greatest(1, n // 12)),
r AS (SELECT e.*, sample FROM e JOIN s USING (series, file) WHERE code != 'c' || (file % 9)),
m AS (SELECT series, code, list_sort(list(v))[count(*) // 2 + 1] AS mid FROM r GROUP BY 1, 2)
SELECT series, code, round(any_value(mid), 1) AS "offset", count(DISTINCT file) FILTER (abs(v - mid) <= 8) AS files, 'text ' || code AS text FROM r JOIN m USING (series, code) GROUP BY series, code
HAVING count(DISTINCT file) FILTER (abs(v - mid) <= 8) >= 3 AND count(DISTINCT file) FILTER (abs(v - mid) <= 8) >= any_value(sample) / 3""")
def recurring_texts(spark, sf_dir):
    """Titles read at one point in several files of an even sample whose names say otherwise: opening titles."""
    seen = _seen(spark, sf_dir)
    sample = cardpass.sampled(seen.select("series", "file").distinct(), "series", "file")
    reads = seen.join(sample.select("file", "sample"), "file").where(F.col("code") != F.concat(F.lit("c"), (F.col("file") % 9).cast("string")))
    return cardpass.recurring_texts(reads.withColumnRenamed("time", "offset"), "series")


def _pass(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    partial, n = F.col("event_id") % 5 == 0, F.col("event_id") % 9
    could = F.array(F.col("code"), F.concat(F.lit("c"), ((n + 1) % 9).cast("string")))
    cards = seen.select("file", "time", F.when(~partial, F.col("code")).alias("code"), partial.alias("partial"), F.when(partial, could).alias("candidates"), "text", (1 + F.col("event_id") % 4).alias("frames"), (F.col("event_id") % 7 == 0).alias("pieced"))
    named = F.array(F.concat(F.lit("c"), (F.col("file") % 9).cast("string")))
    status = F.when(F.col("file") % 17 == 0, "ERROR").when(F.col("file") % 3 == 0, "OK").otherwise("MISMATCH")
    files = seen.select("series", "file").distinct().select("series", "file", status.alias("status"), F.lit(600.0).alias("duration"), named.alias("expected"), F.array(F.lit(0.0), F.lit(200.0)).alias("starts"), named.alias("sure"))
    return files, cards


@query()
def card_pass_found(spark, sf_dir):
    """The cards that a pass over all files finds, probe first and then the learned window."""
    return cardpass.card_pass(*_pass(spark, sf_dir), "series", always=True)[0]


@query()
def card_pass_series(spark, sf_dir):
    """How the probe of each series went, and where its cards come."""
    return cardpass.card_pass(*_pass(spark, sf_dir), "series")[1]


@query()
def fuse_cards(spark, sf_dir):
    """A user's days are files: purchases, signups and errors are stretches of dialogue, views and clicks title cards."""
    e = _seen(spark, sf_dir).withColumn("t", F.col("event_id") % 40 * 60.0)
    spoken, k = F.col("event_type").isin("purchase", "signup", "error"), F.col("event_id")
    code = lambda n: F.concat(F.lit("c"), (n % 5).cast("string"))
    segments = e.where(spoken).select("file", F.col("t").alias("start"), (F.col("t") + 400 + k % 400).alias("end"), code(k).alias("code"), F.lit(0.3).alias("score"), F.when(k % 3 == 0, "high").otherwise("low").alias("confidence"), F.array(code(k + 1)).alias("alternatives"), F.when(k % 4 == 0, code(F.col("file"))).alias("missing"))
    partial = k % 4 == 1
    cards = e.where(~spoken).select("file", F.col("t").alias("time"), F.when(~partial, code(k + 1)).alias("code"), partial.alias("partial"), F.when(partial, F.array(code(k), code(k + 1))).alias("candidates"), (1 + k % 3).alias("frames"), F.lit(0.9).alias("score"))
    file = F.col("file")
    expected = F.when(file % 3 == 0, F.array(code(file))).when(file % 3 == 1, F.array(code(file), code(file + 1))).otherwise(F.array().cast("array<string>"))
    files = e.select("file").distinct().select("file", F.lit(2800.0).alias("duration"), expected.alias("expected"), (file % 2 == 0).alias("trust"), F.lit(9).alias("words"))
    runtimes = e.select(code(k).alias("code"), F.lit(22.0).alias("minutes")).distinct()
    return fusion.fuse_cards(files, segments, cards, runtimes, "file")


@query()
def frame_best_read(spark, sf_dir):
    """A part is a frame that shows the words of its name on lines of their own, some misread or too small, and its type and brand below."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    titles = p.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"), "p_partkey").groupBy("title").agg(F.min("p_partkey").alias("code")).withColumn("part", F.lit(None).cast("long"))
    words = F.concat(F.split(F.upper("p_name"), " "), F.array(F.when(k % 3 == 0, F.regexp_replace("p_type", "O", "0")).otherwise(F.col("p_type")), F.when(k % 5 != 0, F.col("p_brand")).otherwise("written by")))
    lines = F.transform(words, lambda w, i: F.struct(w.alias("text"), F.when((k + i) % 11 == 0, 0.5).otherwise(0.95).alias("conf"), F.when((k + i) % 7 == 0, 0.04).otherwise(0.08).alias("height"), (0.1 * i).alias("y")))
    frames = p.select(k.alias("frame"), F.lit(20.0).alias("at"), lines.alias("lines"))
    recurring = titles.where("code % 500 = 0").select("code", F.lit(20.0).alias("offset"))
    return titleindex.match_frames(frames, titles, "frame", "code", recurring, ("brand", "small"))


_READS = """WITH f AS (SELECT user_id AS file, day(ts) // 10 AS start, CASE WHEN event_id % 2 = 0 THEN 'key' ELSE 'full' END AS mode, (event_id % 97)::DOUBLE AS t, event_type IN ('view', 'click') AS hit, event_type = 'click' AS partial, event_id % 5 != 0 AS fit FROM events),
r AS (SELECT file, start, mode, (file + start) % 3 = 0 AS complete, max(t) + 3 AS stopped_at, CASE WHEN file % 5 = 0 THEN 'old' ELSE 'new' END AS ocr, file % 7 AS read_at FROM f GROUP BY file, start, mode),
g AS (SELECT file, start, mode, min(t) FILTER (hit AND fit) AS first, min(t) FILTER (hit AND fit AND NOT partial) AS ff, bool_or(hit AND NOT partial) AS af, min(t) FILTER (hit) AS fa FROM f GROUP BY ALL),
u AS (SELECT file, start, mode, min(t) AS until FROM f JOIN g USING (file, start, mode) WHERE t > first + CASE WHEN ff < t THEN 6 ELSE 12 END GROUP BY ALL),
j AS (SELECT r.*, g.af, CASE WHEN NOT complete THEN until END AS until, ff, fa, complete OR until IS NOT NULL OR coalesce(stopped_at > first + CASE WHEN ff IS NOT NULL THEN 6 ELSE 12 END, false) AS usable FROM r LEFT JOIN g USING (file, start, mode) LEFT JOIN u USING (file, start, mode)),
k AS (SELECT *, ff IS NOT NULL AND (until IS NULL OR ff < until) AS fit, fa IS NOT NULL AND (until IS NULL OR fa < until) AS seen FROM j WHERE usable AND (ocr = 'new' OR af) AND read_at >= 2),
w AS (SELECT DISTINCT file, start FROM r), p AS (SELECT w.file, w.start, a.mode AS am, a.fit AS afit, a.until AS au, b.mode AS bm, b.seen AS bseen, b.until AS bu FROM w LEFT JOIN (SELECT * FROM k WHERE mode = 'key') a USING (file, start) LEFT JOIN (SELECT * FROM k WHERE mode = 'full') b USING (file, start)),
x AS (SELECT *, CASE WHEN am IS NULL THEN 'read key' WHEN afit THEN 'use key' WHEN bm IS NULL THEN 'read full' WHEN bseen THEN 'use full' ELSE 'use key' END AS action FROM p)"""


def _scan(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    frames = e.select(F.col("user_id").alias("file"), F.floor(F.day("ts") / 10).alias("start"), F.when(k % 2 == 0, "key").otherwise("full").alias("mode"), (k % 97).cast("double").alias("t"), F.col("event_type").isin("view", "click").alias("hit"), (F.col("event_type") == "click").alias("partial"), (k % 5 != 0).alias("fit"))
    file = F.col("file")
    reads = frames.groupBy("file", "start", "mode").agg((F.max("t") + 3).alias("stopped_at")).withColumns({"complete": (file + F.col("start")) % 3 == 0, "ocr": F.when(file % 5 == 0, "old").otherwise("new"), "read_at": file % 7})
    return frames.select("file", "start").distinct(), reads, frames, "new", F.lit(2)


@query(_READS + " SELECT file, start, action, CASE action WHEN 'use key' THEN au WHEN 'use full' THEN bu END AS until FROM x")
def frame_scan_plan(spark, sf_dir):
    """Which windows of frames suffice as they were read, judged by the present rules."""
    return cardpass.scan_plan(*_scan(spark, sf_dir))


@query(_READS + " SELECT file, start, CASE action WHEN 'read key' THEN 'key' ELSE 'full' END AS mode FROM x WHERE starts_with(action, 'read')")
def frame_scan_worklist(spark, sf_dir):
    return cardpass.planned_reads(*_scan(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN length(text) % 7 IN (doc_id % 7, 3) THEN 'E' || (length(text) % 7) END AS code, CASE WHEN length(text) % 7 IN (doc_id % 7, 3) THEN 0.5 END AS confidence FROM documents")
def model_answers(spark, sf_dir):
    """Answers through the hook, the model being one that counts characters."""
    def ask(prompts):
        return [f'Thinking... {{"episode": "e{len(p) % 7}", "confidence": 0.5, "reason": "length"}}' for p in prompts]

    could = F.array(F.concat(F.lit("E"), F.col("doc_id") % 7), F.lit("E3"))
    return model.asked(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), could, ask).select("doc_id", "code", "confidence")
