"""Queries of the rules on single rows, each held against SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import references
from ..operators import rules as R
from ..registry import query
from .common import table

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 != 0 THEN {_DAY} END AS d FROM orders), a AS (SELECT *, bool_or(d IS NOT NULL) OVER (PARTITION BY o_custkey) AS dated FROM o)
SELECT o_orderkey, coalesce(d <= '1995-06-01', true) AS aired, NOT dated OR coalesce(d <= '1995-06-01', false) AS aired_if_dated FROM a""")
def aired(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    dated = o.groupBy("o_custkey").agg(F.bool_or(F.col("d").isNotNull()).alias("dated"))
    d, today = F.col("d"), F.lit("1995-06-01")
    return o.join(dated, "o_custkey").select("o_orderkey", R.aired(d, today).alias("aired"), R.aired_if_dated(d, today, F.col("dated")).alias("aired_if_dated"))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 5 > 0 OR (l_suppkey % 2 = 0 AND l_suppkey % 3 != 0) AS counts FROM lineitem")
def specials(spark, sf_dir):
    wanted = F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.counts(F.col("l_partkey") % 5, wanted).alias("counts"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AND CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 2 = 0 ELSE NOT coalesce(CASE WHEN o_orderkey % 5 != 0 THEN o_custkey % 7 = 0 END, true) END AS low FROM orders")
def low_trust(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    low = references.low_trust(F.col("o_orderstatus") == "F", F.when(k % 3 == 0, c % 2 == 0), F.when(k % 5 != 0, c % 7 == 0))
    return table(spark, sf_dir, "orders").select("o_orderkey", low.alias("low"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'the source files it under S01E' || p_size || ' ''' || p_name || '''' ELSE 'the source calls S01E1 ''' || p_name || '''' || CASE WHEN p_partkey % 2 = 0 THEN ' but the catalogue calls it ''' || p_brand || '''' ELSE '' END END
 || CASE WHEN p_partkey % 5 = 0 THEN '; ''' || p_name || ''' is S02E1 in the catalogue' ELSE '' END || '; it may hold another episode''s dialogue' AS note FROM part""")
def describe_conflict(spark, sf_dir):
    k = F.col("p_partkey")
    number = F.when(k % 3 == 0, F.concat(F.lit("S01E"), "p_size")).otherwise("S01E1")
    note = references.describe_conflict(F.when((k % 3 == 0), F.lit("-")).otherwise("S01E1"), number, F.col("p_name"), F.when(k % 5 == 0, "S02E1"), F.when(k % 2 == 0, F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", note.alias("note"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey = 3 ELSE c_custkey % 40 = c_nationkey END AS same FROM customer")
def same_series(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    ours = F.format_string("tt%07d", (n + 1).cast("long"))
    theirs = F.when(k % 4 != 0, (k % 40 + 1).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", R.same_series(theirs, ours, n == 3).alias("same"))


_LOG = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'fatal' END AS level, CASE event_id % 7 WHEN 0 THEN 'corrupt frame' WHEN 1 THEN 'deprecated pixel format' WHEN 2 THEN '[null] Invalid' WHEN 3 THEN 'non monotonically increasing dts to muxer in stream 0' WHEN 4 THEN 'Skipping NAL' ELSE 'all fine' END AS message FROM events"


@query(f"SELECT event_id, level IN ('error', 'fatal', 'warning') AND (level != 'warning' OR event_id % 7 IN (0, 2, 3, 4)) AND event_id % 7 NOT IN (2, 3) AS damage FROM ({_LOG})")
def damage_messages(spark, sf_dir):
    k = F.col("event_id")
    pick = lambda mod, names: F.try_element_at(F.array(*map(F.lit, names)), (k % mod + 1).cast("int"))
    message = pick(7, ("corrupt frame", "deprecated pixel format", "[null] Invalid", "non monotonically increasing dts to muxer in stream 0", "Skipping NAL", "all fine", "all fine"))
    return table(spark, sf_dir, "events").select("event_id", R.damage_message(pick(4, ("error", "warning", "info", "fatal")), message).alias("damage"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 6 AS code, [l_suppkey % 6, l_suppkey % 4] AS expected, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 6 END AS named, l_quantity * 10 AS words, l_quantity * 10 * (1 + l_linenumber % 3 / 2.0) AS refwords, l_discount * 6 AS score FROM lineitem)
SELECT l_orderkey, l_linenumber, words >= 200 AND refwords >= 1.8 * words AS broad, NOT list_contains(expected, code) AND NOT list_has_any(CASE WHEN named IS NULL THEN expected ELSE [named] END, [0, 1, 2]) AND (score < 0.35 OR (words >= 200 AND refwords >= 1.8 * words)) AS discounted FROM s""")
def discount_unreferenced(spark, sf_dir):
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    words = F.col("l_quantity") * 10
    reference = words * (1 + n % 3 / 2.0)
    out = R.unreferenced(p % 6, F.array(s % 6, s % 4), F.when(n % 2 == 0, s % 6), F.array(*[F.lit(k).cast("long") for k in range(3)]), words, reference, F.col("l_discount") * 6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.broad_reference(words, reference).alias("broad"), out.alias("discounted"))


@query("SELECT event_id, event_id % 5 != 0 AND event_type != 'view' AND CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 4 END >= 2 AS clear FROM events")
def clear_card(spark, sf_dir):
    k = F.col("event_id")
    clear = R.clear_card(F.when(k % 5 == 0, True), F.when(F.col("event_type") != "view", F.col("event_type")), F.when(k % 3 != 0, k % 4))
    return table(spark, sf_dir, "events").select("event_id", clear.alias("clear"))


_KIND = "['rename', 'split', 'aside', 'join', 'review', 'ok'][1 + o_orderkey % 6]"


@query(f"WITH i AS (SELECT {_KIND} AS kind, o_custkey % 9 = 0 AS damaged FROM orders) SELECT v AS view, count(*) AS n FROM i, (VALUES ('all'), ('damaged'), ('actions'), ('review'), ('ok')) t(v) WHERE v = 'all' OR (v = 'damaged' AND damaged) OR (v = 'actions' AND kind IN ('rename', 'split', 'aside', 'join')) OR v = kind GROUP BY v")
def plan_views(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ("rename", "split", "aside", "join", "review", "ok"))), (F.col("o_orderkey") % 6).cast("int"))
    items = table(spark, sf_dir, "orders").select(kind.alias("kind"), (F.col("o_custkey") % 9 == 0).alias("damaged"))
    views = F.array(*map(F.lit, ("all", "damaged", "actions", "review", "ok")))
    mine = F.filter(views, lambda v: R.shown(F.col("kind"), F.col("damaged"), v))
    return items.select(F.explode(mine).alias("view")).groupBy("view").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, coalesce(o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_custkey % 2 = 0), false) AS blocked FROM orders")
def import_blocked(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "importBlocked").when(F.col("o_orderstatus") == "P", "importPending")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.import_blocked(state, F.when(F.col("o_custkey") % 2 == 0, "warning")).alias("blocked"))


@query("SELECT p_partkey, p_partkey % 6 IN (0, 1, 3, 5) AS inside FROM part")
def path_guard(spark, sf_dir):
    k = F.col("p_partkey") % 6
    name = F.col("p_name")
    path = F.when(k == 0, name).when(k == 1, F.concat(F.lit("/media/tv/./"), name)).when(k == 2, F.concat(F.lit("../"), name)).when(k == 3, F.concat(F.lit("a/../b//"), name)).when(k == 4, F.concat(F.lit("/media/tv2/"), name)).otherwise("/media/tv/a/..")
    return table(spark, sf_dir, "part").select("p_partkey", R.inside(path, F.lit("/media/tv")).alias("inside"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN l_suppkey WHEN l_discount > 0.05 THEN l_partkey WHEN l_linenumber = 2 THEN l_orderkey ELSE l_partkey END AS code, CASE WHEN l_partkey % 7 = 0 THEN 'manual' WHEN l_discount > 0.05 THEN 'high' WHEN l_linenumber = 2 THEN 'ai' ELSE 'low' END AS strength FROM lineitem")
def segment_strength(spark, sf_dir):
    c = R.segment_choice(F.when(F.col("l_partkey") % 7 == 0, F.col("l_suppkey")), F.when(F.col("l_discount") > 0.05, "high").otherwise("low"), F.col("l_partkey"), F.when(F.col("l_linenumber") == 2, F.col("l_orderkey")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.alias("c")).select("l_orderkey", "l_linenumber", "c.code", "c.strength")


@query("WITH c AS (SELECT o_orderkey, list(CASE WHEN l_linenumber % 5 != 0 THEN l_quantity END ORDER BY l_linenumber, l_partkey) AS cuts, max(l_linenumber) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), f AS (SELECT *, list_filter(cuts, lambda x: x IS NOT NULL) AS s FROM c) SELECT o_orderkey, len(cuts) = n + o_orderkey % 2 AND len(list_filter(s, lambda x: x <= 0)) = 0 AND list_sort(s) = s AND len(list_distinct(s)) = len(s) AS sound FROM f")
def cut_validation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).alias("q")))), lambda x: x["q"]).alias("cuts"), F.max("l_linenumber").alias("n"))
    return li.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", R.sound_cuts(F.col("cuts"), F.col("n") + F.col("o_orderkey") % 2 + 1).alias("sound"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS page, p_partkey % 3 != 2 AS same FROM part")
def page_tests(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    title = F.when(k % 4 == 0, F.concat(name, F.lit("/Transcript"))).when(k % 4 == 1, F.concat(F.lit("TRANSCRIPT: "), name)).when(k % 4 == 2, " Transcripts ").otherwise(name)
    site = F.when(k % 3 == 0, F.concat(name, F.lit(" Wiki"))).when(k % 3 == 1, F.concat(F.lit("The "), F.upper(name), F.lit(" Database"))).otherwise("Wiki")
    return table(spark, sf_dir, "part").select("p_partkey", R.transcript_page(title).alias("page"), R.same_show(site, F.concat(name, F.lit(" (1999)"))).alias("same"))


@query("SELECT o_orderkey, s IN ('imported', 'cancelled') OR (s = 'failed' AND (o_custkey % 2 = 0 OR o_custkey % 3 = 0 OR o_custkey % 5 = 0)) AS over FROM (SELECT *, ['imported', 'cancelled', 'failed', 'waiting'][1 + o_orderkey % 4] AS s FROM orders)")
def finished_requests(spark, sf_dir):
    c = F.col("o_custkey")
    status = F.get(F.array(*map(F.lit, ("imported", "cancelled", "failed", "waiting"))), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.over(status, F.when(c % 2 != 0, True), c % 3 == 0, F.when(c % 5 == 0, True)).alias("over"))


_SETS = "SELECT l_suppkey, list(DISTINCT l_partkey % 4) FILTER (l_linenumber = 1) AS a, list(DISTINCT l_partkey % 4) AS b, list(DISTINCT l_orderkey % 3) FILTER (l_quantity > 45) AS c FROM lineitem GROUP BY 1"


@query(f"SELECT l_suppkey, len(a) < len(b) AS part, list_sort(list_distinct(list_concat(a, c))) AS either FROM ({_SETS}) WHERE a IS NOT NULL AND c IS NOT NULL")
def set_tests(spark, sf_dir):
    """Proper subsets (partial evidence) and unions without repeats (files of a waiting batch)."""
    s = lambda mod, when: F.collect_set(F.when(when, F.col(mod[0]) % mod[1]))
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(s(("l_partkey", 4), F.col("l_linenumber") == 1).alias("a"), s(("l_partkey", 4), F.lit(True)).alias("b"), s(("l_orderkey", 3), F.col("l_quantity") > 45).alias("c")).where("size(a) > 0 and size(c) > 0")
    return g.select("l_suppkey", R.proper_subset(F.col("a"), F.col("b")).alias("part"), F.sort_array(F.array_union("a", "c")).alias("either"))


@query("SELECT l_orderkey, l_linenumber, abs(l_quantity * 20 - (l_quantity * 20 + l_linenumber * 2 - 4)) <= greatest(3, 0.02 * l_quantity * 20) AS fits FROM lineitem")
def piece_tolerance(spark, sf_dir):
    wanted = F.col("l_quantity") * 20
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", R.within_tolerance(wanted + F.col("l_linenumber") * 2 - 4, wanted).alias("fits"))


_AT = "CASE WHEN event_id % 5 = 0 THEN 'unknown' WHEN event_id % 5 = 1 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END"


@query("SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 0 ELSE epoch(TIMESTAMP '2030-01-01') - floor(epoch(ts)) END::BIGINT AS age, event_id % 3 > 0 AND (event_id % 5 < 2 OR epoch(TIMESTAMP '2030-01-01') - floor(epoch(ts)) >= (event_id % 3) * 20000 * 3600) AS due FROM events")
def elapsed_and_due(spark, sf_dir):
    k = F.col("event_id")
    at = F.when(k % 5 == 0, "unknown").when(k % 5 > 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", R.elapsed(at, now).alias("age"), R.due(at, now, k % 3 * 20000).alias("due"))


@query("SELECT p_partkey, ['extend', 'duplicate', 'prefixed_range', 'smart', 'smart'][1 + p_partkey % 5] AS style, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS flag, CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE p_size END::INT AS number FROM part")
def settings_coercion(spark, sf_dir):
    """Names of another system's settings, by number or by name, and settings as text."""
    k = F.col("p_partkey")
    pick = lambda mod, *names: F.get(F.array(*map(F.lit, names)), (k % mod).cast("int"))
    styles = ("extend", "duplicate", "repeat", "scene", "range", "prefixed_range")
    style = R.mapped(pick(5, "0", "Duplicate", "prefixedRange", "9", "other"), styles, "smart")
    return table(spark, sf_dir, "part").select("p_partkey", style.alias("style"), R.coerced(pick(4, " Yes", "off", "maybe", "2"), "boolean", F.lit(None).cast("boolean")).alias("flag"), R.coerced(F.when(k % 3 == 0, "many").otherwise(F.concat(F.lit(" "), "p_size")), "int", F.lit(7)).alias("number"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/media/tv/old/' || p_name ELSE '/media/' || p_name || '/old' END AS root, CASE WHEN p_partkey % 2 = 0 THEN '../old/' || p_name ELSE 'old' END AS relative FROM part")
def backup_paths(spark, sf_dir):
    series = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/media/tv/"), "p_name")).otherwise(F.concat(F.lit("/media/"), "p_name"))
    media = F.lit("/media/tv")
    return table(spark, sf_dir, "part").select("p_partkey", R.backup_root(series, media, F.lit("old")).alias("root"), R.backup_relative(series, media, F.lit("old")).alias("relative"))


@query("SELECT l_orderkey, list(CASE WHEN l_linenumber % 2 = 0 THEN '../old/x/' || l_partkey ELSE 'older/' || l_partkey END ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem GROUP BY 1")
def backup_prefix_moved(spark, sf_dir):
    op = F.struct("l_linenumber", "l_partkey", F.lit("s").alias("src"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, "old/").otherwise("older/"), "l_partkey").alias("dst"))
    logs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(op)).alias("log"))
    moved = R.moved_prefix(F.col("log"), "old/", "../old/x/", ("src", "dst"))
    return logs.select("l_orderkey", F.transform(moved, lambda x: x["dst"]).alias("dst"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'none' WHEN o_orderkey % 4 = 1 THEN 'part' WHEN o_custkey % 2 = 0 AND o_orderkey % 4 = 2 THEN 'contradicts' END AS reason FROM orders")
def vision_reason(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    card = F.struct(F.when(k == 0, 99.0).otherwise(5.0).alias("time"), F.when(k == 2, "S01E09").otherwise("S01E01").alias("code"), (k == 1).alias("partial"))
    said = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("S01E01"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.vision_reason(F.array(card), F.lit(60.0), said).alias("reason"))


@query("SELECT p_partkey, p_partkey % 3 != 2 AS only FROM part")
def name_words_only(spark, sf_dir):
    k = F.col("p_partkey") % 3
    words = F.filter(F.split(F.lower("p_name"), "[^a-z0-9]+"), lambda w: w != "")
    joined = X.norm_nospace(F.col("p_name"))
    text = F.when(k == 0, joined).when(k == 1, F.concat(joined, F.get(words, F.lit(0)))).otherwise(F.concat(joined, F.lit("9q")))
    return table(spark, sf_dir, "part").select("p_partkey", R.name_words_only(text, words).alias("only"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 END, o_orderstatus = 'F') AS selected FROM orders")
def kept_ticks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"), (F.col("o_orderstatus") == "F").alias("selected"))
    before = o.where("o_orderkey % 3 = 0").withColumn("selected", F.col("o_orderkey") % 2 == 0)
    return R.settled_ticks(o, before, ["o_orderkey", "kind"]).select("o_orderkey", "selected")


# ---- text functions that other operators use
@query("SELECT p_partkey, p_name AS core, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 END::BIGINT AS part FROM part")
def page_core(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    title = F.when(k == 0, F.concat(name, F.lit("/Transcript"))).when(k == 1, F.concat(F.lit("Transcript: "), name)).when(k == 2, F.concat(name, F.lit(" (Season 2 episode)"))).otherwise(F.concat(name, F.lit(" (transcript)")))
    card = F.when(k == 0, "Part Two").when(k == 1, "the end pt. III").when(k == 2, "PART 1").otherwise("Party 4")
    return table(spark, sf_dir, "part").select("p_partkey", X.page_core(title).alias("core"), X.card_part(card).cast("long").alias("part"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'srt' ELSE 'ass' END AS format FROM part")
def subtitle_format(spark, sf_dir):
    from ..sources.subtitles import subtitle_format as of

    k = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", of(F.when(k == 0, "SSA").otherwise("srt"), F.when(k == 1, "[Script Info]\nTitle").otherwise("1\n00:00")).alias("format"))
