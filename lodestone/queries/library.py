"""Queries of names, listings and library views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming as N
from ..operators import library as L
from ..registry import query
from ..sources import probe as S
from .common import table

# ---- names
_TITLE = "p_name || CASE p_partkey % 4 WHEN 0 THEN ', the ''end''!' WHEN 1 THEN ' & (more)' WHEN 2 THEN '/b' ELSE '' END"


def _title():
    k = F.col("p_partkey") % 4
    return F.concat("p_name", F.when(k == 0, ", the 'end'!").when(k == 1, " & (more)").when(k == 2, "/b").otherwise(""))


@query("SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' the ''end''!' WHEN 1 THEN ' and more' WHEN 2 THEN ' b' ELSE '' END AS clean FROM part")
def scene_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.scene_title(F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(", the 'end'!"))).otherwise(_title())).alias("clean"))


_A = "p_partkey % 90"


@query(f"""SELECT p_partkey, upper(p_brand) || '.S' || lpad(p_size::VARCHAR, 2, '0') || 'E' || lpad(({_A})::VARCHAR, 2, '0') || '-E' || lpad(({_A} + 2)::VARCHAR, 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN ' [' || p_type || ']' ELSE '' END AS range,
 p_brand || ' - s' || p_size || 'x' || lpad(({_A})::VARCHAR, 3, '0') || ' - s' || p_size || 'x' || lpad(({_A} + 1)::VARCHAR, 3, '0') || ' - s' || p_size || 'x' || lpad(({_A} + 2)::VARCHAR, 3, '0') || ' ' || replace(p_name, ' ', '.') AS doubled,
 'plain ' || p_brand AS plain FROM part""")
def name_templates(spark, sf_dir):
    """Templates in both dialects: cases and separators from the token, padding, values that aren't there, three numbers."""
    a = F.col("p_partkey") % 90
    numbers = F.array(a, a + 1, a + 2)
    values = {"series": F.col("p_brand"), "title": F.col("p_name"), "quality": F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), "season": F.col("p_size"), "episode": a}
    ranged = N.render("{SERIES TITLE}.S{season:00}E{episode:00}{ [Quality Full]}", values, F.col("p_size"), numbers)
    doubled = N.render("{Series Title} - s{season}x{episode:03d} {Episode.Title}", values, F.col("p_size"), numbers, "duplicate")
    return table(spark, sf_dir, "part").select("p_partkey", ranged.alias("range"), doubled.alias("doubled"), N.render("plain {series}{-year}", values).alias("plain"))


@query("""WITH t AS (SELECT p_partkey, repeat(p_name || ' é', 1 + p_partkey % 5 * 2) AS a, repeat(p_brand || ' ', 1 + p_partkey % 7 * 2) AS b FROM part), s AS (SELECT p_partkey, regexp_replace(a, '[ .?]+$', '') AS a, regexp_replace(b, '[ .?]+$', '') AS b FROM t),
z AS (SELECT *, octet_length(encode(a)) AS la, octet_length(encode(b)) AS lb, (SELECT max(k) FROM range(0, 401) r(k) WHERE k <= len(a) AND octet_length(encode(a[1:k])) <= 97) AS cut FROM s)
SELECT p_partkey, CASE WHEN la + lb + 3 <= 100 THEN a || ' + ' || b WHEN la + lb + 3 <= 100 THEN a || '...' || b WHEN la + 3 <= 100 THEN a || '...' ELSE regexp_replace(a[1:cut], '[ .]+$', '') || '...' END AS title FROM z""")
def titles_in_budget(spark, sf_dir):
    """Two titles within 100 bytes."""
    k = F.col("p_partkey")
    titles = F.array(F.repeat(F.concat("p_name", F.lit(" é")), (1 + k % 5 * 2).cast("int")), F.repeat(F.concat("p_brand", F.lit(" ")), (1 + k % 7 * 2).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", N.joined_titles(N.prepared_titles(titles), F.lit(100)).alias("title"))


@query(f"SELECT p_partkey, p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' (1999)' ELSE '' END || ' - S' || lpad(p_size::VARCHAR, 2, '0') || 'E' || lpad(({_A})::VARCHAR, 2, '0') || ' - ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' HDTV-720p' ELSE '' END || '.mkv' AS name, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'S' || p_size WHEN p_size % 4 = 0 THEN 'Specials' ELSE 'Season ' || lpad((p_size % 4)::VARCHAR, 2, '0') END AS folder FROM part")
def episode_files(spark, sf_dir):
    k = F.col("p_partkey")
    name = N.episode_file("{Series TitleYear} - S{season:00}E{episode:00} - {Episode Title} {Quality Full}", F.concat("p_brand", F.when(k % 2 == 0, " (1999)").otherwise("")), F.lit(""), F.col("p_size"), F.array(k % 90), F.array(F.concat("p_name", F.lit(".?"))), F.when(k % 3 == 0, "HDTV-720p"), F.lit(".mkv"))
    folder = N.season_folder(F.col("p_size") % 4, k % 5 == 0, F.when(k % 7 == 0, F.concat(F.lit("S"), "p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), folder.alias("folder"))


# ---- probes
_PROBES = "SELECT p_partkey, p_size, p_retailprice FROM part"


def _probes(spark, sf_dir):
    k = F.col("p_partkey")
    s = lambda **x: F.struct(*[v.alias(n) for n, v in x.items()])
    tags = lambda **x: F.create_map(*[y for n, v in x.items() for y in (F.lit(n), v)])
    stream = lambda i, kind, codec, length, forced, picture, t: s(index=F.lit(i), codec_type=F.lit(kind), codec_name=codec, start_time=F.lit("0.5"), duration=length, disposition=s(forced=forced, attached_pic=picture), tags=t)
    no, text = F.lit(0), F.lit(None).cast("string")
    tag = F.format_string("%02d:%02d:%02d.500", F.floor(k / 3600).cast("long"), F.floor(k / 60).cast("long") % 60, k % 60)
    language = F.get(F.array(*map(F.lit, ("eng", "ger", "und"))), (k % 3).cast("int"))
    rows = F.array(
        stream(0, "video", F.lit("h264"), F.when(k % 2 == 0, F.col("p_retailprice").cast("string")).otherwise("N/A"), no, no, tags(DURATION=tag)), stream(1, "video", F.lit("mjpeg"), text, no, F.lit(1), tags(title=F.lit("cover"))),
        stream(2, "subtitle", F.lit("subrip"), text, (k % 5 == 0).cast("int"), no, tags(language=language, title=F.lit("SDH"))), stream(3, "subtitle", F.lit("ass"), text, no, no, tags(language=F.lit("eng"), title=F.when(k % 7 == 0, "Forced").otherwise("Full"))),
        stream(4, "subtitle", F.when(k % 4 == 0, "hdmv_pgs_subtitle").otherwise("subrip"), text, no, no, tags(language=F.lit("fre"), title=F.lit("x"))),
    )
    raw = F.when(k % 11 == 0, "broken {").otherwise(F.to_json(s(format=s(duration=F.col("p_retailprice").cast("string")), streams=rows)))
    return S.probed(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", raw.alias("raw")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 0.0 ELSE p_retailprice END AS duration, coalesce(p_partkey % 11 != 0 AND p_partkey % 4 = 0, false) AS image FROM part")
def probe_facts(spark, sf_dir):
    return _probes(spark, sf_dir).select("p_partkey", "duration", F.coalesce(S.has_image_subtitles(F.col("probe")), F.lit(False)).alias("image"))


@query("SELECT p_partkey, 'video' AS type, 'h264' AS codec, 0.5::DOUBLE AS start, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_partkey + 0.5 END::DOUBLE AS length FROM part WHERE p_partkey % 11 != 0")
def stream_lengths(spark, sf_dir):
    return S.streams(_probes(spark, sf_dir), "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 != 0 THEN 3 WHEN p_partkey % 3 = 1 OR p_partkey % 5 = 0 THEN 3 ELSE 2 END::INT AS index FROM part WHERE p_partkey % 11 != 0")
def subtitle_stream(spark, sf_dir):
    return S.subtitle_stream(_probes(spark, sf_dir), "p_partkey", "en").withColumn("index", F.col("index").cast("int"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'sidecar' WHEN o_orderkey % 5 = 0 THEN 'embedded' WHEN o_orderkey % 7 = 0 THEN 'speech' ELSE 'none' END AS source, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN o_orderstatus END AS text FROM orders")
def dialogue_source(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = lambda n, c: o.where(f"o_orderkey % {n} = 0").select("o_orderkey", F.col(c).alias("text"))
    blank = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("  ").alias("text"))
    return S.dialogue(o, "o_orderkey", [("empty", blank), ("sidecar", rows(3, "o_orderpriority")), ("embedded", rows(5, "o_orderstatus")), ("speech", rows(7, "o_orderstatus"))])


@query("""WITH f AS (SELECT l_suppkey AS site, l_partkey % 100 AS title, CASE WHEN l_linenumber < 2 THEN 0 WHEN l_linenumber < 5 THEN 1 ELSE 2 END AS k FROM lineitem), c AS (SELECT site, min(k) AS last FROM (SELECT site, k FROM f GROUP BY 1, 2 HAVING count(DISTINCT title) >= 20) GROUP BY 1)
SELECT site, title, ['category', 'search', 'all'][1 + min(k)] AS how FROM f LEFT JOIN c USING (site) GROUP BY site, title, last HAVING last IS NULL OR min(k) <= last""")
def pages_found(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), (F.col("l_partkey") % 100).alias("title"), "l_linenumber")
    return S.pages_found([("category", li.where("l_linenumber < 2")), ("search", li.where("l_linenumber between 2 and 4")), ("all", li.where("l_linenumber > 4"))])


_WEB = "SELECT o_orderkey, o_custkey AS series, CASE o_orderkey % 4 WHEN 0 THEN 'Download' WHEN 1 THEN 'Test' WHEN 2 THEN 'Rename' ELSE 'Download' END AS event, CASE WHEN o_orderkey % 8 != 0 THEN o_orderpriority END AS rel FROM orders"


@query(f"SELECT series, rel, CASE WHEN event = 'Test' THEN 'test' WHEN event != 'Download' THEN event || ' event' WHEN series % 3 != 0 THEN 'unknown series' WHEN rel IS NULL THEN 'no file' END AS ignored FROM ({_WEB})")
def import_messages(spark, sf_dir):
    k = F.col("o_orderkey")
    event = F.when(k % 4 == 1, "Test").when(k % 4 == 2, "Rename").otherwise("Download")
    raw = F.to_json(F.struct(event.alias("eventType"), F.struct(F.col("o_custkey").alias("id")).alias("series"), F.struct(F.when(k % 8 != 0, F.col("o_orderpriority")).alias("relativePath")).alias("episodeFile")))
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("series"))
    return S.import_events(table(spark, sf_dir, "orders").select(raw.alias("raw")), known)


@query("SELECT conv_id, CASE WHEN len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) >= 48 AND len(text) >= 190 THEN CASE WHEN conv_id % 2 = 0 THEN 'subtitles' ELSE 'transcript' END END AS format FROM (SELECT conv_id, min(text) AS text FROM conversations GROUP BY 1)")
def pasted_references(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("text").alias("text"))
    raw = F.concat("text", F.when(F.col("conv_id") % 2 == 0, "\n0:00:01,000 -->").otherwise("\nname name "))
    return t.select("conv_id", S.pasted_reference(raw, F.lit(0) + 190 + F.length(raw) - F.length("text"), 50)["format"].alias("format"))


@query("SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN '1999' ELSE '' END AS year, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS number FROM (SELECT c_custkey, replace(c_name, '#', ' ') AS c_name FROM customer)")
def folder_names(spark, sf_dir):
    k = F.col("c_custkey")
    shown = F.replace("c_name", F.lit("#"), F.lit("_"))
    folder = F.concat(F.replace(shown, F.lit(" "), F.lit(".")), F.when(k % 2 == 0, " (1999)").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(" {catid-"), k, F.lit("}"))).otherwise(""))
    name, year, number = S.folder_query(folder)
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), year.alias("year"), number.alias("number"))


@query("""WITH r AS (SELECT o_custkey AS folder, o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 16 = 1 THEN 100 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 0 END AS points, o_orderkey AS place FROM orders),
b AS (SELECT folder, max(points) AS points FROM r GROUP BY 1), t AS (SELECT r.folder, b.points, min(r.place) AS id, count(*) AS tied FROM r JOIN b ON b.folder = r.folder AND b.points = r.points GROUP BY 1, 2)
SELECT folder::VARCHAR AS folder, id, points::INT AS points, points >= 100 OR (points >= 20 AND tied = 1) AS sure FROM t""")
def folder_resolution(spark, sf_dir):
    """An order is a search result for its customer's folder; every fourth customer's folder has the catalogue number of one
    of its orders of remainder 1 by 16, the first by name and place."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    numbered = o.where("o_custkey % 4 = 0 and o_orderkey % 16 = 1").groupBy("o_custkey").agg(F.min_by(k, F.struct(k % 3 != 0, k)).alias("number"))
    folder = F.concat(F.lit("Show "), "o_custkey", F.lit(" (2001)"), F.coalesce(F.concat(F.lit(" {catid-"), "number", F.lit("}")), F.lit("")))
    results = o.join(numbered, "o_custkey", "left").select(folder.alias("folder"), k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("The Show "), "o_custkey")).otherwise("Other").alias("name"), F.when(k % 2 == 0, "2001").otherwise("1990").alias("year"), k.alias("place"))
    return S.resolve_folders(results.select("folder").distinct(), results).withColumn("folder", F.regexp_extract("folder", r"Show (\d+)", 1))


@query("""SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'tv/' || p_brand WHEN 1 THEN 'kids/x/' || p_brand WHEN 2 THEN 'tv/' || p_brand ELSE NULL END AS folder FROM part WHERE p_partkey % 5 < 3 """)
def show_folders(spark, sf_dir):
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, F.concat(F.lit("/media/tv/"), "p_brand", F.lit("/Season 1/"), "p_name", F.lit(".txt"))).when(k == 1, F.concat(F.lit("/media/kids/x/"), "p_brand", F.lit("/"), "p_name", F.lit(".mkv"))).when(k == 2, F.concat(F.lit("/media/tv/"), "p_brand", F.lit("/extra/"), "p_name", F.lit(".avi"))).when(k == 3, F.concat(F.lit("/media/.x/"), "p_brand", F.lit("/a.mkv"))).otherwise(F.concat(F.lit("/media/docs/"), "p_brand", F.lit("/a.txt")))
    files = table(spark, sf_dir, "part").select(path.alias("path"))
    upper = table(spark, sf_dir, "part").where("p_partkey % 5 = 2").select(F.concat(F.lit("/media/tv/"), "p_brand", F.lit("/first.mkv")).alias("path"))
    return S.show_folders(files.unionByName(upper), "/media")


# ---- library views
@query("""WITH g AS (SELECT o_orderkey AS g, o_custkey % 7 AS norm, o_custkey AS ep, epoch(o_orderdate) AS tm FROM orders WHERE o_orderkey % 2 = 0), h AS (SELECT o_orderkey AS d, (o_custkey + o_orderkey % 3) % 7 AS norm, o_custkey AS ep, epoch(o_orderdate) AS tm FROM orders WHERE o_orderkey % 2 = 1),
j AS (SELECT g.g, h.d, h.tm, h.norm = g.norm AS same FROM g JOIN h ON h.ep = g.ep AND h.tm >= g.tm - 8640000), n AS (SELECT g, arg_min(d, {'a': tm, 'd': d}) AS named FROM j WHERE same GROUP BY g), f AS (SELECT g, arg_min(d, {'a': tm, 'd': d}) AS first FROM j WHERE d NOT IN (SELECT named FROM n) GROUP BY g)
SELECT g.g AS "grab", coalesce(named, first) AS download FROM g LEFT JOIN n USING (g) LEFT JOIN f USING (g)""")
def history_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    grabs = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("grab"), (F.col("o_custkey") % 7).alias("norm"), F.col("o_custkey").alias("episode"), at.alias("at"))
    history = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("download"), ((F.col("o_custkey") + F.col("o_orderkey") % 3) % 7).alias("norm"), F.col("o_custkey").alias("episode"), at.alias("at"))
    return L.matched_history(grabs, history, slack=8640000)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 != 0 AND o_orderkey % 2 = 0 THEN o_custkey END AS imdb FROM orders")
def carried_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    old = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "other").otherwise(F.col("o_orderstatus")).alias("title"), F.col("o_custkey").alias("imdb"))
    new = o.select("o_orderkey", F.col("o_orderstatus").alias("title"), F.lit(None).cast("long").alias("imdb"))
    return L.carried(new, old, ["o_orderkey"], "title", "imdb").select("o_orderkey", "imdb")


@query("SELECT l_orderkey, CASE WHEN s IS NOT NULL THEN s ELSE n END AS codes FROM (SELECT l_orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) FILTER (l_discount > 0.07) AS s, list(DISTINCT l_suppkey ORDER BY l_suppkey) AS n FROM lineitem GROUP BY 1)")
def file_contents(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.when(F.col("l_discount") > 0.07, F.col("l_partkey")))).alias("s"), F.sort_array(F.collect_set("l_suppkey")).alias("n"))
    return sets.select("l_orderkey", L.holds(F.col("s"), F.col("n")).alias("codes"))


@query("""SELECT l_partkey, id FROM (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_tax > 0.05 OR l_suppkey % 3 = 0) DESC, l_suppkey % 3 = 0 DESC, l_returnflag != 'A' DESC, l_quantity DESC, l_orderkey * 10 + l_linenumber) AS k FROM lineitem WHERE l_suppkey % 3 != 1 AND l_discount > 0.01) WHERE k = 1""")
def subtitle_pick(spark, sf_dir):
    named = F.when(F.col("l_suppkey") % 3 == 0, "match").when(F.col("l_suppkey") % 3 == 1, "other").otherwise("")
    found = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_tax") > 0.05).alias("title_fits"), named.alias("named"), (F.col("l_returnflag") == "A").alias("hearing_impaired"), F.col("l_quantity").alias("downloads"), (F.col("l_discount") > 0.01).alias("usable"))
    return L.subtitle_pick(found, "l_partkey")


@query("""WITH e AS (SELECT l_suppkey AS series, l_linenumber % 4 AS season, l_partkey AS episode FROM lineitem GROUP BY ALL), r AS (SELECT DISTINCT l_suppkey AS series, l_linenumber % 4 AS season, l_partkey AS episode FROM lineitem WHERE l_quantity > 25),
a AS (SELECT series, count(*) AS episodes, count(*) FILTER ((series, season, episode) IN (SELECT (series, season, episode) FROM r)) AS n FROM e WHERE season > 0 GROUP BY 1), c AS (SELECT l_suppkey AS series, count(*) FILTER (l_returnflag = 'R') AS bad, count(*) FILTER (l_returnflag = 'A') AS warn FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1), q AS (SELECT l_suppkey AS series, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1)
SELECT s_suppkey AS series, coalesce(episodes, 0) AS episodes, coalesce(n, 0) AS with_reference, coalesce(bad, 0) AS bad, coalesce(warn, 0) AS warn, coalesce(o, 0) AS open FROM supplier LEFT JOIN a ON a.series = s_suppkey LEFT JOIN c ON c.series = s_suppkey LEFT JOIN q ON q.series = s_suppkey""")
def dashboard(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("series", F.col("l_suppkey"))
    eps = li.select("series", (F.col("l_linenumber") % 4).alias("season"), F.col("l_partkey").alias("episode"), "l_quantity")
    checks = li.where("series % 2 = 0").select("series", F.when(F.col("l_returnflag") == "R", "bad").when(F.col("l_returnflag") == "A", "warn").otherwise("ok").alias("status"))
    asked = li.where("series % 3 = 0").select("series", (F.col("l_linestatus") != "O").alias("over"))
    return L.dashboard(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("series")), eps.select("series", "season", "episode").distinct(), eps.where("l_quantity > 25"), checks, asked)


@query("SELECT user_id, event_id, line::INT AS line FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - greatest(count(*) OVER (PARTITION BY user_id) - 30, 0) AS line FROM events) WHERE line > 0")
def log_tail(spark, sf_dir):
    return L.tail(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 30)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderkey DESC)::INT AS job_place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 = 0, o_orderkey % 5, o_orderkey)::INT AS catalogue_place FROM orders")
def list_orders(spark, sf_dir):
    from pyspark.sql.window import Window

    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), k.alias("id"), (k % 5).alias("season"), k.alias("episode"))
    place = lambda order: F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order))
    return o.select("o_orderkey", place(L.job_order()).alias("job_place"), place(L.catalogue_order()).alias("catalogue_place"))


@query("SELECT l_suppkey, season, episode FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY season, episode) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, season ORDER BY episode) AS k FROM (SELECT DISTINCT l_suppkey, l_partkey % 6 AS season, l_partkey AS episode FROM lineitem) WHERE season > 0) WHERE k <= 2) WHERE n <= 6")
def probe_sample(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 6).alias("season"), F.col("l_partkey").alias("episode")).distinct()
    return L.probe_sample(e, "l_suppkey")


@query("""WITH m AS (SELECT user_id, (event_id / 3)::DOUBLE AS t, 'error in frame ' || (event_id % 10) AS message FROM events WHERE event_type != 'view'), c AS (SELECT user_id, count(*) AS errors FROM m GROUP BY 1) SELECT user_id, errors::BIGINT AS errors FROM c""")
def problem_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type != 'view'")
    m = e.select("user_id", (F.col("event_id") / 3).alias("t"), F.lit("error").alias("level"), F.concat(F.lit("error in  frame "), F.col("event_id") % 10, F.lit(" @ 0xff")).alias("message"))
    return L.problem_list(m, "user_id").select("user_id", "errors")
