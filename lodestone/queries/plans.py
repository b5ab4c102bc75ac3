"""Queries of whole plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as V
from ..plans import build as B
from ..plans import chain
from ..plans import claims as P
from ..plans import history as H
from ..registry import query
from .common import table

def _code(c):
    return F.format_string("S%02dE%02d", F.floor(c / 10).cast("long") + 1, c % 10 + 1)


def plan_input(spark, sf_dir):
    """An order is a file, its lines are segments; forty episodes, every ninth with a doubtful reference."""
    li = table(spark, sf_dir, "lineitem").withColumn("file", F.format_string("f%08d", F.col("l_orderkey")))
    n = F.col("l_linenumber").cast("double")
    segment = F.struct(
        ((n - 1) * 600).alias("start"), (n * 600 - F.when(F.col("l_tax") > 0.07, 600).otherwise(F.col("l_suppkey") % 40)).alias("end"), _code(F.col("l_partkey") % 40).alias("code"), (F.floor(F.col("l_quantity")) / 50).alias("score"),
        F.when(F.col("l_discount") > 0.01, "high").otherwise("low").alias("confidence"), F.when((F.col("l_discount") <= 0.01) & (F.col("l_suppkey") % 3 == 0), _code(F.col("l_suppkey") % 40)).alias("model_code"),
        F.lit(None).cast("string").alias("override"), (F.col("l_suppkey") % 11 == 0).alias("title_card"),
    )
    files = li.groupBy("file", "l_orderkey").agg(F.sort_array(F.collect_list(segment)).alias("segments"))
    first = F.get("segments", F.lit(0))["code"]
    k = F.col("l_orderkey")
    named = F.when(k % 4 == 0, F.array(first)).when(k % 4 == 1, F.array(_code(k % 40))).when(k % 4 == 2, F.transform("segments", lambda s: s["code"])).otherwise(F.array(first, F.when(k % 3 == 0, "S09E01").otherwise(_code((k + 1) % 40))))
    files = files.select("file", F.when(k % 29 == 0, "NO_TEXT").when(k % 4 == 2, "OK").otherwise("MISMATCH").alias("status"), named.alias("expected"), (F.size("segments") * 600.0).alias("duration"), (k % 31 == 0).alias("hold"), "segments")
    overrides = li.where("l_orderkey % 37 = 0 and l_linenumber <= 2").groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", _code(F.col("l_partkey") % 39).alias("c")))), lambda x: x["c"]).alias("codes"))
    e = spark.range(40).withColumnRenamed("id", "n")
    episodes = e.select(_code(F.col("n")).alias("code"), (F.floor(F.col("n") / 10) + 1).alias("season"), (F.col("n") % 10 + 1).alias("number"), (F.col("n") % 9 == 0).alias("low_trust"))
    return files, episodes, overrides


@query()
def build_plan(spark, sf_dir):
    """Held against a plain loop over files in tests."""
    return B.build(*plan_input(spark, sf_dir)).orderBy("file")


def library_input(spark, sf_dir):
    """Twelve orders are a series of one season with as many episodes: an order is a file named for one of them, or in parts."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("double")
    code = lambda series, number: F.format_string("T%07dE%02d", series, F.pmod(number, F.lit(12)) + 1)
    li = table(spark, sf_dir, "lineitem").withColumn("series", F.floor(k / 12))
    own = F.when(k % 24 < 2, 0).when(F.col("l_suppkey") % 5 == 0, k + F.col("l_partkey") % 3).otherwise(k + n.cast("long") - 1)
    segment = F.struct(
        ((n - 1) * 600).alias("start"), (n * 600).alias("end"), code(F.col("series"), own).alias("code"), (F.floor(F.col("l_quantity")) / 50).alias("score"), F.when(k % 4 != 3, "high").otherwise("low").alias("confidence"),
        F.when((k % 4 == 3) & (F.col("l_suppkey") % 7 == 0), code(F.col("series"), own)).alias("model_code"), F.lit(None).cast("string").alias("override"), (F.col("l_suppkey") % 11 == 0).alias("title_card"),
    )
    lines = li.where("l_orderkey % 3 = 0 or l_linenumber = 1").groupBy("series", "l_orderkey").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    first = code(F.col("series"), k)
    named = F.when(k % 13 == 0, F.array().cast("array<string>")).when(k % 11 == 0, F.array(code(F.col("series"), k + 1))).when(k % 3 == 0, F.transform(F.sequence(F.lit(0).cast("long"), F.size("segments").cast("long") - 1), lambda i: code(F.col("series"), k + i))).otherwise(F.array(first))
    part = F.when(k % 24 < 4, F.concat(F.lit(" - Part "), (k % 2 + 1).cast("string"))).otherwise("")
    group = F.when(k % 24 < 4, F.floor(k / 2)).otherwise(-k)
    name = F.concat(F.lit("Season "), "series", F.lit("/show "), group.cast("string"), part, F.lit(".mkv"))
    named = F.when(k % 24 < 2, F.array(code(F.col("series"), F.lit(0)))).otherwise(named)
    files = lines.select(name.alias("file"), F.when(k % 29 == 0, "NO_TEXT").when(k % 4 == 2, "OK").otherwise("MISMATCH").alias("status"), named.alias("expected"), (F.size("segments") * 600.0).alias("duration"), (k % 31 == 0).alias("hold"), "segments", F.when(k % 2 == 0, F.col("series")).alias("season_hint"))
    overrides = files.where("season_hint % 19 = 0").select("file", F.array(code(F.col("season_hint"), F.lit(3))).alias("codes"))
    e = li.select("series").distinct().select("series", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n"))
    episodes = e.select(code(F.col("series"), F.col("n").cast("long")).alias("code"), F.col("series").alias("season"), F.col("n").cast("long").alias("number"), ((F.col("series") + F.col("n")) % 9 == 0).alias("low_trust"), (F.col("n") % 6 != 5).alias("aired"), F.when(F.col("series") % 4 == 0, 15.0).otherwise(90.0).alias("runtime"))
    return files, episodes, overrides


@query()
def whole_plan(spark, sf_dir):
    """The plans of all series in one chain; held against a plain loop in tests."""
    return chain.whole_plan(*library_input(spark, sf_dir))


@query("""WITH f AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_custkey % 2 AS sure, o_custkey % 5 AS own FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1) AND sure = 0 THEN 'release name' END AS evidence,
 CASE WHEN k = 0 AND sure = 0 THEN 'S01E01' WHEN k = 1 AND sure = 0 THEN 'S02E02' WHEN own = 1 THEN 'S01E01' ELSE 'S03E03' END AS code FROM f""")
def release_name_evidence(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.lit(None).cast("string")
    segment = F.struct(F.lit(0.0).alias("start"), F.lit(60.0).alias("end"), F.when(c % 5 == 1, "S01E01").otherwise("S03E03").alias("code"), F.lit(0.5).alias("score"), F.when(c % 2 == 1, "high").otherwise("low").alias("confidence"), text.alias("model_code"), text.alias("override"), F.lit(False).alias("title_card"))
    o = table(spark, sf_dir, "orders")
    files = o.select(k.alias("file"), F.array(F.lit("S01E01")).alias("expected"), F.lit(60.0).alias("duration"), F.array(segment).alias("segments"))
    verdicts = o.where("o_orderkey % 3 != 2").select(k.alias("file"), F.when(k % 3 == 0, "match").otherwise("other").alias("verdict"), F.when(k % 3 == 1, "S02E02").alias("code"))
    return B.by_release_name(files, verdicts).select(F.col("file").alias("o_orderkey"), "evidence", F.get("segments", F.lit(0))["code"].alias("code"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'new/' || o_orderkey ELSE o_orderkey::VARCHAR END AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'ok' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'rename' ELSE 'aside' END END AS kind, o_orderkey % 3 != 0 AS selected FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_custkey % 2 = 1)")
def plan_after_apply(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    items = o.select(k.cast("string").alias("file"), F.when(F.col("o_custkey") % 2 == 0, "rename").otherwise("aside").alias("kind"), F.lit("").alias("reason"), F.lit(True).alias("selected"))
    applied = o.where("o_orderkey % 3 = 0").select(k.cast("string").alias("file"))
    return B.after_apply(items, applied, applied.select("file", F.concat(F.lit("new/"), "file").alias("path"))).select("file", "kind", "selected")


@query("""WITH c AS (SELECT l_suppkey AS series, l_orderkey * 10 + l_linenumber AS place, (l_quantity * 2)::BIGINT AS mapped, 100 AS n, l_partkey % 9 = 0 AS same FROM lineitem), ok AS (SELECT * FROM c WHERE mapped > 0 AND (mapped >= 15 OR same)), s AS (SELECT series, min(place) AS stop FROM ok WHERE mapped >= 80 GROUP BY 1)
SELECT series, site, mapped FROM (SELECT ok.series, 'w' || place AS site, mapped, row_number() OVER (PARTITION BY ok.series ORDER BY mapped DESC, place) AS k FROM ok LEFT JOIN s ON s.series = ok.series WHERE stop IS NULL OR place <= stop) WHERE k = 1""")
def wiki_discovery(spark, sf_dir):
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series"), place.alias("place"), F.concat(F.lit("w"), place).alias("site"), (F.col("l_quantity") * 2).cast("long").alias("mapped"), F.lit(100).alias("episodes"), (F.col("l_partkey") % 9 == 0).alias("same_name"))
    return B.accepted_wikis(c)


@query("""WITH p AS (SELECT p_size, p_partkey AS a, p_name, p_partkey % 3 + 1 AS part FROM part WHERE p_partkey % 4 != 0)
SELECT x.p_size, x.a, y.a AS b FROM p x JOIN p y ON x.p_size = y.p_size AND x.p_name = y.p_name AND x.a != y.a AND abs(x.a - y.a) <= 400 AND x.part != y.part""")
def story_parts_near(spark, sf_dir):
    k = F.col("p_partkey")
    title = F.concat("p_name", F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit(" Part "), k % 3 + 1)).when(k % 4 == 2, F.concat(F.lit(" (pt. "), k % 3 + 1, F.lit(")"))).otherwise(F.concat(F.lit(", Part "), F.get(F.array(*map(F.lit, ("One", "II", "three"))), (k % 3).cast("int")))))
    return P.story_neighbours(table(spark, sf_dir, "part").select("p_size", "p_partkey", title.alias("title")), ["p_size"], "p_partkey", "title", 400)


@query("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1)::BIGINT AS place, l_partkey AS code, l_returnflag AS flag, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem")
def json_items(spark, sf_dir):
    x = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").alias("code"), F.col("l_returnflag").alias("flag"))))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(x).alias("raw"))
    rows = V.json_rows(docs, "l_orderkey", "raw", "struct<code:long,flag:string>")
    return rows.join(docs.select("l_orderkey", V.json_length(F.col("raw")).alias("n")), "l_orderkey")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'naming_format' ELSE 'season_folder_format' END AS name, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'unknown: {Air-Date}' WHEN p_partkey % 5 = 0 THEN 'anime series' END AS note FROM part WHERE p_partkey % 3 != 2")
def settings_import(spark, sf_dir):
    k = F.col("p_partkey")
    value = F.concat(F.lit("{Series Title} S{season:00}"), F.when((k % 3 == 0) & (k % 2 == 0), " {Air-Date}").otherwise(""))
    name = F.when(k % 3 == 0, "standardEpisodeFormat").when(k % 3 == 1, "seasonFolderFormat").otherwise("other")
    remote = table(spark, sf_dir, "part").select(name.alias("name"), value.alias("value"), F.when(k % 5 == 0, "anime").otherwise("standard").alias("type"), "p_partkey")
    out = V.imported_settings(remote.withColumn("value", F.concat("value", F.lit("|"), "p_partkey")), {"standardEpisodeFormat": "naming_format", "seasonFolderFormat": "season_folder_format"})
    return out.select(F.regexp_extract("value", r"\|(\d+)$", 1).cast("long").alias("p_partkey"), "name", "note")


def _two_applies(spark, sf_dir):
    """Files f(k) trade places in pairs, and then every third place's file goes on to a new name."""
    k = F.col("o_orderkey")
    other = k + 1 - 2 * (k % 2)
    moves = table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("f"), k).alias("src"), F.concat(F.lit("f"), other).alias("dst"), other.alias("other"))
    first = P.rename_ops(moves.select("src", "dst"), "src", "dst")
    second = moves.where("other % 3 = 0").select((F.lit(1 << 40) + F.col("other")).alias("ordinal"), F.lit("move").alias("op"), F.col("dst").alias("src"), F.concat(F.lit("g"), "other").alias("dst"))
    return moves, first.unionByName(second)


@query("WITH m AS (SELECT o_orderkey AS k, o_orderkey + 1 - 2 * (o_orderkey % 2) AS other, o_totalprice AS price FROM orders) SELECT 'f' || k AS file, 'f' || k AS before, price FROM m")
def scan_after_undo(spark, sf_dir):
    """A scan made after two applies, brought back through the log to the names before both."""
    moves, ops = _two_applies(spark, sf_dir)
    place = F.when(F.col("other") % 3 == 0, F.concat(F.lit("g"), "other")).otherwise(F.col("dst"))
    price = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return H.restored(moves.join(price, "k").select(place.alias("file"), F.col("src").alias("before"), "price"), ops)


@query("WITH m AS (SELECT o_orderkey AS k, o_orderkey + 1 - 2 * (o_orderkey % 2) AS other FROM orders) SELECT CASE WHEN other % 3 = 0 THEN 'g' ELSE 'f' END || other AS now, 'f' || k AS before FROM m")
def names_before_applies(spark, sf_dir):
    return H.names_before(_two_applies(spark, sf_dir)[1])


@query("SELECT 'o' || o_orderkey AS file, CASE WHEN o_orderkey % 3 != 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN ['new'] ELSE ['old'] END AS expected FROM orders WHERE o_orderkey % 5 != 0")
def scan_with_new_files(spark, sf_dir):
    """The last scan has two thirds of the files, the listing four fifths."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("file", F.concat(F.lit("o"), k))
    scan = o.where("o_orderkey % 3 != 0").select("file", F.col("o_orderstatus").alias("status"), F.array(F.lit("old")).alias("expected"))
    return H.with_new_files(scan, o.where("o_orderkey % 5 != 0").select("file", F.array(F.lit("new")).alias("expected")))


_PAGE = r"SELECT page_id, page_id % 20 AS site, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS page, regexp_extract(url, '//([^/.:]+)', 1) AS title FROM pages WHERE url IS NOT NULL"


@query(f"""WITH p AS ({_PAGE}), q AS (SELECT site, page_id, left(page, strpos(page, title) - 1) || '{{title}}' || substr(page, strpos(page, title) + length(title)) AS pattern FROM p WHERE title != '' AND strpos(page, title) > 0)
SELECT site, pattern, n FROM (SELECT site, pattern, count(*) AS n, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, min(page_id), pattern) AS k FROM q GROUP BY site, pattern) WHERE k = 1""")
def page_pattern(spark, sf_dir):
    """The form that most addresses of a site have, host names as titles."""
    p = table(spark, sf_dir, "pages").where("url is not null")
    return H.page_pattern(p.select((F.col("page_id") % 20).alias("site"), "page_id", F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("page"), F.regexp_extract("url", "//([^/.:]+)", 1).alias("title")), "site", "page", "title", "page_id")
