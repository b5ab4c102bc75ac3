"""Queries of planning: claims, plan items, elimination, parts, names and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views
from ..plans import claims as P
from ..plans import releases as R
from ..registry import query
from .common import table

# lines of an order claim parts: a part is an episode, an order a file
_CL = "SELECT l_partkey, (l_orderkey % 3)::BIGINT AS rank, l_linenumber % 2 = 0 AS named, l_discount AS score, l_orderkey AS path, l_linenumber::BIGINT AS start FROM lineitem"
_RK = f"SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY rank DESC, named DESC, score DESC, path DESC, start DESC) AS place FROM ({_CL})"


def _claims(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_partkey", (F.col("l_orderkey") % 3).alias("rank"), (F.col("l_linenumber") % 2 == 0).alias("named"), F.col("l_discount").alias("score"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("start"))


@query(f"SELECT l_partkey, rank, named, score, path, start FROM ({_RK}) WHERE place = 1")
def claims_winner(spark, sf_dir):
    return P.winners(_claims(spark, sf_dir), "l_partkey")


@query(f"SELECT path, count(*) AS lost FROM ({_RK}) WHERE place > 1 GROUP BY path")
def claims_lost(spark, sf_dir):
    return P.ranked_claims(_claims(spark, sf_dir), "l_partkey").where("place > 1").groupBy("path").agg(F.count("*").alias("lost"))


@query(f"SELECT l_partkey, list(path ORDER BY place) AS occupants FROM ({_RK}) WHERE place <= 3 GROUP BY 1")
def occupants(spark, sf_dir):
    top = P.ranked_claims(_claims(spark, sf_dir), "l_partkey").where("place <= 3")
    return top.groupBy("l_partkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("occupants"))


_FILES = "SELECT l_orderkey, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey) AS expected, list((l_partkey + CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END) % 5 ORDER BY CASE WHEN l_orderkey % 4 = 0 THEN -l_linenumber ELSE l_linenumber END, l_partkey) FILTER (l_quantity > 3) AS found, sum(l_quantity)::BIGINT AS words, min(l_discount) < 0.06 AS high FROM lineitem GROUP BY 1"


def _files(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    ordered = lambda rows: F.transform(F.sort_array(rows), lambda x: x["v"])
    code = (F.col("l_partkey") + F.when(F.col("l_quantity") > 48, 1).otherwise(0)) % 5
    seen = F.struct(F.when(F.col("l_orderkey") % 4 == 0, -line).otherwise(line).alias("k"), F.col("l_partkey"), code.alias("v"))
    return li.groupBy("l_orderkey").agg(
        ordered(F.collect_list(F.struct(line.alias("k"), "l_partkey", (F.col("l_partkey") % 5).alias("v")))).alias("expected"),
        ordered(F.collect_list(F.when(F.col("l_quantity") > 3, seen))).alias("found"),
        F.sum("l_quantity").cast("long").alias("words"), (F.min("l_discount") < 0.06).alias("high"),
    )


_STATUS = f"""WITH f AS ({_FILES}), g AS (SELECT l_orderkey, expected, coalesce(found, []) AS found, words, high FROM f)
SELECT l_orderkey, CASE WHEN len(found) = 0 THEN CASE WHEN words = 0 THEN 'NO_TEXT' ELSE 'NO_MATCH' END WHEN NOT high THEN 'LOW_CONFIDENCE' WHEN expected = found THEN 'OK'
 WHEN list_sort(expected) = list_sort(found) AND len(list_distinct(found)) = len(found) THEN 'OK_ORDER_DIFFERS' ELSE 'MISMATCH' END AS status FROM g"""


@query(_STATUS)
def classify_status(spark, sf_dir):
    return _files(spark, sf_dir).select("l_orderkey", P.classify(F.col("expected"), F.col("found"), F.col("words"), F.col("high")).alias("status"))


@query(f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY 1")
def status_counts(spark, sf_dir):
    return classify_status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


_ITEMS = f"""WITH k AS ({_RK}), c AS (SELECT path, list_sort(list(DISTINCT l_partkey) FILTER (place = 1)) AS won, list_sort(list(DISTINCT l_partkey)) AS found, list_sort(list(DISTINCT l_partkey) FILTER (named)) AS named FROM k GROUP BY path),
i AS (SELECT path, CASE WHEN won IS NULL THEN 'aside' WHEN named = won THEN 'ok' WHEN path % 10 = 0 THEN 'review' WHEN len(won) > 1 THEN 'split' ELSE 'rename' END AS kind FROM c)"""


def _items(spark, sf_dir):
    r = P.ranked_claims(_claims(spark, sf_dir), "l_partkey")
    s = lambda c: F.sort_array(F.collect_set(c))
    files = r.groupBy("path").agg(s(F.when(F.col("place") == 1, F.col("l_partkey"))).alias("won"), s("l_partkey").alias("found"), s(F.when(F.col("named"), F.col("l_partkey"))).alias("named"))
    return files.select("path", P.plan_kind(F.col("won"), F.col("named"), F.col("path") % 10 == 0, F.col("found")).alias("kind"))


@query(_ITEMS + " SELECT kind, count(*) AS n FROM i GROUP BY 1")
def plan_kinds(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(_ITEMS + " SELECT path, kind, row_number() OVER (ORDER BY path)::INT AS id, list_position(['join', 'split', 'rename', 'aside', 'review', 'ok'], kind) - 1 AS kind_rank FROM i")
def plan_order_ids(spark, sf_dir):
    return P.plan_order(_items(spark, sf_dir))


_SEAS = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS season, o_orderstatus FROM orders"


@query(f"""WITH s AS ({_SEAS}), u AS (SELECT season, min(o_orderkey) AS path FROM s WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) = 1), f AS (SELECT season, min(o_orderkey) AS episode FROM s WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) = 1)
SELECT season, path, episode FROM u JOIN f USING (season)""")
def eliminate_single(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("season", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return P.eliminate(o.where("o_orderstatus = 'P'").select("season", F.col("o_orderkey").alias("path")), o.where("o_orderstatus = 'O'").select("season", F.col("o_orderkey").alias("episode")), "season")


@query("SELECT o_orderpriority, o_orderkey FROM orders o WHERE o_orderstatus = 'P' AND EXISTS (SELECT 1 FROM orders a WHERE a.o_orderpriority = o.o_orderpriority AND a.o_orderkey = o.o_orderkey - 1 AND a.o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders a WHERE a.o_orderpriority = o.o_orderpriority AND a.o_orderkey = o.o_orderkey + 1 AND a.o_orderstatus = 'F')")
def eliminate_neighbours(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus")
    return P.between_neighbours(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), "o_orderpriority", "o_orderkey").select("o_orderpriority", "o_orderkey")


@query("""WITH p AS (SELECT p_name || '/' || p_brand AS key, p_size::BIGINT % 4 + 1 AS part, p_partkey AS path, p_retailprice AS duration FROM part),
g AS (SELECT key, list(part ORDER BY part) AS parts, list(path ORDER BY part, path) AS sources, sum(duration) AS d FROM p GROUP BY 1)
SELECT key, parts, sources, parts = range(1, len(parts) + 1) AND d <= 1.6 * 2500 AS selected FROM g WHERE len(parts) > 1 AND len(list_distinct(parts)) = len(parts)""")
def join_parts_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", "p_brand").alias("key"), (F.col("p_size").cast("long") % 4 + 1).alias("part"), F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("duration"))
    return P.join_groups(p, "key", F.lit(2500.0))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_name = b.p_name AND b.p_partkey != a.p_partkey AND abs(a.p_partkey - b.p_partkey) <= 400")
def story_neighbours(spark, sf_dir):
    return P.near(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "a"), ["p_size", "p_name"], "a", "b", 400).select("a", "b")


@query("""SELECT p_partkey, c AS code, round(p_size * i / 3.0, 6) AS start, round(p_size * (i + 1) / 3.0, 6) AS "end" FROM part, (VALUES ('a', 0), ('b', 1), ('c', 2)) v(c, i)""")
def story_split(spark, sf_dir):
    parts = P.story_parts(F.lit(0.0), F.col("p_size").cast("double"), F.array(*map(F.lit, "abc")))
    x = table(spark, sf_dir, "part").select("p_partkey", F.explode(parts).alias("x"))
    return x.select("p_partkey", "x.code", F.round("x.start", 6).alias("start"), F.round("x.end", 6).alias("end"))


_SW = "SELECT l_suppkey, l_partkey % 20 AS named, (l_partkey * 7 + l_linenumber) % 20 AS holds, l_orderkey FROM lineitem"


@query(f"""WITH r AS ({_SW}), o AS (SELECT l_suppkey, named AS x, holds AS y, min(l_orderkey) AS first FROM r WHERE named != holds GROUP BY 1, 2, 3)
SELECT a.l_suppkey, a.x, a.y, a.first, b.first AS second FROM o a JOIN o b ON a.l_suppkey = b.l_suppkey AND a.x = b.y AND a.y = b.x WHERE a.x < a.y""")
def ref_swaps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_suppkey", (F.col("l_partkey") % 20).alias("named"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 20).alias("holds"), "l_orderkey")
    return P.swaps(rows, "l_suppkey", "named", "holds", "l_orderkey")


@query("""WITH r AS (SELECT l_orderkey, min(l_suppkey) AS s, min(l_partkey) % 50 AS named, max(l_partkey) % 50 AS holds FROM lineitem GROUP BY 1), p AS (SELECT a.l_orderkey AS a, b.l_orderkey AS b FROM r a JOIN r b ON a.s = b.s AND a.named = b.holds AND a.holds = b.named AND a.l_orderkey != b.l_orderkey),
u AS (SELECT a, min(b) AS b FROM p GROUP BY a HAVING count(*) = 1) SELECT u.a, u.b FROM u JOIN u v ON u.b = v.a WHERE u.a < u.b""")
def card_swaps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), (F.min("l_partkey") % 50).alias("named"), (F.max("l_partkey") % 50).alias("holds"))
    return views.only_swaps(li, "l_orderkey", "s", "named", "holds")


# ---- operation tables
_OPS = "WITH r AS (SELECT 'f' || lpad(c_custkey::VARCHAR, 6, '0') AS src, 'f' || lpad((1501 - c_custkey)::VARCHAR, 6, '0') AS dst, row_number() OVER (ORDER BY c_custkey) AS k FROM customer), o AS (SELECT k AS ordinal, 'move' AS op, src, src || '.tmp' AS dst FROM r UNION ALL SELECT k + (SELECT count(*) FROM r), 'move', src || '.tmp', dst FROM r)"


def _renames(spark, sf_dir):
    name = lambda c: F.concat(F.lit("f"), F.lpad(c.cast("string"), 6, "0"))
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(name(k).alias("from"), name(1501 - k).alias("to"))


@query(_OPS + " SELECT ordinal, op, src, dst FROM o")
def op_log(spark, sf_dir):
    return P.rename_ops(_renames(spark, sf_dir), "from", "to")


@query(_OPS + " SELECT (SELECT max(ordinal) FROM o) - ordinal + 1 AS ordinal, 'move' AS op, dst AS src, src AS dst FROM o")
def undo_ops(spark, sf_dir):
    return P.undo_ops(op_log(spark, sf_dir))


@query("SELECT 'f' || lpad(c_custkey::VARCHAR, 6, '0') AS src, 'f' || lpad((1501 - c_custkey)::VARCHAR, 6, '0') AS dst FROM customer")
def swap_safe_rename(spark, sf_dir):
    """The net effect of the two passes: where each file ends."""
    ops = op_log(spark, sf_dir)
    first, second = ops.where("dst like '%.tmp'"), ops.where("src like '%.tmp'").select(F.col("src").alias("via"), F.col("dst").alias("end"))
    return first.join(second, F.col("dst") == F.col("via")).select("src", F.col("end").alias("dst"))


@query("SELECT p_partkey, CASE WHEN k = 0 THEN p_name || '.mkv' ELSE p_name || ' (' || k || ').mkv' END AS free FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)")
def free_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(".mkv")).alias("name"))
    return P.free_names(p, "name", "p_partkey").select("p_partkey", "free")


@query("""SELECT p_partkey, format('S{:02d}E{:02d}-{:02d}-{:02d}', s, a, a + 1, a + 2) AS extend, format('S{:02d}E{:02d}.S{:02d}E{:02d}.S{:02d}E{:02d}', s, a, s, a + 1, s, a + 2) AS duplicate, format('S{:02d}E{:02d}E{:02d}E{:02d}', s, a, a + 1, a + 2) AS repeat,
 format('S{:02d}E{:02d}-E{:02d}-E{:02d}', s, a, a + 1, a + 2) AS scene, format('S{:02d}E{:02d}-{:02d}', s, a, a + 2) AS range, format('S{:02d}E{:02d}-E{:02d}', s, a, a + 2) AS prefixed_range FROM (SELECT p_partkey, p_size::BIGINT AS s, p_partkey % 90 AS a FROM part)""")
def multi_episode_styles(spark, sf_dir):
    a = F.col("p_partkey") % 90
    styles = ("extend", "duplicate", "repeat", "scene", "range", "prefixed_range")
    return table(spark, sf_dir, "part").select("p_partkey", *[P.multi_episode(s, F.col("p_size"), F.array(a, a + 1, a + 2)).alias(s) for s in styles])


@query("SELECT p_partkey, format('{} - S{:02d}E{:02d} - {}', p_brand, p_size::BIGINT, p_partkey % 100, replace(p_name, ':', '-')) || '.mkv' AS name FROM part")
def naming_default(spark, sf_dir):
    from ..functions.text import clean_token, episode_code

    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.concat_ws(" - ", clean_token(F.col("p_brand")), episode_code(F.col("p_size"), F.col("p_partkey") % 100), clean_token(F.col("p_name"))), F.lit(".mkv")).alias("name"))


# ---- releases: an order's lines are the titles it brings, wanted are those of its customer's first order
_REL = """WITH w AS (SELECT o_custkey, list_sort(list(DISTINCT l_partkey % 40)) AS want FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY 1),
r AS (SELECT o_custkey, o_orderkey AS guid, list_sort(list(DISTINCT l_partkey % 40)) AS has, min(l_returnflag) = 'R' AS rejected, min(l_linestatus) = 'O' AS same, max(l_quantity) > 40 AS preferred, min(l_tax) AS age FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
c AS (SELECT r.*, want, list_sort(list_filter(has, lambda x: list_contains(want, x))) AS covers, list_sort(list_filter(has, lambda x: NOT list_contains(want, x))) AS extra FROM r JOIN w USING (o_custkey))"""


def _releases(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    code = F.col("l_partkey") % 40
    want = j.where("l_linenumber = 1").groupBy("o_custkey").agg(F.sort_array(F.collect_set(code)).alias("want"))
    rel = j.groupBy("o_custkey", F.col("o_orderkey").alias("guid")).agg(F.sort_array(F.collect_set(code)).alias("has"), (F.min("l_returnflag") == "R").alias("rejected"), (F.min("l_linestatus") == "O").alias("same_quality"), (F.max("l_quantity") > 40).alias("preferred"), F.min("l_tax").alias("age"))
    c = rel.join(want, "o_custkey")
    return c.withColumns({"covers": F.sort_array(F.array_intersect("has", "want")), "extra": F.sort_array(F.array_except("has", "want")), "kind_rank": F.when(F.size("has") > 4, 0).otherwise(1)})  # a pack of several is looked at first


@query(_REL + " SELECT guid, covers, extra FROM c")
def covers_extra_fills(spark, sf_dir):
    return _releases(spark, sf_dir).select("guid", "covers", "extra")


@query(_REL + ", k AS (SELECT o_custkey, guid, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN len(has) > 4 THEN 0 ELSE 1 END, len(covers) DESC, len(extra), rejected, same DESC, preferred DESC, age, guid) AS place FROM c) SELECT o_custkey, guid, place FROM k WHERE place <= 8")
def release_rank(spark, sf_dir):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*P.release_order()))
    return _releases(spark, sf_dir).withColumn("place", place).where("place <= 8").select("o_custkey", "guid", "place")


@query("WITH RECURSIVE " + _REL.removeprefix("WITH ") + """, l AS (SELECT o_custkey, want, list(covers ORDER BY guid) AS cs FROM c GROUP BY 1, 2),
g AS (SELECT o_custkey, cs, 1 AS i, cs[1] AS got, CASE WHEN len(cs[1]) > 0 THEN [0] ELSE []::INT[] END AS picks FROM l UNION ALL
 SELECT o_custkey, cs, i + 1, list_distinct(list_concat(got, cs[i + 1])), CASE WHEN len(list_filter(cs[i + 1], lambda x: NOT list_contains(got, x))) > 0 THEN list_append(picks, i) ELSE picks END FROM g WHERE i < len(cs))
SELECT o_custkey, picks FROM g WHERE i = len(cs)""")
def set_cover(spark, sf_dir):
    rows = _releases(spark, sf_dir).groupBy("o_custkey", "want").agg(F.sort_array(F.collect_list(F.struct("guid", "covers"))).alias("x"))
    return rows.select("o_custkey", P.set_cover(F.transform("x", lambda y: y["covers"]), F.col("want")).alias("picks"))


@query("SELECT o_orderkey, o_orderpriority NOT LIKE '%URGENT%' AND o_orderpriority NOT LIKE '%HIGH%' AS soft FROM orders")
def soft_hard(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", views.soft(F.array("o_orderpriority"), "URGENT|HIGH").alias("soft"))


# ---- what releases mean: an order is a release; its lines are titles in its name, or numbers alone
_MEAN = """WITH r AS (SELECT o_orderkey AS guid, o_custkey, list_sort(list(DISTINCT l_partkey % 30)) AS codes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
w AS (SELECT o_custkey, list_sort(list(DISTINCT l_partkey % 30)) AS want FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 AND o_orderkey % 3 = 0 GROUP BY 1),
x AS (SELECT guid, r.o_custkey, CASE WHEN guid % 4 < 2 THEN codes ELSE [] END AS named, CASE WHEN guid % 4 = 3 THEN codes[1:2] ELSE [] END AS mapped, guid % 8 = 2 AS season, want, [c FOR c IN [guid % 30, (guid + 1) % 30] IF NOT list_contains(want, c)] AS fill FROM r JOIN w USING (o_custkey)),
k AS (SELECT *, CASE WHEN len(named) > 0 THEN CASE WHEN list_has_any(named, want) THEN 'title' END WHEN season THEN 'pack' WHEN len(mapped) > 0 AND list_has_all(want, mapped) THEN 'numbers' END AS kind FROM x),
m AS (SELECT guid, kind, CASE kind WHEN 'title' THEN list_sort([c FOR c IN named IF list_contains(want, c)]) WHEN 'pack' THEN want ELSE list_sort([c FOR c IN want IF list_contains(mapped, c)]) END AS covers,
 CASE WHEN kind = 'title' THEN list_sort([c FOR c IN named IF NOT list_contains(want, c) AND NOT list_contains(fill, c)]) ELSE [] END AS extra, CASE WHEN kind = 'title' THEN list_sort([c FOR c IN named IF list_contains(fill, c)]) ELSE [] END AS fills, want FROM k WHERE kind IS NOT NULL)"""


def _meant(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    code, k = F.col("l_partkey") % 30, F.col("guid")
    want = j.where("l_linenumber <= 2 and o_orderkey % 3 = 0").groupBy("o_custkey").agg(F.sort_array(F.collect_set(code)).alias("want"))
    rows = j.groupBy(F.col("o_orderkey").alias("guid"), "o_custkey").agg(F.sort_array(F.collect_set(code)).alias("codes")).join(want, "o_custkey")
    none = F.array().cast("array<bigint>")
    rows = rows.select("guid", F.when(k % 4 < 2, F.col("codes")).otherwise(none).alias("named"), F.when(k % 4 == 3, F.slice("codes", 1, 2)).otherwise(none).alias("mapped"), (k % 8 == 2).alias("full_season"), "want", F.array(k % 30, (k + 1) % 30).alias("fill"))
    return R.meanings(rows)


@query(_MEAN + " SELECT guid, kind, covers, extra, fills FROM m")
def release_meanings(spark, sf_dir):
    return _meant(spark, sf_dir).select("guid", "kind", *[F.sort_array(c).alias(c) for c in ("covers", "extra", "fills")])


@query(_MEAN + " SELECT guid FROM m WHERE kind = 'title' AND len(extra) = 0 AND guid % 5 != 0 AND guid % 7 != 0 AND list_has_all(covers, want[1:1]) AND guid % 11 != 0 AND guid % 2000 NOT IN (SELECT guid % 2000 FROM m WHERE guid % 33 = 0)")
def fetchable_releases(spark, sf_dir):
    """Releases with the wanted titles and nothing else that were not tried, nor another one of their name."""
    k = F.col("guid")
    c = _meant(spark, sf_dir).withColumns({"norm": (k % 2000).cast("string"), "hard": k % 5 == 0, "imported": k % 7 == 0, "need": F.slice("want", 1, 1)})
    tried = c.select("guid", F.when(k % 33 == 0, F.col("norm")).alias("norm")).where("guid % 11 = 0")
    return R.fetchable(c, tried).select("guid")


@query(f"""WITH r AS ({_SW}), o AS (SELECT l_suppkey, named AS x, holds AS y, min(l_orderkey) AS first FROM r WHERE named != holds GROUP BY 1, 2, 3),
p AS (SELECT a.l_suppkey, a.x, a.y FROM o a JOIN o b ON a.l_suppkey = b.l_suppkey AND a.x = b.y AND a.y = b.x WHERE a.x < a.y)
SELECT l_suppkey, x, y FROM p WHERE NOT ((x + y) % 3 = 0 AND x + 10 >= l_suppkey % 20)""")
def ref_swaps_since(spark, sf_dir):
    """Swapped references, but those that were swapped back after the scan."""
    pairs = ref_swaps(spark, sf_dir).select("l_suppkey", "x", "y", (F.col("l_suppkey") % 20).alias("scanned"))
    done = pairs.where((F.col("x") + F.col("y")) % 3 == 0).select("l_suppkey", F.col("y").alias("x"), F.col("x").alias("y"), (F.col("x") + 10).alias("at"))
    return R.swaps_since(pairs, done, "l_suppkey").select("l_suppkey", "x", "y")
