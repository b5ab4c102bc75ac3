"""Queries of evidence: titles in names, fuzzy titles, title cards, listings, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cards, names, references, vectors, views
from ..registry import query
from ..sources import subtitles
from .common import table, terms_sql

# titles are pairs of words of the benchmark passages; names are lines of documents
_W = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_T = f"SELECT item_id AS code, w[1] || ' ' || w[2] AS title FROM (SELECT item_id, {_W} AS w FROM benchmark) UNION ALL SELECT item_id + 1000, w[1] || ' ' || w[2] || ' ' || w[3] FROM (SELECT item_id, {_W} AS w FROM benchmark)"
_D = "SELECT doc_id, doc_id % 40 AS own, ' ' || trim(regexp_replace(translate(replace(lower(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), '&', ' and '), '''’', ''), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents"
_HITS = f"WITH t AS (SELECT code, title AS words FROM ({_T}) WHERE len(title) >= 4), d AS ({_D}), h AS (SELECT doc_id, own, code, words, strpos(t, ' ' || words || ' ') AS pos FROM d JOIN t ON contains(t, ' ' || words || ' ') AND (len(words) >= 8 OR code = own))"


def _titled(spark, sf_dir):
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    b = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))
    titles = b.select(F.col("item_id").alias("code"), F.array_join(F.slice("w", 1, 2), " ").alias("title")).unionByName(b.select((F.col("item_id") + 1000).alias("code"), F.array_join(F.slice("w", 1, 3), " ").alias("title")))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("own"), "text")
    return docs, titles


def _hits(spark, sf_dir):
    docs, titles = _titled(spark, sf_dir)
    return docs, names.contained(docs, "doc_id", "text", titles, "code", "title", own="own")


@query(_HITS + " SELECT doc_id, code, words, pos::BIGINT AS \"at\" FROM h")
def title_containment(spark, sf_dir):
    return _hits(spark, sf_dir)[1]


_OUT = _HITS + ", o AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.doc_id = h.doc_id AND len(g.words) > len(h.words) AND contains(' ' || g.words || ' ', ' ' || h.words || ' ')))"


@query(_OUT + " SELECT doc_id, list(code ORDER BY pos, code) AS codes FROM o GROUP BY 1")
def titles_in_order(spark, sf_dir):
    _, hits = _hits(spark, sf_dir)
    o = names.outermost(hits, "doc_id", "code")
    return o.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes"))


@query(_HITS + """, b AS (SELECT doc_id, code, words FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(words) DESC, words DESC, code DESC) AS k FROM h) WHERE k = 1), m AS (SELECT DISTINCT doc_id, words AS mine FROM h WHERE code = own)
SELECT d.doc_id, CASE WHEN b.code IS NULL THEN NULL WHEN mine IS NOT NULL AND NOT (len(b.words) > len(mine) AND contains(b.words, mine)) THEN 'match' ELSE 'other' END AS verdict FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)""")
def name_verdict(spark, sf_dir):
    docs, hits = _hits(spark, sf_dir)
    return names.verdict(hits, docs, "doc_id", "code", "own")


# ---- fuzzy titles: part names against the same names with a letter changed
def _fuzzy(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), "p_size").distinct()
    titles = p.select("title").distinct().withColumn("norm", X.norm_title(F.col("title")))
    pages = titles.select(F.upper("title").alias("page"), F.regexp_replace("norm", "e", "a").alias("norm"))
    return names.fuzzy_pairs(titles, pages, "title", "page"), p


@query()
def fuzzy_title_join(spark, sf_dir):
    return _fuzzy(spark, sf_dir)[0]


@query()
def greedy_assignment(spark, sf_dir):
    pairs, parts = _fuzzy(spark, sf_dir)
    return names.greedy_pairs(pairs.join(parts, "title"), "p_size", "title", "page")


@query()
def title_code_unique(spark, sf_dir):
    return names.unique_code(_fuzzy(spark, sf_dir)[0], "title", "page")


# ---- title cards
def _lines(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", X.norm_nospace(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("norm"))
    cut = F.when(F.col("p_partkey") % 3 == 0, F.left("norm", F.lit(12))).otherwise(F.regexp_replace("norm", "l", "i"))
    return p.select(F.col("p_partkey").alias("line"), cut.alias("norm")), p.groupBy("norm").agg(F.min("p_partkey").alias("code"))


@query()
def title_read_full_partial(spark, sf_dir):
    lines, titles = _lines(spark, sf_dir)
    return cards.readings(lines, titles.select("code", "norm"), "line", "code")


_READS = "SELECT user_id, event_id::DOUBLE AS t, [ascii(event_type) % 3, length(event_type) % 3] AS codes, value AS score FROM events"
_CARDS = f"""WITH r AS ({_READS}), m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 120 AND list_has_any(codes, lag(codes) OVER w) THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS card FROM m)
SELECT user_id, card::BIGINT AS card, min(t) AS time, max(t) AS last, count(*) AS frames, arg_max(codes, {{'s': score, 't': -t}}) AS codes, max(score) AS score FROM g GROUP BY user_id, card"""


def _cards(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    codes = F.array(F.ascii("event_type") % 3, F.length("event_type") % 3)
    return cards.grouped(e.select("user_id", F.col("event_id").cast("double").alias("t"), codes.alias("codes"), F.col("value").alias("score")), "user_id", 120.0)


@query(_CARDS)
def cards_grouped(spark, sf_dir):
    return _cards(spark, sf_dir)


@query()
def cards_nms(spark, sf_dir):
    return cards.thinned(_cards(spark, sf_dir).select("user_id", "card", "time", "score"), "user_id", 1200.0)


@query("SELECT event_id, event_id % 3 = 0 OR list_has_any(CASE WHEN event_id % 3 = 0 THEN [] ELSE [event_id % 5] END, [event_id % 7, event_id % 4]) AS fits FROM events")
def card_fit(spark, sf_dir):
    e = F.col("event_id")
    named = F.when(e % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(e % 5))
    return table(spark, sf_dir, "events").select("event_id", cards.fits(named, F.array(e % 7, e % 4)).alias("fits"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (event_id % 7, event_id % 4) THEN event_id % 5 WHEN event_id % 6 IN (event_id % 7, event_id % 4) THEN event_id % 6 WHEN event_id % 2 IN (event_id % 7, event_id % 4) THEN event_id % 2 END AS code FROM events")
def partial_resolution(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", cards.resolve_partial(F.array(e % 5), F.array(e % 6), F.array(e % 2), F.array(e % 7, e % 4)).alias("code"))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id::DOUBLE AS start, event_id + 60.0 AS "end", event_type AS code, event_type = 'view' AS card, event_type IN ('error', 'click') AS weak, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT user_id, k, start AS s, "end" AS e, code, card, 1 AS seg FROM s WHERE k = 1 UNION ALL
 SELECT s.user_id, s.k, CASE WHEN s.weak AND f.card AND s."end" - f.s <= 280 THEN f.s ELSE s.start END, s."end", CASE WHEN s.weak AND f.card AND s."end" - f.s <= 280 THEN f.code ELSE s.code END,
  CASE WHEN s.weak AND f.card AND s."end" - f.s <= 280 THEN true ELSE s.card END, CASE WHEN s.weak AND f.card AND s."end" - f.s <= 280 THEN f.seg ELSE f.seg + 1 END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
SELECT user_id, min(s)::DOUBLE AS start, max(e)::DOUBLE AS "end", any_value(code) AS code, bool_or(card) AS card FROM f GROUP BY user_id, seg""")
def card_absorption(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    start = F.col("event_id").cast("double")
    segs = e.select("user_id", start.alias("start"), (start + 60).alias("end"), F.col("event_type").alias("code"), (F.col("event_type") == "view").alias("card"), F.col("event_type").isin("error", "click").alias("weak"))
    return cards.absorbed(segs, "user_id", 200.0)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, min(event_id) FILTER (event_type = 'view') OVER (PARTITION BY user_id) AS hit FROM events) WHERE hit IS NULL OR event_id <= hit + 1200")
def settle_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return views.settled(e, e.where("event_type = 'view'"), "user_id", "event_id", 1200).select("user_id", "event_id")


@query("""WITH h AS (SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'view') + 300, min(event_id) + 2000) AS u FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT e.user_id, event_id FROM events e LEFT JOIN h USING (user_id) WHERE u IS NULL OR event_id <= u""")
def settle_after_partial(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    hits = e.where("event_type in ('view', 'click')").select("user_id", "event_id", (F.col("event_type") == "click").alias("partial"))
    return views.settled(e, hits, "user_id", "event_id", 300, 2000).select("user_id", "event_id")


# ---- listings: a part is a file
_LIST = "SELECT p_partkey, '/tv/' || p_brand || CASE p_partkey % 5 WHEN 0 THEN '/Season 1/' WHEN 1 THEN '/Extras/' WHEN 2 THEN '/.hidden/' ELSE '/' END || p_name || CASE p_partkey % 4 WHEN 0 THEN '.mkv' WHEN 1 THEN ' sample.mp4' WHEN 2 THEN '.txt' ELSE '.avi' END AS path, p_retailprice * 150000 AS size FROM part"


def _listing(spark, sf_dir):
    k = F.col("p_partkey")
    folder = F.when(k % 5 == 0, "/Season 1/").when(k % 5 == 1, "/Extras/").when(k % 5 == 2, "/.hidden/").otherwise("/")
    end = F.when(k % 4 == 0, ".mkv").when(k % 4 == 1, " sample.mp4").when(k % 4 == 2, ".txt").otherwise(".avi")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.lit("/tv/"), "p_brand", folder, "p_name", end).alias("path"), (F.col("p_retailprice") * 150000).alias("size"))


@query(f"SELECT p_partkey FROM ({_LIST}) WHERE p_partkey % 5 NOT IN (1, 2) AND p_partkey % 4 != 2 AND NOT (p_partkey % 4 = 1 AND size < 157286400)")
def video_listing(spark, sf_dir):
    return subtitles.list_videos(_listing(spark, sf_dir), F.concat(F.lit("/tv/"), "p_brand")).select("p_partkey")


@query(f"SELECT split_part(path, '/', 3) AS show, bool_or(regexp_matches(lower(path), '/season [0-9]+/')) AS seasons, bool_or(p_partkey % 5 > 2) AS flat FROM ({_LIST}) GROUP BY 1")
def folder_layout(spark, sf_dir):
    return views.layouts(_listing(spark, sf_dir), "path", 2)


@query("""WITH f AS (SELECT p_name AS video, p_name || CASE p_partkey % 5 WHEN 0 THEN '.en.srt' WHEN 1 THEN '.srt' WHEN 2 THEN '.de.srt' WHEN 3 THEN '.en.forced.srt' ELSE '.nfo' END AS path, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS rank FROM part)
SELECT video, max(rank)::INT AS rank, arg_max(path, rank) AS path FROM f WHERE rank IS NOT NULL GROUP BY video""")
def sidecar_choice(spark, sf_dir):
    k = F.col("p_partkey") % 5
    end = F.when(k == 0, ".en.srt").when(k == 1, ".srt").when(k == 2, ".de.srt").when(k == 3, ".en.forced.srt").otherwise(".nfo")
    return subtitles.sidecar_choice(table(spark, sf_dir, "part").select(F.col("p_name").alias("video"), F.col("p_name").alias("stem"), F.concat("p_name", end).alias("path")))


@query("SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'small' THEN 0 WHEN starts_with(lower(p_name), 'small') THEN 1 ELSE 2 END AS rank FROM part WHERE contains(lower(p_name), 'small') ORDER BY 3, 2, 1 LIMIT 50")
def folder_search(spark, sf_dir):
    return views.found_folders(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "small", 50)


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'env' END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, 'default') AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'env' WHEN o_orderkey % 3 = 0 THEN 'file' ELSE 'default' END AS origin FROM orders")
def settings_precedence(spark, sf_dir):
    k = F.col("o_orderkey")
    env, file = F.when(k % 5 == 0, "env"), F.when(k % 3 == 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(env, file, F.lit("default")).alias("value"), F.when(env.isNotNull(), "env").when(file.isNotNull(), "file").otherwise("default").alias("origin"))


@query("SELECT item_id, source FROM (SELECT item_id, 'manual' AS source FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT item_id, 'cached' FROM benchmark WHERE item_id % 3 != 0)")
def reference_priority(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return views.by_priority("item_id", "source", ("manual", b.where("item_id % 3 = 0")), ("cached", b))


@query("""WITH p AS (SELECT event_id, list_distinct(list_concat([event_type], list_concat([['click', 'error', 'view'][1 + event_id % 3]], ['purchase', 'signup', 'view']))) AS pool0, event_type FROM events)
SELECT event_id, [x FOR x IN list_transform(list_filter(list_zip(c, range(1, 6)), lambda z: list_position(c, z[1]) = z[2]), lambda z: z[1]) IF x != 'signup'][1:3] AS pool FROM (SELECT event_id, [event_type, ['click', 'error', 'view'][1 + event_id % 3], 'purchase', 'signup', 'view'] AS c FROM events)""")
def candidate_pool(spark, sf_dir):
    near = F.get(F.array(*map(F.lit, ("click", "error", "view"))), (F.col("event_id") % 3).cast("int"))
    sources = [F.array("event_type"), F.array(near), F.array(*map(F.lit, ("purchase", "signup", "view")))]
    return table(spark, sf_dir, "events").select("event_id", views.pool(sources, F.array(F.lit("signup")), 3).alias("pool"))


# ---- checks of references by the dialogue of others
_FLAG = f"WITH r AS (SELECT item_id, text, item_id % 4 = 0 AS flagged, CASE WHEN item_id % 8 = 0 THEN item_id + 1 END AS target FROM benchmark), {terms_sql('t', 'item_id', 'r')}" + """, tt AS (SELECT t.* FROM t JOIN r USING (item_id) WHERE NOT flagged), n AS (SELECT count(*) AS n FROM r WHERE NOT flagged),
idf AS (SELECT term, ln((1 + n) / (1 + count(DISTINCT item_id))) + 1 AS idf FROM tt, n GROUP BY term, n HAVING n < 10 OR count(DISTINCT item_id) <= 0.6 * n),
x AS (SELECT item_id, term, (1 + ln(count(*))) * any_value(idf) AS x FROM t JOIN idf USING (term) GROUP BY 1, 2), v AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM x),
s AS (SELECT a.item_id, b.item_id AS other, sum(a.w * b.w) AS score FROM v a JOIN r f ON f.item_id = a.item_id AND f.flagged JOIN v b USING (term) JOIN r g ON g.item_id = b.item_id AND NOT g.flagged GROUP BY 1, 2),
b AS (SELECT item_id, max(score) AS best FROM s GROUP BY 1)
SELECT r.item_id, CASE WHEN coalesce(best, 0) >= 0.35 THEN 'removed' WHEN g.item_id IS NOT NULL AND coalesce(score, 0) < 0.15 AND coalesce(best, 0) < 0.25 THEN 'verified' ELSE 'flagged' END AS verdict
FROM r LEFT JOIN b USING (item_id) LEFT JOIN r g ON g.item_id = r.target AND NOT g.flagged LEFT JOIN s ON s.item_id = r.item_id AND s.other = r.target WHERE r.flagged"""


@query(_FLAG)
def verify_flagged(spark, sf_dir):
    """Every fourth passage is flagged; half of these say that they are another one's."""
    k = F.col("item_id")
    refs = table(spark, sf_dir, "benchmark").select("item_id", "text", (k % 4 == 0).alias("flagged"), F.when(k % 8 == 0, k + 1).alias("target"))
    return references.verify_flagged(refs, "item_id")


@query("SELECT e.vec_id, o.vec_id AS other, round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 5) AS score FROM embeddings e JOIN embeddings o ON e.label = o.label AND o.vec_id != e.vec_id QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 5) DESC, o.vec_id) <= 2")
def embedding_topk_whole(spark, sf_dir):
    """Dense scores of vectors against all other vectors of their label, the two best."""
    return vectors.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", "other", 2)


@query("SELECT e.vec_id, o.vec_id AS other, round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 5) AS score FROM embeddings e JOIN embeddings o ON e.label = o.label AND o.vec_id != e.vec_id AND e.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 5) DESC, o.vec_id) <= 2")
def embedding_topk(spark, sf_dir):
    """The search: every fiftieth vector asks, and all vectors of its label are looked at."""
    return vectors.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", "other", 2, asking=F.col("vec_id") % 50 == 0)
