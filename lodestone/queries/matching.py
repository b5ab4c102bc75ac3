"""Queries of the matcher: scores, windows, decoding and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode, match, tfidf, windows
from ..registry import query
from .common import stored, table, terms_sql

# ---- documents against benchmark passages



def _scores_sql(background: bool = False, stop: bool = False, bigrams: bool = False, max_df: float | None = None) -> str:
    fit = "SELECT 'r' || item_id AS k, term FROM rt" + (" UNION ALL SELECT 'd' || doc_id AS k, term FROM dt" if background else "")
    n = "(SELECT count(*) FROM benchmark)" + (" + (SELECT count(*) FROM documents)" if background else "")
    cap = f" WHERE n < 10 OR df <= {max_df} * n" if max_df else ""
    vec = lambda t, k: f"{t}x AS (SELECT {k}, term, (1 + ln(count(*))) * any_value(idf) AS x FROM {t} JOIN idf USING (term) GROUP BY {k}, term), {t}v AS (SELECT {k}, term, x / sqrt(sum(x * x) OVER (PARTITION BY {k})) AS w FROM {t}x)"
    return f"""WITH {terms_sql('rt', 'item_id', 'benchmark', stop, bigrams)}, {terms_sql('dt', 'doc_id', 'documents', stop, bigrams)},
f AS ({fit}), df AS (SELECT term, count(DISTINCT k) AS df, {n} AS n FROM f GROUP BY term), idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df{cap}),
{vec('rt', 'item_id')}, {vec('dt', 'doc_id')},
s AS (SELECT doc_id, item_id, sum(d.w * r.w) AS score FROM dtv d JOIN rtv r USING (term) GROUP BY doc_id, item_id),
t AS (SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 4) DESC, item_id) AS rank, round(score, 4) AS score FROM s)"""


def _scored(spark, sf_dir, background=False, stop=False, bigrams=False, max_df=None, whole=False):
    terms = tfidf.Terms(tfidf.english_stop_words() if stop else (), bigrams, whole)
    docs, refs = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    parts = tfidf.parts_of(docs)
    rt = tfidf.counts(refs, "item_id", "text", terms)
    n = refs.agg(F.count("*").alias("n"))
    known = rt.select("term", F.lit(1).alias("df"))
    if background:
        known = known.unionByName(tfidf.frequencies(docs, "doc_id", "text", terms, parts))
        n = n.unionByName(docs.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("n"))
    weights = tfidf.fit(known, n, max_df, once=background)
    weights = tfidf.Weights(stored(weights.idf, "idf"), weights.once)
    return tfidf.scores(docs, weights, stored(weights.vectors(rt, "item_id"), "vectors"), "doc_id", "item_id", terms, parts)


_TOP2 = " SELECT doc_id, item_id, rank, score FROM t WHERE rank <= 2"


@query(_scores_sql() + _TOP2)
def tfidf_top2(spark, sf_dir):
    return tfidf.top(_scored(spark, sf_dir), "doc_id", "item_id", 2)


@query(_scores_sql(background=True) + _TOP2)
def tfidf_background_idf(spark, sf_dir):
    return tfidf.top(_scored(spark, sf_dir, background=True), "doc_id", "item_id", 2)


@query(_scores_sql(bigrams=True) + _TOP2)
def tfidf_bigrams(spark, sf_dir):
    return tfidf.top(_scored(spark, sf_dir, bigrams=True), "doc_id", "item_id", 2)


@query(_scores_sql(True, True, True, 0.6) + _TOP2)
def tfidf_maxdf_stopwords(spark, sf_dir):
    return tfidf.top(_scored(spark, sf_dir, True, True, True, 0.6), "doc_id", "item_id", 2)


@query(_scores_sql(True, True, True, 0.6) + """, c AS (SELECT a.doc_id, a.item_id, a.score, coalesce(b.score, 0) AS nxt FROM (SELECT * FROM t WHERE rank = 1) a LEFT JOIN (SELECT * FROM t WHERE rank = 2) b USING (doc_id))
SELECT doc_id, item_id, score, round(score - nxt, 4) AS margin, CASE WHEN score >= 0.12 AND round(score - nxt, 4) >= 0.04 AND score >= 1.4 * nxt THEN 'high' ELSE 'low' END AS confidence FROM c""")
def tfidf_confidence(spark, sf_dir):
    return _confidence(spark, sf_dir)


def _confidence(spark, sf_dir, whole=False):
    ranked = tfidf.top(_scored(spark, sf_dir, True, True, True, 0.6, whole), "doc_id", "item_id", 2)
    return tfidf.confidence(ranked, "doc_id", "item_id", table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n")))


# ---- the same with characters of all scripts decomposed, in Python
@query()
def tfidf_top2_whole(spark, sf_dir):
    return tfidf.top(_scored(spark, sf_dir, whole=True), "doc_id", "item_id", 2)


@query()
def tfidf_background_idf_whole(spark, sf_dir):
    return tfidf.top(_scored(spark, sf_dir, background=True, whole=True), "doc_id", "item_id", 2)


@query()
def tfidf_bigrams_whole(spark, sf_dir):
    return tfidf.top(_scored(spark, sf_dir, bigrams=True, whole=True), "doc_id", "item_id", 2)


@query()
def tfidf_maxdf_stopwords_whole(spark, sf_dir):
    return tfidf.top(_scored(spark, sf_dir, True, True, True, 0.6, True), "doc_id", "item_id", 2)


@query()
def tfidf_confidence_whole(spark, sf_dir):
    return _confidence(spark, sf_dir, True)


# ---- hopping windows: each turn of a conversation is a cue of 20 to 40 s
_CUES = "SELECT conv_id, turn * 30.0 AS start, turn * 30.0 + 20 + len(text) % 20 AS \"end\", text FROM conversations"
_WIN = f"""WITH c AS ({_CUES}), e AS (SELECT conv_id, max("end") AS fe FROM c GROUP BY conv_id),
n AS (SELECT conv_id, fe, unnest(range(ceil(greatest(fe - 45, 45) / 45)::BIGINT)) AS win FROM e),
w AS (SELECT n.conv_id, win, win * 45.0::DOUBLE AS win_start, least(win * 45.0 + 90, fe)::DOUBLE AS win_end, c.start, c."end", c.text FROM n JOIN c ON c.conv_id = n.conv_id AND c."end" > win * 45 AND c.start < win * 45 + 90)"""


def _cues(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    start = (F.col("turn") * 30).cast("double")
    return c.select("conv_id", start.alias("start"), (start + 20 + F.length("text") % 20).alias("end"), "text")


@query(_WIN + ' SELECT conv_id, win::BIGINT AS win, win_start, win_end, start::DOUBLE AS start, "end"::DOUBLE AS "end" FROM w')
def windows_hop(spark, sf_dir):
    return windows.cue_windows(_cues(spark, sf_dir), "conv_id").select("conv_id", "win", "win_start", "win_end", "start", "end")


_WORDS = _WIN + ", x AS (SELECT conv_id, win::BIGINT AS win, win_start, win_end, string_agg(text, ' ' ORDER BY start, text) AS text FROM w GROUP BY ALL), y AS (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) AS words FROM x)"


@query(_WORDS + " SELECT conv_id, win, win_start, win_end, text, words, words < 8 AS silent FROM y")
def window_words(spark, sf_dir):
    return windows.window_words(windows.cue_windows(_cues(spark, sf_dir), "conv_id"), "conv_id")


@query(_WORDS + " SELECT conv_id, count(*) AS windows, count(*) FILTER (words < 8) AS silent FROM y GROUP BY conv_id")
def silent_windows(spark, sf_dir):
    w = windows.window_words(windows.cue_windows(_cues(spark, sf_dir), "conv_id"), "conv_id")
    return w.groupBy("conv_id").agg(F.count("*").alias("windows"), F.count_if("silent").alias("silent"))


def _window_scores(spark, sf_dir):
    w = windows.window_words(windows.cue_windows(_cues(spark, sf_dir), "conv_id"), "conv_id").where("not silent")
    w = w.select(F.concat_ws("/", "conv_id", "win").alias("k"), "text")
    refs = table(spark, sf_dir, "benchmark")
    rt = tfidf.counts(refs, "item_id")
    weights = tfidf.Weights(stored(tfidf.fit(rt, refs.agg(F.count("*").alias("n"))).idf, "idf"))
    return tfidf.scores(w, weights, stored(weights.vectors(rt, "item_id"), "vectors"), "k", "item_id")


@query(_WORDS + f""", q AS (SELECT conv_id || '/' || win AS k, text FROM y WHERE words >= 8), {terms_sql('rt', 'item_id', 'benchmark')}, {terms_sql('qt', 'k', 'q')},
df AS (SELECT term, count(DISTINCT item_id) AS df FROM rt GROUP BY term), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1 AS idf FROM df),
rx AS (SELECT item_id, term, (1 + ln(count(*))) * any_value(idf) AS x FROM rt JOIN idf USING (term) GROUP BY 1, 2), rv AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM rx),
qx AS (SELECT k, term, (1 + ln(count(*))) * any_value(idf) AS x FROM qt JOIN idf USING (term) GROUP BY 1, 2), qv AS (SELECT k, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS w FROM qx),
s AS (SELECT k, item_id, sum(q.w * r.w) AS score FROM qv q JOIN rv r USING (term) GROUP BY 1, 2),
t AS (SELECT k, item_id, row_number() OVER (PARTITION BY k ORDER BY round(score, 4) DESC, item_id) AS rank, round(score, 4) AS score FROM s)
SELECT k, item_id, rank, score FROM t WHERE rank <= 3""")
def window_scores(spark, sf_dir):
    return tfidf.top(_window_scores(spark, sf_dir), "k", "item_id", 3)


# ---- decoding: hours of a day are windows, shares of event types are scores
STATES = ("click", "error", "purchase", "signup", "view")
NULL_SCORE, SWITCH = 0.3, 0.22
_BIN = "SELECT date_part('day', ts)::BIGINT AS day, date_part('hour', ts)::BIGINT AS t, " + ", ".join(f"count(*) FILTER (event_type = '{s}') / count(*) AS p{i}" for i, s in enumerate(STATES)) + " FROM events GROUP BY ALL"
_PATH = f"""WITH RECURSIVE b AS ({_BIN}), e AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY t) AS k, t, [p0, p1, p2, p3, p4, {NULL_SCORE}::DOUBLE] AS v FROM b),
f AS (SELECT day, k, v AS s, NULL::BIGINT[] AS back FROM e WHERE k = 1 UNION ALL
 SELECT e.day, e.k, list_transform(range(1, 7), lambda i: greatest(f.s[i], list_max(f.s) - {SWITCH}) + e.v[i]), list_transform(range(1, 7), lambda i: CASE WHEN list_max(f.s) - {SWITCH} > f.s[i] THEN list_position(f.s, list_max(f.s)) ELSE i END)
 FROM f JOIN e ON e.day = f.day AND e.k = f.k + 1),
w AS (SELECT day, k, list_position(s, list_max(s))::BIGINT AS st FROM f WHERE k = (SELECT max(k) FROM f g WHERE g.day = f.day) UNION ALL
 SELECT w.day, w.k - 1, f.back[w.st]::BIGINT FROM w JOIN f ON f.day = w.day AND f.k = w.k WHERE w.k > 1),
p AS (SELECT w.day, e.t, w.st - 1 AS state, e.v[w.st] AS score FROM w JOIN e ON e.day = w.day AND e.k = w.k)"""


def _emissions(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").cast("long").alias("day"), F.hour("ts").cast("long").alias("t"))
    share = [F.count_if(F.col("event_type") == s) / F.count("*") for s in STATES]
    return e.agg(F.array(*share, F.lit(NULL_SCORE)).alias("v"))


def _path(spark, sf_dir):
    rows = _emissions(spark, sf_dir).groupBy("day").agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("x"))
    v = F.transform("x", lambda y: y["v"])
    rows = rows.select("day", F.arrays_zip(F.col("x"), decode.viterbi(v, SWITCH).alias("state")).alias("z"))
    rows = rows.select("day", F.explode("z").alias("z"))
    return rows.select("day", "z.x.t", F.col("z.state").cast("long").alias("state"), F.expr("get(z.x.v, z.state)").alias("score"))


@query(_PATH + " SELECT day, t, state, round(score, 6) AS score FROM p")
def viterbi_labels(spark, sf_dir):
    return _path(spark, sf_dir).withColumn("score", F.round("score", 6))


_RUNS = _PATH + """, m AS (SELECT *, CASE WHEN state = lag(state) OVER o THEN 0 ELSE 1 END AS new FROM p WINDOW o AS (PARTITION BY day ORDER BY t)),
r AS (SELECT *, sum(new) OVER (PARTITION BY day ORDER BY t) AS run FROM m),
g AS (SELECT day, run::BIGINT AS run, state, min(t)::DOUBLE AS start, max(t)::DOUBLE + 2 AS "end", max(score) AS score, count(*) AS n FROM r GROUP BY day, run, state)"""


def _runs(spark, sf_dir):
    p = _path(spark, sf_dir).withColumns({"s": F.col("t").cast("double"), "e": F.col("t").cast("double") + 2})
    return decode.runs(p, "day", "t", "state", "s", "e", "score")


@query(_RUNS + ' SELECT day, run, state, start, "end", round(score, 6) AS score, n FROM g')
def viterbi_runs(spark, sf_dir):
    return _runs(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(_RUNS + """, h AS (SELECT day, run, state, score, CASE WHEN lag("end") OVER o > start THEN (lag("end") OVER o + start) / 2 ELSE start END AS start, CASE WHEN lead(start) OVER o < "end" THEN (lead(start) OVER o + "end") / 2 ELSE "end" END AS "end" FROM g WINDOW o AS (PARTITION BY day ORDER BY run)),
k AS (SELECT * FROM h WHERE state != 5 AND ("end" - start >= 2 OR "end" - start >= 0.35 * 24)),
l AS (SELECT *, sum(new) OVER (PARTITION BY day ORDER BY run) AS seg FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY day ORDER BY run) THEN 0 ELSE 1 END AS new FROM k))
SELECT day, seg::BIGINT AS run, state, min(start) AS start, max("end") AS "end", round(max(score), 6) AS score, count(*) AS n FROM l GROUP BY day, seg, state""")
def segments_final(spark, sf_dir):
    rows = decode.split_overlaps(_runs(spark, sf_dir), "day").withColumn("total", F.lit(24.0))
    return decode.surviving(rows.withColumn("state", F.col("state").cast("string")), "day", "state", "5", 2.0, 0.35, "total").withColumns({"score": F.round("score", 6), "state": F.col("state").cast("long")})


# ---- joins in time
@query("SELECT event_id, user_id, (SELECT max(s.event_id) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.event_id <= e.event_id) AS as_of_start FROM events e WHERE event_type = 'purchase'")
def asof_start(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return windows.as_of(e.where("event_type = 'purchase'").select("user_id", "event_id", "event_type"), e.where("event_type = 'signup'").select("user_id", "event_id"), "user_id", "event_id", "event_id").select("event_id", "user_id", "as_of_start")


@query("""WITH s AS (SELECT user_id, event_id AS index, epoch(ts)::DOUBLE AS start, epoch(ts)::DOUBLE + 600 AS "end" FROM events WHERE event_type = 'view'), p AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS time FROM events WHERE event_type = 'click')
SELECT p.user_id, p.event_id, max(index) AS index FROM p JOIN s ON s.user_id = p.user_id AND time >= start - 60 AND time <= "end" + 15 GROUP BY ALL""")
def card_to_segment(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("time", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double") + F.date_format("ts", "0.SSSSSS").cast("double"))
    spans = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("index"), F.col("time").alias("start"), (F.col("time") + 600).alias("end"))
    return windows.within(e.where("event_type = 'click'").select("user_id", "event_id", "time"), spans, "user_id", "time", 60, 15).select("user_id", "event_id", "index")


@query("SELECT event_id, list_extract(['a', 'b', 'c', 'd'][1:1 + event_id % 4], (least(event_id % 4, greatest(0, floor(value / (200.0 / (1 + event_id % 4)))))::BIGINT + 1)) AS code FROM events")
def expected_at(spark, sf_dir):
    named = F.slice(F.array(*map(F.lit, "abcd")), 1, (1 + F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", windows.expected_at(named, F.col("value"), F.lit(200.0)).alias("code"))


@query("""WITH s AS (SELECT user_id, epoch(ts)::DOUBLE AS start, epoch(ts)::DOUBLE + 7200 AS "end" FROM events),
m AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 300 THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, round(min(start), 3) AS start, round(max("end"), 3) AS "end", count(*) AS n FROM i GROUP BY user_id, g""")
def merge_intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("start", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double") + F.date_format("ts", "0.SSSSSS").cast("double"))
    return windows.merge_intervals(e.select("user_id", "start", (F.col("start") + 7200).alias("end")), "user_id", 300).withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})


# ---- the whole match of files: conversations as files, benchmark passages as references
@query()
def match_file(spark, sf_dir):
    """Segments of every conversation; held against a plain loop over the reference's steps in tests."""
    cues = _cues(spark, sf_dir)
    spoken = cues.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), " ").alias("text"))
    return match.segments(cues, table(spark, sf_dir, "benchmark").select("item_id", "text"), "conv_id", "item_id", background=spoken, stop=tfidf.english_stop_words(), min_seconds=60.0)  # conversations are short


@query(f"""WITH c AS (SELECT conv_id, string_agg(text, ' ') AS text FROM conversations GROUP BY 1), {terms_sql('rt', 'item_id', 'benchmark')}, {terms_sql('qt', 'conv_id', 'c')},
df AS (SELECT term, count(DISTINCT item_id) AS df FROM rt GROUP BY term), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1 AS idf FROM df),
rx AS (SELECT item_id, term, (1 + ln(count(*))) * any_value(idf) AS x FROM rt JOIN idf USING (term) GROUP BY 1, 2), rv AS (SELECT item_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS w FROM rx),
qx AS (SELECT conv_id, term, (1 + ln(count(*))) * any_value(idf) AS x FROM qt JOIN idf USING (term) GROUP BY 1, 2), qv AS (SELECT conv_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY conv_id)) AS w FROM qx),
s AS (SELECT conv_id, item_id, sum(q.w * r.w) AS score FROM qv q JOIN rv r USING (term) GROUP BY 1, 2),
t AS (SELECT conv_id, item_id, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 4) DESC, item_id) AS rank, round(score, 4) AS score FROM s)
SELECT conv_id, item_id, rank, score FROM t WHERE rank <= 5""")
def segment_scores(spark, sf_dir):
    return match.whole(_cues(spark, sf_dir), table(spark, sf_dir, "benchmark"), "conv_id", "item_id")
