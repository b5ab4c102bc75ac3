"""Which reference does each stretch of a file hold? Windows, scores, decoding, segments and their own scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from . import decode, tfidf, windows


def emissions(cues: DataFrame, weights: tfidf.Weights, vectors: DataFrame, key: str, ref: str, none: float, size: float, hop: float, min_words: int, parts: int, stop: tuple[str, ...] = ()) -> DataFrame:
    """key, file_end, codes and, in order, each window's start, end and scores of the file's codes with `none`
    behind them. All windows of a file are there, silent ones with scores of 0. A reference that no
    window of a file shares a word with can't win against `none`, so it is left out of that file.
    Files are dealt out in so many parts and stay there: a window's scores take many times the size of its text."""
    ends = cues.select(key, "end").repartition(parts, key).groupBy(key).agg(F.max("end").alias("file_end"))
    grid = ends.select(key, "file_end", F.explode(F.sequence(F.lit(0).cast("long"), windows.window_count(F.col("file_end"), size, hop).cast("long") - 1)).alias("win"))
    spoken = windows.window_words(windows.cue_windows(cues, key, size, hop), key, min_words).where("not silent")
    own = F.struct(key, "win")
    scored = stored(tfidf.scores(spoken.select(own.alias("k"), "text"), weights, vectors, "k", ref, tfidf.Terms(stop, True), parts).select(f"k.{key}", "k.win", ref, "score"), "scores").repartition(parts, key)
    by_window = scored.groupBy(key, "win").agg(F.map_from_entries(F.collect_list(F.struct(ref, "score"))).alias("m"))
    codes = scored.groupBy(key).agg(F.sort_array(F.collect_set(ref)).alias("codes"))
    rows = grid.join(by_window, [key, "win"], "left").join(codes, key)
    value = F.array_append(F.transform("codes", lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0))), F.lit(none))
    window = F.struct("win", (F.col("win") * hop).alias("start"), F.least(F.col("win") * hop + size, F.col("file_end")).alias("end"), value.alias("v"))
    return rows.groupBy(key, "file_end", "codes").agg(F.sort_array(F.collect_list(window)).alias("w"))


def segments(cues: DataFrame, references: DataFrame, key: str, ref: str, background: DataFrame | None = None, stop: tuple[str, ...] = (), max_df: float | None = 0.6, size: float = 90.0, hop: float = 45.0, min_words: int = 8, switch: float = 0.22, min_seconds: float = 240.0, min_share: float = 0.35, min_score: float = 0.12, min_margin: float = 0.04) -> DataFrame:
    """Segments of each file from its cues (key, start, end, text) and references (ref, text): start, end, code,
    score, margin, confidence, the next best (`alternatives`) and the number of words.

    Weights of words, and of pairs of neighbours once stop words are out, come from the references and from `background` (key, text), the files' own dialogue.
    Windows are scored and decoded into runs; runs that last are segments, which are scored again as
    a whole; neighbours that then have one code are one segment with the best of their scores.
    """
    rt = tfidf.counts(references, ref, "text", tfidf.Terms(stop, True))
    n, known = references.agg(F.count("*").alias("n")), rt.select("term", F.lit(1).alias("df"))
    if background is not None:
        said = background.where(F.trim("text") != "")
        known = known.unionByName(tfidf.frequencies(said, key, "text", tfidf.Terms(stop, True)))
        n = n.unionByName(said.agg(F.count("*").alias("n"))).agg(F.sum("n").alias("n"))
    weights = tfidf.Weights(stored(tfidf.fit(known, n, max_df).idf, "idf"))
    vectors = stored(weights.vectors(rt, ref), "vectors")

    parts = tfidf.parts_of(cues)
    decoded = emissions(cues, weights, vectors, key, ref, 0.6 * min_score, size, hop, min_words, parts, stop)
    path = decode.viterbi(F.transform("w", lambda x: x["v"]), switch)
    steps = decoded.select(key, "file_end", "codes", F.explode(F.arrays_zip("w", path.alias("state"))).alias("z"))
    label = F.coalesce(F.get("codes", F.col("z.state")).cast("string"), F.lit("-"))
    steps = steps.select(key, "file_end", F.col("z.w.win").alias("win"), F.col("z.w.start").alias("s"), F.col("z.w.end").alias("e"), label.alias("label"), F.lit(0.0).alias("score"))
    long = decode.split_overlaps(decode.runs(steps, key, "win", "label", "s", "e", "score"), key).join(steps.select(key, "file_end").distinct(), key)
    found = decode.surviving(long, key, "label", "-", min_seconds, min_share, "file_end").select(key, F.col("run").alias("seg"), "start", "end")
    found = stored(found, "segments")

    # each segment's own text, scored as a whole
    inside = cues.withColumnsRenamed({"start": "_s", "end": "_e"}).join(found, key).where("_e > start and _s < end")
    held = inside.groupBy(key, "seg", "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_s", "text"))), lambda x: x["text"]), " ").alias("text"))
    held = stored(held, "texts")
    scored = tfidf.scores(held.select(F.struct(key, "seg").alias("k"), "text"), weights, vectors, "k", ref, tfidf.Terms(stop, True), parts)
    best = tfidf.top(scored, "k", ref, 4).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("rank", F.col(ref).alias("code"), "score"))).alias("t"))
    rows = held.join(best.select(f"k.{key}", "k.seg", "t"), [key, "seg"])
    score, second = F.get("t", F.lit(0))["score"], F.coalesce(F.get("t", F.lit(1))["score"], F.lit(0.0))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long")
    rows = rows.crossJoin(F.broadcast(references.agg(F.count("*").alias("_n"))))  # one row
    margin = F.round(score - second, 4)
    sure = tfidf.sure(score, second, margin, F.col("_n"), min_score, min_margin)
    rows = rows.select(key, "seg", F.round("start", 1).alias("start"), F.round("end", 1).alias("end"), F.get("t", F.lit(0))["code"].alias("code"), score.alias("score"), margin.alias("margin"), F.when(sure, "high").otherwise("low").alias("confidence"), F.transform(F.slice("t", F.lit(2), F.lit(3)), lambda x: F.struct(x["code"], x["score"])).alias("alternatives"), words.alias("words"))
    # neighbours with one code: the first one's evidence, all their time, the best score
    w = Window.partitionBy(key).orderBy("seg")
    rows = rows.withColumn("_new", F.coalesce(F.col("code") != F.lag("code").over(w), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "seg").alias(c)
    out = rows.groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), first("code"), F.max("score").alias("score"), first("margin"), first("confidence"), first("alternatives"), first("words"))
    return out.withColumnRenamed("_run", "segment")


def whole(cues: DataFrame, references: DataFrame, key: str, ref: str, k: int = 5) -> DataFrame:
    """The k best references of all that is said in a file."""
    rt = tfidf.counts(references, ref)
    weights = tfidf.Weights(stored(tfidf.fit(rt.select("term"), references.agg(F.count("*").alias("n"))).idf, "idf"))
    return tfidf.top(tfidf.scores(cues, weights, stored(weights.vectors(rt, ref), "vectors"), key, ref), key, ref, k)
