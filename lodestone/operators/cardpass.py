"""The title-card pass over a library: what recurs in a sample, where cards appear, and a second look there.

A pass adapts to what it finds. An even sample of each series' files shows texts that come at one point
of many files (opening titles); a probe of a few files tells whether the series has title cards and how
far into an episode they come; only then are the other files looked at, in the learned window first and
in the whole one where that shows nothing that fits. Each step is a join of files' probable episode
starts with cards by file and range of time, and the range of the second step is what the first has learned.

Frames are read in two phases, key frames before all frames, and what was read before is judged again by
the present rules: only windows that then lack something are read (`scan_plan`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from .state import upper_medians

NONE = "array<string>"


def fits(code: Column, partial: Column, candidates: Column, expected: Column) -> Column:
    """Does a reading fit the names of a file? Names that say nothing fit all."""
    none = F.array().cast(NONE)
    expected = F.coalesce(expected, none)
    could = F.when(partial, F.coalesce(candidates, none)).otherwise(F.array(code))
    return (F.size(expected) == 0) | F.coalesce(F.arrays_overlap(expected, could), F.lit(False))


def sampled(files: DataFrame, group: str, order: str, most: int = 12) -> DataFrame:
    """Every n-th file of each group, `most` of them, with `sample` (how many)."""
    w = Window.partitionBy(group)
    ranked = files.withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    taken = ranked.where((F.col("_k") % step == 0) & (F.col("_k") < step * most))
    return taken.withColumn("sample", F.count("*").over(w)).drop("_k", "_n")


def recurring_texts(reads: DataFrame, group: str, tolerance: float = 8.0, least: int = 3, share: float = 1 / 3) -> DataFrame:
    """group, code, offset, files and text of titles that are read at one point of several files.

    reads: group, file, code, offset (seconds into an episode), text and sample (files looked at). The
    point is the upper median of a code's offsets; files with a reading within `tolerance` of it count,
    and `least` of them, and `share` of the sample, are needed.
    """
    keyed = reads.where("code is not null and offset is not null").withColumn("_k", F.struct(group, "code"))
    middle = upper_medians(keyed, "_k", "offset").withColumnRenamed("middle", "_middle")
    near = F.when(F.abs(F.col("offset") - F.col("_middle")) <= tolerance, F.col("file"))
    found = keyed.join(middle, "_k").groupBy(group, "code").agg(F.first("_middle").alias("_m"), F.count_distinct(near).alias("files"), F.max("sample").alias("_n"), F.min("text").alias("text"))
    return found.where((F.col("files") >= least) & (F.col("files") >= share * F.col("_n"))).select(group, "code", F.round("_m", 1).alias("offset"), "files", "text")


def learned_window(hits: DataFrame, group: str, before: float = 40.0, after: float = 60.0) -> DataFrame:
    """group, lo and hi: where cards come, from at least two offsets; whole seconds, halves to even."""
    enough = hits.groupBy(group).agg(F.count("offset").alias("n")).where("n >= 2").select(group)
    middle = upper_medians(hits, group, "offset").join(enough, group)
    return middle.select(group, F.greatest(F.lit(0.0), F.bround(F.col("middle") - before)).alias("lo"), F.bround(F.col("middle") + after).alias("hi"))


def best_per_stretch(cards: Column, span: float = 120.0) -> Column:
    """Cards (rank, time, ...; lower ranks first) of a window, each more than `span` seconds from all better ones, in order of time: a fold over the sorted array."""
    order = F.array_sort(cards)
    kept = F.aggregate(order, F.slice(order, 1, 0), lambda a, c: F.when(F.forall(a, lambda k: F.abs(k["time"] - c["time"]) > span), F.array_append(a, c)).otherwise(a))
    return F.array_sort(F.transform(kept, lambda c: F.struct(c["time"].alias("time"), c.alias("card"))))


def detected(files: DataFrame, cards: DataFrame, group: str, recurring: DataFrame | None = None, window: DataFrame | None = None, full: float = 180.0, all_cards: bool = False) -> DataFrame:
    """group, file, time, code, partial, candidates, text and offset of the cards that a look at each probable start shows.

    files: group, file, duration, expected, starts. cards: file, time, code, partial, candidates, text, frames,
    pieced. A start's learned window is looked at first; the whole window where no full card in it fits.
    Readings of a recurring text near its point are left out; of each stretch of two minutes the most
    convincing card stays, unless all_cards; the same text within 30 s counts once.
    """
    spots = files.select(group, "file", "duration", "expected", "starts", F.explode("starts").alias("start"))
    if window is None:
        window = files.select(group).limit(0).select(group, F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    spots = spots.join(window, group, "left")
    if recurring is not None:
        spots = spots.join(recurring.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("code", "offset"))).alias("_points")), group, "left")
    else:
        spots = spots.withColumn("_points", F.lit(None).cast("map<string,double>"))
    none = F.array().cast(NONE)

    def inside(lo: Column, hi: Column) -> Column:
        a = F.greatest(F.lit(0.0), F.col("start") + lo)
        held = (F.col("time") >= a) & (F.col("time") <= a + F.least(hi - lo, F.greatest(F.lit(10.0), F.col("duration") - a)))
        return F.coalesce(lo.isNotNull() & held, F.lit(False))  # greatest() and least() pass over nulls

    both = cards.select("file", "time", "code", "partial", F.coalesce("candidates", none).alias("candidates"), "text", "frames", "pieced")
    near = spots.join(both, "file").withColumns({"learned": inside(F.col("lo"), F.col("hi")), "whole": inside(F.lit(0.0), F.lit(full))}).where("learned or whole")
    at_point = lambda c: F.coalesce(F.abs(F.col("time") - F.col("start") - F.try_element_at("_points", c)) <= 8.0, F.lit(False))
    near = near.withColumn("candidates", F.when(F.col("_points").isNull(), F.col("candidates")).otherwise(F.filter("candidates", lambda c: ~at_point(c))))
    near = near.where(F.when(F.col("partial"), F.size("candidates") > 0).otherwise(F.col("code").isNotNull() & ~at_point(F.col("code"))))
    fit = fits(F.col("code"), F.col("partial"), F.col("candidates"), F.col("expected"))
    here = Window.partitionBy("file", "start")
    flagged = near.withColumns({"_sure": F.max(fit & ~F.col("partial") & F.col("learned")).over(here), "_any": F.max("whole").over(here), "_fit": fit})
    seen = flagged.where(F.when(F.col("_sure"), F.col("learned")).when(F.col("_any"), F.col("whole")).otherwise(F.col("learned")))
    named = F.col("_fit") & (F.size(F.coalesce("expected", none)) > 0)
    card = F.struct((~named).alias("r1"), F.col("partial").alias("r2"), F.coalesce("pieced", F.lit(False)).alias("r3"), (-F.length(F.coalesce("text", F.lit("")))).alias("r4"), (-F.coalesce("frames", F.lit(1))).alias("r5"), "time", "code", "partial", "candidates", "text", "starts")
    listed = seen.groupBy(group, "file", "start").agg(F.collect_list(card).alias("x"))
    kept = F.array_sort(F.transform("x", lambda c: F.struct(c["time"].alias("time"), c.alias("card")))) if all_cards else best_per_stretch(F.col("x"))
    rows = listed.select(group, "file", "start", F.explode(kept).alias("c")).select(group, "file", "start", "c.card.time", "c.card.code", "c.card.partial", "c.card.candidates", "c.card.text", "c.card.starts")
    # the starts of a file in order, each adding what isn't there yet
    same = rows.groupBy(group, "file", "code", "text").agg(F.array_sort(F.collect_list(F.struct("start", "time", "partial", "candidates", "starts"))).alias("x"))
    once = F.aggregate("x", F.slice("x", 1, 0), lambda a, c: F.when(F.forall(a, lambda k: F.abs(k["time"] - c["time"]) >= 30), F.array_append(a, c)).otherwise(a))
    out = same.select(group, "file", "code", "text", F.explode(once).alias("c"))
    base = F.coalesce(F.array_max(F.filter("c.starts", lambda s: s <= F.col("c.time"))), F.lit(0.0))
    return out.select(group, "file", "c.time", "code", "c.partial", "c.candidates", "text", (F.col("c.time") - base).alias("offset"))


def card_pass(files: DataFrame, cards: DataFrame, group: str, always: bool = False, everything: bool = False, full: float = 180.0, sample: int = 12, probe: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """found (cards as `detected` gives them, with `step`), series (probed, hits, has_cards, lo, hi) and recurring texts.

    files: group, file (in order), status, duration, expected, starts, sure (codes that dialogue is sure of).
    The probe takes a series' first confirmed files, and others where these are fewer than four; it is
    passed with two hits at least and on half of its files, or by `always`. Then the files that dialogue
    did not confirm are looked at, or all with `everything`; a series whose probe fails has no cards. At the end the window is learned
    again from all that was found.
    """
    usable = files.where(F.coalesce("status", F.lit("")) != "ERROR")
    chosen = sampled(usable.where(F.size(F.coalesce("expected", F.array().cast(NONE))) > 0), group, "file", sample)
    odd = detected(chosen, cards, group, full=full, all_cards=True).join(chosen.select("file", "expected", "sample"), "file")
    odd = odd.where("not partial and sample >= 3").where(~F.array_contains("expected", F.col("code")))
    recurring = stored(recurring_texts(odd, group), "recurring")

    ok = F.coalesce(F.col("status") == "OK", F.lit(False))
    order = Window.partitionBy(group, "_ok").orderBy("file")
    placed = usable.withColumn("_ok", ok).withColumn("_k", F.row_number().over(order)).withColumn("_oks", F.count_if("_ok").over(Window.partitionBy(group)))
    first = F.when(F.col("_ok"), F.col("_k") <= probe).otherwise((F.col("_oks") < 4) & (F.col("_k") <= probe - F.col("_oks")))
    probed = placed.where(first).drop("_ok", "_k", "_oks")
    shown = stored(detected(probed, cards, group, recurring, None, full), "probe")
    agrees = F.col("status").isNull() | (F.col("status") != "OK") | F.coalesce(F.array_contains("sure", F.col("code")), F.lit(False))
    hit = shown.join(probed.select("file", "status", "sure"), "file").groupBy("file").agg(F.max(agrees).alias("hit"))
    counts = probed.join(hit, "file", "left").groupBy(group).agg(F.count("*").alias("probed"), F.count_if(F.coalesce("hit", F.lit(False))).alias("hits"))
    passed = F.col("hits") >= F.greatest(F.lit(2), F.floor((F.col("probed") + 1) / 2))
    series = counts.withColumn("has_cards", passed | F.lit(always))
    series = stored(series.join(learned_window(shown.join(series.where("has_cards").select(group), group), group), group, "left"), "series")

    left = usable.join(probed.select("file"), "file", "left_anti").join(series.where("has_cards").select(group), group, "left_semi")
    left = left if everything else left.where(~ok)
    second = detected(left, cards, group, recurring, series.where("lo is not null").select(group, "lo", "hi"), full)
    found = stored(shown.withColumn("step", F.lit("probe")).unionByName(second.withColumn("step", F.lit("second"))), "cards")
    again = learned_window(found.join(series.where("has_cards").select(group), group), group)
    series = series.select(group, "probed", "hits", "has_cards", F.col("lo").alias("lo_before"), F.col("hi").alias("hi_before")).join(again, group, "left")
    return found, series.select(group, "probed", "hits", "has_cards", F.coalesce("lo", "lo_before").alias("lo"), F.coalesce("hi", "hi_before").alias("hi")), recurring


# ---- reading in two phases
def judged(reads: DataFrame, frames: DataFrame, settle: float = 6.0, settle_partial: float = 12.0) -> DataFrame:
    """Which windows read before (file, start, mode, complete, stopped_at, ocr) hold what the present rules need:
    usable, until (frames behind it would not have been read; null: all count), any_full, and of what counts full_fit and any_hit.

    frames: file, start, mode, t, hit (by the present rules), partial, fit (with the file's names). A reading that
    stopped early counts if it would have stopped by now at the latest: a while after the first reading
    that fits, longer as long as that is partial.
    """
    key = ["file", "start", "mode"]
    fit, full = F.coalesce(F.col("hit") & F.col("fit"), F.lit(False)), F.coalesce(F.col("hit") & ~F.col("partial"), F.lit(False))
    firsts = frames.groupBy(*key).agg(F.min(F.when(fit, F.col("t"))).alias("first"), F.min(F.when(fit & full, F.col("t"))).alias("first_full"), F.max(full).alias("any_full"), F.min(F.when(F.col("hit"), F.col("t"))).alias("first_any"))
    rest = lambda seen: F.col("first") + F.when(seen, settle).otherwise(settle_partial)
    behind = frames.select(*key, "t").join(firsts.where("first is not null"), key).where(F.col("t") > rest(F.coalesce(F.col("first_full") < F.col("t"), F.lit(False))))
    stops = behind.groupBy(*key).agg(F.min("t").alias("until"))
    rows = reads.join(firsts, key, "left").join(stops, key, "left")
    in_time = F.coalesce(F.col("stopped_at") > rest(F.col("first_full").isNotNull()), F.lit(False))
    usable = F.col("complete") | F.col("until").isNotNull() | in_time
    until = F.when(~F.col("complete"), F.col("until"))
    within = lambda c: F.coalesce(F.col(c).isNotNull() & (until.isNull() | (F.col(c) < until)), F.lit(False))
    return rows.select(*key, "ocr", "read_at", usable.alias("usable"), until.alias("until"), F.coalesce("any_full", F.lit(False)).alias("any_full"), within("first_full").alias("full_fit"), within("first_any").alias("any_hit"))


def scan_plan(windows: DataFrame, reads: DataFrame, frames: DataFrame, ocr: str, not_before: Column | None = None) -> DataFrame:
    """file, start and what each wanted window needs: `read key` (nothing usable from key frames), `read full` (key frames
    show no full card that fits), or `use key` or `use full`: what is there suffices, key frames where all frames show nothing.

    not_before: readings older than this don't count. Those by another reader (ocr) count only if they show a full
    title. A change of rules changes hits in `frames`, never what has to be read where the old frames suffice.
    """
    state = judged(reads, frames)
    good = state.where("usable").where((F.col("ocr") == ocr) | F.col("any_full"))
    if not_before is not None:
        good = good.where(F.col("read_at") >= not_before)
    one = lambda mode: good.where(F.col("mode") == mode).select("file", "start", F.lit(True).alias(mode), F.col("full_fit").alias(f"{mode}_fit"), F.col("any_hit").alias(f"{mode}_hit"), F.col("until").alias(f"{mode}_until"))
    got = windows.select("file", "start").distinct().join(one("key"), ["file", "start"], "left").join(one("full"), ["file", "start"], "left")
    action = F.when(F.col("key").isNull(), "read key").when(F.col("key_fit"), "use key").when(F.col("full").isNull(), "read full").when(F.col("full_hit"), "use full").otherwise("use key")
    return got.select("file", "start", action.alias("action"), F.when(action == "use key", F.col("key_until")).when(action == "use full", F.col("full_until")).alias("until"))


def planned_reads(windows: DataFrame, reads: DataFrame, frames: DataFrame, ocr: str, not_before: Column | None = None) -> DataFrame:
    """The windows still to be read, with mode: those for which what is there is not enough."""
    plan = scan_plan(windows, reads, frames, ocr, not_before)
    done = plan.where(F.col("action").startswith("use")).select("file", "start")
    return windows.join(done, ["file", "start"], "left_anti").join(plan, ["file", "start"]).select(*windows.columns, F.when(F.col("action") == "read key", "key").otherwise("full").alias("mode"))
