"""What is remembered between runs: snapshots and their changes, outcomes of imports, requests and what was tried for them.

Each is a table with a key; a run joins it with what is new and gives the table as it is from then on.
On a stream, foreachBatch does that for each batch (see `remembered`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.state import snapshot_diff

GOOD = ("OK", "MANUAL")


def pending_changes(old: DataFrame, new: DataFrame, before: DataFrame, series: str, now: Column) -> DataFrame:
    """Per series whose files differ from the snapshot: numbers of added, changed and removed files, a digest
    of the changes, since when they are the same ones, and whether references are to be fetched for them:
    once for each new set of changes, and not for removals alone. Snapshots are (series, rel, sig);
    `before` is the result of the run before."""
    keyed = lambda d: d.select(F.struct(series, "rel").alias("k"), "sig")
    d = snapshot_diff(keyed(old), keyed(new), "k", "sig").select(f"k.{series}", "k.rel", "status")
    # the order of rows doesn't matter to a sum of hashes
    digest = F.sum(F.xxhash64("rel", "status").cast("decimal(20,0)")).cast("string")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    found = d.groupBy(series).agg(n("added"), n("changed"), n("removed"), digest.alias("digest"))
    known = before.select(series, F.col("digest").alias("_digest"), F.col("since").alias("_since"), F.col("fetched").alias("_fetched"))
    same = F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False))
    rows = found.join(known, series, "left")
    fetch = (F.col("added") + F.col("changed") > 0) & ~(same & F.coalesce("_fetched", F.lit(False)))
    return rows.select(series, "added", "changed", "removed", "digest", F.when(same, F.col("_since")).otherwise(now).alias("since"), fetch.alias("fetch"), (fetch | (same & F.coalesce("_fetched", F.lit(False)))).alias("fetched"))


def recorded(snapshot: DataFrame, scanned: DataFrame, series: str, full: bool) -> DataFrame:
    """The snapshot after a scan: all files of the scanned series anew, or only the scanned files (a null `sig`:
    it is gone) in series that have a snapshot."""
    if full:
        return snapshot.join(scanned.select(series).distinct(), series, "left_anti").unionByName(scanned.where("sig is not null"))
    based = scanned.join(snapshot.select(series).distinct(), series, "left_semi")
    return snapshot.join(based.select(series, "rel"), [series, "rel"], "left_anti").unionByName(based.where("sig is not null"))


def outcomes(memory: DataFrame, new: DataFrame, series: str, last: int = 30) -> DataFrame:
    """Outcomes of imports (series, rel, at, status): a file's newest one, the `last` of each series."""
    both = memory.unionByName(new)
    newest = both.groupBy(series, "rel").agg(F.max(F.struct("at", "status")).alias("x")).select(series, "rel", "x.at", "x.status")
    rank = F.row_number().over(Window.partitionBy(series).orderBy(F.desc("at"), "rel"))
    return newest.withColumn("_k", rank).where(F.col("_k") <= last).drop("_k")


def after_full_scan(memory: DataFrame, scanned: DataFrame, series: str) -> DataFrame:
    """A full scan covers what went wrong before: only good outcomes of the scanned series stay."""
    rows = memory.join(scanned.select(series).distinct().withColumn("_scanned", F.lit(True)), series, "left")
    return rows.where(F.col("_scanned").isNull() | F.col("status").isin(*GOOD)).drop("_scanned")


def imported_releases(memory: DataFrame, grabs: DataFrame) -> DataFrame:
    """Releases that were imported (norm, codes, at), each with all the episodes it was for; grabs that have since
    been cleared stay remembered."""
    done = grabs.where("status = 'imported' and norm != ''").select("norm", "codes", "at")
    both = memory.select("norm", "codes", "at").unionByName(done)
    return both.groupBy("norm").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"), F.min("at").alias("at"))


def with_memory(candidates: DataFrame, memory: DataFrame) -> DataFrame:
    """Candidates (request, norm, covers, extra, ...) with `imported_before`: for one of the episodes they are for."""
    known = memory.select("norm", F.col("codes").alias("_codes"))
    before = F.coalesce(F.arrays_overlap(F.concat("covers", "extra"), F.col("_codes")), F.lit(False))
    return candidates.join(known, "norm", "left").withColumn("imported_before", before).drop("_codes")


def demoted(request: str, place: str, keep: int) -> list[Column]:
    """place_shown and whether a candidate is among those offered: those imported before come after all others, in
    their own order, and don't take the places of the `keep` that are shown."""
    w = Window.partitionBy(request).orderBy("imported_before", place)
    shown = F.row_number().over(w)
    return [shown.alias("place_shown"), (F.col("imported_before") | (shown <= keep)).alias("offered")]


def retries(failed: DataFrame, tried: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """The next release for each failed request (request, needs): the best candidate by `place` whose name has the
    title, which covers all that is needed and nothing else, wasn't tried (by guid or name), rejected or
    imported before. None for a request that has had `most` tries."""
    n = tried.groupBy("request").agg(F.count("*").alias("tries"))
    left = failed.join(n, "request", "left").where(F.coalesce("tries", F.lit(0)) < most).select("request", "needs")
    fit = candidates.where("kind = 'title' and not rejected and not imported_before and size(extra) = 0").join(left, "request").where(F.size(F.array_except("needs", "covers")) == 0)
    for by in ("guid", "norm"):
        fit = fit.join(tried.select("request", by).distinct(), ["request", by], "left_anti")
    return fit.groupBy("request").agg(F.min_by("guid", F.struct("place", "guid")).alias("guid"))


def grabbed_once(picks: DataFrame, releases: DataFrame) -> DataFrame:
    """What to grab for picks (request, guid): each guid once, for the first request that picked it; one that is no
    longer among the releases needs a new search."""
    first = picks.groupBy("guid").agg(F.min("request").alias("request"))
    there = releases.select("guid").distinct().withColumn("_there", F.lit(True))
    return first.join(there, "guid", "left").select("guid", "request", F.when(F.col("_there"), "grab").otherwise("search").alias("act"))


def put_back(moved: DataFrame, backups: DataFrame, files: DataFrame, filled: DataFrame) -> DataFrame:
    """What becomes of damaged files (rel, backup, episode) that were set aside: `restore`, unless the copy is gone,
    something is at the path again, or the episode has a file."""
    mark = lambda d, c, name: d.select(c).distinct().withColumn(name, F.lit(True))
    rows = moved.join(mark(backups, "backup", "_kept"), "backup", "left").join(mark(files, "rel", "_taken"), "rel", "left").join(mark(filled, "episode", "_filled"), "episode", "left")
    act = F.when(F.col("_kept").isNull(), "lost").when(F.col("_taken"), "taken").when(F.col("_filled"), "filled").otherwise("restore")
    return rows.select("rel", act.alias("act"))


def upgraded(requests: DataFrame) -> DataFrame:
    """Requests of an older form (grabs alone, no status) as followed ones; grabs given up on because the history
    didn't show them are looked up again, once. requests: (rel, status, grabs: array of (title, status,
    reason, rechecked))."""
    old = F.col("status").isNull()
    missed = lambda g: ~F.coalesce(g["rechecked"], F.lit(False)) & F.coalesce(g["reason"].rlike("history shows no grab|has no record"), F.lit(False))
    waiting = lambda g: F.struct(g["title"], F.lit("waiting").alias("status"), F.lit(None).cast("string").alias("reason"), F.coalesce(g["rechecked"], F.lit(False)).alias("rechecked"))
    again = lambda g: F.struct(g["title"], F.lit("waiting").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("rechecked"))
    kept = lambda g: F.struct(g["title"], g["status"], g["reason"], F.coalesce(g["rechecked"], F.lit(False)).alias("rechecked"))
    grabs = F.when(old, F.transform("grabs", waiting)).otherwise(F.transform("grabs", lambda g: F.when(missed(g), again(g)).otherwise(kept(g))))
    recheck = ~old & F.exists("grabs", missed)
    status = F.when(old | (recheck & F.col("status").isin("failed", "partly")), "waiting").otherwise(F.col("status"))
    return requests.select("rel", status.alias("status"), grabs.alias("grabs"), (recheck & F.col("status").isin("failed", "partly")).alias("recheck_only"))


# States of a queue's items, and how they read.
STATES = {
    "downloading": "downloading", "queued": "queued in the download client", "paused": "paused", "delay": "waiting (delay profile)",
    "downloadClientUnavailable": "download client unreachable", "completed": "downloaded", "failed": "failed", "warning": "needs attention",
}
TRACKED = {
    "importPending": "waiting to import", "importing": "importing", "imported": "imported", "importBlocked": "import blocked", "failedPending": "failing", "failed": "failed",
}


def progress(size: Column, left: Column, status: Column, tracked: Column) -> tuple[Column, Column]:
    """Per cent done (null without a size) and how the state reads."""
    named = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    plain = F.coalesce(F.try_element_at(named(STATES), status), status, F.lit(""))
    reads = F.when(tracked.isNull() | (tracked == "downloading"), plain).otherwise(F.try_element_at(named(TRACKED), tracked))
    return F.when(size > 0, F.round(100 * (size - left) / size).cast("long")), reads


def remembered(stream: DataFrame, path: str, step: Callable[[DataFrame, DataFrame], DataFrame], schema: str):
    """A stream whose batches update a table in the shared folder: batch k reads version k - 1 and writes version k,
    so a batch that runs again after a failure gives the same version again. Start it with a
    checkpointLocation; `latest_version` reads the table."""

    def keep(rows: DataFrame, k: int) -> None:
        spark = rows.sparkSession
        before = spark.read.schema(schema).parquet(f"{path}/version={k - 1}") if k else spark.createDataFrame([], schema)
        step(before, rows).write.mode("overwrite").parquet(f"{path}/version={k}")

    return stream.writeStream.foreachBatch(keep)


def latest_version(spark, path: str, schema: str) -> DataFrame:
    whole = spark.read.schema(schema + ", version int").parquet(path)
    last = whole.inputFiles()
    version = max(int(f.split("version=")[1].split("/")[0]) for f in last)
    return whole.where(F.col("version") == version).drop("version")


def settled_grabs(grabs: DataFrame, history: DataFrame, queue: DataFrame, have: DataFrame, now: Column, unseen: float = 1800, fresh: float = 300, gone: float = 900, stuck: float = 48 * 3600) -> DataFrame:
    """grab, status, reason and gone_since of waiting grabs (grab, at, download, episodes, gone_since).

    The history (download, kind: imported or failed) settles a grab first. One that never got a download within
    `unseen` seconds didn't happen. One older than `fresh` that has left the queue (download) is over: imported
    if all its episodes have files (have: episode), else failed once it has been gone for `gone` seconds. What
    is still there after `stuck` seconds is stuck.
    """
    ended = history.groupBy("download").agg(F.bool_or(F.col("kind") == "imported").alias("_imported"), F.bool_or(F.col("kind") == "failed").alias("_failed"))
    rows = grabs.join(ended, "download", "left").join(queue.select("download").distinct().withColumn("_queued", F.lit(True)), "download", "left")
    held = grabs.select("grab", F.explode("episodes").alias("episode")).join(have.select("episode").distinct().withColumn("_has", F.lit(1)), "episode", "left")
    rows = rows.join(held.groupBy("grab").agg(F.count("*").alias("_n"), F.count("_has").alias("_have")), "grab", "left")
    no, age = F.lit(False), now - F.col("at")
    left = F.col("download").isNotNull() & (age >= fresh) & F.col("_queued").isNull()
    here = left & (F.coalesce("_n", F.lit(0)) > 0) & (F.col("_n") == F.col("_have"))
    since = F.when(left & ~here, F.coalesce("gone_since", now))
    made = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    verdict = (
        F.when(F.coalesce("_imported", no), made("imported", None)).when(F.coalesce("_failed", no), made("failed", "download"))
        .when(F.col("download").isNull() & (age > unseen), made("failed", "not seen")).when(here, made("imported", None))
        .when(now - since >= gone, made("failed", "gone")).when(age > stuck, made("stuck", "two days")).otherwise(made("waiting", None))
    )
    return rows.withColumn("_v", verdict).select("grab", F.col("_v.status").alias("status"), F.col("_v.reason").alias("reason"), F.when(F.col("_v.status") == "waiting", since).alias("gone_since"))
