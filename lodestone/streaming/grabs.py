"""Stateful streams: downloads on their way, import batches, sessions and hops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Status of a grab after its history: a failure or an import ends it; too long without either, it is stuck.
STUCK_SECONDS = 48 * 3600


def grab_status(history: DataFrame, key: str, now: float) -> DataFrame:
    """Batch form: status of each grab from its events (at, kind) up to `now`."""
    ended = history.where(F.col("kind").isin("imported", "failed")).groupBy(key).agg(F.min_by("kind", F.struct("at", "kind")).alias("end"))
    first = history.groupBy(key).agg(F.min("at").alias("since"))
    rows = first.join(ended, key, "left")
    return rows.select(key, F.coalesce("end", F.when(now - F.col("since") > STUCK_SECONDS, "stuck").otherwise("waiting")).alias("status"))


def grab_stream(history: DataFrame, key: str, kind: str = "long", late: str = "10 minutes") -> DataFrame:
    """Stream form: a row (key, status) whenever a grab's status changes. Without an end it is stuck once
    the watermark is STUCK_SECONDS past its first event; the first end by (at, kind) counts, also when
    it comes after that. `at` are seconds."""
    timed = history.withColumn("time", F.timestamp_seconds("at")).withWatermark("time", late)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, since, ended = state.get if state.exists else (None, None, None)
        status = before or "waiting"
        for rows in batches:
            least = float(rows["at"].min())
            since = least if since is None else min(since, least)
            ends = rows[rows["kind"].isin(["imported", "failed"])]
            if len(ends):
                first = min(zip(ends["at"].astype(float), ends["kind"], strict=True))
                if ended is None or first < (ended, status):
                    ended, status = first
        if status == "waiting":
            deadline = int((since + STUCK_SECONDS) * 1000)
            if state.hasTimedOut or deadline <= state.getCurrentWatermarkMs():
                status = "stuck"
            else:
                state.setTimeoutTimestamp(deadline)
        state.update((status, since, ended))
        if status != before:
            yield pd.DataFrame({key: [k[0]], "status": [status]})

    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string", "status string, since double, ended double", "update", GroupStateTimeout.EventTimeTimeout)


def rollup(requests: DataFrame, grabs: DataFrame, key: str) -> DataFrame:
    """imported if all that was wanted has come; else partly, stuck, failed or waiting."""
    got = grabs.groupBy(key).agg(F.collect_set(F.when(F.col("status") == "imported", F.col("code"))).alias("got"), F.bool_or(F.col("status") == "stuck").alias("stuck"), F.bool_and(F.col("status") == "failed").alias("failed"))
    rows = requests.join(got, key, "left")
    have = F.coalesce("got", F.array().cast(got.schema["got"].dataType))
    status = F.when(F.size(F.array_except("want", have)) == 0, "imported").when(F.size(have) > 0, "partly").when(F.coalesce("stuck", F.lit(False)), "stuck").when(F.coalesce("failed", F.lit(False)), "failed").otherwise("waiting")
    return rows.select(key, status.alias("status"))


def queue_match(queue: DataFrame, by_id: DataFrame, by_title: DataFrame, by_episode: DataFrame) -> DataFrame:
    """Each queue item's grab: by download id, else by normalised title, else by episode."""
    rows = queue.join(by_id, "download_id", "left").join(by_title, "norm", "left").join(by_episode, "episode", "left")
    return rows.select("item", F.coalesce("grab_by_id", "grab_by_title", "grab_by_episode").alias("grab"))


def import_batches(imports: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, time: str | None = None, late: str = "7 days"):
    """Each micro-batch is one scan: what arrives while one runs waits for the next. A file (series, rel) counts
    once, whatever batches it comes in: state remembers it, for `late` if there is a column of times."""
    keys = ["series", "rel"]
    once = imports.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if time else imports.dropDuplicates(keys)
    return once.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def joined_batches(batches: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Batches of imports (series, batch, rel, started) after arrivals (series, rel): these join their series' batch
    that hasn't started yet, or open the next one; what waits there already isn't added again."""
    last = batches.groupBy("series").agg(F.max("batch").alias("_last"), F.max(F.when(~F.col("started"), F.col("batch"))).alias("_open"))
    new = arrivals.select("series", "rel").distinct().join(last, "series", "left")
    new = new.select("series", F.coalesce("_open", F.col("_last") + 1, F.lit(1)).cast("long").alias("batch"), "rel", F.lit(False).alias("started"))
    fresh = new.join(batches.where("not started").select("series", "rel"), ["series", "rel"], "left_anti")
    return batches.select("series", "batch", "rel", "started").unionByName(fresh.select("series", "batch", "rel", "started"))


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events with gaps below `gap`, with a watermark on streams."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if events.isStreaming else timed
    w = F.session_window(time, gap)
    return timed.groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def hops(events: DataFrame, time: str, size: str, step: str, late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if events.isStreaming else timed
    return timed.groupBy(F.window(time, size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
