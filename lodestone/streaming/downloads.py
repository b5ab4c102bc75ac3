"""Downloads followed on one stream of what history, queue and imports say, with several deadlines for each.

Events of a grab are worked on in order of their time and never before the watermark has passed them, and its
deadlines fall due between them: so what comes late but within the watermark gives the same as what comes in
order, and any cut into batches gives what all events at once give (`followed`). Of a grab the stream keeps a few
values and the events that still wait; an ended grab is forgotten after `KEEP` seconds. Grabs are kept by buckets
of their keys, so that a call and a table go to a bucket and not to each grab.

Kinds of events: `grabbed`; `queued` and `absent` (the download is in a look at the queue, or not); `imported` and
`failed` (history); `blocked` (its import waits for something that can be put right). What comes out: `seen`;
`fix` (put an import right: three times at most, ten minutes apart); `imported`; `failed` with a reason
(`download`, `not seen` in half an hour, `gone` from the queue for a quarter of an hour, `import blocked`
after three fixes); `stuck` after two days, which an import or a failure may still end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, islice
from math import ceil
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UNSEEN, FRESH, GONE, STUCK = 1800.0, 300.0, 900.0, 48 * 3600.0
FIXES, BETWEEN_FIXES = 3, 600.0
KEEP = 7 * 86400.0
#: Events in one task of the batch form.
ROWS = 500_000
#: A bucket's grabs, in columns: key, next time to look at it, and `Grab.row`.
STATE = "grab array<{}>, due array<double>, since array<double>, seen array<boolean>, gone array<double>, fixes array<long>, fixed array<double>, status array<string>, ended array<double>, waiting_at array<array<double>>, waiting_kind array<array<string>>"
OUT = "at double, status string, reason string"


class Grab:
    """One grab's state."""

    def __init__(self, since=None, seen=False, gone=None, fixes=0, fixed=None, status="waiting", ended=None, waiting_at=(), waiting_kind=()):
        self.since, self.seen, self.gone, self.fixes, self.fixed, self.status, self.ended = since, seen, gone, fixes, fixed, status, ended
        self.waiting = list(zip(waiting_at, waiting_kind, strict=True))

    def row(self) -> tuple:
        return self.since, self.seen, self.gone, self.fixes, self.fixed, self.status, self.ended, [a for a, _ in self.waiting], [k for _, k in self.waiting]

    def deadline(self) -> tuple[float, str, str] | None:
        """The next time at which something follows from nothing happening."""
        if self.status != "waiting" or self.since is None:
            return None
        due = [(self.since + STUCK, "stuck", "two days")]
        if not self.seen:
            due.append((self.since + UNSEEN, "failed", "not seen"))
        if self.gone is not None:
            due.append((self.gone + GONE, "failed", "gone"))
        return min(due)

    def over(self, now: float) -> bool:
        """Whether it may be forgotten."""
        return self.ended is not None and self.status != "stuck" and now >= self.ended + KEEP and not self.waiting

    def due(self) -> float | None:
        """The next time at which something is to be done."""
        times = [self.waiting[0][0]] if self.waiting else []
        times += [x[0]] if (x := self.deadline()) else []
        times += [self.ended + KEEP] if self.ended is not None and self.status != "stuck" else []
        return min(times, default=None)

    def advance(self, until: float) -> list[tuple[float, str, str | None]]:
        """Go on to a time: what comes out on the way, events before deadlines of the same time."""
        out: list[tuple[float, str, str | None]] = []
        self.waiting.sort()
        while True:
            due = self.deadline()
            if self.waiting and (due is None or self.waiting[0][0] <= due[0]):
                at, kind = self.waiting[0]
                if at > until:
                    return out
                self.waiting.pop(0)
                out += self.take(at, kind)
            elif due and due[0] <= until:
                out.append(self.end(*due))
            else:
                return out

    def end(self, at: float, status: str, reason: str | None) -> tuple[float, str, str | None]:
        self.status, self.ended, self.gone = status, at, None
        return at, status, reason

    def take(self, at: float, kind: str) -> list[tuple[float, str, str | None]]:
        if self.status in ("imported", "failed"):
            return []
        self.since = at if self.since is None else self.since
        if kind == "imported":
            return [self.end(at, "imported", None)]
        if kind == "failed":
            return [self.end(at, "failed", "download")]
        if self.status == "stuck":
            return []
        if kind == "queued":
            new, self.seen, self.gone = not self.seen, True, None
            return [(at, "seen", None)] if new else []
        if kind == "absent" and self.seen and self.gone is None and at - self.since >= FRESH:
            self.gone = at
        if kind == "blocked" and (self.fixed is None or at - self.fixed >= BETWEEN_FIXES):
            if self.fixes == FIXES:
                return [self.end(at, "failed", "import blocked")]
            self.fixes, self.fixed = self.fixes + 1, at
            return [(at, "fix", str(self.fixes))]
        return []


def followed(events: DataFrame, key: str, now: float) -> DataFrame:
    """Batch form: what comes out of all events (key, at in seconds, kind) up to a time; later events wait. Rows
    without a key, a time or a kind are left out; rows that repeat count once."""
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = chain.from_iterable(zip(b[key].tolist(), b["at"].tolist(), b["kind"].tolist(), strict=True) for b in batches)
        grabs = ((k, Grab(waiting_at=at, waiting_kind=kinds)) for k, own in groupby(rows, itemgetter(0)) for _, at, kinds in [zip(*own, strict=True)])
        out = ((k, *x) for k, grab in grabs for x in grab.advance(now))
        while some := list(islice(out, 10_000)):
            yield pd.DataFrame(some, columns=[key, "at", "status", "reason"])

    # each part holds whole grabs, one after the other in order of time; a table for each of them would take most of the time
    rows = events.where(F.col(key).isNotNull() & F.col("at").isNotNull() & F.col("kind").isNotNull()).select(key, F.col("at").cast("double").alias("at"), "kind")
    parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS)
    return rows.repartition(parts, key).distinct().sortWithinPartitions(key, "at", "kind").mapInPandas(run, f"{key} {kind}, {OUT}")


def follow(events: DataFrame, key: str, late: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """Stream form: each row as soon as the watermark has passed what it follows from.

    A bucket's grabs are read and written together whenever one of them has something new or falls due: few buckets
    suit much that comes at once, many suit small batches over many open grabs. Their number holds for the
    life of a checkpoint, as does the number of shuffle partitions.
    """
    kind = events.schema[key].dataType.simpleString()
    held = kind if kind in ("tinyint", "smallint", "int", "bigint", "string") else "string"
    rows = events.where(F.col(key).isNotNull() & F.col("at").isNotNull() & F.col("kind").isNotNull()).select(F.col(key).cast(held).alias(key), F.col("at").cast("double").alias("at"), "kind")
    timed = rows.withColumns({"time": F.timestamp_seconds("at"), "_bucket": F.pmod(F.xxhash64(key), F.lit(buckets))}).withWatermark("time", late)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() / 1000
        kept = {k: own for k, *own in zip(*state.get, strict=True)} if state.exists else {}
        new: dict = {}
        for b in batches:
            for k, at, what in zip(b[key].tolist(), b["at"].tolist(), b["kind"].tolist(), strict=True):
                new.setdefault(k, set()).add((at, what))
        out = []
        for k in [*(k for k, own in kept.items() if own[0] is not None and own[0] <= now and k not in new), *new]:
            grab = Grab(*kept[k][1:]) if k in kept else Grab()
            grab.waiting = sorted({*grab.waiting, *new.get(k, ())})
            out += [(k, *x) for x in grab.advance(now)]
            if grab.over(now):
                kept.pop(k, None)
            else:
                kept[k] = (grab.due(), *grab.row())
        if kept:
            state.update(tuple(map(list, zip(*((k, *own) for k, own in kept.items()), strict=True))))
            if (due := min((own[0] for own in kept.values() if own[0] is not None), default=None)) is not None:
                # a time falls due once the watermark is past the timeout, by a millisecond or more
                state.setTimeoutTimestamp(max(ceil(due * 1000) - 1, state.getCurrentWatermarkMs(), 1))
        else:
            state.remove()
        for k in range(0, len(out), 10_000):
            yield pd.DataFrame(out[k : k + 10_000], columns=[key, "at", "status", "reason"])

    found = timed.groupBy("_bucket").applyInPandasWithState(step, f"{key} {held}, {OUT}", STATE.format(held), "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn(key, F.col(key).cast(kind))
