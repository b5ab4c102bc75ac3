"""Downloads followed on a stream: against the batch form over batches with late rows, and that against a clock that ticks."""

from __future__ import annotations

import random

import pytest
from conftest import SMALL_SF_DIR

import lodestone.queries  # noqa: F401
from lodestone import registry
from lodestone.streaming import downloads

SCHEMA = "grab long, at double, kind string"


def ticking(events, until):
    """Every second on its own; each rule written out."""
    s = {"since": None, "seen": False, "gone": None, "fixes": 0, "fixed": None, "status": "waiting"}
    out, by_time = [], {}
    for at, kind in sorted(set(events)):
        by_time.setdefault(at, []).append(kind)

    def over(t, status, reason):
        s["status"], s["gone"] = status, None
        out.append((float(t), status, reason))

    for t in range(0, until + 1):
        for kind in by_time.get(t, []):
            if s["status"] in ("imported", "failed"):
                continue
            if s["since"] is None:
                s["since"] = t
            if kind in ("imported", "failed"):
                over(t, kind, None if kind == "imported" else "download")
            elif s["status"] == "stuck":
                pass
            elif kind == "queued":
                if not s["seen"]:
                    out.append((float(t), "seen", None))
                s["seen"], s["gone"] = True, None
            elif kind == "absent":
                if s["seen"] and s["gone"] is None and t - s["since"] >= 300:
                    s["gone"] = t
            elif kind == "blocked" and (s["fixed"] is None or t - s["fixed"] >= 600):
                if s["fixes"] == 3:
                    over(t, "failed", "import blocked")
                else:
                    s["fixes"], s["fixed"] = s["fixes"] + 1, t
                    out.append((float(t), "fix", str(s["fixes"])))
        if s["status"] == "waiting" and s["since"] is not None:
            if s["gone"] is not None and t == s["gone"] + 900:
                over(t, "failed", "gone")
            elif not s["seen"] and t == s["since"] + 1800:
                over(t, "failed", "not seen")
            elif t == s["since"] + 48 * 3600:
                over(t, "stuck", "two days")
    return out


def _events(rng, n=60):
    rows = []
    for g in range(n):
        at = rng.randrange(0, 5000)
        rows.append((g, float(at), "grabbed"))
        for _ in range(rng.randrange(0, 9)):
            at += rng.choice([60, 200, 300, 600, 900, 1700, 40000])
            rows.append((g, float(at), rng.choice(["queued", "queued", "queued", "absent", "absent", "blocked", "blocked", "imported", "failed"])))
    return rows


def test_batch_form_equals_a_ticking_clock(spark):
    rows = _events(random.Random(2), 120)
    rows += [(500, float(t), k) for t, k in ((0, "grabbed"), (10, "queued"), (100, "blocked"), (200, "blocked"), (700, "blocked"), (1300, "blocked"), (1899, "blocked"), (1900, "blocked"), (2000, "imported"))]
    until = 260_000
    want = {(g, *x) for g in {r[0] for r in rows} for x in ticking([(a, k) for h, a, k in rows if h == g], until)}
    df = spark.createDataFrame(rows + rows[:20] + [(None, 1.0, "queued"), (1, None, "queued"), (1, 3.0, None)], SCHEMA)
    assert {tuple(r) for r in downloads.followed(df, "grab", float(until)).collect()} == want
    assert {x[2:] for x in want} >= {("seen", None), ("fix", "1"), ("fix", "3"), ("imported", None), ("failed", "download"), ("failed", "gone"), ("failed", "not seen"), ("failed", "import blocked"), ("stuck", "two days")}


@pytest.mark.parametrize("seed", [1])
def test_stream_of_late_rows_equals_the_batch_form(spark, tmp_path, seed):
    """Five micro-batches; each row may come up to ten minutes of event time late; an end that comes after a deadline."""
    rng = random.Random(seed)
    rows = sorted(_events(rng, 25), key=lambda r: r[1] + rng.choice([0, 0, 500]))
    rows.append((999, 900_000.0, "grabbed"))  # moves the watermark past the deadlines
    cuts = [0, *sorted(rng.sample(range(1, len(rows) - 1), 3)), len(rows) - 1, len(rows)]
    # rows of a batch that the watermark of an earlier one has passed would be dropped: keep what is late within bounds
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for k, part in enumerate(parts):
        before = max((r[1] for p in parts[:k] for r in p), default=0.0)
        assert all(r[1] > before - 600 for r in part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got: list = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = downloads.follow(stream, "grab").writeStream.outputMode("append").foreachBatch(lambda d, k: got.extend(map(tuple, d.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) >= 4
    want = {tuple(r) for r in downloads.followed(spark.createDataFrame(rows, SCHEMA), "grab", 900_000.0 - 600).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_stream_in_pieces_equals_all_at_once(spark):
    rows = {name: sorted(map(tuple, registry.QUERIES[name](spark, SMALL_SF_DIR).collect())) for name in ("followed_downloads", "stream_downloads")}
    assert rows["followed_downloads"] == rows["stream_downloads"] and len(rows["stream_downloads"]) > 50


def test_grabs_of_a_part_are_followed_one_after_the_other(spark):
    """No group of its own for each grab, and grabs that lie across two batches are whole."""
    rows = _events(random.Random(4), 40)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in downloads.followed(df, "grab", 260_000.0).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = downloads.followed(df, "grab", 260_000.0)
        assert {tuple(r) for r in out.collect()} == want and len(want) > 40
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_grabs_of_a_bucket_are_kept_together(spark, tmp_path):
    """A row of state for a bucket, not for each grab; a deadline at the very watermark; an ended grab is forgotten beside one that waits."""
    later = 1_000_000.0 - 600 + downloads.KEEP
    ended = (900, 5.0, "imported")
    pieces = [[*_events(random.Random(5), 40), ended], [(999, 1_000_000.0, "grabbed")], [(901, later, "grabbed")], [(900, later + 100, "queued"), (999, later + 2400, "absent")]]
    got: list = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for piece in pieces:
            spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = downloads.follow(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "grab", buckets=3)
            q = stream.writeStream.outputMode("append").foreachBatch(lambda d, k: got.extend(map(tuple, d.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(900, *x) for x in ((5.0, "imported", None), (later + 100, "seen", None))} == {x for x in got if x[0] == 900}
    assert (901, later + 1800, "failed", "not seen") in got
    rest = spark.createDataFrame([r for piece in pieces for r in piece if r != ended], SCHEMA)
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in downloads.followed(rest, "grab", later + 1800).collect()} | {(900, 5.0, "imported", None)}


@pytest.mark.parametrize("kind", ["string", "date"])
def test_keys_of_other_types(spark, tmp_path, kind):
    rows = spark.createDataFrame([("2024-01-01", 10.0, "queued"), ("2024-01-02", 5000.0, "queued")], "grab string, at double, kind string").selectExpr(f"cast(grab as {kind}) grab", "at", "kind")
    rows.write.parquet(f"{tmp_path}/in")
    got: list = []
    stream = downloads.follow(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "grab", buckets=1)
    assert stream.schema["grab"].dataType == rows.schema["grab"].dataType
    stream.writeStream.outputMode("append").foreachBatch(lambda d, k: got.extend(map(tuple, d.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert set(got) == set(map(tuple, downloads.followed(rows, "grab", 5000.0 - 600).collect())) and len(got) == 1
