"""Names through logs of operations against carrying them out, and plans after an undo."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_chain import library, segment

from lodestone.plans import chain, claims, history

OPS = "ordinal long, op string, src string, dst string"


def carried_out(start, ops):
    """name now -> name at the start (None: made by an operation)."""
    names = {p: p for p in start}
    for _, op, src, dst in sorted(ops):
        if op == "move":
            names[dst] = names.pop(src)
        else:
            names[dst] = None
    return names


def test_names_through_random_logs(spark):
    rng = random.Random(6)
    for _ in range(3):
        start = [f"f{i}" for i in range(30)]
        there, ops, n = set(start), [], 0
        for _ in range(120):
            n += rng.randint(1, 3)
            src = rng.choice(sorted(there))
            if rng.random() < 0.12:
                dst = f"made{n}"
                ops.append((n, rng.choice(["cut", "join", "create"]), src, dst))
            else:
                free = [f"f{i}" for i in range(34) if f"f{i}" not in there]
                dst = rng.choice(free + [f"new{n}"])
                ops.append((n, "move", src, dst))
                there.discard(src)
            there.add(dst)
        want = {now: before for now, before in carried_out(start, ops).items() if any(now in o[2:] for o in ops)}
        touched = {o[3] for o in ops}
        got = {r["now"]: r["before"] for r in history.names_before(spark.createDataFrame(ops, OPS)).collect()}
        assert got == {now: before for now, before in want.items() if now in touched}
        rows = spark.createDataFrame([(p, i) for i, p in enumerate(sorted(there))], "file string, x int")
        back = {r["file"] for r in history.restored(rows, spark.createDataFrame(ops, OPS)).collect()}
        assert back == {b for b in carried_out(start, ops).values() if b}
        on = history.followed(spark.createDataFrame([(p,) for p in start], "file string"), spark.createDataFrame(ops, OPS))
        assert {r["file"] for r in on.collect()} >= {now for now, b in carried_out(start, ops).items() if b}


def test_apply_and_undo_give_the_plan_before(spark):
    """Two files are swapped and a third moves; scanned under their new names and brought back, they give the same plan."""
    rows = [("Season 1/a S01E01.mkv", "MISMATCH", ["S01E01"], [segment("S01E02")]), ("Season 1/b S01E02.mkv", "MISMATCH", ["S01E02"], [segment("S01E01")]), ("Season 1/c.mkv", "MISMATCH", [], [segment("S01E03")]), ("Season 1/d S01E04.mkv", "OK", ["S01E04"], [segment("S01E04")]), ("Season 1/e S01E04.mkv", "OK", ["S01E04"], [segment("S01E04", end=1200.0)])]
    episodes = [(f"S01E{e:02d}", 1, e, False, True, 22.0) for e in range(1, 6)]
    files, eps, own = library(spark, rows, episodes)
    before = chain.whole_plan(files, eps, own)
    ticked = before.where("selected and kind in ('rename', 'aside')").select(F.col("file").alias("src"), F.col("targets")[0]["path"].alias("dst"))
    none = spark.createDataFrame([], "src string, dst string, start double, end double")
    ops = claims.operations(ticked, none, none.select("src", "dst", F.lit(1).alias("place")), files.select(F.col("file").alias("path")))
    applied = history.followed(files, ops)
    assert {r["file"] for r in applied.collect()} == {"Season 1/S01E01.mkv", "Season 1/S01E02.mkv", "Season 1/S01E03.mkv", "Season 1/e S01E04.mkv", "parked/duplicates/Season 1/d S01E04.mkv"}
    again = chain.whole_plan(history.restored(applied, ops), eps, own)
    assert sorted(map(str, again.collect())) == sorted(map(str, before.collect()))


def test_listed_files_and_empty_logs(spark):
    rows = spark.createDataFrame([("a", 1, ["x"]), ("gone", 2, ["x"])], "file string, size int, expected array<string>")
    listed = spark.createDataFrame([("a", ["y"]), ("b", ["y"]), ("b", ["z"])], "file string, expected array<string>")
    got = {r["file"]: (r["size"], r["expected"]) for r in history.with_new_files(rows, listed).collect()}
    assert got["a"] == (1, ["x"]) and got["b"][0] is None and got["b"][1] in (["y"], ["z"]) and len(got) == 2
    nothing = spark.createDataFrame([], OPS)
    assert history.names_before(nothing).count() == 0
    assert history.restored(rows, nothing).count() == 2 == history.followed(rows, nothing).count()


def test_page_patterns(spark):
    rows = [(1, 0, "Pilot/Transcript", "Pilot"), (1, 1, "Two (ep)", "Two"), (1, 2, "Three/Transcript", "Three"), (2, 0, "A (ep)", "A"), (2, 1, "B/x", "B"), (2, 2, "nothing", "C"), (2, 3, "B", ""), (2, 4, "B", None), (3, 0, None, "A"), (4, 0, "Two Two", "Two")]
    got = history.page_pattern(spark.createDataFrame(rows, "s int, k int, page string, title string"), "s", "page", "title", "k")
    assert {r["s"]: (r["pattern"], r["n"]) for r in got.collect()} == {1: ("{title}/Transcript", 2), 2: ("{title} (ep)", 1), 4: ("{title} Two", 1)}


def test_parts_grow_with_the_log(spark, monkeypatch):
    """Logs lie in more parts than shuffles have by themselves, and names stay; a file that moves to its own place keeps its name."""
    ops = [(i, "move", f"f{i % 50}" if i < 50 else f"g{i % 50}" if i < 100 else f"h{i % 50}", f"g{i % 50}" if i < 50 else f"h{i % 50}" if i < 100 else f"f{(i + 1) % 50}") for i in range(150)] + [(200, "move", "f3", "f3")]
    log = spark.createDataFrame(ops, OPS)
    want = {f"f{(i + 1) % 50}": f"f{i}" for i in range(50)}
    monkeypatch.setattr(history, "ROWS", 5)
    names = history.names_before(log)
    assert {r["now"]: r["before"] for r in names.where("before is not null and now like 'f%'").collect()} == want
    assert "hashpartitioning(ordinal" in (plan := names._jdf.queryExecution().executedPlan().toString()) and ", 30), REPARTITION_BY_NUM" in plan
