"""Fuzzy titles, assignments and thinned cards against plain loops; streams in several batches."""

from __future__ import annotations

import difflib
import random

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.operators import cards, names
from lodestone.streaming import grabs, memory


def _ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_fuzzy_titles_greedy_pairs_and_unique_codes(spark):
    """Every pair, one by one."""
    pairs = {(r["title"], r["page"]): r["score"] for r in registry.QUERIES["fuzzy_title_join"](spark, SF_DIR).collect()}
    titles = sorted({r["p_name"] for r in spark.read.parquet(f"{SF_DIR}/part.parquet").select("p_name").collect()})
    from lodestone.functions.text import norm_title

    norm = {r["t"]: r["n"] for r in spark.createDataFrame([(t,) for t in titles], "t string").select("t", norm_title(F.col("t")).alias("n")).collect()}
    pages = {t.upper(): norm[t].replace("e", "a") for t in titles}
    want = {(t, p): _ratio(norm[t], q) for t in titles for p, q in pages.items()}
    for k, v in pairs.items():
        assert abs(v - want[k]) < 1e-6
    assert {k for k, v in want.items() if v >= 0.85} == set(pairs)
    sizes = {(r["p_name"], r["p_size"]) for r in spark.read.parquet(f"{SF_DIR}/part.parquet").select("p_name", "p_size").collect()}
    taken = set()
    for size in {z for _, z in sizes}:
        used_a, used_b = set(), set()
        for v, t, p in sorted(((-v, t, p) for (t, p), v in pairs.items() if (t, size) in sizes)):
            if t not in used_a and p not in used_b:
                used_a.add(t)
                used_b.add(p)
                taken.add((size, t, p))
    assert {(r["p_size"], r["title"], r["page"]) for r in registry.QUERIES["greedy_assignment"](spark, SF_DIR).collect()} == taken
    for r in registry.QUERIES["title_code_unique"](spark, SF_DIR).collect():
        own = {p: v for (t, p), v in pairs.items() if t == r["title"]}
        exact, near = [p for p, v in own.items() if v == 1.0], [p for p, v in own.items() if v >= 0.92]
        assert r["page"] == (exact[0] if len(exact) == 1 else near[0] if not exact and len(near) == 1 else None)


def test_cards_that_are_thinned(spark):
    r = random.Random(2)
    rows = [(f, k, float(r.randint(0, 900)), r.randint(0, 20) / 20) for f in range(5) for k in range(40)]
    got = cards.thinned(spark.createDataFrame(rows, "file int, card int, time double, score double"), "file", 60.0).collect()
    want = set()
    for f in range(5):
        kept = []
        for _, k, t, s in sorted((x for x in rows if x[0] == f), key=lambda x: (-x[3], x[2])):
            if all(abs(t - u) >= 60 for u in kept):
                kept.append(t)
                want.add((f, t, s))
    assert {(x["file"], x["time"], x["score"]) for x in got} == want


def test_containment_by_broadcast_and_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The Big Red Fox jumps"), (2, "nothing here"), (3, "a big red fox and the big red fox jumps high"), (4, None)], "k int, text string")
    titles = spark.createDataFrame([(10, "big red fox"), (11, "red fox jumps"), (12, "fox"), (13, "nothing hereabouts")], "code int, title string")
    few = sorted(map(tuple, names.contained(docs, "k", "text", titles, "code", "title").collect()))
    monkeypatch.setattr(names, "BROADCAST_TITLES", 0)
    assert sorted(map(tuple, names.contained(docs, "k", "text", titles, "code", "title").collect())) == few
    assert {(k, c) for k, c, _, _ in few} == {(1, 10), (1, 11), (3, 10), (3, 11)}


def test_short_titles_count_where_a_name_is_kept_under_them(spark):
    docs = spark.createDataFrame([(1, 20, "show rain s01"), (2, 21, "show rain s01"), (3, 20, "rain and the big storm"), (3, 20, "another row"), (4, None, "rain fox")], "k int, own int, text string")
    titles = spark.createDataFrame([(20, "Rain"), (21, "Fox"), (22, "The Big Storm"), (20, "Rain"), (23, None)], "code int, title string")
    hits = names.contained(docs, "k", "text", titles, "code", "title", own="own")
    assert sorted((r["k"], r["code"], r["at"]) for r in hits.collect()) == [(1, 20, 6), (3, 20, 1), (3, 22, 10)]  # places in " words between spaces "
    got = {(r["k"], r["verdict"]) for r in names.verdict(hits, docs, "k", "code", "own").collect()}
    assert got == {(1, "match"), (2, None), (3, "match"), (4, None)}


@pytest.fixture
def files_of(spark, tmp_path):
    def make(batches, schema):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), str(tmp_path)

    return make


def test_a_file_in_two_batches_counts_once(spark, files_of):
    stream, path = files_of([[(1, "a"), (1, "a"), (2, "b")], [(1, "a"), (1, "c")], [(2, "b"), (1, "c")]], "series long, rel string")
    seen = []
    q = grabs.import_batches(stream, lambda rows, k: seen.extend(map(tuple, rows.collect())), f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [(1, "a"), (1, "c"), (2, "b")]


def test_late_rows_and_several_batches_of_sessions(spark, files_of):
    """Rows that come in a later batch but within the watermark join their session."""
    t = "2024-01-01 00:{:02d}:00"
    stream, path = files_of([[(1, t.format(0)), (1, t.format(20))], [(1, t.format(14)), (2, t.format(21))], [(1, t.format(59))]], "user long, ts string")
    rows = []
    q = grabs.sessions(stream, "user", "ts", "10 minutes", late="20 minutes").writeStream.outputMode("append").foreachBatch(lambda d, k: rows.extend(map(tuple, d.select("user", "n").collect()))).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(rows) == [(1, 1), (1, 2), (2, 1)]


def test_batch_that_runs_again_gives_the_same_table(spark, tmp_path):
    schema = "user_id long, rel long, at long, status string"
    step = lambda before, rows: memory.outcomes(before, rows, "user_id", last=2)
    batches = [spark.createDataFrame([(1, r, 10 * k + r, "OK") for r in range(3)], schema) for k in range(3)]

    class Stream:
        @property
        def writeStream(self):  # noqa: N802
            return self

        def foreachBatch(self, f):  # noqa: N802
            return f

    keep = memory.remembered(Stream(), str(tmp_path), step, schema)
    for k in (0, 1, 1, 2, 2):
        keep(batches[k], k)
    got = memory.latest_version(spark, str(tmp_path), schema).collect()
    assert sorted((x["rel"], x["at"]) for x in got) == [(1, 21), (2, 22)]
