"""Collocations, line deduplication and resampling against brute force, and on rows that are out of the ordinary."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import SMALL_SF_DIR
from pyspark.sql import functions as F
from test_corpus_operators import ODD, SCHEMA

from lodestone.llm import collocations, line_dedup, resampling

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module", params=["table", "odd"])
def docs(spark, request):
    if request.param == "table":
        return spark.read.parquet(f"{SMALL_SF_DIR}/documents.parquet").cache()
    return spark.createDataFrame([(*r, "x", 1, None, 0.5, "y") for r in ODD], SCHEMA).cache()


def _collocations_wanted(rows, longest, support, inside, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\v\f\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    gone = set()
    for p, b in found.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                short = (p[0], *p[i : i + k])
                if short in found and 100 * b >= inside * found[short]:
                    gone.add(short)
    made = defaultdict(list)
    for (lang, *w), a in found.items():
        if (lang, *w) not in gone:
            cuts = []
            for k in range(1, len(w)):
                l, r = f[(lang, *w[:k])], f[(lang, *w[k:])]
                cuts.append((1_000_000 * a * a // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            made[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in made.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


@pytest.mark.parametrize("how", [{}, {"longest": 4, "support": 3, "inside": 80, "top": 25, "shards": 2}, {"longest": 2, "support": 5, "shards": 8}, {"filter_bits": 8, "support": 4}])
def test_collocations(docs, how):
    """With other limits, a filter so full that all pass, and longer phrases."""
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    want = _collocations_wanted(rows, **({"longest": 3, "support": 10, "inside": 50, "top": 2000} | {k: v for k, v in how.items() if k not in ("shards", "filter_bits")}))
    assert sorted(map(tuple, collocations.collocations(docs, **how).collect())) == want
    assert want


def test_collocations_of_long_texts_in_parts(spark):
    text = "One two, three FOUR five! " * 5000 + "tail " * 40
    rows = [(1, text, "en"), (2, text[:999], None), (3, "a", "en"), (4, "", "fr"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collocations.counted(docs, part=1000).where("k > 1")
    want = Counter()
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\n\v\f\r]", (t or "").translate(LOWER)):
            w = piece.split()
            want.update((k, lang or "und", " ".join(w[i : i + k])) for k in (2, 3) for i in range(len(w) - k + 1))
    assert {tuple(r)[:3]: r["f"] for r in got.collect()} == {k: v for k, v in want.items() if v >= 10}


def test_scores_of_large_counts_are_exact(spark):
    """Products of more than 64 bits: floor(10 ** 6 * a * a / (l * r)) by decimals equals that of whole numbers."""
    rows = [(99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_998), (33_333_333_333_333, 99_999_999_999_999, 77_777_777_777_777), (10, 10, 10), (12_345_678_901, 98_765_432_109, 12_345_678_902)]
    exact = lambda c: F.col(c).cast("decimal(14,0)")
    got = spark.createDataFrame(rows, "a long, l long, r long").select(F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")), exact("l") * exact("r"))).collect()
    assert [x[0] for x in got] == [10**6 * a * a // (l * r) for a, l, r in rows]


def _lines_left(rows, min_docs, min_chars):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add((d, t or ""))
    goes = {k for k, x in held.items() if len(x) >= min_docs and len(k) >= min_chars}
    return [(d, t, [x for x in (t or "").split("\n") if key(x) not in goes]) for d, t in rows]


@pytest.mark.parametrize("how", [{}, {"min_docs": 2}, {"min_docs": 2, "min_chars": 30}])
def test_line_dedup(docs, how):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = _lines_left(rows, how.get("min_docs", 10), how.get("min_chars", 1))
    got = line_dedup.deduplicated(docs, **how)
    assert got.columns == docs.columns
    left = sorted(((d, None if t is None and x == [""] else "\n".join(x)) for d, t, x in want), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == left


def test_line_dedup_counts(spark):
    """Copies of a row count once, two texts of one id twice, and lines differ in more than ends and case."""
    texts = [f"Own {i}\n \tSHARED line\v\n\nend  {i}" for i in range(9)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 5 + [(20, "shared  line\nz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.deduplicated(docs).collect())) == sorted(rows)
    docs = docs.union(spark.createDataFrame([(8, "shared line"), (None, None)], "doc_id long, text string"))
    got = [tuple(r) for r in line_dedup.deduplicated(docs).collect()]
    assert (8, "") in got and (None, None) in got and (20, "shared  line\nz") in got
    assert sorted(x for x in got if x[0] == 0) == [(0, "Own 0\n\nend  0")] * 6
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def _features(text, runs):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return len(w), [zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def _resampled(rows, target, runs, buckets, percent, min_words):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(x % buckets for x in _features(text, runs)[1])
    for text in target:
        t.update(x % buckets for x in _features(text, runs)[1])
    s_all, t_all, out = sum(s.values()), sum(t.values()), []
    for d, text in rows:
        n_words, own = _features(text, runs)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in (x % buckets for x in own))
        weight = gain // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    order = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    drawn = len(order) * percent // 100
    return [(*x[:4], i + 1 if i < drawn else None) for i, x in enumerate(order)] + [(*x[:4], None) for x in out if x[4] < min_words]


@pytest.mark.parametrize("how", [(1, 10_000, 10, 20), (3, 97, 35, 1)])
def test_resampling(spark, docs, how):
    runs, buckets, percent, min_words = how
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    target = spark.read.parquet(f"{SMALL_SF_DIR}/benchmark.parquet")
    scored = resampling.scores(docs, target, runs, buckets)
    got = resampling.ranked(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")
    want = _resampled(rows, [r["text"] for r in target.collect()], runs, buckets, percent, min_words)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    drawn = resampling.resample(docs, target, percent, min_words, runs=runs, buckets=buckets)
    assert drawn.columns == docs.columns
    assert sorted((r["doc_id"] for r in drawn.collect()), key=repr) == sorted((x[0] for x in want if x[4]), key=repr)


def test_runs_do_not_depend_on_parts():
    text = " ".join(f"w{i % 13}é{'x' * (i % 50)}" for i in range(300)).encode()
    for runs in (1, 2, 4):
        whole = sorted(_features(text.decode(), runs)[1])
        for part in (1, 7, 64, 1 << 20):
            assert sorted(x for _, y in resampling.hashed_runs(text, runs, part) for x in y) == whole


def test_no_rows(docs):
    none = docs.limit(0)
    assert collocations.collocations(none).count() == 0
    assert resampling.ranked(resampling.scores(none, docs.select("text"))).count() == 0
    assert resampling.ranked(resampling.scores(docs, none)).count() == docs.count()
