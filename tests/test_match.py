"""The match of whole files against plain loops over its steps."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import match, tfidf
from lodestone.operators.tfidf import _WORD, _plain
from lodestone.storage import stored


def _plain_match(cues, refs, background, stop, min_seconds=240.0):
    def words(t):
        """Single words and pairs of neighbours, stop words taken out before."""
        w = [w for w in _WORD.findall(_plain(t)) if w not in stop]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    texts = [*refs.values(), *background.values()]
    df = Counter(w for t in texts for w in set(words(t)))
    n = len(texts)
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in df.items() if n < 10 or d <= 0.6 * n}

    def vector(t):
        x = {w: (1 + math.log(c)) * idf[w] for w, c in Counter(words(t)).items() if w in idf}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / size for w, v in x.items()} if size else {}

    rv = {c: vector(t) for c, t in sorted(refs.items())}
    codes = list(rv)
    score = lambda t: [sum(v * rv[c].get(w, 0) for w, v in vector(t).items()) for c in codes]
    files = defaultdict(list)
    for k, s, e, t in cues:
        files[k].append((s, e, t))
    out = []
    for k, own in sorted(files.items()):
        own.sort()
        end = max(e for _, e, _ in own)
        rows, at = [], []
        for i in range(math.ceil(max(end - 45, 45) / 45)):
            t = " ".join(x for s, e, x in own if e > i * 45 and s < i * 45 + 90)
            rows.append((score(t) if len(t.split()) >= 8 else [0.0] * len(codes)) + [0.12 * 0.6])
            at.append((i * 45.0, min(i * 45.0 + 90, end)))
        total, back = list(rows[0]), []
        for r in rows[1:]:
            best = max(range(len(total)), key=lambda j: (total[j], -j))
            back.append([best if total[best] - 0.22 > total[j] else j for j in range(len(r))])
            total = [max(total[j], total[best] - 0.22) + r[j] for j in range(len(r))]
        path = [max(range(len(total)), key=lambda j: (total[j], -j))]
        for b in reversed(back):
            path.append(b[path[-1]])
        path.reverse()
        runs = []
        for state, (s, e) in zip(path, at, strict=True):
            if runs and runs[-1][0] == state:
                runs[-1][2] = e
            else:
                if runs and runs[-1][2] > s:
                    runs[-1][2] = s = (runs[-1][2] + s) / 2
                runs.append([state, s, e])
        kept = []
        for state, s, e in runs:
            if state < len(codes) and (e - s >= min_seconds or e - s >= 0.35 * end):
                if kept and kept[-1][0] == state:
                    kept[-1][2] = e
                else:
                    kept.append([state, s, e])
        segs = []
        for _, s, e in kept:
            text = " ".join(x for a, b, x in own if b > s and a < e)
            top = sorted(((round(v, 4), -j) for j, v in enumerate(score(text)) if v > 0), reverse=True)[:4]
            (best, j), second = top[0], top[1][0] if len(top) > 1 else 0.0
            margin = round(best - second, 4)
            high = best >= (0.35 if len(codes) < 5 else 0.12) and margin >= 0.04 and best >= 1.4 * second
            if segs and segs[-1][3] == codes[-j]:
                segs[-1][2], segs[-1][4] = round(e, 1), max(segs[-1][4], best)
            else:
                segs.append([k, round(s, 1), round(e, 1), codes[-j], best, margin, "high" if high else "low", [codes[-i] for _, i in top[1:]], len(text.split())])
        out += [tuple(x) for x in segs]
    return out


@pytest.mark.parametrize(("count", "limit"), [(40, {}), (3, {}), (40, {"min_seconds": 60.0})])
def test_segments_equal_plain_loops(spark, count, limit):
    """Files made of passages of some references one after the other, with silence and words of their own."""
    import random

    r = random.Random(5)
    names = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    refs = {c: " ".join(r.choice(names[c * 5 : c * 5 + 60]) for _ in range(400)) for c in range(1, count + 1)}
    cues = []
    for k in range(12):
        t = 0.0
        for c in r.sample(sorted(refs), min(3, count)):
            said = refs[c].split()
            for i in range(r.randint(8, 40)):
                start = r.randrange(len(said) - 9)
                cues.append((k, t, t + 4.0, " ".join(said[start : start + 9]) if r.random() < 0.8 else "Café quiet the the"))
                t += 5.0
            t += r.choice([0, 0, 150])
    background = {k: " ".join(t for f, _, _, t in cues if f == k) for k in range(12)}
    df = spark.createDataFrame(cues, "file long, start double, end double, text string")
    own = spark.createDataFrame(list(background.items()), "file long, text string")
    stop = tfidf.english_stop_words()
    got = match.segments(df, spark.createDataFrame(list(refs.items()), "code long, text string"), "file", "code", background=own, stop=stop, **limit)
    got = got.orderBy("file", "segment").select("file", "start", "end", "code", "score", "margin", "confidence", F.col("alternatives.code"), "words").collect()
    want = _plain_match(cues, refs, background, stop, **limit)
    assert len(want) >= (8 if count > 3 else 4)
    for g, w in zip(map(tuple, got), want, strict=True):
        assert g[:4] == w[:4] and g[6:] == w[6:] and abs(g[4] - w[4]) < 2e-4 and abs(g[5] - w[5]) < 2e-4


def test_no_cues(spark):
    none = spark.createDataFrame([], "file long, start double, end double, text string")
    refs = spark.createDataFrame([(1, "some words of a reference")], "code long, text string")
    assert match.segments(none, refs, "file", "code").count() == 0


def test_parts_grow_with_the_cues(spark, monkeypatch):
    """Scores of windows lie in more parts than shuffles have by themselves."""
    cues = spark.createDataFrame([(k, 30.0 * i, 30.0 * i + 20, "one two three four five six seven eight nine ten") for k in range(4) for i in range(10)], "k int, start double, end double, text string")
    refs = spark.createDataFrame([("a", "one two three"), ("b", "seven eight")], "r string, text string")
    weights = tfidf.Weights(stored(tfidf.fit(tfidf.counts(refs, "r"), refs.agg(F.count("*").alias("n"))).idf, "idf"))
    rows = match.emissions(cues, weights, stored(weights.vectors(tfidf.counts(refs, "r"), "r"), "vectors"), "k", "r", 0.1, 90.0, 45.0, 8, 40)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 40), REPARTITION_BY_NUM") == 3 and rows.count() == 4
    assert not any(line.strip(" :+-").startswith("Exchange") and "ENSURE" in line for line in plan.splitlines())
