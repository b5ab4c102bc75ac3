"""The whole plan against a plain loop over one library after another, and the cases that its stages are for."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from conftest import SMALL_SF_DIR
from test_plan import _choice, _plain

from lodestone.plans import build, chain
from lodestone.queries.plans import library_input

SEGMENTS = f"array<{build.SEGMENT}>"
FILES = f"file string, status string, expected array<string>, duration double, hold boolean, segments {SEGMENTS}, season_hint long"
EPISODES = "code string, season long, number long, low_trust boolean, aired boolean, runtime double"


def path_of(file, codes, season):
    return f"Season {season}/{'-'.join(codes)}{re.search(r'(\.[^./]*)?$', file)[0]}"


def parts_of(file):
    m = list(re.finditer(r" - Part (\d+)", file))
    return (re.sub(r"[^a-z0-9]+", " ", (file[: m[-1].start()] + " " + file[m[-1].end() :]).lower()), int(m[-1][1])) if m else None


def by_hand(files, eps, overrides):
    base = _plain(files, eps, overrides, True)
    files = {f["file"]: {**f, "segments": [dict(s) for s in f["segments"]]} for f in files}
    for k, own in overrides.items():
        f = files.get(k)
        if f and not (len(own) == len(f["segments"]) and len(own) > 1):
            f["segments"] = [{"start": 0.0, "end": f["duration"], "code": c, "override": c, "score": 1.0, "confidence": "manual", "model_code": None, "title_card": False} for c in own]
        elif f:
            for s, c in zip(f["segments"], own, strict=True):
                s["override"] = c
    best = {}
    usable = {}
    for k, f in files.items():
        usable[k] = [(s, c, strength) for s in f["segments"] for c, strength in [_choice(s)] if c and strength != "low"]
        for s, c, strength in usable[k]:
            best[c] = max(best.get(c, ()), ({"manual": 3, "high": 2, "ai": 1}[strength], c in f["expected"], s["score"], k, s["start"]))
    items = {}
    for k, (kind, reason, codes, selected, shaky, claimed) in base.items():
        t = []
        if kind == "rename":
            t = [(path_of(k, codes, eps[codes[0]]["season"]), tuple(codes), None, None, False)]
        elif kind == "split":
            for s, c, _ in usable[k]:
                dup = best[c][3:] != (k, s["start"])
                p = path_of(k, [c], eps[c]["season"])
                t.append((f"parked/duplicates/{p.split('/')[-1]}" if dup else p, (c,), s["start"], s["end"], dup))
        elif kind == "aside":
            t = [(f"parked/{'unverified' if reason == 'unverified' else 'duplicates'}/{k}", (), None, None, False)]
        items[k] = {"kind": kind, "reason": reason, "codes": codes, "selected": selected, "ref_warning": shaky, "claimed_by": claimed, "eliminated": False, "targets": t, "sources": [k], "expected": files[k]["expected"]}
    covered = set()
    for it in items.values():
        covered |= set(it["expected"]) if it["kind"] == "ok" else {c for t in it["targets"] if not t[4] for c in t[1]} if it["kind"] in ("rename", "split") else set()
    named = defaultdict(list)
    for it in items.values():
        for c in it["expected"]:
            named[c].append(it)
    open_ = {k for k, it in items.items() if it["kind"] == "review" and len(it["expected"]) < 2 and not it["claimed_by"] and not any(s["confidence"] in ("high", "manual") and s["code"] not in it["expected"] for s in files[k]["segments"])}
    seasons = defaultdict(list)
    for k in open_:
        exp = items[k]["expected"]
        n = eps.get(exp[0], {}).get("season") if exp else files[k]["season_hint"]
        if n is not None:
            seasons[n].append(k)
    for n, ks in seasons.items():
        left = [c for c, e in eps.items() if e["season"] == n and e["aired"] and c not in covered and all(o["kind"] == "review" for o in named[c])]
        if len(ks) == len(left) == 1:
            it, c = items[ks[0]], left[0]
            covered.add(c)
            it.update(reason="elimination", eliminated=True, selected=False)
            if c in it["expected"]:
                it["kind"] = "ok"
            else:
                it.update(kind="rename", codes=[c], targets=[(path_of(ks[0], [c], n), (c,), None, None, False)])
    sure = {(eps[c]["season"], eps[c]["number"]) for it in items.values() if it["kind"] == "ok" for c in it["expected"] if c in eps}
    for k in open_:
        it = items[k]
        if it["kind"] == "review" and len(it["expected"]) == 1 and it["expected"][0] in eps:
            c = it["expected"][0]
            e = eps[c]
            if c not in covered and len(named[c]) == 1 and {(e["season"], e["number"] - 1), (e["season"], e["number"] + 1)} <= sure:
                it.update(kind="ok", reason="between neighbours", eliminated=True)
    groups = defaultdict(list)
    for k in files:
        if p := parts_of(k):
            groups[p[0]].append((p[1], k))
    joins = {}
    for g in groups.values():
        g.sort()
        ks, nums = [k for _, k in g], [n for n, _ in g]
        if len(g) < 2 or len(set(nums)) < len(nums):
            continue
        exp = [tuple(files[k]["expected"]) for k in ks]
        names = {c for e in exp for c in e}
        if len(names) > 1 and all(c in eps for c in names):
            continue
        held = [{c for _, c, _ in usable[k]} for k in ks]
        heard = set().union(*held)
        same = len(set(exp)) == 1 and len(exp[0]) == 1
        code = next(iter(heard)) if len(heard) == 1 and all(h == heard for h in held) else exp[0][0] if same and heard <= set(exp[0]) else None
        if code not in eps:
            continue
        gap, long = max(nums) > len(nums), bool(eps[code]["runtime"]) and sum(files[k]["duration"] for k in ks) > 96 * eps[code]["runtime"]
        joins[ks[0]] = {"kind": "join", "reason": "parts, some missing" if gap else "parts, too long" if long else "parts", "codes": [code], "selected": not gap and not long, "ref_warning": False, "claimed_by": None, "eliminated": False, "targets": [(path_of(ks[0], [code], eps[code]["season"]), (code,), None, None, False)], "sources": ks}
    used = {k for j in joins.values() for k in j["sources"]}
    order = [*sorted(joins.items()), *sorted((k, it) for k, it in items.items() if k not in used)]
    return {(k, it["kind"]): (i, it) for i, (k, it) in enumerate(order)}


def compare(spark, files, episodes, overrides):
    rows = chain.whole_plan(files, episodes, overrides).collect()
    eps = {r["code"]: r.asDict() for r in episodes.collect()}
    want = by_hand([r.asDict(recursive=True) for r in files.collect()], eps, {r["file"]: r["codes"] for r in overrides.collect()})
    names = ("reason", "codes", "selected", "ref_warning", "claimed_by", "eliminated", "sources")
    got = {(r["file"], r["kind"]): (r["id"], *(r[n] for n in names), [(t["path"], tuple(t["codes"]), t["start"], t["end"], t["duplicate"]) for t in r["targets"]]) for r in rows}
    assert got.keys() == want.keys()
    for k, (i, it) in want.items():
        assert got[k] == (i, *(it[n] for n in names), it["targets"]), k
    return rows


def test_whole_plan_equals_plain_loop(spark):
    rows = compare(spark, *library_input(spark, SMALL_SF_DIR))
    kinds, reasons = Counter(r["kind"] for r in rows), Counter(r["reason"] for r in rows)
    assert set(kinds) == {"join", "split", "rename", "aside", "review", "ok"}, kinds
    assert {"elimination", "parts", "parts, too long", "duplicate", "unverified"} <= set(reasons), reasons


def segment(code, conf="high", end=1300.0):
    return (0.0, end, code, 0.4, conf, None, None, False)


def library(spark, rows, episodes, overrides=()):
    made = [(name, status, list(exp), 1300.0, False, segs, int(m[1]) if (m := re.search(r"Season (\d+)", name)) else None) for name, status, exp, segs in rows]
    return spark.createDataFrame(made, FILES), spark.createDataFrame(episodes, EPISODES), spark.createDataFrame(list(overrides), "file string, codes array<string>")


def test_elimination(spark):
    """Four seasons: one file and one episode left as named; as offered; a file between neighbours; two files and three episodes."""
    name = lambda s, e: f"Season {s}/Show - S{s:02d}E{e:02d} - x.mkv"
    code = lambda s, e: f"S{s:02d}E{e:02d}"

    def f(s, e, holds=None, conf="high", path=None):
        exp = [code(s, e)] if path is None else []
        segs = [segment(holds, conf)] if holds else []
        status = "NO_MATCH" if not holds else "LOW_CONFIDENCE" if conf == "low" else "OK" if exp == [holds] else "MISMATCH"
        return path or name(s, e), status, exp, segs

    rows = [f(1, 1, "S01E01"), f(1, 2, "S01E02"), f(1, 3, "S01E05", "low"), f(1, 4, "S01E04"), f(1, 5, "S01E05"), f(2, 1, "S02E01"), f(2, 2, "S02E02"), f(2, 0, path="Season 2/Show - unknown episode.mkv"), f(3, 1, "S03E01"), f(3, 2, "S03E04", "low"), f(3, 3, "S03E03"), f(4, 1, "S04E03", "low"), f(4, 2, "S04E01", "low")]
    episodes = [(code(s, e), s, e, False, True, 22.0) for s, n in ((1, 5), (2, 3), (3, 4), (4, 3)) for e in range(1, n + 1)]
    items = {r["file"]: r for r in compare(spark, *library(spark, rows, episodes))}
    a, b, c = items[name(1, 3)], items["Season 2/Show - unknown episode.mkv"], items[name(3, 2)]
    assert (a["kind"], a["reason"]) == ("ok", "elimination")
    assert (b["kind"], b["codes"], b["selected"], b["targets"][0]["path"]) == ("rename", ["S02E03"], False, "Season 2/S02E03.mkv")
    assert (c["kind"], c["reason"]) == ("ok", "between neighbours")
    assert items[name(4, 1)]["kind"] == items[name(4, 2)]["kind"] == "review"


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        ([(1, ["S01E01"], "S01E01", "high"), (2, ["S01E01"], "S01E01", "high")], ("parts", True)),
        ([(1, ["S01E01"], None, "high"), (2, ["S01E01"], "S01E01", "high")], ("parts", True)),
        ([(1, ["S01E01"], "S01E01", "high"), (3, ["S01E01"], "S01E01", "high")], ("parts, some missing", False)),
        ([(1, [], "S01E01", "high"), (2, [], "S01E01", "high")], ("parts", True)),
        ([(1, ["S01E01"], "S01E01", "high"), (2, ["S01E01"], "S01E02", "high")], None),
        ([(1, ["S01E01"], "S01E01", "high"), (2, ["S01E02"], "S01E01", "high")], None),
        ([(1, ["S01E01"], "S01E02", "low"), (2, ["S01E01"], "S01E02", "low"), (3, ["S01E01"], None, "low")], ("parts, too long", False)),
    ],
)
def test_parts(spark, parts, want):
    rows = [(f"Season 1/Show S01E01 - Part {n}.mkv", "OK" if holds else "NO_MATCH", exp, [segment(holds, conf)] if holds else []) for n, exp, holds, conf in parts]
    episodes = [("S01E01", 1, 1, False, True, 30.0), ("S01E02", 1, 2, False, True, 30.0)]
    joins = [(r["reason"], r["selected"]) for r in compare(spark, *library(spark, rows, episodes)) if r["kind"] == "join"]
    assert joins == ([want] if want else [])


def test_a_file_in_its_place_and_no_files(spark):
    rows = [("Season 1/S01E01.mkv", "MISMATCH", ["S01E02"], [segment("S01E01")]), ("Season 1/other.mkv", "MISMATCH", ["S01E02"], [segment("S01E02")])]
    episodes = [("S01E01", 1, 1, False, True, None), ("S01E02", 1, 2, None, True, 0.0)]
    got = {r["file"]: (r["kind"], r["reason"]) for r in chain.whole_plan(*library(spark, rows, episodes)).collect()}
    assert got == {"Season 1/S01E01.mkv": ("ok", "in place"), "Season 1/other.mkv": ("ok", "agrees")}
    assert chain.whole_plan(*library(spark, [], [])).count() == 0
