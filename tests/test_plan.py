"""Plans against a plain loop over files."""

from __future__ import annotations

import pytest
from conftest import SMALL_SF_DIR

from lodestone.plans import build, claims
from lodestone.queries.plans import plan_input

RANK = {"manual": 3, "high": 2, "ai": 1, "low": 0}


def _choice(s):
    if s["override"]:
        return s["override"], "manual"
    if s["confidence"] == "high":
        return s["code"], "high"
    if s["model_code"]:
        return s["model_code"], "ai"
    return s["code"], "low"


def _plain(files, eps, overrides, splits):
    files = {f["file"]: {**f, "segments": [dict(s) for s in f["segments"]]} for f in files}
    for k, own in overrides.items():
        f = files.get(k)
        if not f:
            continue
        if len(own) == len(f["segments"]) and len(own) > 1:
            for s, c in zip(f["segments"], own, strict=True):
                s["override"] = c
        else:
            f["segments"] = [{"start": 0.0, "end": f["duration"], "code": c, "override": c, "score": 1.0, "confidence": "manual", "model_code": None, "title_card": False} for c in own]
        f["status"] = "MANUAL"
    chosen = {k: [(s, *_choice(s)) for s in f["segments"] if _choice(s)[0]] for k, f in files.items()}
    claims = {}
    for k, f in files.items():
        for s, c, strength in chosen[k]:
            if strength != "low":
                claims.setdefault(c, []).append((RANK[strength], c in f["expected"], s["score"], k, s["start"]))
    winner = {c: max(x)[3:] for c, x in claims.items()}
    items, owner = {}, {}
    for k, f in files.items():
        usable = [x for x in chosen[k] if x[2] != "low"]
        codes, exp = [c for _, c, _ in usable], f["expected"]
        ai, manual = any(x[2] == "ai" for x in usable), any(x[2] == "manual" for x in usable)
        lost = [x for x in usable if winner[x[1]] != (k, x[0]["start"])]
        covered = sum(max(0.0, s["end"] - s["start"]) for s, _, _ in usable)

        def kind():
            if f["status"] == "NO_TEXT" or not usable or len(usable) != len(chosen[k]) or (f["hold"] and f["status"] != "MANUAL"):
                return "review", "undecided"
            if any(c not in eps for c in exp) and not manual:
                return "review", "name not listed"
            if len(lost) == len(usable):
                return "aside", "duplicate"
            if f["status"] == "OK" and not ai and not manual:
                return "ok", "correct"
            if codes == exp:
                return "ok", "agrees"
            if exp and not manual and set(codes) < set(exp) and (ai or covered < 0.75 * f["duration"]):
                return "review", "part confirmed"
            if any(c not in eps for c in codes):
                return "review", "not listed"
            first = eps[codes[0]]
            if len(set(codes)) == len(codes) and all((eps[c]["season"], eps[c]["number"]) == (first["season"], first["number"] + i) for i, c in enumerate(codes)):
                return ("review", "part is a duplicate") if lost else ("rename", "name")
            if not splits:
                return "review", "splits are off"
            if any(s["end"] <= s["start"] for s, _, _ in usable):
                return "review", "no boundaries"
            return "split", "split"

        what, why = kind()
        involved = set(exp) | (set(codes) if what in ("rename", "split") else set())
        shaky = what in ("rename", "split", "aside") and any(c in eps and eps[c]["low_trust"] for c in involved)
        shaky = shaky and not all(s["title_card"] for s in f["segments"]) and not any(s["override"] for s in f["segments"])
        items[k] = [what, why, codes, what in ("rename", "split", "aside") and not ai and not shaky, shaky, None]
        if what in ("rename", "split"):
            owner |= {c: k for c in codes if winner[c][0] == k}
    for k, it in items.items():
        if it[0] == "review":
            met = sorted((c, owner[c]) for c in files[k]["expected"] if c in owner and owner[c] != k)
            if met:
                it[5] = met[0][1]
                if not any(s["title_card"] and s["code"] in files[k]["expected"] for s in files[k]["segments"]):
                    it[:2] = "aside", "unverified"
                    it[3] = "owner"
    return {k: (*it[:3], items[it[5]][3] if it[3] == "owner" else it[3], *it[4:]) for k, it in items.items()}


@pytest.mark.parametrize("splits", [True, False])
def test_plan_equals_plain_loop(spark, splits):
    files, episodes, overrides = plan_input(spark, SMALL_SF_DIR)
    got = {r["file"]: (r["kind"], r["reason"], r["codes"], r["selected"], r["ref_warning"], r["claimed_by"]) for r in build.build(files, episodes, overrides, splits).collect()}
    eps = {r["code"]: r.asDict() for r in episodes.collect()}
    want = _plain([r.asDict(recursive=True) for r in files.collect()], eps, {r["file"]: r["codes"] for r in overrides.collect()}, splits)
    assert got == want
    assert {x[0] for x in want.values()} >= {"ok", "review", "aside", "rename"}


def _run(files, ops):
    """Carry operations out on a set of names; nothing may be overwritten."""
    files = set(files)
    for op, src, dst in ops:
        assert src in files, (op, src)
        if op == "join":
            files.add(dst)
            continue
        assert dst not in files, (op, src, dst)
        files.add(dst)
        if op == "move":
            files.discard(src)
    return files


def test_operations_never_overwrite(spark):
    """A swap, a chain, a split, a join, and a file that stands in the way."""
    moves = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("x", "stands")], "src string, dst string")
    cuts = spark.createDataFrame([("long", "p1", 0.0, 10.0), ("long", "p2", 10.0, 20.0)], "src string, dst string, start double, end double")
    parts = spark.createDataFrame([("q1", "whole", 1), ("q2", "whole", 2)], "src string, dst string, place int")
    present = ["a", "b", "c", "d", "x", "stands", "long", "q1", "q2", "other"]
    there = spark.createDataFrame([(p,) for p in present], "path string")
    rows = claims.operations(moves, cuts, parts, there).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(1, len(rows) + 1))
    end = _run(present, [(r["op"], r["src"], r["dst"]) for r in rows])
    assert end == {"a", "b", "d", "e", "stands", "parked/stands", "p1", "p2", "parked/long", "whole", "parked/q1", "parked/q2", "other"}
    assert [r["src"] for r in rows if r["op"] == "join"] == ["q1.tmp", "q2.tmp"]
    undo = claims.undo_ops(spark.createDataFrame([(1, "move", "a", "b"), (2, "create", "n", "m")], "ordinal long, op string, src string, dst string"))
    clash = claims.undo_conflicts(undo, spark.createDataFrame([("a",), ("z",)], "path string")).collect()
    assert [tuple(r) for r in clash] == [("b", "a")]
