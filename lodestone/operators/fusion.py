"""Fusion of a file's dialogue segments with the title cards seen in it.

Cards are taken in order of time, and each is judged against the segments as the cards before it have
left them: a card may confirm, rename, split or dispute a segment, or open one where dialogue matched
nothing, and the next card then meets what was made. So it is a fold over two ordered streams. The
streams of a file meet in one row (arrays sorted by time), rows are spread over the cluster by their
key, and only the fold itself is plain code on one row's arrays. The status that follows from the
segments is worked out by column expressions again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.claims import classify

SEGMENT = "start double, end double, code string, score double, confidence string, alternatives array<string>, evidence string, reason string, said string, card double, dispute string, story array<string>, absorbed array<string>"
_ARROW = pa.schema([
    ("start", pa.float64()), ("end", pa.float64()), ("code", pa.string()), ("score", pa.float64()), ("confidence", pa.string()), ("alternatives", pa.list_(pa.string())), ("evidence", pa.string()),
    ("reason", pa.string()), ("said", pa.string()), ("card", pa.float64()), ("dispute", pa.string()), ("story", pa.list_(pa.string())), ("absorbed", pa.list_(pa.string())),
])

#: Seconds: a card may come this long before its segment starts, and after it ends.
EARLY, LATE = 60.0, 15.0
#: A second card in one segment cuts it only if this much is left on either side.
LEAST_BEFORE, LEAST_AFTER = 240.0, 120.0


def _segment(start: float, end: float, code: str | None, score: float | None, **more) -> dict:
    return {"start": start, "end": end, "code": code, "score": score, "confidence": "high", "alternatives": [], "evidence": None, "reason": None, "said": None, "card": None, "dispute": None, "story": None, "absorbed": None, "missing": None} | more


class _File:
    """One file's segments while its cards are worked in."""

    def __init__(self, row: dict):
        self.expected, self.length, self.trust = row["expected"] or [], row["duration"] or 0.0, bool(row["trust"])
        self.runtimes = dict(row["runtimes"] or [])
        self.segments = [_segment(**{k: s[k] for k in ("start", "end", "code", "score", "confidence", "missing")}, alternatives=s["alternatives"] or []) for s in row["segments"] or []]
        for s in self.segments:
            s["spoken"] = dict(s)  # what dialogue alone had said
        self.confirmed: set[str] = set()

    def named_at(self, time: float) -> str | None:
        """The episode that the file's name puts at a time; None if it names none, or the length isn't known."""
        n = len(self.expected)
        if n < 2:
            return self.expected[0] if n else None
        return self.expected[min(n - 1, int(time * n / self.length))] if self.length > 0 else None

    def resolved(self, card: dict, segment: dict | None, named: str | None) -> str | None:
        """The code of a card; a reading of a beginning only confirms what dialogue or name say already."""
        if not card["partial"]:
            return card["code"]
        could = set(card["candidates"] or [])
        said = [segment["code"], *segment["alternatives"]] if segment else []
        sure = said[:1] if segment and segment["confidence"] == "high" else []
        return next((c for c in [*sure, *([named] if named else self.expected), *said] if c in could), None)

    def clear(self, card: dict) -> bool:
        return not card["partial"] and card["code"] is not None and (card["frames"] or 1) >= 2

    def settled(self) -> bool:
        """Has every named episode been confirmed by a card?"""
        return set(self.expected) <= self.confirmed

    # ---- without dialogue
    def from_cards(self, cards: list[dict]) -> None:
        for card in cards:
            code = self.resolved(card, None, self.named_at(card["time"]))
            if code is None:
                continue
            time = card["time"]
            if self.segments:
                last = self.segments[-1]
                start = max(last["start"] + 60, time - 5)
                last["end"] = max(last["start"] + 30, time - 90)
            else:
                start = max(0.0, time - 60) if code in self.expected[1:] and code != self.expected[0] else 0.0
            self.segments.append(_segment(round(start, 1), round(self.length, 1), code, card["score"], evidence="title+filename" if card["partial"] else "title", reason="card alone", card=time))

    # ---- with dialogue
    def take(self, card: dict) -> None:
        held = [i for i, s in enumerate(self.segments) if s["start"] - EARLY <= card["time"] <= s["end"] + LATE]
        at = held[-1] if held else None
        segment = self.segments[at] if held else None
        code = self.resolved(card, segment, self.named_at(card["time"]))
        if code is None:
            return  # an incomplete reading that nothing else supports
        if segment is None:
            self.fill(card, code)
            return
        if segment["card"] is not None:
            at = self.split(at, card, code)
            if at is None:
                return
        parts = self.story_of(card, self.segments[at])
        if parts:
            self.tell(at, card, parts)
        else:
            self.judge(self.segments[at], card, code)

    def fill(self, card: dict, code: str) -> None:
        """A card where dialogue matched nothing opens a segment from what ends before it to what comes next."""
        before = max((i for i, s in enumerate(self.segments) if s["end"] <= card["time"]), default=-1)
        start = self.segments[before]["end"] if before >= 0 else 0.0
        end = self.segments[before + 1]["start"] if before + 1 < len(self.segments) else self.length
        named = code in self.expected
        agreed = named or self.settled() or (self.trust and self.clear(card))
        new = _segment(start, end, code, card["score"], confidence="high" if agreed else "conflict", evidence="title+filename" if named else "title", reason="fills a gap" if agreed else "fills a gap against the name", card=card["time"], card_code=code)
        self.segments.insert(before + 1, new)
        if named:
            self.confirmed.add(code)

    def split(self, at: int, card: dict, code: str) -> int | None:
        """A second card, of another title, cuts the segment where its episode starts; the new part goes back to what dialogue said."""
        first = self.segments[at]
        lead = min(120.0, max(5.0, first["card"] - first["start"]))
        cut = card["time"] - lead
        until = self.segments[at + 1]["start"] if at + 1 < len(self.segments) else self.length or first["end"]
        if first["card_code"] == code or cut - first["start"] < LEAST_BEFORE or until - cut < LEAST_AFTER:
            return None
        spoken = first.get("spoken") or first
        piece = _segment(round(cut, 1), round(max(until, first["end"]), 1), spoken["code"], spoken["score"], confidence=spoken["confidence"], alternatives=spoken["alternatives"], story=spoken["story"])
        if spoken["missing"]:
            piece["missing"] = self.named_at(card["time"]) or spoken["missing"]
        first["end"] = round(cut, 1)
        self.segments.insert(at + 1, piece)
        return at + 1

    def story_of(self, card: dict, segment: dict) -> list[str]:
        """The named parts of a story of which the card has the title, if dialogue matched one part right across them."""
        parts = [c for c in self.expected if c in (card["candidates"] or [])] if card["partial"] else []
        if len(parts) < 2 or segment["code"] not in parts or segment["confidence"] not in ("high", "low"):
            return []
        across = {self.named_at(segment["start"] + 1), self.named_at(segment["end"] - 1)} & set(parts)
        return parts if len(across) >= 2 else []

    def tell(self, at: int, card: dict, parts: list[str]) -> None:
        whole = self.segments[at]
        start, step = whole["start"], (whole["end"] - whole["start"]) / len(parts)
        self.segments[at : at + 1] = [
            {**whole, "start": round(start + k * step, 1), "end": round(start + (k + 1) * step, 1), "code": c, "confidence": "high", "evidence": "title+filename", "reason": "parts of one story", "said": whole["code"], "story": parts, "card": card["time"], "card_code": c, "spoken": None}
            for k, c in enumerate(parts)
        ]
        self.confirmed |= set(parts)

    def judge(self, segment: dict, card: dict, code: str) -> None:
        said, weak = segment["code"], segment["confidence"] != "high"
        segment["card"], segment["card_code"] = card["time"], code
        named = code in self.expected
        if named:
            self.confirmed.add(code)
        if code == said:
            segment.update(confidence="high", evidence="dialogue+title", reason="all agree" if named else "dialogue and card agree")
            return
        runner_up = code in segment["alternatives"]
        open_names = bool(self.expected) and not self.settled()
        if named:
            why = "dialogue ran on from another named episode" if said in self.expected else "no reference for it" if segment["missing"] == code else "reference in doubt"
            evidence = "title+filename"
        elif weak and self.trust and self.clear(card) and not runner_up and open_names:
            why, evidence = "clear card against the name", "title"
        elif weak and (runner_up or not open_names):
            why, evidence = "weak dialogue settled", "title"
        else:
            segment.update(confidence="conflict", dispute=code, reason="card against name and weak dialogue" if weak else "card against dialogue")
            return
        segment.update(said=said, code=code, confidence="high", evidence=evidence, reason=why)

    # ---- afterwards
    def joins(self, last: dict, s: dict) -> bool:
        """Is weak dialogue behind a card's episode still part of it?"""
        if last["card"] is None or last["confidence"] != "high" or s["card"] is not None or s["confidence"] != "low" or s["code"] in self.expected or s["code"] == last["code"]:
            return False
        if len(self.expected) > 1 and self.named_at((s["start"] + s["end"]) / 2) not in (None, last["code"]):
            return False
        runtime = self.runtimes.get(last["code"])
        return not runtime or s["end"] - last["start"] <= runtime * 60 * 1.4

    def tidied(self) -> list[dict]:
        kept: list[dict] = []
        for s in self.segments:
            if kept and self.joins(kept[-1], s):
                kept[-1]["end"] = s["end"]
                kept[-1]["absorbed"] = [*(kept[-1]["absorbed"] or []), s["code"]]
            else:
                kept.append(s)
        out: list[dict] = []
        for s in kept:
            if out and (out[-1]["code"], out[-1]["confidence"]) == (s["code"], s["confidence"]):
                out[-1]["end"] = s["end"]
            else:
                out.append(s)
        return out


def fused(row: dict) -> list[dict]:
    """The segments of one file (duration, expected, trust, runtimes, segments, cards) after its cards."""
    file, cards = _File(row), row["cards"] or []
    if not file.segments:
        file.from_cards(cards)
        return file.segments
    if not cards:
        return file.segments
    for card in cards:
        file.take(card)
    return file.tidied()


def fuse_cards(files: DataFrame, segments: DataFrame, cards: DataFrame, runtimes: DataFrame, key: str) -> DataFrame:
    """key, status, hold and fused segments (SEGMENT) of each of the files (key, duration, expected codes, trust, words).

    segments: key, start, end, code, score, confidence (high, low), alternatives (codes) and missing (a named code
    without a reference). cards: key, time, code, partial, candidates, frames, score. runtimes: code, minutes.
    trust: may a clear card (in full, on two frames) overrule the name where dialogue is weak?
    A file whose name says more than what was found, with nothing against it, is held as LOW_CONFIDENCE.
    Files without segments and cards keep none; rows with other keys, and those without times, are left out; ties in time follow the code.
    """
    segments, cards = segments.where("start is not null and end is not null"), cards.where("time is not null")
    spoken = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "code", "score", "confidence", "alternatives", "missing"))).alias("segments"))
    seen = cards.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("time", "code", "partial", "candidates", "frames", "score"))).alias("cards"))
    rows = files.select(key, "duration", "expected", "trust", "words").join(spoken, key, "left").join(seen, key, "left")
    none = F.array().cast("array<string>")
    listed = [F.col("expected"), F.transform("segments", lambda s: s["code"]), F.transform("cards", lambda c: c["code"]), F.flatten(F.transform("segments", lambda s: F.coalesce(s["alternatives"], none)))]
    codes = F.flatten(F.array(*[F.coalesce(x, none) for x in listed]))
    # only the runtimes of codes that a file mentions travel with it
    mentioned = rows.select(key, F.explode(F.array_distinct(codes)).alias("code")).join(runtimes.where("minutes is not null").groupBy("code").agg(F.max("minutes").cast("double").alias("minutes")), "code")
    lengths = mentioned.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("code", "minutes"))).alias("runtimes"))
    whole = rows.join(lengths, key, "left")
    kind = whole.schema[key].dataType

    def fold(batches):
        for batch in batches:
            got = [fused(row) for row in batch.to_pylist()]
            made = pa.array([[{k: s[k] for k in _ARROW.names} for s in x] for x in got], pa.list_(pa.struct(list(_ARROW))))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], [key, "segments"])

    inner = ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in SEGMENT.split(", ")))
    folded = whole.mapInArrow(fold, f"{key} {kind.simpleString()}, segments array<struct<{inner}>>")
    out = files.select(key, "expected", "words").join(folded, key)
    found = F.transform("segments", lambda s: s["code"])
    expected = F.coalesce("expected", F.array().cast("array<string>"))
    status = classify(expected, found, F.col("words"), F.forall("segments", lambda s: s["confidence"] == "high"))
    distinct = F.array_distinct(found)
    fewer = (F.size(F.array_except(distinct, expected)) == 0) & (F.size(distinct) < F.size(F.array_distinct(expected)))
    hold = (status == "MISMATCH") & (F.size(expected) > 0) & fewer
    return out.select(key, F.when(hold, "LOW_CONFIDENCE").otherwise(status).alias("status"), hold.alias("hold"), "segments")
