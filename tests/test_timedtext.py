"""Subtitle files in a folder, in several encodings and formats."""

from __future__ import annotations

from lodestone.operators import names
from lodestone.sources import timedtext

SRT = "1\n00:00:01,500 --> 00:00:03,000\n<i>Héllo</i> there\n\n2\n00:01:00,000 --> 00:01:02,000\nBye – now\n"
ASS = "[Script Info]\n[Events]\nFormat: Start, End, Text\nDialogue: 0:00:05.50,0:00:06.00,Où, là\\Nbas\n"


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    made = {"a/one.srt": SRT.encode("utf-8"), "a/two.SRT": SRT.encode("utf-8-sig"), "a/b/three.vtt": ("WEBVTT\n\n" + SRT).encode("utf-16"), "four.srt": SRT.encode("cp1252"), "five.ass": ASS.encode("utf-16"), "six.srt": ASS.encode("cp1252"), "seven.srt": b"\x81 00:00:01,000 --> 00:00:02,000\n\x81\xe9", "eight.srt": b"", "note.txt": b"x", "utf16be.srt": b"\xfe\xff" + SRT.encode("utf-16-be")}
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
    files = {r["path"].removeprefix(f"{tmp_path}/"): (r["format"], r["encoding"], r["size"]) for r in timedtext.read_files(spark, str(tmp_path), 150).collect()}
    assert files == {"a/one.srt": ("srt", "utf-8", len(made["a/one.srt"])), "a/two.SRT": ("srt", "utf-8-sig", len(made["a/two.SRT"])), "a/b/three.vtt": ("vtt", "utf-16", len(made["a/b/three.vtt"])), "four.srt": ("srt", "cp1252", len(made["four.srt"])), "five.ass": ("ass", "utf-16", len(made["five.ass"])), "six.srt": ("ass", "cp1252", len(made["six.srt"])), "seven.srt": ("srt", "latin-1", len(made["seven.srt"])), "eight.srt": ("srt", "utf-8", 0), "utf16be.srt": ("srt", "utf-16", len(made["utf16be.srt"]))}
    reader = timedtext.TimedTextReader({"path": f"file:{tmp_path}", "bytesPerPartition": "150"})
    groups = [p.paths for p in reader.partitions()]
    assert len(groups) > 3 and sorted(x for g in groups for x in g) == sorted(f"{tmp_path}/{x}" for x in files)
    cues = {(r["path"].removeprefix(f"{tmp_path}/"), r["start"], r["text"]) for r in timedtext.read_cues(spark, str(tmp_path), 150).collect()}
    for name in ("a/one.srt", "a/two.SRT", "a/b/three.vtt", "four.srt", "utf16be.srt"):
        assert {(s, t) for n, s, t in cues if n == name} == {(1.5, "Héllo there"), (60.0, "Bye – now")}, name
    assert {(s, t) for n, s, t in cues if n in ("five.ass", "six.srt")} == {(5.5, "Où, là bas")}
    assert timedtext.read_files(spark, str(tmp_path / "none")).count() == 0


def test_greedy_rounds(spark):
    """A chain in which each pair waits for the one before, groups without a name, repeated pairs."""
    pairs = [("g", f"k{i}", f"r{i}", 0.9 - i / 100) for i in range(12)] + [("g", f"k{i + 1}", f"r{i}", 0.895 - i / 100) for i in range(12)] + [(None, "a", "b", 0.5), (None, "a", "c", 0.5), ("g", "k0", "r0", 0.9)]
    got = names.greedy_pairs(spark.createDataFrame(pairs, "grp string, key string, ref string, score double"), "grp", "key", "ref")
    used, want = set(), set()
    for g, k, r, s in sorted(set(pairs), key=lambda x: (-x[3], x[1], x[2])):
        if (g, "k", k) not in used and (g, "r", r) not in used:
            used |= {(g, "k", k), (g, "r", r)}
            want.add((g, k, r, s))
    assert {tuple(x) for x in got.collect()} == want
    assert names.greedy_pairs(spark.createDataFrame([], "grp string, key string, ref string, score double"), "grp", "key", "ref").count() == 0
