"""Each stage of the corpus pipeline on its own, and the whole, against plain loops over a small table."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from conftest import SMALL_SF_DIR
from pyspark.sql import functions as F

from lodestone.llm import pipeline, quality_cnn
from lodestone.llm.tokens import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Name, input and output of each stage of one run."""
    docs, out = spark.read.parquet(f"{SMALL_SF_DIR}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        made = pipeline.stored(stage(spark, docs, SMALL_SF_DIR), "test")
        out[name] = (docs, made)
        docs = made
    return out


def _rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    for name, (docs, made) in list(stages.items())[:-1]:
        assert made.schema.names == docs.schema.names, name
        same = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert made.select(same).exceptAll(docs.select(same)).isEmpty(), name


def test_quality_classifier(spark, stages):
    docs, made = stages["quality classifier"]
    model = quality_cnn.learn(docs, spark.read.parquet(f"{SMALL_SF_DIR}/labels.parquet"))
    want = {}
    for d, text in _rows(docs).items():
        data = np.frombuffer((text or "").encode(), np.uint8)
        if model.scores(data, np.array([0, len(data)]))[0] >= pipeline.REJECT_BELOW:
            want[d] = text
    assert _rows(made) == want


def test_quality_rules(stages):
    docs, made = stages["quality rules"]
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]
    norm = lambda x: " ".join(WORD.findall(x.translate({c: c + 32 for c in range(65, 91)})))
    held, hosts = {}, {}
    for d, text, host in rows:
        hosts[host] = hosts.get(host, 0) + 1
        for x in {norm(x) for x in text.split("\n")} - {""}:
            held.setdefault((host, x), set()).add(d)
    often = {k for k, v in held.items() if len(v) > 10 and len(v) > 0.05 * hosts[k[0]]}
    want = {}
    for d, text, host in rows:
        w = WORD.findall(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
        marked = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
        lines = text.split("\n")
        gone = sum(len(WORD.findall(x)) for x in lines if (host, norm(x)) in often)
        if len(w) >= 10 and 100 * len(marked) <= 20 * len(w) and gone <= 0.7 * len(w):
            want[d] = "\n".join(x for x in lines if (host, norm(x)) not in often)
    assert _rows(made) == want


def test_near_duplicates(stages):
    docs, made = stages["near duplicates"]
    texts = _rows(docs)
    sets = {}
    for d, text in texts.items():
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert _rows(made) == {d: texts[d] for d in ids if root[d] == d}


def test_repeated_passages(stages):
    docs, made = stages["repeated passages"]
    seen, want = set(), {}
    for d, text in sorted(_rows(docs).items()):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if (w := b[i : i + 100]) in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        want[d] = bytes(c for c, x in zip(b, gone, strict=True) if not x).decode("utf-8", "ignore")
    assert _rows(made) == want
    assert made.where("n_chars != length(text)").join(docs.select("doc_id", F.col("text").alias("before")), "doc_id").where("text != before").isEmpty()


def test_packing_and_the_whole(spark, stages):
    from tokenizers import Tokenizer

    docs, made = stages["packing"]
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    ids = {d: [*t.encode(text or "", add_special_tokens=False).ids, 2] for d, text in _rows(docs).items()}
    got = {d: [] for d in ids}
    for p in made.collect():
        piece = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == p["ids_crc32"]
        got[p["doc_id"]].append((p["start"], p["length"]))
    for d, parts in got.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    whole = pipeline.run(spark, SMALL_SF_DIR).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in whole} == {d: len(x) for d, x in ids.items()}


def test_no_rows_and_odd_rows(spark):
    schema = spark.read.parquet(f"{SMALL_SF_DIR}/documents.parquet").schema
    odd = [{"doc_id": None, "text": "words of no document at all, some " * 9}, {"doc_id": 1, "text": None}, {"doc_id": 2, "text": ""}, {"doc_id": 3, "text": "some text of an id that comes again and again here now"}, {"doc_id": 3, "text": "some text of an id that comes again and again here now"}]
    rows = [tuple(r.get(f.name) for f in schema) for r in odd]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in pipeline.STAGES:
            if name != "quality classifier":  # learns from the rows that it gets
                made = stage(spark, docs, SMALL_SF_DIR)
                assert made.count() >= (1 if data and name == "packing" else 0), name
                if name == "near duplicates" and data:
                    assert sorted((r["doc_id"] for r in made.collect()), key=str) == [1, 2, 3, None]
