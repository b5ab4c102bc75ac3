"""The corpus operators against brute force on a small table, and on rows that are out of the ordinary."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from conftest import SF_DIR, SMALL_SF_DIR
from pyspark.sql import functions as F

from lodestone.llm import bpe, embeddings, language_id, minhash, packing, quality_cnn, quality_rules, queries, repeats, token_files, url_filter
from lodestone.llm.tokens import vocabulary

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"{w}{i % 97}" for i, w in enumerate(["alpha", "beta", "gamma", "delta", "żółw"] * 12000))
#: Nulls in every column, empty and very long texts, ties, repeated rows, one id for two texts.
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, "   \n\t ", "en", "a", 5), (4, LONG, "en", "a", 1), (5, LONG, "en", None, 1),
    (5, LONG, "en", None, 1), (None, "no id here, " * 30, "fr", "b", 2), (None, None, None, None, None), (8, "one two three four five", "en", "b", 3),
    (9, "One TWO three four five", "en", "b", 3), (10, "a b", "de", "b", 3), (11, "A b", "de", "b", 3), (12, "first text of an id", "en", "c", 1),
    (12, "second text of this id", "en", "c", 1), (13, "x" * 5000, "en", "c", 1), (14, "\U0001f600\u0301<|endoftext|> \u0130 \x00 end" * 40, "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, k int, host string, score double, line string"


@pytest.fixture(scope="module", params=["table", "odd"])
def docs(spark, request):
    """A whole small table, and odd rows with extra columns whose names operators might use themselves."""
    if request.param == "table":
        return spark.read.parquet(f"{SMALL_SF_DIR}/documents.parquet").cache()
    return spark.createDataFrame([(*r, "x", 1, None, 0.5, "y") for r in ODD], SCHEMA).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def _tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def _sets(rows):
    out = {}
    for d, text in rows:
        w = SPACE.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        out.setdefault((d, text), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def _components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (3, [1.0, 0.01], 1, "x"), (4, [1.0, 0.0], 2, "x"), (5, [1.0, 0.0], None, "x"), (6, None, 1, "x"), (7, [0.0, 0.0], 1, None), (8, [nan, 1.0], 1, "x"), (9, [inf, 0.0], 1, "x"), (10, [1.0, None], 1, "x"), (None, [1.0, 0.0], 1, "x"), (12, [], 1, "x"), (13, [0.0, 1.0], 1, "x")]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int, cell string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(v)
    assert [got[i] for i in (1, 2, 3)] == [(2, 1, True), (2, 1, False), (2, 1, False)]
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12, 13))
    assert got[None][0] == 0 and got[None][1] is None
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def _embedding_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=repr)


def test_embeddings_with_several_vectors_under_one_id(spark):
    got = _embedding_rows(spark, [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (9, [1.0, 0.0, 0.0], 1)])
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (9, 0, 9, True)], key=repr)


def test_embeddings_with_repeated_ids_equal_sql(spark):
    """Vectors of small numbers, ids that repeat with the same or another vector, and pairs at the limit itself."""
    import duckdb
    import pandas as pd

    r = np.random.default_rng(4)
    rows = [(int(r.integers(0, 60)), [float(x) for x in r.integers(-3, 4, 2 + int(k % 7 == 0))], int(r.integers(0, 2))) for k in range(120)]
    rows += [(200, [1.0, 0.0], 3), (201, [49.0, float(np.sqrt(2401 / 0.9604 - 2401))], 3), (None, [1.0, 1.0], 1)]
    embeddings_table = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])  # noqa: F841  DuckDB reads it
    sql = embeddings.OP1_SQL.replace("list_cosine_similarity(a.v, b.v) >= 0.98", "len(a.v) = len(b.v) AND list_cosine_similarity(CASE WHEN len(a.v) = len(b.v) THEN a.v ELSE b.v END, b.v) >= 0.98")
    want = duckdb.sql(sql.replace("FROM embeddings", "FROM (SELECT vec_id::BIGINT AS vec_id, embedding::FLOAT[] AS embedding, label FROM embeddings_table)"))
    names = [d[0] for d in want.description]
    want = [dict(zip(names, x, strict=True)) for x in want.fetchall()]
    want = sorted(((x["vec_id"], x["n_links"], x["component_id"], True if x["vec_id"] is None else x["kept"]) for x in want), key=repr)
    assert _embedding_rows(spark, rows) == want


@pytest.mark.parametrize("per_cell", [3, 20, 2000])
def test_embeddings_in_several_cells_equal_sql(spark, per_cell):
    """Chains of vectors across the borders of many cells, three labels, pairs at the limit itself and just below it."""
    import duckdb
    import pandas as pd

    r = np.random.default_rng(8)
    rows, n = [], 0
    for label in (1, 1, 1, 2, 2, 3):
        a, b = r.normal(size=(2, 6))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        angle = 0.0
        for _ in range(45):  # steps around a circle, some within the angle of 0.98 and some beyond
            angle += r.choice([0.05, 0.15, 0.19, 0.205, 0.25])
            rows.append((n, ((a * np.cos(angle) + b * np.sin(angle)) * r.uniform(0.5, 2)).tolist() + [0.0, 0.0], label))
            n += 1
    rows += [(n + k, [float(x) for x in r.integers(-2, 3, 8)], int(r.integers(1, 4))) for k in range(150)]
    rows += [(900, [0.0] * 6 + [1.0, 0.0], 2), (901, [0.0] * 6 + [49.0, float(np.sqrt(2401 / 0.9604 - 2401))], 2), (902, [0.0] * 6 + [49.0, float(np.sqrt(2401 / 0.9604 - 2401)) * 1.001], 2)]
    table = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])  # noqa: F841  DuckDB reads it
    want = duckdb.sql(embeddings.OP1_SQL.replace("FROM embeddings", "FROM (SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS embedding, label FROM table)".replace("table)", "\"table\")")))
    df = spark.createDataFrame([(int(i), [float(x) for x in v], int(k)) for i, v, k in rows], "vec_id long, embedding array<double>, label int")
    got = {tuple(x) for x in embeddings.near_duplicates(df, per_cell=per_cell, block=16).collect()}
    assert got == set(want.fetchall())
    assert sum(x[1] for x in got) > 300
    links = {x[0]: x[1] for x in got}
    assert links[900] >= 1 and links[901] >= 2 and len({x[2] for x in got}) > 20


def test_quality_rules(docs, rows):
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.scores(docs).collect()), key=repr)
    want = []
    for d, text in rows:
        text = text or ""
        w = SPACE.findall(text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        marked = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), len(w) < 10 or 100 * len(marked) > 20 * len(w)))
    assert got == sorted(want, key=repr)


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    body = " ".join(f"w{i}" for i in range(40))
    data = [(i, f"Buy  now from us today\n{body} own{i}", "h") for i in range(12)] + [(50 + i, f"buy now from us today\nx{i}", "h") for i in range(3)] + [(90, "buy now from us today\n" + body, "other")]
    df = spark.createDataFrame([(a, t + " end" * 1, s) for a, t, s in data], "doc_id long, text string, source string")
    df = df.unionByName(spark.createDataFrame([(200 + i, f"{body} z{i} last", "h") for i in range(5)], df.schema))
    kept = {r["doc_id"]: r["text"] for r in quality_rules.filtered(df, min_words=1).collect()}
    assert set(range(12)) <= set(kept) and 90 in kept
    assert not any("now" in kept[i] for i in range(12)) and "now" in kept[90]
    assert not {50, 51, 52} & set(kept)


def test_packing(docs, rows):
    t = _tokenizer("word_bpe_49k.json")
    got = packing.pack(docs, vocabulary("word_bpe_49k.json")).collect()
    want, found = Counter(), Counter()
    ids_of = {r: [*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in set(rows)}
    for r in rows:
        want[(r[0], len(ids_of[r]))] += len(ids_of[r])
    for p in got:
        found[(p["doc_id"], p["doc_tokens"])] += p["length"]
        assert any(d == p["doc_id"] and _crc(i[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for (d, _), i in ids_of.items())
    assert found == want
    windows = defaultdict(list)
    for p in got:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    padded = total = 0
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
        padded += at if at & (at - 1) == 0 else 4096
    assert padded <= 1.01 * total + 4096


@pytest.mark.parametrize("step", [4096, 1 << 14, 1 << 16])
def test_step_groups_hold_equal_numbers_of_ids(spark, step):
    """All groups but the last of a partition have exactly `step` ids, and groups dealt together like numbers of each length."""
    docs = spark.read.parquet(f"{SMALL_SF_DIR}/documents.parquet").repartition(2)
    got = packing.pack(docs, vocabulary("word_bpe_49k.json"), buffer_tokens=1 << 14, step_tokens=step).select("sequence_id", "sequence_length", "step_group").distinct().collect()
    ids, lengths = Counter(), defaultdict(Counter)
    for r in got:
        ids[r["step_group"]] += r["sequence_length"]
        lengths[r["step_group"]][r["sequence_length"]] += 1
    short = [g for g, n in ids.items() if n != step]
    assert len(short) <= 3 and all(ids[g] < step for g in short)  # two partitions and their remainders
    assert len(ids) - len(short) >= sum(ids.values()) // step - 2
    dealt = packing.step_groups([4096] * 37 + [2048] * 22 + [1024] * 6 + [512] * 20, 1 << 14, 8)
    mixed = [Counter(n for n, g in zip([4096] * 37 + [2048] * 22 + [1024] * 6 + [512] * 20, dealt, strict=True) if g == k)[4096] for k in range(8)]
    assert max(mixed) - min(mixed) <= 1


def test_bpe(docs, rows):
    t = _tokenizer("byte_bpe_50k.json")
    want = []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for leaf in (1 << 15, 400):
        got = bpe.encode_decode_digests(docs, vocabulary("byte_bpe_50k.json"), leaf_chars=leaf).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_minhash(docs, rows):
    sets = _sets(rows)
    ids = sorted({d for d, _ in rows if d is not None})
    links = []
    keys = [k for k in sets if k[0] is not None and sets[k]]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = len(sets[a]), len(sets[b])
            if a[0] != b[0] and 100 * min(x, y) >= 85 * max(x, y):
                n = len(sets[a] & sets[b])
                if 100 * n >= 85 * (x + y - n):
                    links.append((a[0], b[0]))
    want = _components(ids, links)
    got = minhash.near_duplicates(docs, percent=85).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((d, len(sets[d, x])) for d, x in rows)


def _minhash_links(rows, percent):
    sets = {k: v for k, v in _sets(rows).items() if k[0] is not None and v}
    keys = list(sets)
    return [(a[0], b[0]) for i, a in enumerate(keys) for b in keys[i + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def test_minhash_with_two_texts_under_one_id(spark):
    """Either text of document 12 links it: 20 is near one, 30 near the other."""
    text = lambda start, end: " ".join(f"w{i}" for i in range(start, end))
    rows = [(12, text(0, 200)), (12, text(1000, 1200)), (20, text(1003, 1203)), (30, text(2, 202)), (30, text(2, 202)), (40, text(5000, 5100))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == {12: 12, 20: 12, 30: 12, 40: 40}


def test_minhash_of_a_large_group_of_near_copies(spark):
    """Copies of one text with words changed here and there: many pairs lie just below or above the similarity."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(300):
        words = list(base)
        for k in r.integers(0, 120, r.integers(1, 5)):
            words[k] = f"x{d}_{k}"
        rows.append((d, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent=85).collect()
    want = _components(range(300), _minhash_links(rows, 85))
    assert len(set(want.values())) > 3
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_minhash_keeps_structured_words_apart(spark):
    """Words on which polynomials modulo a power of two collide, whatever their base."""
    words = [thue_morse(n, x) for n in (512, 1024, 2048, 4096) for x in ("ab", "ba")]
    texts = [(i, w) for i, w in enumerate(words)] + [(20 + i, f"one two {w} three four five six") for i, w in enumerate(words)] + [(40, words[3].upper())]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), percent=85).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == {**{d: d for d, _ in texts}, 40: 3}
    assert [got[d]["n_shingles"] for d in (0, 3, 20, 27)] == [1, 1, 3, 3]


def test_span_hashes_of_structured_bytes():
    data = np.frombuffer("".join(thue_morse(n, x) for n in (128, 1024, 4096) for x in ("ab", "ba")).encode(), np.uint8)
    starts, size = np.array([0, 128, 256, 1280, 2304, 6400]), np.array([128, 128, 1024, 1024, 4096, 4096])
    hashes = repeats.exact_hashes(data, starts, size)
    assert len(set(hashes.tolist())) == 6
    assert len(set((hashes[:2] & np.uint64((1 << 31) - 1)).tolist())) == 2
    for block in (1 << 18, 1000, 7):
        assert (repeats.exact_hashes(np.concatenate([data[5:], data]), starts + len(data) - 5, size, block) == hashes).all()
    r = np.random.default_rng(1)
    a, b = r.integers(0, repeats._PRIME, (2, 2000), dtype=np.uint64)
    assert repeats.times(a, b).tolist() == [x * y % repeats._PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    at, to, n = r.integers(0, 3000, (3, 500))
    assert repeats.same_bytes(data, at, to, n + 1).tolist() == [bytes(data[x : x + k + 1]) == bytes(data[y : y + k + 1]) for x, y, k in zip(at.tolist(), to.tolist(), n.tolist(), strict=True)]


def test_links_of_a_bucket_whatever_its_blocks(spark):
    """Five texts in a row, each near the next; a sixth shares only its last band with them. Pairs that share
    no bucket as their first band aren't verified, and blocks of any size find links for the same components."""
    text = lambda k: " ".join(f"w{i}" for i in range(6 * k, 6 * k + 200))
    texts = {k: text(k) for k in range(6)}
    bands = {k: list(range(100, 124)) for k in range(5)} | {5: [*range(200, 223), 123]}
    packed = {k: zstandard.compress(t.encode()) for k, t in texts.items()}
    rows = [(bucket, k, max(0, k - 3), 196, bytes(120), own, packed[k]) for k, own in bands.items() for bucket in own if bucket in (100, 105, 123)]
    members = spark.createDataFrame(rows, "bucket long, node long, component long, n_shingles long, places binary, bands array<long>, text binary")
    for block in (500_000, 300):
        got = [tuple(r) for r in minhash._joining_links(members, percent=85, shingle=5, block=block).collect()]
        assert len(got) < 12
        assert set(_components(range(6), [*got, (0, 1), (1, 2), (2, 3)]).values()) == {0}


def test_token_files(spark, docs, rows):
    from lodestone.llm.common import fresh_dir

    t = _tokenizer("byte_bpe_50k.json")
    folder = fresh_dir(spark, "tokens")
    index = token_files.write_token_files(docs, folder, vocabulary("byte_bpe_50k.json"))
    got = sorted(token_files.read_token_files(spark, folder, index).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(len(got))]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    want = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[(d, len(ids), _crc(ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def _repeats_wanted(order):
    """(doc_id, bytes, removed, runs, digest) of each (doc_id, text), which come in corpus order."""
    seen, want = set(), {}
    for d, text in order:
        b = (text or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                cut[i : i + 100] = b"\1" * 100
            seen.add(w)
        spans = len(re.findall(rb"\x01+", bytes(cut)))
        kept = bytes(c for c, gone in zip(b, cut, strict=True) if not gone)
        want[d, text] = (d, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest())
    return want


def _repeats_found(docs, **how):
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    got = repeats.repeated_spans(docs, **how).select("doc.doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted(map(tuple, got), key=repr)


def test_repeats(spark, docs, rows):
    ranked = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")).distinct().collect()
    order = [(r["doc_id"], r["text"]) for r in sorted(ranked, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))]
    want = _repeats_wanted(order)
    assert _repeats_found(docs) == sorted([want[r] for r in rows], key=repr)


def test_repeats_of_one_id_with_several_long_texts(spark):
    """Shared passages at odd places, between texts of one id, within a text, and in cells of a few bytes."""
    r = np.random.default_rng(7)
    shared = ["".join(map(chr, r.integers(97, 103, n))) for n in (150, 400, 99, 100, 1000)]
    own = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    rows = [(int(k // 2), own(int(r.integers(0, 60))) + shared[k % 5] + own(int(r.integers(0, 300))) + shared[(k * 3) % 5][: int(r.integers(50, 1000))] + "\u017c" * int(r.integers(0, 80))) for k in range(40)]
    rows += [(None, shared[1]), (None, shared[4] * 2), (3, rows[6][1]), (3, rows[6][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranked = df.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")).distinct().collect()
    order = [(x["doc_id"], x["text"]) for x in sorted(ranked, key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["h"]))]
    want = _repeats_wanted(order)
    for how in ({}, {"cell_bytes": 500}, {"part": 300}):
        assert _repeats_found(df.repartition(3), **how) == sorted([want[x] for x in rows], key=repr), how


def test_suffix_ranks_order_suffixes():
    data = np.frombuffer(b"abracadabra" * 30 + b"abrac", np.uint8)
    rank = repeats.suffix_ranks(data, 100)
    raw = data.tobytes()
    want = sorted(range(len(raw)), key=lambda i: raw[i : i + 100])
    assert [raw[i : i + 100] for i in np.argsort(rank, kind="stable")] == [raw[i : i + 100] for i in want]
    assert all((rank[i] == rank[i + 11]) == (raw[i : i + 100] == raw[i + 11 : i + 111]) for i in range(200))


def test_url_rules(spark):
    urls = [("http://A.org/es/x", "allow", "org/"), ("https://Example.ORG/es/p?q=/", "block", "example.org/es/"), ("x://www.example.org/en/12#a", "block", "example.org/en/1"), ("h://b.com/fr/", "allow", "com/fr/"), ("h://com/de/x", "block", "com/de/"), ("h://notexample.org/es/", "allow", "org/"), ("h://b.com/it/", None, None), ("nothing", None, None), (None, None, None), ("", None, None), ("://", None, None), ("h://b.com?u=http://x.org/", None, None), ("h://b.com/" + "y" * 100000, None, None)]
    df = spark.createDataFrame([(i, u, "x") for i, (u, _, _) in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(df).collect()}
    assert len(got) == len(urls)
    for i, (_, verdict, rule) in enumerate(urls):
        assert got[i]["rule"] == rule and got[i]["verdict"] in ((verdict,) if verdict else ("allow", "block"))
    assert (got[0]["host"], got[0]["path"]) == ("a.org", "/es/x") and (got[7]["host"], got[7]["path"]) == ("", "") == (got[8]["host"], got[8]["path"])
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


#: DuckDB SQL for what rules decide: host, path, rule and, where a rule fits, the verdict.
RULED_SQL = r"""WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
p AS (SELECT page_id, CASE WHEN pos = 0 THEN '' ELSE substr(url, pos + 3) END AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM p),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'), ('block', 'example.org', '/en/1', 'example.org/en/1'), ('allow', 'com', '/fr/', 'com/fr/'), ('block', 'com', '/de/', 'com/de/')) v(verdict, own, prefix, rule)),
m AS (SELECT page_id, max_by(rule, len(rule)) AS rule, max_by(verdict, len(rule)) AS verdict FROM h JOIN r ON (host = own OR host LIKE '%.' || own) AND starts_with(path, prefix) GROUP BY page_id)
SELECT page_id, host, path, rule, verdict FROM h LEFT JOIN m USING (page_id)"""


def test_url_rules_equal_sql(spark, duck):
    got = url_filter.op4_url_filter(spark, SF_DIR)
    ruled = got.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")))
    assert sorted(map(tuple, ruled.collect()), key=repr) == sorted(duck.execute(RULED_SQL).fetchall(), key=repr)


def test_lexical_features_of_urls(spark):
    import math

    urls = ["https://a.b.com/x/y9//?q=1&r=2#t", "http://host", "", None, "plain text?a#b", "h://x/" + "z1" * 3000, "s://\u00e9\u4e2d.org/\u00e9"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string")
    host, path = url_filter.host_path(F.col("url"))
    got = {r["k"]: r["x"] for r in df.select("k", url_filter.lexical(F.col("url"), host, path).alias("x")).collect()}
    for k, u in enumerate(urls):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        query = u.partition("?")[2].partition("#")[0]
        n = Counter(u)
        want = [len(u), len(host), host.count(".") + bool(host), path.rstrip("/").count("/"), len(path), sum(c in "0123456789" for c in path) / max(1, len(path)),
                -sum(c / len(u) * math.log2(c / len(u)) for c in n.values()), query.count("&") + bool(query), "#" in u, u.startswith("https")]
        assert np.allclose(got[k], np.array(want, float)), u


def test_url_trees_learn_what_the_rules_say(spark):
    """Paths with digits are blocked by a rule on hosts that it knows; trees carry that to other hosts."""
    rules = (("block", "evil.net/"), ("allow", "good.net/"))
    rows = [(k, f"https://evil.net/p{k}{k * 7919}/{k * 104729}?a={k}&b={k}") for k in range(150)] + [(1000 + k, f"http://good.net/about/page-{'abc'[k % 3] * (k % 9)}") for k in range(150)]
    rows += [(2000, "https://other.eu/p55432123/99887766?a=1&b=2"), (2001, "http://other.eu/about/page-abc"), (None, "https://other.eu/p1234567/7654321?a=3&b=9"), (2001, "http://other.eu/about/page-abc")]
    got = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules).where("rule is null").collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got if r["page_id"]) == [(2000, "block"), (2001, "allow"), (2001, "allow")]
    assert [r["verdict"] for r in got if r["page_id"] is None] == ["block"]
    only = url_filter.url_verdicts(spark.createDataFrame(rows[:150] + rows[-1:], "page_id long, url string"), rules)
    assert {r["verdict"] for r in only.collect()} == {"block"}  # one kind of label only


def test_language_id_on_held_out_rows(spark):
    held = queries.QUERIES["op7_language_id"](spark, SF_DIR).where("held_out").join(spark.read.parquet(f"{SF_DIR}/documents.parquet").where("length(text) > 40"), "doc_id")
    right, n = held.agg(F.avg(F.expr("cast(lang = lang_pred as double)")), F.count("*")).first()
    assert n > 50 and right > 0.95


def test_quality_on_held_out_rows(spark):
    held = queries.QUERIES["op8_quality_cnn"](spark, SF_DIR).where("held_out").join(spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality is not null"), "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.85


def test_quality_scores_do_not_depend_on_the_batch():
    """Texts scored together and in blocks, against a plain loop over the chunks of one text at a time."""
    net = quality_cnn.Network(seed=1)
    texts = [b"", b"abc", b"y" * 256, b"word " * 100, bytes(range(256)) * 400, "\u017c\u00f3\u0142w ".encode() * 3000]
    plain = []
    for t in texts:
        starts = [0] if len(t) <= quality_cnn.CHUNK else range(0, len(t) - quality_cnn.CHUNK + quality_cnn.STRIDE, quality_cnn.STRIDE)
        tops = []
        for a in starts:
            own = bytes(quality_cnn.LAGS) + t
            own = own[a : a + quality_cnn.LAGS + quality_cnn.CHUNK].ljust(quality_cnn.LAGS + quality_cnn.CHUNK, b"\0")
            tops.append(net.filtered(np.frombuffer(own, np.uint8)[None])[0])
        tops = np.array(tops)
        x = np.maximum(np.concatenate([tops.max(0), tops.mean(0)]) @ net.w[2] + net.w[3], 0) @ net.w[4] + net.w[5]
        plain.append(1 / (1 + np.exp(-np.clip(x[0], -30, 30))))
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert np.allclose(net.scores(data, bounds), plain, atol=1e-5)


def test_gradients_of_the_network():
    """Against differences of the loss."""
    net = quality_cnn.Network(seed=2)
    r = np.random.default_rng(0)
    texts = [bytes(r.integers(97, 101, n, dtype=np.uint8)) for n in (30, 700, 5000)]
    data, bounds, y = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.array([0, 1, 1], np.float32)

    def loss():
        p = net.scores(data, bounds)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net._gradients(data, bounds, y)
    for k in (2, 4, 5):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        before, step = net.w[k][at], 1e-2
        net.w[k][at] = before + step
        high = loss()
        net.w[k][at] = before - step
        low = loss()
        net.w[k][at] = before
        assert abs((high - low) / (2 * step) - grads[k][at]) < 0.05 * abs(grads[k][at]) + 1e-3


def test_language_scores_do_not_depend_on_the_batch(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat with the hat", "en"), ("le chat est sur la table avec le chapeau", "fr"), ("the dog and the fox in the wood", "en"), ("la maison et le jardin dans la rue", "fr")] * 3)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [*(t for _, t, _ in rows[:4]), "THE Cat " * 5000, "\u00bd\u00b2\u2167", "12 34", "\u00e9", ""]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[k][0] for k in (5, 6, 8)] == ["und"] * 3 and got[4][0] == "en" and got[7][0] in ("en", "fr")
    for k, t in enumerate(texts):
        if got[k][0] != "und":
            grams = {t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
            alone = np.zeros((1, language_id.BUCKETS), np.uint8)
            for g in grams:  # one n-gram at a time
                alone |= np.zeros_like(alone) if len(g) == 0 else _only(g)
            s = model.score(alone)[0]
            assert got[k][0] == model.langs[int(s.argmax())] and abs(got[k][1] - s.max()) < 1e-6


def _only(gram):
    """The bucket of one n-gram alone: those of the text itself less those of its shorter parts."""
    from lodestone.llm.language_id import presence

    whole = presence([gram])
    for part in {gram[i : i + n] for n in range(1, len(gram)) for i in range(len(gram) - n + 1)}:
        whole |= presence([part])
    return whole


def test_models_take_odd_rows(spark):
    odd = spark.createDataFrame([(*r, "x", 1, None, 0.5, "y") for r in ODD], SCHEMA)
    langs = language_id.predict(odd, language_id.fit(odd.where("doc_id is not null"))).collect()
    assert len(langs) == len(ODD) and all(0 <= r["score"] <= 1 for r in langs)
    assert all(r["lang_pred"] == "und" for r in langs if r["doc_id"] in (1, 2, 3))
    for model in (quality_cnn.fit(odd, spark.createDataFrame([(4, 1), (8, 0), (10, 1), (12, 0), (None, 0), (13, None)], "doc_id long, label int")), 0.5):
        scored = quality_cnn.score(odd, model).collect()
        assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules.scores(none).count() == quality_rules.filtered(none).count() == 0
    assert packing.pack(none, vocabulary("word_bpe_49k.json")).count() == 0
    assert bpe.encode_decode_digests(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert repeats.repeated_spans(none).count() == 0
    assert language_id.predict(none, language_id.fit(none)).count() == 0
    assert quality_cnn.score(none, 0.5).count() == 0
