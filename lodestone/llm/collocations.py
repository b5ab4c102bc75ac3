"""Phrases whose words belong together, found by SON partitioning.

Texts are lower-cased (A-Z) and cut at sentence punctuation and line ends into pieces, and these at
blanks and tabs into words. A phrase is a run of words within a piece; everything is counted per
language.

Mining: the documents are dealt by hash into `shards`. A phrase found `support` times or more is
found ceil(support / shards) times or more in one shard at least, so each shard is mined completely
at that lowered support, in steps of one more word: a run of words is only counted if both runs of
one word less are frequent somewhere. Local counts are kept by 64-bit hashes of shard and phrase; a
collision can only add a candidate. The union of what is locally frequent is a set of bits of fixed
size (2 ** `filter_bits`), which Spark ors together, the driver holds once and all tasks get; where
it fills up, more phrases pass, and none is lost. A second scan counts words, and by their text all
phrases that pass, over all shards exactly; only those with `support` or more are candidates.

In a task words get numbers by an Arrow dictionary, and runs of k + 1 words the number of the first k
and of the last word, so counting is exact. Spark adds up the tasks' counts by phrase. Scores use
decimals: 1000000 * a * a takes 37 digits at most while counts have up to 14.

Defined cases: null text: no words; null language: `und`; repeated rows count again; no doc_id is
read but for dealing out shards; texts longer than `part` bytes are counted in parts cut between
pieces; no rows: no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, small_batches, stored, table, tidy
from .shingles import mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLANK = np.isin(np.arange(256), list(b" \t"))
_STOP = np.isin(np.arange(256), list(b".,;:!?\n\v\f\r"))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHARDS = 3  # bits of a key that hold the shard


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a set of 2 ** size bits; the low bits, where keys hold the shard, aren't used."""
    mask = np.uint64((1 << size) - 1)
    return (hashes >> np.uint64(_SHARDS)) & mask, (hashes >> np.uint64(64 - size)) & mask


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))


class _Runs:
    """The runs of k = 1, 2, 3... words in some texts: which distinct ones there are, their number, hash and words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, group_of_row: np.ndarray, groups: list[str]):
        solid = ~(_BLANK | _STOP)[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        row = np.searchsorted(bounds, starts, "right") - 1
        piece = np.cumsum(_STOP[data])[starts] if len(data) else starts
        self.together = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        joined = pa.py_buffer(_LOWER[data[solid]])
        offsets = pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, joined]).dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.hashes = _word_hashes(self.words)
        of_group = np.fromiter((xxhash.xxh64_intdigest(g) for g in groups), np.uint64, len(groups))
        self.at, self.k = np.arange(len(starts)), 1
        run, self.of = self._distinct(group_of_row[row] * len(self.words) + self.ids)
        self.group, word = np.divmod(run, max(1, len(self.words)))
        self.parts = [word]
        self.hash = mix(of_group[self.group] * _ODD + self.hashes[word])

    @staticmethod
    def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coded = pa.array(codes).dictionary_encode()
        return coded.dictionary.to_numpy(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def counts(self) -> np.ndarray:
        return np.bincount(self.of, minlength=len(self.hash))

    def longer(self, stays: np.ndarray | None = None) -> None:
        """Go on to the runs of one more word, both of whose shorter runs stay."""
        known = np.full(len(self.ids) + 1, -1, np.int64)
        held = slice(None) if stays is None else stays[self.of]
        known[self.at[held]] = self.of[held]
        at = np.flatnonzero((known[:-2] >= 0) & (known[1:-1] >= 0) & self.together) if len(self.ids) else self.at
        run, self.of = self._distinct(known[at] * len(self.words) + self.ids[at + self.k] if len(at) else at)
        first, last = np.divmod(run, max(1, len(self.words)))
        self.at, self.k = at, self.k + 1
        self.group, self.parts = self.group[first], [*(p[first] for p in self.parts), last]
        self.hash = mix(self.hash[first] * _ODD + self.hashes[last])

    def texts(self, which: np.ndarray) -> pa.Array:
        words = [self.words.take(pa.array(p[which])) for p in self.parts]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())).cast(pa.string()) if len(words) > 1 else words[0].cast(pa.string())


def _chunks(batches, part: int):
    """Rows of several batches, of about `part` bytes: their data, bounds, shards and languages; a longer text comes in parts cut between pieces."""
    data, rows, size = [], [], 0
    for batch in batches:
        for text, lang, shard in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            start = 0
            while start < len(text):
                end = len(text)
                if end - start > part:
                    stops = np.flatnonzero(_STOP[np.frombuffer(text, np.uint8, offset=start + part)])
                    end = start + part + int(stops[0]) + 1 if len(stops) else end
                data.append(text[start:end])
                rows.append((lang, shard))
                size, start = size + end - start, end
                if size >= part:
                    yield data, rows
                    data, rows, size = [], [], 0
    if data:
        yield data, rows


def _runs(batches, part: int):
    for data, rows in _chunks(batches, part):
        names = sorted({lang for lang, _ in rows})
        number = {x: i for i, x in enumerate(names)}
        bounds = np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64)
        yield np.frombuffer(b"".join(data), np.uint8), bounds, np.array([number[x] for x, _ in rows], np.int64), np.array([s for _, s in rows], np.int64), names


def _local(docs: DataFrame, k: int, shorter, filter_bits: int, part: int) -> DataFrame:
    """key (hash of a run of k words, and its shard in the low bits) and count in the shard."""

    @tidy
    def step(batches):
        for data, bounds, lang, shard, names in _runs(batches, part):
            # one group for each language and shard; a run's hash leaves the shard out
            runs = _Runs(data, bounds, lang * (1 << _SHARDS) + shard, [x for x in names for _ in range(1 << _SHARDS)])
            for j in range(2, k + 1):
                runs.longer(_passes(runs.hash, shorter[j - 1].value, filter_bits) if j - 1 in shorter else None)
            low = np.uint64((1 << _SHARDS) - 1)
            keys = (runs.hash & ~low) | (runs.group & int(low)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(runs.counts().astype(np.int32))], ["key", "n"])

    return docs.mapInArrow(step, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))


def _passes(hashes: np.ndarray, held: np.ndarray, filter_bits: int) -> np.ndarray:
    hashes = hashes & ~np.uint64((1 << _SHARDS) - 1)
    out = np.ones(len(hashes), bool)
    for at in _bits(hashes, filter_bits):
        out &= (held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _filter(keys: DataFrame, filter_bits: int) -> np.ndarray:
    """The set of bits of some keys: 2 ** filter_bits bits, whatever the number of keys."""
    shard = (1 << _SHARDS) - 1
    h = F.col("key").bitwiseAND(~shard)
    mask = (1 << filter_bits) - 1
    places = F.array(F.shiftright(h, _SHARDS).bitwiseAND(mask), F.shiftrightunsigned(h, 64 - filter_bits))
    words = keys.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << (filter_bits - 6), np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _counts(docs: DataFrame, longest: int, filters: dict, filter_bits: int, part: int) -> DataFrame:
    """k, lang, phrase and count f of all words, and of all longer runs that pass the filters."""

    @tidy
    def step(batches):
        for data, bounds, lang, _, names in _runs(batches, part):
            runs, langs = _Runs(data, bounds, lang, names), pa.array(names, pa.string())
            passed = None
            for k in range(1, longest + 1):
                if k > 1:
                    runs.longer(passed)
                    passed = _passes(runs.hash, filters[k].value, filter_bits)
                which = np.arange(len(runs.hash)) if k == 1 else np.flatnonzero(passed)
                n = len(which)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), langs.take(pa.array(runs.group[which])), runs.texts(which), pa.array(runs.counts()[which])], ["k", "lang", "phrase", "n"])

    return docs.mapInArrow(step, "k int, lang string, phrase string, n long").groupBy("k", "lang", "phrase").agg(F.sum("n").alias("f"))


def counted(docs: DataFrame, longest: int = 3, support: int = 10, shards: int = 4, filter_bits: int = 27, part: int = 4_000_000) -> DataFrame:
    """k, lang, phrase, f: all words, and the phrases of 2 to `longest` words found `support` times or more."""
    if not 1 <= shards <= 1 << _SHARDS:
        raise ValueError(f"1 to {1 << _SHARDS} shards")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    local, filters = -(-support // shards), {}
    for k in range(2, longest + 1):
        filters[k] = spark.sparkContext.broadcast(_filter(_local(rows, k, filters, filter_bits, part).where(F.col("n") >= local), filter_bits))
    return stored(_counts(rows, longest, filters, filter_bits, part).where((F.col("k") == 1) | (F.col("f") >= support)), "phrases")


def collocations(docs: DataFrame, longest: int = 3, support: int = 10, inside: int = 50, top: int = 2000, shards: int = 4, filter_bits: int = 27) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 to `longest` words.

    a: count of the phrase; l, r: counts of the two parts at its weakest cut; n: words of the language.
    Phrases inside a longer one that has at least `inside` percent of their count are left out.
    """
    counts = counted(docs, longest, support, shards, filter_bits)
    words = counts.where("k = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where(F.col("f") >= support).select("lang", "phrase", "f")
    found = counts.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", F.split("phrase", " ").alias("w"))
    piece = lambda start, size: F.array_join(F.slice("w", start, size), " ")

    kept = found
    if longest > 2:
        around = found.where("k > 2").select("lang", F.col("a").alias("b"), F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
        kept = found.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("b") < inside * F.col("a"), F.lit(True))).drop("b")

    cuts = kept.select("lang", "phrase", "a", "k", "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select("lang", "phrase", "a", "cut", piece(F.lit(1), F.col("cut")).alias("first"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    both = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(14,0)")
    score = both.withColumn("score", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")), exact("l") * exact("r")))
    best = score.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(max(64, partitions(docs.sparkSession))))
    # each language is thinned in parts before these meet in one task
    some = best.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, range(1, 4) AS ks(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM c, unnest(range(1, k)) AS u(cut), f AS l, f AS r
  WHERE l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') AND r.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS a FROM c, unnest([1, 2]) AS u(i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM top JOIN n USING (lang) WHERE rank <= 2000
"""
