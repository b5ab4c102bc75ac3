"""Importance resampling of documents towards a target distribution, on hashed n-grams.

Features of a text are all runs of 1 to `runs` consecutive words. A table of 256 bytes lower-cases
A-Z and blanks separators in UTF-8, bytes.split yields the words, the crc32 of a run is that of its
first words carried on over the next one, and Counters reduce what a task has read; buckets are the
crc32 modulo `buckets`. Spark adds up the tasks' counts, at most `buckets` rows each. The gain of a
bucket is the floored log ratio of its smoothed shares in target and documents; a document's weight
is the floored mean gain of its features, its score the weight and Gumbel noise from its doc_id, so
that the highest scores are a draw without replacement in proportion to exp(weight / 1000).

Ranks come from a range partitioning by score: each row's place in its partition and the number of
rows in the partitions before; no task holds more than its range, and the driver gets one count for
each partition and one for each bucket.

Defined cases: null text: no words, weight 0; null doc_id: noise as of an empty id, last among ties;
rows that repeat doc_id and score rank by their other values; long texts are read in parts cut
between words; fewer than `min_words` words: never drawn; no rows: no rows; an empty target: smoothed
shares alone. Other columns, whatever their names, are carried along by `resample`.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, small_batches, stored, table, tidy

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of other characters, blanks the rest.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PART = 1 << 22


def _parts(text: bytes, size: int):
    """The words of a text, in parts of about `size` bytes."""
    data = text.translate(_WORDS)
    start = 0
    while start < len(data):
        end = len(data) if len(data) - start <= size else data.find(b" ", start + size)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def hashed_runs(text: bytes, runs: int = 1, part: int = _PART):
    """For each part of a text: the number of its words, and the crc32 of each run that ends in it."""
    before: list[bytes] = []
    for words in _parts(text, part):
        crcs = list(map(zlib.crc32, words))
        out, all_words = crcs, before + words
        if runs > 1:
            seeds = list(map(zlib.crc32, all_words))
            out = crcs.copy()
            for k in range(1, runs):
                seeds = [zlib.crc32(b" " + w, seed) for seed, w in zip(seeds, all_words[k:], strict=False)]
                out += seeds[max(0, len(before) - k) :]
            before = all_words[-(runs - 1) :]
        yield len(words), out


def _texts(column) -> list[bytes]:
    return column.fill_null("").cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, runs: int, buckets: int) -> np.ndarray:
    """How many features of all texts (the column text) fall into each bucket."""

    @tidy
    def step(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            seen: Counter[int] = Counter()
            for text in _texts(batch.column(0)):
                for _, crcs in hashed_runs(text, runs):
                    seen.update(crcs)
            if seen:
                np.add.at(total, np.fromiter(seen.keys(), np.int64, len(seen)) % buckets, np.fromiter(seen.values(), np.int64, len(seen)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    small_batches(texts.sparkSession)
    counted = texts.select("text").mapInArrow(step, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored log ratio of each bucket's smoothed shares, in thousandths."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (float(t + 1) * (s_all + buckets)) / (float(s + 1) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: str = "2024") -> int:
    """The floored Gumbel noise of a document, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000, seed: str = "2024", carried: list[str] | None = None) -> DataFrame:
    """doc (a struct of the carried columns), doc_id, n_words, n_features, weight and score of each row of docs."""
    of_bucket = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))

    @tidy
    def step(batches):
        for batch in batches:
            made = []
            for text, doc_id in zip(_texts(batch.column(2)), batch.column(1).to_pylist(), strict=True):
                n_words = n = gain = 0
                for words, crcs in hashed_runs(text, runs):
                    n_words, n = n_words + words, n + len(crcs)
                    gain += int(of_bucket[np.array(crcs, np.int64) % buckets].sum())
                weight = gain // n if n else 0
                made.append((n_words, n, weight, weight + noise(doc_id, seed)))
            columns = [pa.array(x, pa.int64()) for x in zip(*made, strict=True)] if made else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    names = ["doc", "doc_id", "n_words", "n_features", "weight", "score"]
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried or ["doc_id"]]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([rows.schema["doc"], *[T.StructField(x, T.LongType()) for x in names[1:]]])
    return rows.mapInArrow(step, schema)


def ranked(scored: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """Scored rows with rank: 1, 2, 3... for the drawn ones, the `percent` highest scores of the rows with min_words words; else null."""
    spark = scored.sparkSession
    scored = stored(scored, "scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("n_words")]
    enough = scored.where(F.col("n_words") >= min_words).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # the id of a sorted partition's rows: the partition's number in the upper 31 bits, the row's place in the lower 33
    placed = stored(enough.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    counts = sorted((x["part"], x["n"]) for x in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, bases = 0, []
    for p, n in counts:
        bases.append((p, before))
        before += n
    drawn = before * percent // 100
    base = spark.createDataFrame(bases, "part long, base long")
    place = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    with_rank = placed.withColumn("part", part).join(F.broadcast(base), "part").withColumn("rank", F.when(place <= drawn, place)).drop("part", "base", "at")
    return with_rank.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, **how) -> DataFrame:
    """The drawn rows of docs, with all their columns."""
    out = ranked(scores(docs, target, carried=docs.columns, **how), percent, min_words)
    return out.where(F.col("rank").isNotNull()).select("doc.*")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")
