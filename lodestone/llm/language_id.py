"""Language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of character n-grams
(n = 1 to 3, lower-cased text) that occur in both, over the root of the product of the numbers that
occur in each. N-grams are hashed to `buckets` places. Landmarks, some texts of each language, give
Nystroem features K(x, landmarks) K(landmarks)^-1/2; one-versus-rest kernel ridge regression on
them learns a language each. Texts are scored in batches: a 0/1 matrix of n-gram presence of the
whole texts times the landmarks' matrix, times the learned weights.

It learns from a bounded sample: `per_language` texts of each language, those with the smallest
hashes, and at most `max_rows` in all; of a learning text only its presence bits reach the driver.
Rows that repeat doc_id, text and lang are one of them.
Defined cases: null text or one without a letter: `und`, score 0; no text to learn from: `und`;
null doc_id or lang: judged like any other, never learned from; repeated rows: each judged; no
rows: no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, small_batches, smallest, table, tidy

BUCKETS = 1 << 15
#: A character of Unicode's category L; numerals that look like letters are none.
LETTER = r"\p{L}"
_MULTIPLIERS = ((0x9E3779B1,), (0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1, 0x9E3779B1))


def presence(texts: list[str], chunk: int = 1 << 20) -> np.ndarray:
    """1 where a text has an n-gram of the bucket (texts x buckets); whole texts, in chunks."""
    out = np.zeros((len(texts), BUCKETS), np.uint8)
    flat = out.reshape(-1)
    for first, joined, row in _chunks(texts, chunk):
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        for parts in _MULTIPLIERS:
            n = len(parts)
            if len(cp) < n:
                continue
            h = cp[: len(cp) - n + 1] * np.uint32(parts[0])
            for k in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + cp[k : len(cp) - n + 1 + k] * np.uint32(parts[k])
            h ^= h >> np.uint32(16)
            code = ((h * np.uint32(0x7FEB352D)) >> np.uint32(17)).astype(np.int64)
            whole = row[: len(row) - n + 1] == row[n - 1 :]
            flat[(row[: len(code)] * BUCKETS + code)[whole] + first * BUCKETS] = 1
    return out


def _chunks(texts: list[str], chunk: int):
    """(first text, characters, text of each character) of runs of texts; long texts overlap by two characters."""
    k = 0
    while k < len(texts):
        if len(texts[k]) > chunk:
            for a in range(0, len(texts[k]), chunk):
                part = texts[k][a : a + chunk + 2]
                yield k, part, np.zeros(len(part), np.int64)
            k += 1
            continue
        end, size = k, 0
        while end < len(texts) and size + len(texts[end]) <= chunk:
            size += len(texts[end])
            end += 1
        lengths = [len(t) for t in texts[k:end]]
        yield k, "".join(texts[k:end]), np.repeat(np.arange(end - k), lengths)
        k = end


class KernelModel:
    """Landmarks and ridge regression weights."""

    def __init__(self, bits: np.ndarray, langs: list[str], landmarks: int, ridge: float):
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(x) for x in langs])
        chosen = np.concatenate([np.flatnonzero(y == k)[: max(1, landmarks // len(self.langs))] for k in range(len(self.langs))])
        marks = bits[chosen]
        self.columns = np.flatnonzero(marks.any(0))
        self.marks = marks[:, self.columns].astype(np.float32).T
        self.size = marks.sum(1, dtype=np.float64)
        k_mm = self.kernel(marks)
        value, vector = np.linalg.eigh(k_mm)
        good = value > 1e-6 * value.max()
        self.nystroem = vector[:, good] / np.sqrt(value[good])
        phi = self.kernel(bits) @ self.nystroem
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        self.weights = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ target)

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        own = np.maximum(bits.sum(1, dtype=np.float64), 1)
        return (bits[:, self.columns].astype(np.float32) @ self.marks) / np.sqrt(own[:, None] * self.size)

    def score(self, bits: np.ndarray) -> np.ndarray:
        """A probability-like score of each language (texts x languages)."""
        f = self.kernel(bits) @ self.nystroem @ self.weights[:-1] + self.weights[-1]
        e = np.exp(4 * (f - f.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def fit(labelled: DataFrame, per_language: int = 200, max_rows: int = 4000, landmarks: int = 128, ridge: float = 1e-2) -> KernelModel | None:
    """Learn from labelled (doc_id, text, lang); None if there is nothing to learn from."""
    small_batches(labelled.sparkSession)
    usable = labelled.where("lang is not null and doc_id is not null").where(F.regexp_like("text", F.lit(LETTER)))
    usable = usable.select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    keys = usable.select("doc_id", "lang", "h").distinct()
    drawn = smallest(keys, ["lang"], [F.xxhash64("doc_id"), F.col("doc_id"), F.col("h")], per_language)
    chosen = drawn.orderBy("_rank", "lang").limit(max_rows).select("doc_id", "lang", "h")

    @tidy
    def bits(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                got = np.packbits(presence([t.lower() for t in part.column(2).to_pylist()]), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array([x.tobytes() for x in got], pa.binary())], names=["doc_id", "lang", "h", "bits"])

    one = usable.join(F.broadcast(chosen), ["doc_id", "lang", "h"]).dropDuplicates(["doc_id", "lang", "h"]).select("doc_id", "lang", "text", "h")
    rows = one.mapInArrow(bits, "doc_id long, lang string, h long, bits binary").collect()  # at most max_rows
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["h"]))
    return KernelModel(np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in rows]), axis=1), [r["lang"] for r in rows], landmarks, ridge)


def predict(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x buckets and the weights: a bounded size

    @tidy
    def judge(batches):
        m = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                lettered = pc.match_substring_regex(part.column(1), LETTER).to_pylist()
                texts = [t if known else "" for t, known in zip(part.column(1).to_pylist(), lettered, strict=True)]
                lang, top = np.full(len(texts), "und", object), np.zeros(len(texts))
                if m is not None:
                    known = np.array([bool(t) for t in texts])
                    s = m.score(presence([t.lower() for t in texts]))
                    lang[known] = np.array(m.langs, object)[s.argmax(1)][known]
                    top[known] = s.max(1)[known]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(top)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    model = fit(docs.where(~held_out).select(F.col("doc_id").cast("long"), "text", "lang"))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
