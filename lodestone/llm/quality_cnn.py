"""A byte-level convolutional network for text quality, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each place has as
channels its byte's eight bits and, for lags 1 to 20, whether the byte equals the one that far
before. Learned filters (width 12, step 4) run over a chunk, with ReLU and the largest value over
its places. The largest and the mean value of each filter over the document's chunks go through a
dense layer into one probability.

It is trained on a bounded sample of the labelled rows: of each class at most `per_class` rows, in
order of a hash, as long as their texts take no more than `class_bytes` together; a text that is
longer than all of that by itself is passed over. All chunks of a text count, in training as in
scoring, and are worked on in blocks of `BLOCK`.
Defined cases: null or empty text: one chunk of zero bytes; nothing or only one class to learn
from: score 0.5 or that class; null doc_id: never learned from; repeated rows: each is scored, and
learned from once; a doc_id with several texts: each is a row; a document with contradicting labels
is left out of training; no rows: no rows; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_of_id, row_bytes, small_batches, smallest, table, tidy

CHUNK, STRIDE, WIDTH, STEP, LAGS = 256, 192, 12, 4, 20
PLACES = (CHUNK - WIDTH) // STEP + 1
CHANNELS = 8 + LAGS
BLOCK = 192


def chunk_counts(sizes: np.ndarray) -> np.ndarray:
    """How many chunks cover a text of so many bytes: one at least."""
    return np.maximum(1, -(-(sizes - CHUNK) // STRIDE) + 1)


def chunk_blocks(data: np.ndarray, bounds: np.ndarray, block: int = BLOCK):
    """(text of each chunk, chunks with LAGS bytes before them) for blocks of all texts' chunks in order;
    zeros stand outside a text."""
    counts = chunk_counts(np.diff(bounds))
    ends = np.cumsum(counts)
    across = np.arange(-LAGS, CHUNK)
    padded = np.append(data, np.uint8(0))
    for lo in range(0, int(ends[-1]) if len(ends) else 0, block):
        number = np.arange(lo, min(lo + block, ends[-1]))
        text = np.searchsorted(ends, number, "right")
        start = bounds[text] + (number - (ends - counts)[text]) * STRIDE
        at = start[:, None] + across
        inside = (at >= bounds[text][:, None]) & (at < bounds[text + 1][:, None])
        yield text, np.where(inside, padded[np.where(inside, at, len(data))], np.uint8(0))


def patches(block: np.ndarray) -> np.ndarray:
    """What the filters see: (chunks * places) x (width * channels)."""
    own = block[:, LAGS:]
    x = np.empty((len(block), CHUNK, CHANNELS), np.float32)
    for bit in range(8):
        x[:, :, bit] = (own >> bit) & 1
    for lag in range(1, LAGS + 1):
        x[:, :, 7 + lag] = own == block[:, LAGS - lag : LAGS + CHUNK - lag]
    windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STEP]
    return np.ascontiguousarray(windows.transpose(0, 1, 3, 2)).reshape(-1, WIDTH * CHANNELS)


class Network:
    FILTERS, HIDDEN = 24, 16

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        normal = lambda a, b: (r.standard_normal((a, b)) * np.sqrt(2 / a)).astype(np.float32)
        self.w = [normal(WIDTH * CHANNELS, self.FILTERS), np.zeros(self.FILTERS, np.float32), normal(2 * self.FILTERS, self.HIDDEN), np.zeros(self.HIDDEN, np.float32), normal(self.HIDDEN, 1), np.zeros(1, np.float32)]

    def filtered(self, block: np.ndarray, keep: bool = False):
        """The largest value of each filter over each chunk (chunks x filters)."""
        p = patches(block)
        a = (p @ self.w[0]).reshape(len(block), PLACES, self.FILTERS)
        at = a.argmax(1)
        top = np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + self.w[1], 0)
        return (top, p, at) if keep else top

    def combined(self, largest: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The probability of each document from each filter's largest value, sum and number of chunks."""
        return 1 / (1 + np.exp(-self._head(np.hstack([largest, total / count[:, None]]))[0]))

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The probability of each text, whose bytes lie one after the other."""
        docs = len(bounds) - 1
        largest, total = np.zeros((docs, self.FILTERS), np.float32), np.zeros((docs, self.FILTERS))
        for text, block in chunk_blocks(data, bounds):
            top = self.filtered(block)
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            own = text[first]
            largest[own] = np.maximum(largest[own], np.maximum.reduceat(top, first))
            total[own] += np.add.reduceat(top, first, dtype=np.float64)
        return self.combined(largest, total.astype(np.float32), chunk_counts(np.diff(bounds)).astype(np.float32))

    def _pooled(self, top, doc, docs):
        starts = np.searchsorted(doc, np.arange(docs))
        count = np.bincount(doc, minlength=docs).astype(np.float32)[:, None]
        largest = np.maximum.reduceat(top, starts)
        return np.hstack([largest, np.add.reduceat(top, starts) / count]), largest, count

    def _head(self, pooled):
        hidden = np.maximum(pooled @ self.w[2] + self.w[3], 0)
        return np.clip((hidden @ self.w[4] + self.w[5])[:, 0], -30, 30), hidden

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int, batch: int = 32, rate: float = 3e-3, seed: int = 6) -> Network:
        r = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                data = np.frombuffer(b"".join(texts[k] for k in own), np.uint8)
                bounds = np.cumsum([0, *(len(texts[k]) for k in own)])
                t += 1
                for k, g in enumerate(self._gradients(data, bounds, labels[own])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def _gradients(self, data, bounds, y):
        """Two passes over the blocks of chunks, so that no more than a block's patches are held at a time."""
        docs, f = len(y), self.FILTERS
        made = [(text, self.filtered(block)) for text, block in chunk_blocks(data, bounds)]
        doc, top = np.concatenate([text for text, _ in made]), np.concatenate([x for _, x in made])
        pooled, largest, count = self._pooled(top, doc, docs)
        logit, hidden = self._head(pooled)
        d = ((1 / (1 + np.exp(-logit)) - y) / docs).astype(np.float32)[:, None]
        d_hidden = (d @ self.w[4].T) * (hidden > 0)
        d_pooled = d_hidden @ self.w[2].T
        is_top = top == largest[doc]
        ties = np.add.reduceat(is_top, np.searchsorted(doc, np.arange(docs)), dtype=np.float32)
        d_top = (is_top * (d_pooled[:, :f] / ties)[doc] + (d_pooled[:, f:] / count)[doc]) * (top > 0)
        d_w, lo = np.zeros_like(self.w[0]), 0
        for _, block in chunk_blocks(data, bounds):
            _, p, at = self.filtered(block, keep=True)
            row, own = np.arange(len(block)) * PLACES, d_top[lo : lo + len(block)]
            for k in range(f):
                d_w[:, k] += own[:, k] @ p[row + at[:, k]]
            lo += len(block)
        return [d_w, d_top.sum(0), pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ d, d.sum(0)]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 800, class_bytes: int = 6_000_000, epochs: int = 5) -> Network | float:
    """Learn from docs (doc_id, text) and labels (doc_id, label 0/1). With one class only: its label; with none: 0.5.

    Texts are looked up by the keys of the sample once it is drawn; before that only a hash and the size
    of each text is joined with the labels."""
    small_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long"), "label").where("doc_id is not null and label in (0, 1)")
    clear = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    # (doc_id, a hash of the text) stands for a text until the sample is drawn
    texts_of = docs.select("doc_id", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).where(F.col("size") <= class_bytes)
    keys = texts_of.join(clear, "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("h")]
    drawn = smallest(keys, ["label"], order, per_class)
    so_far = F.sum("size").over(Window.partitionBy("label").orderBy("_rank"))  # at most per_class rows a label
    chosen = drawn.withColumn("so_far", so_far).where(F.col("so_far") <= class_bytes).select("doc_id", "h", "label")
    texts = docs.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])  # per_class rows a class
    rows = sorted(texts.select("doc_id", "h", "label", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).collect(), key=lambda r: (r["doc_id"], r["h"]))  # bounded by per_class and class_bytes
    y = np.array([r["label"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    return Network().train([bytes(r["text"]) for r in rows], y, epochs)


def score(docs: DataFrame, model: Network | float, texts: bool = True) -> DataFrame:
    """The columns of docs but text as a struct `doc`, the text where `texts` asks for it, and score:
    the probability of label 1 of each whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # the network's weights
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), "text")
    kind = nested.schema["doc"].dataType.simpleString()

    @tidy
    def run(batches):
        m = sent.value
        for batch in batches:
            made = np.full(batch.num_rows, m) if isinstance(m, float) else m.scores(*row_bytes(batch.column(1))).astype(np.float64)
            cols = [batch.column(0), *[batch.column(1)] * texts, pa.array(made)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", *["text"] * texts, "score"])

    return nested.mapInArrow(run, f"doc {kind}, {'text string, ' * texts}score double")


def learn(docs: DataFrame, labels: DataFrame) -> Network | float:
    """Train on rows outside the held-out third."""
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    return fit(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    return score(docs.select("doc_id", "text"), model, texts=False).select("doc.doc_id", "score").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
