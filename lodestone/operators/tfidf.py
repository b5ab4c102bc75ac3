"""TF-IDF cosine scores of texts against a reference corpus."""

from __future__ import annotations

import re
import unicodedata
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import pairwise
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.find_spark_home import _find_spark_home
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

#: A word: two or more letters or apostrophes that begin with a letter, between characters that no word has.
_WORD = re.compile(r"\b[a-z][a-z']+\b")
#: Reference vectors, and weights of words, of up to this many rows are broadcast (about 100 bytes each); beyond it, joined by shuffles.
BROADCAST_ROWS = 1_000_000
#: The set of terms whose weights are fetched has 8 bits or more for each, but not more than this (64 MB).
MOST_BITS = 1 << 29


@cache
def english_stop_words() -> tuple[str, ...]:
    """The English list that Spark ML's StopWordsRemover has, read from Spark's own library."""
    jar = next((Path(_find_spark_home()) / "jars").glob("spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as z:
        return tuple(z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split())


@cache
def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters they are made of."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _plain(text: str) -> str:
    """Lower case without accents: NFKD, combining marks left out."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


class _Latin(dict):
    """Of a character: the letter that a Latin one is made of, nothing for a mark, else itself."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.category(chr(c))[0] == "M" else c
        return self[c]


@cache
def _latin() -> _Latin:
    return _Latin(zip(map(ord, _accents()[0]), map(ord, _accents()[1]), strict=True))


def _folded(text: str) -> str:
    """Lower case; Latin letters without their marks, whether these are part of a character or follow it."""
    text = text.lower()
    return text if text.isascii() else text.translate(_latin())


@dataclass(frozen=True)
class Terms:
    """What counts as a term: words that aren't stop words, and with `bigrams` pairs of neighbours of these, in lower
    case without Latin accents; with `plain`, characters of all scripts are decomposed."""

    stop: tuple[str, ...] = ()
    bigrams: bool = False
    plain: bool = False

    def counted(self, texts: list[list[str]]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Of the terms of each row of texts: the row, the term, and how often the row has it."""
        fold, out = _plain if self.plain else _folded, frozenset(self.stop)
        terms, times, sizes = [], [], []
        for row in texts:
            found: Counter = Counter()
            for text in row:
                words = [w for w in _WORD.findall(fold(text)) if w not in out]
                found.update(words)
                if self.bigrams:
                    found.update(map(" ".join, pairwise(words)))
            terms += found.keys()
            times += found.values()
            sizes.append(len(found))
        return np.repeat(np.arange(len(texts)), np.array(sizes, np.int64)), pa.array(terms, pa.string()), np.array(times, np.int64)


def lists(row: np.ndarray, rows: int, **values: pa.Array) -> pa.Array:
    """Lists of structs, one for each row, of values that lie in the order of their rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(values.values()), list(values)))


def parts_of(texts: DataFrame, each: int = 2000) -> int:
    """In how many parts to deal out texts so that one has `each` of them on average, and none is left idle."""
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.count() // each)


def _by_key(texts: DataFrame, key: str, text: str, parts: int | None) -> DataFrame:
    """key and _texts, all its texts. They are dealt out by key once, before anything is done with them: few large files
    don't keep the work in few tasks. With `parts` they are so many, whatever their bytes."""
    texts = texts.select(key, text)
    texts = texts.repartition(parts, F.col(key)) if parts else texts.repartition(F.col(key))
    return texts.groupBy(key).agg(F.collect_list(text).alias("_texts"))


def counts(texts: DataFrame, key: str, text: str = "text", terms: Terms = Terms(), parts: int | None = None) -> DataFrame:  # noqa: B008
    """key, term and n, how often the texts of a key have it."""

    @F.arrow_udf("array<struct<term:string,n:bigint>>")
    def counted(texts: pa.Array) -> pa.Array:
        row, term, n = terms.counted(texts.to_pylist())
        return lists(row, len(texts), term=term, n=pa.array(n))

    # an inner explode would have the terms looked for a second time, in a filter before it
    return _by_key(texts, key, text, parts).select(key, F.explode_outer(counted("_texts")).alias("t")).where("t is not null").select(key, "t.term", "t.n")


def frequencies(texts: DataFrame, key: str, text: str = "text", terms: Terms = Terms(), parts: int | None = None) -> DataFrame:  # noqa: B008
    """term and df, in how many keys' texts it is, summed over some of them: a batch of texts is counted where it lies."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, term, _ = terms.counted(batch["_texts"].to_pylist())
            yield pa.RecordBatch.from_struct_array(term.value_counts().cast(pa.struct([("values", pa.string()), ("counts", pa.int64())]))).rename_columns(["term", "df"])

    return _by_key(texts, key, text, parts).select("_texts").mapInArrow(found, "term string, df long")


@dataclass
class Weights:
    """Word weights: term, idf; null for terms that are left out. `once`: the weight of each term that isn't listed, as one text
    alone has it; the texts to weigh are among those of the fit then. Without it unlisted terms don't count."""

    idf: DataFrame
    once: float | None = None

    def weighted(self, counts: DataFrame, key: str) -> DataFrame:
        """key, term, x: 1 + ln n times idf; unknown terms don't count."""
        if self.once is None:
            return counts.join(self.idf.where("idf is not null"), "term").select(key, "term", _weight().alias("x"))
        listed = self.idf.withColumn("_listed", F.lit(True))
        idf = F.when(F.col("_listed"), F.col("idf")).otherwise(F.lit(self.once))
        return counts.join(listed, "term", "left").withColumn("idf", idf).where("idf is not null").select(key, "term", _weight().alias("x"))

    def vectors(self, counts: DataFrame, key: str) -> DataFrame:
        """key, term, w: weights scaled to length one."""
        raw = self.weighted(counts, key)
        norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        return raw.join(norm, key).select(key, "term", (F.col("x") / F.col("norm")).alias("w"))


def _weight() -> Column:
    return (1 + F.log("n")) * F.col("idf")


def fit(counts: DataFrame, n_docs: DataFrame, max_df: float | None = None, once: bool = False) -> Weights:
    """Smoothed idf over texts' terms (term, and in how many texts: df, 1 if that isn't there); n_docs has one row and column n, the
    number of texts. With max_df and ten texts or more, terms in a larger share of them are left out. With `once`, terms of
    one text alone, which are most of them, aren't listed but have their common weight (see Weights)."""

    def idf(df: Column) -> Column:
        w = F.log((1 + F.col("n")) / (1 + df)) + 1
        return w if max_df is None else F.when((F.col("n") < 10) | (df <= max_df * F.col("n")), w)

    rows = counts.groupBy("term").agg((F.sum("df") if "df" in counts.columns else F.count("*")).alias("df"))
    single = n_docs.select(idf(F.lit(1))).first()[0] if once else None
    if single is not None:
        rows = rows.where("df > 1")
    return Weights(rows.crossJoin(F.broadcast(n_docs)).select("term", idf(F.col("df")).alias("idf")), single)  # one row


@dataclass
class Known:
    """Weights of terms (null: left out), and for each of them its references and their weights: `which` and `weight` from `first`."""

    terms: pa.Array
    idf: np.ndarray
    first: np.ndarray
    which: np.ndarray
    weight: np.ndarray
    refs: pa.Array

    def products(self, row: np.ndarray, term: np.ndarray, x: np.ndarray, rows: int, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row and reference that share a term: the row, the reference and the sum of their products. A block of
        rows meets all references at once."""
        many, width = self.first[term + 1] - self.first[term], len(self.refs)
        block = np.cumsum(width + np.bincount(row, many, rows).astype(np.int64)) // cells
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for b in np.unique(block):
            low, high = np.searchsorted(block, [b, b + 1])
            own = slice(*np.searchsorted(row, [low, high]))
            n = many[own]
            met = np.repeat(self.first[term[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            s = np.bincount(np.repeat((row[own] - low) * width, n) + self.which[met], np.repeat(x[own], n) * self.weight[met], (high - low) * width)
            hit = np.flatnonzero(s)
            out.append((hit // width + low, hit % width, s[hit]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))


def _places(terms: list[str], size: int) -> np.ndarray:
    return np.fromiter((crc32(t.encode()) for t in terms), np.int64, len(terms)) % size


def _set_of(terms: DataFrame, n: int, piece: int = 1 << 20) -> np.ndarray:
    """A bit for each of n terms, at its place (`_places`) among 8 n or more; terms that share one look alike. Bytes come to the
    driver in pieces that tasks put together."""
    size = min(MOST_BITS, 1 << (8 * max(n, 128)).bit_length())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"place": pa.array(_places(batch["term"].to_pylist(), size))})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch["place"].to_numpy()
            for k in np.unique(place // (8 * piece)).tolist():
                own = place[place // (8 * piece) == k] - k * 8 * piece
                np.bitwise_or.at(bits.setdefault(k, np.zeros(piece, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        for k, b in bits.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "bits": pa.array([b.tobytes()], pa.binary())})

    places = terms.select("term").mapInArrow(placed, "place long")
    out = np.zeros(max(1, size // (8 * piece)) * piece, np.uint8)
    for k, b in places.repartition(F.floor(F.col("place") / (8 * piece))).mapInArrow(packed, "k long, bits binary").collect():
        out[k * piece : (k + 1) * piece] = np.frombuffer(b, np.uint8)
    return out[: max(1, size // 8)]


def _known(idf: DataFrame, references: DataFrame, ref: str) -> Known:
    """Few weights and few references' vectors, as all tasks hold them."""
    table, rows = idf.select("term", "idf").toArrow(), references.select(ref, "term", "w").toArrow()
    terms = pa.array(table["term"].to_pylist(), pa.string())
    rows = rows.filter(pc.is_in(rows["term"], value_set=terms))  # others are in no text that is weighed
    by_ref = rows[ref].combine_chunks().dictionary_encode()
    at = pc.index_in(rows["term"].combine_chunks(), value_set=terms).to_numpy()
    order = np.argsort(at, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms)))])
    return Known(terms, table["idf"].to_numpy(), first, by_ref.indices.to_numpy()[order].astype(np.int64), rows["w"].to_numpy()[order], by_ref.dictionary)


def scores(texts: DataFrame, weights: Weights, references: DataFrame, key: str, ref: str, terms: Terms = Terms(), parts: int | None = None) -> DataFrame:  # noqa: B008
    """key, ref and the cosine of each pair of a text (key, text) and a reference that share a term, from reference vectors
    (ref, term, w). Where these are few, texts are dealt out by key and stay there: the weights of references' terms and of the
    most frequent others are sent to all tasks, and of a text's rare terms only what they add to its length is fetched. Terms
    that aren't listed are told by a set of bits and not asked for, but for some that look like a listed one."""
    if references.count() > BROADCAST_ROWS:
        weighted = weights.weighted(counts(texts, key, "text", terms, parts), key)
        norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"))
        sums = weighted.join(references, "term").groupBy(key, ref).agg(F.sum(F.col("x") * F.col("w")).alias("s"))
        return sums.join(norm, key).select(key, ref, (F.col("s") / F.col("_norm")).alias("score"))
    idf, once, total, often = weights.idf, weights.once, weights.idf.count(), F.lit(True)
    fetched = total > BROADCAST_ROWS
    if fetched:
        limit = idf.approxQuantile("idf", [BROADCAST_ROWS / total], 0.001)[0]
        often = F.col("_shared").isNotNull() | F.col("idf").isNull() | (F.col("idf") < limit)
        idf = idf.join(F.broadcast(references.select("term").distinct().withColumn("_shared", F.lit(True))), "term", "left")
    known = _known(idf.where(often), references, ref)
    listed = _set_of(idf.where(~often), total - len(known.terms)) if fetched else np.zeros(1, np.uint8)
    held = texts.sparkSession.sparkContext.broadcast((known, listed))
    kind = references.schema[ref].dataType.simpleString()

    @F.arrow_udf(f"struct<sq:double,pairs:array<struct<ref:{kind},s:double>>,rare:array<struct<term:string,n:bigint>>>")
    def met(texts: pa.Array) -> pa.Array:
        (known, listed), rows = held.value, len(texts)
        row, term, n = terms.counted(texts.to_pylist())
        at = pc.fill_null(pc.index_in(term, value_set=known.terms), -1).to_numpy()
        far = at < 0
        place = _places(term.filter(pa.array(far)).to_pylist(), 8 * len(listed))
        far[far] = listed[place >> 3] >> (place & 7) & 1
        rare = lists(row[far], rows, term=term.filter(pa.array(far)), n=pa.array(n[far]))
        weight = np.append(known.idf, np.nan if once is None else once)[at]
        x = (1 + np.log(n)) * np.where(far, np.nan, weight)
        counts = ~np.isnan(x)
        row, at, x = row[counts], at[counts], x[counts]
        sq, some = np.bincount(row, x * x, rows), at >= 0
        own, other, s = known.products(row[some], at[some], x[some], rows)
        return pa.StructArray.from_arrays([pa.array(sq), lists(own, rows, ref=known.refs.take(pa.array(other)), s=pa.array(s)), rare], ["sq", "pairs", "rare"])

    rows = _by_key(texts, key, "text", parts).select(key, met("_texts").alias("m")).select(key, F.col("m.sq").alias("_sq"), F.col("m.pairs").alias("_pairs"), F.col("m.rare").alias("_far"))
    if fetched:
        rows = stored(rows, "met")
        far = rows.select(key, F.explode("_far").alias("t")).select(key, "t.term", "t.n")
        far = far.repartition(parts, "term") if parts else far
        unlisted = F.lit(once).cast("double")
        rarer = idf.where(~often).select("term", "idf")  # those have a weight
        far = far.join(rarer, "term", "left").withColumn("idf", F.coalesce("idf", unlisted)).groupBy(key).agg(F.sum(_weight() * _weight()).alias("_rare"))
        rows = rows.join(far, key, "left").withColumn("_sq", F.col("_sq") + F.coalesce("_rare", F.lit(0.0)))
    pairs = rows.select(key, "_sq", F.explode_outer("_pairs").alias("r")).where("r is not null")
    return pairs.select(key, F.col("r.ref").alias(ref), (F.col("r.s") / F.sqrt("_sq")).alias("score"))


def top(scored: DataFrame, key: str, ref: str, k: int, digits: int = 4) -> DataFrame:
    """The k best references of each text, ties by reference; scores rounded."""
    best = Window.partitionBy(key).orderBy(F.desc(F.round("score", digits)), ref)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(key, ref, "rank", F.round("score", digits).alias("score"))


def sure(score: Column, second: Column, margin: Column, references: Column, min_score: float = 0.12, min_margin: float = 0.04, min_ratio: float = 1.4, few: tuple[int, float] = (5, 0.35)) -> Column:
    """Is a best match good enough, and far enough from the second? With fewer references than few[0] it has to be plainly the same."""
    least = F.when(references < few[0], F.greatest(F.lit(min_score), F.lit(few[1]))).otherwise(min_score)
    return (score >= least) & (margin >= min_margin) & (score >= min_ratio * second)


def confidence(ranked: DataFrame, key: str, ref: str, references: DataFrame, **limits) -> DataFrame:
    """Best reference, score, margin to the second and a label. `references` has one row and column n."""
    by_rank = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    rows = ranked.where("rank <= 2").groupBy(key).agg(F.min_by(ref, "rank").alias(ref), by_rank(1).alias("score"), F.coalesce(by_rank(2), F.lit(0.0)).alias("next")).crossJoin(F.broadcast(references))
    margin = F.round(F.col("score") - F.col("next"), 4)
    return rows.select(key, ref, "score", margin.alias("margin"), F.when(sure(F.col("score"), F.col("next"), margin, F.col("n"), **limits), "high").otherwise("low").alias("confidence"))
