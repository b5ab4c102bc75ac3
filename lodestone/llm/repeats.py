"""Removal of repeated passages by prefix-free parsing of the corpus.

The corpus is the documents in order of doc_id, and a position is repeated if the `length` bytes
from there also start earlier. Parsing and ordering:

Triggers. A rolling hash runs over all strings of `trigger` bytes. In each window of `length`
bytes the (leftmost) string with the smallest hash is the window's trigger. So triggers depend on
content alone, and no window is without one, which a fixed modulus couldn't promise.

Phrases. Neighbouring windows with one trigger form a phrase: their bytes, overlapping the next
phrase by length - 1. Each window lies in exactly one phrase, so the parse of a document is its list
of phrases, and equal windows have the same trigger at the same place in their phrases.

Parse. A window never leaves its phrase, so of the parse's suffixes only the first phrase matters:
its suffix array, cut off there, is the list of occurrences in order of phrase and corpus position.
A phrase's first occurrence stands for it in the dictionary; all windows of its later ones are
repeated. Phrases are told apart by their bytes within a batch of texts, and across batches by a hash
modulo the prime 2 ** 61 - 1 and 32 bits of their trigger's hash.

Dictionary. What is left are equal windows of different phrases. They have the trigger in common and,
on the side of the window's middle where it lies, half the bytes around it (its context). Phrases
that share trigger and a context with another one go, as bytes, to a cell of that context, and
there the suffix array of the dictionary, to `length` bytes, is built by prefix doubling over the
bytes themselves. Neighbours in it that agree in `length` bytes form a run, which the parse puts
into corpus order; all but the first are repeated.

Before anything is shuffled, phrases that a batch of texts has already had are settled there, so
a passage that a third of the documents hold is sent about once per batch. Occurrences travel as
compressed columns, one block per batch and cell; numbers of cells follow from measured bytes.

Defined cases: null text: empty; texts shorter than `length`: nothing is removed; null doc_id:
last in corpus order; rows that repeat a doc_id and text are one document, and each gets its
result; rows with one doc_id and different texts follow a hash of the text; no rows: no rows.
Matches never cross documents. Other columns are carried along whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, Scratch, compressed, partitions, row_bytes, small_batches, stored, table, tidy
from .shingles import mix
from .tokens import runs

_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)
#: A place is a position and, in its low bits, the trigger's offset (7 bits) and a number of windows (7 bits).
BITS = 14
COUNT = (1 << 7) - 1


def parts(texts: pa.Array, length: int, part: int):
    """(rows, positions in their texts, data, bounds) of strings of about `part` bytes together; longer
    texts come in parts that overlap by length - 1."""
    data, offsets = row_bytes(texts)
    n = len(texts)
    row = 0
    while row < n:
        size = offsets[row + 1] - offsets[row]
        if size > part:
            for a in range(0, size - length + 1, part):
                b = min(size, a + part + length - 1)
                yield np.array([row]), np.array([a]), data[offsets[row] + a : offsets[row] + b], np.array([0, b - a])
            row += 1
        else:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + part, "right")) - 1)
            yield np.arange(row, end), np.zeros(end - row, np.int64), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


_OF_BYTE = np.random.default_rng(20).integers(1, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PRIME = (1 << 61) - 1
_P = np.uint64(_PRIME)
_X = 0x123456789ABCDEF7 % _PRIME
_powers: dict[tuple[int, int], np.ndarray] = {}
CACHES.append(_powers)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2 ** 61 - 1."""
    half, low30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    s31, s30, s61 = np.uint64(31), np.uint64(30), np.uint64(61)
    a0, a1, b0, b1 = a & half, a >> s31, b & half, b >> s31
    middle = a1 * b0 + a0 * b1
    x = (a1 * b1 << np.uint64(1)) + (middle >> s30) + ((middle & low30) << s31) + a0 * b0
    x = (x & _P) + (x >> s61)
    return np.where(x >= _P, x - _P, x)


def powers(base: int, n: int, modulus: int = 1 << 64) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1) modulo 2 ** 64 or 2 ** 61 - 1."""
    have = _powers.get((base, modulus))
    if have is None or len(have) < n:
        size = max(n, 1 << 16) * 9 // 8
        if modulus == 1 << 64:
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            have = np.cumprod(steps)
        else:
            have = np.ones(1, np.uint64)
            while len(have) < size:
                have = np.concatenate([have, times(have, np.uint64(pow(base, len(have), modulus)))])
        _powers[base, modulus] = have
    return have[:n]


class Hashes:
    """Hashes of any span of data in constant time: a polynomial modulo 2 ** 64, for triggers and contexts, where spans
    that only hash alike are told apart further on."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_OF_BYTE[data] * powers(_BASE, len(data)), out=self.total[1:])
        self.inverse = powers(_INVERSE, len(data) + 1)

    def spans(self, starts: np.ndarray, size) -> np.ndarray:
        return mix((self.total[starts + size] - self.total[starts]) * self.inverse[starts] + np.asarray(size).astype(np.uint64))


def exact_hashes(data: np.ndarray, starts: np.ndarray, size: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A hash of data[start : start + size] for each of some rising starts, for whole phrases: a polynomial modulo
    2 ** 61 - 1, by which two different ones of n bytes agree with a probability of n / 2 ** 61 at most, however
    they are made. Running sums are kept for a block of starts at a time."""
    out, longest = np.empty(len(starts), np.uint64), int(size.max(initial=0))
    edges = np.searchsorted(starts, np.arange(0, len(data) + block, block))
    half, inverse = np.uint64((1 << 31) - 1), pow(_X, -1, _PRIME)
    for k, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if lo == hi:
            continue
        value = data[k * block : (k + 1) * block + longest].astype(np.uint64) + np.uint64(1)
        power = powers(_X, len(value), _PRIME)
        low, high = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * x)]) for x in (power & half, power >> np.uint64(31)))
        at = starts[lo:hi] - k * block
        end = at + size[lo:hi]
        total = ((low[end] - low[at]) % _P + times((high[end] - high[at]) % _P, np.uint64(1 << 31))) % _P
        out[lo:hi] = mix(times(total, powers(inverse, len(value), _PRIME)[at]) ^ mix(size[lo:hi].astype(np.uint64)))
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] equals data[b : b + size], for each row."""
    if not len(a):
        return np.empty(0, bool)
    differs = data[runs(a, size)] != data[runs(b, size)]
    return ~np.logical_or.reduceat(differs, np.cumsum(size) - size)


def phrases(data: np.ndarray, bounds: np.ndarray, length: int, trigger: int):
    """First window, number of windows, the trigger's offset from the first window, hashes of trigger and
    phrase, and hashes of the context before and behind the trigger (0: it would leave the text) of
    each phrase in data.

    Equal windows agree in half the bytes around the trigger at least on one of its sides, so
    phrases without an equal context share no window.
    """
    n = len(data)
    windows = n - length + 1
    if windows < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 4
    hashes = Hashes(data)
    grams = n - trigger + 1
    h = mix((hashes.total[trigger:] - hashes.total[:-trigger]) * hashes.inverse[:grams])
    least = (h & _HIGH) | np.arange(grams, dtype=np.uint64)
    across, size = length - trigger + 1, 1
    while size * 2 <= across:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:windows], least[across - size : across - size + windows])
    at = (least & _LOW).astype(np.int64)
    fits = np.ones(windows, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        fits[max(a, b - length + 1) : b] = False
    first = fits.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~fits[:-1]
    last = fits.copy()
    last[:-1] &= first[1:] | ~fits[1:]
    starts = np.flatnonzero(first)
    count = np.flatnonzero(last) - starts + 1
    place, half = at[starts], (length - trigger) // 2
    doc = np.searchsorted(bounds, starts, "right") - 1
    before, behind = place - half, place + trigger + half
    left = np.where(before >= bounds[doc], hashes.spans(np.maximum(before, 0), half + trigger) | np.uint64(1), np.uint64(0))
    right = np.where(behind <= bounds[doc + 1], hashes.spans(np.minimum(place, n - half - trigger), half + trigger) | np.uint64(1), np.uint64(0))
    return starts, count, place - starts, h[place], exact_hashes(data, starts, count + length - 1), left, right


def packed(columns: list[np.ndarray]) -> bytes:
    return zstandard.compress(b"".join(c.tobytes() for c in columns), 3)


def unpacked(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The columns of all blocks, one block behind the other."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list] = [[] for _ in kinds]
    for blob in blobs:
        raw = zstandard.decompress(blob)
        n, at = len(raw) // width, 0
        for k, kind in enumerate(kinds):
            out[k].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in out]


PHRASE = ["u4", "u2", "u2", "u8", "i8", "i8"]  # trigger, contexts, phrase, document, place
BLOCK = "cell int, block binary, doc_order long, place long"


def blocks(cell: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row per cell with its rows' columns."""
    order = np.argsort(cell, kind="stable")
    columns = [c[order] for c in columns]
    edges = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0, [True]])).tolist() if len(cell) else [0]
    got = [(int(cell[order[a]]), packed([c[a:b] for c in columns])) for a, b in zip(edges, edges[1:], strict=False)]
    nothing = pa.nulls(len(got), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary()), nothing, nothing], names=["cell", "block", "doc_order", "place"])


def settled(docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    n = len(docs)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(docs), pa.array(places)], names=["cell", "block", "doc_order", "place"])


def later(keys: list[np.ndarray], docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks each row with a row of the same keys at an earlier document or place; and the first row of each row's keys."""
    order = np.lexsort((places, docs, *keys))
    a, b = order[:-1], order[1:]
    same = np.ones(len(b), bool)
    for k in keys:
        same &= k[a] == k[b]
    new = np.concatenate([[True], ~same]) if len(order) else np.empty(0, bool)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out, first = np.zeros(len(order), bool), np.empty(len(order), np.int64)
    out[order], first[order] = (docs[head] != docs[order]) | (places[head] >> BITS != places[order] >> BITS), head
    return out, first


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes of data by their first `length` bytes (fewer where data ends): prefix doubling.
    Equal ranks mean equal bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + len(data)]
    size, rank = 8, np.unique(word, return_inverse=True)[1].astype(np.uint64)
    while size < length:
        step = min(size, length - size)
        behind = np.zeros(len(rank), np.uint64)
        behind[: max(0, len(rank) - step)] = rank[step:] + np.uint64(1)
        rank = np.unique(rank << np.uint64(32) | behind, return_inverse=True)[1].astype(np.uint64)
        size += step
    return rank


def _with_order(docs: DataFrame) -> DataFrame:
    """doc (all columns but text), text and doc_order: a document's rank in the corpus, doc_id itself where that will do."""
    names = [c for c in docs.columns if c != "text"]
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), "text", F.col("doc_id").cast("long").alias("id"))
    clear = nested.groupBy("id").count().where("id is null or count > 1").isEmpty()
    if clear:
        return nested.withColumnRenamed("id", "doc_order")
    # some ids are null or repeated: number the different (doc_id, text) in corpus order, by ranges
    tie = F.coalesce(F.xxhash64("text"), F.lit(0))
    n = partitions(docs.sparkSession)
    ranged = nested.select(F.col("id").alias("_id"), tie.alias("_tie")).distinct().repartitionByRange(n, F.col("_id").asc_nulls_last(), "_tie").sortWithinPartitions(F.col("_id").asc_nulls_last(), "_tie")
    # partition number in the high bits, row number in the low ones: rising in corpus order
    ranks = stored(ranged.withColumn("doc_order", F.monotonically_increasing_id()), "order")
    return nested.withColumn("tie", tie).join(ranks, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).select("doc", "text", "doc_order")


def repeated_spans(docs: DataFrame, length: int = 100, trigger: int = 32, part: int = 2_000_000, cell_bytes: int = 4_000_000, as_text: bool = False) -> DataFrame:
    """Each row of docs as a struct `doc`, with n_bytes, the removed runs (`spans`, in bytes) and `kept` bytes.

    docs needs doc_id and text. Phrase occurrences are shuffled once, in blocks by trigger, a cell for
    each `cell_bytes` of text; the bytes of phrases that stay open, once; texts, compressed, once for
    the suffix step (those with open phrases) and once for the result. With as_text, `kept` is a
    string, without the characters that a run cuts.
    """
    across, half = length - trigger, (length - trigger) // 2
    assert across + 1 <= COUNT and length >= 8
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = _with_order(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = int(max(partitions(spark), size // cell_bytes + 1))

    @tidy
    def occurrences(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            for rows, base, data, bounds in parts(batch.column(1), length, part):
                start, count, offset, trig, phrase, left, right = phrases(data, bounds, length, trigger)
                k = np.searchsorted(bounds, start, "right") - 1
                doc, place = key[rows[k]], base[k] + start - bounds[k] << BITS | offset << 7 | count
                again, first = later([phrase], doc, place)
                rows_again = np.flatnonzero(again)
                again[rows_again] = same_bytes(data, start[rows_again], start[first[rows_again]], count[rows_again] + length - 1)
                new = ~again
                yield settled(doc[again], place[again])
                short = trig[new].astype(np.uint32)
                yield blocks((short % np.uint32(cells)).astype(np.int32), [short, left[new].astype(np.uint16), right[new].astype(np.uint16), phrase[new], doc[new], place[new]])

    @tidy
    def resolve(cell: pa.Table) -> pa.Table:
        trig, left, right, phrase, doc, place = unpacked(cell.column("block").to_pylist(), PHRASE)
        again, _ = later([phrase, trig], doc, place)
        # dictionary: first occurrences; those that share trigger and a context with another phrase stay open
        first = np.flatnonzero(~again)
        first = first[np.lexsort((phrase[first], trig[first]))]
        first = first[np.concatenate([[True], (np.diff(trig[first]) != 0) | (np.diff(phrase[first]) != 0)])] if len(first) else first
        route = trig[first].astype(np.int64) << 32
        for side, shift in ((left, 16), (right, 0)):
            both = trig[first].astype(np.uint64) << np.uint64(16) | side[first]
            _, at, n = np.unique(both, return_inverse=True, return_counts=True)
            route |= np.where(n[at] > 1, side[first].astype(np.int64), 0) << shift
        is_open = route & 0xFFFFFFFF != 0
        first, route = first[is_open], route[is_open]
        rows = np.concatenate([np.flatnonzero(again), first])
        return pa.table({"doc_order": doc[rows], "place": place[rows], "route": pa.array(np.concatenate([np.zeros(len(rows) - len(first), np.int64), route]), mask=np.arange(len(rows)) < len(rows) - len(first))})

    sent = scratch.stored(docs.select("doc_order", "text").mapInArrow(occurrences, BLOCK), "phrases")
    resolved = scratch.stored(sent.where("cell is not null").select("cell", "block").groupBy("cell").applyInArrow(resolve, "doc_order long, place long, route long"), "resolved")
    coarse = sent.where("cell is null").select("doc_order", "place").unionByName(resolved.where("route is null").select("doc_order", "place"))
    left_open = resolved.where("route is not null")
    waiting = left_open.agg(F.sum(F.col("place").bitwiseAND(COUNT) + length - 1)).first()[0] or 0
    suffix_cells = int(max(partitions(spark), 4 * waiting // cell_bytes + 1))

    @tidy
    def pack_texts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), compressed(batch.column(1))], names=["doc_order", "text"])

    small = docs.select("doc_order", "text").mapInArrow(pack_texts, "doc_order long, text binary")
    open_of = left_open.groupBy("doc_order").agg(F.collect_list(F.struct("place", "route")).alias("places"))

    @tidy
    def dictionary(batches):
        """The bytes of open phrases, each side's windows to the cell of trigger and context."""
        for batch in batches:
            got: list[list] = [[], [], [], []]
            listed = batch.column(2)
            for k in range(batch.num_rows):
                data = np.frombuffer(zstandard.decompress(batch.column(1)[k].as_py()), np.uint8)
                place, route = (x.to_numpy() for x in listed[k].values.flatten())
                start, offset, count = place >> BITS, place >> 7 & COUNT, place & COUNT
                on_left = np.clip(offset - half + 1, 0, count)  # windows that hold all of the left context
                for from_, n, ctx, side in ((start, on_left, route >> 16 & 0xFFFF, 1), (start + on_left, count - on_left, route & 0xFFFF, 0)):
                    some = (n > 0) & (ctx != 0)
                    a, m = from_[some], n[some]
                    got[0].append(mix((route[some] >> 32 << 17 | side << 16 | ctx[some]).view(np.uint64)) % np.uint64(suffix_cells))
                    got[1].append(np.full(len(a), batch.column(0)[k].as_py()))
                    got[2].append(a << BITS | m)
                    got[3].append(data[runs(a, m + length - 1)])
            cell, doc, place, data = (np.concatenate(x) for x in got)
            cell = cell.astype(np.int64)
            width = (place & COUNT) + length - 1
            at = np.cumsum(width) - width
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0, [True]])).tolist() if len(cell) else [0]
            cells_of, blobs = [], []
            for a, b in zip(edges, edges[1:], strict=False):
                own = order[a:b]
                cells_of.append(int(cell[own[0]]))
                blobs.append(packed([np.array([b - a]), doc[own], place[own], data[runs(at[own], width[own])]]))
            yield pa.RecordBatch.from_arrays([pa.array(cells_of, pa.int64()), pa.array(blobs, pa.binary())], names=["cell", "block"])

    @tidy
    def order_suffixes(cell: pa.Table) -> pa.Table:
        docs_of, places, texts = [], [], []
        for blob in cell.column("block").to_pylist():
            raw = zstandard.decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            docs_of.append(np.frombuffer(raw, np.int64, n, 8))
            places.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
            texts.append(np.frombuffer(raw, np.uint8, -1, 8 + 16 * n))
        doc, place, data = (np.concatenate(x) for x in (docs_of, places, texts))
        count = place & COUNT
        width = count + length - 1
        at = runs(np.cumsum(width) - width, count)  # where each window starts in the dictionary
        own = np.repeat(np.arange(len(doc)), count)
        position = runs(place >> BITS, count)
        rank = suffix_ranks(data, length)[at]
        again, _ = later([rank], doc[own], position << BITS)
        # neighbouring windows of one phrase go as one place
        hit = np.flatnonzero(again)
        head = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(own[hit]) != 0)]) if len(hit) else np.empty(0, bool)
        first = hit[head]
        n = np.diff(np.append(np.flatnonzero(head), len(hit)))
        return pa.table({"doc_order": doc[own[first]], "place": position[first] << BITS | n})

    entries = small.join(open_of, "doc_order").select("doc_order", "text", "places").mapInArrow(dictionary, "cell long, block binary")
    fine = scratch.stored(entries.repartition(suffix_cells, "cell").groupBy("cell").applyInArrow(order_suffixes, "doc_order long, place long"), "suffixes")
    marks = stored(coarse.unionByName(fine).groupBy("doc_order").agg(F.collect_set("place").alias("marks")), "marks")
    scratch.clear()
    out_type = docs.schema["doc"].dataType.simpleString()

    @tidy
    def squeeze(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), compressed(batch.column(1)), batch.column(2)], names=["doc", "text", "doc_order"])

    @tidy
    def cut_out(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for packed_text, marked in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = zstandard.decompress(packed_text)
                sizes.append(len(text))
                found = []
                if marked.is_valid:
                    places = np.sort(marked.values.to_numpy())
                    a = places >> BITS
                    b = np.maximum.accumulate(a + (places & COUNT) + length - 1)
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                    found = list(zip(a[new].tolist(), b[np.append(new[1:] - 1, len(b) - 1)].tolist(), strict=True))
                edges = [0, *(x for run in found for x in run), len(text)]
                spans.append([{"start": x, "end": y} for x, y in found])
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if found else text)
            if as_text:
                kept = [x.decode("utf-8", "ignore") for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string() if as_text else pa.binary())], names=["doc", "n_bytes", "spans", "kept"])

    whole = docs.mapInArrow(squeeze, f"doc {out_type}, text binary, doc_order long")
    return whole.join(marks, "doc_order", "left").select("doc", "text", "marks").mapInArrow(cut_out, f"doc {out_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return got.select("doc.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
