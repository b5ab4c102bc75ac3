"""Hierarchical multi-length packing.

Context tiers are powers of two (512, 1024, 2048, 4096). Each document, encoded once and closed
with the end id, is routed to the smallest tier that holds it; longer ones first fill whole
windows of the longest tier. Tiers are packed from the longest down: a window of a tier takes one
of its documents, its gap the largest shorter documents that fit, and the rest of the gap a piece
cut off a shorter document. What the shortest tier has left is cut into full windows too, so that
windows are full, and of a power of two, without padding. Full windows are dealt into step groups of
exactly `step_tokens` ids and like mixtures of lengths; windows wait for their group from flush to
flush, and only the last group of a partition, and of each group of remainders, may hold fewer ids.

Packing runs within each partition over buffers of bounded size. Less than a window of the shortest
tier is left over by a partition; these remainders meet in groups of 64 partitions, and what a
group leaves is cut into windows of smaller powers of two.

Defined cases: null or empty text: one piece, the end id; repeated rows and null ids: each row is a
document of its own; no rows: no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tidy
from .tokens import encoder, vocabulary, with_end

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"
ROW = PIECE + ", part int, ids binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]
FAN_IN = 64


class Piece:
    """ids[start:start + len(ids)] of a document with doc_tokens ids."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id, start, ids, doc_tokens):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __lt__(self, other):
        return len(self.ids) < len(other.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens)


class Packer:
    """Fills windows from pieces that come in; `done` has (tier, pieces) of full windows."""

    def __init__(self, tiers: tuple[int, ...] = (512, 1024, 2048, 4096)):
        self.tiers = tuple(sorted(tiers))
        self.pools: dict[int, list[Piece]] = {t: [] for t in self.tiers}
        self.done: list[tuple[int, list[Piece]]] = []
        self.waiting = 0

    def add(self, piece: Piece) -> None:
        top = self.tiers[-1]
        while len(piece.ids) > top:
            head, piece = piece.cut(top)
            self.done.append((top, [head]))
        self._route(piece)

    def _route(self, piece: Piece) -> None:
        n = len(piece.ids)
        tier = next(t for t in self.tiers if n <= t)
        if n == tier:
            self.done.append((tier, [piece]))
        elif n:
            insort(self.pools[tier], piece)
            self.waiting += n

    def _take(self, tier: int, k: int) -> Piece:
        piece = self.pools[tier].pop(k)
        self.waiting -= len(piece.ids)
        return piece

    def _fitting(self, below: int, gap: int) -> Piece | None:
        """The longest waiting piece of a tier shorter than `below` with at most `gap` ids."""
        for t in reversed(self.tiers):
            if t < below and (k := bisect_right(self.pools[t], gap, key=lambda p: len(p.ids))):
                return self._take(t, k - 1)
        return None

    def _any(self) -> Piece | None:
        """The shortest waiting piece."""
        return next((self._take(t, 0) for t in self.tiers if self.pools[t]), None)

    def flush(self) -> None:
        """Fill windows until fewer ids wait than the shortest tier has."""
        for tier in reversed(self.tiers):
            while self.pools[tier] and self.waiting >= tier:
                window = [self._take(tier, -1)]
                gap = tier - len(window[0].ids)
                while gap and (p := self._fitting(tier, gap)):
                    window.append(p)
                    gap -= len(p.ids)
                while gap:
                    p = self._any()
                    if len(p.ids) > gap:
                        p, rest = p.cut(gap)
                        self._route(rest)
                    window.append(p)
                    gap -= len(p.ids)
                self.done.append((tier, window))
            # too little is left for a window of this tier: its documents go on to shorter ones
            while self.pools[tier] and tier != self.tiers[0]:
                p = self._take(tier, -1)
                head, rest = p.cut(tier // 2)
                self.done.append((tier // 2, [head]))
                self._route(rest)

    def rest(self) -> list[Piece]:
        out = []
        while p := self._any():
            out.append(p)
        return out


def step_groups(lengths: list[int], tokens: int, groups: int | None = None) -> list[int]:
    """A group for each window: the longest first, each to the group that has the fewest ids so far. Lengths that are
    powers of two leave groups equal where they can be, and like in the lengths that they hold."""
    groups = groups or max(1, -(-sum(lengths) // tokens))
    out, held = [0] * len(lengths), [(0, g) for g in range(groups)]
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n, g = heappop(held)
        out[k] = g
        heappush(held, (n + lengths[k], g))
    return out


class _Rows:
    """Collects rows of the result. Windows wait, as rows without their ids, until they fill step groups: `mix` groups
    of exactly step_tokens at a time, whatever batch or flush their windows are of; at the end of a partition
    single groups, and one that is not full."""

    def __init__(self, base: int, step_tokens: int, mix: int = 8):
        self.next, self.steps, self.step_tokens, self.mix = base, base, step_tokens, mix
        self.cols: list[list] = [[] for _ in NAMES]
        self.open: list[tuple[int, list[tuple]]] = []

    def windows(self, done: list[tuple[int, list[Piece]]]) -> None:
        for tier, pieces in done:
            at, made = 0, []
            for p in pieces:
                made.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, self.next, at, tier))
                at += len(p.ids)
            self.open.append((tier, made))
            self.next += 1
        self._deal(self.mix)

    def close(self) -> None:
        self._deal(1)
        if self.open:
            self._emit(self.open, None)
            self.open = []

    def _deal(self, groups: int) -> None:
        total, wanted = sum(t for t, _ in self.open), groups * self.step_tokens
        while total >= wanted:
            gap, taken, left = wanted, [], []
            for w in self.open:  # in order of arrival, so that groups have the mixture that comes in
                if w[0] <= gap:
                    gap -= w[0]
                    taken.append(w)
                else:
                    left.append(w)
            if gap and total < 2 * wanted:
                return  # shorter windows may come
            self._emit(taken, groups)
            self.open = left
            total -= wanted - gap

    def _emit(self, windows: list[tuple[int, list[tuple]]], groups: int | None) -> None:
        dealt = step_groups([t for t, _ in windows], self.step_tokens, groups)
        for (_, made), group in zip(windows, dealt, strict=True):
            for row in made:
                self._row(*row, self.steps + group, None, None)
        self.steps += max(dealt, default=-1) + 1

    def left(self, pieces: list[Piece], part: int) -> None:
        for p in pieces:
            self._row(p.doc_id, p.start, len(p.ids), None, p.doc_tokens, None, None, None, None, part, p.ids.astype("<u4").tobytes())

    def _row(self, *values) -> None:
        for col, v in zip(self.cols, values, strict=True):
            col.append(v)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 9 + [pa.int32(), pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.cols, kinds, strict=True)], names=NAMES)
        self.cols = [[] for _ in NAMES]
        return out


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = (512, 1024, 2048, 4096), end_id: int = 2, buffer_tokens: int = 1 << 20, step_tokens: int = 1 << 16) -> DataFrame:
    """One row per piece of docs (doc_id, text): where it comes from, its window and its place there.

    A partition holds at most `buffer_tokens` waiting ids. Each text is encoded once; the pieces and
    the remainders are stored in the shared folder, and only the remainders' ids are shuffled.
    """

    @tidy
    def packed(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        packer, rows = Packer(tiers), _Rows(part << 32, step_tokens)
        for batch in batches:
            k = 0
            for ids, n in enc.encode_parts(batch.column(1)):
                ids, n = with_end(ids, n, end_id)
                ends = np.cumsum(n)
                for key, e, m in zip(batch.column(0).slice(k, len(n)).to_pylist(), ends.tolist(), n.tolist(), strict=True):
                    packer.add(Piece(key, 0, ids[e - m : e], m))
                k += len(n)
                if packer.waiting >= buffer_tokens:
                    packer.flush()
                rows.windows(packer.done)
                packer.done = []
                yield rows.batch()
        packer.flush()
        rows.windows(packer.done)
        rows.close()
        rows.left(packer.rest(), part)
        yield rows.batch()

    def remainders(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "doc_id", "start"], kind="stable")
        packer = Packer(tiers)
        for r in group.itertuples():
            packer.add(Piece(None if pd.isna(r.doc_id) else int(r.doc_id), int(r.start), np.frombuffer(r.ids, "<u4"), int(r.doc_tokens)))
        packer.flush()
        done, rest = packer.done, packer.rest()
        size = sum(len(p.ids) for p in rest)
        for power in reversed(range(size.bit_length())):  # the last few ids: windows of smaller powers of two
            gap = size & 1 << power
            window = []
            while gap:
                p = rest.pop(0)
                if len(p.ids) > gap:
                    p, tail = p.cut(gap)
                    rest.insert(0, tail)
                window.append(p)
                gap -= len(p.ids)
            if window:
                done.append((1 << power, window))
        rows = _Rows(1 << 62 | int(group["part"].iloc[0]) // FAN_IN << 32, step_tokens)
        rows.windows(done)
        rows.close()
        return rows.batch().to_pandas(integer_object_nulls=True)[[*PIECES]]

    made = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, ROW), "packed")
    left = made.where(F.col("ids").isNotNull())
    tail = left.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(remainders, PIECE)
    return made.where(F.col("ids").isNull()).select(*PIECES).unionByName(tail)


PIECES = NAMES[:9]


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
