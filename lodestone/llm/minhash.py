"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find.

SuperMinHash gives each shingle a random permutation of the signature's places and a random
fraction; at a shingle's j-th place the value is j plus the fraction, and a place keeps its
smallest value. Ranks of one shingle are thus correlated (a permutation, not independent draws),
which lowers the variance. The levels j are worked through for all shingles at once; a document
stops as soon as each place has a value, since later levels are larger.

Distinct sets, told apart by two 64-bit sums over their shingles, are the nodes of the graph; a
document that repeats with other texts has several, which are linked. Nodes that agree in a band
share a bucket. Two rounds verify candidates on the full sets. First each member of a bucket meets
the bucket's most central one (whose buckets are the fullest: as a rule the text that the others
were made from): pairs in proportion to the bucket. Then, in buckets that still hold several
components, members outside the bucket's largest component meet all members of other components.
That happens within tasks: blocks of a bounded number of shingles bring signatures and texts
along, pairs whose signatures agree as far as similar sets' do are verified on the spot unless
links found before join them already, and only links that join something become rows. So no
candidate pair that could join two components is left out, and no pair becomes a row but a link.
A pair that shares several bands is met in the first one. By calculation (places taken as
independent), with 24 bands of 5 banding misses a pair with a probability of 8e-7 at a similarity
of 0.85 and 7e-5 at 0.80, and the signature test (4.5 standard deviations) with 2e-5.

Defined cases: null text or one without words: empty set, links with nothing; fewer words than a
shingle: the whole sequence is the only shingle; null doc_id: links with nothing, component null,
kept; rows that repeat a doc_id share its links and verdict, also those of its other texts; no
rows: no rows; other columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, compressed, partitions, small_batches, stored, table, tidy
from .components import connected_components
from .shingles import mix, shingle_sets

_GOLD = 0x9E3779B97F4A7C15
_STEP = np.uint64(_GOLD)


def superminhash(hashes: np.ndarray, sizes: np.ndarray, places: int) -> np.ndarray:
    """Signatures (documents x places) of sets that lie one after the other in hashes; empty: infinite."""
    docs = len(sizes)
    out = np.full(docs * places, np.inf)
    doc = np.repeat(np.arange(docs), sizes)
    own, perm = hashes, None
    for level in range(places):
        state = mix(own + np.uint64(_GOLD * (2 * level + 1) % (1 << 64)))
        fraction = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = level + (mix(state + _STEP) % np.uint64(places - level)).astype(np.int64)
        if perm is None:  # nothing is swapped yet
            place = k
        else:
            e = np.arange(len(own))
            place = perm[e, k].astype(np.int64)
            perm[e, k] = perm[:, level]
        np.minimum.at(out, doc * places + place, level + fraction)
        waiting = np.isinf(out).reshape(docs, places).any(1)[doc]
        if not waiting.any():
            break
        if perm is None:
            own, doc, k = own[waiting], doc[waiting], k[waiting]
            perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint32), (len(own), 1))
            perm[np.arange(len(own)), k] = 0
        elif not waiting.all():
            own, doc, perm = own[waiting], doc[waiting], perm[waiting]
    return out.reshape(docs, places)


def signatures(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """For docs (doc_id, text): doc_id, h (a hash of the text), n_shingles, set_a, set_b (a fingerprint
    of the whole set), the hashes of the bands and `places`, a byte of each place of the signature."""

    @tidy
    def sign(batches):
        for batch in batches:
            for a, hashes, sizes in shingle_sets(batch.column(2), shingle):
                made = np.zeros((len(sizes), bands), np.uint64)
                places = np.zeros((len(sizes), bands * rows), np.uint8)
                ends = np.cumsum(sizes)
                for lo in range(0, len(sizes), 512):
                    part = slice(lo, lo + 512)
                    at = ends[lo] - sizes[lo]
                    sig = superminhash(hashes[at : at + sizes[part].sum()], sizes[part], bands * rows)
                    places[part] = mix(sig.view(np.uint64)) >> np.uint64(56)
                    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
                    made[part] = np.arange(bands, dtype=np.uint64) * _STEP
                    for r in range(rows):
                        made[part] = mix(made[part] * np.uint64(0x100000001B3) ^ bits[:, :, r])
                total = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(mix(hashes), out=total[0, 1:])
                np.cumsum(mix(hashes ^ _STEP), out=total[1, 1:])
                prints = (total[:, ends] - total[:, ends - sizes]).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * bands, made.reshape(-1).view(np.int64))
                keys = [batch.column(k).slice(a, len(sizes)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), lists, pa.array([x.tobytes() for x in places], pa.binary())], names=["doc_id", "h", "n_shingles", "set_a", "set_b", "bands", "places"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return keyed.mapInArrow(sign, "doc_id long, h long, n_shingles long, set_a long, set_b long, bands array<long>, places binary")


def _texts(docs: DataFrame, wanted: DataFrame, bound: int = 4_000_000) -> DataFrame:
    """node and the compressed text of the wanted (node, doc_id, h). What isn't wanted is left out before
    the shuffle, by a broadcast of 64-bit keys, as long as there are `bound` of them (about 100 MB) at most."""
    key = F.xxhash64("doc_id", "h")
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    if wanted.count() <= bound:
        texts = texts.withColumn("key", key).join(F.broadcast(wanted.select(key.alias("key"))), "key", "left_semi").drop("key")

    @tidy
    def compress(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], compressed(batch.column(2))], names=["doc_id", "h", "text"])

    packed = texts.mapInArrow(compress, "doc_id long, h long, text binary")
    return packed.join(wanted, ["doc_id", "h"]).select("node", "text").dropDuplicates(["node"])


class _Sets:
    """The shingle sets of compressed texts; those used last are kept, `room` shingles of them."""

    def __init__(self, shingle: int, room: int = 2_000_000):
        self.shingle, self.room, self.held, self.kept = shingle, room, 0, OrderedDict()

    def __getitem__(self, text: bytes) -> np.ndarray:
        if text in self.kept:
            self.kept.move_to_end(text)
            return self.kept[text]
        raw = pa.array([zstandard.decompress(text)], pa.large_binary()).cast(pa.large_string())
        own = np.concatenate([h for _, h, _ in shingle_sets(raw, self.shingle)])
        self.kept[text] = own
        self.held += len(own)
        while self.held > self.room and len(self.kept) > 2:
            self.held -= len(self.kept.popitem(last=False)[1])
        return own


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _similar(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets have 100 * intersection >= percent * union."""

    @tidy
    def verify(batches):
        sets = _Sets(shingle)
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([alike(sets[x], sets[y], percent) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _joining_links(members: DataFrame, percent: int, shingle: int, block: int = 500_000) -> DataFrame:
    """Links (a, b) that join components within buckets, for members (bucket, node, component, n_shingles,
    places, bands, text) of buckets with several components.

    A bucket's rows outside its largest component, and those inside, are dealt into blocks of about
    `block` shingles. Each block from outside meets every block from inside and every other one from
    outside; pairs within it are dealt with where it meets the first block from inside. Buckets
    of one block each are worked on many at a time.
    """
    weight = F.col("n_shingles") + 100
    shares = members.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
    sizes = shares.groupBy("bucket").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("largest"), F.sum("w").alias("all"), F.max_by("w", F.struct("c", -F.col("component"))).alias("inside"))
    sizes = sizes.select("bucket", "largest", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("inside")) / block)).alias("outer"), F.ceil(F.col("inside") / block).alias("inner"), "all")
    total = sizes.agg(F.sum("all")).first()[0] or 0
    cells = max(partitions(members.sparkSession), total // (2 * block) + 1)  # small buckets: about two blocks a cell
    rows = members.join(sizes, "bucket")
    hashed = F.xxhash64("node")
    outside = F.col("component") != F.col("largest")
    own = F.when(outside, F.pmod(hashed, "outer")).otherwise(F.col("outer") + F.pmod(hashed, "inner"))
    met = F.expr("filter(sequence(0L, if(component != largest, outer + inner, outer) - 1), x -> x != own)")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(met))
    small = (F.col("outer") == 1) & (F.col("inner") == 1)
    dealt = dealt.select(F.when(small, F.pmod("bucket", F.lit(cells))).otherwise(F.col("bucket")).alias("cell"), small.alias("small"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "outer", "bucket", "node", "n_shingles", "component", "places", "bands", "text")

    @tidy
    def compare(group: pa.Table) -> pa.Table:
        col = lambda name: group.column(name).to_numpy()
        order = np.lexsort((col("node"), col("bucket")))
        bucket, node, n, component, own, lo, outer = (col(x)[order] for x in ("bucket", "node", "n_shingles", "component", "own", "lo", "outer"))
        places = np.frombuffer(b"".join(group.column("places").to_pylist()), np.uint8).reshape(len(order), -1)[order]
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        texts, sets = group.column("text"), _Sets(shingle)
        width, p = places.shape[1], percent / 100
        least = width * p - 4.5 * np.sqrt(width * p * (1 - p))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        out: list[tuple[int, int]] = []
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        step = 128
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            # outer blocks ask; with the first inner block they also ask among themselves
            within = own[first:last] == lo[first]
            asks = first + np.flatnonzero(within)
            told = first + np.flatnonzero(~within)
            if bool((own[told] == outer[first]).any()):
                told = np.concatenate([asks, told])
            for i in range(0, len(asks), step):
                x = asks[i : i + step]
                for j in range(0, len(told), step):
                    y = told[j : j + step]
                    label = {c: find(c) for c in {*component[x].tolist(), *component[y].tolist()}}
                    apart = np.array([label[c] for c in component[x].tolist()])[:, None] != np.array([label[c] for c in component[y].tolist()])
                    good = apart & (100 * np.minimum(n[x, None], n[y]) >= percent * np.maximum(n[x, None], n[y]))
                    if not good.any():
                        continue
                    a, b = np.nonzero(good)
                    keep = (places[x[a]] == places[y[b]]).sum(1) >= least
                    a, b = x[a[keep]], y[b[keep]]
                    shared = (bands[a] == bands[b]).argmax(1)
                    keep = bands[a, shared] == bucket[first]
                    for k, m in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                        s, t = find(int(component[k])), find(int(component[m]))
                        if s != t and alike(sets[texts[int(order[k])].as_py()], sets[texts[int(order[m])].as_py()], percent):
                            root[max(s, t)] = min(s, t)
                            out.append((int(node[k]), int(node[m])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.groupBy("cell", "small", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, bands: int = 24, rows: int = 5, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Links join documents with 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest doc_id that links reach; kept marks that document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stored(signatures(docs, bands, rows, shingle), "signatures")
    linked = signed.where("doc_id is not null and n_shingles > 0")
    key = ["set_a", "set_b"]
    one = F.min_by(F.struct("doc_id", "h", "n_shingles", "bands", "places"), F.struct("doc_id", "h")).alias("one")
    sets = linked.groupBy(*key).agg(one).select(*key, F.monotonically_increasing_id().alias("node"), F.col("one.doc_id").alias("head"), "one.h", "one.n_shingles", "one.bands", "one.places")
    sets = scratch.stored(sets, "sets")  # from here on a node's number is fixed
    member = stored(linked.select("doc_id", *key).join(sets.select(*key, "node", "head"), key).select("doc_id", "node", "head").distinct(), "members")

    # buckets of nodes that agree in a band
    rows_of = sets.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    crowded = rows_of.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowd = scratch.stored(rows_of.join(crowded, "bucket"), "buckets")
    central = crowd.groupBy("node").agg(F.sum("n").alias("central"))
    pivot = crowd.join(central, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n_shingles"), F.struct("central", -F.col("node"))).alias("pivot"))
    wanted = scratch.stored(sets.join(central.select("node"), "node", "left_semi").select("node", F.col("head").alias("doc_id"), "h"), "wanted")
    near = scratch.stored(_texts(docs, wanted), "texts")

    # first round: each member against the bucket's most central one
    size = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent  # noqa: E731  a smaller ratio can't reach the similarity
    tried = crowd.join(pivot, "bucket").where("node != pivot.node").where(size(F.col("n_shingles"), F.col("pivot.n_shingles")))
    tried = tried.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()
    links = scratch.stored(_similar(tried, near, percent, shingle), "links")
    # texts under one doc_id belong together
    several = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1")
    own = member.join(several, "doc_id").select("a", F.col("node").alias("b")).where("a != b")
    found = connected_components(links.unionByName(own))

    # second round: members of different components that share a bucket
    placed = crowd.join(found.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", F.coalesce("component_id", "node").alias("component"))
    placed = scratch.stored(placed, "placed")
    mixed = placed.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("mixed")).where("mixed").select("bucket")
    left = placed.join(mixed, "bucket").join(sets.select("node", "n_shingles", "places", "bands"), "node").join(near, "node")
    extra = scratch.stored(_joining_links(left, percent, shingle), "links")
    if not extra.isEmpty():
        found = connected_components(found.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(extra))

    # the smallest doc_id of each component
    inside = found.join(sets.select(F.col("node").alias("id"), "head"), "id")
    least = inside.groupBy("component_id").agg(F.min("head").alias("least"))
    reached = stored(inside.join(least, "component_id").select(F.col("id").alias("node"), "least"), "components")
    scratch.clear()
    of_doc = member.join(reached, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("least", "head")).alias("least"))
    out = signed.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
