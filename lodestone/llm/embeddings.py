"""Embedding near-duplicates: an exact metric range join.

On the unit sphere the cosine is a distance: cosine >= c means a Euclidean distance of at most
r = sqrt(2 - 2c). A bounded sample of vectors serves as pivots. A vector's home is the cell of its
nearest pivot p. It is copied to the cell of another pivot q only if a vector at home there can be
within r: by the triangle inequality d(x, q) <= d(x, p) + 2r, and, tighter on the sphere,
d(x, q)^2 - d(x, p)^2 <= 2 r d(p, q). So each home vector finds all its partners in its own cell,
cells join independently, and no pair is counted twice. Cells are kept apart by label. Cells of
many vectors are joined as blocks of bounded size; within a block similarities are matrix products.
Blocks return counts and, in place of pairs, each vector with the smallest it is connected to there.

Copies of a vector (same label and components) are one unit of the join, counted with the number
of their rows; a vec_id that comes with several vectors has units of its own, which don't link with
each other. Defined cases: label or vector null, a component null or not finite, or all zero:
links with nothing; vec_id null: likewise, component null, kept; rows that repeat a vec_id: each is
a vector, all rows of the vec_id have the links of all of them together with vectors of other
ids, and one component; vectors of different lengths don't link; no rows: no rows; other columns
aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table, tidy
from .components import connected_components

_SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def links_of_block(homes: np.ndarray, home_at: np.ndarray, members: np.ndarray, owners: np.ndarray, weights: np.ndarray, cosine: float):
    """For members, of which those at home_at are homes: the weight of each home's partners, and for each
    member the first one that it is connected with here. owners: members of one owner don't link."""
    h, m = unit(homes), unit(members)
    counts = np.zeros(len(h), np.int64)
    label = np.arange(len(members))
    for lo in range(0, len(h), 512):
        at = home_at[lo : lo + 512]
        s = h[lo : lo + 512] @ m.T
        linked = s >= cosine
        for i, j in np.argwhere(np.abs(s - cosine) < _SLACK).tolist():
            x, y = homes[lo + i], members[j]
            linked[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= cosine
        linked &= owners[at, None] != owners
        counts[lo : lo + 512] = linked @ weights
        a, b = np.nonzero(linked)
        a = at[a]
        while len(a):
            low = np.minimum(label[a], label[b])
            if (low == label[a]).all() and (low == label[b]).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
    while (label != label[label]).any():
        label = label[label]
    return counts, label


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, per_cell: int = 2000, max_pivots: int = 1024, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label)."""
    small_batches(vectors.sparkSession)
    bad = "exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("usable", F.expr(f"coalesce(vec_id is not null and label is not null and size(v) > 0 and not {bad} and exists(v, x -> x != 0), false)"))
    rows = rows.select("vec_id", "label", "v", "usable", F.when(F.col("usable"), F.xxhash64("v")).alias("p"), F.when(F.col("usable"), F.xxhash64(F.reverse("v"), F.lit(1))).alias("q"))
    key = ["label", "p", "q"]
    owned = stored(rows.select("vec_id", *key, "usable"), "vectors")
    alone = F.struct(*key)
    several = owned.where("usable").groupBy("vec_id").agg((F.min(alone) != F.max(alone)).alias("several")).where("several")
    usable = owned.where("usable").join(several, "vec_id", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    # a unit: the rows of one vector, apart for each vec_id that has other vectors too
    owner = F.when(F.col("several"), F.col("vec_id"))
    units = usable.groupBy(*key, owner.alias("owner")).agg(F.min("vec_id").alias("head"), F.count("*").alias("weight"))
    units = stored(units.withColumn("unit", F.monotonically_increasing_id()), "units")  # numbers stay from here on
    of_row = F.col("owner").eqNullSafe(owner)
    member = usable.join(units.withColumnsRenamed({k: f"u_{k}" for k in key}), [*[F.col(k) == F.col(f"u_{k}") for k in key], of_row])
    member = stored(member.groupBy("vec_id", "unit", "head", "weight", "owner").agg(F.count("*").alias("rows")), "members")
    own = [*[F.col(k) == F.col(f"u_{k}") for k in key], F.col("vec_id") == F.col("head")]
    single = rows.where("usable").join(units.withColumnsRenamed({k: f"u_{k}" for k in key}), own).dropDuplicates(["unit"])
    single = stored(single.select("unit", "label", "v", "weight", "p", "head", "owner"), "heads")

    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    # labels are cells of their own, so the largest one says how many pivots are of use
    sizes = single.groupBy(F.size("v").alias("n"), "label").count().groupBy("n").agg(F.max("count").alias("count"))
    sizes = sizes.orderBy(F.desc("count"), "n").limit(max_pivots).collect()
    pivots, left = {}, max_pivots
    for r in sizes:
        wanted = min(left, r["count"] // per_cell + 1)
        if wanted:
            drawn = single.where(F.size("v") == r["n"]).orderBy(F.xxhash64("p"), "unit").limit(wanted).select("v").collect()  # all together bounded by max_pivots
            pivots[r["n"]] = unit(np.array([x["v"] for x in drawn]))
            left -= wanted
        if r["count"] < per_cell:
            break  # a cell for each of the other lengths
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist(), strict=False))
    between = {n: np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) for n, x in pivots.items()}

    @tidy
    def cells(batches):
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for n in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == n)
                part = batch.take(pa.array(mine))
                if n not in pivots:
                    row, cell, home = np.arange(len(mine)), np.full(len(mine), -n), np.ones(len(mine), bool)
                else:
                    d2 = np.maximum(0, 2 - 2 * unit(_matrix(part.column(2))) @ pivots[n].T)
                    nearest = d2.argmin(1)
                    own = d2[np.arange(len(d2)), nearest][:, None]
                    close = (np.sqrt(d2) <= np.sqrt(own) + 2 * radius) & (d2 - own <= 2 * radius * between[n][nearest] + _SLACK)
                    close[np.arange(len(d2)), nearest] = True
                    row, cell = np.nonzero(close)
                    home = nearest[row] == cell
                    cell = cell + first[n]
                got = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([got.column(1), pa.array(cell, pa.int32()), pa.array(home), got.column(0), *(got.column(k) for k in (3, 4, 5)), got.column(2)], names=["label", "cell", "home", "unit", "weight", "head", "owner", "v"])

    kind = single.schema["label"].dataType.simpleString()
    placed = stored(single.select("unit", "label", "v", "weight", "head", "owner").mapInArrow(cells, f"label {kind}, cell int, home boolean, unit long, weight long, head long, owner long, v array<double>"), "cells")
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count_if("home") / block).alias("rows"), F.ceil(F.count("*") / block).alias("cols"))
    spread = placed.join(sizes, ["label", "cell"]).where("rows > 0")
    # every block of home vectors meets every block of the cell's vectors
    what = ["unit", "weight", "head", "owner", "v"]
    asked = spread.where("home").select("label", "cell", F.pmod(F.xxhash64("unit"), "rows").alias("i"), F.explode(F.expr("sequence(0L, cols - 1)")).alias("j"), F.lit(True).alias("asks"), *what)
    told = spread.select("label", "cell", F.explode(F.expr("sequence(0L, rows - 1)")).alias("i"), F.pmod(F.xxhash64("unit", F.lit(7)), "cols").alias("j"), F.lit(False).alias("asks"), *what)

    @tidy
    def join_block(block_rows: pa.Table) -> pa.Table:
        asks = block_rows.column("asks").to_numpy()
        ids, weights, heads = (block_rows.column(x).to_numpy() for x in ("unit", "weight", "head"))
        v = _matrix(block_rows.column("v").combine_chunks())
        # connections are kept among all units here, those that ask and those that are told
        both, one, place = np.unique(ids, return_index=True, return_inverse=True)
        told_weight = np.zeros(len(both), np.int64)
        told_weight[place[~asks]] = weights[~asks]
        owned_by = block_rows.column("owner")
        no_owner = owned_by.is_null().to_numpy()[one]
        # a unit is its own only owner unless a vec_id owns several: those come after all units' numbers
        owners = np.arange(len(both))
        owners[~no_owner] = len(both) + np.unique(owned_by.fill_null(0).to_numpy()[one][~no_owner], return_inverse=True)[1]
        n, root = np.zeros(len(both), np.int64), np.arange(len(both))
        home_at = place[asks]
        if told_weight.any() and len(home_at):
            n[home_at], root = links_of_block(v[asks], home_at, v[one], owners, told_weight, cosine)
        keep = (n > 0) | (root != np.arange(len(both)))
        return pa.table({"unit": both[keep], "n": n[keep], "a": heads[one][keep], "b": heads[one][root][keep]})

    found = stored(asked.unionByName(told).groupBy("label", "cell", "i", "j").applyInArrow(join_block, "unit long, n long, a long, b long"), "links")
    counted = found.groupBy("unit").agg(F.sum("n").alias("n"))
    component = connected_components(found.select("a", "b").unionByName(member.select(F.col("vec_id").alias("a"), F.col("head").alias("b"))))
    copies = F.when(F.col("owner").isNull(), F.col("weight") - F.col("rows")).otherwise(0)
    total = member.join(counted, "unit", "left").groupBy("vec_id").agg(F.sum(F.col("rows") * (copies + F.coalesce("n", F.lit(0)))).alias("n_links"))
    out = owned.join(total, "vec_id", "left").join(component.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    smallest = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), smallest.alias("component_id"), F.coalesce(smallest == F.col("vec_id"), F.lit(True)).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id != b.vec_id
  AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT a, a AS b FROM (SELECT DISTINCT a FROM l) UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id,
  coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
