"""Exact nearest vectors by cosine, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest(vectors: DataFrame, key: str, group: str, vector: str, ref: str, k: int, digits: int = 5, block: int = 2048, asking: Column | None = None) -> DataFrame:
    """key, ref and score of the k vectors of its group that are most like each vector, ties by ref.

    A group's vectors are dealt to blocks, and each pair of blocks is a task's matter: all pairs are scored, but
    only k of a vector and block become rows. Null and zero vectors and null groups have no score; vectors of
    different lengths, and rows with one and the same key, are not compared. asking: which rows to answer for, all without it.
    """
    rows = vectors.select((F.lit(True) if asking is None else asking).alias("_asks"), F.col(key).alias("id"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and g is not null and exists(v, x -> x != 0) and not exists(v, x -> x is null or isnan(x))").withColumn("n", F.size("v"))
    counts = rows.groupBy("g", "n").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = rows.join(counts, ["g", "n"]).withColumn("own", F.pmod(F.xxhash64("id"), "parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    asked = dealt.where("_asks").select("g", "n", F.col("own").alias("q"), every.alias("r"), F.lit(True).alias("asks"), "id", "v")
    held = dealt.select("g", "n", every.alias("q"), F.col("own").alias("r"), F.lit(False).alias("asks"), "id", "v")

    def best(cell: pa.Table) -> pa.Table:
        asks, ids = cell.column("asks").to_numpy(), cell.column("id").to_numpy()
        if not asks.any():
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x = cell.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x = x / np.sqrt((x * x).sum(1))[:, None]
        order = np.argsort(ids[~asks], kind="stable")
        refs, y = ids[~asks][order], x[~asks][order]
        mine, own = x[asks], ids[asks]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for lo in range(0, len(own), 512):
            raw = mine[lo : lo + 512] @ y.T * 10.0**digits
            score = np.copysign(np.floor(np.abs(raw) + 0.5), raw) / 10.0**digits + 0.0
            score[own[lo : lo + 512, None] == refs] = -np.inf
            for _ in range(min(k, len(refs))):
                at = score.argmax(1)  # the first of equals has the smallest id
                top = score[np.arange(len(at)), at]
                found = top > -np.inf
                out.append((own[lo : lo + 512][found], refs[at[found]], top[found]))
                score[np.arange(len(at)), at] = -np.inf
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"id": a, "other": b, "score": s})

    met = asked.unionByName(held).groupBy("g", "n", "q", "r").applyInArrow(best, "id long, other long, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias(key), F.col("other").alias(ref), "score")
