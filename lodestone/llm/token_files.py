"""Token-ID / binary output: flat files of unsigned ids, 64-bit document offsets, memory-mapped.

A set of files is one folder. Shard k has `<name>.bin`, the ids of its documents one behind the
other (uint16 if the vocabulary allows, else uint32, little-endian), and `<name>.idx`: int64
number of documents n, then n + 1 int64 offsets within the shard, n int64 document ids and n
bytes that are 1 where the id is null. Shards hold rising ranges of doc_id; `index.json` lists
them with the number of ids before each (a prefix sum over the shards' totals).

Defined cases: null or empty text: only the end id; null doc_id: first in order; rows that repeat
a doc_id: each is a document, ordered by its text's hash; empty table: no shard; other columns are
not read. A task that runs again writes files under another name, and only the names that
successful tasks report get into the index.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, partitions, small_batches, table, tidy
from .tokens import encoder, vocabulary, with_end


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> dict:
    """Encode docs (doc_id, text) and write them in ascending doc_id order; the index is returned.

    One shuffle by ranges of doc_id (with the text's hash, so that one repeated id spreads over
    shards too); encoding runs behind it, so each text is encoded once and ids aren't shuffled.
    """

    @tidy
    def write(batches):
        enc = encoder(tokenizer)
        kind = "<u2" if enc.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, path = _opened(folder)
        store.create_dir(path, recursive=True)
        counts, keys, nulls, out = [], [], [], None
        for batch in batches:
            ids_of = batch.column(0)
            k = 0
            for ids, n in enc.encode_parts(batch.column(1)):
                ids, n = with_end(ids, n, end_id)
                out = out or store.open_output_stream(f"{path}/{name}.bin")
                out.write(ids.astype(kind).tobytes())
                counts.append(n)
                own = ids_of.slice(k, len(n))
                keys.append(own.fill_null(0).to_numpy())
                nulls.append(own.is_null().to_numpy(zero_copy_only=False))
                k += len(n)
        if out is None:
            return
        out.close()
        n = np.concatenate(counts)
        with store.open_output_stream(f"{path}/{name}.idx") as f:
            f.write(np.array([len(n)], "<i8").tobytes())
            f.write(np.concatenate([[0], np.cumsum(n)]).astype("<i8").tobytes())
            f.write(np.concatenate(keys).astype("<i8").tobytes())
            f.write(np.concatenate(nulls).astype("u1").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": [task.partitionId()], "name": [name], "docs": [len(n)], "ids": [int(n.sum())], "kind": [kind]},
            pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("kind", pa.string())]),
        )

    small_batches(docs.sparkSession)
    tie = F.xxhash64("text")
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(partitions(docs.sparkSession), "doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
    )
    # one row a shard: bounded by the number of partitions
    done = sorted(ordered.mapInArrow(write, "part int, name string, docs long, ids long, kind string").collect())
    bases = [0, *accumulate(r["ids"] for r in done)]
    index = {"shards": [{"name": r["name"], "docs": r["docs"], "ids": r["ids"], "base": b, "dtype": r["kind"]} for r, b in zip(done, bases, strict=False)], "ids": bases[-1], "end_id": end_id}
    store, path = _opened(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/index.json") as f:
        f.write(json.dumps(index).encode())
    return index


def read_shard(folder: str, shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids (mapped, not read, where the store is a file system), offsets, document ids, null marks."""
    store, path = _opened(folder)
    with store.open_input_file(f"{path}/{shard['name']}.idx") as f:
        blob = f.read()
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    offsets = np.frombuffer(blob, "<i8", n + 1, 8)
    keys = np.frombuffer(blob, "<i8", n, 8 * (n + 2))
    nulls = np.frombuffer(blob, "u1", n, 8 * (2 * n + 2)).astype(bool)
    if store.type_name == "local":
        ids = np.memmap(f"{path}/{shard['name']}.bin", shard["dtype"], "r")
    else:
        with store.open_input_file(f"{path}/{shard['name']}.bin") as f:
            ids = np.frombuffer(f.read(), shard["dtype"])
    return ids, offsets, keys, nulls


def read_token_files(spark: SparkSession, folder: str, index: dict, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    shards = index["shards"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    @tidy
    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                ids, offsets, keys, nulls = read_shard(folder, shards[k])
                for a in range(0, len(keys), 1024):
                    b = min(a + 1024, len(keys))
                    own = np.asarray(ids[offsets[a] : offsets[b]]).astype("<u4").tobytes()
                    at = (offsets[a : b + 1] - offsets[a]) * 4
                    blobs = [own[x:y] for x, y in zip(at, at[1:], strict=False)]
                    cols = [
                        pa.array(keys[a:b], pa.int64(), mask=nulls[a:b]),
                        pa.array(offsets[a:b] + shards[k]["base"]),
                        pa.array(np.diff(offsets[a : b + 1])),
                        pa.array([zlib.crc32(x) for x in blobs], pa.int64()),
                    ] + [pa.array(blobs, pa.binary())] * with_ids
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(read, schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "ids")
    index = write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return read_token_files(spark, folder, index)
