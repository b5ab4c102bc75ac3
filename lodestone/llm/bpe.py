"""BPE encoding and decoding of long texts by tree concatenation.

A text of more than `leaf_chars` characters is halved until its leaves are short enough. Leaves
are encoded apart, in parallel; then neighbours are joined, two by two up the tree. At each join
the ids near it are encoded again, as a window of text around the join that starts and ends with
a token of either side; the window grows until its first and last `agree` tokens are the very
tokens, at the very places, that the two sides have there. From then on both sides stand.
A window that has reached both ends is simply the encoding of the whole.

Defined cases: null text: like empty (no ids, empty decoded text); repeated rows: each is a row of
the result; null doc_id: kept; no rows: no rows; other columns are not read. Shorter texts are
encoded in their own batch, without a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, partitions, small_batches, table, tidy
from .tokens import Encoder, byte_alphabet, encoder, runs, vocabulary

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """An encoder with what decoding and joining need: the bytes of each token."""

    def __init__(self, path: str):
        self.enc: Encoder = encoder(path)
        tok = self.enc.tok
        back = {c: b for b, c in enumerate(byte_alphabet())}
        special = set(self.enc.specials)
        size = tok.get_vocab_size()
        names = [tok.id_to_token(i) or "" for i in range(size)]
        blobs = [s.encode() if s in special else bytes(back[c] for c in s) for s in names]
        self.lengths = np.array([len(b) for b in blobs], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(blobs), np.uint8)
        self.shown = [str(i) for i in range(size)]

    def raw(self, ids: np.ndarray) -> bytes:
        return self.bytes[runs(self.starts[ids], self.lengths[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.enc.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def join(self, left: np.ndarray, right: np.ndarray, agree: int = 4, window: int = 16) -> np.ndarray:
        """The ids of the two texts' concatenation, from the ids of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        while True:
            i, j = max(0, len(left) - window), min(len(right), window)
            # begin and end the window where a character does
            while i and self.bytes[self.starts[left[i]]] & 0xC0 == 0x80:
                i -= 1
            while j < len(right) and self.bytes[self.starts[right[j]]] & 0xC0 == 0x80:
                j += 1
            got = self.plain(self.raw(np.concatenate([left[i:], right[:j]])).decode())
            head, tail = min(agree, len(left) - i), min(agree, j)
            if (i == 0 or self._same(got[:head], left[i : i + head])) and (j == len(right) or self._same(got[len(got) - tail :], right[j - tail : j])) and (i == 0 or j == len(right) or len(got) >= head + tail):
                return np.concatenate([left[:i], got, right[j:]])
            window *= 2

    @staticmethod
    def _same(a: np.ndarray, b: np.ndarray) -> bool:
        return len(a) == len(b) and bool((a == b).all())

    def tree(self, leaves: list[np.ndarray]) -> np.ndarray:
        """Join neighbours, level by level."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0] if leaves else np.empty(0, np.uint32)

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        listed = ",".join(map(self.shown.__getitem__, ids.tolist()))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


_codecs: dict[str, Codec] = {}
CACHES.append(_codecs)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, tokenizer: str, leaf_chars: int = 1 << 15) -> DataFrame:
    """doc_id and ids (little-endian uint32) of each row of docs (doc_id, text)."""
    return _encode(docs, tokenizer, leaf_chars, digest=False)


def encode_decode_digests(docs: DataFrame, tokenizer: str, leaf_chars: int = 1 << 15) -> DataFrame:
    """doc_id, number of ids, and the digests of the ids and of the text decoded from them."""
    return _encode(docs, tokenizer, leaf_chars, digest=True)


def _encode(docs: DataFrame, tokenizer: str, leaf_chars: int, digest: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids"]
    schema = RESULT if digest else "doc_id long, ids binary"

    def rows(c: Codec, keys: pa.Array, texts: list[np.ndarray]) -> pa.RecordBatch:
        made = [c.digests(x) if digest else (x.astype("<u4").tobytes(),) for x in texts]
        kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.binary()]
        return pa.RecordBatch.from_arrays([keys.cast(pa.int64()), *(pa.array([m[k] for m in made], t) for k, t in enumerate(kinds))], names=names)

    @tidy
    def short(batches):
        c = codec(tokenizer)
        for batch in batches:
            k = 0
            for ids, n in c.enc.encode_parts(batch.column(1)):
                ends = np.cumsum(n)
                yield rows(c, batch.column(0).slice(k, len(n)), [ids[e - m : e] for e, m in zip(ends, n, strict=True)])
                k += len(n)

    @tidy
    def leaf(batches):
        c = codec(tokenizer)
        for batch in batches:
            k = 0
            for ids, n in c.enc.encode_parts(batch.column(3)):
                at = np.concatenate([[0], np.cumsum(n)]) * 4
                blob = ids.astype("<u4").tobytes()
                cols = [x.slice(k, len(n)) for x in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([blob[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["row", "doc_id", "leaf", "ids"])
                k += len(n)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        c = codec(tokenizer)
        leaves = [np.frombuffer(x, "<u4") for x in group.sort_values("leaf")["ids"]]
        one = rows(c, pa.array([None if pd.isna(group["doc_id"].iloc[0]) else int(group["doc_id"].iloc[0])], pa.int64()), [c.tree(leaves)])
        return one.to_pandas().astype({"doc_id": "Int64"})

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = F.length("text")
    direct = docs.where(F.coalesce(size, F.lit(0)) <= leaf_chars).mapInArrow(short, schema)
    # halves of halves: as many leaves of equal length as the smallest power of two that is enough
    leaves = F.pow(F.lit(2.0), F.ceil(F.log2(size / F.lit(float(leaf_chars))))).cast("int")
    step = F.ceil(size / leaves).cast("int")
    cut = (
        docs.where(size > leaf_chars)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", leaves.alias("leaves"), step.alias("step"))
        .select("row", "doc_id", F.explode(F.expr("transform(sequence(0, leaves - 1), k -> struct(k as leaf, substring(text, k * step + 1, step) as part))")).alias("x"))
        .select("row", "doc_id", "x.leaf", "x.part")
        .repartition(partitions(docs.sparkSession), "row", "leaf")
    )
    tree = cut.mapInArrow(leaf, "row long, doc_id long, leaf int, ids binary").groupBy("row").applyInPandas(joined, schema)
    return direct.unionByName(tree)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
