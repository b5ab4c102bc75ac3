"""Removal of lines that many documents share, with DataFrame functions alone.

The lines of a text (its parts between \\n; null text: one empty line) are exploded with their
positions and normalised: ASCII white space stripped at both ends, A-Z lower-cased. Distinct
documents are counted per hash of a normalised line; a line that at least `min_docs` documents hold
goes from all of them, and what is left is put together again by position.

Only hashes are counted and joined, 96 bits a line; the count of distinct documents is taken in two
steps, by line and document and then by line, so that no task holds all documents of one line. Which
lines are frequent is written as a table, from whose size Spark decides whether to broadcast it; a
text moves once, to meet the positions that it loses, and stays in its row.

Defined cases: null text: one empty line; null doc_id: as any other value; rows that repeat doc_id
and text count as one document, rows that share doc_id alone as several; lines of fewer than
`min_chars` code points after stripping always stay; a text that loses all its lines becomes empty;
no rows: no rows. Other columns, whatever their names, are carried along by `deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

_WHITE = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rows(docs: DataFrame, carried: list[str]) -> DataFrame:
    """doc (the carried columns), doc_id, text (never null) and its hash h of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"), F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, h, pos, line and check (two hashes) of the lines that may go."""
    exploded = rows.select("doc_id", "h", F.posexplode(F.split(F.translate("text", _UPPER, _LOWER), "\n")).alias("pos", "raw"))
    keyed = exploded.select("doc_id", "h", "pos", F.btrim("raw", F.lit(_WHITE)).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "h", "pos", F.xxhash64("key").alias("line"), F.hash("key").alias("check"))


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """line, check and n_docs of the lines that at least min_docs documents hold."""
    lines = _lines(_rows(docs, []), min_chars)
    return lines.groupBy("line", "check").agg(F.count_distinct(F.struct("doc_id", "h")).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _met(docs: DataFrame, carried: list[str], min_docs: int, min_chars: int) -> tuple[DataFrame, Column, Column]:
    """Rows with `dropped` (the positions of lines that go; null: none), the lines of text, and the text that is left."""
    frequent = stored(frequent_lines(docs, min_docs, min_chars).select("line", "check"), "lines")
    hits = _lines(_rows(docs, []), min_chars).join(frequent, ["line", "check"], "left_semi")
    lost = hits.groupBy(F.col("doc_id").alias("of_id"), F.col("h").alias("of_h")).agg(F.collect_set("pos").alias("dropped"))
    met = _rows(docs, carried).join(lost, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")), "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return met, lines, F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left)


def deduplicated(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """All rows with all their columns, and without the frequent lines in text."""
    met, _, left = _met(docs, docs.columns, min_docs, min_chars)
    text = F.when(F.col("dropped").isNull(), F.col("doc.text")).otherwise(left)
    return met.select(*[(text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    met, lines, left = _met(table(spark, sf_dir, "documents"), [], 10, 1)
    return met.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(left, 256).alias("kept_sha256"),
    )


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT r, doc_id, t, i, ls[i] AS x FROM s, unnest(range(1, len(ls) + 1)) AS u(i)),
k AS (SELECT *, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT {'d': doc_id, 't': t}) >= 10),
f AS (SELECT k.*, o.key IS NOT NULL AS gone FROM k LEFT JOIN often o ON o.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r
"""
