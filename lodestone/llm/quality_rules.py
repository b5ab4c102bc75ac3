"""Quality rules with DataFrame functions alone: word and line statistics and cross-document line frequency.

Statistics of a text (null: empty) use words, the runs without ASCII white space. They are computed
within the row: hashes of the 5-word windows are sorted with their places, equal neighbours mark
windows that occur more than once, and marked places are added up without counting a word twice.

Cross-document lines: lines are normalised (white space, A-Z lower-cased) and hashed together with
their host (`source`); a line of a host is too frequent if more than `min_docs` documents and more
than `max_share` of the host's documents hold it. Such lines are removed; a document that so loses
more than `max_removed` of its words is depleted and rejected.

Only hashes of distinct lines are shuffled. Defined cases: null doc_id: a document of its own;
null source: one host; rows that repeat doc_id and text count as one document and share a result;
text without words: all counts 0, base_failed; no rows: no rows; other columns are carried along
by `filtered` and not read by `scores`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table

_WHITE = " \t\n\v\f\r"
_SQL_WHITE = r"' \t\n\u000B\f\r'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 5


def let(name: str, value: str, body: str) -> str:
    """SQL for body in which name stands for value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeat_words(words: str) -> str:
    """SQL for the number of words in 5-word windows that occur twice or more in the array `words`."""
    window = ", ".join(f"get(hw, i + {k})" for k in range(WINDOW))
    hashes = f"transform(sequence(0, size(hw) - {WINDOW}), i -> xxhash64({window}))"
    ordered = "array_sort(transform(h, (x, i) -> struct(x, i)))"
    marked = "array_sort(filter(transform(s, (e, k) -> if(e.x = get(s, k - 1).x or e.x = get(s, k + 1).x, e.i, -1)), v -> v >= 0))"
    covered = f"aggregate(transform(p, (v, k) -> least({WINDOW}, coalesce(get(p, k + 1) - v, {WINDOW}))), 0, (a, b) -> a + b)"
    slow = let("s", ordered, let("p", marked, covered))
    some = let("h", hashes, f"if(size(array_distinct(h)) = size(h), 0, {slow})")
    return f"if(size({words}) < {WINDOW}, 0, {let('hw', f'transform({words}, x -> xxhash64(x))', some)})"


def statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text that isn't null."""
    size = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _WHITE, "") != "")
    return {
        "words": F.filter(F.split(text, SPACE), lambda x: x != ""),
        "word_chars": F.length(F.translate(text, _WHITE, "")).cast("long"),
        "n_symbols": (size - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "lines": lines,
    }


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.col("source").alias("host"), text.alias("text"), F.xxhash64("doc_id", "text").alias("k"))


def _lines(docs: DataFrame) -> DataFrame:
    """k, host, line (a hash) and words (in all its occurrences) of each document's distinct lines."""
    raw = F.split(F.translate("text", _UPPER, _LOWER), "\n")
    norm = F.filter(F.transform(raw, lambda x: F.trim(F.regexp_replace(x, SPACE, " "))), lambda x: x != "")
    one = F.transform(norm, lambda x: F.struct(F.xxhash64(F.col("host"), F.col("host").isNull(), x).alias("line"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")))
    parts = docs.select("k", "host", F.explode(one).alias("x"))
    # a document's lines stay in its task: the first grouping needs no more than its own hash map
    return parts.select("k", "host", "x.line", "x.words")


def frequent_lines(docs: DataFrame, min_docs: int = 10, max_share: float = 0.05) -> DataFrame:
    """The hashes of lines that too many documents of a host hold."""
    keyed = _keyed(docs)
    held = _lines(keyed).groupBy("line").agg(F.count_distinct("k").alias("n"), F.first("host").alias("host")).where(F.col("n") > min_docs)
    hosts = keyed.select("host", "k").groupBy("host").agg(F.count_distinct("k").alias("docs"))
    return held.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).where(F.col("n") > max_share * F.col("docs")).select("line")


def scores(docs: DataFrame, min_docs: int = 10, max_share: float = 0.05, max_removed: float = 0.7, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """The statistics of each row, base_failed, the words in frequent lines (removed_words) and kept."""
    keyed = _keyed(docs)
    s = statistics(F.col("text"))
    base = keyed.select("doc_id", "k", s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), F.struct(s["words"].alias("w"), s["lines"].alias("l")).alias("x"))
    counted = base.select(
        "doc_id", "k", "word_chars", "n_symbols",
        F.expr(let("y", "x", f"struct(size(y.w) as n_words, size(y.l) - size(array_distinct(y.l)) as n_dup_lines, {repeat_words('y.w')} as n_repeat_words)")).alias("z"),
    ).select("doc_id", "k", F.col("z.n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("z.n_dup_lines").cast("long").alias("n_dup_lines"), F.col("z.n_repeat_words").cast("long").alias("n_repeat_words"))
    removed = _lines(keyed).join(frequent_lines(docs, min_docs, max_share), "line", "left_semi").groupBy("k").agg(F.sum("words").alias("removed_words"), F.count("*").alias("c"))
    rows = keyed.groupBy("k").agg(F.count("*").alias("copies"))
    # rows that repeat doc_id and text have each added their lines
    removed = removed.join(rows, "k").select("k", F.expr("removed_words div copies").alias("removed_words"))
    out = counted.join(removed, "k", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = F.col("removed_words") > max_removed * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def filtered(docs: DataFrame, **limits) -> DataFrame:
    """The rows that are kept, with all their columns, and without the frequent lines in text."""
    verdict = scores(docs, **limits).select("k", "kept", "removed_words").dropDuplicates(["k"])
    names = docs.columns
    lined = {x: limits[x] for x in ("min_docs", "max_share") if x in limits}
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.xxhash64("doc_id", "text").alias("k")).join(verdict.where("kept").select("k", "removed_words"), "k")
    frequent = frequent_lines(docs, **lined)
    # which of its lines a document loses: only documents with any have a row here
    lost = _lines(_keyed(docs)).join(frequent, "line", "left_semi").groupBy("k").agg(F.collect_set("line").alias("lost"))
    out = held.join(lost, "k", "left")
    norm = lambda x: F.trim(F.regexp_replace(F.translate(x, _UPPER, _LOWER), SPACE, " "))
    host = F.col("doc.source")
    left = F.array_join(F.filter(F.split(F.col("doc.text"), "\n"), lambda x: ~F.array_contains(F.col("lost"), F.xxhash64(host, host.isNull(), norm(x)))), "\n")
    text = F.when(F.col("lost").isNull(), F.col("doc.text")).otherwise(left)
    return out.select(*[(text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in names])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
g AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM p),
twice AS (SELECT r, unnest(list(i)) AS i FROM g GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, range(5) t(o) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d),
f AS (SELECT r, x FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM f GROUP BY r),
nl AS (SELECT r, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS x,
  len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM f),
h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
often AS (SELECT d.source, x FROM nl JOIN d USING (r) JOIN h ON h.source IS NOT DISTINCT FROM d.source
  GROUP BY d.source, x, docs HAVING count(DISTINCT r) > 10 AND count(DISTINCT r) > 0.05 * docs),
gone AS (SELECT r, sum(n) AS n FROM nl JOIN d USING (r) JOIN often o ON o.x = nl.x AND o.source IS NOT DISTINCT FROM d.source GROUP BY r),
s AS (SELECT doc_id, len(w) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed_words > 0.7 * n_words) AS kept,
  removed_words::BIGINT AS removed_words FROM s
"""
