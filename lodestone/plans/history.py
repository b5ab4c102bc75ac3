"""Names through a log of operations: what a file was called before, and scans that follow files back or on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored

#: Operations in one part of a log.
ROWS = 300_000


def names_before(operations: DataFrame) -> DataFrame:
    """now and before: where each file that the log has touched is in the end, and where it was at the start.

    operations: (ordinal, op, src, dst) with unique ordinals. A file that a `cut`, `join` or `create` has made has no name
    before (null). Each operation follows the last one before it that put a file at its source; these
    links are followed in doubled steps, so a chain of n moves takes log2(n) rounds of joins, through
    temporary names and swaps alike.
    """
    return _names_before(operations)[0]


def _names_before(operations: DataFrame) -> tuple[DataFrame, int]:
    """`names_before`, and in how many parts it lies."""
    moves = stored(operations.select("ordinal", "op", "src", "dst"), "moves")
    parts = max(int(moves.sparkSession.conf.get("spark.sql.shuffle.partitions")), moves.count() // ROWS)
    made = ~(F.col("op") == "move")
    arrives = moves.select(F.col("dst").alias("path"), "ordinal", F.lit(1).alias("_in"), made.alias("made"))
    leaves = moves.where("op = 'move'").select(F.col("src").alias("path"), "ordinal", F.lit(0).alias("_in"), F.lit(False).alias("made"))
    order = Window.partitionBy("path").orderBy("ordinal", "_in")
    # several pieces of a join arrive at one place and none leaves between: the last one stands for all
    came = F.last(F.when(F.col("_in") == 1, F.struct("ordinal", "made")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    events = arrives.unionByName(leaves).repartition(parts, "path").withColumns({"came": came, "latest": F.lead("ordinal").over(order).isNull()})
    events = stored(events, "events")
    links = events.where("_in = 0").select("ordinal", F.col("path").alias("src"), F.col("came.ordinal").alias("up"), F.coalesce("came.made", F.lit(False)).alias("made"))
    # origin: the name at the start of the file that an operation moved; made files have none
    done = links.select("ordinal", F.when(F.col("up").isNull(), F.col("src")).alias("origin"), F.when(~F.col("made"), F.col("up")).alias("up"))
    while not done.where("up is not null").isEmpty():
        ahead = done.select(F.col("ordinal").alias("up"), F.col("origin").alias("_origin"), F.col("up").alias("_up"))
        open_ = done.where("up is not null").repartition(parts, "up").join(ahead.repartition(parts, "up"), "up", "left")
        done = stored(done.where("up is null").unionByName(open_.select("ordinal", F.coalesce("origin", "_origin").alias("origin"), F.col("_up").alias("up"))), "names")
    last = events.where("latest and _in = 1").select(F.col("path").alias("now"), "ordinal", "made").repartition(parts, "ordinal")
    met = last.join(done.select("ordinal", "origin").repartition(parts, "ordinal"), "ordinal", "left")
    return met.select("now", F.when(~F.col("made"), F.col("origin")).alias("before")), parts


def restored(rows: DataFrame, operations: DataFrame, key: str = "file") -> DataFrame:
    """Rows of a scan under the names that their files had before the operations; what these had made is left out."""
    names, parts = _names_before(operations)
    back = names.withColumnsRenamed({"now": "_now", "before": "_before"}).withColumn("_touched", F.lit(True)).repartition(parts, "_now")
    met = rows.repartition(parts, key).join(back, F.col(key) == F.col("_now"), "left")
    name = F.when(F.col("_touched"), F.col("_before")).otherwise(F.col(key))
    return met.withColumn(key, name).where(F.col(key).isNotNull()).select(*rows.columns)


def followed(rows: DataFrame, operations: DataFrame, key: str = "file") -> DataFrame:
    """Rows of a scan under the names that their files have after the operations."""
    names, parts = _names_before(operations)
    on = names.where("before is not null").withColumnsRenamed({"now": "_now", "before": "_before"}).repartition(parts, "_before")
    met = rows.repartition(parts, key).join(on, F.col(key) == F.col("_before"), "left")
    return met.withColumn(key, F.coalesce("_now", key)).select(*rows.columns)


def with_new_files(rows: DataFrame, listed: DataFrame, key: str = "file") -> DataFrame:
    """The last scan's rows of files that are still there, and a row for each file listed since, with what its listing
    says and nothing else. listed: key, and columns of rows that a name alone gives; repeated names count once."""
    there = listed.dropDuplicates([key])
    stays = rows.join(there.select(key), key, "left_semi").select(*rows.columns)
    new = there.join(rows.select(key), key, "left_anti")
    return stays.unionByName(new.select(*[F.col(c) if c in listed.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]))


def page_pattern(mapped: DataFrame, group: str, page: str, title: str, order: str) -> DataFrame:
    """group, pattern and n: the page name that most mapped pages of a group follow, with `{title}` where the title
    first stands; of equally frequent ones the one that was mapped first. Pages without their title, and empty titles, don't count."""
    at = F.instr(F.col(page), F.col(title))
    pattern = F.concat(F.left(page, at - 1), F.lit("{title}"), F.substring(F.col(page), at + F.length(title), F.length(page)))
    rows = mapped.where((F.length(title) > 0) & (at > 0)).select(group, pattern.alias("pattern"), order)
    counted = rows.groupBy(group, "pattern").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counted.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), "_first", "pattern")).alias("x")).select(group, "x.pattern", (-F.col("x.n")).alias("n"))
