"""Which references to get, from where, and what to remember of it: the loop over sources as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import latest


def worklist(episodes: DataFrame, have: DataFrame, misses: DataFrame, key: list[str]) -> DataFrame:
    """Episodes to get (`todo`) and those whose crowd-sourced text a transcript could replace (`upgrade`).
    episodes: key, wanted; have: key, source, tried; misses: key."""
    rows = episodes.where("wanted").join(have.select(*key, "source", F.coalesce("tried", F.lit(False)).alias("tried")), key, "left")
    rows = rows.join(misses.select(*key).distinct().withColumn("_missed", F.lit(True)), key, "left")
    task = F.when(F.col("source").isNull() & F.col("_missed").isNull(), "todo").when((F.col("source") == "crowd") & ~F.col("tried"), "upgrade")
    return rows.select(*key, task.alias("task")).where("task is not null")


def broken(answers: DataFrame, group: str, order: str, after: int = 3) -> DataFrame:
    """Answers of a site (status: ok, missing, error) in order, with whether it was asked at all: once it has failed
    `after` times in a row it isn't asked again. A failure's place in its run comes from the number of
    answers before it that weren't failures."""
    w = Window.partitionBy(group).orderBy(order)
    run = F.sum((F.col("status") != "error").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = answers.withColumn("_run", run)
    place = F.row_number().over(Window.partitionBy(group, "_run", F.col("status") == "error").orderBy(order))
    rows = rows.withColumn("_trips", (F.col("status") == "error") & (place == after))
    since = F.max(F.col("_trips").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("asked", F.coalesce(since, F.lit(0)) == 0).drop("_run", "_trips")


def refreshed(work: DataFrame, site: DataFrame, crowd: DataFrame, key: list[str], quota: int) -> DataFrame:
    """What becomes of each piece of work: source, `outcome` and the text. site: key, status (ok, missing, error), text,
    usable; crowd: key, text, place. The site comes first, as it costs nothing; then the crowd's text, as
    far as the quota goes in order of place. An episode that the site didn't answer for is no real miss."""
    rows = work.join(site.select(*key, F.col("status"), F.col("text").alias("site_text"), F.col("usable")), key, "left")
    status = F.when(F.col("status") == "ok", F.when(F.col("usable"), "ok").otherwise("missing")).otherwise(F.coalesce("status", F.lit("missing")))
    rows = rows.withColumn("status", status)
    asks = rows.where("task = 'todo' and status != 'ok'").select(*key).join(crowd, key)
    # a quota is a small number: the first so many of all, found by a top-k, not by numbering all
    granted = asks.orderBy("place", *key).limit(quota).select(*key, F.lit(True).alias("granted"))
    allowed = asks.join(F.broadcast(granted), key, "left").withColumn("crowd_text", F.when(F.col("granted"), F.col("text")))
    rows = rows.join(allowed.select(*key, "crowd_text", F.lit(True).alias("offered")), key, "left")
    new = F.col("task") == "todo"
    ok, failed = F.col("status") == "ok", F.col("status") == "error"
    outcome = (
        F.when(ok, F.when(new, "fetched").otherwise("upgraded")).when(~new, F.when(failed, "deferred").otherwise("tried"))
        .when(F.col("crowd_text").isNotNull(), "fetched").when(failed | F.coalesce("offered", F.lit(False)), "deferred").otherwise("missed")
    )
    source = F.when(ok, "site").when(new & F.col("crowd_text").isNotNull(), "crowd")
    return rows.select(*key, "task", outcome.alias("outcome"), source.alias("source"), F.when(ok, F.col("site_text")).when(new, F.col("crowd_text")).alias("text"))


def overwritten(table: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """A table after writes by key: the last write of each key stands, and one with a null value takes the key out."""
    both = table.withColumn(order, F.lit(-1).cast(new.schema[order].dataType)).unionByName(new)
    return latest(both, key, order).where("value is not null").drop(order)


def seasons(episodes: DataFrame, have: DataFrame, blocked: DataFrame, key: str, today: Column) -> DataFrame:
    """Per season of a series the sorted numbers of episodes that are here, missing or not shown yet, those that only
    wait for something (blocked), and whether it is complete and whether it can be searched for as a whole:
    nothing of it is here and all has been shown. episodes: key, season, number, aired."""
    mark = lambda d, name: d.select(key, "season", "number").distinct().withColumn(name, F.lit(True))
    rows = episodes.join(mark(have, "_have"), [key, "season", "number"], "left").join(mark(blocked, "_blocked"), [key, "season", "number"], "left")
    shown = F.coalesce(F.col("aired") <= today, F.lit(True))
    state = F.when(F.col("_have"), "have").when(~shown, "unaired").when(F.col("_blocked"), "blocked").otherwise("missing")
    numbers = lambda s: F.sort_array(F.collect_set(F.when(F.col("state") == s, F.col("number")))).alias(s)
    out = rows.withColumn("state", state).groupBy(key, "season").agg(*map(numbers, ("have", "missing", "unaired", "blocked")))
    return out.withColumns({"complete": (F.size("missing") == 0) & (F.size("blocked") == 0) & (F.size("unaired") == 0), "searchable": (F.size("have") == 0) & (F.size("unaired") == 0) & (F.size("missing") > 0)})


def by_names(flagged: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Doubtful references after a look at the names of their files: an own title there verifies them, another's
    removes them, else they stay flagged; each is looked at once (`names_checked`)."""
    rows = flagged.where("not coalesce(names_checked, false)").join(verdicts, key, "left")
    return rows.select(key, F.when(F.col("verdict") == "match", "verified").when(F.col("verdict") == "other", "removed").otherwise("flagged").alias("verdict"), F.lit(True).alias("names_checked"))


def to_read_again(files: DataFrame) -> DataFrame:
    """Files (file, status, words, candidates) worth a model's look: nothing sure was found, there is text, and there
    are candidates to choose from, the first twelve."""
    few = F.slice(F.array_distinct("candidates"), 1, 12)
    return files.where(F.col("status").isin("LOW_CONFIDENCE", "NO_MATCH") & (F.col("words") > 0) & (F.size("candidates") > 0)).select("file", few.alias("candidates"))


def settings(default: DataFrame, file: DataFrame, env: DataFrame, secrets: tuple[str, ...] = ("key", "password", "token")) -> DataFrame:
    """name, value and origin of each setting: environment, then file, then default; a secret's value shows only that
    it is set."""
    named = lambda d, n: d.select("name", F.col("value").alias(n))
    rows = named(default, "d").join(named(file, "f"), "name", "left").join(named(env, "e"), "name", "left")
    value = F.coalesce("e", "f", "d")
    secret = F.exists(F.array(*map(F.lit, secrets)), lambda s: F.endswith(F.col("name"), s))
    origin = F.when(F.col("e").isNotNull(), "env").when(F.col("f").isNotNull(), "file").otherwise("default")
    return rows.select("name", F.when(secret & (F.coalesce(value, F.lit("")) != ""), "********").otherwise(value).alias("value"), origin.alias("origin"))
