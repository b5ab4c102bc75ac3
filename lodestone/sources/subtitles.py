"""Timed text: parsing of subtitle formats, listing and choice of files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_cue, timestamp_seconds

VIDEO = ("mkv", "mp4", "avi", "m4v", "mov", "wmv", "ts", "mpg", "mpeg", "webm", "flv")
SUBTITLES = ("srt", "vtt", "ass", "ssa")
SMALL_SAMPLE = 150 * 1024 * 1024
# Folders whose videos are no episodes.
EXTRAS = ("extras", "featurettes", "behind the scenes")
ASS_FIELDS = ("layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of files, decoded as UTF-8 (with or without mark), UTF-16, Windows or Latin text, whichever fits first."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str:
            for name in ("utf-8-sig", "utf-16", "cp1252"):
                try:
                    return raw.decode(name)
                except UnicodeError:
                    continue
            return raw.decode("latin-1")

        return content.map(one)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", decoded("content").alias("text"))


def list_videos(files: DataFrame, root: Column, backup: str = ".backup") -> DataFrame:
    """files (path, size) below a series' folder `root` -> its videos: nothing hidden, nothing in the
    backup folder right below the root, no extras, no small samples."""
    parts = F.split(F.substring("path", F.length(root) + 2, F.length("path")), "/")
    name = F.lower(F.element_at(parts, -1))
    ext = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    hidden = F.exists(parts, lambda x: x.startswith(".")) | (F.get(parts, F.lit(0)) == backup)
    small = name.contains("sample") & (F.col("size") < SMALL_SAMPLE)
    return files.where(ext.isin(*VIDEO) & ~hidden & ~F.exists(parts, lambda x: F.lower(x).isin(*EXTRAS)) & ~small)


def subtitle_format(ext: Column, raw: Column) -> Column:
    return F.when(F.lower(ext).isin("ass", "ssa") | F.left(raw, F.lit(200)).contains("[Script Info]"), "ass").otherwise("srt")


def parse_srt(files: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, start, end and text of each cue; blocks are parted by blank lines, the first `-->` line has the times."""
    blocks = files.select(key, F.explode(F.split(F.replace(raw, F.lit("\r"), F.lit("")), r"\n\s*\n")).alias("b"))
    timed = r"(?s)^(?:(?!-->).)*?(?:^|\n)?([^\n]*?)-->([^\n]*)(?:\n(.*))?$"
    part = lambda k: F.regexp_extract("b", timed, k)
    body = F.array_join(F.filter(F.split(part(3), "\n"), lambda x: F.trim(x) != ""), " ")
    cues = blocks.where(F.col("b").contains("-->")).select(key, timestamp_seconds(part(1)).alias("start"), timestamp_seconds(part(2)).alias("end"), clean_cue(body).alias("text"))
    return cues.where("text != ''")


def parse_ass(files: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, start, end and text of each dialogue line, its fields in the order that the first Format line with a text states."""
    lines = F.split(F.col(raw), r"\r?\n")
    formats = F.filter(lines, lambda x: x.startswith("Format:") & x.contains("Text"))
    named = F.transform(F.split(F.substring(F.get(formats, F.lit(0)), F.lit(8), F.length(F.get(formats, F.lit(0)))), ","), lambda x: F.lower(F.trim(x)))
    fields = F.when(F.size(formats) > 0, named).otherwise(F.array(*map(F.lit, ASS_FIELDS)))
    said = F.filter(lines, lambda x: x.startswith("Dialogue:"))
    rows = files.select(key, fields.alias("f"), F.explode(said).alias("d"))
    rows = rows.select(key, "f", F.expr("split(substring(d, 10), ',', size(f))").alias("p")).where("size(p) = size(f)")
    pick = lambda name: F.element_at("p", F.array_position("f", name).cast("int"))

    def seconds(c: Column) -> Column:
        part = lambda k: F.regexp_extract(c, r"^\s*([0-9]+):([0-9]+):([0-9]+)\.([0-9]+)", k)
        return F.when(part(1) != "", (part(1).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long")) + part(4).cast("long") / 100)

    cues = rows.select(key, seconds(pick("start")).alias("start"), seconds(pick("end")).alias("end"), clean_cue(pick("text")).alias("text"))
    return cues.where("start is not null and end is not null and text != ''")


def sidecar_choice(files: DataFrame, languages: tuple[str, ...] = ("en", "eng", "english")) -> DataFrame:
    """files (video, stem, path) -> the best subtitle file beside each video: tagged with the language,
    then bare, then other; forced ones never. Ties: the first by path."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    tags = F.split(F.regexp_replace(F.substring(name, F.length("stem") + 1, F.length(name)), r"\.[a-z0-9]+$", ""), r"[._ -]+")
    tags = F.filter(tags, lambda x: x != "")
    rank = F.when(F.arrays_overlap(tags, F.array(*map(F.lit, languages))), 2).when(F.size(tags) == 0, 1).otherwise(0)
    fits = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1).isin(*SUBTITLES) & F.startswith(name, F.lower("stem")) & ~F.array_contains(tags, "forced")
    return files.where(fits).groupBy("video").agg(F.max_by("path", F.struct(rank, F.expr("-ascii(path)"))).alias("any"), F.max(rank).alias("rank"), F.min_by("path", F.struct(-rank, F.col("path"))).alias("path")).select("video", "rank", "path")
