"""What other systems say of files, as columns: stream lists, listings, releases and messages in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_title
from ..operators.rules import IMAGE_CODECS, TEXT_CODECS, language_fits

PROBE = (
    "format struct<duration:string>, streams array<struct<index:int,codec_type:string,codec_name:string,start_time:string,duration:string,"
    "disposition:struct<forced:int,attached_pic:int>,tags:map<string,string>>>"
)
VIDEO = ("mkv", "mp4", "avi", "m4v", "mov", "wmv", "ts", "mpg", "mpeg", "webm", "flv")


def probed(files: DataFrame, raw: str = "raw") -> DataFrame:
    """With the columns of a probe's JSON; one that can't be read has no streams and the length 0."""
    p = F.from_json(raw, PROBE)
    return files.withColumn("probe", p).withColumn("duration", F.coalesce(p["format"]["duration"].try_cast("double"), F.lit(0.0)))


def seconds_of_tag(c: Column) -> Column:
    """`hh:mm:ss.fraction` in seconds."""
    part = lambda k: F.regexp_extract(c, r"^(\d+):(\d+):([\d.]+)", k)
    return F.when(part(1) != "", part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).try_cast("double"))


def streams(files: DataFrame, key: str) -> DataFrame:
    """key, type, codec, start and length of each video and audio stream of probed files, attached pictures
    left out. Where a stream has no length, its tag may have one."""
    rows = files.select(key, F.explode("probe.streams").alias("s")).where("s.codec_type in ('video', 'audio') and coalesce(s.disposition.attached_pic, 0) = 0")
    tag = F.coalesce(F.try_element_at("s.tags", F.lit("DURATION")), F.try_element_at("s.tags", F.lit("DURATION-eng")))
    return rows.select(key, F.col("s.codec_type").alias("type"), F.col("s.codec_name").alias("codec"), F.col("s.start_time").try_cast("double").alias("start"), F.coalesce(F.col("s.duration").try_cast("double"), seconds_of_tag(tag)).alias("length"))


def subtitle_stream(files: DataFrame, key: str, language: str) -> DataFrame:
    """key and index of the text subtitles to use: in the language, not forced, not for the deaf, the first of
    these. None where no stream is in the language or says nothing of its own."""
    title = F.lower(F.coalesce(F.try_element_at("s.tags", F.lit("title")), F.lit("")))
    fits = language_fits(F.try_element_at("s.tags", F.lit("language")), language)
    rank = F.struct(fits.alias("fits"), ((F.coalesce("s.disposition.forced", F.lit(0)) == 0) & ~title.contains("forced")).alias("free"), (~title.contains("sdh")).alias("plain"), (-F.col("s.index")).alias("i"))
    rows = files.select(key, F.explode("probe.streams").alias("s")).where((F.col("s.codec_type") == "subtitle") & F.col("s.codec_name").isin(*TEXT_CODECS))
    best = rows.groupBy(key).agg(F.max(rank).alias("r"))
    return best.where("r.fits").select(key, (-F.col("r.i")).alias("index"))


def has_image_subtitles(probe: Column) -> Column:
    return F.exists(probe["streams"], lambda s: s["codec_name"].isin(*IMAGE_CODECS))


def dialogue(files: DataFrame, key: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """key, source and text: of each file the text of the first source that has one, else `none`. The sources
    (key, text) come in order; one that isn't to be used is left out by the caller."""
    ranked = None
    for k, (name, rows) in enumerate(sources):
        own = rows.where(F.coalesce(F.trim("text"), F.lit("")) != "").select(key, F.struct(F.lit(k).alias("rank"), F.lit(name).alias("source"), "text").alias("x"))
        ranked = own if ranked is None else ranked.unionByName(own)
    best = ranked.groupBy(key).agg(F.min("x").alias("x"))
    return files.select(key).join(best, key, "left").select(key, F.coalesce("x.source", F.lit("none")).alias("source"), "x.text")


def pages_found(finds: list[tuple[str, DataFrame]], enough: int = 20) -> DataFrame:
    """site, title and how it was found: the union of several ways in order, each page under the first that
    found it. Ways after one that found `enough` pages of a site aren't taken there."""
    rows = None
    for k, (name, pages) in enumerate(finds):
        own = pages.select("site", "title", F.struct(F.lit(k).alias("k"), F.lit(name).alias("how")).alias("x"))
        rows = own if rows is None else rows.unionByName(own)
    one = rows.groupBy("site", "title").agg(F.min("x").alias("x"))
    last = rows.groupBy("site", "x").agg(F.count_distinct("title").alias("n")).where(F.col("n") >= enough).groupBy("site").agg(F.min("x.k").alias("last"))
    return one.join(last, "site", "left").where("last is null or x.k <= last").select("site", "title", "x.how")


EVENT = "eventType string, series struct<id:long>, episodeFile struct<relativePath:string>"


def import_events(messages: DataFrame, known: DataFrame, raw: str = "raw", carried: tuple[str, ...] = ()) -> DataFrame:
    """series, rel and why a message is ignored (null: it isn't), and carried columns: only downloads of known series with a
    file count. Works on streams, with `known` (series) as a table."""
    m = F.from_json(raw, EVENT)
    rows = messages.select(*carried, m.alias("m")).select(*carried, F.col("m.series.id").alias("series"), F.col("m.episodeFile.relativePath").alias("rel"), F.coalesce("m.eventType", F.lit("unknown")).alias("event"))
    rows = rows.join(known.select("series", F.lit(True).alias("_known")), "series", "left")
    why = F.when(F.col("event") == "Test", "test").when(F.col("event") != "Download", F.concat("event", F.lit(" event"))).when(F.col("_known").isNull(), "unknown series").when(F.coalesce("rel", F.lit("")) == "", "no file")
    return rows.select("series", "rel", why.alias("ignored"), *carried)


def pasted_reference(raw: Column, least_chars: int = 200, least_words: int = 50) -> Column:
    """Format and text of a pasted reference: `subtitles` by their times, else `transcript`, whose speakers
    start lines of their own even where the paste has lost its line ends; null if it is too short."""
    timed = raw.rlike(r"\d{1,2}:\d{2}:\d{2}[,.]\d{1,3}\s*-->")
    lines = F.size(F.split(raw, "\n"))
    run_on = F.regexp_replace(raw, r"(?<=[.!?…\"”])\s+(?=[A-Z][A-Za-z.'’ ]{0,30}: )", "\n")
    text = F.when(timed | (lines > 5), raw).otherwise(run_on)
    words = F.size(F.filter(F.split(raw, r"\s+"), lambda w: w != ""))
    return F.when((F.length(raw) >= least_chars) & (words >= least_words), F.struct(F.when(timed, "subtitles").otherwise("transcript").alias("format"), text.alias("text")))


def bare_name(folder: Column) -> Column:
    """A folder's name without what stands in brackets, its words between single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(folder, r"[\[{(][^\]})]*[\]})]", " "), "._", "  "), r"\s+", " "))


def folder_query(folder: Column) -> tuple[Column, Column, Column]:
    """The name, year and catalogue number that a folder's name has: `Name (2010) {id-123}`."""
    number = F.regexp_extract(folder, r"(?i)[\[{(][a-z]*id[-= ](\d+)[\]})]", 1).try_cast("long")
    year = F.regexp_extract(folder, r"\(((?:19|20)\d{2})\)", 1)
    bare = bare_name(folder)
    named = F.trim(F.regexp_replace(bare, r"\s*\b(19|20)\d{2}\b\s*$", ""))
    return F.when(named != "", named).otherwise(bare), year, number


def resolve_folders(folders: DataFrame, results: DataFrame) -> DataFrame:
    """folders (folder) and search results (folder, id, name, year, place) -> the best result of each folder, its
    points (catalogue number 100, title 20, year 10) and whether it is sure: by number, or by title with
    more points than the next. Where the year stands in brackets, a number like a year before it may belong to the
    title (`Show 1984 (2001)`): the title fits with it as well as without it."""
    name, year, number = folder_query(F.col("folder"))
    whole = F.when(year != "", bare_name(F.col("folder"))).otherwise(name)
    rows = results.join(folders.select("folder", norm_title(name).alias("_n"), norm_title(whole).alias("_w"), year.alias("_y"), number.alias("_i")), "folder").withColumn("_name", norm_title(F.col("name")))
    points = F.when(F.col("id") == F.col("_i"), 100).otherwise(0) + F.when((F.col("_name") == F.col("_n")) | (F.col("_name") == F.col("_w")), 20).otherwise(0) + F.when((F.col("_y") != "") & (F.col("year") == F.col("_y")), 10).otherwise(0)
    rows = rows.select("folder", "id", "place", points.alias("points"))
    best = rows.groupBy("folder").agg(F.max_by("id", F.struct("points", -F.col("place"))).alias("id"), F.max("points").alias("points"), F.count("*").alias("n"), F.count_if(F.lit(True)).alias("_all"))
    tied = rows.join(best.select("folder", F.col("points").alias("_p")), "folder").where("points = _p").groupBy("folder").agg(F.count("*").alias("tied"))
    return best.join(tied, "folder").select("folder", "id", "points", ((F.col("points") >= 100) | ((F.col("points") >= 20) & (F.col("tied") == 1))).alias("sure"))


SEASON_FOLDER = r"(?i)^(season|series|s)\s*\d+$|^specials$"


def show_folders(files: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """Folders up to `depth` levels below the first one under `root` that look like a show: they hold videos or
    season folders. Nothing below a show is one; hidden folders are passed over. files has `path`."""
    parts = F.split(F.substring("path", len(root) + 2, 1 << 30), "/")
    name = F.element_at("p", -1)
    rows = files.where(F.col("path").startswith(root + "/")).select(parts.alias("p")).where("size(p) > 1")
    rows = rows.where(~F.exists(F.slice("p", F.lit(1), F.size("p") - 1), lambda x: x.rlike(r"^[.@#]")))
    video = F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1).isin(*VIDEO)
    # the folder that holds the file, if it is a video; every folder above a season folder
    here = F.when(video, F.array(F.size("p") - 1)).otherwise(F.array().cast("array<int>"))
    above = F.filter(F.sequence(F.lit(1), F.greatest(F.size("p") - 2, F.lit(1))), lambda k: F.get("p", k).rlike(SEASON_FOLDER) & (k <= F.size("p") - 2))
    rows = rows.select("p", F.concat(here, above).alias("k")).where("size(k) > 0")
    top = rows.select(F.slice("p", F.lit(1), F.array_min("k")).alias("f")).where(F.size("f") <= depth + 1).distinct()
    # nothing below another show
    upper = top.select(F.array_join("f", "/").alias("folder"), F.explode(F.sequence(F.lit(1), F.size("f"))).alias("n"), "f").select("folder", F.array_join(F.slice("f", F.lit(1), F.col("n")), "/").alias("above")).where("above != folder")
    held = upper.join(top.select(F.array_join("f", "/").alias("above")), "above", "left_semi").select("folder")
    return top.select(F.array_join("f", "/").alias("folder")).join(held, "folder", "left_anti")
