"""Rules on single rows: what counts, what is trusted, what may be changed. All are column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_episode

ACTIONABLE = ("rename", "split", "aside", "join")
# Languages as streams are tagged with them.
LANGUAGES = {
    "en": ("en", "eng", "english"), "es": ("es", "spa"), "fr": ("fr", "fre", "fra"), "de": ("de", "ger", "deu"),
    "it": ("it", "ita"), "pt": ("pt", "por"), "nl": ("nl", "dut", "nld"), "ja": ("ja", "jpn"),
}
TEXT_CODECS = ("subrip", "ass", "ssa", "mov_text", "webvtt", "text")
IMAGE_CODECS = ("hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle", "xsub")
# Words of a site's name that say what it is, not what it is about.
SITE_WORDS = r"(?i)\b(wiki|fandom|encyclopedia|database)\b"
# What a decoder's warning says when it points at damage.
DAMAGE = (
    r"(?i)corrupt|invalid|non[- ]?monoton|out of order|concealing|missing|"
    r"truncat|error|could not find ref|mismatch|damaged|overread|skipp"
)


def aired(date: Column, today: Column) -> Column:
    """Shown already, or no date is known."""
    return F.coalesce(date <= today, F.lit(True))


def aired_if_dated(date: Column, today: Column, any_dated: Column) -> Column:
    """The same where a series has dates at all: then one without a date isn't shown yet."""
    return ~any_dated | F.coalesce(date <= today, F.lit(False))


def counts(season: Column, specials: Column) -> Column:
    """Specials, season 0, count if asked for."""
    return (season > 0) | F.coalesce(specials, F.lit(False))


def same_series(imdb: Column, own_imdb: Column, titles_match: Column) -> Column:
    """By IMDb number, however padded; by title where either number is missing."""
    bare = lambda c: F.regexp_replace(c, "^t*0*", "")
    return F.when((imdb != "") & (own_imdb != ""), bare(imdb) == bare(own_imdb)).otherwise(titles_match)


def damage_message(level: Column, message: Column) -> Column:
    """Does a decoder's message point at damage? All errors do, warnings by what they say; complaints of
    the null output are about itself."""
    own = message.startswith("[null]") | message.contains("to muxer in stream")
    return level.isin("fatal", "error", "warning") & ((level != "warning") | message.rlike(DAMAGE)) & ~own


def broad_reference(words: Column, reference_words: Column, least: int = 200, times: float = 1.8) -> Column:
    """A reference so much longer than a file's dialogue that it covers several episodes."""
    return (words >= least) & (reference_words >= times * words)


def unreferenced(code: Column, expected: Column, named: Column, referenced: Column, words: Column, reference_words: Column, score: Column, same: float = 0.35) -> Column:
    """Does a match against another episode say little, as the file's own has no reference to match?
    `named` is the episode that the name puts at the place, if any; `referenced` are all codes with a
    reference. A plain match still counts, unless the matched reference is broad."""
    own = F.when(named.isNotNull(), F.array(named)).otherwise(expected)
    blind = (F.size(expected) > 0) & ~F.array_contains(expected, code) & ~F.arrays_overlap(own, referenced)
    return blind & ((score < same) | broad_reference(words, reference_words))


def clear_card(partial: Column, code: Column, frames: Column) -> Column:
    return ~F.coalesce(partial, F.lit(False)) & (F.coalesce(code, F.lit("")) != "") & (F.coalesce(frames, F.lit(1)) >= 2)


def shown(kind: Column, damaged: Column, view: Column) -> Column:
    """Is a plan item part of a view: all, damaged, actions or a kind?"""
    return F.when(view == "all", True).when(view == "damaged", damaged).when(view == "actions", kind.isin(*ACTIONABLE)).otherwise(kind == view)


def import_blocked(state: Column, status: Column) -> Column:
    """Downloaded, but not imported without help."""
    return F.coalesce((state == "importBlocked") | ((state == "importPending") & (status == "warning")), F.lit(False))


def inside(path: Column, root: Column) -> Column:
    """Does a path stay below `root` once its `.` and `..` are resolved? Relative ones start there."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(root, F.lit("/"), path))
    parts = F.filter(F.split(whole, "/"), lambda x: ~x.isin("", "."))
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    real = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).otherwise(F.array_append(done, x)))
    resolved = F.concat(F.lit("/"), F.array_join(real, "/"))
    return (resolved == root) | resolved.startswith(F.concat(root, F.lit("/")))


def segment_choice(override: Column, confidence: Column, code: Column, model_code: Column) -> Column:
    """code and strength of a segment's evidence: by hand, then sure dialogue, then a model, then weak dialogue."""
    made = lambda c, s: F.struct(c.alias("code"), F.lit(s).alias("strength"))
    return F.when(override.isNotNull(), made(override, "manual")).when(confidence == "high", made(code, "high")).when(model_code.isNotNull(), made(model_code, "ai")).otherwise(made(code, "low"))


def sound_cuts(cuts: Column, targets: Column) -> Column:
    """Cut points for a split into `targets` files: one fewer, and those that are set rise from above 0."""
    some = F.filter(cuts, lambda x: x.isNotNull())
    rising = (F.array_sort(some) == some) & (F.size(F.array_distinct(some)) == F.size(some))
    return (F.size(cuts) == targets - 1) & F.forall(some, lambda x: x > 0) & rising


def transcript_page(title: Column) -> Column:
    """A page that holds a transcript, not the list of them."""
    return title.rlike(r"(?i)transcript") & ~F.lower(F.trim(title)).isin("transcript", "transcripts")


def same_show(site: Column, series: Column) -> Column:
    """Is a site, by its name without words for `wiki`, about a series?"""
    a = norm_episode(F.regexp_replace(F.coalesce(site, F.lit("")), SITE_WORDS, ""))
    b = norm_episode(F.regexp_replace(F.coalesce(series, F.lit("")), r"\(\d{4}\)", ""))
    return (a != "") & (b != "") & (F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit("")))


def over(status: Column, moved: Column, restored: Column, superseded: Column) -> Column:
    """A request with nothing left to do: done, called off, or failed with no damaged file left to put back."""
    no = F.lit(False)
    settled = ~F.coalesce(moved, no) | F.coalesce(restored, no) | F.coalesce(superseded, no)
    return status.isin("imported", "cancelled") | ((status == "failed") & settled)


def proper_subset(some: Column, whole: Column) -> Column:
    return (F.size(F.array_except(some, whole)) == 0) & (F.size(F.array_except(whole, some)) > 0)


def within_tolerance(got: Column, wanted: Column, least: float = 3.0, share: float = 0.02) -> Column:
    """Is a piece as long as it should be?"""
    return F.abs(got - wanted) <= F.greatest(F.lit(least), share * wanted)


def elapsed(at: Column, now: Column) -> Column:
    """Seconds since an ISO time; 0 if it can't be read."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(at)), F.lit(0))


def due(checked_at: Column, now: Column, hours: Column) -> Column:
    """Never checked, or long enough ago; never with an interval of 0."""
    last = F.try_to_timestamp(checked_at)
    return (hours > 0) & (last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= hours * 3600))


def mapped(value: Column, names: Sequence[str], default: str) -> Column:
    """The name for a number or a name of another system, in any case."""
    by = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(str(k)), F.lit(n), F.lit(n.replace("_", "")), F.lit(n))])
    return F.coalesce(F.try_element_at(by, F.lower(F.regexp_replace(value.cast("string"), "[_ ]", ""))), F.lit(default))


def coerced(value: Column, like: str, default: Column) -> Column:
    """A setting as text, read as the type of its default; what can't be read is the default."""
    if like == "boolean":
        read = F.when(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), True).when(F.lower(F.trim(value)).isin("0", "false", "no", "off", ""), False)
    else:
        read = F.trim(value).try_cast(like)
    return F.coalesce(read, default)


def backup_root(series: Column, media: Column, name: Column) -> Column:
    """Where displaced files go: beside the series, or inside it where there is nothing above it in the library."""
    parent, own = F.regexp_extract(series, "^(.*)/[^/]+$", 1), F.regexp_extract(series, "([^/]+)$", 1)
    above = (parent == media) | parent.startswith(F.concat(media, F.lit("/")))
    return F.when(above, F.concat_ws("/", parent, name, own)).otherwise(F.concat_ws("/", series, name))


def backup_relative(series: Column, media: Column, name: Column) -> Column:
    own = F.regexp_extract(series, "([^/]+)$", 1)
    beside = backup_root(series, media, name) != F.concat_ws("/", series, name)
    return F.when(beside, F.concat_ws("/", F.lit(".."), name, own)).otherwise(name)


def moved_prefix(log: Column, old: str, new: str, fields: Sequence[str]) -> Column:
    """An array of operations whose paths below `old` are below `new` instead."""
    there = lambda c: F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, F.length(c)))).otherwise(c)
    return F.transform(log, lambda op: F.struct(*[(there(op[f]) if f in ("src", "dst") else op[f]).alias(f) for f in fields]))


def language_fits(tag: Column, language: str) -> Column:
    tag = F.lower(F.coalesce(tag, F.lit("")))
    return F.lit(True) if not language else tag.isin(*LANGUAGES.get(language, (language,)), "", "und")


def vision_reason(cards: Column, first_end: Column, said: Column) -> Column:
    """Why the first episode's title card should be read by a model: `none` was read, only a `part`, or it
    `contradicts` both name and dialogue (codes in `said`); null: no need. cards: array of (time, code, partial)."""
    first = F.filter(cards, lambda c: c["time"] < first_end)
    full = F.filter(first, lambda c: ~F.coalesce(c["partial"], F.lit(False)))
    backed = F.exists(full, lambda c: F.array_contains(said, c["code"]))
    return F.when(F.size(first) == 0, "none").when(F.size(full) == 0, "part").when((F.size(said) > 0) & ~backed, "contradicts")


def name_words_only(text: Column, words: Column) -> Column:
    """Is a text (lower-case letters and digits) nothing but the given words run together? A fold over its
    places keeps which of them a row of words can reach."""
    start = F.array(F.lit(0))
    places = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)))

    def step(reached: Column, i: Column) -> Column:
        fits = F.filter(words, lambda w: (w != "") & (F.substring(text, i + 1, F.length(w)) == w))
        return F.when(F.array_contains(reached, i), F.array_union(reached, F.transform(fits, lambda w: i + F.length(w)))).otherwise(reached)

    return (F.length(text) >= 3) & F.array_contains(F.aggregate(places, start, step), F.length(text))


def settled_ticks(items: DataFrame, before: DataFrame, key: Sequence[str]) -> DataFrame:
    """A rebuilt plan's items with the ticks of the plan before, for items that are the same one (`key`) there."""
    kept = before.groupBy(*key).agg(F.bool_or("selected").alias("_was"))
    return items.join(kept, list(key), "left").withColumn("selected", F.coalesce("_was", "selected")).drop("_was")
