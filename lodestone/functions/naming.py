"""File names from templates: tokens in braces, numbers in several styles, titles within a byte budget."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_token, let

STYLES = ("extend", "duplicate", "repeat", "scene", "range", "prefixed_range")
MOST_BYTES = 255
# What tokens of either dialect stand for, by their names without separators.
TOKENS = {
    "series": "series", "seriestitle": "series", "seriestitleyear": "series_year", "seriestitlewithoutyear": "series_noyear",
    "seriescleantitle": "series_clean", "seriescleantitleyear": "series_clean_year", "seriescleantitlewithoutyear": "series_clean_noyear",
    "season": "season", "episode": "episode", "title": "title", "episodetitle": "title", "episodecleantitle": "title_clean",
    "quality": "quality", "qualityfull": "quality", "qualitytitle": "quality", "year": "year",
}
# Punctuation that scene names leave out.
SCENE = r"(?<=\s)[,<>/\;:'\"|`’~!?@$%^*\-_=](?=\s)|['`’:?,](?=(?:s|m|t|ve|ll|d|re)\s|\s|$)|[()\[\]{}]"
_BRACES = re.compile(r"\{([^{}]*)\}")
_INNER = re.compile(r"([- ._\[(]*)([A-Za-z0-9]+(?:[- ._][A-Za-z0-9]+)*)(?::(.*?))?([- ._)\]]*)")


class Token:
    """One `{...}` of a template: what stands before and behind its value, its name and number format."""

    def __init__(self, inner: str):
        m = _INNER.fullmatch(inner)
        self.known = m is not None
        self.before, self.name, self.format, self.behind = m.groups(default="") if m else ("", "", "", "")
        self.key = TOKENS.get(re.sub(r"[- ._]", "", self.name).lower())
        joints = re.findall(r"[- ._]", self.name)
        self.joint = joints[-1] if joints else ""

    def number(self, n: Column) -> Column:
        """Padded as `00` or `02d` say; a format that says nothing else leaves it as it is."""
        width = len(self.format) if re.fullmatch("0+", self.format) else int(m[1]) if (m := re.fullmatch(r"0?(\d+)d", self.format)) else 0
        shown = n.cast("string")
        return F.when(F.length(shown) < width, F.lpad(shown, width, "0")).otherwise(shown)

    def column(self, values: Mapping[str, Column]) -> Column:
        """The value in the token's case and with its separators; nothing at all where there is no value."""
        if self.key not in values:
            return F.lit("")
        v = values[self.key]
        v = self.number(v) if self.key in ("season", "episode") else F.coalesce(v.cast("string"), F.lit(""))
        out = v if self.joint in ("", " ") else F.replace(v, F.lit(" "), F.lit(self.joint))
        letters = re.sub("[^A-Za-z]", "", self.name)
        if self.joint:
            out = F.upper(out) if letters.isupper() else F.lower(out) if letters.islower() else out
        return F.when(v == "", "").otherwise(F.concat(F.lit(self.before), out, F.lit(self.behind)))


def parsed(template: str) -> list[str | Token]:
    """Literals and tokens in turn; braces that hold no token are literal."""
    out, at = [], 0
    for m in _BRACES.finditer(template):
        token = Token(m[1])
        if token.known:
            out += [template[at : m.start()], token]
            at = m.end()
    return [*out, template[at:]]


def unknown_tokens(template: str) -> list[str]:
    return list(dict.fromkeys(m[0] for m in _BRACES.finditer(template) if (t := Token(m[1])).known and t.key is None))


def _numbers(parts: list[str | Token]) -> int | None:
    """Where a season token is followed by `e` or `x` and an episode token."""
    for k in range(1, len(parts) - 2, 2):
        if parts[k].key == "season" and parts[k + 2].key == "episode" and re.fullmatch(r"[- ._]?[exEX]", parts[k + 1]):
            return k
    return None


def has_numbers(template: str) -> bool:
    return _numbers(parsed(template)) is not None


def render(template: str, values: Mapping[str, Column], season: Column | None = None, numbers: Column | None = None, style: str = "prefixed_range") -> Column:
    """A name from a template. With season and numbers (an array) the template's season and episode stand for
    all of them, in one of STYLES."""
    parts = parsed(template)
    at = _numbers(parts) if season is not None and numbers is not None else None
    made: list[Column] = []
    k = 0
    while k < len(parts):
        part = parts[k]
        if at is not None and k == at - 1:  # the literal before the season, which may end with its `s`
            s = part[-1:] if part[-1:] in ("s", "S") else ""
            before = part[: len(part) - len(s)]
            between = before if k and re.fullmatch("[- ._]+", before) else " "
            joint, season_of, number_of = parts[at + 1], parts[at], parts[at + 2]
            head = F.concat(F.lit(s), season_of.number(season), F.lit(joint))
            first = F.concat(head, number_of.number(F.get(numbers, F.lit(0))))
            rest = F.slice(numbers, F.lit(2), F.greatest(F.size(numbers) - 1, F.lit(0)))
            each = lambda lead: F.array_join(F.transform(rest, lambda n: F.concat(lead, number_of.number(n))), "")  # noqa: B023, E731
            last = number_of.number(F.element_at(numbers, -1))
            more = {
                "extend": lambda: each(F.lit("-")), "duplicate": lambda: each(F.concat(F.lit(between), head)), "repeat": lambda: each(F.lit(joint)),  # noqa: B023
                "scene": lambda: each(F.lit(f"-{joint}")), "range": lambda: F.concat(F.lit("-"), last),  # noqa: B023
            }.get(style, lambda: F.concat(F.lit(f"-{joint}"), last))()  # noqa: B023
            made += [F.lit(before), F.concat(first, F.when(F.size(numbers) > 1, more).otherwise(""))]
            k = at + 3
            continue
        made.append(F.lit(part) if isinstance(part, str) else part.column(values))
        k += 1
    return F.concat(*made)


def scene_title(c: Column) -> Column:
    """A title as scene names have it: words alone, `and` for &."""
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit("and")), r"[/\\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, SCENE, ""), r"\s{2,}", " "))


def series_values(name: Column, year: Column, **how) -> dict[str, Column]:
    """The values of a series' tokens: its name as it is, with and without its year, plain and as in scene names."""
    year = F.trim(F.coalesce(year.cast("string"), F.lit("")))
    dated = name.rlike(r"\(\d{4}\)$")
    without = F.trim(F.regexp_replace(name, r"\s*\(\d{4}\)$", ""))
    with_year = F.when(dated | (year == ""), name).otherwise(F.concat(name, F.lit(" ("), year, F.lit(")")))
    forms = {"series": name, "series_year": with_year, "series_noyear": without}
    clean = {k.replace("series", "series_clean"): scene_title(v) for k, v in forms.items()}
    return {k: clean_token(v, **how) for k, v in {**forms, **clean}.items()} | {"year": year}


def left_bytes(c: Column, n: Column) -> Column:
    """The longest beginning of a text with at most n bytes of UTF-8, never half a character."""

    def cut(c: Column, n: Column) -> Column:
        raw = c.cast("binary")
        # a character ends where the next byte does not go on with it; it has four bytes at most
        ends = F.filter(F.array(n, n - 1, n - 2, n - 3), lambda k: (k >= 0) & ~F.hex(F.substring(raw, k + 1, F.lit(1))).rlike("^[89AB]"))
        return F.when(F.octet_length(c) <= n, c).otherwise(F.substring(raw, F.lit(1), F.coalesce(F.array_max(ends), F.lit(0))).cast("string"))

    return let(c, lambda c: let(F.greatest(n.cast("int"), F.lit(0)), lambda n: cut(c, n)))


def prepared_titles(titles: Column) -> Column:
    """Titles as a name gets them: without end stops; several without their part numbers, each once. If these
    leave nothing, as they are."""
    bare = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"[ .?]+$", "")
    once = lambda raw: F.array_distinct(F.transform(raw, lambda t: F.trim(F.regexp_replace(t, r"(?i):?\s?(\(\d+\)|(part|pt\.?)\s?\d+)$", ""))))
    chosen = lambda raw, parted: F.when(F.size(raw) == 1, raw).when(F.forall(parted, lambda t: t == ""), F.array_distinct(raw)).otherwise(parted)
    return let(F.transform(titles, bare), lambda raw: let(once(raw), lambda parted: chosen(raw, parted)))


def joined_titles(titles: Column, most: Column) -> Column:
    """All titles within `most` bytes; else the first and the last, the first alone, or what of it fits, with an ellipsis."""
    size = F.octet_length

    def joined(titles: Column, most: Column) -> Column:
        many = F.size(titles) > 1
        everything = F.array_join(titles, " + ")
        first, last = F.get(titles, F.lit(0)), F.element_at(titles, -1)
        ended = F.regexp_replace(first, "[ .]+$", "")
        cut = F.regexp_replace(left_bytes(first, most - 3), "[ .]+$", "")
        return (
            F.when(size(everything) <= most, everything)
            .when(many & (size(first) + size(last) + 3 <= most), F.concat(ended, F.lit("..."), last))
            .when(many & (size(first) + 3 <= most), F.concat(ended, F.lit("...")))
            .when(~many & (size(first) <= most), first)
            .otherwise(F.concat(cut, F.lit("...")))
        )

    return let(titles, lambda t: let(most, lambda m: joined(t, m)))


def tidy_name(c: Column) -> Column:
    """An assembled name without empty brackets, double spaces and characters that files can't have."""
    c = F.regexp_replace(c, r"\[\s*\]|\(\s*\)|\{\s*\}", "")
    c = F.btrim(F.regexp_replace(c, r"\s{2,}", " "), F.lit(" -"))
    return F.trim(F.regexp_replace(clean_token(c, replace=False, mode="delete"), r"\s{2,}", " "))


def episode_file(template: str, name: Column, year: Column, season: Column, numbers: Column, titles: Column, quality: Column, ext: Column, style: str = "prefixed_range") -> Column:
    """A file's name from a template, whose title gets what bytes the rest leaves. A template without season
    and episode would give all files one name, so the plain one stands in for it."""
    if not has_numbers(template):
        template = "{series} - S{season:02d}E{episode:02d} - {title}"
    # what is named several times below is computed once for each row
    series = series_values(name, year)
    given = F.struct(*[v.cast("string").alias(k) for k, v in series.items()], season.alias("season"), numbers.alias("numbers"), quality.cast("string").alias("quality"), ext.alias("ext"))

    def named(x: Column) -> Column:
        season, numbers, ext = x["season"], x["numbers"], x["ext"]
        values = {**{k: x[k] for k in series}, "season": season, "episode": F.get(numbers, F.lit(0)), "quality": x["quality"]}
        bare = render(template, {**values, "title": F.lit(""), "title_clean": F.lit("")}, season, numbers, style)
        title = joined_titles(prepared_titles(titles), F.lit(MOST_BYTES) - F.octet_length(ext) - F.octet_length(bare))
        with_title = lambda t: tidy_name(render(template, {**values, "title": t["title"], "title_clean": t["clean"]}, season, numbers, style))
        whole = let(let(title, lambda t: F.struct(clean_token(t).alias("title"), clean_token(scene_title(t)).alias("clean"))), with_title)
        return F.concat(F.rtrim(left_bytes(whole, F.lit(MOST_BYTES) - F.octet_length(ext))), ext)

    return let(given, named)


def season_folder(season: Column, flat: Column, known: Column, template: str = "Season {season:00}", specials: str = "Specials") -> Column:
    """Where a season's files go: the root of a flat series, the folder that it has, or one by the template."""
    made = tidy_name(render(template, {"season": season}))
    return F.when(flat, "").when(known.isNotNull(), known).when(season == 0, specials).otherwise(let(made, lambda made: F.when(made == "", F.format_string("Season %02d", season.cast("long"))).otherwise(made)))
