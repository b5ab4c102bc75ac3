"""What a text on screen says among titles, found through an index of letter pairs.

A text and a title that are alike share letter pairs, so texts meet titles in equality joins on these and
no task holds all titles. For a similarity of r (twice the matched letters over all letters) of two texts
of n and m letters, M = ceil(r (n + m) / 2) letters match, in at most n + m - 2 M + 1 pieces, so that
3 M - (n + m) - 1 pairs at least are common. Prefix filtering follows from that number: if each side
keeps its rarest pairs only, as many as leave fewer than this number aside, the two still have one of
those in common, and frequent pairs like `er` are hardly ever joined. For beginnings and ends of
titles, where s letters may differ, any 3 s + 1 pairs of the text do, and a pair may stand s places off.
Where titles are made of few words most texts meet most titles; so they meet in blocks, in which letters are
counted for all pairs at once, and only those become rows that have enough letters in the same order.
These are checked by their real similarity, one by one.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..storage import stored
from .rules import name_words_only

#: Similarities below these never decide anything; a runner-up counts within LEAD of a weak best.
LOW, LEAD = 0.78, 0.25
#: Texts and titles that share a token meet in blocks of about so many of each.
BLOCK = 1000
#: So many of the titles that could be near a weak best are looked at first.
LIKELY = 8


def _similarities(a: list[str], b: list[str], least: list[float]) -> np.ndarray:
    """Twice the matched letters over all letters of each pair; 0 below least. Pairs of one second text in turn, as what is known of it is kept."""
    out = np.zeros(len(a))
    m = difflib.SequenceMatcher(None)
    for k in sorted(range(len(a)), key=b.__getitem__):
        if m.b != b[k]:
            m.set_seq2(b[k])
        m.set_seq1(a[k])
        r = m.ratio()
        out[k] = r if r >= least[k] else 0.0
    return out


def _coded(texts: list[str], letters: dict[str, int]) -> np.ndarray:
    """The letters of each text by number, 0 behind its end."""
    codes = np.zeros((len(texts), max(map(len, texts), default=0)), np.int64)
    for k, t in enumerate(texts):
        codes[k, : len(t)] = [letters[c] for c in t]
    return codes


def _sizes(texts: list[str]) -> np.ndarray:
    return np.array([len(t) for t in texts], np.int64)


def _numbers(a: list[str], b: list[str]) -> dict[str, int]:
    return {c: k + 1 for k, c in enumerate(sorted({c for t in (*a, *b) for c in t}))}


def _in_order(firsts: list[str], seconds: list[str], of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """At least as many letters as can match in each pair of a first and a second text (of, to): their longest common
    subsequence, by bits, where the first has 63 letters or fewer, else the shorter one's length. What matches piece by
    piece is such a sequence."""
    letters = _numbers(firsts, seconds)
    masks, codes = np.zeros((len(firsts), len(letters) + 1), np.uint64), _coded(seconds, letters)
    for i, column in enumerate(_coded(firsts, letters)[:, :63].T):
        masks[np.arange(len(firsts)), column] |= np.uint64(1 << i)
    masks[:, 0] = 0
    v = np.full(len(of), np.uint64(2**64 - 1))
    for column in codes.T:
        met = v & masks[of, column[to]]
        v = (v + met) | (v - met)
    n = _sizes(firsts)
    common = np.bitwise_count(~v & (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)[of]) - np.uint64(1)).astype(np.int64)
    return np.where(n[of] <= 63, common, np.minimum(n[of], _sizes(seconds)[to]))


def _in_common(a: list[str], b: list[str]) -> np.ndarray:
    """How many letters each text of a has in common with each of b, in any order."""
    letters = _numbers(a, b)

    def often(texts: list[str]) -> np.ndarray:
        width = len(letters) + 1
        cells = np.arange(len(texts))[:, None] * width + _coded(texts, letters)
        return np.bincount(cells.ravel(), minlength=len(texts) * width).reshape(-1, width)[:, 1:]

    x, y = often(a), often(b)
    most = range(1, min(x.max(initial=0), y.max(initial=0)) + 1)
    out = np.zeros((len(a), len(b)), np.float32)
    for k in most:
        out += (x >= k).astype(np.float32) @ (y >= k).astype(np.float32).T
    return out


def alike(pairs: DataFrame, a: str, b: str, least: Column) -> DataFrame:
    """pairs with `r`, the similarity of the texts a and b, where it is at least `least`. Pairs that have too few letters
    in the same order are left out by the batch; the others are compared one by one."""
    rows = pairs.withColumn("_least", least.cast("double"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", r double"

    names = [*pairs.columns, "r"]
    places = (names.index(a), names.index(b), len(names) - 1)

    def step(batches):
        for batch in batches:
            x, y, need = (batch.column(k).to_pylist() for k in places)
            both = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
            (firsts, of), (seconds, to) = (np.unique(np.array(z, object), return_inverse=True) for z in (x, y))
            could = 2 * _in_order(firsts.tolist(), seconds.tolist(), of, to) >= np.array(need) * both - 1e-9
            batch, some = batch.filter(pa.array(could, pa.bool_())), np.flatnonzero(could)
            r = _similarities([x[k] for k in some], [y[k] for k in some], [need[k] for k in some])
            keep = pa.array(r > 0, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in [*batch.columns[:-1], pa.array(r, pa.float64())]], names)

    return rows.mapInArrow(step, schema)


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs in as many parts as a shuffle has: comparing them takes time that their bytes don't tell, so that parts
    put together by size would leave it to one task."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c", "t")


def _meeting(asked: DataFrame, held: DataFrame, need: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """c, t and `common` of each text (c) and title (t) that share one of their `tokens` (numbers) and have at least as many
    letters in common, in the same order, as `need` says for their lengths; common: at least as many as can match.

    Those that share a token meet in blocks; a pair with several of them is looked at where the least one is."""
    asked, held = stored(asked, "asked"), stored(held, "held")
    blocks = lambda rows, name: rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(asked, "of").join(blocks(held, "to"), "token")

    def dealt(rows: DataFrame, text: str, own: str, other: str) -> DataFrame:
        met = rows.select(text, "tokens", F.explode("tokens").alias("token")).join(sizes, "token")
        return met.select(text, "tokens", "token", F.pmod(F.xxhash64(text), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)).groupBy("token", "of", "to")

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        c, t = (pa.array([], pa.string()) if not len(x) else x[k].combine_chunks() for x, k in ((a, "c"), (b, "t")))
        of = to = common = np.zeros(0, np.int64)
        if len(c) and len(t):
            firsts, seconds = c.to_pylist(), t.to_pylist()
            least = need(_sizes(firsts)[:, None], _sizes(seconds)[None, :])
            could = (_in_common(firsts, seconds) >= least) & ~_earlier(a, b)
            of, to = np.nonzero(could)
            common = _in_order(firsts, seconds, of, to)
            enough = common >= least[of, to]
            of, to, common = of[enough], to[enough], common[enough]
        return pa.table({"c": c.take(pa.array(of)), "t": t.take(pa.array(to)), "common": pa.array(common, pa.int64())})

    return dealt(asked, "c", "of", "to").cogroup(dealt(held, "t", "to", "of")).applyInArrow(step, "c string, t string, common long")


def _earlier(a: pa.Table, b: pa.Table) -> np.ndarray:
    """Which texts of a and b, which share a token, share a lesser one as well."""
    rows = []
    for x in (a, b):
        tokens = x["tokens"].combine_chunks()
        token, row = tokens.flatten().to_numpy(), np.repeat(np.arange(len(x)), tokens.value_lengths().to_numpy())
        less = token < x["token"][0].as_py()
        rows.append((len(x), token[less], row[less]))
    both = np.intersect1d(rows[0][1], rows[1][1])
    sides = []
    for n, token, row in rows:
        some = np.isin(token, both)
        side = np.zeros((n, len(both)), np.float32)
        side[row[some], np.searchsorted(both, token[some])] = 1
        sides.append(side)
    return sides[0] @ sides[1].T > 0


def _tokens(rows: DataFrame, text: str, *parts: str) -> DataFrame:
    return rows.groupBy(text).agg(F.collect_set(F.xxhash64(*parts)).alias("tokens"))


def _grams(rows: DataFrame, text: str, size: int) -> DataFrame:
    """text, pos (from 0) and gram of each run of `size` letters."""
    places = F.sequence(F.lit(0), F.length(text) - size)
    return rows.where(F.length(text) >= size).select(text, F.explode(places).alias("pos")).select(text, "pos", F.substring(F.col(text), F.col("pos") + 1, F.lit(size)).alias("gram"))


def _numbered(grams: DataFrame, text: str) -> DataFrame:
    """Repeats of a gram within a text become tokens of their own."""
    return grams.withColumn("nth", F.row_number().over(Window.partitionBy(text, "gram").orderBy("pos"))).select(text, "gram", "nth")


def similar(texts: DataFrame, titles: DataFrame, r: float, size: int) -> DataFrame:
    """Pairs c (of texts), t (of titles) that may have a similarity of r, by prefix filtering on runs of `size` letters and by
    letters in order."""
    return _dealt(_similar(texts, titles, r, size).select("c", "t"))


def _similar(texts: DataFrame, titles: DataFrame, r: float, size: int) -> DataFrame:
    """These pairs with `common`, at least as many letters as can match.

    With size 2 and r >= 0.75 no pair of six letters together or more is missed; with size 1 none at all.
    """
    tc, tt = _numbered(_grams(texts, "c", size), "c"), _numbered(_grams(titles, "t", size), "t")
    often = tt.groupBy("gram", "nth").agg(F.count("*").alias("df"))
    factor, less = (1.5 * r - 1, 1) if size == 2 else (0.5 * r, 0)

    def rarest(tokens: DataFrame, name: str) -> DataFrame:
        n = F.length(name)
        both = n + F.ceil(n * (r / (2 - r)) - 1e-9)  # the shortest other side that can be that alike
        common = F.greatest(F.lit(1), F.ceil(factor * both - less - 1e-9))
        rank = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("df", F.lit(0)), "gram", "nth"))
        return tokens.join(often, ["gram", "nth"], "left").withColumn("rank", rank).where(F.col("rank") <= n - size + 1 - common + 1).select(name, "gram", "nth")

    def need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(np.abs(m - n) <= np.maximum(4, m // 2), r * (n + m) / 2 - 1e-9, np.inf)

    return _meeting(_tokens(rarest(tc, "c"), "c", "gram", "nth"), _tokens(rarest(tt, "t"), "t", "gram", "nth"), need)


def _slips(n: Column) -> Column:
    """How many letters of a text may differ from the beginning of a title."""
    return F.greatest(F.lit(1), F.floor(n / 12)).cast("int")


def _placed(texts: DataFrame, titles: DataFrame, slips: Column, size: int, from_end: bool, need: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pairs c, t where t is at least three letters longer and has all letters of c but for `slips` in the same order, and one of
    any `keep` of c's grams stands in t at the same place, give or take `slips`, counted from the beginning or from the end."""
    grams, held = _grams(texts, "c", size), _grams(titles, "t", size)
    often = held.groupBy("gram").agg(F.count("*").alias("df"))
    keep = 3 * slips + 1 if size == 2 else slips + 1
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.coalesce("df", F.lit(0)), "gram", "pos"))
    some = grams.join(often, "gram", "left").withColumn("rank", rank).where(F.col("rank") <= keep)
    place = (lambda text: F.length(text) - F.col("pos")) if from_end else (lambda text: F.col("pos"))
    asked = some.withColumn("at", F.explode(F.sequence(place("c") - slips, place("c") + slips))).select("c", "gram", "at")
    longer = lambda n, m: np.where(m >= n + 3, need(n), np.inf)
    return _dealt(_meeting(_tokens(asked, "c", "gram", "at"), _tokens(held.select("t", "gram", place("t").alias("at")), "t", "gram", "at"), longer).select("c", "t"))


def readings(lines: DataFrame, titles: DataFrame, key: str, code: str, sure: float = 0.85, short: int = 8, short_sure: float = 0.9, most: int = 25) -> DataFrame:
    """What a line of text (`norm`, letters and digits alone) reads as among titles (code, `norm`; a code may have several).

    `full`: one title is alike enough and leads the next one of another code by 0.06 (0.03 for near certainty), or is
    at 0.78 with nothing within 0.25. `tail`: it is the end of one title alone. `partial`: the beginning of longer
    titles, `most` at most, or a text that several codes have; it lists candidates, and has a code only if one
    title was read in full that is itself the beginning of others. score: of the best title at 0.78 or more, else 0.

    Lines of fewer than 3 letters, and titles of fewer than 2 or without a code, say nothing; repeated lines are read
    once; null lines have no reading.
    """
    known = stored(titles.where(F.col(code).isNotNull() & (F.length("norm") >= 2)).select(F.col(code).cast("long").alias("code"), F.col("norm").alias("t")).distinct(), "titles")
    names = known.select("t").distinct()
    texts = stored(lines.where(F.length("norm") >= 3).select(F.col("norm").alias("c")).distinct(), "lines")
    n = F.length("c")

    # the best title of each text, and the best one of another code and text
    met = stored(similar(texts, names, LOW, 2), "met")
    low = min(LOW, sure - 0.06, short_sure - 0.06)  # below it nothing is near a sure best
    first = stored(alike(met, "c", "t", F.lit(low)), "similar")

    def placed_first(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(known, "t")
        top = rows.groupBy("c").agg(F.max(F.struct("r", "code", "t")).alias("top"))
        other = rows.join(top, "c").where((F.col("code") != F.col("top.code")) & (F.col("t") != F.col("top.t"))).groupBy("c").agg(F.max("r").alias("second"))
        return top.join(other, "c", "left").select("c", F.col("top.r").alias("score"), F.col("top.code").alias("code"), F.col("top.t").alias("t"), F.coalesce("second", F.lit(0.0)).alias("second"))

    least = F.when(F.length("t") <= short, short_sure).otherwise(sure)
    lead = F.col("score") - F.col("second")
    clear = (F.col("score") >= least) & ((lead >= 0.06) | ((F.col("score") >= 0.97) & (lead >= 0.03)))
    alone = (F.col("score") >= LOW) & (n >= 12) & (lead >= LEAD)
    tops = placed_first(first).where(F.col("score") >= LOW)
    # where a weak best has nothing near it so far, titles of down to 0.53 are looked at by their letters, first those that
    # have most in common: one that is near settles it
    weak = stored(tops.where(alone & ~clear), "weak")
    near = F.greatest(F.lit(0.5), F.col("best") - LEAD)
    wide = stored(_similar(weak.select("c"), names, LOW - LEAD, 1).join(weak.select("c", F.col("score").alias("best")), "c").withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(F.desc(F.col("common") / (F.length("c") + F.length("t"))), "t"))), "wide")
    likely = alike(_dealt(wide.where(F.col("place") <= LIKELY).select("c", "t", "best")), "c", "t", near).select("c", "t", "r")
    first = stored(first.unionByName(likely).distinct(), "near")
    tops = placed_first(first).where(F.col("score") >= LOW)
    doubt = stored(tops.where(alone & ~clear), "doubt")
    more = alike(_dealt(wide.where(F.col("place") > LIKELY).join(doubt.select("c"), "c", "left_semi").select("c", "t", "best")), "c", "t", near).select("c", "t", "r")
    again = placed_first(more.unionByName(first.join(doubt.select("c"), "c", "left_semi")).distinct())
    tops = stored(tops.join(doubt.select("c"), "c", "left_anti").unionByName(again).withColumn("full", clear | alone), "tops")

    # titles that a text could be the beginning of
    slips = _slips(n)
    most_of = lambda n: n - np.maximum(1, n // 12)
    begun = _placed(texts.where(n >= 6), names, slips, 2, False, most_of).unionByName(_placed(tops.where((n < 6) & F.col("full")).select("c"), names, slips, 1, False, most_of))
    cut = begun.withColumn("start", F.substring(F.col("t"), F.lit(1), n))
    longer = alike(cut, "c", "start", 1 - slips / n).select("c", "t")
    starts = names.where(F.length("t") >= 5).select(F.col("t").alias("whole"), F.explode(F.expr("transform(sequence(2, length(t) - 3), i -> left(t, i))")).alias("t"))
    own = tops.where("full").select("c", "t").join(starts, "t").select("c", F.col("whole").alias("t"))
    longer = stored(longer.unionByName(own).distinct().join(known, "t").select("c", "t", "code"), "longer")
    counted = longer.groupBy("c").agg(F.count("*").alias("n_longer"))
    few = counted.where(F.col("n_longer") <= most)
    listed = longer.join(few, "c", "left_semi").groupBy("c").agg(F.sort_array(F.collect_set("code")).alias("longer"))
    shared = known.withColumnRenamed("code", "twin")
    twins = tops.where("full").join(shared, "t").where("twin != code").select("c", "twin").distinct()
    many = twins.groupBy("c").agg(F.count("*").alias("n_twins"), F.sort_array(F.collect_set("twin")).alias("twins"))

    rest = texts.where(n >= 10).join(tops.where("full"), "c", "left_anti").join(counted, "c", "left_anti")
    allowed = n - F.ceil(0.92 * n - 1e-9)
    ends = _placed(rest, names, allowed.cast("int"), 2, True, lambda n: np.ceil(0.92 * n - 1e-9)).withColumn("end", F.expr("right(t, length(c))"))
    tails = alike(ends, "c", "end", F.lit(0.92)).select("c", "t").join(known, "t").groupBy("c").agg(F.count_distinct("code").alias("k"), F.min("code").alias("tail")).where("k = 1").select("c", "tail")

    rows = texts.join(tops, "c", "left").join(counted, "c", "left").join(listed, "c", "left").join(many, "c", "left").join(tails, "c", "left")
    full, some = F.coalesce("full", F.lit(False)), F.col("n_longer").isNotNull()
    twin = full & F.col("n_twins").isNotNull()
    beginning = F.col("longer").isNotNull() & ((n >= 6) | (full & (F.col("score") >= 0.999)))
    kind = F.when(twin, "partial").when(full & ~some, "full").when(~full & ~some & F.col("tail").isNotNull(), "tail").when(some & beginning, "partial")
    could = F.when(twin, F.array_distinct(F.concat(F.array("code"), F.col("twins")))).when(kind == "partial", F.array_distinct(F.concat(F.when(full, F.array("code")).otherwise(F.array().cast("array<bigint>")), F.col("longer"))))
    says = F.when(kind == "tail", F.col("tail")).when(full & ~twin, F.col("code"))
    got = rows.select("c", kind.alias("kind"), says.alias(code), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), could.alias("candidates")).where("kind is not null")
    return lines.select(key, F.col("norm").alias("c")).join(got, "c").select(key, "kind", code, "score", "candidates")


# ---- frames
def _runs(big: Column, title_height: float, longest: int = 7) -> Column:
    """The texts of runs of neighbouring lines, each with and without words that repeat the one before."""

    def of(i: Column) -> Column:
        def run(j: Column) -> Column:
            lines = F.slice(big, i + 1, j)
            words = F.filter(F.split(F.array_join(F.transform(lines, lambda x: x["text"]), " "), r"\s+"), lambda w: w != "")
            once = F.filter(words, lambda w, k: (k == 0) | (F.lower(w) != F.lower(F.get(words, k - 1))))
            tall = F.exists(lines, lambda x: x["height"] >= title_height)
            return F.when(tall, F.array(F.array_join(words, " "), F.array_join(once, " "))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(big) - i)), run))

    places = F.when(F.size(big) > 0, F.sequence(F.lit(0), F.size(big) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(places, of)))


def match_frames(frames: DataFrame, titles: DataFrame, key: str, code: str, recurring: DataFrame | None = None, name_words: tuple[str, ...] = (), sure_line: float = 0.75, line_height: float = 0.035, title_height: float = 0.045) -> DataFrame:
    """The best reading of each frame that says something: key, kind (full, tail, gapped, part, partial), code, score, candidates, text.

    frames: key, at (seconds into the episode; null: unknown) and lines, an array of (text, conf, height, y). titles: code
    and `title`, of which `part` (null: none) is the number that tells parts of one story apart. Titles are often
    wrapped: runs of up to seven neighbouring lines, one of which is tall, are read, then titles with a hidden
    middle. Readings of recurring texts (code, offset) within 8 s of their point, and those made of
    `name_words` (the show's own name) alone that aren't a title exactly, are dropped. Full readings win, then longer texts, then higher scores, then what comes first.
    """
    known = titles.select(F.col(code).cast("long").alias(code), X.norm_nospace(F.col("title")).alias("norm"), F.col("part").cast("long").alias("part"))
    clear = F.filter("lines", lambda x: (x["conf"] >= sure_line) & (x["height"] >= line_height) & x["text"].rlike(r"\p{L}{2}"))
    big = F.transform(F.array_sort(F.transform(clear, lambda x, i: F.struct(x["y"].alias("y"), i.alias("i"), x.alias("line")))), lambda x: x["line"])
    rows = frames.select(key, "at", big.alias("big"), F.filter("lines", lambda x: x["conf"] >= sure_line).alias("sure"))
    runs = rows.select(key, "at", F.posexplode(_runs(F.col("big"), title_height)).alias("place", "text"))
    # a frame's runs of one text are read once
    read = stored(runs.select(key, "at", "place", "text", X.norm_nospace(F.col("text")).alias("norm")), "runs")
    got = readings(read.select("norm").distinct().withColumn("line", F.col("norm")), known, "line", code).withColumnRenamed("line", "norm")
    words = F.array(*[F.lit(w) for w in name_words]) if name_words else None

    def only_name(norm: Column) -> Column:
        return name_words_only(norm, words) if name_words else F.lit(False)

    seen = read.join(got, "norm").where(~only_name(F.col("norm")) | ((F.col("kind") != "tail") & (F.col("score") >= 0.97)))
    seen = seen.select(key, "at", "place", "text", "norm", "kind", code, "score", "candidates")
    seen = _without_recurring(seen, recurring, code)
    whole = seen.where("kind != 'partial'").select(key).distinct()
    gaps = _gapped(rows.where(F.size("big") >= 2).join(whole, key, "left_anti"), known, key, code, title_height, only_name)
    every = seen.unionByName(_without_recurring(gaps, recurring, code))
    best = F.struct((F.col("kind") != "partial").alias("full"), F.length("norm").alias("size"), "score", (-F.col("place")).alias("place"), "kind", code, "candidates", "text")
    top = every.groupBy(key).agg(F.max(best).alias("x")).select(key, "x.kind", f"x.{code}", "x.score", "x.candidates", "x.text")
    return _with_part(top, rows, known, key, code)


def _without_recurring(reads: DataFrame, recurring: DataFrame | None, code: str) -> DataFrame:
    if recurring is None:
        return reads
    points = recurring.agg(F.map_from_entries(F.collect_list(F.struct(F.col(code).cast("long"), "offset"))).alias("_points"))
    rows = reads.join(F.broadcast(points))  # one row: the texts of one show's opening titles
    there = lambda c: F.coalesce(F.abs(F.col("at") - F.try_element_at("_points", c)) <= 8.0, F.lit(False))
    partial = F.col("kind") == "partial"
    could = F.when(partial, F.filter("candidates", lambda c: ~there(c)))
    keep = F.when(partial, F.size(could) > 0).otherwise(~there(F.col(code)))
    says = F.when(partial & there(F.col(code)), None).otherwise(F.col(code))
    return rows.where(keep).withColumns({code: says, "candidates": could}).drop("_points")


def _gapped(rows: DataFrame, known: DataFrame, key: str, code: str, title_height: float, only_name) -> DataFrame:
    """Titles read in two pieces, a tall one and, behind it, the end of the title; one code alone, half of what is left of it read."""
    norm = lambda x: X.norm_nospace(x["text"])
    pieces = rows.select(key, "at", F.transform("big", lambda x: F.struct(norm(x).alias("n"), x["text"].alias("text"), (x["height"] >= title_height).alias("tall"))).alias("p"))
    heads = pieces.select(key, "at", "p", F.posexplode("p").alias("i", "a")).where("a.tall and length(a.n) >= 6")
    both = heads.select(key, "at", "i", "a", F.posexplode("p").alias("j", "b")).where("i != j and length(b.n) >= 3")
    ends = known.select(code, F.col("norm").alias("t")).distinct().where(F.length("t") >= 9).select(code, "t", F.explode(F.expr("transform(sequence(3, length(t) - 6), i -> right(t, i))")).alias("end"))
    met = both.join(ends, F.col("b.n") == F.col("end")).withColumn("p", F.expr("instr(t, a.n)"))
    met = met.where((F.col("p") > 0) & (F.length("t") - F.length("b.n") >= F.col("p") - 1 + F.length("a.n")))
    cover = (F.length("a.n") + F.length("b.n")) / (F.length("t") - F.col("p") + 1)
    text = F.concat("a.text", F.lit(" … "), "b.text")
    name = only_name(F.col("a.n")) & only_name(F.col("b.n"))
    found = met.select(key, "at", code, cover.alias("score"), text.alias("text"), F.concat("a.n", "b.n").alias("norm"), name.alias("_name"))
    one = found.groupBy(key, "at").agg(F.count_distinct(code).alias("k"), F.max(F.struct("score", "text", "norm", "_name", code)).alias("x")).where("k = 1")
    out = one.select(key, "at", F.lit(1 << 20).alias("place"), "x.text", "x.norm", F.lit("gapped").alias("kind"), f"x.{code}", F.round("x.score", 3).alias("score"), F.lit(None).cast("array<bigint>").alias("candidates"), "x._name")
    return out.where("score >= 0.5 and not _name").drop("_name")


def _with_part(top: DataFrame, rows: DataFrame, known: DataFrame, key: str, code: str) -> DataFrame:
    """A partial reading of a story in parts with a part's number on the same frame is that part."""
    parts = known.where("part is not null").select(code, "part").distinct()
    marks = rows.select(key, F.posexplode("sure").alias("place", "line")).select(key, "place", F.col("line.text").alias("mark"), X.card_part(F.col("line.text")).alias("part")).where("part is not null")
    could = top.where("kind = 'partial'").select(key, F.explode("candidates").alias(code)).join(parts, code)
    hit = could.join(marks, [key, "part"]).groupBy(key, "place", "mark").agg(F.count_distinct(code).alias("k"), F.min(code).alias("is")).where("k = 1")
    first = hit.groupBy(key).agg(F.min(F.struct("place", "mark", "is")).alias("m"))
    told = top.join(first, key, "left")
    is_part = F.col("m").isNotNull()
    text = F.when(is_part & ~F.contains("text", "m.mark"), F.concat("text", F.lit(" … "), "m.mark")).otherwise(F.col("text"))
    return told.select(key, F.when(is_part, "part").otherwise(F.col("kind")).alias("kind"), F.when(is_part, F.col("m.is")).otherwise(F.col(code)).alias(code), "score", F.when(~is_part, F.col("candidates")).alias("candidates"), text.alias("text"))
