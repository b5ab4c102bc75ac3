"""Queries of text functions and timed text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.views import cache_key
from ..registry import query
from ..sources import subtitles
from .common import table

# ---- titles made from part names, with the forms that normalisers treat
_TITLES = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'The ' || p_name || ' (' || p_size || ')'
  WHEN 1 THEN 'A ' || p_name || ' &amp; Versus Pt. ' || p_size WHEN 2 THEN p_name || ' Part Two'
  WHEN 3 THEN p_name || '''s "Day" &quot;Off&quot;' WHEN 4 THEN 'an ' || upper(p_name) || ' - Part iii' ELSE p_name END AS title FROM part"""


def _titles(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("lodestone_part")
    return spark.sql(_TITLES.replace("FROM part", "FROM lodestone_part").replace("'''s \"", "\"\\'s \\\"").replace("\"\\'s", "'\\'s").replace("\\\"Day\\\"", '"Day"'))


_UN = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_U = _UN.format("title")
_SP = "trim(regexp_replace({0}, '[^a-z0-9]+', ' ', 'g'))"
_NP = f"regexp_replace(trim(lower({_U})), '\\([0-9]+\\)$', '')"


@query(f"WITH t AS ({_TITLES}) SELECT p_partkey, {_SP.format(f"regexp_replace({_NP}, '^(the|a|an)\\s+', '')")} AS norm FROM t")
def norm_title(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", X.norm_title(F.col("title")).alias("norm"))


@query(f"WITH t AS ({_TITLES}) SELECT p_partkey, regexp_replace(regexp_replace({_NP}, '\\bversus\\b', 'vs', 'g'), '[^a-z0-9]+', '', 'g') AS norm FROM t")
def norm_nospace(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", X.norm_nospace(F.col("title")).alias("norm"))


def _norm_part_sql() -> str:
    c = f"regexp_replace(replace(lower({_U}), '&', ' and '), '\\(([0-9]+)\\)\\s*$', ' part \\1')"
    for word, n in (("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("i", 1), ("ii", 2), ("iii", 3), ("iv", 4)):
        c = f"regexp_replace({c}, '\\bpart\\s+{word}\\b', 'part {n}', 'g')"
    c = f"regexp_replace({c}, '\\bpt\\.?\\s*([0-9])', 'part \\1', 'g')"
    return f"WITH t AS ({_TITLES}) SELECT p_partkey, regexp_replace({_SP.format(c)}, '^(the|a|an)\\s+', '') AS norm FROM t"


@query(_norm_part_sql())
def norm_part(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", X.norm_episode(F.col("title")).alias("norm"))


@query(f"WITH t AS ({_TITLES}) SELECT p_partkey, ' ' || {_SP.format(f"translate(replace(lower({_U}), '&', ' and '), '''’', '')")} || ' ' AS words, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS alnum FROM t")
def name_words(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", X.name_words(F.col("title")).alias("words"), X.alnum(F.col("title")).alias("alnum"))


# ---- file names
_NAMES = """SELECT p_partkey, p_size, CASE p_partkey % 8 WHEN 0 THEN format('{} S{:02d}E{:02d}.mkv', p_name, p_size, p_partkey % 30)
  WHEN 1 THEN format('{} s{:02d}e{:02d}E{:02d}', p_name, p_size, p_partkey % 30, p_partkey % 30 + 1)
  WHEN 2 THEN format('{} S{:02d}E{:02d}-E{:02d} x', p_name, p_size, p_partkey % 30, p_partkey % 30 + 4)
  WHEN 3 THEN format('{} S{:02d}E{:02d}-{:02d}', p_name, p_size, p_partkey % 30, p_partkey % 30 + 3)
  WHEN 4 THEN format('{} {}x{:02d}', p_name, p_size, p_partkey % 90 + 10)
  WHEN 5 THEN format('{} {}x{:02d}-{:02d} WEB-DL 1080p', p_name, p_size, p_partkey % 40 + 10, p_partkey % 40 + 11)
  WHEN 6 THEN format('{} S{:02d}E{:02d}E{:02d}', p_name, p_size, p_partkey % 30, p_partkey % 30) ELSE p_name || ' HDTV-720p' END AS name FROM part"""


def _names(spark, sf_dir):
    n = F.col("p_partkey") % 30
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s, e = two(F.col("p_size")), two(n)
    p, k = F.col("p_name"), F.col("p_partkey") % 8
    forms = [
        F.concat(p, F.lit(" S"), s, F.lit("E"), e, F.lit(".mkv")),
        F.concat(p, F.lit(" s"), s, F.lit("e"), e, F.lit("E"), two(n + 1)),
        F.concat(p, F.lit(" S"), s, F.lit("E"), e, F.lit("-E"), two(n + 4), F.lit(" x")),
        F.concat(p, F.lit(" S"), s, F.lit("E"), e, F.lit("-"), two(n + 3)),
        F.concat(p, F.lit(" "), F.col("p_size"), F.lit("x"), two(F.col("p_partkey") % 90 + 10)),
        F.concat(p, F.lit(" "), F.col("p_size"), F.lit("x"), two(F.col("p_partkey") % 40 + 10), F.lit("-"), two(F.col("p_partkey") % 40 + 11), F.lit(" WEB-DL 1080p")),
        F.concat(p, F.lit(" S"), s, F.lit("E"), e, F.lit("E"), e),
    ]
    out = F.concat(p, F.lit(" HDTV-720p"))
    for i, form in enumerate(forms):
        out = F.when(k == i, form).otherwise(out)
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", out.alias("name"))


@query(f"""WITH t AS ({_NAMES}), m AS (SELECT p_partkey, regexp_extract(name, '(?i)\\bS([0-9]{{1,3}})((?:[ ._-]*E[0-9]{{1,4}})+)(?:-([0-9]{{1,4}})\\b)?', 0) AS whole, name FROM t),
n AS (SELECT *, regexp_extract(whole, '(?i)S([0-9]{{1,3}})', 1) AS season, list_concat(regexp_extract_all(whole, '(?i)E([0-9]+)', 1), regexp_extract_all(whole, '[0-9]-([0-9]+)$', 1)) AS e,
  regexp_extract(name, '(?i)\\b([0-9]{{1,2}})x([0-9]{{2,3}})', 1) AS xs, list_concat(regexp_extract_all(name, '(?i)\\b[0-9]{{1,2}}x([0-9]{{2,3}})', 1), regexp_extract_all(name, '(?i)\\b[0-9]{{1,2}}x[0-9]{{2,3}}-([0-9]{{2,3}})\\b', 1)) AS xe FROM m),
i AS (SELECT *, list_transform(e, lambda x: x::BIGINT) AS ei FROM n)
SELECT p_partkey, CASE WHEN season = '' THEN list_transform(xe, lambda x: format('S{{:02d}}E{{:02d}}', xs::BIGINT, x::BIGINT))
  WHEN len(ei) = 2 AND ei[2] > ei[1] + 1 AND contains(whole, '-') THEN list_transform(range(ei[1], ei[2] + 1), lambda x: format('S{{:02d}}E{{:02d}}', season::BIGINT, x))
  WHEN len(ei) = 2 AND ei[1] = ei[2] THEN [format('S{{:02d}}E{{:02d}}', season::BIGINT, ei[1])]
  ELSE list_transform(ei, lambda x: format('S{{:02d}}E{{:02d}}', season::BIGINT, x)) END AS codes FROM i""")
def filename_codes(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", X.filename_codes(F.col("name")).alias("codes"))


@query(f"WITH t AS ({_NAMES}) SELECT p_partkey, regexp_extract(name, '{X.QUALITY}', 1) AS quality FROM t")
def quality_tokens(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", X.quality_token(F.col("name")).alias("quality"))


@query("SELECT p_partkey, format('S{:02d}E{:02d}', p_size::BIGINT, p_partkey) AS code FROM part")
def code_format(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.episode_code(F.col("p_size"), F.col("p_partkey")).alias("code"))


_PARTS = "SELECT p_partkey, p_name, CASE p_partkey % 6 WHEN 0 THEN p_name || ' S01E02 - Part 2' WHEN 1 THEN p_name || ', Part II' WHEN 2 THEN p_name || ' Pt. 3 x' WHEN 3 THEN p_name || ' (Part one)' WHEN 4 THEN p_name || ' part two - part 4' ELSE p_name END AS stem FROM part"


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN NULL WHEN 4 THEN regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') || ' part two' WHEN 2 THEN regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') || ' x' ELSE regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') END AS key, CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 4 END::BIGINT AS n FROM part")
def part_markers(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("lodestone_part")
    stems = spark.sql(_PARTS.replace("FROM part", "FROM lodestone_part"))
    key, n = X.part_of(F.col("stem"))
    return stems.select("p_partkey", key.alias("key"), n.cast("long").alias("n"))


_COLON = "SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ': ' WHEN 1 THEN ':' ELSE ' 10:30 ' END || p_type AS name FROM part"


@query(f"WITH t AS ({_COLON}) SELECT p_partkey, replace(name, ':', '') AS deleted, replace(name, ':', '-') AS dash, replace(name, ':', ' -') AS space_dash, replace(name, ':', ' - ') AS space_dash_space, replace(replace(name, ': ', ' - '), ':', '-') AS smart, replace(name, ':', '~') AS custom FROM t")
def colon_modes(spark, sf_dir):
    c = F.col("p_partkey") % 3
    name = F.concat("p_name", F.when(c == 0, ": ").when(c == 1, ":").otherwise(" 10:30 "), "p_type")
    modes = {"deleted": "delete", "dash": "dash", "space_dash": "space_dash", "space_dash_space": "space_dash_space", "smart": "smart"}
    return table(spark, sf_dir, "part").select("p_partkey", *[X.replace_colons(name, m).alias(k) for k, m in modes.items()], X.replace_colons(name, "custom", "~").alias("custom"))


@query("SELECT p_partkey, rtrim(ltrim(replace(replace(replace(replace(replace(replace(replace(replace(' .' || p_name || '\\a/b<c>?*|\"d ', '\\', '+'), '/', '+'), '<', ''), '>', ''), '?', '!'), '*', '-'), '|', ''), '\"', ''), ' .'), ' ') AS token FROM part")
def illegal_chars(spark, sf_dir):
    raw = F.concat(F.lit(" ."), F.col("p_name"), F.lit('\\a/b<c>?*|"d '))
    return table(spark, sf_dir, "part").select("p_partkey", X.clean_token(raw).alias("token"))


# ---- pages
_H = "coalesce(html, '')"
for _t in ("script", "style"):
    _H = f"regexp_replace({_H}, '(?is)<{_t}\\b.*?</{_t}>', ' ', 'g')"
for _t in ("table", "div", "nav"):
    _H = f"regexp_replace({_H}, '(?is)<{_t}\\b[^>]*class=\"[^\"]*navbox.*?</{_t}>', ' ', 'g')"
_H = f"regexp_replace({_H}, '(?i)<br\\s*/?>|</p>|</dd>|</li>', chr(10), 'g')"
_H = "trim(regexp_replace(" + f"replace(replace({_UN}, '&copy;', '©'), '&middot;', '·')".format(f"regexp_replace({_H}, '<[^>]+>', ' ', 'g')") + ", '[ \\t]+', ' ', 'g'))"


@query(f"SELECT page_id, {_H} AS body FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_text(F.col("html")).alias("body"))


@query("""SELECT page_id, CASE WHEN h LIKE '%.example.org' AND regexp_matches(h, '^[a-z0-9-]+[.]example[.]org$') THEN regexp_extract(h, '^([a-z0-9-]+)[.]', 1) ELSE h END AS site, page
FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '(?i)^https?://', ''), '^([^/?]*)', 1)) AS h,
  trim(replace(url_decode(regexp_extract(regexp_extract(url || '/wiki/A_b%20c?x', '(?s)/wiki/(.*)$', 1), '^([^#?]*)', 1)), '_', ' ')) AS page FROM pages)""")
def url_normalise(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_site(url, "example.org").alias("site"), X.normalize_page(F.concat(url, F.lit("/wiki/A_b%20c?x"))).alias("page"))


@query("""WITH w AS (SELECT p_partkey, regexp_extract_all('the ' || lower(p_name) || ' and co', '[a-z0-9]+') AS w FROM part),
b AS (SELECT p_partkey, w, w[2:] AS b, list_filter(w[2:], lambda x: x != 'and') AS a FROM w)
SELECT p_partkey, list_filter(list_distinct_ordered, lambda s: len(s) >= 3 AND s NOT IN ('the', 'and', 'show')) AS slugs FROM (
SELECT p_partkey, list_transform(list_filter(list_zip(c, range(1, len(c) + 1)), lambda z: list_position(c, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered FROM (
SELECT p_partkey, [array_to_string(w, ''), array_to_string(b, ''), array_to_string(w, '-'), array_to_string(b, '-'), array_to_string(a, '-'), array_to_string(a, ''),
  a[1], array_to_string(a[1:2], ''), array_to_string(a[1:2], '-'), array_to_string(b, '') || 'wiki', array_to_string(a, '') || 'wiki'] AS c FROM b))""")
def wiki_slugs(spark, sf_dir):
    name = F.concat(F.lit("The "), F.col("p_name"), F.lit(" & Co (2020)"))
    return table(spark, sf_dir, "part").select("p_partkey", X.slug_candidates(name).alias("slugs"))


# ---- timed text: turns of a conversation as cues of 4.5 s every 5 s
_SRT = "string_agg((turn + 1) || chr(10) || format('{:02d}:{:02d}:{:02d},{:03d} --> {:02d}:{:02d}:{:02d},{:03d}', turn * 5 // 3600, turn * 5 // 60 % 60, turn * 5 % 60, 0, (turn * 5 + 4) // 3600, (turn * 5 + 4) // 60 % 60, (turn * 5 + 4) % 60, 500) || chr(10) || '<i>' || text || '</i> [door] (sighs) ♪', chr(10) || chr(10) ORDER BY turn)"


def _talk(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def _stamp(sec, frac, sep=","):
    return F.format_string(f"%02d:%02d:%02d{sep}%s", F.floor(sec / 3600).cast("long"), F.floor(sec / 60).cast("long") % 60, sec % 60, F.lit(frac))


_CLEAN = "trim(regexp_replace(regexp_replace(" + _UN.format("regexp_replace(text, '<[^>]+>|\\{[^}]*\\}', ' ', 'g')") + ", '\\[[^\\]]*\\]|\\([^)]*\\)|♪', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"


@query(f"SELECT conv_id, (turn * 5)::DOUBLE AS start, (turn * 5 + 4.5)::DOUBLE AS \"end\", {_CLEAN} AS text FROM conversations WHERE {_CLEAN} != ''")
def srt_parse(spark, sf_dir):
    turn = F.col("turn").cast("long")
    block = F.concat_ws("\n", turn + 1, F.concat(_stamp(turn * 5, "000"), F.lit(" --> "), _stamp(turn * 5 + 4, "500")), F.concat(F.lit("<i>"), "text", F.lit("</i> [door] (sighs) ♪")))
    files = _talk(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(turn.alias("t"), block.alias("b")))).alias("x"))
    files = files.select("conv_id", F.array_join(F.transform("x", lambda y: y["b"]), "\n\n").alias("raw"))
    return subtitles.parse_srt(files, "conv_id")


@query(f"SELECT conv_id, (turn * 5)::DOUBLE AS start, (turn * 5 + 4.5)::DOUBLE AS \"end\", {_CLEAN} AS text FROM (SELECT conv_id, turn, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM conversations) WHERE {_CLEAN} != ''")
def ass_parse(spark, sf_dir):
    turn = F.col("turn").cast("long")
    line = F.concat(F.lit("Dialogue: 0,"), _stamp(turn * 5, "00", "."), F.lit(","), _stamp(turn * 5 + 4, "50", "."), F.lit(",Main,{\\b1}"), F.translate("text", "\n\r", "  "))
    files = _talk(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(turn.alias("t"), line.alias("b")))).alias("x"))
    head = F.lit("[Script Info]\n[Events]\nFormat: Layer, Start, End, Style, Text\n")
    files = files.select("conv_id", F.concat(head, F.array_join(F.transform("x", lambda y: y["b"]), "\n")).alias("raw"))
    return subtitles.parse_ass(files, "conv_id")


@query(f"SELECT conv_id, turn, {_CLEAN} AS cleaned FROM conversations")
def cue_clean(spark, sf_dir):
    return _talk(spark, sf_dir).select("conv_id", "turn", X.clean_cue(F.col("text")).alias("cleaned"))


@query("SELECT event_id, format('{}:{:02d}', event_id // 60, event_id % 60) AS short, format('{}:{:02d}:{:02d}', event_id // 3600, event_id // 60 % 60, event_id % 60) AS long FROM events")
def clock_format(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", X.clock(e).alias("short"), X.clock(e, True).alias("long"))


# ---- transcripts: a conversation as a page, one labelled line a turn
_PAGE = "SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || replace(replace(text, chr(10), ' '), chr(13), ' ') || ' [waves]', chr(10) ORDER BY turn) AS page FROM conversations GROUP BY conv_id"
_SPK = X.SPEAKER.replace("'", "''")


def _pages(spark, sf_dir):
    line = F.concat(F.upper(F.left("role", F.lit(1))), F.substring(F.col("role"), F.lit(2), F.length("role")), F.lit(": "), F.translate("text", "\n\r", "  "), F.lit(" [waves]"))
    pages = _talk(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("b")))).alias("x"))
    return pages.select("conv_id", F.array_join(F.transform("x", lambda y: y["b"]), "\n").alias("page"))


@query(f"WITH p AS ({_PAGE}), l AS (SELECT conv_id, list_filter(string_split(page, chr(10)), lambda x: len(trim(x)) > 3) AS l FROM p) SELECT conv_id, len(list_filter(l, lambda x: regexp_matches(x, '{_SPK}')))::BIGINT AS labelled, len(l)::BIGINT AS total FROM l")
def transcript_stats(spark, sf_dir):
    labelled, total = X.transcript_lines(F.col("page"))
    return _pages(spark, sf_dir).select("conv_id", labelled.alias("labelled"), total.alias("total"))


_CLEANED = f"""WITH p AS ({_PAGE}), l AS (SELECT conv_id, string_split(page, chr(10)) AS l FROM p),
s AS (SELECT conv_id, l, len(list_filter(l, lambda x: len(trim(x)) > 3 AND regexp_matches(x, '{_SPK}'))) AS n, len(list_filter(l, lambda x: len(trim(x)) > 3)) AS t FROM l),
c AS (SELECT conv_id, n, CASE WHEN n >= 10 AND n >= 0.3 * t THEN list_transform(list_filter(l, lambda x: regexp_matches(x, '{_SPK}')), lambda x: regexp_extract(x, '{_SPK}', 2)) ELSE list_filter(l, lambda x: NOT regexp_matches(x, '(?:[^|\\n]{{2,80}}\\|){{3,}}')) END AS o FROM s),
d AS (SELECT conv_id, n, trim(regexp_replace(regexp_replace(array_to_string(list_transform(o, lambda x: regexp_replace(x, '\\[[^\\]]*\\]|\\{{\\{{[^}}]*\\}}\\}}', ' ', 'g')), ' '), '\\([^)]{{0,80}}\\)', ' ', 'g'), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS cleaned FROM c)"""


@query(_CLEANED + " SELECT conv_id, cleaned FROM d")
def transcript_clean(spark, sf_dir):
    return _pages(spark, sf_dir).select("conv_id", X.clean_transcript(F.col("page")).alias("cleaned"))


@query(_CLEANED + ", w AS (SELECT conv_id, n, len(regexp_extract_all(cleaned, '[^ \\t\\n\\v\\f\\r]+')) AS w FROM d) SELECT conv_id, CASE WHEN n >= 5 AND w >= 150 THEN '' WHEN n < 5 AND w >= 600 THEN '' ELSE 'short' END AS reason FROM w")
def transcript_gate(spark, sf_dir):
    return _pages(spark, sf_dir).select("conv_id", X.transcript_gate(F.col("page"), 150, 5).alias("reason"))


@query("SELECT doc_id, CASE WHEN len(text) <= 3000 THEN text ELSE text[1:1000] || ' … ' || substring(text, (len(text) // 2 - 500) + 1, 1000) || ' … ' || right(text, 1000) END AS excerpt FROM documents")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.excerpt(F.col("text"), 3000).alias("excerpt"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 != 0 THEN format('S01E{:02d}', p_partkey) END AS code, CASE WHEN p_partkey % 3 != 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE round(p_retailprice, 2) END END AS confidence, CASE WHEN p_partkey % 3 != 0 THEN p_name END AS reason FROM part""")
def llm_reply_parse(spark, sf_dir):
    """A third of the answers name an episode that isn't a candidate; half have no number for their confidence."""
    k = F.col("p_partkey")
    sure = F.when(k % 2 == 0, "high").otherwise((F.col("p_retailprice") + 0.0001).cast("string"))
    reply = F.concat(F.lit("<think>maybe {1}</think>Sure: "), F.to_json(F.struct(F.lower(X.episode_code(F.lit(1), k)).alias("episode"), sure.alias("confidence"), F.col("p_name").alias("reason"))), F.lit(" done"))
    candidates = F.array(F.when(k % 3 != 0, X.episode_code(F.lit(1), k)).otherwise("S99E99"))
    code, confidence, reason = X.model_reply(reply, candidates)
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), confidence.alias("confidence"), reason.alias("reason"))


@query("SELECT o_orderkey, sha1(o_orderkey || '|' || o_orderstatus) AS key FROM orders")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", cache_key("o_orderkey", "o_orderstatus").alias("key"))
