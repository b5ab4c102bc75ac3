"""URL filtering: host and path rules, and gradient-boosted trees for what no rule decides.

Rules are host/path strings that fit a host, its subdomains and all paths with their prefix; the
longest that fits wins. URLs that rules decide are the labelled ones: a bounded sample of them
(`sample_rows`, those with the smallest hashes) trains gradient-boosted trees on lexical features:
lengths, path depth, digit ratio, character entropy, parameter counts, and statistics of suffixes
(of the host and of the last path part), which are counted over all labelled URLs. URLs that train
the trees get the statistics of the labelled URLs outside their own fold, one of `FOLDS`, so that
no URL's label is among its features.

Defined cases: null url or one without `://`: host and path empty, no rule, the trees' verdict;
no labelled URL or only one kind: that verdict for all (allow if there is none); null page_id and
repeated rows: kept as they are; no rows: no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "host_labels", "depth", "path_length", "digit_ratio", "entropy", "parameters", "fragment", "secure")


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules) -> Column:
    """verdict and rule of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, prefix = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


FOLDS = 5


def _count(text: Column, what: str) -> Column:
    """How many characters of `text` are among `what`."""
    return (F.length(text) - F.length(F.translate(text, what, ""))).cast("double")


def lexical(url: Column, host: Column, path: Column) -> Column:
    """The values of FEATURES for a URL."""
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    share = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c != "", (n - F.length(F.replace(url, c, F.lit("")))) / n))
    entropy = F.aggregate(share, F.lit(0.0), lambda a, x: a - F.coalesce(x * F.log2(x), F.lit(0.0)))
    query = F.regexp_extract(url, r"(?s)^[^?]*\?([^#]*)", 1)
    some = lambda x: (x != "").cast("double")
    values = [
        n, F.length(host), _count(host, ".") + some(host), _count(F.regexp_replace(path, "/+$", ""), "/"), F.length(path),
        F.when(path == "", 0.0).otherwise(_count(path, "0123456789") / F.length(path)), F.when(n == 0, 0.0).otherwise(entropy),
        _count(query, "&") + some(query), url.contains("#").cast("double"), url.startswith("https").cast("double"),
    ]
    return F.array(*[v.cast("double") for v in values])


def url_verdicts(pages: DataFrame, rules=RULES, sample_rows: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id, url), and the trees' block score."""
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("features", lexical(F.col("url"), F.col("host"), F.col("path")))
    urls = urls.withColumn("match", matched(F.col("host"), F.col("path"), rules))
    urls = urls.withColumn("top", F.substring_index("host", ".", -1)).withColumn("ending", F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})/?$", 1))
    urls = stored(urls.withColumn("h", F.xxhash64("url")).withColumn("fold", F.pmod("h", F.lit(FOLDS))), "urls")
    block = (F.col("match.verdict") == "block").cast("double")
    labelled = urls.where("match is not null")
    total = labelled.agg(F.count("*").alias("n"), F.sum(block).alias("b")).first()
    ruled = [F.col("page_id"), F.col("host"), F.col("path"), F.col("match.rule").alias("rule")]
    if not total["n"] or total["b"] in (0, total["n"]):
        own = F.lit("block" if total["n"] and total["b"] else "allow")
        return urls.select(*ruled, own.alias("verdict"), F.lit(None).cast("double").alias("score"))
    prior = total["b"] / total["n"]

    def rated(rows: DataFrame, column: str, apart: bool) -> DataFrame:
        """With how often labelled URLs of the row's suffix are blocked, drawn to the mean where there are
        few; `apart`: those of the row's own fold left out."""
        kinds = labelled.groupBy(column, "fold").agg(F.count("*").alias("n"), F.sum(block).alias("b"))
        if apart:
            folds = labelled.sparkSession.range(FOLDS).select(F.col("id").cast(rows.schema["fold"].dataType).alias("of"))
            kinds = kinds.crossJoin(F.broadcast(folds)).where("of != fold").groupBy(column, F.col("of").alias("fold")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        else:
            kinds = kinds.groupBy(column).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        key = [column, "fold"] if apart else [column]
        rate = kinds.select(*key, ((F.col("b") + 20 * prior) / (F.col("n") + 20)).alias(f"{column}_rate"))
        return rows.join(rate, key, "left").withColumn(f"{column}_rate", F.coalesce(f"{column}_rate", F.lit(prior)))

    def full(rows: DataFrame, apart: bool) -> DataFrame:
        for column in ("top", "ending"):
            rows = rated(rows, column, apart)
        return rows.withColumn("x", array_to_vector(F.concat("features", F.array("top_rate", "ending_rate"))))

    drawn = stored(labelled.select("h", "fold", "top", "ending", "features", "match").orderBy("h", "features").limit(sample_rows), "drawn")
    sample = stored(full(drawn, True).select("x", block.alias("label")).coalesce(1), "labelled")
    if sample.select("label").distinct().count() < 2:
        return urls.select(*ruled, F.coalesce("match.verdict", F.lit("block" if prior >= 0.5 else "allow")).alias("verdict"), F.lit(prior).alias("score"))
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2).fit(sample)
    scored = model.setProbabilityCol("p").transform(full(urls, False))
    score = vector_to_array("p")[1]
    verdict = F.coalesce("match.verdict", F.when(score >= 0.5, "block").otherwise("allow"))
    return scored.select(*ruled, verdict.alias("verdict"), score.alias("score"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))
