"""What a name's steps say several times is computed once: the expressions stay small, the cuts right."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import naming as N


def test_the_first_bytes_end_with_a_whole_character(spark):
    texts = ["", "plain", "é", "aé", "日本語", "a😀b", "😀😀", None]
    rows = spark.createDataFrame([(t, n) for t in texts for n in (-2, 0, 1, 2, 3, 4, 5, 7, 8, 9)], "t string, n int")
    for t, n, got in rows.select("t", "n", N.left_bytes(F.col("t"), F.col("n"))).collect():
        want = None if t is None else t.encode()[: max(n, 0)].decode(errors="ignore")
        assert got == want, (t, n)


def test_a_file_name_names_its_input_a_few_times(spark):
    title = F.concat(F.col("id").cast("string"), F.lit("marker"))
    name = N.episode_file("{Series TitleYear} - S{season:00}E{episode:00} - {Episode Title}", F.lit("Show"), F.lit(""), F.lit(1), F.array(F.lit(2)), F.array(title), F.lit(None).cast("string"), F.lit(".mkv"))
    rows = spark.range(3).select(name.alias("name"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("marker") <= 3
    assert [r["name"] for r in rows.orderBy("name").collect()] == [f"Show - S01E02 - {k}marker.mkv" for k in range(3)]
