"""The filter of rows that may repeat, and the audit that shuffles only these."""

import math
import re

from pyspark.sql import functions as F

from tablewarden.functions import repeats
from tablewarden.operators import overlap


def test_every_repeated_row_is_flagged_and_few_others(spark):
    alone = spark.range(60000).select(F.col("id").cast("double").alias("a"), F.lit("x").alias("b"))
    hot = spark.range(20000).select(F.lit(-1.0).alias("a"), F.lit("hot").alias("b"))
    twice = spark.range(3000).select((F.col("id") % 1500 + 0.5).alias("a"), F.lit(None).cast("string").alias("b"))
    odd = spark.createDataFrame([(0.0, "z"), (-0.0, "z"), (math.nan, None), (math.nan, None), (None, None), (None, None), (None, "only")], "a double, b string")
    df = alone.unionByName(hot).unionByName(twice).unionByName(odd).withColumn("_b", F.lit("clash"))
    marked = repeats.may_repeat(df, ["a", "b"])
    counts = marked.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(repeats.FLAG).alias("all"), F.max(repeats.FLAG).alias("any"))
    got = counts.agg(F.expr("count_if(n > 1 AND NOT all)"), F.expr("count_if(n = 1 AND any)"), F.expr("count_if(n = 1)"), F.sum("n")).first()
    assert got[0] == 0 and got[1] < got[2] / 10 and got[3] == df.count() and marked.columns == [*df.columns, repeats.FLAG]


def test_a_full_filter_stays_right(spark, monkeypatch):
    """More repeated keys than slots: everything passes, nothing is lost."""
    monkeypatch.setattr(repeats, "MOST_BITS", repeats.PAGE)
    df = spark.range(200000).select((F.col("id") % 100000).alias("a"))
    assert repeats.may_repeat(df, ["a"]).filter(~F.col(repeats.FLAG)).count() == 0
    assert repeats.may_repeat(df.limit(0), ["a"]).count() == 0
    assert repeats.may_repeat(spark.range(10), ["id"]).filter(repeats.FLAG).count() == 0


def test_rows_that_equal_some(spark):
    df = spark.range(1000).select((F.col("id") % 700).alias("a"), (F.col("id") < 500).alias("train"))
    got = repeats.may_repeat(df, ["a"], "train")
    assert got.filter("a < 500").filter(~F.col(repeats.FLAG)).count() == 0 and got.filter("a >= 500").filter(repeats.FLAG).count() < 60


def test_the_audit_shuffles_only_what_may_repeat(spark):
    """With broadcasts by statistics off no join shuffles wide rows; they meet in one exchange behind the filter."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(5000).select((F.col("id") % 4900).alias("a"), F.col("id").alias("b") % 4900, F.lit("l").alias("label"), F.when(F.col("id") % 5 == 0, "validation").otherwise("train").alias("split"))
        df = df.toDF("a", "b", "label", "split")
        vectors = overlap.vector_counts(df, ["a", "b"], "label", "split")
        plan = vectors._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and len(re.findall(r"Exchange hashpartitioning\(a", plan)) <= 2
        assert vectors.count() == 4900 and overlap.cross_split_overlap(vectors).first().n_shared == sum((i % 5 == 0) != ((i + 4900) % 5 == 0) for i in range(100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
