"""Stratified parts by cut points: exact sizes, the same rows as a sort gives, ties, no sort in the plan."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import cuts, splits


@pytest.mark.parametrize("listed", [1000, 1])
def test_parts_are_those_of_a_sort(spark, monkeypatch, listed):
    monkeypatch.setattr(cuts, "LISTED", listed)
    rows = [(i, ["a", "b", None][i * i % 3 if i % 3 else 2], i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, c string, x int").withColumn("_key", F.lit("clash")).repartition(5)
    wanted = {"a": [("one", 0), ("two", 100)], "b": [("one", 313), ("two", 400)], None: [("one", 1), ("two", 10**6)]}
    got = {r.row_id: r.part for r in cuts.place(df, "c", "row_id", 42, wanted, "part").collect()}
    for g, parts in wanted.items():
        ids = sorted((i for i, c, _ in rows if c == g), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        first, second = (r for _, r in parts)
        last = second if second <= len(ids) else first  # a rank that no row has is no cut
        assert [got[i] for i in ids] == ["one" if k < first else "two" if k < last else "" for k in range(len(ids))]


def test_ids_on_both_sides_of_a_cut(spark):
    """One id fills most of a class: the counts stay exact, rows that are alike may be any of them."""
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("row_id"), F.lit("a").alias("c"), (F.col("id") % 2).alias("x")).repartition(6)
    parts = cuts.place(df, "c", "row_id", 1, {"a": [("t", 300), ("v", 900)]}, "part")
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"t": 300, "v": 600, "": 1100}
    sample = splits.stratified_sample(df, "c", "row_id", 777)
    assert sample.count() == 777 and sample.columns == df.columns


def test_split_has_no_sort(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    out = splits.stratified_split(df, "c", "row_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Exchange hashpartitioning" not in plan
    assert Counter(r.split for r in out.collect()) == {"test": 600, "validation": 600, "train": 2800}
    assert splits.stratified_split(df.limit(0), "c", "row_id").count() == 0
