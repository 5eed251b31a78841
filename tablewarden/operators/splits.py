"""Stratified splits and samples of exact sizes, and overlap between partitions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.operators.contract import ContractError
from tablewarden.operators.cuts import place

SEED = 42


def _quota(counts: DataFrame, label: str, size: str, of: str, out: str) -> DataFrame:
    """size places shared among classes in proportion to column of, by largest remainder, ties by class name.

    Exact decimals throughout; only the table of classes is sorted in one place.
    """
    n, k = F.col(of).cast("decimal(19,0)"), F.col(size).cast("decimal(19,0)")
    everything = Window.partitionBy()
    total = F.sum(of).over(everything).cast("decimal(19,0)")
    rows = counts.withColumns({"_floor": F.expr(f"cast({size} as decimal(19,0)) * cast({of} as decimal(19,0)) div sum({of}) over ()").cast("long"), "_rest": (k * n) % total})
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), label))
    rows = rows.withColumn("_place", place).withColumn(out, F.col("_floor") + (F.col("_place") <= F.col(size) - F.sum("_floor").over(everything)).cast("long"))
    return rows.drop("_floor", "_rest", "_place")


def stratified_split(df: DataFrame, label: str, row_id: str, seed: int = SEED) -> DataFrame:
    """df with split: 15 % test, then 15/85 of the rest validation, the rest train; sizes are rounded up.

    Per class the parts are proportional (largest remainder); within a class the order of MD5(seed:row_id) decides,
    so the result depends neither on partitions nor on the order of rows. No row is sorted or shuffled: the keys at the ends of
    the parts are found by counting, and each row is compared with them.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    counts = counts.withColumn("n_test", F.expr("(15 * sum(n) over () + 99) div 100"))
    counts = _quota(counts, label, "n_test", "n", "test").withColumn("left_over", F.col("n") - F.col("test"))
    counts = counts.withColumn("n_validation", F.floor((15 * (total - F.col("n_test")) + 84) / 85))
    quota = _quota(counts, label, "n_validation", "left_over", "validation").select(label, "test", "validation").collect()  # a row per class
    parts = place(df, label, row_id, seed, {r[label]: [("test", r.test), ("validation", r.test + r.validation)] for r in quota}, "split")
    return parts.withColumn("split", F.when(F.col("split") == "", "train").otherwise(F.col("split")))


def stratified_sample(df: DataFrame, label: str, row_id: str, rows: int, seed: int = SEED) -> DataFrame:
    """rows rows of df, proportional by class; all of df if it has no more. A class that would be lost is an error.

    Rows are compared with the key at which their class's share ends; none is sorted or shuffled.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    quota = _quota(counts.withColumn("_rows", F.least(F.lit(rows).cast("long"), F.sum("n").over(Window.partitionBy()))), label, "_rows", "n", "take").collect()  # a row per class
    if lost := [r[label] for r in quota if r["take"] == 0]:
        raise ContractError(f"A sample of {rows} rows loses the classes {sorted(map(str, lost))}")
    return place(df, label, row_id, seed, {r[label]: [("in", r["take"])] for r in quota}, "__part").filter("__part = 'in'").drop("__part")


def overlap(df: DataFrame, columns: list[str], split: str, splits: list[str]) -> DataFrame:
    """pair, n_shared: distinct keys (null equal to null) that two splits have in common, for every pair of splits.

    One aggregate to a row per key with the splits that hold it; no key is compared pair by pair.
    """
    held = df.groupBy(*columns).agg(*[F.max((F.col(split) == s).cast("int")).alias(f"in_{s}") for s in splits])
    pairs = list(combinations(splits, 2))
    one = held.agg(*[F.count(F.when((F.col(f"in_{a}") == 1) & (F.col(f"in_{b}") == 1), 1)).alias(f"{a}/{b}") for a, b in pairs])
    return one.unpivot([], [f"{a}/{b}" for a, b in pairs], "pair", "n_shared")
