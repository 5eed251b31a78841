"""Which rows come first in each group by a stable order, found by cut points instead of a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.columns import match_nulls
from tablewarden.functions.scratch import materialise

#: Hexadecimal digits that a round of counting adds, and rows of a range that are listed by key instead of counted further.
DIGITS, LISTED = 3, 1000
KEY_DIGITS = 32


def order_key(row_id: str, seed: int) -> Column:
    """MD5(seed:row_id), a null id as an empty text: 32 digits whose order is the stable order of rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row_id).cast("string"), F.lit(""))))


def cut_points(rows: DataFrame, group: str, wanted: dict) -> dict:
    """(group value, name) -> (key, rows wanted among those of this very key, rows of this key).

    rows has the group and _key. wanted has (group value, name) -> rank from 1 on. A round counts rows by the leading digits of
    their keys, sums the counts up and keeps the ranges that hold a wanted rank; the next one counts only these by more digits.
    What comes to the driver has a row per wanted rank, and at last the keys of ranges of LISTED rows.
    """
    spark = rows.sparkSession
    kind = rows.schema[group].dataType.simpleString()
    left = [(g, n, r, "") for (g, n), r in wanted.items() if r > 0]
    digits = 0
    while left and digits < KEY_DIGITS:
        held = spark.createDataFrame(sorted({(g, p) for g, _, _, p in left}, key=str), f"g {kind}, _prefix string")
        held = held.withColumnRenamed("g", group)
        inside = match_nulls(rows.withColumn("_prefix", F.substring("_key", 1, digits)), F.broadcast(held), [group, "_prefix"], "inner")
        digits = min(KEY_DIGITS, digits + DIGITS)
        counts = inside.groupBy(group, "_prefix", F.substring("_key", 1, digits).alias("_next")).agg(F.count("*").alias("n"))
        ahead = Window.partitionBy(group, "_prefix").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        summed = counts.withColumn("_ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        asked = spark.createDataFrame(left, f"g {kind}, name string, rank long, _prefix string").withColumnRenamed("g", group)
        found = match_nulls(summed, F.broadcast(asked), [group, "_prefix"], "inner").filter("rank > _ahead AND rank <= _ahead + n").collect()
        left = [(r[group], r.name, r.rank - r._ahead, r._next) for r in found]
        if max((r.n for r in found), default=0) <= LISTED:
            break
    if not left:
        return {}
    held = spark.createDataFrame(sorted({(g, p) for g, _, _, p in left}, key=str), f"g {kind}, _prefix string").withColumnRenamed("g", group)
    inside = match_nulls(rows.withColumn("_prefix", F.substring("_key", 1, digits)), F.broadcast(held), [group, "_prefix"], "inner")
    keys: dict = {}
    for r in inside.groupBy(group, "_prefix", "_key").agg(F.count("*").alias("n")).collect():
        keys.setdefault((r[group], r._prefix), []).append((r._key, r.n))
    out = {}
    for g, name, rank, prefix in left:
        for key, n in sorted(keys[g, prefix]):
            if rank <= n:
                out[g, name] = (key, rank, n)
                break
            rank -= n
    return out


def place(df: DataFrame, group: str, row_id: str, seed: int, wanted: dict, out: str) -> DataFrame:
    """df with out: the name of the part that a row falls in, "" behind the last.

    wanted has for each group value the parts in order with the rank where each ends: {group value: [(name, rank), ...]}. Rows are compared
    with the cut points of their group, so nothing is sorted or moved. Only where rows of one id lie on both sides of a cut
    are these written and numbered, task by task.
    """
    spark = df.sparkSession
    whole = df.select(F.struct("*").alias("_row"), F.col(group).alias("_g"), order_key(row_id, seed).alias("_key"))
    cuts = cut_points(whole.select("_g", "_key"), "_g", {(g, name): rank for g, parts in wanted.items() for name, rank in parts})
    kind = df.schema[group].dataType.simpleString()
    names = list(dict.fromkeys(name for parts in wanted.values() for name, _ in parts))
    if not names:
        return df.select("*", F.lit("").alias(out))
    entry = "struct<key:string,take:long,n:long>"
    table = [(g, *[cuts.get((g, name)) for name in names]) for g in wanted]
    held = spark.createDataFrame(table, f"_g {kind}, " + ", ".join(f"c{i} {entry}" for i in range(len(names))))  # a row per group
    met = match_nulls(whole, F.broadcast(held), ["_g"], "left")

    def at(i: int, tie: Column) -> Column:
        cut = F.col(f"c{i}.key")
        return F.when((F.col("_key") < cut) | ((F.col("_key") == cut) & (tie <= F.col(f"c{i}.take"))), F.lit(names[i]))

    def part(tie: Column) -> Column:
        return F.coalesce(*[at(i, tie) for i in range(len(names))], F.lit("")).alias(out)

    split = F.lit(False)
    for i in range(len(names)):
        split = split | F.coalesce((F.col("_key") == F.col(f"c{i}.key")) & (F.col(f"c{i}.take") < F.col(f"c{i}.n")), F.lit(False))
    if all(take == n for _, take, n in cuts.values()):
        return met.select("_row.*", part(F.lit(0)))
    ties = materialise(met.filter(split).withColumn("_task", F.spark_partition_id()), "cut-ties")
    before = Window.partitionBy("_g", "_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = ties.groupBy("_g", "_key", "_task").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_g", "_key", "_task").orderBy(F.xxhash64("_row")))
    numbered = match_nulls(ties.withColumn("_at", within), counts, ["_g", "_key", "_task"], "inner").withColumn("_at", F.col("_at") + F.col("_before"))
    return met.filter(~split).select("_row.*", part(F.lit(0))).unionByName(numbered.select("_row.*", part(F.col("_at"))))
