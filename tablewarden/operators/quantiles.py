"""Exact order statistics of many columns at once, by selection over ranges of the numbers' leading bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.columns import without_nan

#: Leading bits of the fraction that tell ranges apart, round by round; the last round tells doubles apart.
ROUNDS = (6, 18, 30, 42, 52)
#: A range of so many rows is put in order as it is; larger ones are cut further.
SMALL = 1 << 20


def range_of(x: Column, bits: int) -> Column:
    """A struct in the order of x: sign, power of two and so many bits of the fraction; infinities stand alone.

    The logarithm need not be exact: it never falls as x grows, and within one power the quotient never falls.
    """
    size = F.abs(x)
    power = F.floor(F.log2(size)).cast("long")
    fraction = F.floor((size / F.pow(F.lit(2.0), power) - 1) * float(1 << bits)).cast("long")
    sign = F.when(x == 0, 0).when(size == float("inf"), 2).otherwise(1) * F.when(x < 0, -1).otherwise(1)
    plain = F.abs(sign) == 1
    above = F.when(plain, sign * (power + 2000)).otherwise(F.lit(0)).cast("long")
    within = F.when(plain, sign * F.greatest(F.lit(0), F.least(fraction, F.lit((1 << bits) - 1)))).otherwise(F.lit(0)).cast("long")
    return F.struct(sign.cast("int").alias("s"), above.alias("p"), within.alias("f"))


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(c, x): every value that is neither null nor NaN, with its column's number."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), without_nan(df, name).cast("double").alias("x")) for i, name in enumerate(columns)])
    return df.select(F.explode(cells).alias("v")).select("v.c", "v.x").filter("x IS NOT NULL")


def _holding(counted: DataFrame, group: list[str], order: str, wanted: DataFrame) -> list:
    """The rows of counted (with n, and ahead: the rows before in the group) that hold a wanted rank of their group."""
    ahead = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = counted.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    return summed.join(F.broadcast(wanted), group).filter("rank >= ahead AND rank < ahead + n").collect()


def order_statistics(df: DataFrame, columns: list[str], ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The value at each wanted rank (from 0) of each column, null and NaN left out.

    A round counts the values of each column by range, sums up the counts along the ranges, and keeps the ranges that
    hold a wanted rank: as many as there are ranks. These are cut finer from round to round until they hold one
    value or at most SMALL rows, which are then counted by value. Counts are combined on the map side, so a value that fills
    a third of a column is one row a task. What comes to the driver are the ranges of the wanted ranks.
    """
    spark = df.sparkSession
    number = {name: i for i, name in enumerate(columns)}
    found: dict[tuple[str, int], float] = {}
    rows = _values(df, columns)
    open_ranks = spark.createDataFrame([(number[c], int(r)) for c in ranks for r in ranks[c]] or [(-1, 0)], "c int, rank long")
    group = ["c"]
    for bits, finer in zip(ROUNDS, (*ROUNDS[1:], None)):
        counted = rows.groupBy(*group, range_of(F.col("x"), bits).alias("k")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        holding = _holding(counted, group, "k", open_ranks)
        found |= {(columns[h.c], h.rank if len(group) == 1 else h.first): h.low for h in holding if h.low == h.high}
        left = [(h.c, h.k, h.rank if len(group) == 1 else h.first, h.rank - h.ahead, h.n) for h in holding if h.low != h.high]
        if not left:
            return found
        schema = f"c int, r {counted.schema['k'].dataType.simpleString()}, first long, rank long, n long"
        open_ranks = spark.createDataFrame(left, schema)
        ranges = F.broadcast(open_ranks.select("c", "r").distinct())  # as many as there are ranks at most
        rows = _values(df, columns).withColumn("r", range_of(F.col("x"), bits)).join(ranges, ["c", "r"])
        open_ranks, group = open_ranks.select("c", "r", "first", "rank"), ["c", "r"]
        if finer is None or max(x[4] for x in left) <= SMALL:
            break
    counted = rows.groupBy("c", "r", "x").agg(F.count("*").alias("n"))
    return found | {(columns[h.c], h.first): h.x for h in _holding(counted, group, "x", open_ranks)}


def quantiles(df: DataFrame, columns: list[str], shares: list[float], counts: dict[str, int]) -> dict[str, list[float | None]]:
    """For each column its quantiles at shares, between neighbours where a share falls between two; None for no values.

    counts has the number of values of each column that are neither null nor NaN.
    """
    places = {c: [s * (counts[c] - 1) for s in shares] for c in columns if counts[c]}
    ranks = {c: sorted({r for p in at for r in (int(p), -int(-p // 1))}) for c, at in places.items()}
    value = order_statistics(df, columns, ranks) if ranks else {}
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for c, at in places.items():
        ends = [(p, value[c, int(p)], value[c, -int(-p // 1)]) for p in at]
        out[c] = [low if low == high else (int(p) + 1 - p) * low + (p - int(p)) * high for p, low, high in ends]
    return out
