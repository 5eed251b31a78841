"""Exact quantiles by distributed selection."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.operators import profile, quantiles

INF = math.inf


def plain(values, shares):
    own = [v for v in values if v is not None and not math.isnan(v)]
    out = []
    for s in shares:
        at = sorted(own)
        p = s * (len(at) - 1)
        low, high = at[math.floor(p)], at[math.ceil(p)]
        out.append(low if low == high else (math.floor(p) + 1 - p) * low + (p - math.floor(p)) * high)
    return out


@pytest.mark.parametrize("small", [1 << 20, 1])
def test_selection_equals_sorting(spark, monkeypatch, small):
    """Signs, zeros, subnormals, infinities, powers of two and their neighbours, copies, nulls; with ranges cut to the last bit."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    draw = random.Random(small)
    near = [math.nextafter(2.0**k, d) for k in range(-3, 60, 7) for d in (0, INF)] + [2.0**k for k in range(-1074, 1024, 97)]
    columns = {
        "a": [draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(500)] + [0.0, -0.0, 5e-324, -5e-324, INF, -INF],
        "b": near * 3 + [None, math.nan],
        "c": [7.25] * 400 + [draw.random() for _ in range(100)],
        "d": [None] * 506,
        "e": [1.0],
        "f": [1 + k * 2.0**-52 for k in range(300)],
    }
    size = max(map(len, columns.values()))
    rows = list(zip(*[(v + [None] * size)[:size] for v in columns.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    counts = {c: sum(v is not None and not math.isnan(v) for v in vs) for c, vs in columns.items()}
    got = quantiles.quantiles(df, list(columns), shares, counts)
    assert got["d"] == [None] * 7
    assert all(got[c] == plain(columns[c], shares) for c in columns if c != "d")


def test_ranges_keep_the_order(spark):
    draw = random.Random(1)
    values = sorted({draw.choice([-1, 1]) * 10 ** draw.uniform(-320, 308) for _ in range(3000)} | {0.0, INF, -INF} | {s * 2.0**k for k in range(-1074, 1024) for s in (-1, 1)})
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    for bits in quantiles.ROUNDS:
        keys = [tuple(r.k) for r in df.select(quantiles.range_of(F.col("x"), bits).alias("k")).collect()]
        assert keys == sorted(keys)


def test_millions_of_distinct_values(spark, caplog):
    """Five million distinct values in three columns, one of them mostly one value: the plans hold no percentile, and it comes out exact."""
    n = 5_000_000
    df = spark.range(0, n, 1, 8).select(
        (F.col("id") * 7919 % n).cast("double").alias("a"), F.sin(F.col("id").cast("double")).alias("b"), F.when(F.col("id") % 3 == 0, F.lit(1.5)).otherwise(F.col("id") / 7).alias("c"),
    )
    got = {r.column_name: r for r in profile.describe(df, ["a", "b", "c"]).collect()}
    i = np.arange(n)
    for c, v in (("a", i.astype(float)), ("b", None), ("c", np.where(i % 3 == 0, 1.5, i / 7))):
        if v is None:
            v = np.array(df.select("b").toArrow().column("b").to_numpy())
        v = np.sort(v)
        for k, p in ((1, "p25"), (2, "p50"), (3, "p75")):
            at = k * (n - 1) / 4
            low, high = v[int(at)], v[int(np.ceil(at))]
            assert got[c][p] == (low if low == high else (int(at) + 1 - at) * low + (at - int(at)) * high)
    assert "percentile" not in open(quantiles.__file__).read() + open(profile.__file__).read()
