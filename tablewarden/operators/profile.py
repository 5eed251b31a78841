"""Profiles of a table: types, missing and infinite values, summaries, class distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.columns import count_if, infinite, missing, without_nan
from tablewarden.operators.quantiles import quantiles

LABEL_NAMES = ("label", "class", "attack", "attack type", "attack_type", "target")
#: Columns that one aggregate takes at once; a wider table is profiled in several passes of generated code.
COLUMNS_AT_ONCE = 60


def label_candidates(df: DataFrame, names: tuple[str, ...] = LABEL_NAMES) -> list[str]:
    """Columns whose lower-cased name is one of names."""
    return [c for c in df.columns if c.lower() in names]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame, label: str, others: tuple[str, ...] = ()) -> list[str]:
    """All columns but the label and others, in order."""
    return [c for c in df.columns if c != label and c not in others]


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def _by_column(df: DataFrame, columns: list[str], figures: dict[str, callable]) -> DataFrame:
    """(column_name, figures...) of one aggregate over the table, turned to a row per column."""
    parts = []
    for i in range(0, len(columns), COLUMNS_AT_ONCE):
        some = columns[i : i + COLUMNS_AT_ONCE]
        one = df.agg(*[F.struct(*[f(c).alias(k) for k, f in figures.items()]).alias(c) for c in some])
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}`.{k}").alias(k) for k in figures]) for c in some])).alias("_r"))
        parts.append(rows.select("_r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_nonnull(df: DataFrame) -> DataFrame:
    """column_name, data_type, n_nonnull (NaN counts as missing)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return _by_column(df, df.columns, {"data_type": lambda c: F.first(F.lit(kinds[c])), "n_nonnull": lambda c: count_if(~missing(df, c))}).select(
        "column_name", F.coalesce("data_type", F.lit("")).alias("data_type"), "n_nonnull"
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, mean, std (of a sample), min, p25, p50, p75, max; exact quantiles between neighbours; NaN is skipped.

    Two or three passes: one aggregate for all but the quantiles, then a distributed selection (quantiles.py).
    """

    def value(c: str) -> Column:
        return without_nan(df, c).cast("double")

    figures = _by_column(
        df,
        columns,
        {"n": lambda c: F.count(value(c)), "mean": lambda c: F.avg(value(c)), "std": lambda c: F.stddev_samp(value(c)), "min": lambda c: F.min(value(c)), "max": lambda c: F.max(value(c))},
    ).collect()  # a row per column
    parts = quantiles(df, columns, [0.25, 0.5, 0.75], {r.column_name: r.n for r in figures})
    rows = [(r.column_name, r.n, r.mean, r.std, r.min, *parts[r.column_name], r.max) for r in figures]
    return df.sparkSession.createDataFrame(rows, "column_name string, n long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def missing_counts(df: DataFrame, top: int | None = 20) -> DataFrame:
    """column_name, n of missing values, worst first; only columns that have any."""
    rows = _by_column(df, df.columns, {"n": lambda c: count_if(missing(df, c))}).filter("n > 0").orderBy(F.desc("n"), "column_name")
    return rows.limit(top) if top else rows


def infinite_counts(df: DataFrame, top: int | None = 20) -> DataFrame:
    """column_name, n of infinite values, worst first; only columns that have any."""
    rows = _by_column(df, numeric_columns(df), {"n": lambda c: count_if(infinite(df, c))}).filter("n > 0").orderBy(F.desc("n"), "column_name")
    return rows.limit(top) if top else rows


def class_distribution(df: DataFrame, label: str, with_null: bool = True) -> DataFrame:
    """label, n, pct, largest first; a null class is counted unless with_null is off."""
    counts = (df if with_null else df.filter(F.col(label).isNotNull())).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select(label, "n", F.round(F.lit(100.0) * F.col("n") / total.scalar(), 6).alias("pct")).orderBy(F.desc("n"), label)


def class_distribution_ordered(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """class_pos, label, n in the given order; absent classes have 0, unknown ones follow by name."""
    spark = df.sparkSession
    known = spark.createDataFrame(list(enumerate(classes)), f"class_pos int, {label} string")
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    rows = known.join(counts, label, "full_outer")
    return rows.select(F.coalesce("class_pos", F.lit(len(classes))).alias("class_pos"), label, F.coalesce("n", F.lit(0)).alias("n")).orderBy("class_pos", label)


def split_distribution(df: DataFrame, label: str, split: str, splits: list[str]) -> DataFrame:
    """label, pct_whole and pct_<split> of each class, by class name."""
    counts = df.groupBy(label).agg(F.count("*").alias("n_whole"), *[count_if(F.col(split) == s).alias(f"n_{s}") for s in splits])
    names = ["whole", *splits]
    totals = counts.agg(*[F.sum(f"n_{s}").alias(f"t_{s}") for s in names])
    pct = [F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col(f"n_{s}"), totals.select(f"t_{s}").scalar()), F.lit(0.0)), 6).alias(f"pct_{s}") for s in names]
    return counts.select(label, *pct).orderBy(label)


def split_sizes(df: DataFrame, split: str) -> DataFrame:
    """split, n, pct."""
    counts = df.groupBy(split).agg(F.count("*").alias("n"))
    return counts.select(split, "n", F.round(F.lit(100.0) * F.col("n") / counts.agg(F.sum("n")).scalar(), 6).alias("pct")).orderBy(split)
