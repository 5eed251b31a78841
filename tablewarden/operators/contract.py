"""The contract of a training and a validation table: columns, types, missing and infinite values, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.columns import count_if, infinite, is_floating, missing


class ContractError(ValueError):
    """A table that doesn't meet the contract."""


def violations(df: DataFrame, features: list[str], label: str, split: str) -> DataFrame:
    """split, column_name, rule (missing, infinite, missing label), n, in one pass over the table; only n > 0.

    df holds both tables, told apart by the split column.
    """
    figures = [("missing", c, missing(df, c)) for c in features]
    figures += [("infinite", c, infinite(df, c)) for c in features if is_floating(df, c)]
    figures.append(("missing label", label, F.col(label).isNull()))
    one = df.groupBy(split).agg(*[count_if(test).alias(f"_{i}") for i, (_, _, test) in enumerate(figures)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"_{i}").alias("n")) for i, (rule, c, _) in enumerate(figures)])
    return one.select(split, F.inline(rows)).filter("n > 0")


def class_set(df: DataFrame, label: str, split: str, expected: list[str]) -> DataFrame:
    """split, class, status (missing or unexpected) of the classes in which each split differs from the expected set."""
    spark = df.sparkSession
    seen = df.filter(F.col(label).isNotNull()).select(split, F.col(label).alias("class")).distinct()
    wanted = seen.select(split).distinct().crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in expected], "class string")))
    both = seen.withColumn("seen", F.lit(True)).join(wanted.withColumn("wanted", F.lit(True)), [split, "class"], "full_outer")
    return both.filter("seen IS NULL OR wanted IS NULL").select(split, "class", F.when(F.col("seen").isNull(), "missing").otherwise("unexpected").alias("status"))


def unseen_classes(df: DataFrame, label: str, split: str, train: str, validation: str) -> DataFrame:
    """class: those of validation that training lacks."""
    of = lambda s: df.filter((F.col(split) == s) & F.col(label).isNotNull()).select(F.col(label).alias("class")).distinct()
    return of(validation).join(of(train), "class", "left_anti")


def validate(train: DataFrame, validation: DataFrame, label: str, expected_features: int | None, expected_classes: list[str] | None, others: tuple[str, ...] = (), failures: dict[str, DataFrame] | None = None) -> list[str]:
    """The feature columns of two tables that meet the contract; the first rule broken raises ContractError.

    Rules in order: label present; same features; same order; number of features; numeric, not boolean; then for
    training before validation: missing, infinite, missing labels, classes; at last no class unseen in training. The
    first five look at schemas only; the rest is one aggregate over both tables. Nothing is dropped or filled;
    negative sentinels are ordinary values. failures has, by "training" or "validation", what a reader couldn't cast
    (column_name, n): a feature with such cells is not numeric.
    """
    for name, df in (("training", train), ("validation", validation)):
        if label not in df.columns:
            raise ContractError(f"Target column {label!r} is missing from the {name} table")
    features = [c for c in train.columns if c != label and c not in others]
    theirs = [c for c in validation.columns if c != label and c not in others]
    if set(features) != set(theirs):
        raise ContractError(f"Features differ: only in training {sorted(set(features) - set(theirs))}, only in validation {sorted(set(theirs) - set(features))}")
    if features != theirs:
        raise ContractError("Features stand in a different order")
    if expected_features is not None and len(features) != expected_features:
        raise ContractError(f"Expected {expected_features} features, found {len(features)}")
    for name, df in (("training", train), ("validation", validation)):
        odd = [c for c in features if not isinstance(df.schema[c].dataType, T.NumericType)]
        if odd:
            raise ContractError(f"Non-numeric features in {name}: {odd}")
        failed = (failures or {}).get(name)
        if failed is not None and (odd := {c: n for c, n in failed.select("column_name", "n").collect() if c in features}):  # a row per column at most
            raise ContractError(f"Non-numeric features in {name}: {odd}")
    both = train.select(*features, label, F.lit("train").alias("_split")).unionByName(validation.select(*features, label, F.lit("validation").alias("_split")))
    found = [tuple(r) for r in violations(both, features, label, "_split").collect()]  # a row per column and rule at most
    classes = [tuple(r) for r in class_set(both, label, "_split", expected_classes).collect()] if expected_classes is not None else []
    for name in ("train", "validation"):
        for rule, says in (("missing", "NaN values"), ("infinite", "Infinite values"), ("missing label", "Missing labels")):
            if bad := {c: n for s, c, r, n in found if s == name and r == rule}:
                raise ContractError(f"{says} in {name}: {bad}")
        if bad := sorted((status, c) for s, c, status in classes if s == name):
            raise ContractError(f"Unexpected class set in {name}: {bad}")
    if bad := sorted(r[0] for r in unseen_classes(both, label, "_split", "train", "validation").collect()):
        raise ContractError(f"Classes in validation that training lacks: {bad}")
    return features
