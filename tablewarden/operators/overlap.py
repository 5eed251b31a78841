"""The audit of feature vectors within and across two splits.

All figures come from one aggregate: vector_counts has a row per vector with what each split holds of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import count_if, match_nulls
from tablewarden.functions.repeats import FLAG, may_repeat
from tablewarden.operators.contract import ContractError

DELIMITER = "|"
NOT_IN_TRAINING, SAME_LABEL, CONFLICTING = "not_in_training", "same_label_in_training", "conflicting_label_in_training"


def _figures(label: str) -> list[Column]:
    """Counts of a vector from its (vector, label) rows; all of them numbers, so Spark keeps them in hash aggregates."""
    here = lambda a, value: F.when(F.col(f"n_{a}") > 0, value)
    return [F.count(label).alias("k")] + [
        e
        for a in "tv"
        for e in (
            F.sum(f"n_{a}").alias(f"n_{a}"), F.count(here(a, F.lit(1))).alias(f"pairs_{a}"), F.max(f"n_{a}").alias(f"most_{a}"), F.count(here(a, F.col(label))).alias(f"k_{a}"),
        )
    ]


def _sets(label: str) -> list[Column]:
    return [F.array_join(F.array_sort(F.collect_set(F.when(F.col(f"n_{a}") > 0, F.col(label).cast("string")))), DELIMITER).alias(f"labels_{a}") for a in "tv"]


def _vectors(df: DataFrame, features: list[str], label: str, split: str, names: dict[str, str], with_sets: bool) -> DataFrame:
    """A row per vector. Vectors meet by value, but only those are shuffled whose 64-bit key may occur more than once.

    A row whose key is alone is a vector of its own and becomes a row as it stands; the others (may_repeat has them all, and
    few more, at every size and with broadcasts by statistics off) are grouped by all features, so keys that collide cost
    a little and change nothing.
    """
    rows = may_repeat(df.filter(F.col(split).isin(*names.values())), features)
    counts = [count_if(F.col(split) == s).alias(f"n_{a}") for a, s in names.items()]
    pairs = rows.filter(FLAG).groupBy(*features, label).agg(*counts)
    together = pairs.groupBy(*features).agg(*_figures(label), *(_sets(label) if with_sets else []))
    one = {a: (F.col(split) == s).cast("long") for a, s in names.items()}
    labelled = F.col(label).isNotNull().cast("long")
    alone = [labelled.alias("k")] + [e.alias(f"{c}_{a}") for a, n in one.items() for c, e in (("n", n), ("pairs", n), ("most", n), ("k", n * labelled))]
    if with_sets:
        alone += [F.when(F.col(split) == s, F.coalesce(F.col(label).cast("string"), F.lit(""))).otherwise("").alias(f"labels_{a}") for a, s in names.items()]
    return together.unionByName(rows.filter(~F.col(FLAG)).select(*features, *alone))


def vector_counts(df: DataFrame, features: list[str], label: str, split: str, train: str = "train", validation: str = "validation") -> DataFrame:
    """features, k (labels in both splits together), then for t (train) and v (validation): n_, pairs_, most_, k_ (labels).

    Enough for all counts of the audit; label sets need vector_splits.
    """
    return _vectors(df, features, label, split, {"t": train, "v": validation}, False)


def vector_splits(df: DataFrame, features: list[str], label: str, split: str, train: str = "train", validation: str = "validation") -> DataFrame:
    """vector_counts with labels_t and labels_v, the sorted label sets as text."""
    return _vectors(df, features, label, split, {"t": train, "v": validation}, True)


def check_delimiter(df: DataFrame, label: str) -> None:
    """Labels that hold the delimiter of label sets are refused."""
    bad = [r[0] for r in df.filter(F.contains(F.col(label).cast("string"), F.lit(DELIMITER))).select(label).distinct().limit(20).collect()]
    if bad:
        raise ContractError(f"Labels hold {DELIMITER!r}: {sorted(bad)}")


def vector_label_sets(vectors: DataFrame, features: list[str], side: str = "t") -> DataFrame:
    return vectors.filter(f"n_{side} > 0").select(*features, F.col(f"labels_{side}").alias("label_set"))


def multiple_label_sets(vectors: DataFrame, side: str = "t") -> DataFrame:
    """label_set, n of the vectors with several labels in one split, by set."""
    return vectors.filter(f"k_{side} > 1").groupBy(F.col(f"labels_{side}").alias("label_set")).agg(F.count("*").alias("n")).orderBy("label_set")


def within_split_audit(vectors: DataFrame, train: str = "train", validation: str = "validation") -> DataFrame:
    """split, n_rows, n_exact_duplicates, n_repeated_rows, n_vectors, n_multi_label, n_multi_label_rows,
    n_min_misclassified (rows that no function of the features can get right)."""

    sides = {"t": train, "v": validation}
    figures = vectors.agg(*[e.alias(f"{c}_{a}") for a in sides for c, e in _within(a).items()])
    each = [F.struct(F.lit(name).alias("split"), *[F.col(f"{c}_{a}").alias(c) for c in _within(a)]) for a, name in sides.items()]
    return figures.select(F.inline(F.array(*each)))


def _within(a: str) -> dict[str, Column]:
    """The within-split figures of one side, as aggregates over vectors."""
    n, k = F.col(f"n_{a}"), F.col(f"k_{a}")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return {
        "n_rows": total(n),
        "n_exact_duplicates": total(n - F.col(f"pairs_{a}")),
        "n_repeated_rows": total(F.when(n > 0, n - 1)),
        "n_vectors": count_if(n > 0),
        "n_multi_label": count_if(k > 1),
        "n_multi_label_rows": total(F.when(k > 1, n)),
        "n_min_misclassified": total(F.when(k > 1, n - F.col(f"most_{a}"))),
    }


def irreducible_errors(vectors: DataFrame) -> DataFrame:
    return within_split_audit(vectors).select("split", "n_min_misclassified")


def shared(vectors: DataFrame) -> DataFrame:
    """Vectors in both splits, with same: one label, the same, on both sides."""
    return vectors.filter("n_t > 0 AND n_v > 0").withColumn("same", (F.col("k_t") == 1) & (F.col("k_v") == 1) & (F.col("k") == 1))


def cross_split_overlap(vectors: DataFrame) -> DataFrame:
    """n_shared, n_same, n_conflicting vectors; n_val_rows, n_train_rows of shared vectors."""
    return shared(vectors).agg(
        F.count("*").alias("n_shared"), count_if(F.col("same")).alias("n_same"), count_if(~F.col("same")).alias("n_conflicting"),
        F.coalesce(F.sum("n_v"), F.lit(0)).alias("n_val_rows"), F.coalesce(F.sum("n_t"), F.lit(0)).alias("n_train_rows"),
    )


def same_label_overlap(vectors: DataFrame) -> DataFrame:
    return shared(vectors).filter("same").groupBy(F.col("labels_t").alias("label")).agg(F.count("*").alias("n")).orderBy("label")


def conflicting_label_pairs(vectors: DataFrame) -> DataFrame:
    """training_labels, validation_labels, n, most frequent first, then by pair."""
    pairs = shared(vectors).filter("NOT same").groupBy(F.col("labels_t").alias("training_labels"), F.col("labels_v").alias("validation_labels"))
    return pairs.agg(F.count("*").alias("n")).orderBy(F.desc("n"), "training_labels", "validation_labels")


def overlap_annotation(df: DataFrame, features: list[str], label: str, row_id: str, split: str, train: str = "train", validation: str = "validation") -> DataFrame:
    """Per validation row: row id, feature_vector_in_training, training_labels_for_vector ("" if none), overlap_label_relation.

    The relation is same_label_in_training only if the training set as text equals the row's own label, so a vector
    with several training labels always conflicts.
    """
    both = may_repeat(df.filter(F.col(split).isin(train, validation)), features)
    met = both.filter(FLAG).drop(FLAG)
    pairs = met.filter(F.col(split) == train).groupBy(*features).agg(F.array_join(F.array_sort(F.collect_set(F.col(label).cast("string"))), DELIMITER).alias("_t"))
    rows = match_nulls(met.filter(F.col(split) == validation), pairs, features, "left")
    alone = both.filter(~F.col(FLAG) & (F.col(split) == validation)).drop(FLAG).withColumn("_t", F.lit(None).cast("string"))
    rows = rows.unionByName(alone)
    relation = F.when(F.col("_t").isNull(), NOT_IN_TRAINING).when(F.col("_t") == F.col(label).cast("string"), SAME_LABEL).otherwise(CONFLICTING)
    return rows.select(
        row_id, F.col("_t").isNotNull().alias("feature_vector_in_training"), F.coalesce("_t", F.lit("")).alias("training_labels_for_vector"), relation.alias("overlap_label_relation")
    )


def audit_summary(df: DataFrame, features: list[str], label: str, split: str, measured: bool = True) -> DataFrame:
    """One row: measured, and if so train, validation (structs of the within-split figures), cross (struct),
    same_label (map), conflicts (array of structs). Not measured means the fields are absent, not 0."""
    if not measured:
        return df.sparkSession.createDataFrame([(False,)], "measured boolean")
    names = {"train": "t", "validation": "v"}
    by_side = [e.alias(f"{c}_{a}") for a in names.values() for c, e in _within(a).items()]
    same = (F.col("k_t") == 1) & (F.col("k_v") == 1) & (F.col("k") == 1)
    vectors = vector_splits(df, features, label, split).withColumn("relation", F.when((F.col("n_t") > 0) & (F.col("n_v") > 0), same))
    # One pass over the vectors; what is left has a row per combination of label sets, and all parts read it from one exchange.
    sums = vectors.groupBy("labels_t", "labels_v", "relation").agg(F.count("*").alias("n"), F.sum("n_t").alias("rows_t"), F.sum("n_v").alias("rows_v"), *by_side)
    whole = sums.agg(*[F.coalesce(F.sum(f"{c}_{a}"), F.lit(0)).alias(f"{c}_{a}") for a in names.values() for c in _within(a)])
    sides = whole.select(*[F.struct(*[F.col(f"{c}_{a}").alias(c) for c in _within(a)]).alias(s) for s, a in names.items()])
    both = sums.filter("relation IS NOT NULL")
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    cross = both.agg(
        total("n").alias("n_shared"), total("n", F.col("relation")).alias("n_same"), total("n", ~F.col("relation")).alias("n_conflicting"),
        total("rows_v").alias("n_val_rows"), total("rows_t").alias("n_train_rows"),
    )
    same = both.filter("relation").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("labels_t").alias("label"), "n")))).alias("same_label"))
    named = F.struct((-F.col("n")).alias("order"), F.col("labels_t").alias("training_labels"), F.col("labels_v").alias("validation_labels"), "n")
    conflicts = both.filter("NOT relation").agg(F.array_sort(F.collect_list(named)).alias("_c"))
    one = sides.crossJoin(cross.select(F.struct("*").alias("cross"))).crossJoin(same).crossJoin(conflicts)  # a row each
    return one.select(
        F.lit(True).alias("measured"), "train", "validation", "cross", "same_label",
        F.transform("_c", lambda x: F.struct(x.training_labels, x.validation_labels, x.n)).alias("conflicts"),
    )


