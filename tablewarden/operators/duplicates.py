"""Exact duplicates, repeated feature vectors, conflicting labels, and the cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.columns import count_if, display_hash, label_set, match_nulls
from tablewarden.functions.repeats import FLAG, may_repeat

#: What marked rows carry: rows of their (vector, label), labels of their vector.
PAIR, LABELS = "__pair_rows", "__vector_labels"


def marked(df: DataFrame, features: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(alone, met): rows whose vector no other row has, as they stand, and all others with PAIR and LABELS.

    Only rows whose vector may repeat are shuffled, once, to meet the counts of their vector; those are combined on the map side first.
    A few of them are alone after all and say so by their counts.
    """
    rows = may_repeat(df, features)
    met = rows.filter(FLAG).drop(FLAG)
    pairs = met.groupBy(*features, label).agg(F.count("*").alias(PAIR))
    groups = pairs.groupBy(*features).agg(F.count(label).alias(LABELS))
    marks = match_nulls(pairs, groups, features, "inner")
    return rows.filter(~F.col(FLAG)).drop(FLAG), match_nulls(met, marks, [*features, label], "inner").select(*df.columns, PAIR, LABELS)


def pair_counts(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """features, label, n: the aggregate that all figures on vectors derive from. Null groups with null."""
    return df.groupBy(*features, label).agg(F.count("*").alias("n"))


def vector_groups(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """features, n, n_labels (distinct, without null), most (rows of the commonest pair), pairs."""
    return pair_counts(df, features, label).groupBy(*features).agg(F.sum("n").alias("n"), F.count(label).alias("n_labels"), F.max("n").alias("most"), F.count("*").alias("pairs"))


def exact_duplicate_counts(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """n_rows, n_in_groups (rows of groups of equal rows), n_extra (copies after the first)."""
    n = F.col("n")
    return pair_counts(df, features, label).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("n_in_groups"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("n_extra")
    )


def exact_duplicate_records(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """All rows of groups of equal rows."""
    _, met = marked(df, features, label)
    return met.filter(F.col(PAIR) > 1).drop(PAIR, LABELS)


def extra_duplicate_rows(df: DataFrame, features: list[str], label: str, row_id: str) -> DataFrame:
    """The copies after the first by row id."""
    copies = exact_duplicate_records(df, features, label)
    first = copies.groupBy(*features, label).agg(F.min(row_id).alias("__first"))
    return match_nulls(copies, first, [*features, label], "inner").filter(F.col(row_id) > F.col("__first")).drop("__first")


def by_class(records: DataFrame, label: str) -> DataFrame:
    return records.groupBy(label).agg(F.count("*").alias("n"))


def repeated_vectors(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """n_rows whose vector repeats, n_groups of such vectors."""
    return vector_groups(df, features, label).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_groups"))


def conflicting_vectors(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """features, n, n_labels of the vectors with more than one label."""
    return vector_groups(df, features, label).filter("n_labels > 1").select(*features, "n", "n_labels")


def vector_group_summary(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Of repeated vectors: n_groups, n_same (one label), n_conflicting."""
    return vector_groups(df, features, label).filter("n > 1").agg(
        F.count("*").alias("n_groups"), count_if(F.col("n_labels") <= 1).alias("n_same"), count_if(F.col("n_labels") > 1).alias("n_conflicting")
    )


def group_size_histogram(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return vector_groups(df, features, label).filter("n > 1").groupBy(F.col("n").alias("group_size")).agg(F.count("*").alias("n"))


def conflicting_records(df: DataFrame, features: list[str], label: str, with_hash: bool = False) -> DataFrame:
    """All rows of conflicting vectors, with a hash of the vector to show if wanted."""
    _, met = marked(df, features, label)
    out = met.filter(F.col(LABELS) > 1).drop(PAIR, LABELS)
    return out.withColumn("vector_hash", display_hash(features)) if with_hash else out


def conflict_label_pairs(df: DataFrame, features: list[str], label: str, separator: str = " <-> ") -> DataFrame:
    """label_set, n: which labels collide on identical vectors, most frequent first."""
    sets = pair_counts(df, features, label).groupBy(*features).agg(F.count(label).alias("_k"), label_set(F.col(label), separator).alias("label_set")).filter("_k > 1")
    return sets.groupBy("label_set").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label_set")


def drop_conflicting(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """df without any row of a conflicting vector."""
    alone, met = marked(df, features, label)
    return alone.unionByName(met.filter(F.col(LABELS) <= 1).drop(PAIR, LABELS))


def drop_extra_copies(df: DataFrame, features: list[str], label: str, row_id: str) -> DataFrame:
    """The first of equal rows by row id; further columns come along with it."""
    others = [c for c in df.columns if c not in (*features, label)]
    first = df.groupBy(*features, label).agg(F.min_by(F.struct(*others), row_id).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) if c in others else c for c in df.columns])


def clean(df: DataFrame, features: list[str], label: str, row_id: str) -> DataFrame:
    """Conflicting vectors go first, then later copies; in this order no vector is left twice."""
    return clean_marked(*marked(df, features, label), features, label, row_id)


def clean_marked(alone: DataFrame, met: DataFrame, features: list[str], label: str, row_id: str) -> DataFrame:
    return alone.unionByName(drop_extra_copies(met.filter(F.col(LABELS) <= 1).drop(PAIR, LABELS), features, label, row_id))


def clean_postcheck(df: DataFrame, features: list[str], label: str, row_id: str) -> DataFrame:
    """n_before, n_after_conflicts, n_after_dedup, n_exact_left, n_vectors_left; the last two must be 0."""
    return postcheck_marked(*marked(df, features, label), features, label, row_id)


def postcheck_marked(alone: DataFrame, met: DataFrame, features: list[str], label: str, row_id: str) -> DataFrame:
    """The post-check from marked rows: what is alone has no copy anywhere, so only the others are grouped again."""
    single = alone.agg(F.count("*").alias("_alone"))
    figures = met.agg(F.count("*").alias("_met"), count_if(F.col(LABELS) <= 1).alias("_sound"))
    kept = drop_extra_copies(met.filter(F.col(LABELS) <= 1).drop(PAIR, LABELS), features, label, row_id)
    left = vector_groups(kept, features, label).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("_kept"),
        F.coalesce(F.sum(F.when(F.col("most") > 1, F.col("n"))), F.lit(0)).alias("n_exact_left"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_vectors_left"),
    )
    one = single.crossJoin(F.broadcast(figures)).crossJoin(F.broadcast(left))  # one row each
    return one.select(
        (F.col("_alone") + F.col("_met")).alias("n_before"), (F.col("_alone") + F.col("_sound")).alias("n_after_conflicts"), (F.col("_alone") + F.col("_kept")).alias("n_after_dedup"),
        "n_exact_left", "n_vectors_left",
    )
