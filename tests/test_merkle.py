"""Hash trees of tables, and what they say about a copy."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewarden import queries
from tablewarden.functions.numbering import numbered
from tablewarden.operators import alerts, evaluate, merkle

FIELDS = ["x", "y"]


def base(spark, n=5000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"), F.concat(F.lit("t"), F.col("id") % 3).alias("y"))


def changes(df):
    return sorted(((r.k is None, r.k or 0), r.change) for r in df.collect())


def test_copies_alike_give_nothing(spark):
    df = base(spark)
    assert merkle.localise(df, df.repartition(7), "k", FIELDS).count() == 0
    none = df.limit(0)
    assert merkle.localise(none, none, "k", FIELDS, claimed={"n": 0}).count() == 0
    assert changes(merkle.localise(none, df.limit(1), "k", FIELDS, claimed={"n": 3})) == [((False, 0), "fabricated"), ((True, 0), "counts:n")]
    root = lambda d: merkle.tree(d, "k", FIELDS).filter(f"level = {merkle.ROOT}").first()
    assert root(df)[1:] == root(df.orderBy(F.desc("k")))[1:] != root(df.filter("k <> 77"))[1:] and root(df).n == 5000


def test_every_copy_of_every_row_counts(spark):
    rows = [(1, 1, "a"), (2, 1, "a"), (2, 2, "b"), (3, 1, "a"), (3, 1, "a"), (4, 1, None), (-9_000_000, 5, "z"), (None, 1, "a"), ((1 << 62), 1, "q"), (5, 1, "a"), (5, 2, "b"), (6, 1, "a")]
    after = [(1, 1, "a"), (1, 1, "a"), (2, 1, "b"), (2, 2, "a"), (3, 1, "a"), (4, 1, "c"), (None, 2, "a"), ((1 << 62), 1, "q"), (5, 1, "a"), (5, 3, "b"), (7, 1, "a"), (6, 1, "a"), (6, 2, "a")]
    kinds = "k long, x int, y string"
    got = changes(merkle.localise(spark.createDataFrame(rows, kinds), spark.createDataFrame(after, kinds), "k", FIELDS))
    assert got == sorted([
        ((False, 1), "repeated"), ((False, 2), "changed:row"), ((False, 3), "lost"), ((False, 4), "changed:y"), ((False, -9_000_000), "missing"), ((True, 0), "changed:x"),
        ((False, 5), "changed:x"), ((False, 7), "fabricated"), ((False, 6), "repeated"), ((False, 6), "changed:x"),
    ])


def test_only_differing_ranges_are_read_again(spark, tmp_path):
    """Three rows of a large table are forged: a few leaves differ, and the filter on their keys reaches the scan."""
    n = 300_000
    base(spark, n).repartitionByRange(8, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    forged = df.withColumn("x", F.when(F.col("k").isin(5, 150_000, 299_999), -1).otherwise(F.col("x")))
    leaves = merkle.differing_leaves(merkle.tree(df, "k", FIELDS), merkle.tree(forged, "k", FIELDS))
    assert sorted(r.node for r in leaves.collect()) == sorted({5 // 1024, 150_000 // 1024, 299_999 // 1024})
    again = merkle.rows_of(df, "k", leaves)
    assert again.count() <= 3 * merkle.LEAF_KEYS and "GreaterThanOrEqual(k" in again._jdf.queryExecution().executedPlan().toString()
    assert changes(merkle.localise(df, forged, "k", FIELDS)) == [((False, k), "changed:x") for k in (5, 150_000, 299_999)]


def test_order_of_a_result(spark):
    df = spark.createDataFrame([(i, 0, "a", p) for i, p in ((1, 0), (2, 1), (4, 2), (3, 3), (5, 4))], "k long, x int, y string, at long")
    assert changes(merkle.localise(df.drop("at"), df, "k", FIELDS, position="at")) == [((False, 3), "reordered")]


def test_input_of_alerts_is_reconciled(spark):
    p = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("b", 2), ("b", 2), ("a", 3), ("a", 5), ("b", 5), ("a", None), ("b", None)], "model_name string, validation_row_index long")
    f = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0), (None, 0.0), (None, 1.0)], "row_id long, v double")
    got = sorted(((r.row_id or 0), r.code) for r in alerts.input_errors(p, f).collect())
    assert got == [(0, "FEATURES_REPEATED"), (2, "PREDICTIONS_REPEATED"), (3, "PREDICTIONS_FEWER"), (4, "PREDICTIONS_MISSING"), (5, "FEATURES_MISSING")]
    assert alerts.input_errors(p.limit(0), f.limit(0)).count() == 0
    attacks = p.filter("validation_row_index = 1 OR validation_row_index = 5").withColumn("predicted_binary", F.lit("ATTACK")).withColumn("predicted_attack_type", F.lit("x"))
    assert alerts.alert_table(attacks.filter("validation_row_index = 1"), f, ["v"], "r", "d").count() == 2
    for rows in (attacks, attacks.withColumn("validation_row_index", F.lit(None).cast("long"))):
        with pytest.raises(Exception, match="occur so often: 0|occur so often: 2|features of record"):
            alerts.alert_table(rows, f, ["v"], "r", "d").collect()


def test_error_cases_need_features(spark):
    p = spark.createDataFrame([(1, False, "FP", "x"), (2, True, "TP", "x")], "validation_row_index long, correct_multiclass_prediction boolean, binary_error_type string, actual_attack_type string")
    f = spark.createDataFrame([(1, 3.0)], "row_id long, v double")
    assert [r.v for r in evaluate.error_cases(p, f).collect()] == [3.0]
    with pytest.raises(Exception, match="no features of record"):
        evaluate.error_cases(p, f.filter("row_id = 7")).collect()


def test_rows_are_numbered_by_ranges(spark):
    """As row_number does, but in many tasks; equal keys and nulls included."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 5003).alias("k"), F.when(F.col("id") % 11 != 0, F.col("id") % 13).alias("x"))
    got = numbered(df, ["k", "x"], "at")
    want = df.withColumn("at", F.row_number().over(Window.orderBy("k", "x")) - 1)
    assert got.exceptAll(want).count() == 0 and got.count() == 20_000
    assert numbered(df.limit(0), ["k"], "at").count() == 0
    plan = numbered(df, ["k", "x"], "at")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_no_window_over_all_rows_in_tamper_localised(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(merkle, "localise", lambda source, result, *a, **k: seen.append(result) or result)
    queries.QUERIES["tamper_localised"](spark, "/root/testdata/sf0.001")
    assert "Window" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
