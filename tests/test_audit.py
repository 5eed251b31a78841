"""Overlap audit, duplicates, splits and samples on hand-checkable tables."""

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import contract, duplicates, overlap, profile, splits
from tablewarden.plans import runs

CALM, BURST, PROBE = "calm", "burst", "probe"
TRAIN = [(10, 0.5, CALM)] * 3 + [(11, 0.25, BURST), (11, 0.25, CALM), (12, 1.5, PROBE), (13, 2.5, BURST), (14, 3.5, CALM), (14, 3.5, PROBE), (14, 3.5, PROBE)]
VALIDATION = [(10, 0.5, CALM), (11, 0.25, CALM), (12, 1.5, BURST), (20, 9.0, CALM), (20, 9.0, CALM), (13, 2.5, BURST), (13, 2.5, PROBE), (14, 3.5, PROBE)]
FEATURES = ["f1", "f2"]


def both(spark, train=TRAIN, validation=VALIDATION, first_id=0):
    rows = [(i, *r, "train") for i, r in enumerate(train)] + [(first_id + i, *r, "validation") for i, r in enumerate(validation)]
    return spark.createDataFrame(rows, "row_id long, f1 int, f2 double, label string, split string")


def vectors(spark, **k):
    return overlap.vector_splits(both(spark, **k), FEATURES, "label", "split")


def test_within_split_audit(spark):
    got = {r.split: r for r in overlap.within_split_audit(vectors(spark)).collect()}
    assert tuple(got["train"])[1:] == (10, 3, 5, 5, 2, 5, 2)
    assert tuple(got["validation"])[1:] == (8, 1, 2, 6, 1, 2, 1)


def test_multiple_label_sets(spark):
    v = vectors(spark)
    assert [tuple(r) for r in overlap.multiple_label_sets(v, "t").collect()] == [("burst|calm", 1), ("calm|probe", 1)]
    assert [tuple(r) for r in overlap.multiple_label_sets(v, "v").collect()] == [("burst|probe", 1)]


def test_cross_split(spark):
    v = vectors(spark)
    assert tuple(overlap.cross_split_overlap(v).first()) == (5, 1, 4, 6, 10)
    assert [tuple(r) for r in overlap.same_label_overlap(v).collect()] == [(CALM, 1)]
    pairs = [(BURST, "burst|probe", 1), ("burst|calm", CALM, 1), ("calm|probe", PROBE, 1), (PROBE, BURST, 1)]
    assert [tuple(r) for r in overlap.conflicting_label_pairs(v).collect()] == pairs


def test_vectors_with_nulls_and_labels_that_are_numbers(spark):
    rows = [(None, 0.0, 1, "train"), (None, -0.0, 2, "validation"), (1, float("nan"), 1, "train"), (1, float("nan"), 1, "validation"), (2, 0.5, None, "train"), (3, 0.5, 3, "train")]
    df = spark.createDataFrame(rows, "f1 int, f2 double, label int, split string")
    got = {r.f1: r for r in overlap.vector_splits(df, FEATURES, "label", "split").collect()}
    assert len(got) == 4 and (got[None].labels_t, got[None].labels_v, got[None].k) == ("1", "2", 2) and got[1].n_v == 1 and (got[2].k, got[2].labels_t) == (0, "")
    assert tuple(overlap.cross_split_overlap(overlap.vector_counts(df, FEATURES, "label", "split")).first()) == (2, 1, 1, 2, 2)
    assert [tuple(r) for r in overlap.conflicting_label_pairs(overlap.vector_splits(df, FEATURES, "label", "split")).collect()] == [("1", "2", 1)]
    overlap.check_delimiter(df, "label")


@pytest.mark.parametrize("train,first", [(TRAIN, 0), (TRAIN[::-1], 100)])
def test_annotation(spark, train, first):
    df = both(spark, train=train, first_id=first)
    got = overlap.overlap_annotation(df.filter("split = 'train'").unionByName(df.filter("split = 'validation'")), FEATURES, "label", "row_id", "split").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(first, first + 8))
    assert "".join("FT"[r.feature_vector_in_training] for r in got) == "TTTFFTTT"
    short = {overlap.SAME_LABEL: "s", overlap.CONFLICTING: "c", overlap.NOT_IN_TRAINING: "n"}
    assert "".join(short[r.overlap_label_relation] for r in got) == "sccnnscc"
    assert got[1].training_labels_for_vector == "burst|calm" and got[3].training_labels_for_vector == ""


def test_no_overlap_and_audit_document(spark):
    moved = both(spark, validation=[(a + 1000, b, c) for a, b, c in VALIDATION])
    one = overlap.audit_summary(moved, FEATURES, "label", "split").first()
    assert one.cross.n_shared == 0 and one.conflicts == [] and one.same_label == {}
    one = overlap.audit_summary(both(spark), FEATURES, "label", "split").first()
    assert one.train.n_rows == 10 and one.same_label == {CALM: 1} and len(one.conflicts) == 4 and tuple(one.cross) == (5, 1, 4, 6, 10)
    assert overlap.audit_summary(moved, FEATURES, "label", "split", measured=False).columns == ["measured"]


def test_delimiter_is_refused(spark):
    with pytest.raises(contract.ContractError, match="left"):
        overlap.check_delimiter(both(spark, train=[(1, 1.0, "left|right")]), "label")


def test_clean_drops_conflicts_before_copies(spark):
    df = spark.createDataFrame(
        [(0, 1, None, "a"), (1, 1, None, "a"), (2, 2, 1.0, "a"), (3, 2, 1.0, "b"), (4, 3, float("nan"), "b"), (5, 3, float("nan"), "b"), (6, 4, 0.0, "a"), (7, 4, -0.0, "a")],
        "row_id long, f1 int, f2 double, label string",
    )
    kept = duplicates.clean(df, FEATURES, "label", "row_id")
    assert sorted(r.row_id for r in kept.collect()) == [0, 4, 6] and kept.columns == df.columns
    assert tuple(duplicates.clean_postcheck(df, FEATURES, "label", "row_id").first()) == (8, 6, 3, 0, 0)
    assert sorted(r.row_id for r in duplicates.exact_duplicate_records(df, FEATURES, "label").collect()) == [0, 1, 4, 5, 6, 7]
    assert sorted(r.row_id for r in duplicates.extra_duplicate_rows(df, FEATURES, "label", "row_id").collect()) == [1, 5, 7]
    assert [tuple(r) for r in duplicates.conflict_label_pairs(df, FEATURES, "label").collect()] == [("a <-> b", 1)]
    with_hash = duplicates.conflicting_records(df, FEATURES, "label", with_hash=True).collect()
    assert len({r.vector_hash for r in with_hash}) == 1 and len(with_hash) == 2


def test_published_split_sizes(spark):
    for n, expected in ((2_520_751, (378_113, 378_113, 1_764_525)), (170, None)):
        test = (15 * n + 99) // 100
        validation = (15 * (n - test) + 84) // 85
        if expected:
            assert (test, validation, n - test - validation) == expected
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 < 8, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("label"))
    got = {(r.label, r.split): r["count"] for r in splits.stratified_split(df, "label", "row_id").groupBy("label", "split").count().collect()}
    assert sum(v for (_, s), v in got.items() if s == "test") == 150 and sum(v for (_, s), v in got.items() if s == "validation") == 150
    assert got["big", "test"] == 120 and got["small", "validation"] == 15
    again = splits.stratified_split(df.repartition(7), "label", "row_id")
    assert splits.stratified_split(df, "label", "row_id").exceptAll(again.select("row_id", "label", "split")).isEmpty()


def test_sample(spark):
    df = spark.range(140).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("string").alias("label"))
    assert {r["count"] for r in splits.stratified_sample(df, "label", "row_id", 35).groupBy("label").count().collect()} == {5}
    assert splits.stratified_sample(df, "label", "row_id", 1000).count() == 140
    with pytest.raises(contract.ContractError, match="loses"):
        splits.stratified_sample(df, "label", "row_id", 3)


def test_profile_of_missing_and_infinite(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "a"), (3, float("nan"), None), (4, float("inf"), "b"), (-1, float("-inf"), "b")], "i int, x double, label string")
    assert {r.column_name: r.n for r in profile.missing_counts(df).collect()} == {"x": 2, "label": 1}
    assert {r.column_name: r.n for r in profile.infinite_counts(df).collect()} == {"x": 2}
    assert {r.column_name: r.n_nonnull for r in profile.profile_nonnull(df).collect()} == {"i": 5, "x": 3, "label": 4}
    d = {r.column_name: r for r in profile.describe(df.filter("i < 3"), ["i", "x"]).collect()}
    assert d["i"].p50 == 1.0 and d["i"].min == -1.0 and d["i"].n == 3
    assert [r.n for r in profile.class_distribution_ordered(df, "label", ["b", "zz", "a"]).collect()] == [2, 0, 2]
    assert profile.label_candidates(df) == ["label"] and profile.numeric_columns(df) == ["i", "x"] and profile.shape(df) == (5, 3)


def frame(spark, n, shift=0.0):
    """Rows of three classes by turns, told apart by a but for some noise."""
    classes = ["burst", "quiet", "sweep"]
    rows = [(i, 10.0 * (i % 3) + (i * i) % 5 + shift, float((i * 7) % 4), classes[i % 3]) for i in range(3 * n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, label string"), classes


def test_contract(spark):
    train, classes = frame(spark, 4)
    ok = lambda t, v, **k: contract.validate(t, v, "label", k.get("n", 2), k.get("c", classes), ("row_id",))
    assert ok(train, train) == ["a", "b"]
    assert ok(train.withColumn("a", F.lit(-1.0)), train) == ["a", "b"]
    for bad, says in (
        (train.drop("label"), "Target column"),
        (train.withColumnRenamed("a", "z"), "differ"),
        (train.select("row_id", "b", "a", "label"), "different order"),
        (train.withColumn("a", F.lit("x")), "Non-numeric"),
        (train.withColumn("a", F.lit(True)), "Non-numeric"),
        (train.withColumn("a", F.when(F.col("row_id") > 0, F.col("a"))), "NaN.*a"),
        (train.withColumn("b", F.when(F.col("row_id") > 0, F.col("b")).otherwise(float("inf"))), "Infinite.*b"),
        (train.withColumn("label", F.when(F.col("row_id") > 0, F.col("label"))), "Missing labels"),
        (train.withColumn("label", F.when(F.col("row_id") > 0, F.col("label")).otherwise("unheard of")), "Unexpected class set.*unheard of"),
    ):
        with pytest.raises(contract.ContractError, match=says):
            ok(train, bad)
    failed = spark.createDataFrame([("a", 2), ("row_id", 1)], "column_name string, n long")
    with pytest.raises(contract.ContractError, match="Non-numeric features in validation.*'a': 2"):
        contract.validate(train, train, "label", None, None, ("row_id",), {"training": failed.filter("n < 2"), "validation": failed})
    with pytest.raises(contract.ContractError, match="Expected 3"):
        ok(train, train, n=3)
    with pytest.raises(contract.ContractError, match="training lacks"):
        contract.validate(train.filter("label <> 'sweep'"), train, "label", None, None, ("row_id",))


def test_baseline_run(spark):
    train, classes = frame(spark, 20)
    validation, _ = frame(spark, 10)
    validation = validation.withColumn("a", F.when(F.col("row_id") < 3, F.col("a") + 9.0).otherwise(F.col("a")))
    kept = {}
    for audit in (True, False):
        said, out = runs.run_baseline(train, validation, "label", "row_id", classes, "quiet", names=("decision_tree",), audit=audit)
        rows = said.orderBy("validation_row_index").collect()
        assert len(rows) == 30 and all(0 <= r.prediction_confidence <= 1 for r in rows)
        kept[audit] = [r.predicted_attack_type for r in rows]
        assert ("overlap_label_relation" in said.columns) == audit
        metrics = out["binary_metrics"].first()
        assert metrics.tp + metrics.tn + metrics.fp + metrics.fn == 30
        assert out["error_cases"].count() == metrics.total_errors
        about = out["run_metadata"].first()
        assert about.n_train == 60 and about.audit.measured == audit and about.binary_mapping == {"burst": "ATTACK", "sweep": "ATTACK", "quiet": "NORMAL"}
        assert {"error_cases", "run_metadata"} <= set(about.outputs)
    assert kept[True] == kept[False]
    with pytest.raises(ValueError, match="unknown model"):
        runs.run_baseline(train, validation, "label", "row_id", classes, "quiet", names=("oracle",))


def test_clean_plan(spark):
    df = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (2, 2, "b")], "row_id long, f int, label string")
    out = runs.clean_table(df, "label", "row_id")
    assert out["clean"].count() == 2 and out["duplicate_records"].count() == 2


def test_marked_rows_give_the_record_sets_of_plain_grouping(spark):
    """A vector that fills a third of the table, conflicts, copies, nulls and repeated row ids, with broadcasts by statistics off."""
    import random
    from collections import Counter

    draw = random.Random(6)
    rows = [(i, 1.0, "hot", "ab"[i % 50 == 0]) for i in range(300)] + [(300 + i, float(draw.randint(0, 400)), draw.choice(["x", "y", None]), draw.choice(["a", "b", None])) for i in range(600)]
    rows += [(900, -1.0, "t", "a"), (900, -1.0, "t", "a"), (None, -2.0, "t", "a"), (None, -2.0, "t", "a")]
    df = spark.createDataFrame(rows, "row_id long, f double, g string, label string").repartition(5)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = runs.clean_table(df, "label", "row_id")
        got = {k: Counter(tuple(r)[:4] for r in out[k].collect()) for k in ("duplicate_records", "conflicting_records", "clean")}
        check = out["postcheck"].first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    pairs, labels = Counter(r[1:] for r in rows), {}
    for r in rows:
        labels.setdefault(r[1:3], set()).update({r[3]} - {None})
    assert got["duplicate_records"] == Counter(r for r in rows if pairs[r[1:]] > 1)
    assert got["conflicting_records"] == Counter(r for r in rows if len(labels[r[1:3]]) > 1)
    sound = [r for r in rows if len(labels[r[1:3]]) <= 1]
    assert Counter(r[1:] for r in got["clean"].elements()) == Counter(dict.fromkeys((r[1:] for r in sound), 1))
    first = {}
    for r in sound:
        if r[0] is not None:
            first[r[1:]] = min(first.get(r[1:], r[0]), r[0])
    assert all(r[0] == first[r[1:]] for r in got["clean"] if r[1:] in first)
    assert (check.n_before, check.n_after_conflicts, check.n_after_dedup, check.n_exact_left) == (len(rows), len(sound), len(set(r[1:] for r in sound)), 0)
