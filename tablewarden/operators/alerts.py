"""Alert tables: building, checking, normalising, comparing, correlating."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.columns import is_floating
from tablewarden.operators.contract import ContractError

DETECTORS = ("decision_tree", "random_forest")
GROUND_TRUTH = ("actual_attack_type", "actual_binary", "binary_error_type", "correct_multiclass_prediction")
LIMIT = 1e15
FORMULA = "^[=+@\\-]"
#: Unit of each feature, and what its raw value is divided by.
MICROSECONDS = ("s", 1_000_000)


def alert_table(predictions: DataFrame, features: DataFrame, allowlist: list[str], run_id: str, dataset: str, row_id: str = "row_id") -> DataFrame:
    """A row per attack prediction: alert_id, run_id, dataset, detector, row id, predicted class, evidence in allowlist order.

    No prediction is lost: one whose record has no features, or has them more than once, fails the query (input_errors lists them all).
    """
    hits = predictions.filter("predicted_binary = 'ATTACK'")
    digits = F.col("validation_row_index").cast("string")
    digits = F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits)
    evidence = features.groupBy(F.col(row_id).alias("validation_row_index")).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in allowlist])
    wrong = F.raise_error(F.concat(F.lit("features of record "), F.coalesce(digits, F.lit("null")), F.lit(" occur so often: "), F.coalesce(F.col("_n"), F.lit(0)).cast("string")))
    rows = hits.join(evidence, "validation_row_index", "left").filter(F.when(F.coalesce(F.col("_n"), F.lit(0)) == 1, True).otherwise(wrong.cast("boolean")))
    return rows.select(
        F.concat_ws(":", F.lit(run_id), "model_name", digits).alias("alert_id"),
        F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset"), F.col("model_name").alias("detector"),
        F.col("validation_row_index").alias("row_id"), F.col("predicted_attack_type").alias("attack_type"), *allowlist,
    )


def input_errors(predictions: DataFrame, features: DataFrame, row_id: str = "row_id") -> DataFrame:
    """row id, code: what keeps predictions and features from matching one to one, from counts by record on both sides.

    FEATURES_MISSING, FEATURES_REPEATED, PREDICTIONS_MISSING (no model has the record), PREDICTIONS_FEWER (not all models
    have it), PREDICTIONS_REPEATED (a model has it twice). Null ids are one record. Empty tables on both sides give no rows.
    """
    at = "validation_row_index"
    models = predictions.agg(F.count_distinct("model_name").alias("_m"))
    p = predictions.groupBy(F.col(at).alias("_p")).agg(F.count("*").alias("_n"), F.count_distinct("model_name").alias("_k"))
    f = features.groupBy(F.col(row_id).alias("_f")).agg(F.count("*").alias("_c"))
    both = p.join(f, F.col("_p").eqNullSafe(F.col("_f")), "full_outer").crossJoin(F.broadcast(models))  # one row
    codes = F.array(
        F.when(F.col("_c").isNull(), "FEATURES_MISSING"), F.when(F.col("_c") > 1, "FEATURES_REPEATED"), F.when(F.col("_n").isNull(), "PREDICTIONS_MISSING"),
        F.when(F.col("_k") < F.col("_m"), "PREDICTIONS_FEWER"), F.when(F.col("_n") > F.col("_k"), "PREDICTIONS_REPEATED"),
    )
    return both.select(F.coalesce("_p", "_f").alias(row_id), F.explode(F.array_compact(codes)).alias("code"))


def refuse_ground_truth(columns: list[str]) -> None:
    """Alert input never holds the true class, not even for a run without alerts."""
    if bad := [c for c in columns if c in GROUND_TRUTH]:
        raise ContractError(f"alert input holds ground truth: {bad}")


def contract_errors(alerts: DataFrame, evidence: list[str], limit: float = LIMIT, detectors: tuple[str, ...] = DETECTORS) -> DataFrame:
    """alert_id, code: one row per broken rule of each alert.

    Evidence may be numbers or text; text counts only if it is a number throughout, and never if typed as text in a
    numeric table (NOT_NUMERIC). Rules: missing, not numeric, infinite or NaN, out of range, unknown detector,
    id that isn't <run>:<detector>:<seven or more digits>, line separators or other control marks in texts.
    """
    refuse_ground_truth(alerts.columns)

    def coded(test: Column, code: str) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.lit(code))

    codes = []
    for c in evidence:
        kind = alerts.schema[c].dataType.simpleString()
        number = F.col(c).try_cast("double") if kind == "string" else F.col(c).cast("double")
        codes.append(coded(F.col(c).isNull(), f"EVIDENCE_MISSING:{c}"))
        if kind == "string":
            codes.append(coded(F.col(c).isNotNull() & number.isNull(), f"EVIDENCE_NOT_NUMERIC:{c}"))
        if kind == "string" or is_floating(alerts, c):
            codes.append(coded(F.isnan(number) | (F.abs(number) == float("inf")), f"EVIDENCE_NOT_FINITE:{c}"))
        codes.append(coded((F.abs(number) > limit) & (F.abs(number) < float("inf")), f"EVIDENCE_OUT_OF_RANGE:{c}"))
    codes.append(coded(~F.col("detector").isin(*detectors) | F.col("detector").isNull(), "CONTRACT_DETECTOR"))
    codes.append(coded(F.col("alert_id").isNull() | ~F.col("alert_id").rlike("^[A-Za-z0-9_-]+:[a-z_]+:[0-9]{7,}$"), "CONTRACT_ALERT_ID"))
    codes.append(coded(F.col("row_id").isNull() | (F.col("row_id") < 0), "CONTRACT_RECORD_ID"))
    text = F.concat_ws(" ", "alert_id", "run_id", "dataset", "attack_type")
    codes.append(coded(text.rlike("[\\u0000-\\u001f\\u2028\\u2029\\ufeff]"), "CONTRACT_ID_NOT_CANONICAL"))
    return alerts.select("alert_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def normalized_evidence(alerts: DataFrame, units: dict[str, tuple[str, int]]) -> DataFrame:
    """alert_id, feature, value, unit: one row per piece of evidence, divided into its unit by exact decimals."""

    def entry(c: str, unit: str, divisor: int) -> Column:
        value = F.col(c).cast("double") if divisor == 1 else (F.col(c).cast("decimal(20,0)") / F.lit(divisor).cast("decimal(10,0)")).cast("double")
        return F.struct(F.lit(c).alias("feature"), value.alias("value"), F.lit(unit).alias("unit"))

    return alerts.select("alert_id", F.inline(F.array(*[entry(c, *u) for c, u in units.items()])))


def quality_notes(df: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """row id, note: the notes of implausible values only."""
    notes = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(note)) for note, test in rules.items()]))
    return df.select(row_id, F.explode(notes).alias("note"))


def tamper_diff(source: DataFrame, result: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change: "missing", "fabricated", "duplicate", or "changed:<field>" of each row that differs."""
    s = source.select(key, F.struct(*fields).alias("_s"))
    r = result.groupBy(key).agg(F.min(F.struct(*fields)).alias("_r"), F.count("*").alias("_n"))
    both = s.join(r, key, "full_outer")
    changed = [F.when(F.col("_s").isNotNull() & F.col("_r").isNotNull() & ~F.col(f"_s.{c}").eqNullSafe(F.col(f"_r.{c}")), f"changed:{c}") for c in fields]
    codes = F.array_compact(
        F.array(F.when(F.col("_r").isNull(), "missing"), F.when(F.col("_s").isNull(), "fabricated"), F.when(F.col("_n") > 1, "duplicate"), *changed)
    )
    return both.select(key, F.explode(codes).alias("change"))


def table_digest(df: DataFrame) -> DataFrame:
    """n_rows, xor, total: a digest that doesn't depend on the order of rows and differs where a row does."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    return df.select(row.alias("h")).agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(20,0)")).alias("total"))


def dataset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns, change: rows (with multiplicity) that only one of two tables has, "removed" or "added"."""
    n = before.withColumn("_d", F.lit(1)).unionByName(after.withColumn("_d", F.lit(-1))).groupBy(*before.columns).agg(F.sum("_d").alias("_d")).filter("_d <> 0")
    times = F.sequence(F.lit(1), F.abs("_d").cast("int"))
    return n.withColumn("_i", F.explode(times)).select(*before.columns, F.when(F.col("_d") > 0, "removed").otherwise("added").alias("change"))


def detector_correlation(alerts: DataFrame, first: str, second: str) -> DataFrame:
    """run_id, dataset, row_id, class_1, class_2, agreement of two detectors' alerts on the same records."""
    keys = ["run_id", "dataset", "row_id"]
    side = lambda d, c: alerts.filter(F.col("detector") == d).select(*keys, F.col("attack_type").alias(c))
    both = side(first, "class_1").join(side(second, "class_2"), keys, "full_outer")
    agreement = F.when(F.col("class_2").isNull(), "first_only").when(F.col("class_1").isNull(), "second_only").when(F.col("class_1") == F.col("class_2"), "same_class").otherwise("different_class")
    return both.withColumn("agreement", agreement)


def correlation_errors(alerts: DataFrame, first: str, second: str, evidence: list[str]) -> DataFrame:
    """code, n of what keeps two detectors' alerts from being compared: RUN_DIFFERS, DATASET_DIFFERS (values that only one
    has), EVIDENCE_DIFFERS (records shown with different evidence); and NOTHING_SHARED, a warning, if no record has both."""
    own = alerts.filter(F.col("detector").isin(first, second))
    one_sided = lambda c: own.groupBy(c).agg(F.count_distinct("detector").alias("k")).filter("k < 2").agg(F.count("*").alias("n"))
    shared = own.groupBy("run_id", "dataset", "row_id").agg(F.count_distinct("detector").alias("k")).filter("k > 1")
    found = [
        one_sided("run_id").select(F.lit("RUN_DIFFERS").alias("code"), "n"),
        one_sided("dataset").select(F.lit("DATASET_DIFFERS").alias("code"), "n"),
        evidence_mismatches(own, evidence).agg(F.count("*").alias("n")).select(F.lit("EVIDENCE_DIFFERS").alias("code"), "n"),
        shared.agg((F.count("*") == 0).cast("long").alias("n")).select(F.lit("NOTHING_SHARED").alias("code"), "n"),
    ]
    return reduce(DataFrame.unionByName, found).filter("n > 0")


def result_errors(result: DataFrame, key: str, position: str, status: str, errors: str) -> DataFrame:
    """key, code of the rows of a result that break its rules.

    STATUS_UNKNOWN: neither success, failed nor rejected. HIDDEN_FAILURE: a success with errors (an array of text).
    NO_ERROR_GIVEN: failed or rejected without any. OUT_OF_ORDER: a smaller key than the row before has; neighbours are
    found by a join on the position, so the result is never sorted in one place.
    """
    n = F.coalesce(F.array_size(errors), F.lit(0))
    codes = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col(status), F.lit("")).isin("success", "failed", "rejected"), "STATUS_UNKNOWN"),
            F.when((F.col(status) == "success") & (n > 0), "HIDDEN_FAILURE"),
            F.when(F.col(status).isin("failed", "rejected") & (n == 0), "NO_ERROR_GIVEN"),
        )
    )
    own = result.select(key, F.explode(codes).alias("code"))
    before = result.select((F.col(position) + 1).alias("_at"), F.col(key).alias("_before"))
    late = result.select(key, F.col(position).alias("_at")).join(before, "_at").filter(F.col(key) < F.col("_before"))
    return own.unionByName(late.select(key, F.lit("OUT_OF_ORDER").alias("code")))


def evidence_mismatches(alerts: DataFrame, evidence: list[str]) -> DataFrame:
    """run_id, dataset, row_id of records for which detectors were shown different evidence."""
    differ = reduce(lambda a, b: a | b, [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))) > 1 for c in evidence])
    return alerts.groupBy("run_id", "dataset", "row_id").agg(differ.alias("_d")).filter("_d").drop("_d")


def review_worksheet(alerts: DataFrame, rare_below: int) -> DataFrame:
    """A line per record: run_id, dataset, row_id, detectors, n_detectors, classes, rare (a class with few alerts).

    Texts that a spreadsheet would take for a formula get a leading apostrophe.
    """
    counts = alerts.groupBy("attack_type").agg(F.count("*").alias("_n"))
    rows = alerts.join(counts, "attack_type").groupBy("run_id", "dataset", "row_id").agg(
        F.array_join(F.array_sort(F.collect_set("detector")), "|").alias("detectors"),
        F.count_distinct("detector").alias("n_detectors"),
        F.array_join(F.array_sort(F.collect_set("attack_type")), "|").alias("classes"),
        (F.min("_n") < rare_below).alias("rare"),
    )
    safe = lambda c: F.when(F.col(c).rlike(FORMULA), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c)
    return rows.select("run_id", safe("dataset"), "row_id", safe("detectors"), "n_detectors", safe("classes"), "rare")


def alert_selection(alerts: DataFrame, ids: list[str] | None = None, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """All alerts by id, those with given ids, or limit of them from offset on; ids don't go with the others."""
    if ids is not None:
        if offset is not None or limit is not None:
            raise ValueError("ids and offset or limit exclude each other")
        return alerts.filter(F.col("alert_id").isin(ids)).orderBy("alert_id")
    out = alerts.orderBy("alert_id").offset(offset or 0)
    return out if limit is None else out.limit(limit)


def duplicate_alerts(alerts: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("alert_id"))
    return alerts.withColumn("_n", n).filter("_n > 1").drop("_n")
