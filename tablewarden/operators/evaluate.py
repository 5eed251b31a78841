"""Predictions to records, error cases, and multiclass and binary metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.columns import count_if, ratio
from tablewarden.operators.contract import ContractError

#: Names of the binary classes, and below those of the columns and categories of a record.
NORMAL, ATTACK = "NORMAL", "ATTACK"
ROUND = 6


def to_binary(label: Column, normal: str) -> Column:
    return F.when(label == normal, NORMAL).otherwise(ATTACK)


def binary_error_type(actual: Column, predicted: Column) -> Column:
    """TP, TN, FP or FN of two binary columns; attack is positive."""
    return F.when(actual == ATTACK, F.when(predicted == ATTACK, "TP").otherwise("FN")).otherwise(F.when(predicted == ATTACK, "FP").otherwise("TN"))


def prediction_confidence(df: DataFrame, classes: list[str], probabilities: str, predicted: str, out: str = "confidence", tolerance: float = 1e-9) -> DataFrame:
    """df with the predicted class's probability, looked up by the model's class order.

    A row fails the query if its array has another length, its prediction is no class, or its prediction isn't the most probable class.
    """
    p = F.col(probabilities)
    at = F.array_position(F.array(*map(F.lit, classes)), F.col(predicted)).cast("int")
    value = F.get(p, at - 1)
    checked = (
        F.when(F.size(p) != len(classes), F.raise_error(F.lit("probabilities and classes differ in number")).cast("double"))
        .when(F.coalesce(at, F.lit(0)) == 0, F.raise_error(F.concat(F.lit("no class of the model: "), F.coalesce(F.col(predicted), F.lit("null")))).cast("double"))
        .when(value < F.array_max(p) - tolerance, F.raise_error(F.lit("the prediction is not the most probable class")).cast("double"))
        .otherwise(value)
    )
    return df.withColumn(out, checked)


def prediction_frame(df: DataFrame, row_id: str, actual: str, predicted: str, confidence: str, normal: str, model_name: str, run_mode: str) -> DataFrame:
    """The ten columns of a prediction record."""
    a, p = F.col(actual), F.col(predicted)
    binary = {"actual_binary": to_binary(a, normal), "predicted_binary": to_binary(p, normal)}
    return df.select(
        F.col(row_id).alias("validation_row_index"),
        F.lit(model_name).alias("model_name"),
        F.lit(run_mode).alias("run_mode"),
        a.alias("actual_attack_type"),
        p.alias("predicted_attack_type"),
        F.col(confidence).alias("prediction_confidence"),
        (a == p).alias("correct_multiclass_prediction"),
        *[e.alias(k) for k, e in binary.items()],
        binary_error_type(*binary.values()).alias("binary_error_type"),
    )


def annotate(predictions: DataFrame, annotation: DataFrame, row_id: str = "row_id") -> DataFrame:
    """predictions with the overlap columns of their row; the number of rows can't change, or it is an error."""
    key = annotation.withColumnRenamed(row_id, "validation_row_index")
    if not key.groupBy("validation_row_index").count().filter("count > 1").isEmpty():
        raise ContractError("the annotation has a row id more than once")
    return predictions.join(key, "validation_row_index", "left")


def error_cases(predictions: DataFrame, features: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Misclassified records once, with their untouched features and error_category. One without features fails the query."""
    wrong = predictions.filter(~F.col("correct_multiclass_prediction"))
    category = (
        F.when(F.col("binary_error_type") == "FP", "binary_false_positive")
        .when(F.col("binary_error_type") == "FN", "binary_false_negative")
        .otherwise("attack_to_attack_misclassification")
    )
    kept = features.withColumnRenamed(row_id, "validation_row_index")
    first = [c for c in kept.columns if c != "validation_row_index"]
    rest = [c for c in predictions.columns if c not in ("validation_row_index", "correct_multiclass_prediction")]
    lost = F.raise_error(F.concat(F.lit("no features of record "), F.coalesce(F.col("validation_row_index").cast("string"), F.lit("null"))))
    met = wrong.withColumn("error_category", category).join(kept.withColumn("_has", F.lit(True)), "validation_row_index", "left")
    return met.filter(F.coalesce(F.col("_has"), lost.cast("boolean"))).select("validation_row_index", *first, *rest, "error_category")


def pair_table(predictions: DataFrame) -> DataFrame:
    """model_name, actual, predicted, n: at most the square of the classes per model; all metrics derive from it."""
    return predictions.groupBy("model_name", F.col("actual_attack_type").alias("actual"), F.col("predicted_attack_type").alias("predicted")).agg(F.count("*").alias("n"))


def observe_pairs(frame: DataFrame, classes: list[str], model: str) -> tuple[DataFrame, Observation]:
    """frame with its pair table counted along the way, whatever it is written to next."""
    seen = Observation(f"pairs of {model}")
    actual, said = F.col("actual_attack_type"), F.col("predicted_attack_type")
    cells = [count_if((actual == a) & (said == b)).alias(f"{i},{j}") for i, a in enumerate(classes) for j, b in enumerate(classes)]
    return frame.observe(seen, F.count(F.lit(1)).alias("n"), *cells), seen


def observed_pairs(spark: SparkSession, seen: dict[str, Observation], classes: list[str]) -> DataFrame:
    """The pair table of frames that were written once; a label outside classes is an error."""
    rows = []
    for model, observation in seen.items():
        got = observation.get
        cells = [(model, classes[int(k.split(",")[0])], classes[int(k.split(",")[1])], n) for k, n in got.items() if k != "n"]
        if sum(c[3] for c in cells) != got["n"]:
            raise ContractError(f"{got['n'] - sum(c[3] for c in cells)} predictions of {model} hold labels outside {classes}")
        rows += [c for c in cells if c[3]]
    return spark.createDataFrame(rows, "model_name string, actual string, predicted string, n long")


def _pairs(predictions: DataFrame) -> DataFrame:
    """A pair table as it is; predictions are counted."""
    return predictions if predictions.columns == ["model_name", "actual", "predicted", "n"] else pair_table(predictions)


def _per_class(predictions: DataFrame, classes: list[str]) -> DataFrame:
    pairs = _pairs(predictions)
    side = lambda c, own, other: pairs.select("model_name", F.col(c).alias("class"), own.alias("tp"), F.col("n").alias(other))
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = side("actual", hit, "support").withColumn("said", F.lit(0)).unionByName(side("predicted", F.lit(0), "said").withColumn("support", F.lit(0)))
    names = predictions.sparkSession.createDataFrame(list(enumerate(classes)), "class_pos int, class string")
    blank = pairs.select("model_name").distinct().crossJoin(F.broadcast(names))
    sums = rows.groupBy("model_name", "class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    full = blank.join(sums, ["model_name", "class"], "left").fillna(0, ["tp", "support", "said"])
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return full.withColumns({"precision": p, "recall": r, "f1": ratio(2 * F.col("tp"), F.col("said") + F.col("support"))})


def _averages(per_class: DataFrame) -> DataFrame:
    w = F.col("support")
    figures = ("precision", "recall", "f1")
    return per_class.groupBy("model_name").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("right"),
        *[F.avg(c).alias(f"macro_{c}") for c in figures], *[ratio(F.sum(F.col(c) * w), F.sum(w)).alias(f"weighted_{c}") for c in figures],
    )


def classification_report(predictions: DataFrame, classes: list[str], run_mode: str = "full") -> DataFrame:
    """run_mode, model_name, class, precision, recall, f1, support, with the rows "macro avg" and "weighted avg"."""
    per = _per_class(predictions, classes)
    avg = _averages(per)
    figures = ("precision", "recall", "f1")
    rounded = lambda df, name, prefix: df.select("model_name", name.alias("class"), *[F.round(f"{prefix}{c}", ROUND).alias(c) for c in figures], F.col("support").cast("long"))
    rows = rounded(per, F.col("class"), "").unionByName(rounded(avg, F.lit("macro avg"), "macro_")).unionByName(rounded(avg, F.lit("weighted avg"), "weighted_"))
    return rows.select(F.lit(run_mode).alias("run_mode"), "*")


def multiclass_summary(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """model_name, accuracy, macro and weighted precision, recall and f1."""
    avg = _averages(_per_class(predictions, classes))
    names = [c for c in avg.columns if c.startswith(("macro_", "weighted_"))]
    return avg.select("model_name", F.round(ratio(F.col("right"), F.col("support")), ROUND).alias("accuracy"), *[F.round(c, ROUND).alias(c) for c in names])


def confusion_matrix(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """model_name, actual_attack_type, a column per predicted class; empty cells are 0, all classes have a row."""
    names = predictions.sparkSession.createDataFrame([(c,) for c in classes], "actual_attack_type string")
    pairs = _pairs(predictions)
    blank = pairs.select("model_name").distinct().crossJoin(F.broadcast(names))
    cells = pairs.groupBy("model_name", F.col("actual").alias("actual_attack_type")).pivot("predicted", classes).agg(F.sum("n"))
    return blank.join(cells, ["model_name", "actual_attack_type"], "left").fillna(0, classes)


def binary_metrics(predictions: DataFrame, run_mode: str = "full", normal: str | None = None) -> DataFrame:
    """Per model: tp, tn, fp, fn, six rates (0 where the denominator is), attack-to-attack errors and all errors.

    predictions may be a pair table, for which normal names the class that is no attack.
    """
    rows = predictions.withColumn("n", F.lit(1))
    if normal:
        rows = _pairs(predictions).withColumn("binary_error_type", binary_error_type(to_binary(F.col("actual"), normal), to_binary(F.col("predicted"), normal)))
        rows = rows.withColumn("correct_multiclass_prediction", F.col("actual") == F.col("predicted"))
    kind = F.col("binary_error_type")
    wrong = ~F.col("correct_multiclass_prediction")
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")
    counts = rows.groupBy("model_name").agg(
        *[total(kind == k).alias(k.lower()) for k in ("TP", "TN", "FP", "FN")], total(wrong & (kind == "TP")).alias("attack_to_attack_errors"), total(wrong).alias("total_errors"),
    )
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    rates = {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp),
    }
    return counts.select(
        F.lit(run_mode).alias("run_mode"), "model_name", F.lit(ATTACK).alias("positive_class"), tp, tn, fp, fn,
        *[F.round(e, ROUND).alias(k) for k, e in rates.items()], "attack_to_attack_errors", "total_errors",
    )


def model_comparison(
    predictions: DataFrame, classes: list[str], run_mode: str = "full", seconds: dict[str, tuple[float, float]] | None = None, normal: str | None = None
) -> DataFrame:
    """A row per model: rows, multiclass and binary figures; with seconds, fit and predict times by model. normal as in binary_metrics."""
    multi = multiclass_summary(predictions, classes)
    binary = binary_metrics(predictions, run_mode, normal).drop("positive_class")
    for c in ("accuracy", "precision", "recall", "f1"):
        binary = binary.withColumnRenamed(c, f"binary_{c}")
    out = _pairs(predictions).groupBy("model_name").agg(F.sum("n").alias("n_rows")).join(multi, "model_name").join(binary, "model_name")
    if seconds:
        times = predictions.sparkSession.createDataFrame([(m, *t) for m, t in seconds.items()], "model_name string, fit_seconds double, predict_seconds double")
        out = out.join(F.broadcast(times), "model_name", "left")
    return out
