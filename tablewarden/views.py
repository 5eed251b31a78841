"""Labelled tables made from the supplied ones by rule, on which the queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators.evaluate import prediction_frame
from tablewarden.operators.splits import stratified_split

FEATURES, LABEL, ROW = ["user_id", "v"], "event_type", "row_id"
CLASSES, NORMAL = ["click", "error", "purchase", "signup", "view"], "view"
WIDE_FEATURES, WIDE_LABEL = ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_returnflag"
MODELS = {"decision_tree": 4, "random_forest": 7}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias(ROW), "user_id", F.floor("value").cast("long").alias("v"), LABEL)


def flows_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(flows(spark, sf_dir), LABEL, ROW)


def flows_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*WIDE_FEATURES, WIDE_LABEL)


def flows_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows with the raw value, made null, NaN and infinite at intervals, and some labels null."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    value = F.when(i % 97 == 0, None).when(i % 101 == 0, float("nan")).when(i % 103 == 0, float("inf")).when(i % 107 == 0, float("-inf")).otherwise(F.col("value"))
    return e.select(i.alias(ROW), "user_id", value.alias("value"), F.when(i % 109 != 0, F.col(LABEL)).alias(LABEL))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two models that are wrong at intervals."""
    rows = flows(spark, sf_dir).withColumn("confidence", F.lit(0.6))
    names = F.array(*map(F.lit, CLASSES))
    out = None
    for model, every in MODELS.items():
        said = F.when(F.col(ROW) % every == 0, F.get(names, (F.col("user_id") % 5).cast("int"))).otherwise(F.col(LABEL))
        frame = prediction_frame(rows.withColumn("predicted", said), ROW, LABEL, "predicted", "confidence", NORMAL, model, "full")
        out = frame if out is None else out.unionByName(frame)
    return out
