"""Labelled tables in, record sets, splits and run results out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.operators.contract import ContractError

#: Tokens that a CSV has for a missing value.
NA_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")


def _require(df: DataFrame, target: str, name: str) -> DataFrame:
    if target not in df.columns:
        raise ContractError(f"Target column {target!r} is missing from {name}")
    return df


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType, target: str, name: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """(table, failures): a CSV with a header, every column read as text and cast to the schema's type.

    The tokens inf, -inf, Infinity, nan are numbers; NA tokens are null. failures has (column_name, n) of tokens that
    aren't missing and fail the cast, which contract checks report as non-numeric. A missing file or target column
    raises ContractError.
    """
    try:
        raw = spark.read.option("header", True).option("nullValue", None).csv(path, inferSchema=False)
    except AnalysisException as e:
        raise ContractError(f"{name} does not exist: {path}") from e
    _require(raw, target, name)
    text = {c: F.when(~F.col(c).isin(*NA_TOKENS), F.col(c)) for c in raw.columns}
    kinds = {f.name: f.dataType for f in schema.fields}
    cast = {c: text[c].try_cast(kinds.get(c, T.StringType())) for c in raw.columns}
    failed = raw.agg(*[F.count(F.when(text[c].isNotNull() & cast[c].isNull(), 1)).alias(c) for c in raw.columns])
    failures = failed.unpivot([], failed.columns, "column_name", "n").filter("n > 0")
    return raw.select(*[cast[c].alias(c) for c in raw.columns]), failures


def read_labelled_parquet(spark: SparkSession, path: str, target: str, name: str = "dataset") -> DataFrame:
    try:
        return _require(spark.read.parquet(path), target, name)
    except AnalysisException as e:
        raise ContractError(f"{name} does not exist: {path}") from e


def add_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """A 0-based position in front of the columns: files by path, rows as they stand in them. Written once after reading, it is an ordinary column.

    However Spark cuts files into blocks and packs these into tasks, a block's rows are read one after the other, so a
    row's place in its block is how far its running number is from the block's first. Blocks are counted, their counts summed
    up by path and start: a row per block, and no sort of the rows. A table that isn't read from files counts along its partitions.
    Rows of files that were dealt anew since they were read (a sort, a repartition) raise an error: number them first.
    """
    at = F.monotonically_increasing_id()
    try:
        source = df.metadataColumn("_metadata")
        block = [source["file_path"].alias("_a"), source["file_block_start"].alias("_b")]
        rows, hint = df.select(F.struct("*").alias("_row"), at.alias("_at"), *block), (lambda x: x)
    except AnalysisException:
        hint = F.broadcast  # a row per partition
        rows = df.select(F.struct("*").alias("_row"), at.alias("_at"), F.lit("").alias("_a"), F.shiftright(at, 33).alias("_b"))  # the upper bits number the partition
    before = Window.orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_a", "_b").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    moved = F.raise_error(F.concat(F.lit("rows were dealt anew since they were read, number them first: "), "_a"))
    shift = F.when(F.col("_last") - F.col("_first") + 1 == F.col("_n"), F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).otherwise(moved.cast("long"))
    blocks = blocks.select("_a", "_b", shift.alias("_shift"))
    placed = rows.join(hint(blocks), ["_a", "_b"])
    return placed.select((F.col("_at") + F.col("_shift")).alias(out), "_row.*")


def preview(df: DataFrame, row_id: str, rows: int = 5000, shown: int = 20) -> DataFrame:
    """The first shown of the first rows by position."""
    return df.filter(F.col(row_id) < rows).orderBy(row_id).limit(shown)


def add_leading(df: DataFrame, **constants) -> DataFrame:
    """Constant columns in front of the others."""
    return df.select(*[F.lit(v).alias(k) for k, v in constants.items()], *[c for c in df.columns if c not in constants])


def write_splits(df: DataFrame, path: str, split: str = "split", kind: str = "csv") -> None:
    """One folder per split."""
    df.write.mode("errorifexists").partitionBy(split).option("header", True).format(kind).save(path)


def write_records(records: DataFrame, path: str, kind: str = "csv") -> None:
    records.write.mode("errorifexists").option("header", True).format(kind).save(path)


def run_path(root: str, run_id: str, run_mode: str) -> str:
    """The folder of one run; its name ends in the mode, so that a smoke run can't be taken for a result."""
    if run_mode not in ("full", "smoke"):
        raise ValueError("run_mode is full or smoke")
    return f"{root.rstrip('/')}/run={run_id}_{run_mode}"


def write_model_outputs(outputs: dict[str, DataFrame], folder: str, run_mode: str, kind: str = "parquet") -> None:
    """Each output under its name, with run_mode in every row, by model where there is one; never over an older run."""
    for name, df in outputs.items():
        rows = df if "run_mode" in df.columns else add_leading(df, run_mode=run_mode)
        writer = rows.write.mode("errorifexists").option("header", True).format(kind)
        (writer.partitionBy("model_name") if "model_name" in df.columns else writer).save(f"{folder}/{name}")
