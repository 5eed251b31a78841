"""What the corpus operators share: text normalisation, row checks, and the scratch tables of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.scratch import drop_scratch, materialise, scratch_path, scratch_root  # noqa: F401

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = ("\t", "\n", "\x0b", "\x0c", "\r")


def one_space(text: Column) -> Column:
    """Null as empty; every run of white space as one space. No regular expression unless a run remains."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, "\x20{2,}", " ")).otherwise(out)


def word_count(text: Column) -> Column:
    """Number of runs of other characters than white space, long; null has none."""
    flat = F.trim(one_space(text))
    gaps = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else changes; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_of_parts(total: int, per_part: int, least: int = 1) -> int:
    """How many parts of about per_part units hold total units; grows with the data, without a ceiling."""
    return max(least, -(-int(total) // per_part))
