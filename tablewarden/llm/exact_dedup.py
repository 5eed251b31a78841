"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.repeats import FLAG, flag_keys
from tablewarden.llm.common import materialise, number_of_parts, one_space, table

PREFIX_CHARS = 64
#: Rows that repeat one id and text are spread over so many tasks that each has about this many of them.
ROWS_PER_SALT = 20_000


def _sketch(docs: DataFrame, text_col: str, id_col: str, **more: Column) -> DataFrame:
    """_id, _len, _prefix (hash of the first characters) of the normalised texts, and more of _flat, in one reading."""
    rows = docs.select(F.col(id_col).alias("_id"), one_space(F.col(text_col)).alias("_flat"))
    own = rows.select("_id", F.length("_flat").alias("_len"), F.xxhash64(F.substring("_flat", 1, PREFIX_CHARS)).alias("_prefix"), *[e.alias(c) for c, e in more.items()])
    return materialise(own, "exact-sketch")


def _shared(sketch: DataFrame) -> DataFrame:
    """The (_len, _prefix) that more rows than one have: rows are counted by length, those of shared lengths by prefix."""
    lengths = materialise(sketch.groupBy("_len").count().filter("count > 1").select("_len"), "exact-lengths")
    prefixes = sketch.join(lengths, "_len", "left_semi").groupBy("_len", "_prefix").count().filter("count > 1")
    return materialise(prefixes.select("_len", "_prefix"), "exact-prefixes")


def _survivors(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """_id, _short (hash of the normalised text), text_sha256 of the rows that share length and prefix with another row.

    Only these rows get a full hash, and few others: those whose (length, prefix) falls on a bit of these. Texts stay where they are.
    """
    shared = _shared(_sketch(docs, text_col, id_col))
    rows = docs.select(F.col(id_col).alias("_id"), one_space(F.col(text_col)).alias("_flat"))
    group = F.xxhash64(F.length("_flat"), F.xxhash64(F.substring("_flat", 1, PREFIX_CHARS)))
    rows = flag_keys(rows, group, shared.select(F.xxhash64("_len", "_prefix").alias("k"))).filter(FLAG)
    return materialise(rows.select("_id", F.xxhash64("_flat").alias("_short"), F.sha2("_flat", 256).alias("text_sha256")), "exact-survivors")


def _groups(survivors: DataFrame) -> DataFrame:
    counts = survivors.groupBy("text_sha256").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    return materialise(counts.filter("group_size > 1"), "exact-groups")


def duplicate_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Groups of two or more rows with equal text: text_sha256, keep_id (smallest id), group_size.

    Texts are equal if they are identical once every run of white space is one space; null counts as empty.
    1. Rows are counted by length. 2. Rows of a shared length are counted by the hash of their first 64 characters.
    3. Only rows of a shared (length, prefix) get a full SHA-256 and are grouped by it.
    All three are counts with map-side partial sums, so a hot length or text is a few rows per task; texts are never
    shuffled. An empty table gives no groups. Rows that repeat an id count as rows of the group.
    """
    return _groups(_survivors(docs, text_col, id_col))


def duplicate_marks(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per row of docs: its id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id is kept (kept is true for each row that carries that id). A null id
    counts as larger than any; a group of null ids only has a null keep_id and its rows are kept. An empty table gives
    no rows. Texts are read once: since every row's digest is asked for, it is taken along with length and prefix; only
    rows of a shared (length, prefix) are grouped by digest. The groups are read back from files: a small table of them
    is sent to all tasks, a large one joined by a shuffle in which Spark splits the partitions of hot texts.
    """
    rows = _sketch(docs, text_col, id_col, text_sha256=F.sha2("_flat", 256))
    groups = _groups(rows.join(_shared(rows), ["_len", "_prefix"], "left_semi"))
    out = rows.join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def mark_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row with text_sha256, keep_id, group_size and kept added, as duplicate_marks has them; columns of those names are replaced."""
    groups = duplicate_groups(docs, text_col, id_col).withColumnsRenamed({"keep_id": "_keep", "group_size": "_size"})
    added = ("text_sha256", "keep_id", "group_size", "kept")
    others = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.sha2(one_space(F.col(text_col)), 256).alias("text_sha256")).join(groups, "text_sha256", "left")
    own = F.col("_row")[id_col]
    keep = F.when(F.col("_size").isNull(), own).otherwise(F.col("_keep"))
    figures = [keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), own.eqNullSafe(keep).alias("kept")]
    return rows.select(*[F.col("_row")[c].alias(c) for c in others], "text_sha256", *figures)


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without later copies: the row with the smallest id of each group of equal texts stays, with its columns.

    Rows that repeat an id, with texts that are equal but for white space, are one document and give one row; rows
    without an id all stay unless a row with an id has their text. An empty table gives no rows; columns may bear any
    name. What goes is listed by id and hash of the normalised text, so the texts are dealt out by id: a text that fills
    a third of the table is spread like any other. A row that nothing repeats stays where it is: only where
    the list is too large to be sent to all tasks are texts shuffled. Of rows that repeat id and text, one is picked by
    partial aggregates.
    """
    survivors = _survivors(docs, text_col, id_col)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  no id is an empty text
    grouped = survivors.join(_groups(survivors), "text_sha256").withColumn("_first", F.col("_id").eqNullSafe(F.col("keep_id")))
    counted = grouped.groupBy(name("_id").alias("_key"), F.col("_short").alias("_hash"), "_first").count()
    dropped = materialise(counted.filter("NOT _first OR (_key != '' AND count > 1)"), "exact-dropped")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), name(id_col).alias("_key"), F.xxhash64(one_space(F.col(text_col))).alias("_hash"))
    listed = flag_keys(whole, F.xxhash64("_key", "_hash"), dropped.select(F.xxhash64("_key", "_hash").alias("k")))
    kept = listed.filter(~F.col(FLAG)).select("_row").unionByName(listed.filter(FLAG).join(dropped, ["_key", "_hash"], "left_anti").select("_row"))
    repeated = dropped.filter("_first").select("_key", "_hash", "count")
    if most := repeated.agg(F.max("count")).first()[0]:
        salts = number_of_parts(most, ROWS_PER_SALT)
        wanted = repeated.select("_key", "_hash", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
        rows = whole.withColumn("_salt", F.monotonically_increasing_id() % salts).join(wanted, ["_key", "_hash", "_salt"], "left_semi")
        kept = kept.unionByName(rows.dropDuplicates(["_key", "_hash"]).select("_row"))
    return kept.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return duplicate_marks(docs)


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
