"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import materialise, number_of_parts, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix"
#: Words that are served at once; a longer document is served as several packets, so that one long document
#: can't carry its source far past its target.
QUANTUM = 256
ROWS_PER_BUCKET = 20_000
WORDS_PER_SLOT = 2_000_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_repeats=MAX_REPEATS) -> DataFrame:
    """One row per source: source, src (its number by code point, null last), source_size, weight, target.

    Weights repeat along the sources. share times all sizes is shared by weight; a target stops at max_repeats times
    its source's size and the excess is shared again by weight until none is above. Sorted by the level at which
    each source stops, the final level follows from running sums, so no loop is needed. Only this table, one row per
    source, is sorted in one place.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = per_source.withColumn("src", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * max_repeats).withColumn("stop", F.col("cap") / F.col("weight"))
    by_stop = Window.orderBy("stop", "src")
    everything = Window.partitionBy()
    w = w.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "below": F.coalesce(F.sum("cap").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "sharing": F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    w = w.withColumn("level", (F.lit(share) * F.col("total") - F.col("below")) / F.col("sharing"))
    w = w.withColumn("final", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "src", "level"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final.level"), F.col("stop")) * F.col("weight"))
    return w.select("source", "src", "source_size", "weight", target.alias("target"), F.col("total"))


def mix_plan(docs, text_col="text", id_col="doc_id", source_col="source", weights=WEIGHTS, share=SHARE, max_repeats=MAX_REPEATS):
    """Per row of docs: its id, source, size (words), source_size, target and taken (words the mix takes of it).

    Each source's documents are shuffled (by MD5 of seed and id, ties by id; without an id, by MD5 of seed and a hash of
    the text) and laid end to end, max_repeats times.
    A packet of a document finishes at virtual time (words of its source up to its end) / target. All packets are
    sorted by finishing time, over ranges of virtual time, and the mix ends where the running total meets the budget,
    share times all words; the packet at that point is cut. So every source comes within one packet of its target.
    Running totals are made in two levels (sums per range, then rows within a range), so neither a hot source nor the
    whole table is ever sorted in one task. Null and blank texts have size 0 and nothing is taken of them; a null
    source is a source of its own; rows that repeat an id, or have none, are separate documents; an empty table gives
    no rows.
    """
    return _plan(docs, text_col, id_col, source_col, weights, share, max_repeats).select(
        F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", "taken"
    )


def _plan(docs, text_col, id_col, source_col, weights=WEIGHTS, share=SHARE, max_repeats=MAX_REPEATS):
    """mix_plan with the id as doc_id, and _hash of the text."""
    spark = docs.sparkSession
    sizes = materialise(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_hash")),
        "mix-sizes",
    )
    targets = materialise(source_targets(sizes, weights, share, max_repeats), "mix-targets")
    n_rows, words = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = int(share * words)
    buckets = number_of_parts(n_rows, ROWS_PER_BUCKET)
    slots = number_of_parts(budget, WORDS_PER_SLOT)

    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("no id:"), F.col("_hash").cast("string")))))
    rows = (
        sizes.join(targets, sizes.source.eqNullSafe(targets.source))
        .select("doc_id", sizes.source, "size", "_hash", "src", "source_size", "target", key.alias("_key"))
        .withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)))
    )
    offsets = rows.groupBy("src", "_bucket").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(offsets.select("src", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "mix-offsets")
    in_bucket = Window.partitionBy("src", "_bucket").orderBy("_key", "doc_id", "size", "_hash")
    placed = rows.join(offsets, ["src", "_bucket"]).withColumns(
        {
            "_pos": F.row_number().over(in_bucket),
            "_start": F.col("_offset") + F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
        }
    )
    placed = materialise(placed.drop("_key", "_offset"), "mix-placed")

    packets = (
        placed.filter("size > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("_first", F.col("_copy") * F.col("source_size") + F.col("_start"))
        .filter("_first < target")
        .withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(QUANTUM).cast("long"))))
        .withColumn("_words", F.least(F.lit(QUANTUM), F.col("size") - F.col("_at")))
        .filter("_first + _at < target")  # what starts at virtual time 1 or later is past the budget
        .select("src", "_bucket", "_pos", "_words", (F.col("_first") + F.col("_at") + F.col("_words")).alias("_end"), "target")
        .withColumn("_finish", F.col("_end") / F.col("target"))
        .withColumn("_slot", F.floor(F.least(F.col("_finish"), F.lit(1.0)) * slots))
    )
    ahead = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slot_offsets = packets.groupBy("_slot").agg(F.sum("_words").alias("_n"))
    slot_offsets = materialise(slot_offsets.select("_slot", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")), "mix-slots")
    in_slot = Window.partitionBy("_slot").orderBy("_finish", "src", "_end").rowsBetween(Window.unboundedPreceding, 0)
    served = packets.join(slot_offsets, "_slot").withColumn("_left", F.lit(budget) - F.col("_ahead") - F.sum("_words").over(in_slot) + F.col("_words"))
    taken = (
        served.filter("_left > 0")
        .groupBy("src", "_bucket", "_pos")
        .agg(F.sum(F.least(F.col("_words"), F.col("_left"))).cast("long").alias("taken"))
    )
    return placed.join(taken, ["src", "_bucket", "_pos"], "left").select(
        "doc_id", "source", "size", "_hash", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it as a whole, with its columns.

    The list of ids grows with the table, so this is a shuffle at every size, by id and hashes of text and source: rows
    without an id are told apart by these and spread by them. A document of which the mix takes t of n words comes
    round(t / n) times. Rows alike in id (or without one), text and source share their copies evenly; only where that
    leaves a remainder are they numbered: rows within salted parts of a group, which are written once, behind the rows
    of the parts before. Which of them gets one copy more hangs on the layout, so reruns may differ in that where their other
    columns differ. An empty table gives no rows.
    """
    plan = _plan(docs, text_col, id_col, source_col, **options)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))  # noqa: E731  rows without an id are told apart by the hashes
    keys = ["_id", "_hash", "_source"]
    copies = F.round(F.col("taken") / F.col("size")).cast("long")
    times = (
        plan.filter("size > 0")
        .groupBy(name("doc_id").alias("_id"), "_hash", F.xxhash64("source").alias("_source"))
        .agg(F.sum(copies).alias("_total"), F.count("*").alias("_alike"))
        .filter("_total > 0")
    )
    times = materialise(times, "mix-times")
    row = F.struct(*docs.columns).alias("_row")
    whole = docs.select(row, name(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.xxhash64(source_col).alias("_source"))
    out = whole.join(times.filter("_total % _alike = 0"), keys).withColumn("_n", F.expr("_total div _alike"))
    ragged = times.filter("_total % _alike > 0")
    if not ragged.isEmpty():
        more = whole.join(ragged, keys)
        salts = number_of_parts(ragged.agg(F.max("_alike")).first()[0], ROWS_PER_BUCKET)
        more = materialise(more.withColumn("_salt", F.floor(F.rand(0) * salts)), "mix-ragged")
        ahead = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        before = more.groupBy(*keys, "_salt").count().withColumn("_before", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
        number = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(F.lit(0)))
        more = more.withColumn("_place", number).join(before, [*keys, "_salt"]).withColumn("_at", F.col("_before") + F.col("_place"))
        more = more.withColumn("_n", F.expr("_total div _alike + IF(_at <= _total % _alike, 1, 0)"))
        out = out.unionByName(more.select(out.columns).filter("_n > 0"))
    return out.select("_row", F.explode(F.expr("sequence(1L, _n)"))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM per_source
), weighted AS (
  SELECT *, [5, 2, 1][src % 3 + 1] AS weight, source_size * 2 AS cap FROM numbered
), stops AS (
  SELECT *, cap::DOUBLE / weight AS stop, sum(source_size) OVER ()::DOUBLE AS total FROM weighted
), levels AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY stop, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY stop, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM stops
), final AS (
  SELECT level FROM levels WHERE level <= stop ORDER BY stop, src LIMIT 1
), targets AS (
  SELECT source, src, source_size, total, least(cap::DOUBLE, coalesce((SELECT level FROM final), stop) * weight) AS target FROM levels
), placed AS (
  SELECT doc_id, size, src, source_size, target, total,
    sum(size) OVER (PARTITION BY src ORDER BY md5('mix:' || doc_id), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start,
    row_number() OVER (PARTITION BY src ORDER BY md5('mix:' || doc_id), doc_id, size) AS pos
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source
), packets AS (
  SELECT src, pos, target, total, least(256, size - p.at) AS words, c.copy * source_size + start + p.at + least(256, size - p.at) AS stop_word
  FROM placed, (SELECT unnest([0, 1]) AS copy) c, LATERAL (SELECT unnest(range(0, size, 256)) AS at) p
  WHERE c.copy * source_size + start + p.at < target
), served AS (
  SELECT src, pos, words, floor(1.5 * total) - sum(words) OVER (ORDER BY stop_word::DOUBLE / target, src, stop_word ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + words AS remaining
  FROM packets
), taken AS (
  SELECT src, pos, sum(least(words, remaining))::BIGINT AS taken FROM served WHERE remaining > 0 GROUP BY ALL
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (src, pos)
"""
