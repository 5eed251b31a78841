"""Line deduplication within an edit bound, by a join of deletion neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import BLANKS, materialise, table

MAX_EDITS = 1
#: Lines with fewer characters than asked for are compared exactly only; by default there is no such length.
NEAR_CHARS = 0
#: A line is hashed in blocks of so many characters, so that a variant costs one block, not the whole line.
BLOCK = 64
#: Documents with lines that may have a near copy are folded into numbered slots, so many for each that few others share
#: one at any size of the table. Up to MOST_SENT slots the set is sent to all tasks; a larger one is joined by a shuffle.
SLOTS_PER_DOCUMENT, LEAST_SLOTS, MOST_SENT = 8, 1 << 16, 1 << 20


def _document(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))


def _lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc, no, line) of the lines that are not blank: runs of white space as one space, none at the ends.

    doc is the id and a hash of the text, so rows that repeat an id with another text are documents of their own.
    """
    others = [blank for blank in BLANKS if blank != "\n"]
    flat = F.col("line")
    for blank in others:
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    any_other = reduce(lambda a, b: a | b, [F.contains("line", F.lit(blank)) for blank in others])
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    # The id and hash are columns before lines are dealt out, so that no line carries the text along. Lines are taken apart before
    # other white space is looked for, so that it costs its line, not its text; to look for a blank is cheaper than to replace it.
    rows = rows.select(_document(id_col, text_col).alias("doc"), F.split(F.col(text_col), "\n", -1).alias("lines")).select("doc", F.posexplode("lines").alias("no", "line"))
    rows = rows.withColumn("line", F.when(any_other, flat).otherwise(F.col("line")))
    rows = rows.withColumn("line", F.when(F.contains("line", F.lit("  ")), F.regexp_replace("line", "\x20{2,}", " ")).otherwise(F.col("line")))
    return rows.withColumn("line", F.trim("line")).filter("line <> ''")


def _key(line: Column) -> dict[str, Column]:
    """A line's identity, 128 bits."""
    return {"k1": F.xxhash64(line), "k2": F.xxhash64(F.lit("second"), line)}


def _halves(line: Column, n: Column) -> Column:
    """Keys of which two lines within one edit share one: the first half and the rest, as for the shorter line's length n or n - 1."""
    out, raw, plain = [], line.cast("binary"), F.octet_length(line) == n
    for m in (n, n - 1):
        half, rest = F.floor(m / 2).cast("int"), F.ceil(m / 2).cast("int")
        # Where each character is one byte, places in the bytes are known without a walk over the characters.
        out.append(F.xxhash64(F.lit("first"), m, F.when(plain, F.substr(raw, F.lit(1), half)).otherwise(F.left(line, half).cast("binary"))))
        out.append(F.xxhash64(F.lit("rest"), m, F.when(plain, F.substr(raw, n - rest + 1)).otherwise(F.right(line, rest).cast("binary"))))
    return F.array(*out)


def _keyed_lines(lines: DataFrame, near_chars: int) -> DataFrame:
    """k1, k2, doc, no, halves (null for short lines): all that later steps need of the lines but for survivors' text."""
    n = F.length("line")
    keys = {**_key(F.col("line")), "halves": F.when(n >= near_chars, _halves(F.col("line"), n))}
    return lines.select("doc", "no", *[e.alias(c) for c, e in keys.items()])


def _distinct_lines(keyed: DataFrame) -> DataFrame:
    """One row per distinct line: k1, k2, first (doc and no of the earliest), times, halves."""
    return keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("times"), F.min("halves").alias("halves"))


def _variants(survivors: DataFrame) -> DataFrame:
    """(variant, place, first): the hash of each line with one character left out, at which place, and of the line itself (place -1).

    A string's hash is the xor of its blocks' hashes. Leaving out place p keeps the blocks before p's, shifts those
    behind by one, and changes p's block. Running xors over a line's blocks give what lies before and behind, so all
    variants of a line cost its length times BLOCK.
    """
    block = F.regexp_extract_all(F.col("line"), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    rows = survivors.select("first", F.posexplode(block).alias("b", "block"))
    line = Window.partitionBy("first").orderBy("b")
    whole = Window.partitionBy("first")
    before, upto = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    xor = lambda c, over: F.coalesce(F.bit_xor(c).over(over), zero)
    rows = rows.withColumn("window", F.concat("block", F.coalesce(F.left(F.lead("block").over(line), F.lit(1)), F.lit(""))))
    rows = rows.withColumns({"h": F.xxhash64("block", "b"), "g": F.when(F.length("window") > 1, F.xxhash64(F.expr("substring(window, 2)"), "b"))})
    rows = rows.withColumns({"around": xor("h", before).bitwiseXOR(xor("g", whole)).bitwiseXOR(xor("g", upto)), "all": xor("h", whole)})
    hole = F.transform(
        F.sequence(F.lit(1), F.length("block")),
        lambda p: F.struct(
            (F.col("b") * BLOCK + p - 1).alias("place"), F.concat(F.left("window", p - 1), F.substring("window", p + 1, F.lit(BLOCK + 1))).alias("left_over")
        ),
    )
    left = rows.select("first", "b", "around", F.inline(hole))
    one = F.when(F.col("left_over") == "", zero).otherwise(F.xxhash64("left_over", "b"))
    own = rows.filter("b = 0").select(F.col("all").alias("variant"), F.lit(-1).alias("place"), "first")
    return own.unionByName(left.select(F.col("around").bitwiseXOR(one).alias("variant"), "place", "first"))


def _near_copies(docs: DataFrame, distinct: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(first,) of the distinct lines with an earlier line one edit away."""
    halves = distinct.filter("halves IS NOT NULL").select("first", F.explode("halves").alias("half"))
    shared = materialise(halves.groupBy("half").count().filter("count > 1").select("half"), "lines-halves")
    found = materialise(halves.join(shared, "half", "left_semi").select("first").distinct(), "lines-survivors")
    documents = materialise(found.select("first.doc").distinct(), "lines-documents")
    n = max(LEAST_SLOTS, 1 << (SLOTS_PER_DOCUMENT * documents.count()).bit_length())
    slot = lambda doc: F.pmod(F.xxhash64(doc), F.lit(n))
    slots = materialise(documents.select(slot("doc.id").alias("_slot")).distinct(), "lines-slots")
    some = docs.select(F.col(id_col), F.col(text_col)).withColumn("_slot", slot(id_col)).join(F.broadcast(slots) if n <= MOST_SENT else slots, "_slot", "left_semi")
    texts = _lines(some, text_col, id_col).select(F.struct("doc", "no").alias("first"), "line").join(found, "first", "left_semi")
    texts = materialise(texts.dropDuplicates(["first"]), "lines-texts")

    variants = materialise(_variants(texts), "lines-variants")
    # Same variant, same place: one character replaced. The earliest of such a group stands for all pairs in it.
    replaced = variants.filter("place >= 0").groupBy("variant", "place").agg(F.min("first").alias("early"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # A line that is another's variant: one character more or less.
    whole = F.when(F.col("place") < 0, F.col("first"))
    longer = F.when(F.col("place") >= 0, F.col("first"))
    grown = variants.groupBy("variant").agg(F.min(whole).alias("short"), F.min(longer).alias("long")).filter("short IS NOT NULL AND long IS NOT NULL")
    replaced, grown = materialise(replaced, "lines-replaced"), materialise(grown, "lines-grown")
    pairs = variants.filter("place >= 0").join(replaced, ["variant", "place"]).select("first", "early")
    pairs = pairs.unionByName(variants.join(grown, "variant").select("first", F.when(F.col("place") < 0, F.col("long")).otherwise(F.col("short")).alias("early")))
    pairs = materialise(pairs.filter("early < first").distinct(), "lines-pairs")
    early = texts.select(F.col("first").alias("early"), F.col("line").alias("early_line"))
    return pairs.join(texts, "first").join(early, "early").filter(F.levenshtein("line", "early_line", MAX_EDITS).between(0, MAX_EDITS)).select("first").distinct()


def dropped_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(doc, no) of the lines to drop: those with an equal line, or one within max_edits (0 or 1), that comes earlier.

    doc is a struct of the id and the text's hash. Earlier is by document id, then hash, then line number (from 0). Lines
    are compared without white space at their ends and with runs of it as one space; blank lines are never dropped; lines
    under near_chars characters are compared exactly. A line within the bound of any earlier line is dropped, even if
    that line is dropped too. Rows with a null id or text take no part; an empty table gives no rows.

    Lines that share neither half with another can have no partner and emit no variants. Variants are grouped, never
    paired: each line is compared with the earliest of its group only, which decides the same, so a group of
    copies costs its length. With a bound of one edit that is exact; a wider bound would need all pairs of a group.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = _lines(docs, text_col, id_col)
    keyed = materialise(_keyed_lines(lines, near_chars), "lines-keyed")
    distinct = materialise(_distinct_lines(keyed), "lines-distinct")
    bad = distinct.filter("times > 1").select("k1", "k2", "first", F.lit(False).alias("all"))
    if max_edits:
        near = materialise(_near_copies(docs, distinct, text_col, id_col), "lines-near")
        marked = distinct.join(near.withColumn("near", F.lit(True)), "first", "left")
        bad = marked.filter("times > 1 OR near").select("k1", "k2", "first", F.coalesce("near", F.lit(False)).alias("all"))
    bad = materialise(bad, "lines-bad")
    return keyed.select("k1", "k2", "doc", "no").join(bad, ["k1", "k2"]).filter(F.col("all") | (F.struct("doc", "no") != F.col("first"))).select("doc", "no")


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_edits: int = MAX_EDITS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with the later ones of equal or near-equal lines taken out of text; n_lines and n_kept are added.

    Kept lines stay as they were, in order, joined by line feeds; a document may end up empty but stays. Null text
    stays null with no lines. Rows with a null id are left whole. Rows alike in id and text are one document, rows that
    repeat an id with another text are documents of their own. Columns named n_lines or n_kept are replaced; no other
    name is reserved. An empty table gives no rows.
    """
    gone = dropped_lines(docs, text_col, id_col, max_edits, near_chars).groupBy("doc").agg(F.collect_set("no").alias("_gone"))
    gone = materialise(gone.select(F.col("doc.id").alias("_id"), F.col("doc.hash").alias("_hash"), "_gone"), "lines-gone")
    others = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    row = F.struct(*[c for c in others if c != text_col])  # it has the id at least
    # Lines are split once, before the join: above it the array is a column, not an expression that each line evaluates.
    rows = docs.select(row.alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.split(F.col(text_col), "\n", -1).alias("_lines"))
    rows = rows.join(gone, ["_id", "_hash"], "left")
    n = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone")), lambda i: F.get("_lines", i))
    text = F.array_join(F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(kept), "\n")
    return rows.select(
        *[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in others],
        n.cast("long").alias("n_lines"),
        (n - F.coalesce(F.array_size("_gone"), F.lit(0))).cast("long").alias("n_kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), lines AS (
  SELECT doc_id, no, trim(regexp_replace(parts[no + 1], '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line
  FROM raw, LATERAL (SELECT unnest(range(0, len(parts))) AS no) u
), seen AS (
  SELECT line, min(doc_id * 1000000 + no) AS first, length(line) AS n FROM lines WHERE line <> '' GROUP BY line
), halves AS (
  SELECT line, first, m, part, CASE part WHEN 0 THEN left(line, m // 2) ELSE right(line, m - m // 2) END AS half
  FROM (SELECT line, first, n - short AS m, part FROM seen, (SELECT unnest([0, 1]) AS short) s, (SELECT unnest([0, 1]) AS part) p)
), pairs AS (
  SELECT DISTINCT a.line, b.line AS early FROM halves a JOIN halves b ON a.m = b.m AND a.part = b.part AND a.half = b.half AND b.first < a.first
), near AS (
  SELECT DISTINCT line FROM pairs
  WHERE abs(length(line) - length(early)) <= 1 AND len(list_filter(range(0, length(line) + 1), lambda i: line[1:i] = early[1:i] AND
    (line[i + 2:] = early[i + 2:] OR line[i + 2:] = early[i + 1:] OR line[i + 1:] = early[i + 2:]))) > 0
), kept AS (
  SELECT l.doc_id, l.no FROM lines l LEFT JOIN seen s USING (line) LEFT JOIN near n USING (line)
  WHERE l.line = '' OR (n.line IS NULL AND l.doc_id * 1000000 + l.no = s.first)
)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, count(k.no) AS n_kept,
  sha256(coalesce(string_agg(string_split(text, chr(10))[k.no + 1], chr(10) ORDER BY k.no), '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.text
"""
