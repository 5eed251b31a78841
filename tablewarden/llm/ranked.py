"""Ranked lexical search: document FP-trees over the items' terms, searched by branch and bound."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import drop_scratch, materialise, number_of_parts, scratch_path, table

TOP = 10
#: Items are dealt into blocks of about so many (item, term) pairs; a block's vocabulary is sent to all tasks.
BLOCK_TERMS = 1 << 18
#: A tree holds so many documents or entries; a subtree of LEAF documents isn't split further.
TREE_DOCS, TREE_ENTRIES, LEAF = 4096, 1 << 21, 32
#: Long texts are cut into terms in pieces of so many bytes, between terms.
PIECE = 1 << 20

#: Bytes of ASCII letters and digits and of all other characters stay, A-Z lower-cased; the rest separates terms.
_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def count_terms(text: str | None, wanted: dict | frozenset | None = None) -> tuple[int, Counter]:
    """(number of terms, occurrences of the terms in wanted, or of all): terms as UTF-8 bytes."""
    raw = (text or "").encode("utf-8", "replace").translate(_KEEP)
    n, counts, at = 0, Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        terms = (raw[at:] if end < 0 else raw[at:end]).split()
        n += len(terms)
        counts.update(terms if wanted is None else filter(wanted.__contains__, terms))
        at = len(raw) if end < 0 else end
    return n, counts


def weight(docs: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * having + 1)))


def length_terms(n: int, docs: int, terms: int) -> int:
    return 100 - 90 + (90 * n * docs) // terms


class Tree:
    """An FP-tree: documents by their terms, most frequent first; common beginnings share a path.

    Documents lie in the order of their term sequences, so each subtree is a range of them. A node knows, for each child and each
    term in it, the greatest part of a score that a document there can get from the term: that of the most occurrences and the least m.
    """

    def __init__(self, ids: list, m: list[int], sequences: list[np.ndarray], occurrences: list[np.ndarray]):
        order = sorted(range(len(ids)), key=[s.astype(">u4").tobytes() for s in sequences].__getitem__)
        self.ids = [ids[i] for i in order]
        by_id = sorted(range(len(order)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        self.id_rank = np.empty(len(order), np.int64)
        self.id_rank[by_id] = np.arange(len(order))
        self.starts = np.concatenate([[0], np.cumsum([len(sequences[i]) for i in order])]).astype(np.int64)
        self.terms = np.concatenate([sequences[i] for i in order])
        self.tf = np.concatenate([occurrences[i] for i in order]).astype(np.int64)
        self.m = np.array([m[i] for i in order], np.int64)
        self.parts = part_of_score(self.tf, np.repeat(self.m, np.diff(self.starts)))
        self.root = self._grow(0, len(order), 0)

    def _shared(self, lo: int, hi: int) -> int:
        """Length of the beginning that all documents of the range share: that of the first and the last."""
        a, b = (self.terms[self.starts[i] : self.starts[i + 1]] for i in (lo, hi - 1))
        n = min(len(a), len(b))
        unlike = np.flatnonzero(a[:n] != b[:n])
        return int(unlike[0]) if len(unlike) else n

    def _grow(self, lo: int, hi: int, depth: int) -> dict:
        depth = max(depth, self._shared(lo, hi)) if hi - lo > LEAF else depth
        lengths = np.diff(self.starts[lo : hi + 1])
        if hi - lo <= LEAF or lengths[-1] <= depth:  # few documents, or all alike
            span = slice(self.starts[lo], self.starts[hi])
            by_term = np.argsort(self.terms[span], kind="stable")
            terms = self.terms[span][by_term]
            first = np.flatnonzero(np.diff(terms, prepend=-1))
            return {"lo": lo, "hi": hi, "children": None, "terms": terms[first], "tf": np.maximum.reduceat(self.tf[span][by_term], first), "m": int(self.m[lo:hi].min())}
        at = np.where(lengths > depth, self.terms[np.minimum(self.starts[lo:hi] + depth, len(self.terms) - 1)], -1)
        cuts = [lo]  # neighbouring small subtrees are one child together
        edges = [*(np.flatnonzero(np.diff(at)) + 1 + lo).tolist(), hi]
        for begin, end in zip([lo, *edges], edges):
            if end - cuts[-1] > LEAF and begin > cuts[-1]:
                cuts.append(begin)
        children = [self._grow(a, b, depth) for a, b in zip(cuts, [*cuts[1:], hi])]
        sizes = [len(c["terms"]) for c in children]
        terms, tf = np.concatenate([c["terms"] for c in children]), np.concatenate([c["tf"] for c in children])
        least = np.repeat(np.array([c["m"] for c in children], np.int64), sizes)
        by_term = np.argsort(terms, kind="stable")
        first = np.flatnonzero(np.diff(terms[by_term], prepend=-1))
        node = {"lo": lo, "hi": hi, "children": children, "terms": terms[by_term][first], "tf": np.maximum.reduceat(tf[by_term], first), "m": int(least.min())}
        node["below"] = (terms, part_of_score(tf, least), np.cumsum([0, *sizes[:-1]]))
        for c in children:
            del c["terms"], c["tf"]
        return node

    def search(self, weights: np.ndarray, best: list, top: int = TOP) -> int:
        """Put the documents that are among the best into best, a list of (-score, id is null, id) in order; returns how many were scored."""
        scored, stack = 0, [(None, self.root)]
        while stack:
            bound, node = stack.pop()
            least = -best[top - 1][0] if len(best) >= top else 1
            if bound is not None and bound < least:
                continue
            if node["children"]:
                terms, parts, starts = node["below"]
                bounds = np.add.reduceat(weights[terms] * parts, starts)
                for c in np.argsort(bounds, kind="stable"):  # the best child is the next one taken
                    if bounds[c] >= least:
                        stack.append((bounds[c], node["children"][c]))
                continue
            lo, hi = node["lo"], node["hi"]
            a, b = self.starts[lo], self.starts[hi]
            scores = np.add.reduceat(weights[self.terms[a:b]] * self.parts[a:b], self.starts[lo:hi] - a)
            scored += hi - lo
            good = np.flatnonzero(scores >= least)
            if len(good) > top:
                good = good[np.lexsort((self.id_rank[lo + good], -scores[good]))[:top]]
            if len(good):
                found = ((-int(scores[i]), self.ids[lo + i] is None, self.ids[lo + i]) for i in good)
                best[:] = heapq.nsmallest(top, [*best, *found], key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
        return scored


def part_of_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a document's score: grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): for each item the documents with the highest scores above 0, top at most.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; null has none. With N documents that have
    a term, L terms in all, n in a document and df documents that hold a term, a term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))), m is 10 + 90 n N div L, and a document scores the sum of weight * (10^9 tf div (1000 tf + 8 m))
    over the item's distinct terms. Equal scores: smaller id first, a null id last. Rows that share an id are documents of
    their own; rows that share an item's id are one item with the terms of all. Items without terms or without any document above
    0 give no rows, as do empty tables. Other columns are left out.

    Documents are read whole, once per block of items (one block up to about BLOCK_TERMS pairs of item and term; more items
    are dealt into more blocks, so what is sent to all tasks stays bounded). What is kept of a document is its
    id, its length and the terms of the block with their counts. Trees are built where these rows lie, without a
    shuffle; a task keeps each item's best over its trees, and a window merges them.
    """
    spark = docs.sparkSession
    item_type = items.select(item_col).limit(0).toArrow().schema.field(0).type
    id_type = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    item_kind, id_kind = (x.schema[c].dataType.simpleString() for x, c in ((items, item_col), (docs, id_col)))

    def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, text in enumerate(rows.column("text")):
                terms = list(count_terms(text.as_py())[1])
                yield pa.RecordBatch.from_arrays([rows.column("item").take(pa.array([i] * len(terms), pa.int64())), pa.array(terms, pa.binary())], names=["item", "term"])

    wanted = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    pairs = materialise(wanted.mapInArrow(item_terms, f"item {item_kind}, term binary").distinct(), "ranked-items")
    blocks = number_of_parts(pairs.count(), BLOCK_TERMS)
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        part = _rank_block(docs, pairs.filter(F.col("block") == block), top, id_col, text_col, (item_type, item_kind), (id_type, id_kind))
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _rank_block(docs: DataFrame, pairs: DataFrame, top: int, id_col: str, text_col: str, item: tuple, doc: tuple) -> DataFrame:
    spark = docs.sparkSession
    by_item: dict = {}
    for row in pairs.select("item", "term").toLocalIterator():  # about BLOCK_TERMS rows
        by_item.setdefault(row.item, []).append(bytes(row.term))
    vocabulary = {t: i for i, t in enumerate(sorted({t for terms in by_item.values() for t in terms}))}
    words = spark.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, with_terms, all_terms = words.value, 0, 0

        def batch(ids, n, terms, tf, totals):
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32())), pa.array(totals, pa.int64())],
                names=["id", "n", "terms", "tf", "docs"],
            )

        for rows in batches:
            at, n, terms, tf = [], [], [], []
            for i, text in enumerate(rows.column("text")):
                length, counts = count_terms(text.as_py(), known)
                with_terms, all_terms = with_terms + (length > 0), all_terms + length
                if counts:
                    at.append(i)
                    n.append(length)
                    terms.append([known[t] for t in counts])
                    tf.append(list(counts.values()))
            yield batch(rows.column("id").take(pa.array(at, pa.int64())), n, terms, tf, [None] * len(at))
        yield batch(pa.nulls(1, doc[0]), [all_terms], [None], [None], [with_terms])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    path, schema = scratch_path(spark, "ranked-vectors"), f"id {doc[1]}, n long, terms array<int>, tf array<int>, docs long"
    texts.mapInArrow(scan, schema).write.parquet(path)
    vectors = spark.read.schema(schema).parquet(path)
    n_docs, n_terms = vectors.filter(F.col("docs").isNotNull()).agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # the block's vocabulary
        having[row.t] = row["count"]
    order = np.argsort(-having, kind="stable")  # most frequent first, equal ones by the term
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    weights = np.array([weight(n_docs, int(h)) for h in having[order]], np.int64)
    asked = [(i, place[[vocabulary[t] for t in terms]]) for i, terms in by_item.items()]
    held = spark.sparkContext.broadcast((place, weights, asked, n_docs, n_terms))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, weighs, wanted, n_all, l_all = held.value
        best: list[list] = [[] for _ in wanted]
        dense = np.zeros(len(weighs), np.int64)

        def serve(ids, m, sequences, occurrences):
            tree = Tree(ids, m, sequences, occurrences)
            for own, (_, terms) in zip(best, wanted):
                dense[terms] = weighs[terms]
                tree.search(dense, own, top)
                dense[terms] = 0

        ids, m, sequences, occurrences, entries = [], [], [], [], 0
        for rows in batches:
            lengths = rows.column("n").to_pylist()
            flat, tf = places[rows.column("terms").flatten().to_numpy()], rows.column("tf").flatten().to_numpy()
            ends = np.cumsum(rows.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            for k, doc_id in enumerate(rows.column("id").to_pylist()):
                a, b = (ends[k - 1] if k else 0), ends[k]
                by_place = np.argsort(flat[a:b])
                ids.append(doc_id)
                m.append(length_terms(lengths[k], n_all, l_all))
                sequences.append(flat[a:b][by_place])
                occurrences.append(tf[a:b][by_place])
                entries += b - a
                if len(ids) >= TREE_DOCS or entries >= TREE_ENTRIES:
                    serve(ids, m, sequences, occurrences)
                    ids, m, sequences, occurrences, entries = [], [], [], [], 0
        if ids:
            serve(ids, m, sequences, occurrences)
        rows = [(i, doc_id, -score) for own, (i, _) in zip(best, wanted) for score, _, doc_id in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], item[0]), pa.array([r[1] for r in rows], doc[0]), pa.array([r[2] for r in rows], pa.int64())], names=["item", "id", "score"])

    found = vectors.filter(F.col("docs").isNull()).select("id", "n", "terms", "tf").mapInArrow(look_up, f"item {item[1]}, id {doc[1]}, score long")
    found = materialise(found, "ranked-found")
    drop_scratch(spark, path)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
t AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, {_TERMS} FROM d) GROUP BY rid, term),
l AS MATERIALIZED (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY rid),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
i AS MATERIALIZED (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM i) GROUP BY term), a),
s AS (SELECT i.item_id, t.rid, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (100 - 90 + ((90 * l.n * a.docs) // a.terms))))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN t USING (term) JOIN l USING (rid), a GROUP BY i.item_id, t.rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT s.item_id, row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id NULLS LAST) AS rank, d.doc_id, s.score FROM s JOIN d USING (rid) WHERE s.score > 0)
WHERE rank <= {TOP}
"""
