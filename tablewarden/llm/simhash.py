"""SimHash near-duplicates: fingerprints, links by the generalised pigeonhole principle, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.repeats import FLAG, flag_keys
from tablewarden.llm.common import materialise, number_of_parts, table
from tablewarden.llm.components import connected_components

BITS = 64
SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
#: Fingerprints that the plan of partitions and thresholds is estimated on. The plan decides the cost, never the result.
PLAN_SAMPLE = 20_000
PARTITION_COUNTS = (2, 3, 4, 5)
#: Cost of a probe (a row emitted, shuffled and sorted) and of a verified candidate (an element of a NumPy array), relative.
PROBE_COST, VERIFY_COST = 1.0, 0.01
KEYS_PER_TASK = 2_000_000
#: Buckets with more entries than this are split once more, by five exact parts of the fingerprint.
BUCKET = 4096
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of the lower-cased 4-word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-SHINGLE].tolist()]
        hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = np.array(hashes[i : i + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def add_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint as a signed long; null and blank texts get 0."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(F.col(text_col)))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bits into parts of almost equal width, each grown from a seed bit by the strongest mean correlation."""
    spread = bits.std(axis=0) > 0 if len(bits) else np.zeros(BITS, bool)
    cor = np.zeros((BITS, BITS))
    if len(bits) > 1 and spread.any():
        cor[np.ix_(spread, spread)] = np.abs(np.corrcoef(bits[:, spread].T))
    np.fill_diagonal(cor, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        order = sorted(free)
        group = [max(order, key=lambda b: cor[b, order].sum())]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: cor[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def _agreement(bits: np.ndarray, group: list[int], upto: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0..upto bits of the group."""
    p = bits[:, group].mean(axis=0) if len(bits) else np.full(len(group), 0.5)
    exactly = np.zeros(upto + 1)
    exactly[0] = 1
    for d in 2 * p * (1 - p):
        exactly[1:] = exactly[1:] * (1 - d) + exactly[:-1] * d
        exactly[0] *= 1 - d
    share = np.cumsum(exactly)
    if len(bits) > 3:
        half = len(bits) // 2
        apart = np.concatenate([(bits[:half][:, group] != np.roll(bits[half : 2 * half], k, axis=0)[:, group]).sum(axis=1) for k in range(16)])
        share = np.maximum(share, [(apart <= t).mean() for t in range(upto + 1)])
    return share


def plan(sample: np.ndarray, n: int, max_distance: int = MAX_DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions of the bits, each with its threshold (those with -1 are left out).

    Any pair within max_distance differs by at most t_i bits in some partition i if the t_i + 1 sum up to
    max_distance + 1. Dynamic programming over the partitions picks the thresholds with the least estimated cost
    (probes emitted and candidates verified among n fingerprints), for several numbers of partitions.
    """
    bits = _bits(sample)
    best = None
    for parts in PARTITION_COUNTS:
        groups = group_bits(bits, parts)
        table_ = {0: (0.0, [])}
        for group in groups:
            share = _agreement(bits, group, max_distance)
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table_.items():
                for t in range(-1, max_distance - used + 1):
                    if t > len(group):
                        continue
                    more = 0.0 if t < 0 else n * PROBE_COST * (1 + sum(comb(len(group), d) for d in range(t + 1))) + VERIFY_COST * n * n / 2 * share[t]
                    if used + t + 1 not in nxt or cost + more < nxt[used + t + 1][0]:
                        nxt[used + t + 1] = (cost + more, [*chosen, t])
            table_ = nxt
        cost, chosen = table_[max_distance + 1]
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _keys(nodes: DataFrame, planned: list[tuple[list[int], int]]) -> DataFrame:
    """(key, probe, fp, rep): each fingerprint under its own value of each partition, and as probe under all values within the threshold."""
    schema = pa.schema([("key", pa.int64()), ("probe", pa.bool_()), ("fp", pa.int64()), ("rep", pa.int64())])

    def emit(batches):
        for batch in batches:
            fp, rep = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
            for k, (group, t) in enumerate(planned):
                value = np.zeros(len(fp), np.int64)
                for i, bit in enumerate(group):
                    value |= ((fp >> bit) & 1) << i
                value += k << 56
                masks = [0] + [sum(1 << b for b in flip) for d in range(1, t + 1) for flip in combinations(range(len(group)), d)]
                for i in range(0, len(masks), 64):
                    some = np.array(masks[i : i + 64], np.int64)
                    key = (value[:, None] ^ some[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.tile(some != 0, len(fp))), pa.array(np.repeat(fp, len(some))), pa.array(np.repeat(rep, len(some)))],
                        schema=schema,
                    )

    return nodes.select("fp", "rep").mapInArrow(emit, "key long, probe boolean, fp long, rep long")


def forest(bucket: np.ndarray, probe: np.ndarray, fp: np.ndarray, max_distance: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (row, root row) of the verified links within each bucket; rows sorted by bucket, probes last.

    Links between an indexed row and any row of its bucket count. At most one edge a row comes out, however many
    links a bucket has. Rows that are known to be connected aren't compared, so a dense bucket costs little more than its rows; one
    of many rows without links costs all its pairs.
    """
    n = len(bucket)
    first = np.r_[True, bucket[1:] != bucket[:-1]] if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    size = np.diff(np.r_[np.flatnonzero(first), n])[np.cumsum(first) - 1] if n else np.zeros(0, int)
    end = start + size
    root = np.arange(n)
    code = fp.view(np.uint64)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root[:] = root[root]

    small = np.flatnonzero((size <= 64) & ~probe & (size > 1))
    step, left = 1, small
    while len(left):
        left = left[left + step < end[left]]
        near = np.bitwise_count(code[left] ^ code[left + step]) <= max_distance
        join(left[near], left[near] + step)
        step += 1
    for s in np.flatnonzero(first & (size > 64)):
        e = end[s]
        indexed = s + np.flatnonzero(~probe[s:e])
        for i in range(0, len(indexed), block):
            rows = indexed[i : i + block]
            trees, sizes = np.unique(root[rows], return_counts=True)
            main = trees[sizes.argmax()]  # rows of one tree needn't meet the rest of it: in a dense bucket that is nearly all
            within = root[rows] == main
            for own, others in ((rows[within], s + np.flatnonzero(root[s:e] != main)), (rows[~within], np.arange(s, e))):
                for j in range(0, len(others) if len(own) else 0, block):
                    cols = others[j : j + block]
                    a, b = np.nonzero(np.bitwise_count(code[own][:, None] ^ code[cols][None, :]) <= max_distance)
                    apart = root[own[a]] != root[cols[b]]
                    join(own[a[apart]], cols[b[apart]])
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _verify(keys: DataFrame, parts: int, max_distance: int) -> DataFrame:
    """(a, b): representatives of linked fingerprints, a forest for each bucket."""

    def edges(batches):
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table):
            moved, root = forest(rows["key"].to_numpy(), rows["probe"].to_numpy(), rows["fp"].to_numpy(), max_distance)
            rep = rows["rep"].to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root])], names=["a", "b"])

        def cut(rows: pa.Table, at_end: bool):
            """Whole buckets, and the bucket that may go on."""
            key = rows["key"].to_numpy()
            return rows.num_rows if at_end or not len(key) else int(np.searchsorted(key, key[-1]))

        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= 200_000:
                rows = pa.Table.from_batches(held)
                at = cut(rows, False)
                if at:
                    yield out(rows.slice(0, at))
                held = rows.slice(at).to_batches()
                waiting = 0 if at else waiting - 200_000
        if held:
            yield out(pa.Table.from_batches(held))

    dealt = keys.repartition(parts, "key").sortWithinPartitions("key", "probe")
    return dealt.mapInArrow(edges, "a long, b long").distinct()


def links(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): links that connect all fingerprints of nodes(fp, rep) within max_distance bits, fewer than all pairs.

    nodes has one row per distinct fingerprint. Partitions and thresholds come from a bounded sample.
    """
    sample = nodes.select("fp").orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).toPandas().fp.to_numpy(np.int64).view(np.uint64)
    n = nodes.count()
    planned = plan(sample, n, max_distance)
    per_node = sum(sum(comb(len(g), d) for d in range(t + 1)) for g, t in planned)
    parts = number_of_parts(n * per_node, KEYS_PER_TASK, least=2)
    keys = _keys(nodes, planned)
    hot = materialise(keys.filter("NOT probe").groupBy("key").count().filter(F.col("count") > BUCKET).select("key", F.lit(True).alias("hot")), "simhash-hot")
    part_bits = -(-BITS // (max_distance + 1))
    split = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(max_distance))).otherwise(F.array(F.lit(-1)))
    keys = keys.join(hot, "key", "left").withColumn("j", F.explode(split))
    within = F.expr(f"shiftrightunsigned(fp, greatest(j, 0) * {part_bits}) & {(1 << part_bits) - 1}")
    keys = keys.select(F.when(F.col("j") < 0, F.col("key")).otherwise(F.xxhash64("key", "j", within)).alias("key"), "probe", "fp", "rep")
    return _verify(keys, parts, max_distance)


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc id, fingerprint (signed long), component_id per row of docs. Ids are of any type that has an order, as is component_id.

    Documents link if their fingerprints differ in at most max_distance bits; a component is what links reach, named
    by its smallest id. All documents of one fingerprint are one node, so copies cost no pairs. Null and blank texts
    have fingerprint 0 and link like any other. Fingerprints are what links join, so rows without an id link too and
    rows that repeat an id may lie in several components; component_id is null if no row of the component has an id.
    An empty table gives no rows.
    """
    return _components(docs, text_col, id_col, max_distance).select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def _components(docs: DataFrame, text_col: str, id_col: str, max_distance: int) -> DataFrame:
    """Per row of docs: id, _hash (of the text), fp, component_id, _keep (the row of its component that stays: _no_id, _id, _hash)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    prints = materialise(add_fingerprint(texts, "_text", "fp").drop("_text"), "simhash-prints")
    first = F.min(F.struct(F.col("id").isNull().alias("_no_id"), F.col("id").alias("_id"), "_hash"))
    nodes = materialise(prints.groupBy("fp").agg(first.alias("_first")), "simhash-nodes")
    found = connected_components(links(nodes.select("fp", F.col("fp").alias("rep")), max_distance))
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "_first", F.coalesce("component", "fp").alias("_root"))
    rooted = materialise(rooted, "simhash-roots")
    kept = rooted.groupBy("_root").agg(F.min("_first").alias("_keep"))
    named = materialise(rooted.join(kept, "_root").select("fp", "_keep", F.col("_keep._id").alias("component_id")), "simhash-components")
    return prints.join(named, "fp", "left")


def simhash_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs with one document of each component, the one with the smallest id, with its columns.

    Ids are compared with the text's hash, so of rows that repeat an id each stays or goes by its own component. Rows
    without an id come after all others; among rows alike in that, the smallest hash stays. Rows alike in id (or
    without one) and text stay or go together. An empty table gives no rows. Only rows that may go, by bitmaps of what goes, are dealt
    out by id; the others stay where they are.
    """
    found = _components(docs, text_col, id_col, max_distance)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  no id is an empty text
    gone = ~(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("_hash") == F.col("_keep._hash")))
    dropped = materialise(found.filter(gone).select(name("id").alias("_key"), "_hash").distinct(), "simhash-dropped")
    whole = docs.select(F.struct("*").alias("_row"), name(id_col).alias("_key"), F.xxhash64(text_col).alias("_hash"))
    listed = flag_keys(whole, F.xxhash64("_key", "_hash"), dropped.select(F.xxhash64("_key", "_hash").alias("k")))
    kept = listed.filter(FLAG).join(dropped, ["_key", "_hash"], "left_anti").select("_row")
    return kept.union(listed.filter(~F.col(FLAG)).select("_row")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
