"""Decision trees and forests of unlimited depth on exact splits.

A tree grows in two phases. Nodes of many rows are split level by level over all data, from counts of
(node, feature, value, class) that are aggregated and summed up in two steps. Once a node's rows fit a task, one
grouped task grows all that is below it. The driver holds the splits of the first phase only. Between steps
a node's rows travel in pieces, arrays in the narrowest types that hold them, so a forest costs Spark no row per tree and vector.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.columns import match_nulls
from tablewarden.functions.scratch import drop_scratch, materialise, scratch_path
from tablewarden.operators.quantiles import range_of

#: A node of at most so many rows (distinct vector and label) is grown in one task, of fewer if they hold more than CELLS values.
SMALL_NODE, CELLS = 400_000, 20_000_000
#: Up to so many trees each add to a node's bound: many trees keep all tasks busy with larger nodes, and a level of theirs costs a pass over all rows of all trees.
TREES_COUNTED = 10
#: Rows that such a task works on at once, unless one node has more.
ROWS_AT_ONCE = 1 << 18
#: Leading bits of a value's fraction that tell ranges apart, within which values are put in order.
RANGE_BITS = 12
#: Rows of a chunk of a table, which pieces are cut from.
CHUNK = 1 << 15
#: Vectors that one task predicts in one subtree; it takes them piece by piece.
PREDICTED_AT_ONCE = 2_000_000
#: Of so many rows alike each tree draws at once.
LUMP = 1024
#: Bytes of a stored subtree in one row.
PART = 1 << 23
NODES = "tree int, top string, path string, feature int, threshold double, p array<double>"
PACKED = "tree int, top string, part int, kinds string, data binary"
PIECES = "tree int, path string, n long, kinds string, data binary, c array<bigint>, low array<double>, high array<double>"


class Subtree(NamedTuple):
    """All that lies below a node (top) of the first phase: feature (-1 in a leaf), threshold, and at: the left child's place (the right one

    follows), in a leaf the place of its first entry in classes and shares, which hold only what is above 0.
    """

    tree: int
    top: str
    feature: np.ndarray
    threshold: np.ndarray
    at: np.ndarray
    classes: np.ndarray
    shares: np.ndarray


@dataclass
class Forest:
    """tops has the splits of the first phase by level, (tree, path) -> (feature, threshold); packed has the subtrees below its ends, in parts."""

    features: list[str]
    classes: list[str]
    trees: int
    tops: list[dict]
    packed: DataFrame

    @property
    def nodes(self) -> DataFrame:
        """A row per node: tree, top (the node of the first phase that it lies below), path, and either feature and threshold or p."""
        k = len(self.classes)
        return self.packed.groupBy("tree", "top").applyInPandas(lambda parts: unpacked(_subtree(parts), k), NODES)


def narrow(a: np.ndarray) -> np.ndarray:
    """a in the narrowest type that holds each of its values."""
    for kind in ("u1", "u2", "f4") if a.dtype.kind == "f" else ("u1", "i2", "i4"):
        with np.errstate(all="ignore"):
            b = a.astype(kind)
        if (b == a).all():
            return b
    return a


def pack(arrays: list[np.ndarray]) -> tuple[str, bytes]:
    """Types and lengths of arrays, and their bytes."""
    return ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays), b"".join(a.tobytes() for a in arrays)


def unpack(kinds: str, data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for kind, n in (each.split(":") for each in kinds.split(",")):
        out.append(np.frombuffer(data, kind, int(n), at))
        at += out[-1].nbytes
    return out


def _stored(t: Subtree) -> list[tuple]:
    """A subtree as rows of packed."""
    threshold = np.where(t.feature < 0, 0.0, t.threshold)
    kinds, data = pack([narrow(np.asarray(a)) for a in (t.feature, threshold, t.at, t.classes, t.shares)])
    return [(t.tree, t.top, i // PART, kinds, data[i : i + PART]) for i in range(0, len(data), PART)]


def _subtree(parts: pd.DataFrame) -> Subtree:
    """A subtree from its rows of packed."""
    parts = parts.sort_values("part")
    feature, threshold, at, classes, shares = unpack(parts.kinds.iloc[0], b"".join(parts.data))
    return Subtree(int(parts.tree.iloc[0]), parts["top"].iloc[0], feature, threshold, at.astype(np.int64), classes, shares)


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of batches in frames of at most CHUNK rows, not many less."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CHUNK:
            whole = pd.concat(held, ignore_index=True)
            full = n - n % CHUNK
            yield from (whole[i : i + CHUNK] for i in range(0, full, CHUNK))
            held, n = [whole[full:]], n - full
    if n:
        yield pd.concat(held, ignore_index=True)


def _mix(*parts: int) -> int:
    """A 64-bit hash of whole numbers, the same wherever it is worked out."""
    h = 0x9E3779B97F4A7C15
    for p in parts:
        h = ((h ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 31
        h = (h * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


def feature_order(seed: int, tree: int, path: str, n: int) -> list[int]:
    """The order in which a node of a forest looks at features; the first ones that aren't constant are its choice."""
    at = int(path, 2) if path else 0
    return sorted(range(n), key=lambda f: _mix(seed, tree, len(path), at, f))


def _mixed(*parts) -> np.ndarray:
    """_mix for arrays."""
    h = np.array(0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        p = np.asarray(p & 0xFFFFFFFFFFFFFFFF if isinstance(p, int) else p).astype(np.uint64)
        h = (np.atleast_1d(h ^ p)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def feature_orders(seed: int, tree: int, depth: int, at: np.ndarray, n: int) -> np.ndarray:
    """feature_order of each node of a level; at is its path as a number, modulo 2 ** 64."""
    return np.stack([_mixed(seed, tree, depth, at, f) for f in range(n)], axis=1).argsort(axis=1, kind="stable")


@functools.cache
def _chances(size: int) -> np.ndarray:
    """Poisson's distribution of mean size: chances of at most 0, 1, 2, ... draws."""
    most = size + 12 * math.isqrt(size) + 24
    return np.cumsum([math.exp(i * math.log(size) - size - math.lgamma(i + 1)) for i in range(most)])


def draws(key: np.ndarray, w: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row of w rows alike: by Poisson's distribution of mean 1 for each, by a hash of the row's key."""
    lumps = -(-w // LUMP)
    row = np.repeat(np.arange(len(w)), lumps)
    lump = np.arange(len(row)) - np.repeat(lumps.cumsum() - lumps, lumps)
    size = np.minimum(w[row] - lump * LUMP, LUMP)
    chance = (_mixed(seed, tree, key[row], lump) >> np.uint64(11)) / float(1 << 53)
    drawn = np.zeros(len(row), np.int64)
    for each in np.unique(size):
        own = np.flatnonzero(size == each)
        drawn[own] = np.searchsorted(_chances(int(each)), chance[own], side="right")
    return drawn if len(row) == len(w) else np.bincount(row, weights=drawn, minlength=len(w)).astype(np.int64)


def middle(a, b):
    m = a / 2 + b / 2
    return np.where((a <= m) & (m < b), m, a)


def _fold(y: np.ndarray, w: np.ndarray, k: int, width: int) -> list[np.ndarray]:
    """The weights of k classes side by side in whole numbers, width bits each, so that few sums run over all rows; they are exact as doubles, too."""
    each = max(1, 52 // width)
    return [np.where(y // each == i, w << (width * (y % each)), 0) for i in range(-(-k // each))]


def _unfold(sums: list[np.ndarray], k: int, width: int) -> list[np.ndarray]:
    each, mask = max(1, 52 // width), (1 << width) - 1
    return [((sums[c // each] >> (width * (c % each))) & mask).astype(float) for c in range(k)]


def _best_cuts(code: np.ndarray, node: np.ndarray, folded: list[np.ndarray], totals: np.ndarray, bits: int, width: int) -> tuple | None:
    """(node, score, code before the cut, code behind it, class weights before it): each node's best cut of a feature, of equal ones the first.

    Rows come with their node, nodes in order; a code has so many bits. A node without a cut isn't listed.
    """
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    least = np.minimum.reduceat(code, start)
    span = np.maximum.reduceat(code, start) - least + 1
    behind_last = span.cumsum()
    place, cells = len(code).bit_length(), int(behind_last[-1])
    if cells <= len(code):  # few values: counted, not put in order
        offset = behind_last - span - least
        at = code + np.repeat(offset, np.diff(np.r_[start, len(node)]))
        held = np.flatnonzero(np.bincount(at, minlength=cells))
        of = np.searchsorted(behind_last, held, side="right")
        key = (node[start[of]] << bits) | (held - offset[of])
        sums = [np.bincount(at, weights=part, minlength=cells)[held].astype(np.int64).cumsum()[:-1] for part in folded]
        own, behind = key[:-1] >> bits, key[1:]
        key = key[:-1]
    else:
        if int(node[-1]).bit_length() + bits + place > 63:
            by = np.lexsort((code, node))
            key = (node[by] << bits) | code[by]
        else:
            key = (((node << bits) | code) << place) | np.arange(len(code))
            if (key[1:] < key[:-1]).any():
                key.sort()
            by = key & ((1 << place) - 1)
            key >>= place
        ends = np.flatnonzero(key[1:] != key[:-1])
        sums = [part[by].cumsum()[ends] for part in folded]
        own, behind = key[ends] >> bits, key[ends + 1]
        key = key[ends]
    last = own != behind >> bits
    cut = np.flatnonzero(~last)
    if not len(cut):
        return None
    own, segment, last = own[cut], last.cumsum()[cut], np.flatnonzero(last)
    lefts = _unfold([s[cut] - np.r_[0, s[last]][segment] for s in sums], len(totals), width)
    score = squares = n_left = n_right = 0.0
    for left, total in zip(lefts, totals):
        right = total[own] - left
        n_left, n_right = n_left + left, n_right + right
        score, squares = score + left * left, squares + right * right
    score = score / n_left + squares / n_right
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    top = np.repeat(np.maximum.reduceat(score, start), np.diff(np.r_[start, len(own)]))
    at = np.flatnonzero(score == top)
    at = at[np.r_[True, own[at][1:] != own[at][:-1]]]
    mask = (1 << bits) - 1
    return own[at], score[at], key[cut[at]] & mask, behind[cut[at]] & mask, np.stack([left[at] for left in lefts])


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, tree: int, top: str, most: int, seed: int) -> Subtree:
    """The subtree from top on down: many nodes of a level at once, by the least Gini impurity.

    Of equal splits the smaller feature, then the smaller threshold. Nodes of one class are left as soon as they are
    made; the rest goes on in blocks of about ROWS_AT_ONCE rows.
    """
    n = x.shape[1]
    np.empty(31 << 20, np.uint8)  # once so much was freed, memory stays with the process between steps
    values, codes = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(n)))
    bits = [len(v).bit_length() for v in values]
    by = codes[int(np.argmax(bits))].argsort(kind="stable")  # what is in order needs no sort
    y, w = np.asarray(y, np.int64)[by], np.asarray(w, np.int64)[by]
    width = int(w.sum()).bit_length()
    splits, leaves, made = [], [], 1

    def leaf(places: np.ndarray, totals: np.ndarray) -> None:
        cls, at = np.nonzero(totals)
        leaves.append((places[at], cls, (totals / totals.sum(axis=0))[cls, at]))

    totals = np.bincount(y, weights=w, minlength=k)[:, None]
    path = np.array([int(top, 2) & 0xFFFFFFFFFFFFFFFF if top else 0], np.uint64)
    one = np.zeros(1, np.int64)
    todo = [(one, len(top), path, totals, np.zeros(len(y), np.int64), [c[by].astype(np.int64) for c in codes], _fold(y, w, k, width))]
    if (totals > 0).sum() == 1:
        leaf(one, totals)
        todo = []
    while todo:
        places, depth, path, totals, node, code, folded = todo.pop()
        m = len(places)
        feature, low, threshold, best = np.full(m, -1), np.zeros(m, np.int64), np.zeros(m), np.full(m, -np.inf)
        lefts, found = np.zeros((k, m)), np.zeros(m, np.int64)
        orders = feature_orders(seed, tree, depth, path, n) if most < n else np.broadcast_to(np.arange(n), (m, n))
        for order in orders.T:
            for f in np.unique(order[found < most]):
                looks = (found < most) & (order == f)
                part = slice(None) if looks.all() else np.flatnonzero(looks[node])
                cuts = _best_cuts(code[f][part], node[part], [p[part] for p in folded], totals, bits[f], width)
                if cuts is None:
                    continue
                at, s, a, b, left = cuts
                found[at] += 1
                better = (s > best[at]) | ((s == best[at]) & (f < feature[at]))
                at, a, b = at[better], a[better], b[better]
                best[at], feature[at], low[at], threshold[at], lefts[:, at] = s[better], f, a, middle(values[f][a], values[f][b]), left[:, better]
        split = feature >= 0
        leaf(places[~split], totals[:, ~split])
        rank = split.cumsum() - 1
        splits.append((places[split], feature[split], threshold[split], made + 2 * rank[split]))
        right = np.zeros(len(node), bool)
        for f in np.unique(feature[split]):
            part = slice(None) if (feature == f).all() else np.flatnonzero((feature == f)[node])
            right[part] = code[f][part] > low[node[part]]
        sides, number = [], 0
        for side, sums in enumerate((lefts, totals - lefts)):
            mixed = split & ((sums > 0).sum(axis=0) > 1)
            pure = split & ~mixed
            leaf(made + 2 * rank[pure] + side, sums[:, pure])
            rows = np.flatnonzero((right == side) & mixed[node])
            sides.append((made + 2 * rank[mixed] + side, path[mixed] * np.uint64(2) + np.uint64(side), sums[:, mixed], (mixed.cumsum() - 1 + number)[node[rows]], rows))
            number += int(mixed.sum())
        made += 2 * int(split.sum())
        places, path, totals, node, rows = (np.concatenate(each, axis=-1) for each in zip(*sides))
        ends, first = np.searchsorted(node, np.arange(number), side="right"), 0
        while first < number:
            a = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, a + ROWS_AT_ONCE, side="right")))
            b = int(ends[last - 1])
            own, block = rows[a:b], slice(first, last)
            todo.append((places[block], depth + 1, path[block], totals[:, block], node[a:b] - first, [c[own] for c in code], [p[own] for p in folded]))
            first = last
    feature, threshold, at = np.full(made, -1), np.full(made, np.nan), np.zeros(made, np.int64)
    for own, f, cut, left in splits:
        feature[own], threshold[own], at[own] = f, cut, left
    own, classes, shares = (np.concatenate(each) for each in zip(*leaves))
    by, held = own.argsort(kind="stable"), np.bincount(own, minlength=made)
    return Subtree(tree, top, feature, threshold, np.where(feature < 0, held.cumsum() - held, at), classes[by], shares[by])


def unpacked(r, k: int) -> pd.DataFrame:
    """The nodes of a subtree, with paths."""
    feature, path = np.asarray(r.feature), [r.top] + [""] * (len(r.feature) - 1)
    for i in np.flatnonzero(feature >= 0):
        path[r.at[i]], path[r.at[i] + 1] = path[i] + "0", path[i] + "1"
    shares = iter(shares_of(r, k).tolist())
    p = [None if f >= 0 else next(shares) for f in feature]
    out = pd.DataFrame({"tree": r.tree, "top": r.top, "path": path, "feature": pd.array(np.where(feature >= 0, feature, 0), "Int32"), "threshold": r.threshold, "p": p})
    out.loc[feature < 0, "feature"] = pd.NA
    out["threshold"] = out["threshold"].astype(object).where(feature >= 0, None)
    return out


def shares_of(r, k: int) -> np.ndarray:
    """The class shares of the leaves of a subtree, in order."""
    start = np.asarray(r.at)[np.asarray(r.feature) < 0]
    out = np.zeros((len(start), k))
    out[np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(r.classes)])), np.asarray(r.classes, int)] = r.shares
    return out


def _vector(features: list[str]) -> Column:
    """The features as doubles; null and NaN as less than every number."""
    clean = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), F.lit(float("-inf"))) + F.lit(0.0)
    return F.array(*[clean(c) for c in features])


def _piece(tree: int, path: str, x: list[np.ndarray], y: np.ndarray, w: np.ndarray, k: int) -> tuple:
    """Rows of a node as a row of pieces, with their number, class weights and ranges."""
    sums = np.bincount(y, weights=w, minlength=k).astype(np.int64)
    return (tree, path, len(y), *pack([*x, y, narrow(w)]), sums.tolist(), [float(a.min()) for a in x], [float(a.max()) for a in x])


_PIECE = ["tree", "path", "n", "kinds", "data", "c", "low", "high"]


def _drawn(named: DataFrame, n: int, k: int, trees: int, bootstrap: bool, seed: int) -> DataFrame:
    """The rows of each tree, in pieces. Rows lie in order of the feature of most values, so that a piece has few of its values."""
    names = [f"x{i}" for i in range(n)]
    rows = named.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)], "y", "w", F.xxhash64("f", "y").alias("h"))
    distinct = rows.agg(F.count("*").alias("n"), *[F.approx_count_distinct(c, 0.1).alias(c) for c in names]).first()
    lead = max(names, key=lambda c: distinct[c])

    def each(batches):
        for chunk in _chunked(batches):
            x, y = [narrow(chunk[c].to_numpy(float)) for c in names], narrow(chunk.y.to_numpy(np.int64))
            w, key = chunk.w.to_numpy(np.int64), chunk.h.to_numpy(np.int64).view(np.uint64)
            out = []
            for t in range(trees):
                taken = draws(key, w, seed, t) if bootstrap else w
                held = np.flatnonzero(taken)
                if len(held):
                    out.append(_piece(t, "", [a[held] for a in x], y[held], taken[held], k))
            yield pd.DataFrame(out, columns=_PIECE)

    parts = 1 + distinct.n // (4 * CHUNK)
    return rows.repartitionByRange(parts, lead).sortWithinPartitions(lead).mapInPandas(each, PIECES)


def _level(pieces: DataFrame, big: list[tuple], k: int) -> dict:
    """(tree, path) -> (feature, threshold) of the best split of each node of big: (tree, path, features that it looks at, class weights)."""
    spark, node = pieces.sparkSession, ["tree", "path"]
    held = F.broadcast(spark.createDataFrame(big, "tree int, path string, features array<int>, t array<bigint>"))  # a row per node of many rows

    def counted(batches):
        for batch in batches:
            for r in batch.itertuples():
                *x, y, w = unpack(r.kinds, r.data)
                for f in r.features:
                    values, code = np.unique(x[f], return_inverse=True)
                    sums = np.bincount(code * k + y, weights=w, minlength=len(values) * k).reshape(-1, k)
                    yield pd.DataFrame({"tree": r.tree, "path": r.path, "feature": f, "x": values.astype(float)} | {f"c{c}": sums[:, c].astype(np.int64) for c in range(k)})

    asked = pieces.select(*node, "kinds", "data").join(held.select(*node, "features"), node)
    cells = asked.mapInPandas(counted, "tree int, path string, feature int, x double, " + ", ".join(f"c{c} long" for c in range(k)))
    cells = cells.withColumn("r", range_of(F.col("x"), RANGE_BITS))
    values = materialise(cells.groupBy(*node, "feature", "r", "x").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(k)]), "trees-values")
    ranges = values.groupBy(*node, "feature", "r").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(k)], F.min("x").alias("low"))
    along = Window.partitionBy(*node, "feature").orderBy("r")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.coalesce(F.sum(f"c{c}").over(before), F.lit(0)).alias(f"b{c}") for c in range(k)]
    ranges = ranges.select(*node, "feature", "r", *ahead, F.lead("low").over(along).alias("next_low"))
    inside = Window.partitionBy(*node, "feature", "r").orderBy("x")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    left = [(F.col(f"b{c}") + F.sum(f"c{c}").over(upto)).cast("double").alias(f"l{c}") for c in range(k)]
    following = F.coalesce(F.lead("x").over(inside), F.col("next_low")).alias("next")
    cuts = values.join(ranges, [*node, "feature", "r"]).select(*node, "feature", "x", *left, following).filter("next IS NOT NULL")
    square = lambda cs: sum((c * c for c in cs[1:]), cs[0] * cs[0])
    whole = lambda cs: sum(cs[1:], cs[0])
    ls = [F.col(f"l{c}") for c in range(k)]
    rs = [F.get("t", F.lit(c)).cast("double") - F.col(f"l{c}") for c in range(k)]
    score = square(ls) / whole(ls) + square(rs) / whole(rs)
    cut = F.struct(score.alias("s"), (-F.col("feature")).alias("f"), (-F.col("x")).alias("x"), "next").alias("cut")
    best = cuts.join(held.select(*node, "t"), node).select(*node, cut).groupBy(*node).agg(F.max("cut").alias("b"))
    return {(r.tree, r.path): (-r.b.f, float(middle(-r.b.x, r.b.next))) for r in best.collect()}  # a row per node of many rows


def fit(train: DataFrame, features: list[str], label: str, trees: int = 1, bootstrap: bool = False, most: int | None = None, seed: int = 42) -> Forest:
    """A forest of so many trees, each grown until its leaves are pure or hold one vector.

    bootstrap draws each row by Poisson's distribution of mean 1 for each tree, by a hash of its vector and label; rows alike are drawn
    together. most is the number of features that a node looks at. Rows alike are one row with a weight, so a vector that fills
    a third of the table costs one. Null labels are refused; a null or NaN feature counts as less than every number. An
    empty table is refused.
    """
    spark, n = train.sparkSession, len(features)
    most = most or n
    named = train.select(_vector(features).alias("f"), F.col(label).cast("string").alias("label")).groupBy("f", "label").agg(F.count("*").alias("w"))
    named = materialise(named, "trees-vectors")
    classes = [r[0] for r in named.select("label").distinct().orderBy("label").collect()]  # a row per class
    if not classes or None in classes:
        raise ValueError("a tree needs rows, each with a label")
    k = len(classes)
    y = F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("int") - 1
    written: list[str] = []

    def kept(pieces: DataFrame) -> DataFrame:
        written.append(scratch_path(spark, "trees-pieces"))
        pieces.write.parquet(written[-1])
        return spark.read.schema(PIECES).parquet(written[-1])

    rows = kept(_drawn(named.select("f", y.alias("y"), "w"), n, k, trees, bootstrap, seed))
    tops: list[dict] = []
    leaves: list[Subtree] = []
    small: DataFrame | None = None  # pieces of all nodes that fit a task, whatever their level
    groups, at_most = 0, max(1, min(SMALL_NODE * min(trees, TREES_COUNTED), CELLS // n))

    def leaf(r) -> None:
        held = [c for c in range(k) if r.c[c] > 0]
        leaves.append(Subtree(r.tree, r.path, np.array([-1]), np.zeros(1), np.zeros(1, int), np.array(held), np.array([r.c[c] / sum(r.c) for c in held])))

    each = lambda how, name, m: F.array(*[how(F.get(name, F.lit(i))) for i in range(m)]).alias(name)
    while True:
        stats = rows.groupBy("tree", "path").agg(F.sum("n").alias("n"), each(F.sum, "c", k), each(F.min, "low", n), each(F.max, "high", n)).collect()
        big, few = [], [(r.tree, r.path) for r in stats if r.n <= at_most]
        for r in stats:
            if r.n > at_most:
                order = feature_order(seed, r.tree, r.path, n) if most < n else range(n)
                looks = [f for f in order if r.low[f] < r.high[f]][:most] if sum(c > 0 for c in r.c) > 1 else []
                if looks:
                    big.append((r.tree, r.path, looks, r.c))
                else:
                    leaf(r)  # one class, or one vector with several
        if few:
            part = rows.join(F.broadcast(spark.createDataFrame(few, "tree int, path string")), ["tree", "path"]) if len(few) < len(stats) else rows
            part = part.select("tree", "path", "kinds", "data")
            small, groups = part if small is None else small.unionByName(part), groups + len(few)
        if not big:
            break
        tops.append(_level(rows, big, k))
        rows = kept(_descend(rows, tops[-1], k))

    def grown(group: pd.DataFrame) -> pd.DataFrame:
        *x, y, w = (np.concatenate(a) for a in zip(*[unpack(r.kinds, r.data) for r in group.itertuples()]))
        tree = grow(np.stack([a.astype(float) for a in x], axis=1), y, w, k, int(group.tree.iloc[0]), group.path.iloc[0], most, seed)
        return pd.DataFrame(_stored(tree), columns=["tree", "top", "part", "kinds", "data"])

    packed = spark.createDataFrame([row for t in leaves for row in _stored(t)], PACKED)
    if small is not None:
        packed = packed.unionByName(small.repartition(4 * groups, "tree", "path").groupBy("tree", "path").applyInPandas(grown, PACKED))  # few of the parts get two nodes
    packed = materialise(packed, "trees-packed")
    for path in written:
        drop_scratch(spark, path)
    return Forest(features, classes, trees, tops, packed)


def _descend(pieces: DataFrame, splits: dict, k: int) -> DataFrame:
    """The rows of the nodes that are split, one level down."""
    table = pieces.sparkSession.createDataFrame([(t, p, f, x) for (t, p), (f, x) in splits.items()], "tree int, path string, feature int, threshold double")

    def each(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                *x, y, w = unpack(r.kinds, r.data)
                left = x[r.feature].astype(float) <= r.threshold
                for side, held in (("0", np.flatnonzero(left)), ("1", np.flatnonzero(~left))):
                    if len(held):
                        out.append(_piece(r.tree, r.path + side, [a[held] for a in x], y[held], w[held], k))
            if out:
                yield pd.DataFrame(out, columns=_PIECE)

    met = pieces.select("tree", "path", "kinds", "data").join(F.broadcast(table), ["tree", "path"])  # a row per node of many rows
    return met.mapInPandas(each, PIECES)


def leaf_numbers(tree: Subtree, x: np.ndarray) -> np.ndarray:
    """Which leaf, counted in order, each row of x comes to."""
    feature, threshold, at = np.asarray(tree.feature), np.asarray(tree.threshold, float), np.asarray(tree.at)
    here = np.zeros(len(x), np.int64)
    going = np.flatnonzero(feature[here] >= 0)
    while len(going):
        node = here[going]
        here[going] = at[node] + (x[going, feature[node]] > threshold[node])
        going = going[feature[here[going]] >= 0]
    return (feature < 0).cumsum()[here] - 1


def walk(tree, x: np.ndarray, k: int) -> np.ndarray:
    """The class shares of the leaf that each row of x comes to in a subtree."""
    return shares_of(tree, k)[leaf_numbers(tree, x)]


def _entries(tree: Subtree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, as (row, class, share) of what is above 0."""
    start = np.asarray(tree.at)[np.asarray(tree.feature) < 0]
    number = leaf_numbers(tree, x)
    held = np.diff(np.r_[start, len(tree.classes)])[number]
    at = np.arange(held.sum()) + np.repeat(start[number] - (held.cumsum() - held), held)
    return np.repeat(np.arange(len(x)), held), tree.classes[at], tree.shares[at]


def _asked(forest: Forest, chunks: DataFrame) -> DataFrame:
    """For each tree and chunk of vectors a piece for each node of the first phase that some come to: their features and places in the chunk."""
    splits = {at: split for level in forest.tops for at, split in level.items()}
    trees = forest.trees

    def each(batches):
        for batch in batches:
            for r in batch.itertuples():
                x = unpack(r.kinds, r.data)
                out, going = [], [(t, "", np.arange(r.n)) for t in range(trees)]
                while going:
                    t, p, i = going.pop()
                    if (t, p) in splits:
                        f, threshold = splits[t, p]
                        left = x[f][i].astype(float) <= threshold
                        going += [(t, p + side, part) for side, part in (("0", i[left]), ("1", i[~left])) if len(part)]
                    else:
                        out.append((t, p, r.chunk, len(i), *pack([*[a[i] for a in x], narrow(i)])))
                yield pd.DataFrame(out, columns=["tree", "path", "chunk", "n", "kinds", "data"])

    return materialise(chunks.mapInPandas(each, "tree int, path string, chunk long, n long, kinds string, data binary"), "trees-asked")


def probabilities(forest: Forest, df: DataFrame) -> DataFrame:
    """(f, p) for each distinct vector of df: the mean over trees of its leaf's class shares.

    Chunks of vectors first go down the splits of the first phase, which every task has; then each subtree meets its own vectors, in groups of
    at most about PREDICTED_AT_ONCE, and each chunk what its vectors came to, which is summed up in the order of trees.
    """
    k, n, trees = len(forest.classes), len(forest.features), forest.trees
    names = [f"x{i}" for i in range(n)]
    vectors = df.select(_vector(forest.features).alias("f")).distinct().select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)])

    def cut(batches):
        for i, chunk in enumerate(_chunked(batches)):
            kinds, data = pack([narrow(chunk[c].to_numpy(float)) for c in names])
            yield pd.DataFrame([((TaskContext.get().partitionId() << 32) + i, len(chunk), kinds, data)], columns=["chunk", "n", "kinds", "data"])

    chunks = materialise(vectors.orderBy(*names).mapInPandas(cut, "chunk long, n long, kinds string, data binary"), "trees-chunks")
    rows = _asked(forest, chunks)
    asked = rows.groupBy("tree", "path").agg(F.ceil(F.sum("n") / PREDICTED_AT_ONCE).cast("int").alias("salts"))
    asked = materialise(asked, "trees-groups")  # a row per subtree
    groups = asked.agg(F.coalesce(F.sum("salts"), F.lit(0))).first()[0]
    rows = rows.join(F.broadcast(asked), ["tree", "path"]).withColumn("salt", F.pmod(F.xxhash64("chunk"), F.col("salts").cast("long")).cast("int")).drop("salts", "n")
    own = forest.packed.withColumnRenamed("top", "path").join(F.broadcast(asked), ["tree", "path"])
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    key = ["tree", "path", "salt"]

    def each(parts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(parts) and len(asked):
            tree = _subtree(parts.rename(columns={"path": "top"}))
            for r in asked.itertuples():
                *x, place = unpack(r.kinds, r.data)
                row, cls, share = _entries(tree, np.stack([a.astype(float) for a in x], axis=1))
                out.append((r.chunk, tree.tree, *pack([place[row], cls, share])))
        return pd.DataFrame(out, columns=["chunk", "tree", "kinds", "data"])

    parts = max(1, groups)
    own, rows = own.repartition(parts, *key), rows.repartition(parts, *key)
    found = own.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(each, "chunk long, tree int, kinds string, data binary")

    def summed(chunk: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        p = np.zeros((int(chunk.n.iloc[0]), k))
        for r in found.sort_values("tree", kind="stable").itertuples():
            place, cls, share = unpack(r.kinds, r.data)
            p[place, cls] += share
        f = np.stack([a.astype(float) for a in unpack(chunk.kinds.iloc[0], chunk.data.iloc[0])], axis=1)
        return pd.DataFrame({"f": list(f), "p": list(p / trees)})

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(summed, "f array<double>, p array<double>")


def predict(forest: Forest, df: DataFrame) -> DataFrame:
    """df with __predicted (the likeliest class, of equal ones the first by name) and __p."""
    known = probabilities(forest, df)
    names = F.array(*map(F.lit, forest.classes))
    known = known.select(F.col("f").alias("__f"), F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int")).alias("__predicted"), F.col("p").alias("__p"))
    return match_nulls(df.withColumn("__f", _vector(forest.features)), known, ["__f"], "left").drop("__f")
