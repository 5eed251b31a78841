"""Trees of unlimited depth against plain recursion."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest

from tablewarden.operators import models, trees


def plain_tree(rows, k, most, tree, seed, path=""):
    """The same rules, one node at a time in plain Python: {path: (feature, threshold) or shares}."""
    counts = [sum(w for _, y, w in rows if y == c) for c in range(k)]
    n = len(rows[0][0])
    order = trees.feature_order(seed, tree, path, n) if most < n else range(n)
    chosen = sorted([f for f in order if len({x[f] for x, _, _ in rows}) > 1][:most]) if sum(c > 0 for c in counts) > 1 else []
    best = None
    for f in chosen:
        values = sorted({x[f] for x, _, _ in rows})
        for a, b in zip(values, values[1:]):
            left = [sum(w for x, y, w in rows if y == c and x[f] <= a) for c in range(k)]
            right = [t - s for t, s in zip(counts, left)]
            score = sum(c * c for c in left) / sum(left) + sum(c * c for c in right) / sum(right)
            if best is None or score > best[0]:
                best = (score, f, a, b)
    if best is None:
        return {path: [c / sum(counts) for c in counts]}
    _, f, a, b = best
    out = {path: (f, (a + b) / 2)}
    out |= plain_tree([r for r in rows if r[0][f] <= a], k, most, tree, seed, path + "0")
    return out | plain_tree([r for r in rows if r[0][f] > a], k, most, tree, seed, path + "1")


def nodes_of(forest, tree=0):
    """All nodes by path, those of both phases."""
    out = {p: s for level in forest.tops for (t, p), s in level.items() if t == tree}
    for r in forest.nodes.filter(f"tree = {tree}").collect():
        out[r.path] = tuple(r.p) if r.feature is None else (r.feature, r.threshold)
    return out


def table(spark, draw, n):
    rows = [(draw.randint(0, 12), draw.randint(0, 9) / 4, draw.choice([-3.5, 0.0, 1.0]), draw.choice("abc")) for _ in range(n)]
    return spark.createDataFrame(rows, "u int, v double, w double, label string"), rows


@pytest.mark.parametrize("small,most,seed", [(10**6, 3, 1), (40, 3, 2), (30, 2, 3)])
def test_tree_equals_plain_recursion(spark, monkeypatch, small, most, seed):
    """Grown in one task, by levels and then in tasks, and by levels alone; with all features and with a choice."""
    monkeypatch.setattr(trees, "SMALL_NODE", small)
    df, rows = table(spark, random.Random(seed), 150)
    forest = trees.fit(df, ["u", "v", "w"], "label", most=most, seed=seed)
    grouped = {}
    for u, v, w, c in rows:
        grouped[(float(u), v, w), "abc".index(c)] = grouped.get(((float(u), v, w), "abc".index(c)), 0) + 1
    want = plain_tree([(x, y, n) for (x, y), n in grouped.items()], 3, most, 0, seed)
    got = nodes_of(forest)
    assert set(got) == set(want) and bool(forest.tops) == (small < 150)
    for path, node in want.items():
        assert got[path] == pytest.approx(tuple(node)), path
    shares = {}
    for x, y in grouped:
        shares.setdefault(x, [0, 0, 0])[y] += grouped[x, y]
    for r in trees.probabilities(forest, df).collect():
        path = ""
        while len(want[path]) == 2:
            f, threshold = want[path]
            path += "0" if r.f[f] <= threshold else "1"
        assert list(r.p) == pytest.approx(want[path])


@pytest.mark.parametrize("small", [10**6, 8])
def test_depth_has_no_limit(spark, monkeypatch, small):
    """A staircase of labels needs a path of over 30 splits; a vector with two labels and many copies stays one leaf."""
    monkeypatch.setattr(trees, "SMALL_NODE", small)
    rows = [(float(2**i), "ab"[i % 2]) for i in range(50)] * 3 + [(-1.0, "a")] * 40 + [(-1.0, "b")] * 60
    df = spark.createDataFrame(rows, "x double, label string")
    forest = trees.fit(df, ["x"], "label")
    assert max(map(len, nodes_of(forest))) >= 5
    got = {r.x: (r["__predicted"], r["__p"]) for r in trees.predict(forest, df).collect()}
    assert all(got[x][0] == label for x, label in rows if x > 0) and got[-1.0] == ("b", pytest.approx([0.4, 0.6]))
    deep = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(64) for _ in range(2 ** min(i, 11))], "x double, label string")
    assert max(map(len, nodes_of(trees.fit(deep, ["x"], "label")))) > 30


def test_forest_draws_rows_and_features(spark):
    df, rows = table(spark, random.Random(8), 400)
    forest = trees.fit(df, ["u", "v", "w"], "label", trees=30, bootstrap=True, most=1)
    again = trees.fit(df.repartition(7), ["u", "v", "w"], "label", trees=30, bootstrap=True, most=1)
    assert nodes_of(forest, 3) == nodes_of(again, 3) != nodes_of(forest, 4)
    scored = trees.predict(forest, df)
    p = scored.select("__p").collect()
    assert len(p) == 400 and all(math.isclose(sum(r[0]), 1) for r in p)
    assert scored.filter("__predicted = label").count() > 200


def test_models_by_name(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i % 11 == 0 else 1.0, "x" if i % 7 < 3 else "y") for i in range(140)], "row_id long, a double, b double, label string")
    for name in models.CONFIGS:
        out = models.predict(models.fit(df, ["a", "b"], "label", name, **({"trees": 5} if name == "random_forest" else {})), df, "label")
        assert out.columns == [*df.columns, "predicted", "confidence"] and out.count() == 140
        assert out.filter("predicted = label").count() >= 130 and out.filter("confidence < 0.5").count() == 0
    with pytest.raises(ValueError, match="unknown model"):
        models.make_model("svm")
    with pytest.raises(ValueError, match="needs rows"):
        models.fit(df.limit(0), ["a"], "label", "decision_tree")


@pytest.mark.parametrize("most", [2, 3])
def test_deep_subtrees_are_stored_without_paths(most):
    """A chain of 300 splits: what is stored and meets the rows to predict grows with the nodes, not with nodes times depth."""
    n = 300
    x = np.stack([np.arange(n, dtype=float)] * 3, axis=1)
    row = trees.grow(x, np.arange(n) % 2, 2.0 ** np.minimum(np.arange(n), 40), 2, 0, "", most, 1)
    r = SimpleNamespace(**dict(zip(["tree", "top", "feature", "threshold", "at", "classes", "shares"], row)))
    assert sum(np.asarray(v).nbytes for v in row[2:]) < 100 * n and len(r.feature) == 2 * n - 1
    paths = trees.unpacked(r, 2)
    assert set(paths.path[1:].str[:-1]) <= set(paths.path) and paths.p.notna().sum() == n
    assert (trees.walk(r, x, 2).argmax(axis=1) == np.arange(n) % 2).all()


def test_forest_costs_no_row_per_tree_and_vector(spark, monkeypatch):
    """What is written on the way has at most a row per vector and label, however many trees there are."""
    df, rows = table(spark, random.Random(5), 400)
    counts, write = {}, trees.materialise

    def counted(rows, name):
        out = write(rows, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(trees, "materialise", counted)
    forest = trees.fit(df, ["u", "v", "w"], "label", trees=20, bootstrap=True, most=1)
    assert trees.probabilities(forest, df).count() == len({r[:3] for r in rows})
    assert max(counts.values()) <= len(set(rows)) and forest.nodes.select("tree").distinct().count() == 20


@pytest.mark.parametrize("values,most", [(6, 1), (6, 3), (10**6, 1), (10**6, 3)])
def test_blocks_of_nodes_equal_plain_recursion(monkeypatch, values, most):
    """Few values are counted and many put in order; nodes are grown in blocks of any size."""
    draw = random.Random(values + most)
    rows = {(tuple(float(draw.randrange(values)) for _ in range(3)), draw.randrange(4)): draw.randint(1, 3) for _ in range(160)}
    rows = [(x, y, w) for (x, y), w in rows.items()]
    want = plain_tree(rows, 4, most, 2, 9)
    for block in (1, 40, 10**6):
        monkeypatch.setattr(trees, "ROWS_AT_ONCE", block)
        got = trees.unpacked(trees.grow(np.array([x for x, _, _ in rows]), np.array([y for _, y, _ in rows]), np.array([w for _, _, w in rows]), 4, 2, "", most, 9), 4)
        assert set(got.path) == set(want)
        for r in got.itertuples():
            assert (tuple(r.p) if r.p is not None else (r.feature, r.threshold)) == pytest.approx(tuple(want[r.path])), r.path


def test_draws_follow_poisson():
    key = np.arange(40_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for size in (1, 5, trees.LUMP, 2 * trees.LUMP + 3):
        w = np.full(len(key), size)
        got = trees.draws(key, w, 1, 7)
        assert (got == trees.draws(key, w, 1, 7)).all() and (got != trees.draws(key, w, 1, 8)).any()
        assert abs(got.mean() - size) < 5 * math.sqrt(size / len(key)) and abs(got.var() / size - 1) < 0.05


def test_packed_arrays_come_back():
    arrays = [np.array([-np.inf, 3.0]), np.array([0.1]), np.array([0, 255]), np.array([-1, 300]), np.array([2**40])]
    kinds, data = trees.pack([trees.narrow(a) for a in arrays])
    back = trees.unpack(kinds, data)
    assert all((a == b).all() for a, b in zip(arrays, back)) and len(data) == 8 + 8 + 2 + 4 + 8
