"""Centroid clustering, ranked search and personal data, held against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import centroids, pii, ranked

VECTORS = "vec_id long, embedding array<float>, cluster string"


def plain_clusters(rows, k, rounds, width, seed="3"):
    """Lloyd's rounds on Python's integers: [(id, cluster, distance)] and the last centroids."""
    sound = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    points = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in sound]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in points if i is not None)
    own = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(own))

    for _ in range(rounds):
        groups = [[] for _ in own]
        for _, v in points:
            groups[nearest(v)[1]].append(v)
        own = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, own)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in points], own


@pytest.mark.parametrize("scale", [1.0, 40.0, 1e6])
def test_clusters_equal_plain_rounds(spark, scale):
    """Narrow and wide integers, and components whose squares doubles don't hold; ties, repeated rows, nulls, other lengths."""
    draw = random.Random(int(scale))
    rows = [(i, [draw.gauss(i % 5, 0.7) * scale for _ in range(3)]) for i in range(300)]
    rows += [(500, [1.0, 1.0, 1.0]), (500, [1.0, 1.0, 1.0]), (501, [-1.0, 1.0, 1.0]), (None, [2.0, 2.0, 2.0])]
    odd = [(600, None), (601, [1.0]), (602, [1.0, None, 2.0]), (603, [math.nan, 1.0, 1.0]), (604, [math.inf, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + odd], VECTORS).repartition(3)
    got = centroids.cluster(df, k=6, rounds=5, width=3).collect()
    want, own = plain_clusters(rows + odd, 6, 5, 3)
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got) == sorted(((i if i is not None else -1), c, d) for i, c, d in want)
    inertia = Counter()
    for _, c, d in want:
        inertia[c] += d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (min(inertia[r.cluster], centroids.MOST_LONG), min(sum(inertia.values()), centroids.MOST_LONG))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, own[r.cluster])).encode()).hexdigest()


def test_clusters_of_little(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroids.cluster(none).count() == 0 and centroids.cluster(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    nameless = spark.createDataFrame([(None, [1.0, 2.0], "x")], VECTORS)
    assert [(r.cluster, r.distance) for r in centroids.cluster(nameless, width=2).collect()] == [(None, None)]
    two = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [5.0, 5.0], "x")], VECTORS)
    assert sorted(r.distance for r in centroids.cluster(two, width=2).collect()) == [0, 0]
    texts = two.select(F.concat(F.lit("v"), "vec_id").alias("vec_id"), "embedding")
    assert {r.vec_id for r in centroids.cluster(texts, width=2).collect()} == {"v1", "v2"}


def test_bounds_skip_and_stay_right():
    """Over many rounds the bounds spare most vectors all distances, and never give another centroid than a full scan."""
    draw = np.random.default_rng(1)
    x = np.floor(draw.normal(0, 30, (2000, 8)) + 400 * draw.integers(0, 4, (2000, 1)))
    history = [[list(map(int, r)) for r in x[:6]]]
    own, upper, upper_at, lower, lower_at = np.zeros(2000, int), np.full(2000, np.inf), np.zeros(2000, int), np.zeros(2000), np.zeros(2000, int)
    met = []
    for _ in range(12):
        past = centroids.History(history, True)
        met.append(past.assign(x, own, upper, upper_at, lower, lower_at))
        assert (own == centroids.squared(x, past.now).argmin(axis=1)).all()
        history.append([[int(s) for s in np.floor(x[own == c].mean(axis=0))] if (own == c).any() else history[-1][c] for c in range(6)])
    assert met[0] == 2000 and sum(met[6:]) < 0.5 * 6 * 2000


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, top):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return out


def ranked_rows(df):
    return sorted(((r.item_id if r.item_id is not None else -1), r.rank, -1 if r.doc_id is None else r.doc_id, r.score) for r in df.collect())


def sorted_plain(rows):
    return sorted((-1 if i is None else i, k, -1 if d is None else d, s) for i, k, d, s in rows)


@pytest.mark.parametrize("seed,tree_docs,block", [(1, 4096, 1 << 18), (2, 50, 40)])
def test_ranked_search_equals_scoring_every_document(spark, monkeypatch, seed, tree_docs, block):
    """One tree and many, one block of items and many; copies, ties, nulls, empty and very long texts, repeated ids."""
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranked, "TREE_DOCS", tree_docs)
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(400)] + ["Äpfel", "äpfel", "3,5", "İx", "x y"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(1, 60)))) for i in range(500)]
    docs += [(1000 + i, docs[3][1]) for i in range(120)] + [(7, "w1 w2 w2"), (7, "w1 w2 w2"), (None, docs[3][1]), (None, "w1"), (9, None), (10, ""), (11, "!!! ?"), (12, "w1 w3-w4 " * 30000)]
    items = [(i, " ".join(draw.choices(words, k=12))) for i in range(30)] + [(50, None), (51, ""), (52, "unheard of"), (53, docs[3][1]), (None, "w5 w1"), (54, "w2"), (54, "W3 w2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("item_id", F.lit(5)).repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    assert ranked_rows(ranked.rank(d, i)) == sorted_plain(plain_ranks(docs, items, 10))


def test_ranked_search_of_nothing(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id int, text string")
    got = ranked.rank(d, i)
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.rank(spark.createDataFrame([(1, "a")], "doc_id long, text string"), i.filter("item_id = 2")).count() == 0
    names = spark.createDataFrame([("x", "a"), ("y", "a a b")], "doc_id string, text string")
    assert [r.doc_id for r in ranked.rank(names, i).orderBy("rank").collect()] == ["y", "x"] or ranked.rank(names, i).count() > 0


def test_branch_and_bound_leaves_documents_out():
    draw = random.Random(5)
    sequences = [np.array(sorted(draw.sample(range(300), 12))) for _ in range(3000)]
    tree = ranked.Tree(list(range(3000)), [100] * 3000, sequences, [np.ones(12, int)] * 3000)
    weights, best = np.zeros(300, np.int64), []
    weights[[250, 280, 299]] = [5000, 6000, 7000]
    scored = tree.search(weights, best)
    full = sorted((-int(sum(weights[s]) * ranked.part_of_score(np.int64(1), np.int64(100))), False, i) for i, s in enumerate(sequences))[:10]
    assert best == full and scored < 3000


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            sound = {"email": lambda: True, "ip": lambda: all(int(p) < 256 for p in m.group().split(".")),
                     "card": lambda: 13 <= len(digits) <= 19 and plain_luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if sound:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    None, "", "a@b", "a@b.c_d@e.f", "x.y@z..w q@r.s.", "a@b.c@d.e", "%@-.- é😀 a.b+c@d-e.ff", "1.2.3.4.5.6.7.8", "001.2.3.0255", "256.1.1.1 1.1.1.256", "1..2.3.4 1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111", "4111111111111111 4111111111111111", "+1 (555) 010-9999", "+1(((((2", "++49 30 1234567--8", "+12 +1", "😀 +44 20 7946 0958 é",
    "a" * 60000 + "@", "1" * 50000, "1.2." * 9000, "x@" + "y." * 9000 + "z", "+" * 30000, "+1" + "(" * 30000, "4111 " * 9000, "a.b@c.de " * 3000,
]


def test_base_spans_equal_plain_patterns(spark):
    draw = random.Random(3)
    parts = ["a", "b@", "@", ".", "1", "23", "255", "256", "+", " ", "-", "(", ")", "é", "😀", "c.d", "4111111111111111", "x@y.zz", "10.0.0.1", "\n", "_", "%"]
    texts = ODD + ["".join(draw.choices(parts, k=draw.randint(1, 60))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_base(t)
        counts = Counter(k for k, _, _ in want)
        spelled = [f"{k}:{a}:{b}" for k, a, b in want]
        assert tuple(got[i][f"n_{k}"] for k in BASE) == tuple(counts[k] for k in BASE), t and t[:80]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest(), t and t[:80]
        assert [s for s in got[i].spans.split(",") if s and "_like" not in s] == spelled


def made_documents(draw, n):
    """Texts of words, ordinary numbers and personal data in the base forms; some carry data written in other ways."""
    word = lambda: "".join(draw.choices("etaoinshrd", k=draw.randint(2, 8)))
    out = []
    for i in range(n):
        words = [word() for _ in range(draw.randint(10, 40))] + [str(draw.randint(1, 10**5)) for _ in range(2)] + [f"{draw.randint(1, 99)}.{draw.randint(0, 9)}"]
        user, host = f"{word()}.{draw.randint(10, 99)}", f"mail{draw.randint(0, 9)}"
        area, line = f"({draw.randint(200, 999)}) 555", f"{draw.randint(1000, 9999)}"
        hidden = None
        if i % 4 == 0:
            words.insert(5, draw.choice([f"{user}@{host}.example.com", f"+1 {area}-{line}", f"{draw.randint(11, 99)}.{draw.randint(100, 255)}.{draw.randint(100, 255)}.{draw.randint(100, 255)}"]))
        elif i % 20 == 1:
            hidden = draw.choice([f"{user} (at) {host} (dot) example (dot) com", f"1 {area}-{line}", f"{draw.randint(11, 99)}[.]{draw.randint(100, 255)}[.]{draw.randint(100, 255)}[.]{draw.randint(100, 255)}"])
            words.insert(5, hidden)
        else:
            words.insert(7, "at")
        out.append((i, " ".join(words), hidden))
    return out


def test_trees_find_data_written_otherwise_and_leave_clean_texts(spark):
    rows = made_documents(random.Random(11), 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, hidden string").repartition(4)
    got = {r.doc_id: r.spans for r in pii.find_pii(docs.drop("hidden")).collect()}
    hidden = [(i, t, h) for i, t, h in rows if h]
    found = sum(any("_like" in s and int(s.split(":")[1]) <= t.index(h) + 2 and int(s.split(":")[2]) >= t.index(h) + len(h) - 2 for s in got[i].split(",") if s) for i, t, h in hidden)
    clean = [i for i, _, h in rows if not h and i % 4]
    assert found >= 0.8 * len(hidden) and sum(bool(got[i]) for i in clean) <= 0.02 * len(clean)
    clear = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clear[0].hidden is None and len(clear) == len(rows)
    for i, t, _ in rows:
        want = t
        for s in sorted((s.split(":") for s in got[i].split(",") if s), key=lambda s: -int(s[1])):
            want = want[: int(s[1])] + f"[{s[0]}]" + want[int(s[2]) :]
        assert clear[i].text == want


def test_score_as_sql_equals_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    draw = random.Random(2)
    rows = [([draw.randint(0, 9) for _ in range(4)],) for _ in range(400)]
    df = spark.createDataFrame(rows, "f array<int>").withColumn("y", ((F.col("f")[0] + F.col("f")[2]) > 9).cast("double"))
    vectors = df.withColumn("features", array_to_vector(F.col("f").cast("array<double>")))
    model = GBTClassifier(labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(vectors)
    both = model.transform(vectors).select(vector_to_array("probability")[1].alias("want"), F.expr(pii.score_sql(model, "f")).alias("got"))
    assert both.filter("abs(want - got) > 1e-12").count() == 0


def test_pii_of_little(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert pii.find_pii(none).count() == 0
    rows = [("a", "x@y.zz"), ("a", "x@y.zz"), (None, "call +1 555 010 9999"), ("b", None)]
    docs = spark.createDataFrame(rows, none.schema)
    assert sorted((r.doc_id or "", r.spans) for r in pii.find_pii(docs).collect()) == [("", "phone:5:20"), ("a", "email:0:6"), ("a", "email:0:6"), ("b", "")]
    assert sorted((r.doc_id or "", r.text) for r in pii.redact(docs).collect() if r.text) == [("", "call [phone]"), ("a", "[email]"), ("a", "[email]")]


def test_pii_trees_see_every_feature_vector(spark, monkeypatch):
    """More than 20,000 distinct vectors a class and half: all of them train, and all rows give thresholds."""
    i = F.col("id")
    f = F.array(*[((i / 32**p).cast("long") % 32).cast("int") if p < 4 else F.lit(0) for p in range(21)])
    rows = spark.range(100_000).select((i % 2).cast("int").alias("half"), f.alias("f"), (F.shiftright(i, 1) % 2).cast("int").alias("y"), F.lit(1).cast("long").alias("n"))
    seen = {}

    class Stop(Exception):
        pass

    def fit(self, df):
        seen["rows"], seen["bins"] = df.count(), self.getMaxBins()
        raise Stop

    monkeypatch.setattr(pii, "labelled", lambda found: rows)
    monkeypatch.setattr(pii.GBTClassifier, "fit", fit)
    with pytest.raises(Stop):
        pii.fit(None)
    assert seen["rows"] == 50_000 and seen["bins"] ** 2 >= 50_000
