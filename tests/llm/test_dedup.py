"""Exact, near and line deduplication against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.functions import repeats
from tablewarden.llm import exact_dedup, line_dedup, simhash
from tablewarden.llm.components import connected_components

DOCS = "doc_id long, text string, kept string, source string"


def make(spark, texts, first=1):
    return spark.createDataFrame([(first + i, t, "mine", None) for i, t in enumerate(texts)], DOCS)


def flat(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


TEXTS = ["a b", "a  b", "a\tb\n", "a b ", None, "", " ", "\n\n", "x" * 200_000, "x" * 200_000, "x" * 199_999 + "y", "é e", "é e", "a b", "same start " * 9 + "1", "same start " * 9 + "2"]


def test_exact_against_brute_force(spark):
    docs = make(spark, TEXTS)
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(flat(t), []).append(i + 1)
    got = exact_dedup.mark_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        own = groups[flat(TEXTS[r.doc_id - 1])]
        assert (r.keep_id, r.group_size, r.kept) == (own[0], len(own), r.doc_id == own[0])
        assert r.text_sha256 == hashlib.sha256(flat(TEXTS[r.doc_id - 1]).encode()).hexdigest()
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(v[0] for v in groups.values())
    assert {r.kept for r in kept.collect()} == {"mine"}


def test_exact_edges(spark):
    empty = make(spark, []).filter("false")
    assert exact_dedup.mark_duplicates(empty).isEmpty() and exact_dedup.exact_dedup(empty).isEmpty()
    repeated = make(spark, ["q", "z"]).unionByName(make(spark, ["q"]))
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(repeated).collect()) == [1, 2]
    assert {(r.doc_id, r.group_size, r.kept) for r in exact_dedup.mark_duplicates(repeated).collect()} == {(1, 2, True), (2, 1, True)}
    nulls = spark.createDataFrame([(None, "q"), (5, "q"), (None, "w")], "doc_id long, text string")
    assert sorted((r.keep_id or 0, r.kept) for r in exact_dedup.mark_duplicates(nulls).collect()) == [(0, True), (5, False), (5, True)]


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= simhash.MAX_DISTANCE:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick\tBrown fox JUMPS É over\x0bthe lazy dog the quick brown fox jumps"
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    assert words[5] == "É"
    for some in (words, words[:3], words[:4], words[:1]):
        shingles = [" ".join(some[i : i + 4]) for i in range(max(1, len(some) - 3))]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert simhash.fingerprint(" ".join(some)) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice((30, 200, 600)))]
        for _ in range(rng.choice((1, 1, 4))):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += [None, "", "  ", texts[0], texts[0].upper()]
    docs = make(spark, texts)
    want = brute_components({i + 1: simhash.fingerprint(t) for i, t in enumerate(texts)})
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.fingerprint % (1 << 64) == simhash.fingerprint(texts[i - 1]) for i, r in got.items())
    kept = simhash.simhash_dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.filter("false")).isEmpty()


@pytest.mark.parametrize("counts,bucket", [((2,), 4096), ((3,), 4096), ((5,), 4096), ((4,), 8)])
def test_links_find_every_pair(spark, monkeypatch, counts, bucket):
    monkeypatch.setattr(simhash, "PARTITION_COUNTS", counts)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(7)
    codes = []
    for _ in range(30):
        code = rng.getrandbits(64)
        codes.append(code)
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                code ^= 1 << b
            codes.append(code)
    codes = list(dict.fromkeys(codes))
    nodes = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)], "fp long, rep long")
    found = {r.node: r.component for r in connected_components(simhash.links(nodes)).collect()}
    want = brute_components(dict(enumerate(codes)))
    assert {i: found.get(i, i) for i in want} == want


def test_thresholds_cover_every_pair():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for n in (100, 10**6, 10**10):
        planned = simhash.plan(sample, n)
        assert sum(t + 1 for _, t in planned) == simhash.MAX_DISTANCE + 1
        assert len({b for g, _ in planned for b in g}) == sum(len(g) for g, _ in planned)


def test_forest_of_a_large_bucket():
    rng = np.random.default_rng(1)
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 62, 150), (1 << np.arange(60)) ^ 12345, [12345]]))
    moved, root = simhash.forest(np.zeros(len(codes), np.int64), np.zeros(len(codes), bool), codes, 4, block=32)
    center = int(np.flatnonzero(codes == 12345)[0])
    assert len(moved) < len(codes) and len({root[moved == i][0] if i in moved else i for i in [center, *np.flatnonzero(np.bitwise_count(codes ^ 12345) == 1)]}) == 1


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 5), (5, 1), (3, 2), (2, 2), (2, 3), (None, 4)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {9: 1, 8: 1, 7: 1, 6: 1, 5: 1, 3: 2}
    assert connected_components(edges.filter("false")).isEmpty()


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(docs):
    seen, dropped = [], set()
    for i, t in docs:
        for no, line in enumerate((t or "").split("\n")) if t is not None else []:
            line = re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line).strip(" ")
            if not line:
                continue
            near = len(line) >= line_dedup.NEAR_CHARS
            if any(line == s or near and len(s) >= line_dedup.NEAR_CHARS and within_one(line, s) for s in seen):
                dropped.add((i, no))
            seen.append(line)
    return dropped


def test_lines_against_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice((5, 17, 40, 64, 65, 129)))) + "." for _ in range(25)]
    texts = []
    for _ in range(30):
        lines = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(base)
            at = rng.randrange(len(line))
            lines.append(rng.choice((line, line, line[:at] + "z" + line[at + 1 :], line[:at] + line[at + 1 :], line[:at] + "q" + line[at:], line + "  ")))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "x" * 70_000, "x" * 35_000 + "y" + "x" * 35_000, "x" * 70_000]
    docs = make(spark, texts)
    want = brute_lines([(i + 1, t) for i, t in enumerate(texts)])
    assert {(r.doc.id, r.no) for r in line_dedup.dropped_lines(docs).collect()} == want
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    for i, t in enumerate(texts):
        kept = None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i + 1, no) not in want)
        assert out[i + 1].text == kept and out[i + 1].n_kept == (0 if t is None else len([1 for no in range(len(t.split("\n"))) if (i + 1, no) not in want]))
        assert out[i + 1].kept == "mine"


def test_line_edges(spark):
    docs = make(spark, ["a", "a"]).unionByName(spark.createDataFrame([(None, "a", None, None)], DOCS))
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.line_dedup(docs).collect()) == [(0, "a"), (1, "a"), (2, "")]
    assert line_dedup.line_dedup(docs.filter("false")).isEmpty()
    two = make(spark, ["abcdefghijklmnopqrst", "abcdefghijklmnopqrsX"])
    assert line_dedup.dropped_lines(two, max_edits=0).isEmpty() and line_dedup.dropped_lines(two).count() == 1
    assert line_dedup.dropped_lines(two, near_chars=21).isEmpty() and line_dedup.dropped_lines(two, near_chars=20).count() == 1
    with pytest.raises(ValueError):
        line_dedup.dropped_lines(two, max_edits=2)


def test_lines_of_one_long_document(spark):
    rng = random.Random(3)
    lines = [f"{i} " + "".join(rng.choice("abcdefghij ") for _ in range(60)) for i in range(300_000)]
    lines[200_000] = lines[7]
    lines[250_000] = lines[8] + "z"
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    began = time.monotonic()
    (got,) = line_dedup.line_dedup(docs).collect()
    assert got.text.split("\n") == [x for i, x in enumerate(lines) if i not in (200_000, 250_000)]
    assert time.monotonic() - began < 90


def test_lines_of_repeated_ids_and_taken_names(spark):
    big = 1 << 60
    names = ["doc", "no", "line", "_gone", "_lines", "_id", "_hash", "_row", "first", "k1"]
    rows = [(big + 1, "one line here\nsecond line"), (big + 1, "other text\nsecond line"), (big + 3, "second line\nlast of all"), (None, "second line")]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = line_dedup.line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_kept"] and all([r[n] for n in names] == names for r in got.collect())
    kept = sorted((r.doc_id or 0, r.text, r.n_kept) for r in got.collect())
    assert kept[0] == (0, "second line", 1) and kept[3] == (big + 3, "last of all", 1)
    assert [i for i, *_ in kept[1:3]] == [big + 1] * 2 and sorted(n for *_, n in kept[1:3]) == [1, 2]
    texts = spark.createDataFrame([("b", "same line"), ("a", "same line")], "doc_id string, text string")
    assert sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(texts).collect()) == [("a", "same line"), ("b", "")]


def test_few_rows_get_their_full_hash_at_any_size(spark, monkeypatch):
    """The bitmaps let few rows through that are alone, at both sizes; where they are full all pass, and nothing else changes."""
    shares = []
    for n, bits in ((400, 1 << 31), (12800, 1 << 31), (12800, repeats.PAGE)):
        monkeypatch.setattr(repeats, "MOST_BITS", bits)
        monkeypatch.setattr(repeats, "BITS_A_KEY", 16 if bits > repeats.PAGE else 1)
        docs = make(spark, [f"{i:08} text of one length" for i in range(n)] + [f"{i:08} text of one length" for i in range(n // 20)])
        shares.append(exact_dedup._survivors(docs, "text", "doc_id").count() / docs.count())
        assert exact_dedup.exact_dedup(docs).count() == n
    assert all(0.09 < s < 0.2 for s in shares)


def test_no_join_shuffles_texts(spark):
    """With broadcasts by statistics off, rows that aren't listed as copies go through no exchange."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = make(spark, [f"text {i % 900}" for i in range(1000)])
        kept = exact_dedup.exact_dedup(docs)
        assert kept.count() == 900 and kept.select("text").distinct().count() == 900
        first = kept._jdf.queryExecution().executedPlan().toString().split("Union", 1)[1].split("LeftAnti", 1)[0]
        assert "BroadcastHashJoin" in first and "hashpartitioning(_key" not in first
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_queries_of_dedup(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    near = simhash.query(spark, sf)
    assert dict(near.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    rows = near.collect()
    assert len(rows) == n and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id for r in rows)
    assert dict(exact_dedup.query(spark, sf).dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}


def test_dedup_of_repeated_and_missing_ids(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"word{rng.randrange(10_000)}" for _ in range(900))
    one, unique, other = text(), text(), text()
    near, near_other = one + " end", other + " end"
    nearly = lambda a, b: bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1") <= simhash.MAX_DISTANCE
    rows = [(1, one), (5, near), (5, unique), (None, near), (None, other), (None, near_other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert nearly(one, near) and nearly(other, near_other) and not nearly(one, unique) and not nearly(one, other)
    got = [(r.doc_id, r.text) for r in simhash.simhash_dedup(docs).collect()]
    assert len(got) == 3 and {(1, one), (5, unique)} < set(got) and got.count((None, other)) + got.count((None, near_other)) == 1
    spaced = spark.createDataFrame([(1, "a b"), (1, "a  b"), (2, "a\tb"), (3, "c"), (3, "d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text.split()) for r in exact_dedup.exact_dedup(spaced).collect()) == [(1, ["a", "b"]), (3, ["c"]), (3, ["d"])]


def test_exact_dedup_of_rows_that_repeat_often(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_SALT", 3)
    rows = [("x", "hot  text" if i % 2 else "hot text") for i in range(50)] + [("y", "hot text"), ("", "blank id"), (None, "blank id"), (None, "no id"), (None, "no id"), ("z", "own")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    got = sorted((r.doc_id or "-", " ".join(r.text.split())) for r in exact_dedup.exact_dedup(docs).collect())
    assert [(i, t) for i, t in got if i != "-"] == [("x", "hot text"), ("z", "own")] and [t for i, t in got if i == "-"] == ["blank id", "no id", "no id"]


def test_dense_bucket_costs_little(spark):
    """100,000 fingerprints alike in 44 bits: one component, found in seconds; the same components as all pairs give on a part."""
    import time

    rng = np.random.default_rng(7)
    codes = (np.int64(0x5A5) << 40) | rng.choice(1 << 20, 100_000, replace=False).astype(np.int64)
    began = time.monotonic()
    moved, root = simhash.forest(np.zeros(len(codes), np.int64), np.zeros(len(codes), bool), codes, 4)
    assert time.monotonic() - began < 30 and len(moved) == len(codes) - 1 and (root == 0).all()
    some = np.sort(rng.choice(1 << 44, 3000, replace=False)).astype(np.int64)
    some[1::3] = some[::3][: len(some[1::3])] ^ 0b101
    moved, root = simhash.forest(np.zeros(3000, np.int64), np.zeros(3000, bool), some, 4, block=64)
    whole = np.arange(3000)
    near = np.bitwise_count(some.view(np.uint64)[:, None] ^ some.view(np.uint64)[None, :]) <= 4
    while True:
        new = np.array([whole[near[i]].min() for i in range(3000)])
        if (new == whole).all():
            break
        whole = new
    got = np.arange(3000)
    got[moved] = root
    assert (got == whole).all()
