"""Archives, vector search and the pipeline."""

import base64
import gzip
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewarden.llm import ann, warc
from tablewarden.llm.common import scratch_path

PAGES = [(1, None, None), (2, "http://x/\r\nWARC-Type: fake", ""), (3, "a", "é"), (5, "b", "é"), (None, "c", "é"), (7, "q", "z\r\n\r\nWARC/1.1\r\n" * 50), (9, "big", "x" * 3_000_000), (8, "d", "é"), (8, "d", "é")]
SCHEMA = "page_id long, url string, html string"


def test_archives_read_back(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).withColumn("refers_to", F.lit("clash"))
    index = warc.normalise(warc.write_archives(pages, scratch_path(spark, "w")), scratch_path(spark, "n"))
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index).collect())
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", 0), i or 0)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = i is not None and i != best[h or ""]
        want.append((i or 0, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", best[h or ""] if revisit else None))
    assert got == sorted(want)
    long_only = warc.normalise(warc.write_archives(pages, scratch_path(spark, "w"), least_bytes=1), scratch_path(spark, "n"))
    assert {r.page_id for r in warc.read_records(long_only).filter("record_type = 'revisit'").collect()} == {3, 5}


def test_archives_keep_large_ids(spark):
    big = 1 << 60
    pages = spark.createDataFrame([(big + 1, "a", "same"), (big + 3, "b", "same"), (None, "c", "own"), (big + 5, "d", "other")], SCHEMA)
    index = warc.normalise(warc.write_archives(pages.coalesce(1), scratch_path(spark, "w")), scratch_path(spark, "n"))
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_records(index.coalesce(1)).collect()}
    assert got == {(big + 1, "revisit", big + 3), (big + 3, "response", None), (None, "response", None), (big + 5, "response", None)}


def test_members_open_alone(spark, tmp_path):
    records = [warc.page_record(i, u, h, None) for i, u, h in PAGES[:4]]
    one = tmp_path / "whole.warc.gz"
    one.write_bytes(gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:])))
    entries = warc.normalise_archive(str(one), str(tmp_path / "single.warc.gz"))
    raw = (tmp_path / "single.warc.gz").read_bytes()
    assert [gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]) for e in entries] == records
    assert gzip.decompress(raw) == b"".join(records) and (tmp_path / "single.idx.json").read_text().count("\n") == 4
    with pytest.raises(ValueError, match="cut off"):
        list(warc.split_records(iter([records[0][:-3]])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.split_records(iter([b"junk\r\n\r\n"])))
    small = list(warc.split_records(iter([bytes([b]) for b in records[2]])))
    assert small[0][1] == records[2] and b"".join(warc.inflate(io.BytesIO(gzip.compress(b"abc") + gzip.compress(b"def")))) == b"abcdef"


def test_no_pages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.read_records(warc.normalise(warc.write_archives(empty, scratch_path(spark, "w")), scratch_path(spark, "n"))).isEmpty()


def test_search_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[100:400] = x[100]  # one vector fills a fifth
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 32), (2040, [float("nan")] + [1.0] * 31), (2060, [1.0] * 5), (2080, [None] + [1.0] * 31), (2100, [float("inf")] + [1.0] * 31), (None, [1.0] * 32)]
    vectors = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(vectors, vectors.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 20))
    wide, found = x.astype(np.float64), 0
    for q, rows in got.items():
        s = (wide * wide[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and all(r[2] == s[r[1]] for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        found += len({r[1] for r in rows} & set(order))
    assert found / 20 / len(got) >= 0.9
    assert [r[1] for r in sorted(got[120])] == [i for i in range(100, 121) if i != 120][:20]


def test_search_small_tables(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(v, v.filter("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(v.filter("false"), v).isEmpty() and ann.search(v, v.filter("false")).isEmpty()


def test_pipeline_stages(spark, tmp_path):
    from tablewarden.llm import exact_dedup, mixing, pieces, quality, simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "source mixing", "sentencepiece"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = sorted(r.doc_id for r in docs.collect())
        if k == 0:
            fitted = quality.fit(before, quality.training_labels(spark.read.parquet(f"{sf}/labels.parquet")))
            want = [r.doc_id for r in quality.score(before, fitted).filter(F.col("score") >= quality.THRESHOLD).collect()]
        elif k == 1:
            want = [r.doc_id for r in exact_dedup.mark_duplicates(before).filter("kept").collect()]
        elif k == 2:
            want = list({r.component_id for r in simhash.near_duplicates(before).collect()})
        elif k == 3:
            want = [r.doc_id for r in mixing.mix_plan(before).collect() for _ in range(int(r.taken / r.size + 0.5) if r.size else 0)]
        else:
            want = [r.doc_id for r in before.collect()]
            text = {r.doc_id: r.text for r in before.collect()}
            p = pieces.load(pieces.public_tokenizers.path(pieces.DEFAULT_MODEL))
            assert all(p.decode(bytes(r.ids)) == text[r.doc_id] for r in docs.collect())
        assert got == sorted(want)
        if k < 4:
            assert docs.columns == before.columns
    assert corpus_pipeline.run(spark, sf).count() == len(got)
