"""Every stage and operator with ids of any kind and with the user's columns named like internal ones."""

import random

import pytest
from pyspark.sql import functions as F

from tablewarden.llm import exact_dedup, lm_score, mixing, pieces, pii, quality, ranked, registry, secrets, simhash

#: Names that the operators use or used inside, in several cases.
NAMES = [
    "_row", "_hash", "_key", "_ID", "_text", "fp", "component_id", "_kept_score", "Score", "merges_ids", "Merges_Round_Trip", "lattice_ids", "text_sha256",
    "keep_id", "row", "key", "user", "taken", "_n", "size", "_salt", "spans", "base", "found", "_base", "_candidates", "id", "part", "doc", "n", "terms", "_t", "label", "_y",
]


def documents(spark, kind):
    draw = random.Random(4)
    good = ["the cat sat on the mat near the door and looked at us", "a long walk by the river in the evening light was good"]
    texts = [" ".join(draw.choices(" ".join(good).split(), k=30)) if i % 3 else " ".join(draw.choices(["xx", "zz", "###", "$$$"], k=30)) for i in range(120)]
    ids = {"string": [f"d-{i}" for i in range(120)], "long": [(1 << 60) + i for i in range(120)]}[kind]
    rows = [(i, t, "en", "web" if k % 2 else None) for k, (i, t) in enumerate(zip(ids, texts))]
    rows += [(None, texts[1], "en", "web"), (None, None, None, None), (ids[5], texts[5], "en", "web"), (ids[5], texts[7], "en", "web"), (ids[9], "", "en", "web")]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(i, int(k % 3 > 0)) for k, i in enumerate(ids)], f"doc_id {kind}, quality int")
    return df.select("*", *[F.concat_ws(":", F.lit(n), "doc_id").alias(n) for n in NAMES]).repartition(3), labels, rows


@pytest.mark.parametrize("kind", ["string", "long"])
def test_columns_and_ids_survive_every_stage(spark, kind):
    docs, labels, rows = documents(spark, kind)
    stages = {
        "quality": lambda d: quality.quality_filter(d, labels), "exact": exact_dedup.exact_dedup, "near": simhash.simhash_dedup, "mix": mixing.mix, "encode": pieces.encode_stage,
    }
    own = {(r[0], r[1]) for r in rows}
    at = docs
    for name, stage in stages.items():
        out = stage(at)
        got = out.collect()
        assert got, name
        for r in got:
            assert all(r[n] == ":".join([n, *([str(r.doc_id)] if r.doc_id is not None else [])]) for n in NAMES), name
        if name != "encode":
            assert out.columns == docs.columns and {(r.doc_id, r.text) for r in got} <= own, name
            at = spark.createDataFrame(got, docs.schema)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_operators_take_ids_of_any_kind(spark, kind):
    docs, labels, rows = documents(spark, kind)
    want = sorted((r[0] is None, r[0] or "") if kind == "string" else (r[0] is None, r[0] or 0) for r in rows)

    def ids(df, column="doc_id"):
        none = "" if kind == "string" else 0
        return sorted((r[column] is None, none if r[column] is None else r[column]) for r in df.select(column).collect())

    near = simhash.near_duplicates(docs)
    assert ids(near) == want and near.schema["component_id"].dataType == docs.schema["doc_id"].dataType
    assert ids(secrets.find_secrets(docs)) == want
    assert ids(pii.find_pii(docs)) == want and pii.redact(docs).columns == docs.columns
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    scored = lm_score.score_texts(docs, train)
    assert ids(scored) == want and scored.filter("doc_id is null and not held_out").count() == 0
    found = ranked.rank(docs, spark.createDataFrame([(1, "river cat")], "item_id long, text string"))
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and found.count() == 10
    assert quality.score(docs, quality.fit(docs, labels)).filter("score is null").count() == 0


def test_sample_is_bounded_by_rows(spark):
    """One labelled id that fills the table gives one row to the sample."""
    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0)], "doc_id long, quality int")
    assert len(quality._sample(docs, labels, "text", "doc_id", "quality")) == 1


def test_stages_of_empty_tables(spark):
    docs, labels, _ = documents(spark, "long")
    none, unlabelled = docs.limit(0), labels.limit(0)
    for out in (quality.quality_filter(none, unlabelled), exact_dedup.exact_dedup(none), simhash.simhash_dedup(none), mixing.mix(none), pieces.encode_stage(none)):
        assert out.count() == 0


def test_queries_have_their_columns_and_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages", "embeddings")}
    long, text = "bigint", "string"
    wanted = {
        "op2_line_dedup": ({"doc_id": long, "n_lines": long, "n_kept": long, "kept_sha256": text}, rows["documents"]),
        "op4_sentencepiece": ({"doc_id": long, "n_tokens": long, "ids_sha256": text, "round_trip": "boolean", "lattice_tokens": long, "lattice_sha256": text, "lattice_round_trip": "boolean"}, rows["documents"]),
        "op8_warc_archives": ({"page_id": long, "payload_bytes": long, "payload_digest": text, "record_type": text, "refers_to": long}, rows["pages"]),
        "op9_nearest_neighbours": ({"query_id": long, "rank": "int", "vec_id": long, "score": "double"}, None),
        "op11_centroid_clustering": ({"vec_id": long, "cluster": "int", "distance": long, "cluster_inertia": long, "inertia": long, "centroid_sha256": text}, rows["embeddings"]),
        "op12_ranked_search": ({"item_id": long, "rank": "int", "doc_id": long, "score": long}, None),
        "op13_pii": ({"doc_id": long, "n_email": long, "n_ip": long, "n_card": long, "n_phone": long, "base_sha256": text, "spans": text}, rows["documents"]),
    }
    for name, (columns, n) in wanted.items():
        got = registry.QUERIES[name](spark, sf)
        assert dict(got.dtypes) == columns, name
        assert n is None or got.count() == n, name
