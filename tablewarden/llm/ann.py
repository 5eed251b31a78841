"""Approximate nearest neighbours by a permutation index: nearest pivots in order, pivot inverted files, footrule, rerank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import materialise, number_of_parts, table

K = 20
#: Pivots are a bounded sample of the vectors; every vector is indexed by its PREFIX nearest pivots in order.
PIVOTS = 4096
PREFIX = 48
#: Of each shard, a query reranks exactly this share of the distinct vectors, at least RERANK_LEAST of them.
RERANK_SHARE, RERANK_LEAST = 0.15, 128
SHARD_VECTORS, QUERY_BLOCK = 5000, 1000
#: Vectors that meet all pivots at once.
INDEXED_AT_ONCE = 500


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding): rows with an id and a vector of the commonest length (of equals the least), finite and not zero.

    An id that repeats counts once, with the least of its vectors.
    """
    v = F.col(vector_col)
    sound = vectors.filter(
        F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))
    common = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return sound.filter(F.size("embedding") == (common.d if common else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each row of x the numbers of its nearest pivots (largest inner product), nearest first."""
    away = -(x @ pivots.T)
    if prefix < away.shape[1]:  # only the nearest are put in order
        some = np.sort(np.argpartition(away, prefix - 1, axis=1)[:, :prefix], axis=1)
        order = np.take_along_axis(some, np.argsort(np.take_along_axis(away, some, axis=1), axis=1, kind="stable"), axis=1)
    else:
        order = np.argsort(away, axis=1, kind="stable")[:, :prefix]
    return order.astype("<i2")


def footrule_order(perm: np.ndarray, query: np.ndarray, starts: np.ndarray, rows: np.ndarray, places: np.ndarray, take: int) -> np.ndarray:
    """The take rows of a shard with the least footrule distance to the query, ties to the earlier row.

    The inverted files are rows and places, those of pivot p at starts[p]:starts[p + 1]. A pivot that one side lacks
    counts as standing at the end of the prefix, so what the files of the query's pivots give is the gain over that.
    """
    n, prefix = perm.shape
    own = np.concatenate([np.arange(starts[p], starts[p + 1]) for p in query]) if len(query) else np.zeros(0, int)
    at = np.repeat(np.arange(len(query)), [starts[p + 1] - starts[p] for p in query])
    gain = (prefix - at) + (prefix - places[own]) - np.abs(at - places[own])
    score = np.bincount(rows[own], weights=gain, minlength=n).astype(np.int64)
    key = -score * n + np.arange(n)
    return np.argpartition(key, take - 1)[:take] if take < n else np.arange(n)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors found.

    queries holds the ids to search for (those without a usable vector give nothing). Nearness is the largest inner
    product in double precision; ties go to the smaller id; a query's own row is no candidate; with k candidates or
    fewer all come out. Vectors that are null, zero, of another length or not finite take no part.

    Of equal vectors only the k + 1 smallest ids can ever be among a query's k nearest, so the others are left out
    before anything else, with a limit on the map side: a vector that fills a third of the table costs k + 1 rows.
    Every other vector is indexed. Shards of vectors (by hash of the vector) have inverted files of their own; blocks
    of queries visit every shard; each gives its k best, which a window with a partial limit merges. Only the pivots
    (PIVOTS vectors at most) are sent everywhere.
    """
    spark = vectors.sparkSession
    base = materialise(usable(vectors, id_col, vector_col), "ann-vectors")
    asked = base.join(queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    of_equal = Window.partitionBy("embedding").orderBy("vec_id")
    kept = base.withColumn("_n", F.row_number().over(of_equal)).filter(F.col("_n") <= k + 1).drop("_n")
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("embedding").toPandas()
    pivots = np.unique(np.stack([np.asarray(v, np.float64) for v in sample.embedding]), axis=0) if len(sample) else np.zeros((0, 1))
    held = spark.sparkContext.broadcast(pivots)

    def index(batches):
        p = held.value
        for rows in batches:
            x = np.stack([np.asarray(v, np.float64) for v in rows.embedding]) if len(rows) else np.zeros((0, p.shape[1]))
            perm = [nearest_pivots(x[k : k + INDEXED_AT_ONCE], p, min(PREFIX, len(p))) for k in range(0, len(x), INDEXED_AT_ONCE)]
            yield pd.DataFrame({"vec_id": rows.vec_id, "x": [r.tobytes() for r in x], "perm": [r.tobytes() for part in perm for r in part]})

    schema = "vec_id long, x binary, perm binary"
    n, m = kept.count(), asked.count()
    shards, blocks = number_of_parts(n, SHARD_VECTORS), number_of_parts(m, QUERY_BLOCK)
    indexed = kept.mapInPandas(index, schema).withColumn("shard", F.pmod(F.xxhash64("x"), F.lit(shards)).cast("int"))
    indexed = materialise(indexed, "ann-index").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    visits = asked.mapInPandas(index, schema).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    visits = visits.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def visit(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        asked_of, found_ids, found_scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(rows) and len(asking):
            rows = rows.sort_values("vec_id")
            groups = rows.groupby("x", sort=False)  # equal vectors are one entry of the index
            first = groups.head(1)
            member = groups.ngroup().to_numpy()
            by_entry = np.argsort(member, kind="stable")
            ends = np.searchsorted(member[by_entry], np.arange(len(first) + 1))
            ids = rows.vec_id.to_numpy()
            x = np.frombuffer(b"".join(first.x), np.float64).reshape(len(first), -1)
            perm = np.frombuffer(b"".join(first.perm), "<i2").reshape(len(first), -1)
            flat = np.argsort(perm.ravel(), kind="stable")
            starts = np.searchsorted(perm.ravel()[flat], np.arange(len(held.value) + 1))
            in_rows, places = flat // perm.shape[1], flat % perm.shape[1]
            take = max(RERANK_LEAST, int(RERANK_SHARE * len(first)))
            for query, raw, own in zip(asking.vec_id, asking.x, asking.perm):
                near = footrule_order(perm, np.frombuffer(own, "<i2"), starts, in_rows, places, take)
                score = (x[near] * np.frombuffer(raw, np.float64)).sum(axis=1)
                if len(near) > k + 1:  # entries below the (k + 1)-th score can't be among the k best
                    top = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    near, score = near[top], score[top]
                sizes = ends[near + 1] - ends[near]
                mine = np.concatenate([ids[by_entry[ends[e] : ends[e + 1]]] for e in near])
                scores = np.repeat(score, sizes)
                scores, mine = scores[mine != query], mine[mine != query]
                best = np.lexsort((mine, -scores))[:k]
                asked_of.append((query, len(best)))
                found_ids.append(mine[best])
                found_scores.append(scores[best])
        queries = np.repeat([q for q, _ in asked_of], [n for _, n in asked_of]) if asked_of else np.zeros(0, np.int64)
        return pd.DataFrame({"query_id": queries, "vec_id": np.concatenate(found_ids), "score": np.concatenate(found_scores)})

    found = indexed.groupBy("shard", "block").cogroup(visits.groupBy("shard", "block")).applyInPandas(visit, "query_id long, vec_id long, score double")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))
