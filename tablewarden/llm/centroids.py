"""Centroid clustering of vectors: Lloyd's rounds in exact integers, made cheap by ns-bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import drop_scratch, materialise, scratch_path, table

WIDTH, CENTROIDS, ROUNDS, SEED = 64, 8, 10, "3"
SCALE = 1024
#: Scaled components lie below this in absolute value, so that sums over 10^19 vectors have 38 digits at most.
LARGEST = 2.0**62
MOST_LONG = (1 << 63) - 1
#: Bounds are doubles; a bound counts as holding only beyond this relative margin, far above their rounding.
MARGIN = 1e-6
SLICE = 2000


def exact_below(width: int) -> int:
    """Integers below this have squared distances over width components that doubles hold exactly."""
    return math.isqrt((1 << 53) // (4 * width))


def kept(vectors: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(id, v): the vectors of just that many components, none null, not finite or beyond LARGEST when scaled."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < LARGEST))
    return vectors.filter(v.isNotNull() & (F.size(v) == width) & sound).select(F.col(id_col).alias("id"), v.alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c; doubles where these are exact, else Python's integers."""
    if x.dtype == object:
        return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class History:
    """The centroids of every round so far, and how far each has gone in all since each of them."""

    def __init__(self, rounds: list[list[list[int]]], exact: bool):
        self.now = np.array(rounds[-1], np.float64 if exact else object)
        old = np.array(rounds, np.float64)
        gone = np.sqrt(((old[-1][None] - old) ** 2).sum(axis=2))  # the norm of the total displacement: [round, centroid]
        self.gone = gone
        first = gone.argmax(axis=1)
        rest = gone.copy()
        rest[np.arange(len(gone)), first] = 0.0
        most = np.repeat(gone.max(axis=1)[:, None], gone.shape[1], axis=1)
        most[np.arange(len(gone)), first] = rest.max(axis=1)
        self.others = most  # [round, centroid]: the longest way of any other centroid
        self.round = len(rounds) - 1

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, upper_at: np.ndarray, lower: np.ndarray, lower_at: np.ndarray) -> int:
        """Bring own (the number of the nearest centroid) up to date in place; returns how many vectors met all centroids.

        upper is the distance to the own centroid as it stood in round upper_at, lower that to the nearest other one in
        round lower_at. A vector keeps its centroid if upper, plus the way that went since, lies below lower, less the
        longest way that another went since. Else its own distance is taken anew, and, if that doesn't do, all distances.
        """

        def holds(rows):
            most, least = upper[rows] + self.gone[upper_at[rows], own[rows]], lower[rows] - self.others[lower_at[rows], own[rows]]
            return most + MARGIN * (1 + most + np.abs(least)) < least

        fail = np.flatnonzero(~holds(np.arange(len(own))))
        seen = fail[np.isfinite(upper[fail])]
        if len(seen):
            upper[seen] = root(((x[seen] - self.now[own[seen]]) ** 2).sum(axis=1))
            upper_at[seen] = self.round
            fail = fail[~holds(fail)]
        for k in range(0, len(fail), SLICE):
            rows = fail[k : k + SLICE]
            away = squared(x[rows], self.now)
            own[rows] = away.argmin(axis=1)  # of equal ones the first, which has the smaller number
            two = np.sort(away, axis=1)[:, :2]
            upper[rows], upper_at[rows] = root(two[:, 0]), self.round
            lower[rows], lower_at[rows] = root(two[:, 1]) if two.shape[1] > 1 else np.inf, self.round
        return len(fail)


def _unpack(column: pa.Array, kind: str, width: int, exact: bool) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, kind).reshape(-1, width)
    return x.astype(np.float64) if exact else np.array([[int(i) for i in row] for row in x], object).reshape(-1, width)


STATE = "x binary, own int, upper double, upper_at int, lower double, lower_at int, sums array<decimal(38,0)>, summed boolean"
SUMS = pa.list_(pa.decimal128(38, 0))


def _state_batch(ids: pa.Array, x: list, own, upper, upper_at, lower, lower_at, sums: list, summed: bool) -> pa.RecordBatch:
    n = len(own)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(x, pa.binary()), pa.array(own, pa.int32()), pa.array(upper, pa.float64()), pa.array(upper_at, pa.int32()),
         pa.array(lower, pa.float64()), pa.array(lower_at, pa.int32()), pa.array(sums, SUMS), pa.array([summed] * n, pa.bool_())],
        names=["id", "x", "own", "upper", "upper_at", "lower", "lower_at", "sums", "summed"],
    )


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding",
            width: int = WIDTH, seed: str = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector after that many rounds.

    A vector is kept if it has width components, none null or not finite; component x counts as floor(1024 * x). The first
    centroids are the k kept vectors with the smallest SHA-256 of "seed:id" (rows that share an id: smaller vector first;
    a null id is never one). A round assigns every vector to the nearest centroid, ties to the smaller number, and
    moves each centroid to the floor of its vectors' mean, one without vectors staying. Everything is exact: sums are
    decimals of 38 digits, distances doubles where these are exact for the table, else Python's integers. With fewer
    than k candidates there are fewer centroids; with none (only null ids) cluster and distance are null. Repeated ids
    and vectors are rows of their own; an empty table gives no rows. A scaled component of 2 ** 62 or more leaves the vector out;
    distances and inertias beyond the range of long come out as its greatest value.

    Each vector carries an upper and a lower bound with the round each was taken in. The centroids of all rounds are kept
    (k x rounds vectors, sent to all tasks); a bound is loosened by the norm of a centroid's total displacement since
    that round. Only vectors whose bounds fail are measured again. A round is one pass over the vectors, packed
    in the narrowest integers that hold the table, without a shuffle; each task adds what joined and left each centroid, so k rows a task are added up.
    Every round's state is a table in the shared folder, the one before is deleted.
    """
    spark = vectors.sparkSession
    source = kept(vectors, id_col, vector_col, width)
    kind = vectors.schema[id_col].dataType.simpleString()
    salted = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = source.filter(F.col("id").isNotNull()).orderBy(salted, "v").limit(k).select("v").collect()  # k rows
    history = [[[math.floor(SCALE * float(x)) for x in row.v] for row in first]]
    if not first:
        none = F.lit(None)
        return source.select(F.col("id").alias(id_col), none.cast("int").alias("cluster"), none.cast("long").alias("distance"),
                             none.cast("long").alias("cluster_inertia"), none.cast("long").alias("inertia"), none.cast("string").alias("centroid_sha256"))
    k = len(first)
    reach = source.agg(F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))))).first()[0] * SCALE + 1
    packed = "<i2" if reach < 1 << 15 else "<i4" if reach < 1 << 31 else "<f8"
    exact = reach < exact_below(width)
    id_type = source.select("id").limit(0).toArrow().schema.field("id").type

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in batches:
            x = np.floor(SCALE * rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, width).astype(packed)
            n = len(x)
            yield rows.column("id"), [r.tobytes() for r in x], np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in batches:
            yield (rows.column("id"), rows.column("x").to_pylist(), *(rows.column(c).to_numpy(zero_copy_only=False).copy() for c in ("own", "upper", "upper_at", "lower", "lower_at")))

    def round_of(reading, held, starting: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            past, joined = History(held.value, exact), [[0] * (width + 1) for _ in range(k)]
            for ids, raw, *state in reading(batches):
                if len(raw):
                    x, before = _unpack(pa.array(raw, pa.binary()), packed, width, exact), state[0].copy()
                    past.assign(x, *state)
                    moved = np.ones(len(raw), bool) if starting else state[0] != before
                    for sign, side in ((1, state[0]), (-1, before)):
                        if sign > 0 or not starting:
                            for c in np.unique(side[moved]):
                                here = moved & (side == c)
                                gained = [*(int(s) for s in x[here].sum(axis=0)), int(here.sum())]
                                joined[c] = [a + sign * b for a, b in zip(joined[c], gained)]
                    yield _state_batch(ids, raw, *state, [None] * len(raw), False)
            some = [c for c in range(k) if any(joined[c])]
            empty = [None] * len(some)
            yield _state_batch(pa.nulls(len(some), id_type), empty, some, empty, empty, empty, empty, [[Decimal(s) for s in joined[c]] for c in some], True)

        return step

    sums = [[0] * (width + 1) for _ in range(k)]
    state, path = None, None
    schema = f"id {kind}, {STATE}"
    for at in range(rounds):
        held = spark.sparkContext.broadcast(history)
        rows = source if state is None else state.filter(~F.col("summed"))
        target = scratch_path(spark, f"centroids-{at}")
        rows.mapInArrow(round_of(fresh if state is None else stored, held, state is None), schema).write.parquet(target)
        state = spark.read.schema(schema).parquet(target)
        if path:
            drop_scratch(spark, path)
        path = target
        changes = state.filter("summed").select("own", F.posexplode("sums").alias("place", "s")).groupBy("own", "place").agg(F.sum("s").alias("s"))
        for row in changes.collect():  # k x (width + 1) rows
            sums[row.own][row.place] += int(row.s)
        history = [*history, [[s // n for s in own] if n else old for (*own, n), old in zip(sums, history[-1])]]
    held = spark.sparkContext.broadcast(history)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past = History(held.value, exact)
        for ids, raw, *bounds in (fresh if path is None else stored)(batches):
            x = _unpack(pa.array(raw, pa.binary()), packed, width, exact)
            past.assign(x, *bounds)
            away = [min(int(d), MOST_LONG) for d in ((x - past.now[bounds[0]]) ** 2).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(bounds[0], pa.int32()), pa.array(away, pa.int64())], names=["id", "cluster", "distance"])

    rows = source if state is None else state.filter(~F.col("summed"))
    result = materialise(rows.mapInArrow(last, f"id {kind}, cluster int, distance long"), "centroids")
    if path:
        drop_scratch(spark, path)
    inertia = {r.cluster: int(r.s) for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = min(sum(inertia.values()), MOST_LONG)
    spelled = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1]]
    each = spark.createDataFrame([(c, min(inertia.get(c, 0), MOST_LONG), total, spelled[c]) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return result.join(F.broadcast(each), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out one after the other."""
    near = """n{r} AS MATERIALIZED (SELECT rid, vec_id, v, cluster, d FROM (
  SELECT p.rid, p.vec_id, p.v, c.cluster, list_sum(list_transform(list_zip(p.v, c.c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d
  FROM p, c{r} c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, cluster) = 1)"""
    move = """c{s} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (
  SELECT cluster, list(f ORDER BY pos) AS c FROM (
    SELECT cluster, pos, CAST((t - ((t % n) + n) % n) // n AS BIGINT) AS f FROM (
      SELECT cluster, pos, sum(x) AS t, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM n{r}) GROUP BY cluster, pos))
  GROUP BY cluster) m USING (cluster))"""
    parts = [
        f"""p AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (
  SELECT sha256('{SEED}:' || vec_id) AS h, v FROM p WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CENTROIDS}))""",
    ]
    for r in range(ROUNDS):
        parts += [near.format(r=r), move.format(r=r, s=r + 1)]
    parts.append(near.format(r=ROUNDS))
    return f"""WITH {', '.join(parts)}
SELECT n.vec_id, CAST(n.cluster AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance,
  CAST(sum(n.d) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM n{ROUNDS} n JOIN c{ROUNDS} c USING (cluster)"""


ORACLE_SQL = _sql()
