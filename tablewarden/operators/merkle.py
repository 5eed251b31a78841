"""Where two tables differ: trees of hashes over key ranges, compared from the root, and the rows of what differs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.scratch import materialise

#: Keys of one leaf, children of one node, and the level of the root: FANOUT ** (ROOT - 1) leaves hold all longs.
LEAF_KEYS, FANOUT, ROOT = 1024, 256, 8
#: The leaf of null keys.
NULL_LEAF = -(1 << 54)
#: So many differing leaves are named in the filter that reaches the scan; of more, only the first and the last.
MOST_NAMED = 10_000


def _leaf(key: str) -> Column:
    """The key's range; neighbouring whole numbers are neighbours."""
    k = F.col(key).cast("long")
    return F.coalesce((k - F.pmod(k, F.lit(LEAF_KEYS).cast("long"))) / LEAF_KEYS, F.lit(NULL_LEAF)).cast("long")


def _row_hash(fields: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(fields)]), {"ignoreNullFields": "false"}), 256)


def tree(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(level, node, n, digest): the hash tree of a table with a whole-number key; level 0 are leaves, level ROOT is the root.

    A leaf's digest covers its rows whatever their order and however often each occurs: it is the hash of their number and of two sums of
    their SHA-256 values. A node's digest is the SHA-256 of its children's, in order. Leaves are aggregated on the map side and
    LEAF_KEYS times fewer than keys; what is above is FANOUT times fewer again. An empty table has no nodes. Written once, a tree
    stands for its table in later comparisons.
    """
    rows = df.select(_leaf(key).alias("node"), _row_hash([key, *fields]).alias("h"))
    part = lambda a: F.sum(F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy("node").agg(F.count("*").alias("n"), part(1).alias("a"), part(17).alias("b"))
    digest = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "a", "b")]), 256)
    leaves = materialise(sums.select(F.lit(0).alias("level"), "node", "n", digest.alias("digest")), "merkle-leaves")
    levels = [leaves]
    for level in range(1, ROOT + 1):
        below = levels[-1].select(_parent(level).alias("up"), "n", F.struct("node", "digest").alias("c"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ",")  # FANOUT at most
        above = below.groupBy("up").agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("digest"))
        levels.append(above.select(F.lit(level).alias("level"), F.col("up").alias("node"), "n", "digest"))
    return materialise(reduce(DataFrame.unionByName, levels), "merkle")


def _parent(level: int) -> Column:
    """The node at level that a node one level below lies in."""
    return F.lit(0).cast("long") if level == ROOT else ((F.col("node") - F.pmod("node", F.lit(FANOUT).cast("long"))) / FANOUT).cast("long")


def differing_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node): leaves in which two trees differ. From the root down, only children of differing nodes are compared."""
    nodes = before.withColumn("_s", F.lit("a")).unionByName(after.withColumn("_s", F.lit("b")))
    found = None
    for level in range(ROOT, -1, -1):
        here = nodes.filter(F.col("level") == level)
        if found is not None:
            here = here.withColumn("up", _parent(level + 1)).join(found.withColumnRenamed("node", "up"), "up", "left_semi")
        side = lambda x: F.max(F.when(F.col("_s") == x, F.struct("n", "digest"))).alias(x)
        found = here.groupBy("node").agg(side("a"), side("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select("node")
    return materialise(found, "merkle-differing")


def rows_of(df: DataFrame, key: str, leaves: DataFrame) -> DataFrame:
    """The rows of df in leaves; their ranges are a filter on the key, which the scan can use to pass over the rest."""
    named = [r.node for r in leaves.limit(MOST_NAMED + 1).collect()]
    if len(named) > MOST_NAMED:
        ends = leaves.filter(F.col("node") > NULL_LEAF).agg(F.min("node"), F.max("node")).first()
        runs = [tuple(ends)]
    else:
        runs = []
        for node in sorted(n for n in named if n != NULL_LEAF):
            if runs and runs[-1][1] + 1 == node:
                runs[-1] = (runs[-1][0], node)
            else:
                runs.append((node, node))
    ranges = [F.col(key).between(a * LEAF_KEYS, b * LEAF_KEYS + LEAF_KEYS - 1) for a, b in runs] + [F.col(key).isNull()]
    return df.filter(reduce(lambda x, y: x | y, ranges)).withColumn("__leaf", _leaf(key)).join(leaves.withColumnRenamed("node", "__leaf"), "__leaf", "left_semi").drop("__leaf")


def localise(source: DataFrame, result: DataFrame, key: str, fields: list[str], position: str | None = None, claimed: dict[str, int] | None = None,
             trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """key, change: what sets result apart from source, every copy of every row compared.

    missing: the key has no row in result. fabricated: it has none in source. repeated, lost: it has more, or fewer, but some.
    changed:<field>: a row of result has a value there that no row of source has under the key. changed:row: its values are all
    there, but not together. reordered: with position (a column of result, from 0), a row that stands after one of a larger key; it is
    compared with the one before by a join. counts:<name>, with a null key: claimed[name] isn't the number of rows of source. Null keys are
    one key. trees are those of both tables, if they are at hand. Two tables alike, empty ones too, give no rows.

    Trees are compared from the root; only the rows of differing leaves are read again, and only counts of equal rows meet.
    """
    own = (source, result)
    a, b = trees or tuple(tree(df, key, fields) for df in own)
    leaves = differing_leaves(a, b)
    n = lambda c: F.sum(c).alias(c)
    sides = [rows_of(df.select(key, *fields), key, leaves).select("*", F.lit(1 - i).cast("long").alias("_s"), F.lit(i).cast("long").alias("_r")) for i, df in enumerate(own)]
    rows = materialise(sides[0].unionByName(sides[1]).groupBy(key, *fields).agg(n("_s"), n("_r")), "merkle-rows")
    keys = rows.groupBy(key).agg(n("_s"), n("_r"), F.max((F.col("_s") == 0) & (F.col("_r") > 0)).alias("_new"))
    kind = (
        F.when(F.col("_r") == 0, "missing").when(F.col("_s") == 0, "fabricated").when(F.col("_r") > F.col("_s"), "repeated").when(F.col("_r") < F.col("_s"), "lost")
    )
    codes = [keys.select(key, kind.alias("change")).filter("change IS NOT NULL")]
    both = keys.filter("_s > 0 AND _r > 0 AND _new").select(F.col(key).alias("_k"))
    met = lambda df: df.join(both, df[key].eqNullSafe(both["_k"]), "left_semi")
    changed = None
    for f in fields:
        values = met(rows).groupBy(key, f).agg(n("_s"), n("_r")).filter("_s = 0 AND _r > 0").select(key, F.lit(f"changed:{f}").alias("change")).distinct()
        changed = values if changed is None else changed.unionByName(values)
    changed = materialise(changed, "merkle-changed")
    mixed = both.join(changed, both["_k"].eqNullSafe(changed[key]), "left_anti").select(F.col("_k").alias(key), F.lit("changed:row").alias("change"))
    codes += [changed, mixed]
    if position:
        before = result.select((F.col(position) + 1).alias("_at"), F.col(key).alias("_before"))
        late = result.select(key, F.col(position).alias("_at")).join(before, "_at").filter(F.col(key) < F.col("_before"))
        codes.append(late.select(key, F.lit("reordered").alias("change")).distinct())
    if claimed:
        real = a.filter(F.col("level") == ROOT).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        wrong = F.array_compact(F.array(*[F.when(F.col("n") != v, f"counts:{k}") for k, v in claimed.items()]))
        codes.append(real.select(F.lit(None).cast(source.schema[key].dataType).alias(key), F.explode(wrong).alias("change")))
    return reduce(DataFrame.unionByName, codes)
