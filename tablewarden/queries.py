"""The registered queries on the supplied tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import views as V
from tablewarden.functions.numbering import numbered
from tablewarden.operators import alerts, answers, claims, contract, duplicates, evaluate, merkle, models, overlap, profile, quantities, splits
from tablewarden.plans import runs
from tablewarden.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SPLITS = ["train", "validation", "test"]
EXPECTED = ["click", "error", "login", "purchase", "view"]  # differs from what is there on purpose
FLOW = (V.FEATURES, V.LABEL)
WIDE = (V.WIDE_FEATURES, V.WIDE_LABEL)
RUN, DATASET = "run1", "events"

_FLOWS = "flows AS (SELECT event_id AS row_id, user_id, CAST(floor(value) AS BIGINT) AS v, event_type FROM events)"
_RANKED = _FLOWS + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || row_id), row_id) AS rk FROM flows
), counts AS (SELECT event_type, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM flows GROUP BY event_type)"""
_SPLIT = _RANKED + """, q1 AS (
  SELECT *, (15 * total + 99) // 100 AS n_test FROM counts
), q2 AS (
  SELECT *, n_test::HUGEINT * n // total AS f, n_test::HUGEINT * n % total AS r FROM q1
), q3 AS (
  SELECT *, f + CASE WHEN row_number() OVER (ORDER BY r DESC, event_type) <= n_test - sum(f) OVER () THEN 1 ELSE 0 END AS test FROM q2
), q4 AS (
  SELECT *, n - test AS m, total - n_test AS mt, (15 * (total - n_test) + 84) // 85 AS n_val FROM q3
), q5 AS (
  SELECT *, n_val::HUGEINT * m // mt AS f2, n_val::HUGEINT * m % mt AS r2 FROM q4
), q6 AS (
  SELECT *, f2 + CASE WHEN row_number() OVER (ORDER BY r2 DESC, event_type) <= n_val - sum(f2) OVER () THEN 1 ELSE 0 END AS val FROM q5
), flows_split AS (
  SELECT row_id, user_id, v, event_type, CASE WHEN rk <= test THEN 'test' WHEN rk <= test + val THEN 'validation' ELSE 'train' END AS split
  FROM ranked JOIN q6 USING (event_type)
)"""
_WIDE = "flows AS (SELECT l_quantity, l_discount, l_tax, l_linenumber, l_returnflag FROM lineitem)"
_DIRTY = """flows_dirty AS (
  SELECT event_id AS row_id, user_id, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 'nan'::DOUBLE
    WHEN event_id % 103 = 0 THEN 'inf'::DOUBLE WHEN event_id % 107 = 0 THEN '-inf'::DOUBLE ELSE value END AS value,
    CASE WHEN event_id % 109 <> 0 THEN event_type END AS event_type FROM events
)"""
_GROUPS = "groups AS (SELECT user_id, v, count(*) AS n, count(DISTINCT event_type) AS n_labels FROM flows GROUP BY ALL)"
_CONFLICT = _FLOWS + ", " + _GROUPS + ", bad AS (SELECT user_id, v, n, n_labels FROM groups WHERE n_labels > 1)"
_CLEAN = _CONFLICT + """, kept AS (SELECT f.* FROM flows f WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.user_id IS NOT DISTINCT FROM f.user_id AND b.v IS NOT DISTINCT FROM f.v)),
clean AS (SELECT min(row_id) AS row_id, user_id, v, event_type FROM kept GROUP BY user_id, v, event_type)"""
_VECTORS = _SPLIT + """, pairs AS (
  SELECT split, user_id, v, event_type, count(*) AS n FROM flows_split WHERE split <> 'test' GROUP BY ALL
), sets AS (
  SELECT split, user_id, v, sum(n)::BIGINT AS n, count(*) AS pairs, max(n) AS most, count(DISTINCT event_type) AS k, string_agg(event_type, '|' ORDER BY event_type) AS labels
  FROM pairs GROUP BY split, user_id, v
), shared AS (
  SELECT t.user_id, t.v, t.n AS n_t, w.n AS n_v, t.labels AS labels_t, w.labels AS labels_v, t.labels = w.labels AND t.k = 1 AND w.k = 1 AS same
  FROM sets t JOIN sets w ON t.split = 'train' AND w.split = 'validation' AND t.user_id = w.user_id AND t.v = w.v
)"""
_ANNOTATED = _VECTORS + """, annotation AS (
  SELECT f.row_id, s.labels IS NOT NULL AS feature_vector_in_training, coalesce(s.labels, '') AS training_labels_for_vector,
    CASE WHEN s.labels IS NULL THEN 'not_in_training' WHEN s.labels = f.event_type THEN 'same_label_in_training' ELSE 'conflicting_label_in_training' END AS overlap_label_relation
  FROM flows_split f LEFT JOIN sets s ON s.split = 'train' AND s.user_id = f.user_id AND s.v = f.v WHERE f.split = 'validation'
)"""
_PREDS = _FLOWS + """, said AS (
  SELECT row_id, m.model_name, event_type AS actual,
    CASE WHEN row_id % m.every = 0 THEN ['click', 'error', 'purchase', 'signup', 'view'][user_id % 5 + 1] ELSE event_type END AS predicted
  FROM flows, (VALUES ('decision_tree', 4), ('random_forest', 7)) m(model_name, every)
), preds AS (
  SELECT row_id AS validation_row_index, model_name, 'full' AS run_mode, actual AS actual_attack_type, predicted AS predicted_attack_type, 0.6::DOUBLE AS prediction_confidence,
    actual = predicted AS correct_multiclass_prediction, CASE WHEN actual = 'view' THEN 'NORMAL' ELSE 'ATTACK' END AS actual_binary,
    CASE WHEN predicted = 'view' THEN 'NORMAL' ELSE 'ATTACK' END AS predicted_binary,
    CASE WHEN actual = 'view' THEN CASE WHEN predicted = 'view' THEN 'TN' ELSE 'FP' END ELSE CASE WHEN predicted = 'view' THEN 'FN' ELSE 'TP' END END AS binary_error_type
  FROM said
)"""
_PER = _PREDS + """, names AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS class), per0 AS (
  SELECT m.model_name, n.class, count(*) FILTER (actual_attack_type = class AND predicted_attack_type = class) AS tp,
    count(*) FILTER (actual_attack_type = class) AS support, count(*) FILTER (predicted_attack_type = class) AS said
  FROM (SELECT DISTINCT model_name FROM preds) m CROSS JOIN names n JOIN preds p ON p.model_name = m.model_name GROUP BY ALL
), per AS (
  SELECT *, CASE WHEN said = 0 THEN 0.0 ELSE tp::DOUBLE / said END AS "precision", CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall,
    CASE WHEN said + support = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (said + support) END AS f1 FROM per0
), averages AS (
  SELECT model_name, sum(tp)::DOUBLE / sum(support) AS accuracy, sum(support)::BIGINT AS support, avg("precision") AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
    sum("precision" * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1
  FROM per GROUP BY model_name
)"""
_BINARY = _PREDS + """, b AS (
  SELECT model_name, count(*) FILTER (binary_error_type = 'TP') AS tp, count(*) FILTER (binary_error_type = 'TN') AS tn, count(*) FILTER (binary_error_type = 'FP') AS fp,
    count(*) FILTER (binary_error_type = 'FN') AS fn, count(*) FILTER (NOT correct_multiclass_prediction AND binary_error_type = 'TP') AS attack_to_attack_errors,
    count(*) FILTER (NOT correct_multiclass_prediction) AS total_errors, count(*) AS n_rows FROM preds GROUP BY model_name
), rates AS (
  SELECT *, round((tp + tn)::DOUBLE / n_rows, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS "precision",
    round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END, 6) AS f1,
    round(CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp::DOUBLE / (fp + tn) END, 6) AS false_positive_rate, round(CASE WHEN fn + tp = 0 THEN 0.0 ELSE fn::DOUBLE / (fn + tp) END, 6) AS false_negative_rate FROM b
)"""
_ALERTS = _PREDS + """, alerts AS (
  SELECT 'run1:' || model_name || ':' || lpad(validation_row_index::VARCHAR, greatest(7, length(validation_row_index::VARCHAR))::INT, '0') AS alert_id, 'run1' AS run_id, 'events' AS dataset,
    model_name AS detector, validation_row_index AS row_id, predicted_attack_type AS attack_type, f.user_id, f.v
  FROM preds JOIN flows f ON f.row_id = validation_row_index WHERE predicted_binary = 'ATTACK'
)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return f

    return register


def on(view, name: str, sql: str, f):
    QUERIES[name] = lambda spark, sf_dir: f(view(spark, sf_dir))
    ORACLE_SQL[name] = sql.strip()


# Profiles
@query("row_positions", "SELECT row_number() OVER () - 1 AS row_id, event_id, event_type FROM events")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.add_row_id(V.table(spark, sf_dir, "events").select("event_id", "event_type"))


on(V.flows, "preview_rows", f"WITH {_FLOWS} SELECT * FROM flows WHERE row_id < 5000 ORDER BY row_id LIMIT 20", lambda d: tables.preview(d, V.ROW))
on(
    V.flows_dirty, "profile_nonnull",
    f"""WITH {_DIRTY} SELECT 'row_id' AS column_name, 'bigint' AS data_type, count(row_id) AS n_nonnull FROM flows_dirty
    UNION ALL SELECT 'user_id', 'bigint', count(user_id) FROM flows_dirty
    UNION ALL SELECT 'value', 'double', count(*) FILTER (value IS NOT NULL AND NOT isnan(value)) FROM flows_dirty
    UNION ALL SELECT 'event_type', 'string', count(event_type) FROM flows_dirty""",
    profile.profile_nonnull,
)


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.round(c, 4).alias(c) for c in df.columns])


_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}::DOUBLE), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std, round(min({c})::DOUBLE, 4) AS "min",
    round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, round(max({c})::DOUBLE, 4) AS "max" FROM flows"""
    for c in V.WIDE_FEATURES
)
on(V.flows_wide, "profile_describe", f"WITH {_WIDE} {_DESCRIBE}", lambda d: _rounded(profile.describe(d, V.WIDE_FEATURES), "column_name", "n"))
on(
    V.flows_dirty, "missing_counts",
    f"""WITH {_DIRTY} SELECT * FROM (SELECT 'value' AS column_name, count(*) FILTER (value IS NULL OR isnan(value)) AS n FROM flows_dirty
    UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL) FROM flows_dirty
    UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL) FROM flows_dirty) WHERE n > 0""",
    profile.missing_counts,
)
on(V.flows_dirty, "infinite_counts", f"WITH {_DIRTY} SELECT 'value' AS column_name, count(*) FILTER (isinf(value)) AS n FROM flows_dirty", profile.infinite_counts)
on(
    V.flows_dirty, "class_distribution",
    f"WITH {_DIRTY} SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM flows_dirty GROUP BY event_type",
    lambda d: profile.class_distribution(d, V.LABEL),
)
on(
    V.flows, "class_distribution_ordered",
    f"""WITH {_FLOWS}, names AS (SELECT unnest(range(0, 5))::INT AS class_pos, unnest(['click', 'error', 'login', 'purchase', 'view']) AS event_type)
    SELECT coalesce(class_pos, 5)::INT AS class_pos, event_type, coalesce(n, 0) AS n FROM names FULL JOIN (SELECT event_type, count(*) AS n FROM flows GROUP BY 1) USING (event_type)""",
    lambda d: profile.class_distribution_ordered(d, V.LABEL, EXPECTED),
)
on(
    V.flows_split, "split_distribution_check",
    f"WITH {_SPLIT} SELECT event_type, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct_whole, "
    + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (split = '{s}') / sum(count(*) FILTER (split = '{s}')) OVER (), 6) AS pct_{s}" for s in SPLITS)
    + " FROM flows_split GROUP BY event_type",
    lambda d: profile.split_distribution(d, V.LABEL, "split", SPLITS),
)
on(
    V.flows_split, "split_sizes",
    f"WITH {_SPLIT} SELECT split, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM flows_split GROUP BY split",
    lambda d: profile.split_sizes(d, "split"),
)

# The contract

_PARTED = f"""{_DIRTY}, parted AS (SELECT *, CASE WHEN row_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM flows_dirty)"""


@query(
    "contract_violations",
    f"""WITH {_PARTED} SELECT * FROM (
    SELECT split, 'value' AS column_name, 'missing' AS rule, count(*) FILTER (value IS NULL OR isnan(value)) AS n FROM parted GROUP BY split
    UNION ALL SELECT split, 'user_id', 'missing', count(*) FILTER (user_id IS NULL) FROM parted GROUP BY split
    UNION ALL SELECT split, 'value', 'infinite', count(*) FILTER (isinf(value)) FROM parted GROUP BY split
    UNION ALL SELECT split, 'event_type', 'missing label', count(*) FILTER (event_type IS NULL) FROM parted GROUP BY split) WHERE n > 0""",
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = V.flows_dirty(spark, sf_dir).withColumn("split", F.when(F.col(V.ROW) % 5 == 0, "validation").otherwise("train"))
    return contract.violations(parted, ["user_id", "value"], V.LABEL, "split")


on(
    V.flows_split, "contract_class_set",
    f"""WITH {_SPLIT}, seen AS (SELECT DISTINCT split, event_type AS class FROM flows_split),
    wanted AS (SELECT split, class FROM (SELECT DISTINCT split FROM seen) CROSS JOIN (SELECT unnest(['click', 'error', 'login', 'purchase', 'view']) AS class))
    SELECT split, class, 'missing' AS status FROM (FROM wanted EXCEPT FROM seen) UNION ALL SELECT split, class, 'unexpected' FROM (FROM seen EXCEPT FROM wanted)""",
    lambda d: contract.class_set(d, V.LABEL, "split", EXPECTED),
)
on(
    V.flows_split, "contract_unseen_classes",
    f"""WITH {_SPLIT} SELECT DISTINCT event_type AS class FROM flows_split WHERE split = 'validation' AND event_type NOT IN
    (SELECT event_type FROM flows_split WHERE split = 'train' AND event_type <> 'signup')""",
    lambda d: contract.unseen_classes(d.filter("NOT (split = 'train' AND event_type = 'signup')"), V.LABEL, "split", "train", "validation"),
)

# Duplicates and conflicts

_PAIRS = _FLOWS + ", pairs AS (SELECT user_id, v, event_type, count(*) AS n, min(row_id) AS first FROM flows GROUP BY ALL)"
_DUPLICATES = _PAIRS + ", dup AS (SELECT f.*, p.first FROM flows f JOIN pairs p ON p.n > 1 AND f.user_id IS NOT DISTINCT FROM p.user_id AND f.v IS NOT DISTINCT FROM p.v AND f.event_type IS NOT DISTINCT FROM p.event_type)"
on(
    V.flows, "exact_duplicate_counts",
    f"WITH {_PAIRS} SELECT sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_in_groups, sum(n - 1)::BIGINT AS n_extra FROM pairs",
    lambda d: duplicates.exact_duplicate_counts(d, *FLOW),
)
on(V.flows, "exact_duplicate_records", f"WITH {_DUPLICATES} SELECT row_id, user_id, v, event_type FROM dup", lambda d: duplicates.exact_duplicate_records(d, *FLOW))
on(V.flows, "extra_duplicate_rows", f"WITH {_DUPLICATES} SELECT row_id, user_id, v, event_type FROM dup WHERE row_id > first", lambda d: duplicates.extra_duplicate_rows(d, *FLOW, V.ROW))
on(
    V.flows, "duplicates_by_class", f"WITH {_DUPLICATES} SELECT event_type, count(*) AS n FROM dup GROUP BY event_type",
    lambda d: duplicates.by_class(duplicates.exact_duplicate_records(d, *FLOW), V.LABEL),
)
_WIDE_GROUPS = _WIDE + ", groups AS (SELECT l_quantity, l_discount, l_tax, l_linenumber, count(*) AS n, count(DISTINCT l_returnflag) AS k FROM flows GROUP BY 1, 2, 3, 4)"
on(V.flows_wide, "repeated_vectors", f"WITH {_WIDE_GROUPS} SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups FROM groups WHERE n > 1", lambda d: duplicates.repeated_vectors(d, *WIDE))
on(V.flows, "conflicting_vectors", f"WITH {_CONFLICT} SELECT * FROM bad", lambda d: duplicates.conflicting_vectors(d, *FLOW))
on(
    V.flows_wide, "vector_group_summary",
    f"WITH {_WIDE_GROUPS} SELECT count(*) AS n_groups, count(*) FILTER (k <= 1) AS n_same, count(*) FILTER (k > 1) AS n_conflicting FROM groups WHERE n > 1",
    lambda d: duplicates.vector_group_summary(d, *WIDE),
)
on(V.flows_wide, "group_size_histogram", f"WITH {_WIDE_GROUPS} SELECT n AS group_size, count(*) AS n FROM groups WHERE n > 1 GROUP BY groups.n", lambda d: duplicates.group_size_histogram(d, *WIDE))
on(V.flows, "conflicting_records", f"WITH {_CONFLICT} SELECT f.* FROM flows f JOIN bad b USING (user_id, v)", lambda d: duplicates.conflicting_records(d, *FLOW))
on(
    V.flows, "conflicts_by_class", f"WITH {_CONFLICT} SELECT event_type, count(*) AS n FROM flows JOIN bad b USING (user_id, v) GROUP BY event_type",
    lambda d: duplicates.by_class(duplicates.conflicting_records(d, *FLOW), V.LABEL),
)
on(
    V.flows, "conflict_label_pairs",
    f"""WITH {_PAIRS} SELECT label_set, count(*) AS n FROM (SELECT string_agg(event_type, ' <-> ' ORDER BY event_type) AS label_set, count(event_type) AS k FROM pairs GROUP BY user_id, v)
    WHERE k > 1 GROUP BY label_set""",
    lambda d: duplicates.conflict_label_pairs(d, *FLOW),
)
on(V.flows, "drop_conflicting", f"WITH {_CLEAN} SELECT * FROM kept", lambda d: duplicates.drop_conflicting(d, *FLOW))
on(V.flows, "clean_table", f"WITH {_CLEAN} SELECT * FROM clean", lambda d: duplicates.clean(d, *FLOW, V.ROW))
on(
    V.flows, "clean_postcheck",
    f"""WITH {_CLEAN} SELECT (SELECT count(*) FROM flows) AS n_before, (SELECT count(*) FROM kept) AS n_after_conflicts, (SELECT count(*) FROM clean) AS n_after_dedup,
    (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM clean GROUP BY user_id, v, event_type) WHERE n > 1) AS n_exact_left,
    (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM clean GROUP BY user_id, v) WHERE n > 1) AS n_vectors_left""",
    lambda d: duplicates.clean_postcheck(d, *FLOW, V.ROW),
)

# Splits

on(V.flows_split, "stratified_split", f"WITH {_SPLIT} SELECT row_id, event_type, split FROM flows_split", lambda d: d.select(V.ROW, V.LABEL, "split"))
on(
    V.flows, "stratified_sample",
    f"""WITH {_RANKED}, s1 AS (SELECT *, least(500, total) AS k FROM counts), s2 AS (SELECT *, k * n // total AS f, k * n % total AS r FROM s1),
    s3 AS (SELECT *, f + CASE WHEN row_number() OVER (ORDER BY r DESC, event_type) <= k - sum(f) OVER () THEN 1 ELSE 0 END AS take FROM s2)
    SELECT row_id, event_type FROM ranked JOIN s3 USING (event_type) WHERE rk <= take""",
    lambda d: splits.stratified_sample(d, V.LABEL, V.ROW, 500).select(V.ROW, V.LABEL),
)
_OVERLAP = "SELECT '{a}/{b}' AS pair, count(*) AS n_shared FROM (SELECT DISTINCT {c} FROM flows_split WHERE split = '{a}' INTERSECT SELECT DISTINCT {c} FROM flows_split WHERE split = '{b}')"
for _name, _columns in (("split_overlap_rows", "user_id, v, event_type"), ("split_overlap_vectors", "user_id, v")):
    on(
        V.flows_split, _name,
        f"WITH {_SPLIT} " + " UNION ALL ".join(_OVERLAP.format(a=a, b=b, c=_columns) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))),
        lambda d, columns=_columns.split(", "): splits.overlap(d, columns, "split", SPLITS),
    )

# Overlap between splits


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.vector_splits(V.flows_split(spark, sf_dir), *FLOW, "split")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.vector_counts(V.flows_split(spark, sf_dir), *FLOW, "split")


_WITHIN = """SELECT split, sum(n)::BIGINT AS n_rows, sum(n - pairs)::BIGINT AS n_exact_duplicates, sum(n - 1)::BIGINT AS n_repeated_rows, count(*) AS n_vectors, count(*) FILTER (k > 1) AS n_multi_label,
    coalesce(sum(n) FILTER (k > 1), 0)::BIGINT AS n_multi_label_rows, coalesce(sum(n - most) FILTER (k > 1), 0)::BIGINT AS n_min_misclassified FROM sets GROUP BY split"""
on(_vectors, "vector_label_sets", f"WITH {_VECTORS} SELECT user_id, v, labels AS label_set FROM sets WHERE split = 'train'", lambda d: overlap.vector_label_sets(d, V.FEATURES))
on(_vectors, "multiple_label_sets", f"WITH {_VECTORS} SELECT labels AS label_set, count(*) AS n FROM sets WHERE split = 'train' AND k > 1 GROUP BY 1", overlap.multiple_label_sets)
on(_counts, "within_split_audit", f"WITH {_VECTORS} {_WITHIN}", overlap.within_split_audit)
on(_counts, "irreducible_errors", f"WITH {_VECTORS} SELECT split, n_min_misclassified FROM ({_WITHIN})", overlap.irreducible_errors)
_CROSS = """SELECT count(*) AS n_shared, count(*) FILTER (same) AS n_same, count(*) FILTER (NOT same) AS n_conflicting,
    coalesce(sum(n_v), 0)::BIGINT AS n_val_rows, coalesce(sum(n_t), 0)::BIGINT AS n_train_rows FROM shared"""
on(_counts, "cross_split_overlap", f"WITH {_VECTORS} {_CROSS}", overlap.cross_split_overlap)
on(_vectors, "same_label_overlap", f"WITH {_VECTORS} SELECT labels_t AS label, count(*) AS n FROM shared WHERE same GROUP BY 1", overlap.same_label_overlap)
on(
    _vectors, "conflicting_label_pairs",
    f"WITH {_VECTORS} SELECT labels_t AS training_labels, labels_v AS validation_labels, count(*) AS n FROM shared WHERE NOT same GROUP BY 1, 2", overlap.conflicting_label_pairs,
)
on(V.flows_split, "overlap_annotation", f"WITH {_ANNOTATED} SELECT * FROM annotation", lambda d: overlap.overlap_annotation(d, *FLOW, V.ROW, "split"))


@query(
    "audit_summary",
    f"""WITH {_VECTORS}, w AS ({_WITHIN}), c AS ({_CROSS}) SELECT t.n_rows AS train_rows, v.n_rows AS validation_rows, t.n_min_misclassified AS train_min_misclassified,
    v.n_min_misclassified AS validation_min_misclassified, c.n_shared, c.n_conflicting, (SELECT count(DISTINCT labels_t) FROM shared WHERE same) AS n_same_labels,
    (SELECT count(*) FROM (SELECT DISTINCT labels_t, labels_v FROM shared WHERE NOT same)) AS n_conflict_pairs
    FROM w t, w v, c WHERE t.split = 'train' AND v.split = 'validation'""",
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = overlap.audit_summary(V.flows_split(spark, sf_dir), *FLOW, "split")
    return document.select(
        F.col("train.n_rows").alias("train_rows"), F.col("validation.n_rows").alias("validation_rows"), F.col("train.n_min_misclassified").alias("train_min_misclassified"),
        F.col("validation.n_min_misclassified").alias("validation_min_misclassified"), "cross.n_shared", "cross.n_conflicting",
        F.size("same_label").cast("long").alias("n_same_labels"), F.size("conflicts").cast("long").alias("n_conflict_pairs"),
    )


# Predictions and metrics


@query(
    "prediction_confidence",
    f"WITH {_PREDS} SELECT validation_row_index AS row_id, 0.5::DOUBLE + (validation_row_index % 40)::DOUBLE / 100::DOUBLE AS confidence FROM preds WHERE model_name = 'decision_tree'",
)
def prediction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = V.predictions(spark, sf_dir).filter("model_name = 'decision_tree'")
    own = F.lit(0.5) + (F.col("validation_row_index") % 40).cast("double") / F.lit(100.0)
    p = F.array(*[F.when(F.col("predicted_attack_type") == c, own).otherwise((1 - own) / 4) for c in V.CLASSES])
    return evaluate.prediction_confidence(said.withColumn("p", p), V.CLASSES, "p", "predicted_attack_type").select(F.col("validation_row_index").alias("row_id"), "confidence")


on(V.predictions, "prediction_frame", f"WITH {_PREDS} SELECT * FROM preds", lambda d: d)


@query(
    "annotated_predictions",
    f"""WITH {_ANNOTATED}, {_PREDS.removeprefix(_FLOWS + ', ')} SELECT p.*, a.feature_vector_in_training, a.training_labels_for_vector, a.overlap_label_relation
    FROM preds p JOIN annotation a ON a.row_id = p.validation_row_index""",
)
def annotated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    annotation = overlap.overlap_annotation(V.flows_split(spark, sf_dir), *FLOW, V.ROW, "split")
    said = V.predictions(spark, sf_dir).join(annotation.select(F.col(V.ROW).alias("validation_row_index")), "validation_row_index", "left_semi")
    return evaluate.annotate(said, annotation)


@query(
    "error_cases",
    f"""WITH {_PREDS} SELECT validation_row_index, f.user_id, f.v, model_name, run_mode, actual_attack_type, predicted_attack_type, prediction_confidence, actual_binary, predicted_binary, binary_error_type,
    CASE binary_error_type WHEN 'FP' THEN 'binary_false_positive' WHEN 'FN' THEN 'binary_false_negative' ELSE 'attack_to_attack_misclassification' END AS error_category
    FROM preds JOIN flows f ON f.row_id = validation_row_index WHERE NOT correct_multiclass_prediction""",
)
def error_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_cases(V.predictions(spark, sf_dir), V.flows(spark, sf_dir).select(V.ROW, *V.FEATURES))


_REPORT = 'SELECT \'full\' AS run_mode, model_name, {name} AS class, round({p}precision{q}, 6) AS "precision", round({p}recall{q}, 6) AS recall, round({p}f1{q}, 6) AS f1, support FROM {t}'
on(
    V.predictions, "classification_report",
    f"WITH {_PER} SELECT 'full' AS run_mode, model_name, class, round(\"precision\", 6) AS \"precision\", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'full', model_name, '{k} avg', round({k}_precision, 6), round({k}_recall, 6), round({k}_f1, 6), support FROM averages" for k in ("macro", "weighted")
    ),
    lambda d: evaluate.classification_report(d, V.CLASSES),
)
_MULTI = "SELECT model_name, round(accuracy, 6) AS accuracy, " + ", ".join(f"round({k}_{c}, 6) AS {k}_{c}" for k in ("macro", "weighted") for c in ("precision", "recall", "f1")) + " FROM averages"
on(V.predictions, "multiclass_summary", f"WITH {_PER} {_MULTI}", lambda d: evaluate.multiclass_summary(d, V.CLASSES))
on(
    V.predictions, "confusion_matrix",
    f"WITH {_PREDS}, names AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS actual_attack_type) SELECT m.model_name, n.actual_attack_type, "
    + ", ".join(f"count(*) FILTER (predicted_attack_type = '{c}') AS {c}" for c in V.CLASSES)
    + " FROM (SELECT DISTINCT model_name FROM preds) m CROSS JOIN names n LEFT JOIN preds p ON p.model_name = m.model_name AND p.actual_attack_type = n.actual_attack_type GROUP BY 1, 2",
    lambda d: evaluate.confusion_matrix(d, V.CLASSES),
)
on(
    V.predictions, "binary_metrics",
    f"""WITH {_BINARY} SELECT 'full' AS run_mode, model_name, 'ATTACK' AS positive_class, tp, tn, fp, fn, accuracy, "precision", recall, f1, false_positive_rate, false_negative_rate,
    attack_to_attack_errors, total_errors FROM rates""",
    evaluate.binary_metrics,
)
on(
    V.predictions, "model_comparison",
    f"""WITH {_PER}, {_BINARY.removeprefix(_PREDS + ', ')} SELECT model_name, r.n_rows, m.accuracy, m.macro_precision, m.macro_recall, m.macro_f1, m.weighted_precision, m.weighted_recall, m.weighted_f1,
    'full' AS run_mode, tp, tn, fp, fn, r.accuracy AS binary_accuracy, r."precision" AS binary_precision, r.recall AS binary_recall, r.f1 AS binary_f1, false_positive_rate, false_negative_rate,
    attack_to_attack_errors, total_errors FROM rates r JOIN ({_MULTI}) m USING (model_name)""",
    lambda d: evaluate.model_comparison(d, V.CLASSES),
)


@query(
    "run_metadata",
    f"""WITH {_SPLIT} SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation,
    count(*) FILTER (split = 'train' AND event_type = 'view') AS train_normal, count(*) FILTER (split = 'validation' AND event_type = 'view') AS validation_normal, 2 AS n_features, 5 AS n_classes,
    'view' AS normal_class, 'full' AS run_mode FROM flows_split""",
)
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = V.flows_split(spark, sf_dir)
    one = runs.run_metadata(both.filter("split = 'train'"), both.filter("split = 'validation'"), V.FEATURES, V.LABEL, V.CLASSES, V.NORMAL, "full", {"seed": 42})
    return one.select(
        "n_train", "n_validation", F.col("train_distribution")[V.NORMAL].alias("train_normal"), F.col("validation_distribution")[V.NORMAL].alias("validation_normal"),
        F.size("features").alias("n_features"), F.size("classes").alias("n_classes"), "normal_class", "run_mode",
    )


def _model_predictions(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        both = V.flows_split(spark, sf_dir)
        fitted = models.fit(both.filter("split = 'train'"), V.FEATURES, V.LABEL, name)
        return models.predict(fitted, both.filter("split = 'validation'"), V.LABEL).select(V.ROW, "predicted", "confidence")

    return run


QUERIES["decision_tree_predictions"] = _model_predictions("decision_tree")
QUERIES["random_forest_predictions"] = _model_predictions("random_forest")

# Alerts and answers


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_table(V.predictions(spark, sf_dir), V.flows(spark, sf_dir), V.FEATURES, RUN, DATASET)


on(_alerts, "alert_table", f"WITH {_ALERTS} SELECT * FROM alerts", lambda d: d)


@query(
    "alert_input_errors",
    f"""WITH {_PREDS}, p AS (SELECT validation_row_index AS k, count(*) AS n, count(DISTINCT model_name) AS m FROM (
      SELECT validation_row_index, model_name FROM preds WHERE NOT (model_name = 'decision_tree' AND validation_row_index % 127 = 0) AND validation_row_index % 211 <> 0
      UNION ALL SELECT validation_row_index, model_name FROM preds WHERE validation_row_index % 131 = 0 AND validation_row_index % 211 <> 0) GROUP BY 1),
    f AS (SELECT row_id AS k, count(*) AS n FROM (SELECT row_id FROM flows WHERE row_id % 83 <> 0 UNION ALL SELECT row_id FROM flows WHERE row_id % 101 = 0 AND row_id % 83 <> 0) GROUP BY 1),
    b AS (SELECT k AS row_id, p.n AS n, p.m AS m, f.n AS c FROM p FULL JOIN f USING (k))
    SELECT row_id, 'FEATURES_MISSING' AS code FROM b WHERE c IS NULL UNION ALL SELECT row_id, 'FEATURES_REPEATED' FROM b WHERE c > 1 UNION ALL SELECT row_id, 'PREDICTIONS_MISSING' FROM b WHERE n IS NULL
    UNION ALL SELECT row_id, 'PREDICTIONS_FEWER' FROM b WHERE m < 2 UNION ALL SELECT row_id, 'PREDICTIONS_REPEATED' FROM b WHERE n > m""",
)
def alert_input_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides with records left out and repeated at intervals."""
    p, f, i = V.predictions(spark, sf_dir), V.flows(spark, sf_dir), F.col("validation_row_index")
    p = p.filter(i % 211 != 0)
    p = p.filter((F.col("model_name") != "decision_tree") | (i % 127 != 0)).unionByName(p.filter(i % 131 == 0))
    f = f.filter(F.col(V.ROW) % 83 != 0)
    return alerts.input_errors(p, f.unionByName(f.filter(F.col(V.ROW) % 101 == 0)), V.ROW)


@query(
    "alert_contract_errors",
    f"""WITH {_ALERTS}, {_DIRTY}, odd AS (SELECT a.alert_id, CASE WHEN a.row_id % 89 = 0 THEN 'other' ELSE a.detector END AS detector, d.value
      FROM alerts a JOIN flows_dirty d USING (row_id))
    SELECT alert_id, 'EVIDENCE_MISSING:value' AS code FROM odd WHERE value IS NULL UNION ALL SELECT alert_id, 'EVIDENCE_NOT_FINITE:value' FROM odd WHERE isnan(value) OR isinf(value)
    UNION ALL SELECT alert_id, 'EVIDENCE_OUT_OF_RANGE:value' FROM odd WHERE abs(value) > 150 AND NOT isinf(value) AND NOT isnan(value)
    UNION ALL SELECT alert_id, 'CONTRACT_DETECTOR' FROM odd WHERE detector NOT IN ('decision_tree', 'random_forest')""",
)
def alert_contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = _alerts(spark, sf_dir).drop("v", "user_id").join(V.flows_dirty(spark, sf_dir).select(V.ROW, "value"), V.ROW)
    odd = odd.withColumn("detector", F.when(F.col(V.ROW) % 89 == 0, "other").otherwise(F.col("detector")))
    return alerts.contract_errors(odd, ["value"], limit=150)


on(
    _alerts, "normalized_evidence",
    f"""WITH {_ALERTS} SELECT alert_id, 'v' AS feature, (v::DECIMAL(20, 0) / 1000000)::DOUBLE AS value, 's' AS unit FROM alerts UNION ALL SELECT alert_id, 'user_id', user_id::DOUBLE, 'count' FROM alerts""",
    lambda d: alerts.normalized_evidence(d, {"v": alerts.MICROSECONDS, "user_id": ("count", 1)}),
)
on(
    V.flows_dirty, "quality_notes",
    f"""WITH {_DIRTY} SELECT row_id, 'value is not finite' AS note FROM flows_dirty WHERE isinf(value) OR isnan(value) UNION ALL SELECT row_id, 'value is implausibly large' FROM flows_dirty WHERE value > 150 AND NOT isinf(value) AND NOT isnan(value)""",
    lambda d: alerts.quality_notes(
        d, V.ROW,
        {
            "value is not finite": F.isnan("value") | (F.abs("value") == float("inf")),
            "value is implausibly large": (F.col("value") > 150) & (F.col("value") < float("inf")),
        },
    ),
)


def _tampered(d: DataFrame) -> DataFrame:
    i = F.col(V.ROW)
    out = d.filter(i % 89 != 0).unionByName(d.filter(i % 89 == 0).filter(i % 2 == 0).withColumn("v", F.col("v") + 1)).unionByName(d.filter(i % 331 == 0))
    return out.unionByName(d.filter(i % 997 == 0).withColumn(V.ROW, -i - 1))


_TAMPERED = _FLOWS + """, after AS (
  SELECT * FROM flows WHERE row_id % 89 <> 0 UNION ALL SELECT row_id, user_id, v + 1, event_type FROM flows WHERE row_id % 89 = 0 AND row_id % 2 = 0
  UNION ALL SELECT * FROM flows WHERE row_id % 331 = 0 UNION ALL SELECT -row_id - 1, user_id, v, event_type FROM flows WHERE row_id % 997 = 0
)"""
on(
    V.flows, "tamper_diff",
    f"""WITH {_TAMPERED}, r AS (SELECT row_id, min({{'user_id': user_id, 'v': v, 'event_type': event_type}}) AS r, count(*) AS n FROM after GROUP BY row_id), j AS (
      SELECT row_id, f.user_id, f.v, f.event_type, f.row_id IS NOT NULL AS has_s, r.r, r.n FROM (SELECT *, row_id AS k FROM flows) f FULL JOIN r USING (row_id))
    SELECT row_id, 'missing' AS change FROM j WHERE n IS NULL UNION ALL SELECT row_id, 'fabricated' FROM j WHERE row_id NOT IN (SELECT row_id FROM flows) UNION ALL SELECT row_id, 'duplicate' FROM j WHERE n > 1
    UNION ALL SELECT f.row_id, 'changed:v' FROM flows f JOIN r USING (row_id) WHERE r.r.v <> f.v""",
    lambda d: alerts.tamper_diff(d, _tampered(d), V.ROW, ["user_id", "v", "event_type"]),
)
_FORGED = _TAMPERED + """, forged AS (
  SELECT * FROM after UNION ALL SELECT row_id, user_id, v + 3, event_type FROM flows WHERE row_id % 661 = 0 UNION ALL SELECT row_id, user_id, v, 'forged' FROM flows WHERE row_id % 1009 = 0
), placed AS (SELECT *, row_number() OVER (ORDER BY row_id, v, event_type) - 1 AS place FROM forged),
moved AS (SELECT row_id, user_id, v, event_type, CASE WHEN place % 500 = 10 THEN place + 1 WHEN place % 500 = 11 THEN place - 1 ELSE place END AS place FROM placed)"""


@query(
    "tamper_localised",
    f"""WITH {_FORGED}, s AS (SELECT row_id, count(*) AS n FROM flows GROUP BY 1), r AS (SELECT row_id, count(*) AS n FROM moved GROUP BY 1), b AS (SELECT row_id, coalesce(s.n, 0) AS s, coalesce(r.n, 0) AS r FROM s FULL JOIN r USING (row_id)),
    o AS (SELECT row_id, lag(row_id) OVER (ORDER BY place) AS before FROM moved)
    SELECT row_id, CASE WHEN r = 0 THEN 'missing' WHEN s = 0 THEN 'fabricated' WHEN r > s THEN 'repeated' ELSE 'lost' END AS change FROM b WHERE r <> s
    UNION ALL SELECT DISTINCT m.row_id, 'changed:v' FROM moved m JOIN flows f ON f.row_id = m.row_id WHERE f.v <> m.v UNION ALL SELECT DISTINCT m.row_id, 'changed:event_type' FROM moved m JOIN flows f ON f.row_id = m.row_id WHERE f.event_type <> m.event_type
    UNION ALL SELECT DISTINCT row_id, 'reordered' FROM o WHERE row_id < before UNION ALL SELECT NULL, 'counts:processed' FROM (SELECT count(*) AS n FROM flows) WHERE n <> 12345""",
)
def tamper_localised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was changed in a copy with changed, missing, repeated, fabricated, forged and moved rows and a wrong count, found by hash trees."""
    d = V.flows(spark, sf_dir)
    d.createOrReplaceTempView("tw_flows")
    sql = _FORGED[len(_FLOWS) + 2 : _FORGED.index(", placed AS")].replace("flows", "tw_flows")
    placed = numbered(spark.sql(f"WITH {sql} SELECT * FROM forged"), [V.ROW, "v", "event_type"], "place")
    place = F.col("place")
    result = placed.withColumn("place", F.when(place % 500 == 10, place + 1).when(place % 500 == 11, place - 1).otherwise(place))
    return merkle.localise(d, result, V.ROW, ["user_id", "v", "event_type"], position="place", claimed={"processed": 12345})


on(
    V.flows, "dataset_diff",
    f"""WITH {_TAMPERED} SELECT *, 'removed' AS change FROM (FROM flows EXCEPT ALL FROM after) UNION ALL SELECT *, 'added' FROM (FROM after EXCEPT ALL FROM flows)""",
    lambda d: alerts.dataset_diff(d, _tampered(d)),
)
on(
    _alerts, "detector_correlation",
    f"""WITH {_ALERTS}, a AS (SELECT run_id, dataset, row_id, attack_type AS class_1 FROM alerts WHERE detector = 'decision_tree'), b AS (SELECT run_id, dataset, row_id, attack_type AS class_2 FROM alerts WHERE detector = 'random_forest')
    SELECT run_id, dataset, row_id, class_1, class_2, CASE WHEN class_2 IS NULL THEN 'first_only' WHEN class_1 IS NULL THEN 'second_only' WHEN class_1 = class_2 THEN 'same_class' ELSE 'different_class' END AS agreement
    FROM a FULL JOIN b USING (run_id, dataset, row_id)""",
    lambda d: alerts.detector_correlation(d, "decision_tree", "random_forest"),
)
on(
    _alerts, "review_worksheet",
    f"""WITH {_ALERTS}, c AS (SELECT attack_type, count(*) AS k FROM alerts GROUP BY 1)
    SELECT run_id, dataset, row_id, string_agg(DISTINCT detector, '|' ORDER BY detector) AS detectors, count(DISTINCT detector) AS n_detectors, string_agg(DISTINCT attack_type, '|' ORDER BY attack_type) AS classes,
    min(k) < 1500 AS rare FROM alerts JOIN c USING (attack_type) GROUP BY run_id, dataset, row_id""",
    lambda d: alerts.review_worksheet(d, 1500),
)
on(_alerts, "alert_selection", f"WITH {_ALERTS} SELECT alert_id FROM alerts ORDER BY alert_id LIMIT 50 OFFSET 100", lambda d: alerts.alert_selection(d, offset=100, limit=50).select("alert_id"))

# Answers with parts that depend on the row: lists, text or something else, keys that lack or are too many.
_ANSWER = """CASE WHEN user_id % 19 = 0 THEN props || ' trailing' WHEN user_id % 17 = 0 THEN '[' || props || ']' ELSE
  '{"observations": ' || CASE user_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN '["' || event_type || '", {"nested": 1}]' ELSE '["' || event_type || '"]' END ||
  CASE WHEN user_id % 7 = 0 THEN '' ELSE ', "explanation": ' || CASE event_type WHEN 'click' THEN '" "' WHEN 'view' THEN props ELSE '"' || event_type || '"' END END ||
  ', "limitations": ["' || event_type || '"], "evidence_used": ' || CASE WHEN user_id % 3 = 0 THEN '["v", "v"]' WHEN user_id % 3 = 1 THEN '["' || event_type || '"]' ELSE '["user_id"]' END ||
  CASE WHEN user_id % 11 = 0 THEN ', "extra": 1' ELSE '' END || ', "priority": ' || CASE WHEN user_id % 13 = 0 THEN '"high"' ELSE 'null' END || '}' END"""
_KEYS = ("observations", "explanation", "limitations", "evidence_used", "priority")


def _structure_sql() -> str:
    """The rules of structure on the text of an answer, by JSON functions."""
    kind = lambda c: f"json_type(j, '$.{c}')"
    sound = lambda c: f"coalesce({kind(c)} = 'ARRAY' AND len(list_filter(json_extract(j, '$.{c}[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0, false)"
    texts = lambda c: f"CASE WHEN {sound(c)} THEN json_extract_string(j, '$.{c}[*]') ELSE []::VARCHAR[] END"
    empty = lambda c: f"len(list_filter({texts(c)}, lambda x: trim(x) <> '')) = 0"
    used = texts("evidence_used")
    rules = {f"{c.upper()}_EMPTY": empty(c) for c in ("observations", "limitations", "evidence_used")}
    rules["EXPLANATION_EMPTY"] = f"coalesce({kind('explanation')} <> 'VARCHAR' OR trim(json_extract_string(j, '$.explanation')) = '', true)"
    rules["EVIDENCE_USED_DUPLICATE"] = f"len(list_distinct({used})) < len({used})"
    rules["EVIDENCE_USED_UNKNOWN"] = f"len(list_filter({used}, lambda x: x NOT IN ({', '.join(map(repr, V.FEATURES))}))) > 0"
    rules["PRIORITY_NOT_NULL"] = f"coalesce({kind('priority')} <> 'NULL', false)"
    rules["RESPONSE_LENGTH"] = f"length(content) > {answers.LONGEST}"
    rules |= {f"KEY_MISSING:{c}": f"NOT list_contains(json_keys(j), '{c}')" for c in _KEYS}
    rules["KEY_UNKNOWN"] = f"len(list_filter(json_keys(j), lambda x: x NOT IN ({', '.join(map(repr, _KEYS))}))) > 0"
    rules |= {f"WRONG_TYPE:{c}": f"list_contains(json_keys(j), '{c}') AND NOT {sound(c)}" for c in ("observations", "limitations", "evidence_used")}
    rules["WRONG_TYPE:explanation"] = f"list_contains(json_keys(j), 'explanation') AND coalesce({kind('explanation')} <> 'VARCHAR', true)"
    each = ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in rules.items())
    return f"""WITH said AS (SELECT event_id AS row_id, {_ANSWER} AS content FROM events),
    parsed AS (SELECT *, CASE WHEN json_valid(content) AND json_type(content) = 'OBJECT' THEN content::JSON END AS j FROM said),
    broken AS (SELECT row_id, unnest([{each}]) AS code FROM parsed WHERE j IS NOT NULL)
    SELECT row_id, code FROM broken WHERE code IS NOT NULL UNION ALL SELECT row_id, 'NOT_JSON' FROM parsed WHERE j IS NULL"""


@query("answer_structure_errors", _structure_sql())
def answer_structure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.expr(_ANSWER).alias("content"))
    return answers.structure_errors(content, "row_id", "content", V.FEATURES)


# What conversations say, with a sentence more that depends on the turn and its length; which claim that makes is known.
_SENTENCES = [
    ("The totals proved it", "CONFIRMATION_CLAIM"), ("Nobody confirmed that, and it is not certain", None), ("A UDP burst, no payload", "INVENTED_NETWORK_DETAIL"), ("The flow was an attack", "ASSERTIVE_CLASSIFICATION"),
    ("I am 80 % sure", "CONFIDENCE_CLAIM"), ("Such figures look corrupted to me", "UNSUPPORTED_DATA_QUALITY_CLAIM"), ("We cannot see port 4433", "INVENTED_NETWORK_DETAIL"),
    ("It might be normal, but it clearly indicates abuse", "CONFIRMATION_CLAIM"), ("Nothing else", None), ("More logs would be needed to prove intent", None), ("There are no flags, payloads, or TCP details", None),
    ("Payloads are not available, however SYN was set", "INVENTED_NETWORK_DETAIL"), ("Rather than a confirmed case, it looks routine", None), ("Rather than guess, this confirms abuse", "CONFIRMATION_CLAIM"),
    ("The flow is possibly an attack", None), ("No sign of corruption, no measurement error", None), ("Payloads and SYN counts are unavailable", None),
]
_PICKED = f"(length(text) + turn) % {len(_SENTENCES)}"
_SAID = "text || '. ' || CASE " + _PICKED + " " + " ".join(f"WHEN {i} THEN '{s}'" for i, (s, _) in enumerate(_SENTENCES)) + " END || '.'"


@query(
    "answer_claim_flags",
    f"""WITH c AS (SELECT conv_id, turn, role, CASE {_PICKED} {' '.join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_SENTENCES) if c)} END AS code FROM conversations WHERE text IS NOT NULL)
    SELECT DISTINCT conv_id, turn, code FROM c WHERE code IS NOT NULL AND NOT (code = 'UNSUPPORTED_DATA_QUALITY_CLAIM' AND role = 'user')""",
)
def answer_claim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL says what each sentence claims, not how that is found; conversations themselves make no claims."""
    said = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("said"), (F.col("role") == "user").alias("noted"))
    return claims.claim_flags(said, ["conv_id", "turn"], "said", "noted")


@query("conversation_claims", "SELECT conv_id, turn, 'NONE' AS code FROM conversations WHERE false")
def conversation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as they stand: every row that comes out is a false alarm."""
    return claims.claim_flags(V.table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


# Sentences about a record's evidence: Flow Duration (s) is v, Flow Bytes/s (B/s) is user_id, Total Fwd Packets (packets) is row_id % 50.
_WRITTEN = """CASE row_id % 13 WHEN 0 THEN 'The session ran ' || v || ' seconds.' WHEN 1 THEN 'It ran ' || v * 1000 || 'ms in all.'
  WHEN 2 THEN 'It ran ' || CAST(floor(v / 60) AS BIGINT) || ' min ' || v % 60 || ' s.' WHEN 3 THEN 'Flow Bytes/s was ' || (user_id + row_id % 2) || 'B/s.'
  WHEN 4 THEN 'Total Fwd Packets was ' || v || ' packets.' WHEN 5 THEN 'The ' || (row_id % 6 + 4) || 'th observation is short.'
  WHEN 6 THEN 'It sits at the ' || (row_id % 6 + 4) || 'th percentile.' WHEN 7 THEN 'It ran a few minutes.' WHEN 8 THEN 'It moved ' || user_id || ' kB.'
  WHEN 9 THEN 'It ran ' || v || 'e1 seconds.' WHEN 10 THEN 'It ran roughly seventeen hours.' WHEN 11 THEN 'Seen were ' || (v + row_id % 3) || ' and ' || row_id % 50 || '.'
  ELSE 'It ran ' || (v + 1) || ' seconds, and ' || row_id % 50 || ' packets were sent.' END"""


def _numbers_sql() -> str:
    """What is written, read from the sentences by a pattern for each way of writing: (number, dim, value, half)."""
    ways = [
        (r" ([0-9]+ seconds)", "'s'", "{1}", "0.5", r" ([0-9]+) seconds"),
        (r"([0-9]+ms)", "'s'", "{1} / 1000", "0.0005", r"([0-9]+)ms"),
        (r"([0-9]+ min [0-9]+ s)", "'s'", r"{1} * 60 + CAST(regexp_extract(text, 'min ([0-9]+) s', 1) AS DOUBLE)", "0.5", r"([0-9]+) min"),
        (r"([0-9]+B/s)", "'B/s'", "{1}", "0.5", r"([0-9]+)B/s"),
        (r"([0-9]+ packets)", "'packets'", "{1}", "0.5", r"([0-9]+) packets"),
        (r"([0-9]+th percentile)", "'?'", "{1}", "0.5", r"([0-9]+)th percentile"),
        (r"(a few minutes)", "'s'", "360", "180", None),
        (r"([0-9]+ kB)", "'B'", "{1} * 1000", "500", r"([0-9]+) kB"),
        (r"([0-9]+e1 seconds)", "'s'", "{1} * 10", "5", r"([0-9]+)e1"),
        (r"(seventeen hours)", "'s'", "61200", "1800", None),
        (r"were ([0-9]+) and", "''", "{1}", "0.5", r"were ([0-9]+) and"),
        (r"and ([0-9]+)\.", "''", "{1}", "0.5", r"and ([0-9]+)\."),
    ]
    each = []
    for pattern, dim, value, half, digits in ways:
        value = value.replace("{1}", f"CAST(regexp_extract(text, '{digits}', 1) AS DOUBLE)") if digits else value
        each.append(f"SELECT row_id, text, regexp_extract(text, '{pattern}', 1) AS number, {dim} AS dim, {value} AS value, {half} AS half FROM said WHERE regexp_matches(text, '{pattern}')")
    return f"""WITH {_FLOWS}, said AS (SELECT row_id, {_WRITTEN} AS text FROM flows), written AS ({' UNION ALL '.join(each)}),
    evidence AS (SELECT row_id, 'Flow Duration' AS feature, 's' AS unit, v AS is FROM flows UNION ALL SELECT row_id, 'Flow Bytes/s', 'B/s', user_id FROM flows UNION ALL SELECT row_id, 'Total Fwd Packets', 'packets', row_id % 50 FROM flows),
    one AS (SELECT row_id, text, max(feature) AS feature FROM said JOIN evidence USING (row_id) WHERE contains(text, feature) GROUP BY row_id, text),
    numbered AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS n FROM written)
    SELECT DISTINCT row_id, number FROM numbered w WHERE NOT EXISTS (SELECT 1 FROM evidence e LEFT JOIN one USING (row_id) WHERE e.row_id = w.row_id AND w.dim IN ('', e.unit)
      AND abs(e.is - w.value) <= w.half AND (n > 1 OR one.feature IS NULL OR one.feature = e.feature))"""


@query("answer_numbers_ungrounded", _numbers_sql())
def answer_numbers_ungrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.flows(spark, sf_dir)
    features = {"Flow Duration": ("s", F.col("v")), "Flow Bytes/s": ("B/s", F.col("user_id")), "Total Fwd Packets": ("packets", F.col(V.ROW) % 50)}
    each = [F.struct(F.lit(f).alias("feature"), F.lit(unit).alias("unit"), value.cast("double").alias("value")) for f, (unit, value) in features.items()]
    evidence = rows.select(V.ROW, F.explode(F.array(*each)).alias("_e")).select(V.ROW, "_e.*")
    return quantities.ungrounded(rows.select(V.ROW, F.expr(_WRITTEN).alias("text")), [V.ROW], "text", evidence)
