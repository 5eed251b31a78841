"""Cleaning a labelled table, and a baseline experiment over a training and a validation table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablewarden.functions.columns import count_if, display_hash
from tablewarden.functions.scratch import materialise
from tablewarden.operators import contract, duplicates, evaluate, models, overlap, profile, splits
from tablewarden.sources import tables


def clean_table(df: DataFrame, label: str, row_id: str) -> dict[str, DataFrame]:
    """The record sets of a quality audit by name, and the cleaned table.

    Rows whose vector may repeat are marked once, with one shuffle of them, and written to the shared folder; record sets are
    filters on these, and rows that are alone stay where they are.
    """
    features = profile.feature_columns(df, label, (row_id,))
    alone, met = duplicates.marked(df, features, label)
    met = materialise(met, "clean-marked")
    plain = lambda rows: rows.drop(duplicates.PAIR, duplicates.LABELS)
    conflicting = plain(met.filter(F.col(duplicates.LABELS) > 1))
    return {
        "missing": profile.missing_counts(df),
        "infinite": profile.infinite_counts(df),
        "class_distribution": profile.class_distribution(df, label),
        "duplicate_records": plain(met.filter(F.col(duplicates.PAIR) > 1)),
        "conflicting_records": conflicting.withColumn("vector_hash", display_hash(features)),
        "conflict_label_pairs": duplicates.conflict_label_pairs(conflicting, features, label),
        "clean": duplicates.clean_marked(alone, met, features, label, row_id),
        "postcheck": duplicates.postcheck_marked(alone, met, features, label, row_id),
    }


def observe_classes(df: DataFrame, label: str, classes: list[str], name: str) -> tuple[DataFrame, Observation]:
    """df with its rows by class counted along the way, whatever it is written to next."""
    seen = Observation(f"classes of {name}")
    return df.observe(seen, F.count(F.lit(1)).alias("n"), *[count_if(F.col(label) == c).alias(c) for c in classes]), seen


def _counts(df: DataFrame, label: str, classes: list[str]) -> dict[str, int]:
    """Rows by class, a row per class from the table, and under None all rows with a label."""
    rows = {r[label]: r.n for r in profile.class_distribution_ordered(df, label, classes).collect()}
    return rows | {None: sum(rows.values())}


def run_metadata(
    train: DataFrame, validation: DataFrame, features: list[str], label: str, classes: list[str], normal: str, run_mode: str, parameters: dict[str, str], seen: tuple[dict, dict] | None = None
) -> DataFrame:
    """One row: run_mode, counts, class distributions (maps), features, classes, normal class, parameters.

    seen has both tables' rows by class and under None their number, where they were counted while being written.
    """
    sides = dict(zip(("train", "validation"), seen or (_counts(train, label, classes), _counts(validation, label, classes))))
    listed = lambda xs: F.array(*map(F.lit, xs))
    kept = {name: {c: n for c, n in counts.items() if c is not None and n} for name, counts in sides.items()}
    mapped = lambda counts, kind: F.create_map(*[F.lit(x) for kv in sorted(counts.items()) for x in kv]).cast(kind)
    each = [e for name in sides for e in (F.lit(sides[name][None]).cast("long").alias(f"n_{name}"), mapped(kept[name], "map<string,bigint>").alias(f"{name}_distribution"))]
    return train.sparkSession.range(1).select(
        F.lit(run_mode).alias("run_mode"), *each, listed(features).alias("features"), listed(classes).alias("classes"), F.lit(normal).alias("normal_class"),
        mapped({str(k): str(v) for k, v in parameters.items()}, "map<string,string>").alias("parameters"),
    )


def run_baseline(train, validation, label, row_id, classes, normal, names=("decision_tree", "random_forest"), audit=True, sample=None, expected_features=None, failures=None):
    """(predictions, outputs): validate, audit the full tables, sample if asked (a smoke run), fit and score every model.

    outputs has error cases, report, confusion matrix, binary metrics, comparison, audit and metadata by name. Models are
    checked before anything runs; the audit covers the full tables, before sampling. Both tables and each model's predictions are
    written once, to the shared folder; counts by class and the table of (actual, predicted) are observed while that is
    done, so no figure takes a second pass, and the seconds are those of fitting and of scoring every row alone. failures is what the
    reader couldn't cast (contract.validate).
    """
    for name in names:
        models.make_model(name)
    features = contract.validate(train, validation, label, expected_features, classes, (row_id,), failures)
    both = train.withColumn("split", F.lit("train")).unionByName(validation.withColumn("split", F.lit("validation")))
    annotation = None
    if audit:
        overlap.check_delimiter(both, label)
        annotation = overlap.overlap_annotation(both, features, label, row_id, "split")
    mode = "smoke" if sample else "full"
    if sample:
        train, validation = (splits.stratified_sample(d, label, row_id, n) for d, n in zip((train, validation), sample, strict=True))
    written, counts = [], []
    for name, df in (("train", train), ("validation", validation)):
        observed, seen = observe_classes(df, label, classes, name)
        written.append(materialise(observed, f"run-{name}"))
        got = seen.get
        counts.append({c: got[c] for c in classes} | {None: got["n"]})
    train, validation = written
    predictions, seconds, observations = None, {}, {}
    for name in names:
        began = time.monotonic()
        fitted = models.fit(train, features, label, name)
        done = time.monotonic()
        scored = models.predict(fitted, validation, label)
        frame = evaluate.prediction_frame(scored, row_id, label, "predicted", "confidence", normal, name, mode)
        observed, observations[name] = evaluate.observe_pairs(frame, classes, name)
        frame = materialise(observed, f"run-{name}")
        seconds[name] = (done - began, time.monotonic() - done)
        predictions = frame if predictions is None else predictions.unionByName(frame)
    pairs = evaluate.observed_pairs(train.sparkSession, observations, classes)
    if annotation is not None:
        predictions = evaluate.annotate(predictions, annotation, row_id)
    outputs = {
        "error_cases": evaluate.error_cases(predictions, validation.select(row_id, *features), row_id),
        "classification_report": evaluate.classification_report(pairs, classes, mode),
        "confusion_matrix": tables.add_leading(evaluate.confusion_matrix(pairs, classes), run_mode=mode),
        "binary_metrics": evaluate.binary_metrics(pairs, mode, normal),
        "model_comparison": evaluate.model_comparison(pairs, classes, mode, seconds, normal),
        "audit_summary": overlap.audit_summary(both, features, label, "split", audit),
    }
    about = run_metadata(train, validation, features, label, classes, normal, mode, {"models": ",".join(names)}, tuple(counts))
    mapping = F.create_map(*[F.lit(x) for c in classes for x in (c, "NORMAL" if c == normal else "ATTACK")])
    named = F.array(*[F.lit(x) for x in sorted([*outputs, "run_metadata"])])
    whole = about.crossJoin(outputs["audit_summary"].select(F.struct("*").alias("audit")))  # one row each
    outputs["run_metadata"] = whole.withColumns({"binary_mapping": mapping, "outputs": named})
    return predictions, outputs
