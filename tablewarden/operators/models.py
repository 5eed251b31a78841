"""The tree baselines by name."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from tablewarden.operators import trees
from tablewarden.operators.evaluate import prediction_confidence

SEED = 42
#: Both grow until leaves are pure; a forest's node looks at the square root of the number of features. Fixed values.
CONFIGS = {
    "decision_tree": lambda n: {"trees": 1, "bootstrap": False, "most": n},
    "random_forest": lambda n: {"trees": 100, "bootstrap": True, "most": max(1, math.isqrt(n))},
}


def make_model(name: str, n_features: int = 1) -> dict:
    """The settings of a model; an unknown name is an error."""
    if name not in CONFIGS:
        raise ValueError(f"unknown model {name!r}; there are {sorted(CONFIGS)}")
    return CONFIGS[name](n_features)


def fit(train: DataFrame, features: list[str], label: str, name: str, **settings) -> trees.Forest:
    """A fitted model. Rows must meet the contract (no NaN, no null)."""
    return trees.fit(train, features, label, **({"seed": SEED} | make_model(name, len(features)) | settings))


def predict(model: trees.Forest, df: DataFrame, label: str) -> DataFrame:
    """df with predicted and confidence."""
    rows = trees.predict(model, df).withColumnRenamed("__predicted", "predicted")
    return prediction_confidence(rows, model.classes, "__p", "predicted").select(*df.columns, "predicted", "confidence")
