"""Exact Shapley values of boosted trees: what each feature adds to a row's margin.

A tree's value for a set of known features follows those, and takes the mean over the training rows of both sides at splits
by others. For one leaf this is a product over the features on its path: 1 or 0 for a known one (the row passes all its
splits or not), the share of rows that pass for an unknown one. So the Shapley values of a leaf come from the coefficients of
a polynomial with one factor a feature, and those of the model are the sums over leaves and trees.

Trees are exported once to leaves with their paths, a table bounded by the model; rows stream past them. What a leaf gives
depends only on which of its features a row passes, and is computed once for each such pattern of a batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_ROWS = 4096


@dataclass
class Leaf:
    """value: weighted; features[j] are passed by tests[j] (all of (split, is left)), by shares[j] of the rows of the tree."""

    value: float
    features: list[int]
    shares: np.ndarray
    tests: list[list[tuple[tuple, bool]]]


def export(model: PipelineModel, path: str) -> tuple[list[Leaf], float]:
    """Leaves of all trees and the mean margin of the training rows; path: a folder of the shared store for the model's tables."""
    trees = model.stages[-1]
    trees.write().overwrite().save(path)
    nodes: dict[int, dict[int, tuple]] = {}
    for r in SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # the model's size, not the data's
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    leaves, base = [], 0.0
    for tree, weight in enumerate(trees.treeWeights):
        table = nodes[tree]
        todo = [(0, {})]
        while todo:
            at, passed = todo.pop()
            node = table[at]
            if node["leftChild"] < 0:
                leaf = Leaf(weight * node["prediction"], list(passed), np.array([s for s, _ in passed.values()]), [t for _, t in passed.values()])
                base += leaf.value * float(np.prod(leaf.shares))
                leaves.append(leaf)
                continue
            split = node["split"]
            rule = (split["featureIndex"], tuple(split["leftCategoriesOrThreshold"]), split["numCategories"])
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                share, tests = passed.get(rule[0], (1.0, []))
                part = table[child]["rawCount"] / node["rawCount"]
                todo.append((child, passed | {rule[0]: (share * part, [*tests, (rule, left)])}))
    return leaves, base


def _passes(x: np.ndarray, tests: list[tuple[tuple, bool]]) -> np.ndarray:
    """Whether each value of a feature takes the path through these splits."""
    out = np.ones(len(x), bool)
    for (_, values, categories), left in tests:
        goes = np.isin(x, values) if categories >= 0 else x <= values[0]
        out &= goes if left else ~goes
    return out


def pattern_values(known: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """(pattern, feature): Shapley values of the product over features of `known` (1 or 0) if known, else its share."""
    n, d = known.shape
    weights = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    out = np.empty((n, d))
    for j in range(d):
        poly = np.zeros((n, d))
        poly[:, 0] = 1
        for i in range(d):
            if i != j:  # times (share + known * t)
                poly[:, 1:] = poly[:, 1:] * shares[i] + poly[:, :-1] * known[:, i : i + 1]
                poly[:, 0] *= shares[i]
        out[:, j] = (poly @ weights) * (known[:, j] - shares[j])
    return out


def shapley(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """(row, feature) values of the margin."""
    out = np.zeros(x.shape)
    tested: dict[tuple, np.ndarray] = {}
    for leaf in leaves:
        if not leaf.features:
            continue
        columns = []
        for f, tests in zip(leaf.features, leaf.tests, strict=True):
            key = (f, *tests)
            if key not in tested:
                tested[key] = _passes(x[:, f], tests)
            columns.append(tested[key])
        passed = np.column_stack(columns)
        seen, which = np.unique(passed, axis=0, return_inverse=True)
        out[:, leaf.features] += leaf.value * pattern_values(seen.astype(float), leaf.shares)[which.reshape(-1)]
    return out


def tree_attributions(df: DataFrame, model: PipelineModel, features: list[str], id_col: str, path: str) -> tuple[DataFrame, float]:
    """id, feature, attribution of every row, and the base value: a row's attributions sum to its margin less the base.

    features: the names in the order of the model's vector. A margin m means a probability of 1 / (1 + exp(-2 m)).
    """
    leaves, base = export(model, path)
    shared = df.sparkSession.sparkContext.broadcast(leaves)
    ready = PipelineModel(model.stages[:-1]).transform(df).select(F.col(id_col).alias("id"), vector_to_array("features").alias("x"))
    kind = ready.schema["id"].dataType

    def run(batches):
        names = pa.array(features)
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                x = np.array(part.column("x").flatten()).reshape(part.num_rows, len(features))
                row, feature = np.divmod(np.arange(x.size), len(features))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), names.take(pa.array(feature)), pa.array(shapley(x, shared.value).ravel())], schema=pa.schema([("id", to_arrow_type(kind)), ("feature", pa.string()), ("attribution", pa.float64())]))

    return ready.mapInArrow(run, f"id {kind.simpleString()}, feature string, attribution double").withColumnRenamed("id", id_col), base
