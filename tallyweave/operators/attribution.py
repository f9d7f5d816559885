"""Exact Shapley values of boosted trees (path-dependent), importance, and the factors shown to analysts."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.contract import DESCRIPTIONS

TOLERANCE = 1e-4


def leaves(model) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Each leaf of a boosted model as (value in log-odds, conditions), a condition per feature of its path:
    (feature, low, high, share): the leaf asks low < x <= high, and without the feature known a row
    follows the path with the share of training rows (by Hessian weight) that did."""
    found = []

    def walk(tree, node: int, path: dict[int, tuple[float, float, float]]) -> None:
        f = tree.feature[node]
        if f < 0:
            found.append((tree.value[node], [(f, *c) for f, c in path.items()]))
            return
        cutoff, total = tree.cut[node], tree.cover[node]
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((tree.left[node], (low, min(high, cutoff))), (tree.right[node], (max(low, cutoff), high))):
            walk(tree, child, path | {f: (*bounds, share * tree.cover[child] / total)})

    for tree in model.trees:
        walk(tree, 0, {})
    return found


def shapley(x: np.ndarray, tree_leaves: list) -> np.ndarray:
    """Rows of contributions, one column per feature and the bias as the last. Over one leaf with d features
    the game is a product, so the coalitions of a size are summed as coefficients of a polynomial."""
    out = np.zeros((len(x), x.shape[1] + 1))
    for value, path in tree_leaves:
        holds = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in path]
        shares = [c[3] for c in path]
        d = len(path)
        out[:, -1] += value * np.prod(shares)
        for j, (f, *_) in enumerate(path):
            sums = [np.ones(len(x))]
            for k in range(d):
                if k != j:
                    sums = [(sums[s] * shares[k] if s < len(sums) else 0) + (sums[s - 1] * holds[k] if s else 0) for s in range(len(sums) + 1)]
            weight = sum(factorial(s) * factorial(d - s - 1) / factorial(d) * c for s, c in enumerate(sums))
            out[:, f] += value * (holds[j] - shares[j]) * weight
    return out


def contributions(df: DataFrame, model, features: list[str]) -> DataFrame:
    """df with `contributions`: an array of doubles, in the order of features, then the bias."""
    held = leaves(model)

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
            yield pd.Series(list(shapley(x, held)))

    return df.withColumn("contributions", explain(*[F.col(f).cast("double") for f in features]))


def margin_gap(explained: DataFrame, p: str = "p") -> float:
    """Largest distance of the summed contributions from the log-odds of p."""
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    return explained.agg(F.max(F.abs(total - F.log(F.col(p) / (1 - F.col(p)))))).first()[0] or 0.0


def mean_absolute(explained: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute contribution of each feature, scaled to a sum of 1 (0 if all are 0)."""
    means = explained.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"_{i}") for i in range(len(features))])
    total = sum((F.col(f"_{i}") for i in range(len(features))), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.when(total > 0, F.col(f"_{i}") / total).otherwise(0.0).alias("share")) for i, f in enumerate(features)])
    return means.select(F.inline(rows))


def top_factors(features: list[str], k: int = 3) -> Column:
    """The k reasons of a row: what raises the risk, largest first, then what lowers it, strongest first.
    Whether it raises is told by the rounded contribution that is shown."""
    parts = [F.struct((F.col("contributions")[i] <= 0).alias("lowers"), (-F.abs(F.col("contributions")[i])).alias("size"), F.lit(i).alias("place"), F.lit(f).alias("feature"), F.lit(DESCRIPTIONS.get(f, f)).alias("description"), F.bround(F.col(f).cast("double"), 6).alias("value"), F.bround(F.col("contributions")[i], 6).alias("contribution")) for i, f in enumerate(features)]
    shown = lambda s: F.struct(s["feature"].alias("feature"), s["description"].alias("description"), s["value"].alias("value"), s["contribution"].alias("contribution"), F.when(s["contribution"] > 0, "raises_risk").otherwise("lowers_risk").alias("effect"))
    return F.transform(F.slice(F.array_sort(F.array(*parts)), 1, k), shown)
