"""Gradient boosted trees by histograms of gradients and Hessians, several models at once.

Rows hold the bins of their features and the margin so far. For each level of a tree all models' gradients and
Hessians are summed by (model, node, feature, bin): tasks sum their own rows, and what comes to the driver has at most
models x nodes x features x bins rows, whatever the input; up to FEW tasks send theirs as they are, those of more are
shuffled. Sums are of whole numbers (fixed
point), so a model doesn't depend on how rows are dealt. The driver takes the best split of each node: its gain has
an L2 penalty, both sides need a least Hessian weight, leaves are Newton steps. Trees are functions of the bins, so
a row's margin follows from those since it was last written, every ``WRITE`` rounds. Then the validation rows'
average precision is taken for each of these rounds, and a model whose best is ``PATIENCE`` rounds old grows no more
and keeps its trees up to that one.

Where each model has ``ALONE`` times PART rows at most, a level is less work than the start of its job. Then a task grows
all trees of a model (`_grown`), the models at the same time; trees and margins are the same to the last bit.

Models in one call (folds, ablations) share the jobs: their rows are told apart by `model`."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.work import cut, handed, looping, together

#: Bins of a feature, depth, rate, L2 penalty, least Hessian weight of a side, shares of rows and features of a tree.
BINS, DEPTH, RATE, PENALTY, WEIGHT, ROWS, COLUMNS = 64, 4, 0.05, 2.0, 5.0, 0.8, 0.8
ROUNDS, PATIENCE, WRITE, SEED = 500, 30, 10, 42
#: Units of a gradient in fixed point; rows of a partition: at least PART while that leaves cores idle, at most MOST; and
#: tasks whose sums needn't be shuffled. Parts of a model that one task grows alone, and rows that it sums at once.
UNIT, PART, MOST, FEW = 1 << 24, 100_000, 200_000, 16
ALONE, CHUNK = 7, 65_536


@dataclass
class Tree:
    """Nodes in the order of making: feature (-1: leaf), bin and value of the cut (lower or equal: left), kids,
    margin of a leaf, Hessian weight of the training rows, gain of the split."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def leaf(self, value: float, cover: float) -> int:
        for held, x in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.value, value), (self.cover, cover), (self.gain, 0.0)):
            held.append(x)
        return len(self.feature) - 1

    def at(self, x: np.ndarray, cuts: list) -> np.ndarray:
        """The leaf (or, while the tree grows, the node) of each row of x: bins, or values with their cuts."""
        feature, cuts, places = np.array(self.feature), np.array(cuts), np.arange(len(self.feature))
        # Of each node what follows a value over the cut, and one that isn't; a leaf is followed by itself.
        kids = np.where(feature < 0, places, [self.right, self.left]).T.reshape(-1)
        node, first, flat, feature = np.zeros(len(x), np.int64), np.arange(len(x)) * x.shape[1], x.reshape(-1), np.maximum(feature, 0)
        for _ in range(DEPTH if len(places) > 1 else 0):
            node = kids.take(2 * node + (flat.take(first + feature.take(node)) <= cuts.take(node)))
        return node


@dataclass
class Boosted:
    """A model: names of features, and trees, whose values sum to the log-odds."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)
    #: Average precision on the validation rows by round, where there were any.
    history: list[float] = field(default_factory=list)

    @property
    def numFeatures(self) -> int:  # noqa: N802
        return len(self.features)

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.trees)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            out += np.array(t.value)[t.at(x, t.cut)]
        return out

    def importances(self) -> list[float]:
        """Mean gain of each feature's splits, normalised."""
        total, n = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f], n[f] = total[f] + g, n[f] + 1
        mean = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
        return (mean / mean.sum() if mean.sum() > 0 else mean).tolist()

    def scored(self, df: DataFrame) -> DataFrame:
        """df with p and margin."""
        names = [F.col(f"`{f}`").cast("double") for f in self.features]

        @F.pandas_udf("struct<p:double,margin:double>")
        def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                columns = batch if isinstance(batch, tuple) else (batch,)  # a single column comes alone
                m = self.margin(np.column_stack([c.to_numpy(dtype=float) for c in columns]))
                yield pd.DataFrame({"p": 1 / (1 + np.exp(-m)), "margin": m})

        held = [c for c in df.columns if c not in ("p", "margin")]
        return df.withColumn("_scored", apply(*names)).select(*[F.col(f"`{c}`") for c in held], "_scored.p", "_scored.margin")

    def text(self) -> str:
        return json.dumps({"features": self.features, "trees": [vars(t) for t in self.trees], "history": self.history})

    @classmethod
    def read(cls, text: str) -> Boosted:
        doc = json.loads(text)
        return cls(doc["features"], [Tree(**t) for t in doc["trees"]], doc["history"])


def edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """The cuts of each feature: up to bins - 1 values, quantiles of df; a value's bin is how many are below it."""
    found = df.agg(*[F.percentile_approx(F.col(f"`{f}`").cast("double"), [i / bins for i in range(1, bins)], 20_000).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(x if x else [], float)) for x in found]


def _uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """A number from 0 to 1 for each key, other ones in each draw."""
    x = key.astype(np.uint64) ^ np.uint64(draw * 0x9E3779B97F4A7C15 % 2**64)
    for shift in (30, 27):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted logistic loss, in fixed point."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint(UNIT * w * (p - y)).astype(np.int64), np.rint(UNIT * w * np.maximum(p * (1 - p), 1e-16)).astype(np.int64)


def add(sums: np.ndarray, cell: np.ndarray, value: np.ndarray) -> None:
    """The whole numbers `value`, each added to its cell of sums: as doubles where these hold all sums of them."""
    if np.abs(value.astype(float)).sum() < 2.0**52:
        sums += np.bincount(cell, value, len(sums)).astype(np.int64)
    else:
        np.add.at(sums, cell, value)


def chosen_features(n: int, round_: int) -> np.ndarray:
    order = np.argsort(_uniform(np.arange(n, dtype=np.int64), SEED + 7919 * (round_ + 1)), kind="stable")
    return np.sort(order[: max(1, round(COLUMNS * n))])


def best_split(g: np.ndarray, h: np.ndarray, used: np.ndarray) -> tuple[float, int, int, np.ndarray] | None:
    """Of one node's sums (features x bins) the split of the largest gain, the first feature and bin of equals:
    gain, feature, last bin of the left side, and (G, H) of the left side."""
    gl, hl = np.cumsum(g, 1)[:, :-1] / UNIT, np.cumsum(h, 1)[:, :-1] / UNIT
    gt, ht = g.sum(1)[:, None] / UNIT, h.sum(1)[:, None] / UNIT
    gr, hr = gt - gl, ht - hl
    gain = gl**2 / (hl + PENALTY) + gr**2 / (hr + PENALTY) - gt**2 / (ht + PENALTY)
    ok = (hl >= WEIGHT) & (hr >= WEIGHT) & np.isin(np.arange(len(g)), used)[:, None]
    gain = np.where(ok, np.round(gain, 9), -np.inf)
    i = int(gain.argmax()) if gain.size else 0
    if not gain.size or not gain.flat[i] > 0:
        return None
    f, b = divmod(i, gain.shape[1])
    return float(gain[f, b]), f, b, np.array([g[f, : b + 1].sum(), h[f, : b + 1].sum()])


def grow(tree: Tree, front: list[int], sums: dict[int, tuple[np.ndarray, np.ndarray]], used: np.ndarray, cuts: list[np.ndarray], last: bool) -> list[int]:
    """Splits the nodes of a level by their sums; the new ones, which the next level looks at."""
    new: list[int] = []
    value = lambda g, h: -RATE * (g / UNIT) / (h / UNIT + PENALTY)
    for node in front:
        if node not in sums:
            continue
        g, h = sums[node]
        total = np.array([g[0].sum(), h[0].sum()])
        if len(tree.feature) == 1:
            tree.value[0], tree.cover[0] = value(*total), total[1] / UNIT
        if (found := best_split(g, h, used)) is None:
            continue
        gain, f, b, low = found
        kids = [tree.leaf(value(*side), side[1] / UNIT) for side in (low, total - low)]
        tree.feature[node], tree.bin[node], tree.cut[node], tree.gain[node] = f, b, float(cuts[f][b]), gain
        tree.left[node], tree.right[node] = kids
        new += kids
    return [] if last else new


ROW = "model int, valid boolean, y double, w double, key long, bins binary, margin double"


def _binned(df: DataFrame, features: list[str], label: str, cuts: list[np.ndarray]) -> DataFrame:
    """df (model, valid, label, features) as rows to grow trees of."""
    names = ["model", "valid", "y", "w", "key", "bins", "margin"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.searchsorted(c, batch.column(5 + i).to_numpy(zero_copy_only=False)) for i, c in enumerate(cuts)]).astype(np.uint8)
            raw = x.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([raw[i : i + len(cuts)] for i in range(0, len(raw), len(cuts))], pa.binary()), pa.array(np.zeros(len(x)))], names=names)

    spw = F.sum(F.when(~F.col("valid"), 1 - F.col(label))) / F.greatest(F.sum(F.when(~F.col("valid"), F.col(label))), F.lit(1))
    weights = df.groupBy("model").agg(spw.cast("double").alias("_w"))
    d = df.join(F.broadcast(weights), "model")
    values = [F.col(f"`{f}`").cast("double") for f in features]
    return d.select("model", "valid", F.col(label).cast("double").alias("y"), F.when(F.col(label) == 1, F.col("_w")).otherwise(1.0).alias("w"), F.xxhash64(label, *values).alias("key"), *[v.alias(f"_{i}") for i, v in enumerate(values)]).mapInArrow(stream, ROW)


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    column = batch.column(5)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), n)


def _sums(rows: DataFrame, recent: dict[int, list[Tree]], growing: dict[int, tuple[Tree, list[int]]], round_: int, n: int, several: bool) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Of each growing model and node of its front the sums of its rows by feature and bin."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {m: np.zeros((2, len(front), n, BINS), np.int64) for m, (_, front) in growing.items()}
        for batch in batches:
            model, key = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            drawn = _uniform(key, SEED + round_) < ROWS
            x, y, w, margin = _matrix(batch, n), batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(6).to_numpy()
            for m, (tree, front) in growing.items():
                own = np.flatnonzero(drawn & (model == m))
                if not len(own):
                    continue
                b, f = x[own], margin[own].copy()
                for t in recent[m]:
                    f += np.array(t.value)[t.at(b, t.bin)]
                g, h = gradients(y[own], w[own], f)
                place = np.full(len(tree.feature), -1)
                place[front] = np.arange(len(front))
                node = place[tree.at(b, tree.bin)]
                b, g, h, node = b[node >= 0], g[node >= 0], h[node >= 0], node[node >= 0]
                cell = ((node[:, None] * n + np.arange(n)) * BINS + b).reshape(-1)
                add(held[m][0].reshape(-1), cell, np.repeat(g, n))
                add(held[m][1].reshape(-1), cell, np.repeat(h, n))
        out = []
        for m, s in held.items():
            there = np.flatnonzero(s[1])
            if len(there):
                out.append((np.full(len(there), m, np.int32), there, s[0].reshape(-1)[there], s[1].reshape(-1)[there]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["model", "cell", "g", "h"])

    parts = rows.where("not valid").mapInArrow(stream, "model int, cell long, g long, h long")
    if several:  # those of a few tasks meet on the driver
        parts = parts.groupBy("model", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    found: dict[int, np.ndarray] = {m: np.zeros((2, len(front), n, BINS), np.int64) for m, (_, front) in growing.items()}
    model, cell, g, h = (c.to_numpy() for c in parts.toArrow().columns)  # FEW x models x nodes x features x bins at most
    for m, s in found.items():
        own = model == m
        np.add.at(s[0].reshape(-1), cell[own], g[own])
        np.add.at(s[1].reshape(-1), cell[own], h[own])
    return {m: {node: (s[0][i], s[1][i]) for i, node in enumerate(growing[m][1]) if s[1][i].any()} for m, s in found.items()}


def _moved(rows: DataFrame, recent: dict[int, list[Tree]], n: int) -> DataFrame:
    """The rows of the models in `recent` with their margins after those trees, and of validation rows all in between."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, valid, x, margin = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch, n), batch.column(6).to_numpy().copy()
            size = np.where(valid, [len(recent[m]) for m in model.tolist()], 0)
            first = np.append(0, np.cumsum(size))
            seen = np.zeros(first[-1])
            for m, trees in recent.items():
                own = np.flatnonzero(model == m)
                steps = np.array([np.array(t.value)[t.at(x[own], t.bin)] for t in trees]).reshape(len(trees), len(own))
                after = margin[own] + np.cumsum(steps, 0) if len(trees) else np.zeros((0, len(own)))
                held = valid[own]
                seen[first[own[held]][:, None] + np.arange(len(trees))] = after[:, held].T
                if len(trees):
                    margin[own] = after[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(margin), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(seen))], names=[*batch.schema.names[:7], "seen"])

    return rows.select(*[c.split()[0] for c in ROW.split(", ")]).where(F.col("model").isin(*recent)).mapInArrow(stream, ROW + ", seen array<double>")


def precision(p: np.ndarray, y: np.ndarray) -> float:
    """Average precision as `models.ranking` has it, equal scores together; 0 for one class."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    last = np.flatnonzero(np.append(p[1:] != p[:-1], True)) if len(p) else np.empty(0, np.int64)
    tp, rows = np.cumsum(y)[last], last + 1.0
    if not len(last) or not 0 < tp[-1] < rows[-1]:
        return 0.0
    return float((np.diff(tp, prepend=0) * tp / rows).sum() / tp[-1])


def _grown(features: list[str], cuts: list[np.ndarray], shown: np.ndarray, rounds: int, patience: int):
    """A stream that takes all rows of one model and gives the model as text: the rounds of `fit_many` in one task."""
    n = len(features)

    def sums(x: np.ndarray, g: np.ndarray, h: np.ndarray, tree: Tree, front: list[int], seen: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        held = np.zeros((2, n, len(front), BINS), np.int64)
        place = np.full(len(tree.feature), -1)
        place[front] = np.arange(len(front))
        for a in range(0, len(x), CHUNK):
            b = x[a : a + CHUNK]
            node = place[tree.at(b, tree.bin)]
            there = np.flatnonzero(node >= 0)
            first, gs, hs = node[there] * BINS, g[a : a + CHUNK][there], h[a : a + CHUNK][there]
            for f in seen:
                cell = first + b[there, f]
                add(held[0, f].reshape(-1), cell, gs)
                add(held[1, f].reshape(-1), cell, hs)
        return {node: (held[0, :, i], held[1, :, i]) for i, node in enumerate(front) if held[1, :, i].any()}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy(), _matrix(b, n)) for b in batches if b.num_rows]
        if not parts:
            return
        valid, y, w, key, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        mine, other = np.flatnonzero(~valid), np.flatnonzero(valid)
        # Rows of trees come first, then those that are only looked at; both halves are added up in the order of `_moved`.
        order = np.append(mine, other)
        x, y, w, key, m = x[order], y[order], w[order], key[order], len(mine)
        model = Boosted(list(features))
        written, since, now = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        for r in range(rounds):
            used = shown[chosen_features(len(shown), r)]
            drawn = np.flatnonzero(_uniform(key[:m], SEED + r) < ROWS)
            b, (g, h) = x[drawn], gradients(y[drawn], w[drawn], now[drawn])
            tree = Tree()
            tree.leaf(0.0, 0.0)
            front = [0]
            seen = np.union1d(used, [0])  # a node's total is read from the first feature
            for level in range(DEPTH):
                front = grow(tree, front, sums(b, g, h, tree, front, seen), used, cuts, level == DEPTH - 1)
                if not front:
                    break
            model.trees.append(tree)
            values = np.array(tree.value)
            for a in range(0, len(x), CHUNK):
                step = values[tree.at(x[a : a + CHUNK], tree.bin)]
                since[a : a + CHUNK] += step
                now[a : a + CHUNK] += step
            if len(other):
                model.history.append(precision(1 / (1 + np.exp(-(written[m:] + since[m:]))), y[m:]))
            if (r + 1) % WRITE and r + 1 < rounds:
                continue
            written += since
            now, since = written.copy(), np.zeros(len(x))
            if len(other) and len(model.history) - 1 - int(np.argmax(model.history)) >= patience:
                break
        yield pa.RecordBatch.from_arrays([pa.array([model.text()])], names=["text"])

    return stream


def fit_many(df: DataFrame, features: list[str], label: str = "y", rounds: int = ROUNDS, patience: int = PATIENCE, without: dict[int, list[str]] | None = None) -> dict[int, Boosted]:
    """A model for each value of df.model (int), of the rows where `valid` is false. Where a model has valid rows,
    it keeps the trees up to the best average precision on them; `without` names features that a model isn't
    shown."""
    from tallyweave.operators.models import ranking

    cuts, n = edges(df.where("not valid"), features), len(features)
    rows = cut(_binned(df, features, label, cuts))
    sizes = {m: (a, v) for m, a, v in rows.groupBy("model").agg(F.count("*"), F.count_if("valid")).collect()}
    total = sum(a for a, _ in sizes.values())
    shown = {m: np.array([i for i, f in enumerate(features) if f not in (without or {}).get(m, ())]) for m in sizes}
    if sizes and max(a for a, _ in sizes.values()) <= ALONE * PART:
        grown = lambda m: rows.where(F.col("model") == m).coalesce(1).mapInArrow(_grown(features, cuts, shown[m], rounds, patience), "text string").collect()[0]
        models = {m: Boosted.read(text["text"]) for m, text in zip(sorted(sizes), together(*[lambda m=m: grown(m) for m in sorted(sizes)]), strict=True)}
        for b in models.values():
            if b.history:
                b.trees = b.trees[: int(np.argmax(b.history)) + 1]
        return models
    parts = max(1, -(-total // MOST), min(df.sparkSession.sparkContext.defaultParallelism, -(-total // PART)))
    rows = handed(rows.repartition(parts), looping(df.sparkSession, parts))
    kept = rows.coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
    models = {m: Boosted(list(features)) for m in sorted(sizes)}
    active, since = set(models), {m: 0 for m in models}
    for r in range(rounds):
        used = {m: shown[m][chosen_features(len(shown[m]), r)] for m in active}
        growing = {}
        for m in sorted(active):
            tree = Tree()
            tree.leaf(0.0, 0.0)
            growing[m] = (tree, [0])
        trees = {m: t for m, (t, _) in growing.items()}
        for level in range(DEPTH):
            sums = _sums(kept, {m: models[m].trees[since[m] :] for m in growing}, growing, r, n, parts > FEW)
            growing = {m: (t, front) for m, (t, old) in growing.items() if (front := grow(t, old, sums[m], used[m], cuts, level == DEPTH - 1))}
            if not growing:
                break
        for m, t in trees.items():
            models[m].trees.append(t)
        if (r + 1) % WRITE and r + 1 < rounds:
            continue
        moved = cut(_moved(kept, {m: models[m].trees[since[m] :] for m in active}, n))
        first = {m: since[m] for m in active}
        since = {m: len(b.trees) for m, b in models.items()}
        kept.unpersist()
        kept = moved.drop("seen").coalesce(parts).persist(StorageLevel.MEMORY_AND_DISK)
        if any(sizes[m][1] for m in active):
            seen = moved.where("valid").select("model", "y", F.posexplode("seen").alias("i", "margin")).select("model", "i", "y", (1 / (1 + F.exp(-F.col("margin")))).alias("p"))
            got = {(m, i): ap for m, i, ap in ranking(seen, "p", "y", ("model", "i")).select("model", "i", "ap").collect()}
            for m in sorted(active):
                if sizes[m][1]:
                    models[m].history += [got.get((m, i)) or 0.0 for i in range(len(models[m].trees) - first[m])]
                    best = int(np.argmax(models[m].history))
                    if len(models[m].history) - 1 - best >= patience:
                        active.discard(m)
        if not active:
            break
    kept.unpersist()
    for b in models.values():
        if b.history:
            b.trees = b.trees[: int(np.argmax(b.history)) + 1]
    return models


def fit(train: DataFrame, features: list[str], label: str = "y", rounds: int = ROUNDS, valid: DataFrame | None = None, patience: int = PATIENCE) -> Boosted:
    """One model; with `valid` it stops by that frame's average precision."""
    part = lambda df, v: df.select(F.lit(0).alias("model"), F.lit(v).alias("valid"), F.col(label), *[F.col(f"`{f}`") for f in features])
    both = part(train, False) if valid is None else part(train, False).unionByName(part(valid, True))
    return fit_many(both, features, label, rounds, patience).get(0) or Boosted(list(features))
