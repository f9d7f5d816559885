"""Boosted trees against a plain version, models that grow together, stopping, and saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import models, trees

FEATURES = ["a", "b", "c", "d"]


def made(n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 7, n), rng.exponential(size=n), rng.normal(size=n)])
    p = 1 / (1 + np.exp(-(x[:, 0] * x[:, 1] / 3 - x[:, 2] - 1)))
    return x, (rng.random(n) < p).astype(int)


def frame(spark, n, seed=3):
    x, y = made(n, seed)
    return spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y int")


def plain(x, y, keys, cuts, rounds):
    """Row by row sums, one node after the other; the model's log-odds of each row."""
    b = np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)])
    w, margin = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0), np.zeros(len(x))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint(w * (p - y) * 2**24) / 2**24, np.rint(w * p * (1 - p) * 2**24) / 2**24
        drawn, used, step = trees._uniform(keys, trees.SEED + r) < 0.8, trees.chosen_features(4, r), np.zeros(len(x))

        def grow(rows, depth):
            own = rows[drawn[rows]]
            total, best = (g[own].sum(), h[own].sum()), (0.0, None, None)
            for f in used if depth < 4 else ():
                for cut in range(len(cuts[f])):
                    low = own[b[own, f] <= cut]
                    gl, hl = g[low].sum(), h[low].sum()
                    gr, hr = total[0] - gl, total[1] - hl
                    gain = round(gl**2 / (hl + 2) + gr**2 / (hr + 2) - total[0] ** 2 / (total[1] + 2), 9)
                    if hl >= 5 and hr >= 5 and gain > best[0]:
                        best = (gain, f, cut)
            if best[1] is None:
                step[rows] = -0.05 * total[0] / (total[1] + 2)
                return
            grow(rows[b[rows, best[1]] <= best[2]], depth + 1)
            grow(rows[b[rows, best[1]] > best[2]], depth + 1)

        grow(np.arange(len(x)), 0)
        margin += step
    return margin


def test_equal_to_a_plain_version(spark):
    df = frame(spark, 2000)
    keys = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("y", *FEATURES)).collect()])
    cuts = trees.edges(df, FEATURES)
    x, y = made(2000)
    want = plain(x, y, keys, cuts, 12)
    model = trees.fit(df.repartition(7), FEATURES, rounds=12)
    got = {r.id: (r.margin, r.p) for r in model.scored(df).collect()}
    assert np.allclose([got[i][0] for i in range(2000)], want, atol=1e-6)
    assert np.allclose([got[i][1] for i in range(2000)], 1 / (1 + np.exp(-want)), atol=1e-6)
    assert trees.fit(df.repartition(2), FEATURES, rounds=3).text() == trees.fit(df.coalesce(1), FEATURES, rounds=3).text()
    assert trees.Boosted.read(model.text()).text() == model.text()


def test_models_that_grow_together_and_stop(spark):
    train, valid = frame(spark, 1500), frame(spark, 700, 8)
    alone = trees.fit(train, FEATURES, valid=valid)
    part = lambda df, v: df.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("model"), F.lit(v).alias("valid"), "y", *FEATURES)
    both = trees.fit_many(part(train, False).union(part(valid, True)), FEATURES, without={1: ["a"]})
    assert both[0].text() == alone.text()
    assert all(f != 0 for t in both[1].trees for f in t.feature)
    best = int(np.argmax(alone.history))
    assert len(alone.trees) == best + 1 and best + 30 <= len(alone.history) - 1 < best + 30 + trees.WRITE
    ap = models.ranking(alone.scored(valid)).first().ap
    assert ap == pytest.approx(max(alone.history), abs=1e-9)


def test_edges_of_data(spark):
    df = frame(spark, 60)
    one_class = trees.fit(df.withColumn("y", F.lit(0)), FEATURES, rounds=3)
    assert all(r.p <= 0.5 for r in one_class.scored(df).collect())
    constant = trees.fit(df.withColumns({f: F.lit(1.0) for f in FEATURES}), FEATURES, rounds=2)
    assert all(t.feature == [-1] for t in constant.trees)
    assert trees.fit(df.where("id < 0"), FEATURES, rounds=2).trees == []


def test_folds(spark):
    df = frame(spark, 900).withColumn("ring_id", F.when(F.col("y") == 1, F.col("id") % 12).otherwise(-1))
    r = models.cross_validate(df, FEATURES, 5, rounds=8).collect()
    assert sorted(x.fold for x in r) == [0, 1, 2, 3, 4]
    for x in r:
        assert (x.auc_mean, x.auc_sd) == (pytest.approx(np.mean([y.auc for y in r])), pytest.approx(np.std([y.auc for y in r])))
    assert np.mean([x.auc for x in r]) > 0.7


@pytest.mark.parametrize("few", [16, 1])
def test_rows_in_parts_give_the_same_trees(spark, monkeypatch, few):
    """Parts as small as cores ask for, which see no validation rows, whether their sums are shuffled or not."""
    df = frame(spark, 1200)
    whole = trees.fit(df, FEATURES, rounds=11, valid=frame(spark, 400, 8))
    monkeypatch.setattr(trees, "PART", 200)
    monkeypatch.setattr(trees, "FEW", few, raising=False)
    dealt, sums = [], trees._sums
    monkeypatch.setattr(trees, "_sums", lambda rows, *a: dealt.append((rows.rdd.getNumPartitions(), rows.sparkSession.conf.get("spark.sql.adaptive.enabled"), a[-1])) or sums(rows, *a))
    again = trees.fit(df, FEATURES, rounds=11, valid=frame(spark, 400, 8))
    assert [vars(t) for t in again.trees] == [vars(t) for t in whole.trees] and again.history == pytest.approx(whole.history)
    assert set(dealt) == {(8, "false", few < 8)}  # 1,600 rows
    big = np.zeros(3, np.int64)
    trees.add(big, np.array([1, 1, 2]), np.array([2**60, 1, -5]))
    assert big.tolist() == [0, 2**60 + 1, -5]


def test_a_task_grows_small_models_alone(spark, monkeypatch):
    """The same trees and precisions as by a job for each level, which isn't run."""
    part = lambda n, v, seed: frame(spark, n, seed).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("model"), F.lit(v).alias("valid"), "y", *FEATURES)
    df = part(1200, False, 3).union(part(300, True, 8))
    monkeypatch.setattr(trees, "ALONE", 0, raising=False)
    jobs = trees.fit_many(df, FEATURES, rounds=13, without={1: ["b"]})
    monkeypatch.undo()
    monkeypatch.setattr(trees, "_sums", lambda *a: pytest.fail("a job for a level"))
    alone = trees.fit_many(df.repartition(5), FEATURES, rounds=13, without={1: ["b"]})
    assert [[vars(t) for t in alone[m].trees] for m in (0, 1)] == [[vars(t) for t in jobs[m].trees] for m in (0, 1)]
    assert all(alone[m].history == pytest.approx(jobs[m].history, abs=1e-12) for m in (0, 1))
    assert trees.precision(np.array([0.5, 0.5, 0.2]), np.array([1.0, 0.0, 1.0])) == pytest.approx((1 / 2 + 2 / 3) / 2) and trees.precision(np.ones(2), np.ones(2)) == 0.0
