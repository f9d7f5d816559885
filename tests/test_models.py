"""Models, calibration, bootstrap and streaming: invariants, as no SQL gives their rows."""

import math
import shutil

import pytest

from tallyweave.operators import models
from tallyweave.streaming import ledger as stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, ((i * 7919) % 1000) / 1000.0, i % 40) for i in range(600)]
    return spark.createDataFrame([(i, s, c, float(i % 13), int((s + ((i * 31) % 100) / 100.0) > 1.1)) for i, s, c in rows], "id long, score double, cluster long, other double, y int").cache()


def auc(rows):
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("fit", [models.logistic, models.boosted])
def test_models_rank(frame, fit):
    train, test = frame.where("id % 3 > 0"), frame.where("id % 3 = 0")
    rows = fit(train, ["score", "other"], test).collect()
    # The label's probability rises with the score alone, so no ranking is expected to beat it.
    best = auc([(r.score, r.y) for r in rows])
    assert len(rows) == 200 and auc([(r.p, r.y) for r in rows]) > best - 0.05


def test_platt_is_a_stationary_point(frame):
    a, b = models.platt(frame)
    rows = frame.collect()
    pos = sum(r.y for r in rows)
    neg = len(rows) - pos
    gradient = 0.0
    for r in rows:
        p = min(max(r.score, 1e-6), 1 - 1e-6)
        x = math.log(p / (1 - p))
        gradient += 1 / (1 + math.exp(-(a * x + b))) - ((pos + 1) / (pos + 2) if r.y else 1 / (neg + 2))
    assert a > 0 and abs(gradient) < 1e-4
    with pytest.raises(ValueError, match="both classes"):
        models.platt(frame.where("y = 1"))


def test_bootstrap_brackets_the_auc(frame):
    got = sorted(r.auc for r in models.bootstrap_auc(frame, 40).collect())
    assert len(got) == 40 and got[0] < auc([(r.score, r.y) for r in frame.collect()]) < got[-1]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{DATA}/events.parquet", tmp_path / "in/a.parquet")
    shutil.copy(f"{DATA}/events.parquet", tmp_path / "in/b.parquet")
    got = []
    s = stream.without_replays(stream.event_stream(spark, str(tmp_path / "in")), ["event_id"], "100 days")
    q = stream.score_batches(s, lambda df: df.withColumn("high", df.value > 50), lambda df, k: got.append(df.count()), str(tmp_path / "state"))
    q.awaitTermination()
    assert sum(got) == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_only_splits_that_a_query_reads_are_made(spark, monkeypatch):
    from tallyweave.plans import labelled, training

    asked = []
    monkeypatch.setattr(labelled, "_tables", {})
    monkeypatch.setattr(labelled, "edges", lambda *a: None)
    names = ", ".join(f"{f} double" for f in training.FEATURES)
    empty = spark.createDataFrame([], f"node string, ring_id int, ring_type string, {training.contract.TARGET} int, split string, {names}")
    monkeypatch.setattr(training.labels, "process", lambda e, split: asked.append(split) or empty)
    monkeypatch.setattr(training.models, "logistic", lambda train, features, test, log1p: test.withColumn("p", training.F.lit(0.5)))
    assert training.ml_logreg(spark, "none").columns == ["id", "y", "p"] and sorted(asked) == ["test", "train"]
    assert sorted(training.frames(spark, "none")) == ["test", "train", "val"] and sorted(asked) == ["test", "train", "val"]


def test_the_leakage_gate_sees_features_of_the_graph(spark, monkeypatch):
    from tallyweave.functions import contract
    from tallyweave.plans import labelled

    names = ", ".join(f"{f} double" for f in contract.FEATURES)
    rows = [(*[float(i % 2) if f == "cycle_participation" else float(i * 7 % 5) for f in contract.FEATURES], i % 2) for i in range(40)]
    monkeypatch.setattr(labelled, "feature_table", lambda *a: spark.createDataFrame(rows, f"{names}, {contract.TARGET} int"))
    monkeypatch.setattr(labelled, "_ran", lambda *a: labelled.policies.running(labelled.policies.numbered(labelled.feature_table().withColumnRenamed(contract.TARGET, "y"), labelled.LOCAL), ["feature"]))
    r = labelled.q_leakage_gate(spark, "none").first()
    assert (r.feature, r.strongest, r.passes) == ("cycle_participation", 1.0, False)
