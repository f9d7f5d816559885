"""Partition extension, cycles, Shapley values, cross-validation, the generator and batch scoring against
plain versions and invariants."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyweave.operators import attribution, graph, models, partition, serving
from tallyweave.sources import generator


def plain_extend(edges, start):
    near, done = {}, dict(start)
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    left = sorted(n for n in near if n not in done)
    while True:
        before = len(left)
        for n in left:
            known = [(-w, m) for m, w in near[n].items() if m in done]
            if known:
                done[n] = done[min(known)[1]]
        left = [n for n in left if n not in done]
        if len(left) == before:
            break
    fresh = max(start.values(), default=-1) + 1
    for n in left:
        if n not in done:
            front = [n]
            while front:
                m = front.pop()
                done[m] = fresh
                front += [x for x in near[m] if x not in done]
            fresh += 1
    return done


@pytest.mark.parametrize("seed", range(3))
def test_extend(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample("abcdefghijklmnopqrst", 2))): rng.randint(1, 3) for _ in range(16)}
    edges = [(a, b, w) for (a, b), w in pairs.items()]
    start = {n: rng.randint(0, 2) for n in "adgp"} if seed else {}
    frozen = spark.createDataFrame(list(start.items()), "node string, community int")
    got = partition.extend(spark.createDataFrame(edges, "a string, b string, weight int"), frozen)
    assert {r.node: r.community for r in got.collect()} == plain_extend(edges, start)


def test_fingerprint(spark):
    rows = [("b", 7), ("a", 3), ("c", 7), ("d", 1)]
    one = partition.fingerprint(spark.createDataFrame(rows, "node string, community int")).first()[0]
    two = partition.fingerprint(spark.createDataFrame([(n, -c) for n, c in rows], "node string, community int")).first()[0]
    assert one == two == hashlib.sha256(b"a:0;b:1;c:1;d:2").hexdigest()[:12] + "/3c/4n"
    assert partition.fingerprint(spark.createDataFrame([], "node string, community int")).first()[0] == hashlib.sha256(b"").hexdigest()[:12] + "/0c/0n"


def test_cycles(spark):
    rng = random.Random(1)
    nodes = "ABCDEFG"
    pairs = sorted({tuple(rng.sample(nodes, 2)) for _ in range(16)})
    rows = [(a, b, "1.0", i) for i, (a, b) in enumerate(pairs * 2)]
    e = spark.createDataFrame(rows, "sender string, receiver string, a string, t long").selectExpr("sender", "receiver", "cast(a as decimal(18,4)) as amount", "timestamp_seconds(t) as ts")
    want = sorted(p for n in range(3, 8) for p in itertools.permutations(nodes, n) if p[0] == min(p) and all(x in pairs for x in zip(p, (*p[1:], p[0]))))
    assert [r.cycle for r in partition.cycles(e, 1000).collect()] == [">".join(p) for p in want] and want
    shown = partition.cycles(e, 2).collect()
    assert [r.cycle for r in shown] == [">".join(p) for p in want[:2]] and all(r.truncated for r in shown)


def test_shapley(spark):
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, c, int(a + b * c > 0.8)) for i, a, b, c in rows], "id long, a double, b double, c double, y int")
    names = ["a", "b", "c"]
    model = models.fit_boosted(df, names, rounds=5)
    scored = models.apply(model, df, names)
    out = attribution.contributions(scored.select("id", *names, "p"), model, names).cache()
    assert attribution.margin_gap(out) < attribution.TOLERANCE
    held = attribution.leaves(model)

    def game(x, known):  # the expected log-odds if only these features are known
        return sum(v * math.prod((low < x[f] <= high) if f in known else share for f, low, high, share in path) for v, path in held)

    for r in out.limit(5).collect():
        x = [r.a, r.b, r.c]
        for j in range(3):
            others = [k for k in range(3) if k != j]
            want = sum(math.factorial(n) * math.factorial(2 - n) / 6 * (game(x, {*s, j}) - game(x, set(s))) for n in range(3) for s in itertools.combinations(others, n))
            assert r.contributions[j] == pytest.approx(want, abs=1e-9)
    assert sum(r.share for r in attribution.mean_absolute(out, names).collect()) == pytest.approx(1)
    for r in out.select("contributions", attribution.top_factors(names).alias("f")).collect():
        c = dict(zip(names, r.contributions))
        assert [x.feature for x in r.f] == sorted((n for n in names if c[n] > 0), key=lambda n: -c[n]) + sorted((n for n in names if c[n] <= 0), key=lambda n: c[n])


def test_shapley_of_a_repeated_feature():
    held = [(2.0, [(0, -np.inf, 1.0, 0.25)]), (5.0, [(0, 1.0, np.inf, 0.75)])]
    assert attribution.shapley(np.array([[0.5]]), held)[0] == pytest.approx([2 - 4.25, 4.25])


def test_ranking_and_folds(spark):
    rng = random.Random(5)
    rows = [(i, round(rng.random(), 2), rng.randint(0, 1), i % 9 if i % 3 == 0 else -1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, p double, y int, ring_id int")
    got = models.ranking(df).first()
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    assert got.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    cuts = [(sum(x >= t for x in pos), sum(x >= t for x in neg)) for t in sorted({r[1] for r in rows}, reverse=True)]
    last, ap = 0, 0.0
    for tp, fp in cuts:
        ap, last = ap + (tp - last) / len(pos) * tp / (tp + fp), tp
    assert got.ap == pytest.approx(ap)
    assert models.ranking(df.where("y = 1")).first().auc is None
    f = models.folds(df, 4)
    assert f.count() == 400 and f.where("ring_id >= 0").groupBy("ring_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    cv = models.cross_validate(df.select("id", (F.col("p") + F.col("y")).alias("x"), "y", "ring_id"), ["x"], 3, rounds=5).collect()
    assert len(cv) == 3 and all(r.auc > 0.8 for r in cv)


@pytest.fixture(scope="module")
def made(spark):
    return generator.ledger(spark, 3000, 7).cache()


def test_generator(spark, made):
    t = made.groupBy("split").agg(F.count_if(F.col("edge_role").startswith("organic")).alias("organic"), F.count_distinct(F.when(F.col("ring_id") >= 0, F.col("ring_type"))).alias("types"), F.count_distinct(F.when(F.col("ring_id") >= 0, F.col("ring_id"))).alias("rings"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).orderBy("lo").collect()
    assert [r.split for r in t] == list(generator.SPLITS) and [r.rings for r in t] == [40, 24, 24] and all(r.types == 3 for r in t)
    assert all(a.hi < b.lo for a, b in zip(t, t[1:]))
    volume = [r.organic for r in t]
    assert (max(volume) - min(volume)) / (sum(volume) / 3) <= 0.10 and min(volume) > 20_000
    assert made.where("sender = receiver or amount <= 0 or sender is null or receiver is null").isEmpty()
    seats = made.where("edge_role = 'ring'").select("split", F.explode(F.array("sender", "receiver")).alias("node")).distinct()
    assert seats.groupBy("node").count().where("count > 1").isEmpty()
    later = made.where("split = 'test'").select(F.explode(F.array("sender", "receiver")).alias("node")).distinct()
    assert seats.where("split = 'train'").join(later, "node").isEmpty()
    again = generator.ledger(spark, 3000, 7).repartition(3)
    assert again.exceptAll(made).isEmpty() and again.count() == made.count()
    assert len({r.edge_role for r in made.select("edge_role").distinct().collect()}) >= 13


def test_nice(spark):
    rows = spark.createDataFrame([(3.0,), (44.0,), (1_030.0,), (14_983.41,)], "a double").select(generator.nice(F.col("a")).alias("n")).collect()
    assert [r.n for r in rows] == [10.0, 40.0, 1_050.0, 15_000.0]
    assert sorted(s.name for s in generator.allocate(40)).count("fast_cycle") == 14 and len(generator.allocate(24)) == 24


def test_tiers(spark):
    table = {0.05: "LOW", 0.069767: "MEDIUM", 0.2: "MEDIUM", 0.35: "MEDIUM", 0.5: "HIGH", 0.85: "CRITICAL", 0.99: "CRITICAL"}
    level = serving.tier(F.col("s"), 0.5, 15 / 215)
    df = spark.createDataFrame([(s,) for s in table], "s double").select(F.col("s").alias("risk_score"), level.alias("risk_level"), serving.action(level).alias("action"))
    assert {r.risk_score: r.risk_level for r in df.collect()} == table
    assert serving.mismatches(df, 0.5, 15 / 215).isEmpty()
    assert serving.mismatches(df.withColumn("action", F.lit("BLOCK")), 0.5, 15 / 215).count() == len(table)
    with pytest.raises(PySparkException, match="outside"):
        spark.createDataFrame([(1.5,)], "s double").select(level).collect()
    with pytest.raises(ValueError, match="between"):
        serving.tier(F.col("s"), 0.0, 0.1)


def test_batch(spark, made):
    context = made.where("split = 'val'").selectExpr("sender", "receiver", "cast(amount as decimal(18,4)) as amount", "timestamp as ts").where("sender like '%1'").cache()
    replay = context.orderBy("ts", "sender", "receiver", "amount").limit(3)
    end = context.agg(F.max("ts")).first()[0]
    new = spark.createDataFrame([("NEW_A", "NEW_C", "1.0"), ("NEW_B", "NEW_D", "2.0"), ("NEW_A", "NEW_A", "2.0"), (None, "NEW_D", "2.0"), ("NEW_A", "NEW_D", None), ("NEW_A", "NEW_D", "-1")], "sender string, receiver string, amount string").select("sender", "receiver", F.col("amount").cast("decimal(18,4)").alias("amount"), F.lit(end).alias("ts"))
    batch = replay.unionByName(new)
    assert sorted(str(r.reason) for r in serving.reasons(batch).collect()) == ["None"] * 5 + ["amount", "amount", "self", "sender"]
    good = serving.reasons(batch).where("reason is null")
    note = serving.diagnostics(serving.merge(good, context, 60.0), context, 60.0).first()
    assert (note.n_context, note.n_submitted, note.n_late, note.n_early) == (context.count(), 5, 0, 0) and note.comparable
    assert note.n_dropped == 3 + context.count() - context.distinct().count()
    names = ["in_degree", "out_degree", "fan_in_concentration", "community_internal_ratio"]
    frozen = graph.nodes(context).select("node", F.pmod(F.xxhash64("node"), F.lit(5)).cast("int").alias("community"))
    table = graph.features(context, frozen).na.fill(0.0).withColumn("y", (F.col("out_degree") > 3).cast("int")).cache()
    model = models.fit_boosted(table, names, rounds=3)
    out = serving.score_batch(batch, context, frozen, model, names, 0.5, 15 / 215).cache()
    asked = {r.node for r in graph.nodes(good).collect()}
    rows = out.collect()
    assert {r.node for r in rows} == asked and all(len(r.contributing_factors) == 3 for r in rows)
    assert {r.node for r in rows if not r.seen_in_context} == {"NEW_A", "NEW_B", "NEW_C", "NEW_D"}
    assert serving.mismatches(out, 0.5, 15 / 215).isEmpty()


def test_rows_say_why_factors_are_withheld(spark, monkeypatch):
    t = 1_700_000_000
    pay = lambda rows: spark.createDataFrame(rows, "sender string, receiver string, t long").selectExpr("sender", "receiver", "cast(5 as decimal(18,4)) as amount", "timestamp_seconds(t) as ts")
    context = pay([(f"acc{i % 7}", f"acc{(i * 3 + 1) % 8}", t + 9_000 * i) for i in range(60) if i % 7 != (i * 3 + 1) % 8])
    batch = pay([("acc1", "acc9", t + 500_000), ("acc9", "acc2", t + 510_000)])
    frozen = graph.nodes(context).select("node", F.lit(0).alias("community"))
    names = ["in_degree", "out_degree"]
    table = spark.createDataFrame([(float(i % 5), float(i % 3), int(i % 5 > 2)) for i in range(400)], "in_degree double, out_degree double, y int")
    model = models.fit_boosted(table, names, rounds=2)
    score = lambda: serving.score_batch(batch, context, frozen, model, names, 0.5, 15 / 215).collect()
    rows = score()
    assert len(rows) == 3 and all(r.factors_withheld is None and r.contributing_factors for r in rows)

    def broken(df, m, f):
        raise RuntimeError("no tree")

    holes = lambda df, m, f: attribution.contributions(df, m, f).withColumn("contributions", F.when(F.col("node") != "acc9", F.col("contributions")))
    attributed = serving.attributed
    for explain, why in ((broken, "no tree"), (holes, "1 of 3 rows")):
        monkeypatch.setattr(serving, "attributed", lambda *a: attributed(*a, explain))  # noqa: B023
        assert all(why in r.factors_withheld and r.contributing_factors == [] for r in score())
