"""The feature contract, files, labels, rules and the serving path against plain versions."""

import itertools
import json
import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyweave.functions import contract, scalars
from tallyweave.operators import attribution, graph, labels, models, partition, policies, serving
from tallyweave.sources import files, generator

EDGES = "sender string, receiver string, amount double, timestamp string, is_mule int, edge_role string, ring_id int, ring_type string, split string, pos long"


@pytest.fixture(scope="module")
def edges(spark):
    rng, rows = random.Random(3), []
    for k in range(400):
        a, b = rng.sample("ABCDEFGHIJKLMNOP", 2)
        role, ring, kind = rng.choice([("ring", 1, "fast_cycle"), ("ring", 2, "stealth_cycle"), ("fan_in", 1, "fast_cycle"), *[("organic_oneoff", -1, "organic")] * 9])
        split = ("train", "val", "test")[k % 3]
        rows.append((a, b, rng.randint(1, 9000) / 4, f"2024-0{1 + k % 3}-{1 + k % 27:02d} 0{k % 9}:00:00", int(ring > 0), role, ring + 10 * (k % 3) if ring > 0 else -1, kind, split, k))
    return spark.createDataFrame(rows, EDGES).withColumn("timestamp", F.to_timestamp("timestamp")).cache()


@pytest.fixture(scope="module")
def table(spark, edges):
    part = graph.nodes(edges).select("node", (F.ascii("node") % 3).cast("long").alias("community"))
    return policies.union([labels.process(edges, s, part, rounds=5, tolerance=None) for s in files.SPLITS]).cache()


def test_sigmoid_and_json_safe(spark):
    xs = [-1e4, -710.0, -3.0, 0.0, 2.5, 710.0, 1e4]
    got = [r.s for r in spark.createDataFrame([(x,) for x in xs], "x double").select(scalars.sigmoid(F.col("x")).alias("s")).collect()]
    assert got == pytest.approx([0.0 if x < -700 else 1 / (1 + math.exp(-x)) for x in xs])
    nan, inf = float("nan"), float("inf")
    kind = "struct<a:double,b:array<struct<c:double,d:string>>,m:map<string,double>,n:int>"
    df = spark.createDataFrame([((inf, [(nan, "x"), (1.5, None), None], {"k": -inf, "l": 2.0}, 3),), ((None, None, None, None),)], f"v {kind}")
    safe = [json.loads(r.j) for r in df.select(F.to_json(scalars.json_safe(F.col("v"), df.schema["v"].dataType), {"ignoreNullFields": "false"}).alias("j")).collect()]
    assert safe == [{"a": None, "b": [{"c": None, "d": "x"}, {"c": 1.5, "d": None}, None], "m": {"k": None, "l": 2.0}, "n": 3}, {"a": None, "b": None, "m": None, "n": None}]


def test_times_are_utc(spark):
    texts = {"2024-03-01T12:00:00+05:30": 1709274600, "2024-03-01T12:00:00Z": 1709294400, "2024-03-01 12:00:00": 1709294400, " 2024-03-01T12:00:00-0800 ": 1709323200, "never": None, "": None}
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", F.unix_seconds(scalars.to_utc(F.col("t"))).alias("s"))
    assert {r.t: r.s for r in df.collect()} == texts | {None: None}


def test_contract(spark, table):
    contract.check_names(contract.FEATURES)
    for names in (contract.FEATURES[:-1], (*contract.FEATURES, "is_mule"), (contract.FEATURES[1], contract.FEATURES[0], *contract.FEATURES[2:])):
        with pytest.raises(contract.ContractError):
            contract.check_names(names)
    assert table.columns == list(contract.ORDER) and len(contract.ORDER) == 26
    assert contract.features_only(table, "node").columns == ["node", *contract.FEATURES]
    contract.checked(table)
    for bad in (F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double")):
        with pytest.raises(contract.ContractError, match="burst_ratio"):
            contract.checked(table.withColumn("burst_ratio", F.when(F.col("node") == "A", bad).otherwise(F.col("burst_ratio"))))
    with pytest.raises(contract.ContractError, match="not numeric"):
        contract.checked(table.withColumn("pagerank", F.lit("x")))
    with pytest.raises(contract.ContractError):
        contract.ordered(table.withColumn("more", F.lit(1)))
    assert contract.GRAPH_FEATURES[0] in contract.FEATURES and set(contract.LOG1P) < set(contract.FEATURES) and set(contract.DESCRIPTIONS) == set(contract.FEATURES)


def test_labels(edges, table):
    rows = sorted(edges.collect(), key=lambda r: (r.timestamp, r.pos))
    for split in files.SPLITS:
        first, rings, kinds = {}, {}, {}
        for r in rows:
            if r.split == split and r.edge_role == "ring":
                for n in (r.sender, r.receiver):
                    first.setdefault(n, (r.ring_id, r.ring_type))
                    rings.setdefault(n, set()).add(r.ring_id)
                    kinds.setdefault(n, set()).add(r.ring_type)
        for r in table.where(F.col("split") == split).collect():
            want = first.get(r.node, (-1, "organic"))
            assert (r.is_mule, r.ring_id, r.ring_type) == (int(r.node in first), *want)
            assert r.rings_attributed == "|".join(map(str, sorted(rings.get(r.node, ())))) and r.ring_types_attributed == "|".join(sorted(kinds.get(r.node, ())))
    touched = {n for r in rows if r.is_mule for n in (r.sender, r.receiver)}
    assert {r.node for r in labels.victims(edges).collect()} == touched - {n for r in rows if r.edge_role == "ring" for n in (r.sender, r.receiver)}


def test_files_round_trip(spark, edges, table, tmp_path):
    folder = str(tmp_path)
    files.write_splits(edges, folder)
    files.write_features(table, folder)
    for s in files.SPLITS:
        want = edges.where(F.col("split") == s).drop("pos")
        got = files.read_split(spark, folder, s)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        back = files.read_features(spark, folder, s)
        assert back.columns == list(contract.ORDER) and back.exceptAll(table.where(F.col("split") == s)).isEmpty() and back.count() == table.where(F.col("split") == s).count()
    assert sorted(files.read_all(spark, folder)) == sorted(f"{s}_{k}" for s in files.SPLITS for k in ("edges", "features"))
    assert files.read_context(spark, folder).columns == ["sender", "receiver", "amount", "timestamp"]
    assert files.window_days(spark, folder) > 20
    edges.limit(3).select("sender", "receiver", "amount", "timestamp", "ring_id").write.option("header", True).csv(f"{folder}/leaky/serving_context")
    with pytest.raises(contract.ContractError, match="ring_id"):
        files.read_context(spark, f"{folder}/leaky")
    table.select(*reversed(contract.ORDER)).write.option("header", True).csv(f"{folder}/odd/val_features")
    with pytest.raises(contract.ContractError, match="columns"):
        files.read_features(spark, f"{folder}/odd", "val")


def test_requests(spark):
    pay = {"sender": "abc", "receiver": "def", "amount": 2.5, "timestamp": "2024-03-01T12:00:00+05:30"}
    docs = {
        1: json.dumps({"transactions": [pay, pay | {"timestamp": "soon"}]}), 2: "nothing", 3: json.dumps({"transactions": []}), 4: json.dumps({"transactions": [pay] * 1001}), 5: json.dumps({"transactions": [pay], "threshold_override": 1.0}),
        6: json.dumps({"transactions": [pay], "threshold_override": 0.3}), 7: None, 8: json.dumps({"transactions": [pay] * 1000}),
    }
    rows = files.requests(spark.createDataFrame(list(docs.items()), "request_id long, document string")).collect()
    by = {k: [r for r in rows if r.request_id == k] for k in docs}
    assert {k: v[0].refused for k, v in by.items()} == {1: None, 2: "transactions", 3: "size", 4: "size", 5: "threshold_override", 6: None, 7: "transactions", 8: None}
    assert [len(by[k]) for k in docs] == [2, 1, 1, 1, 1, 1, 1, 1000] and by[1][0].ts.isoformat() == "2024-03-01T06:30:00" and by[1][1].ts is None


def test_metrics_gate(spark, tmp_path):
    good = {"optimal_threshold": 0.12, "model_version": contract.MODEL_VERSION, "cost_config": {"fn_cost": 200000, "fp_cost": 15000}}
    cases = [(good, 0.12), (good | {"optimal_threshold": None}, None), (good | {"optimal_threshold": 0.0}, None), (good | {"optimal_threshold": 1.5}, None), (good | {"model_version": "v1"}, None), ({k: v for k, v in good.items() if k != "model_version"}, 0.12), (good | {"optimal_threshold": True}, None)]
    for i, (doc, want) in enumerate(cases):
        spark.createDataFrame([(json.dumps(doc, indent=1),)], "value string").coalesce(1).write.text(f"{tmp_path}/{i}/metrics.json")
        threshold, source, back = files.load_metrics(spark, f"{tmp_path}/{i}")
        assert (threshold, source) == (want, "metrics.json" if want else "none") and back == doc
    assert files.load_metrics(spark, f"{tmp_path}/none") == (None, "none", {})
    assert files.break_even(good) == pytest.approx(15 / 215) and files.break_even({}) is None and files.break_even({"cost_config": {"break_even_probability": 1.5}}) is None
    with pytest.raises(ValueError, match="threshold"):
        files.resolve_threshold({})


def test_communities(spark):
    rng = random.Random(2)
    rows = [(f"{g}{a}", f"{g}{b}", rng.randint(2, 5)) for g in "wxyz" for a, b in itertools.combinations(range(6), 2)] + [("w0", "x0", 1), ("y0", "z0", 1), ("x1", "y1", 1)]
    u = spark.createDataFrame(rows, "a string, b string, weight int")
    part = graph.communities(u)
    got = {r.node: r.community for r in part.collect()}
    assert len(got) == 24 and len({frozenset(n for n in got if got[n] == c) for c in got.values()}) == 4 and all(got[f"{g}0"] == got[f"{g}{i}"] for g in "wxyz" for i in range(6))
    total, degree = sum(w for *_, w in rows), {}
    for a, b, w in rows:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    want = sum(w for a, b, w in rows if got[a] == got[b]) / total - sum(sum(degree[n] for n in got if got[n] == c) ** 2 for c in set(got.values())) / (2 * total) ** 2
    assert graph.modularity(u, part) == pytest.approx(want)
    # A long chain of pairs needs several levels.
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(120)], "a string, b string, weight int")
    made = graph.communities(chain)
    ones = made.select("node", F.col("node").alias("community"))
    assert made.count() == 121 and graph.modularity(chain, made) > 0.75 > graph.modularity(chain, ones)
    again = graph.communities(chain.repartition(3))
    assert again.exceptAll(made).isEmpty()


def plain_cuts(xs, ys):
    np_, nn = sum(ys), len(ys) - sum(ys)
    out = [(math.nextafter(max(xs), math.inf), 0, 0)]
    for t in sorted(set(xs), reverse=True):
        out.append((t, sum(y for x, y in zip(xs, ys, strict=True) if x >= t), sum(1 - y for x, y in zip(xs, ys, strict=True) if x >= t)))
    return out, np_, nn


@pytest.mark.parametrize("seed", range(4))
def test_policies(spark, seed):
    rng = random.Random(seed)
    n = 900
    values = [rng.choice([0.0, rng.expovariate(1), 1e9 * rng.random(), round(rng.random(), 1)]) for _ in range(n)]
    rows = [(("val", "test")[i % 2], int(rng.random() < (0.6 if v > 0.5 else 0.1)), v, -v if seed % 2 else float(i % 3)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "split string, y int, f double, g double")
    for criterion in ("cost", "f1"):
        got = {(r.feature, r.direction): r for r in policies.rules(frame, ("f", "g"), criterion).collect()}
        assert len(got) == 4
        for (feature, direction), r in got.items():
            sign, at = (1 if direction == "high" else -1), 2 if feature == "f" else 3
            side = lambda s: ([sign * x[at] + 0.0 for x in rows if x[0] == s], [x[1] for x in rows if x[0] == s])  # noqa: B023, E731
            xs, ys = side("val")
            cuts, np_, nn = plain_cuts(xs, ys)
            cost = [(np_ - tp) * 200_000 + fp * 15_000 for _, tp, fp in cuts]
            if criterion == "cost":
                runs, k = [], 0
                while k < len(cuts):
                    end = k
                    while cost[k] == min(cost) and end + 1 < len(cuts) and cost[end + 1] == min(cost):
                        end += 1
                    if cost[k] == min(cost):
                        low = cuts[end + 1][0] if end + 1 < len(cuts) else math.nextafter(cuts[end][0], -math.inf)
                        runs.append((cuts[k][0] - low, cuts[k][0], low))
                    k = end + 1
                _, hi, lo = max(runs, key=lambda x: (x[0], x[1]))
                want = (hi + lo) / 2 if (hi + lo) / 2 > lo else hi
                assert r.val_cost == min(cost)
            else:
                want = max((c for c in cuts if c[1]), key=lambda c: (2.0 * c[1] / (c[1] + c[2] + np_), c[0]))[0]
            assert r.threshold == want
            xt, yt = side("test")
            assert (r.tp, r.fp) == (sum(y for x, y in zip(xt, yt, strict=True) if x >= want), sum(1 - y for x, y in zip(xt, yt, strict=True) if x >= want))
            pos, neg = [x for x, y in zip(xs, ys, strict=True) if y], [x for x, y in zip(xs, ys, strict=True) if not y]
            assert r.screen_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    x = policies.unpivoted(frame, ("f",), "split", "y")
    few = {r.direction: r for r in policies.affordable(policies.sweep(x.where("split = 'val'"), ["direction"]), ["direction"], 100.0).collect()}
    for direction, r in few.items():
        xs, ys = [(v[2] if direction == "high" else -v[2]) + 0.0 for v in rows if v[0] == "val"], [v[1] for v in rows if v[0] == "val"]
        cuts, np_, nn = plain_cuts(xs, ys)
        fits = [t for t, tp, fp in cuts[1:] if (tp + fp) * 1000 <= 100 * (np_ + nn)]
        assert (r.feasible, r.threshold) == (bool(fits), min(fits) if fits else cuts[0][0])
    with pytest.raises(ValueError, match="test"):
        policies.rules(frame, ("f",), screen="test")


def test_rule_text(spark):
    df = spark.createDataFrame([("a", "high", 0.25), ("b", "low", -0.5), ("c", "low", 0.0)], "feature string, direction string, threshold double")
    assert [r[0] for r in df.select(policies.rule_text()).collect()] == ["a >= 0.250000000", "b <= 0.500000000", "c <= 0.000000000"]


def test_actions(spark):
    for name in ("LOCK_ACCOUNT", "block_account", "AUTO_BAN", "REVIEW", ""):
        with pytest.raises(serving.DefenseOnlyError):
            serving.check_actions([name])
    serving.check_actions(serving.PERMITTED)
    made = spark.createDataFrame([("a", 0.9, "CRITICAL", "HOLD_FOR_REVIEW"), ("b", 0.01, "LOW", "ALLOW")], "node string, risk_score double, risk_level string, action string")
    assert serving.validated(made, 0.5, 15 / 215).count() == 2
    for wrong in (made.withColumn("action", F.lit("ALLOW")), made.withColumn("risk_level", F.lit("LOW")), made.withColumn("action", F.lit(None).cast("string"))):
        with pytest.raises(serving.DefenseOnlyError):
            serving.validated(wrong, 0.5, 15 / 215)


def test_attribution_is_withheld(spark, table):
    names = list(contract.FEATURES)
    train = table.withColumn("y", (F.col("in_degree") > 4).cast("int"))
    model = models.fit_boosted(train.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(40)))), names, rounds=3)
    scored = models.apply(model, train.select("node", *names), names).cache()
    good, said = serving.attributed(scored, model, names)
    assert not said and all(len(r.contributing_factors) == 3 and r.contributing_factors[0].description in contract.DESCRIPTIONS.values() for r in good.collect())
    shifted = lambda df, m, f: attribution.contributions(df, m, f).withColumn("contributions", F.transform("contributions", lambda x: x + 0.01))
    turned = lambda df, m, f: attribution.contributions(df, m, f).withColumn("contributions", F.concat(F.slice("contributions", 2, len(f)), F.slice("contributions", 1, 1)))

    def broken(df, m, f):
        raise RuntimeError("no")

    for explain, why in ((shifted, "log-odds"), (turned, "bias"), (broken, "missing")):
        out, said = serving.attributed(scored, model, names, explain)
        assert len(said) == 1 and why in said[0] and all(r.contributing_factors == [] for r in out.collect()) and out.count() == scored.count()
    assert models.margins(model, train, names).where("abs(margin - ln(p / (1 - p))) > 1e-9").isEmpty()
    assert [r.share for r in models.importance(model, train, names).collect()] == sorted((r.share for r in models.importance(model, train, names).collect()), reverse=True)


def test_importance_refuses(spark, table, monkeypatch):
    names = list(contract.FEATURES)
    train = table.withColumn("y", (F.col("in_degree") > 4).cast("int"))
    model = models.fit_boosted(train.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(40)))), names, rounds=2)
    monkeypatch.setattr(attribution, "margin_gap", lambda *_: 0.5)
    with pytest.raises(ValueError, match="log-odds"):
        models.importance(model, train, names)


def test_service(spark, edges, table, tmp_path):
    names = list(contract.FEATURES)
    nothing = serving.start(spark, f"{tmp_path}/none", f"{tmp_path}/none")
    assert not nothing.ready and nothing.health()["status"] == "degraded" and nothing.health()["optimal_threshold"] is None and "context" in nothing.reason
    with pytest.raises(RuntimeError, match="not ready"):
        nothing.score(edges)
    files.write_splits(edges, f"{tmp_path}/data")
    train = table.withColumn("y", (F.col("in_degree") > 4).cast("int"))
    model = models.fit_boosted(train.withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(40)))), names, rounds=2)
    doc = {"optimal_threshold": 0.4, "model_version": contract.MODEL_VERSION, "cost_config": {"fn_cost": 200000.0, "fp_cost": 15000.0}, "odd": [float("nan"), {"x": float("inf")}]}
    files.save_artifacts(spark, f"{tmp_path}/model", model, names, doc)
    assert files.load_metrics(spark, f"{tmp_path}/model")[2]["odd"] == [None, {"x": None}]
    with pytest.raises(contract.ContractError):
        files.save_artifacts(spark, f"{tmp_path}/bad", model, names[::-1], doc)
    s = serving.start(spark, f"{tmp_path}/model", f"{tmp_path}/data")
    h = s.health()
    assert s.ready and h["status"] == "healthy" and h["feature_contract_verified"] and h["context_transactions"] == s.context.count() and h["n_features"] == 18
    assert h["partition_fingerprint"] == partition.fingerprint(s.frozen).first()[0]
    end = s.context.agg(F.max("ts")).first()[0]
    batch = spark.createDataFrame([("new-a", "new-b", "5.0"), ("new-b", "new-c", "6.0"), ("ab", "new-c", "6.0")], "sender string, receiver string, a string").select("sender", "receiver", F.col("a").cast("decimal(18,4)").alias("amount"), F.lit(end).alias("ts"))
    said = []
    rows = s.score(batch, warnings=said).collect()
    assert {r.node for r in rows} == {"new-a", "new-b", "new-c"} and not said and all(r.action in serving.PERMITTED for r in rows)
    # The frozen partition stays as it was for all accounts it knows.
    grown = partition.extend(graph.undirected(graph.pairs(s.context.select("sender", "receiver", "amount", "ts").union(batch))), s.frozen)
    assert s.frozen.exceptAll(grown.select("node", F.col("community").cast(s.frozen.schema["community"].dataType))).isEmpty()


def test_generator_bursts_and_cover(spark):
    e = generator.ledger(spark, 3000, 11).withColumn("t", F.unix_seconds("timestamp")).cache()
    burst, salary = e.where("edge_role = 'organic_burst'"), e.where("edge_role = 'organic_salary'").select(F.col("receiver").alias("who"), F.col("t").alias("paid"))
    assert burst.count() > 500
    after = burst.join(salary, (burst["sender"] == salary["who"]) & (burst["t"] - salary["paid"]).between(600, 8 * 3600)).select("sender", "receiver", "t").distinct()
    assert after.count() == burst.select("sender", "receiver", "t").distinct().count()
    cover = e.where("edge_role = 'organic_camouflage'").cache()
    mule = F.when(F.col("sender").startswith("MULE_"), F.col("sender")).otherwise(F.col("receiver"))
    other = F.when(F.col("sender").startswith("MULE_"), F.col("receiver")).otherwise(F.col("sender"))
    pairs = cover.select(mule.alias("mule"), other.alias("other")).distinct().cache()
    assert cover.where("is_mule <> 0 or ring_id <> -1 or amount < 80 or amount > 4000").isEmpty() and pairs.where("mule not like 'MULE%' or other like 'MULE%'").isEmpty()
    assert pairs.groupBy("other").count().where("count > 1").isEmpty() and pairs.groupBy("mule").count().where("count > 3").isEmpty()
    seats = e.where("edge_role = 'ring'").select(F.explode(F.array("sender", "receiver")).alias("mule")).where("mule like 'MULE%'").distinct()
    assert seats.join(pairs, "mule", "left_anti").isEmpty()
    share = cover.agg(F.avg(F.col("sender").startswith("MULE_").cast("int"))).first()[0]
    assert 0.6 < share < 0.8


def test_short_spans_follow_the_day(spark):
    d = generator.Draw(5)
    start = F.lit(generator.START + 20 * 3600)
    t = spark.range(20_000).select(generator.diurnal_in_span(d, start, F.lit(12 * 3600), F.col("id")).alias("t"))
    assert t.where(f"t < {generator.START + 20 * 3600} or t >= {generator.START + 32 * 3600}").isEmpty()
    got = {r.h: r["count"] / 20_000 for r in t.groupBy(F.floor(F.pmod("t", F.lit(86_400)) / 3600).alias("h")).count().collect()}
    hours = [h % 24 for h in range(20, 32)]
    want = {h: generator.HOURS[h] / sum(generator.HOURS[x] for x in hours) for h in hours}
    assert all(abs(got.get(h, 0) - want[h]) < 0.02 for h in hours)


def test_calibration_leaves_the_order(spark):
    rng = random.Random(4)
    rows = [(rng.random(), k % 2) for k in range(2000)]
    df = spark.createDataFrame([(p, int(rng.random() < p * p), k) for p, k in rows], "score double, y int, k int")
    got = {r.stage: r for r in models.calibration(df.where("k = 0"), df.where("k = 1")).collect()}
    assert got["before"].auc == got["after"].auc and got["after"].ece < got["before"].ece and got["after"].brier < got["before"].brier


def test_cycles_within_a_budget(spark):
    names = [f"n{i}" for i in range(9)]
    rows = [(a, b, "1.0", k) for a, b in itertools.permutations(names, 2) for k in range(2)]
    e = spark.createDataFrame(rows, "sender string, receiver string, a string, t long").selectExpr("sender", "receiver", "cast(a as decimal(18,4)) as amount", "timestamp_seconds(t) as ts")
    shown = partition.cycles(e, 15, budget=400).collect()
    every = sorted(p for n in range(3, 9) for p in itertools.islice(itertools.permutations(names, n), 3000) if p[0] == min(p))
    assert all(r.truncated for r in shown) and [r.cycle for r in shown] == [">".join(p) for p in every[: len(shown)]] and shown


def test_both_directions_of_a_feature_share_their_sums(spark, monkeypatch):
    """What is dealt for the rules is a row for each feature and value, and no key's values are one task's window."""
    rng = random.Random(3)
    rows = [(("val", "test")[i % 2], int(rng.random() < 0.3), rng.random() * 1e6, float(i % 5)) for i in range(400)]
    frame, written, cut = spark.createDataFrame(rows, "split string, y int, f double, g double"), [], policies.scan.cut
    monkeypatch.setattr(policies.scan, "cut", lambda df: written.append(cut(df)) or written[-1])
    assert policies.rules(frame, ("f", "g")).count() == 4
    assert [w.count() for w in written] == [sum(len({x[at] for x in rows if x[0] == "val"}) for at in (2, 3))]
    assert dict(written[0].dtypes)["feature"] == "int" and written[0].select(policies.scan.RANGE).distinct().count() > 1
