"""Operators that hold no group or order whole: scans, quantiles, bootstrap, cycles; against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyweave.operators import graph, models, scan, selection


def test_scan(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0.0, 1.5, 2.0, -1.0]) if i % 3 else rng.random(), rng.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, n long")
    want, total = {}, 0
    for k, (i, _, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += n
        want[i] = (total, k)
    order = [F.desc("x"), F.col("id")]
    got = {r.id: (r.upto, r.k) for r in scan.running(df, order, {"upto": F.col("n")}, "k").collect()}
    assert got == want
    by = sorted(rows, key=lambda r: (-r[1], r[0]))
    for ahead in (True, False):
        near = {r.id: r.v for r in scan.neighbour(df, order, F.col("n"), "v", ahead).collect()}
        assert near == {by[k][0]: (by[k + 1][2] if k + 1 < len(by) else None) if ahead else (by[k - 1][2] if k else None) for k in range(len(by))}
    for few in (df.where("id < 0"), df.where("id = 7")):
        assert scan.running(few, order, place="k").count() == scan.neighbour(few, order, F.col("n"), "v", True).count() == few.count()


def test_no_window_over_all_rows(spark, capsys):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    scan.running(df, [F.col("x"), F.col("id")], place="k").explain()
    plan = capsys.readouterr().out
    for window in [x for x in plan.split("\n") if "Window [" in x]:
        assert "_range" in window


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    groups = {
        "ties": [1.0] * 500 + [2.0] * 499 + [-3.0], "wide": (rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400)).tolist(), "one": [4.25], "two": [-0.0, 0.0],
        "close": [1.0 + k * 2.0**-52 for k in range(300)], "signs": rng.normal(size=1001).tolist(), None: [5.0, 7.0],
    }
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("ties", None), ("none", None)], "g string, x double")
    shares = {"q0": 0.0, "q1": 0.01, "q50": 0.5, "q90": 0.9, "q1000": 1.0}
    got = {r.g: r for r in selection.quantiles(df, ["g"], "x", shares).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        for name, p in shares.items():
            a, at = sorted(xs), (len(xs) - 1) * p
            low, high = a[int(np.floor(at))], a[int(np.ceil(at))]
            assert got[g][name] == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12, abs=0)


def test_bootstrap_is_that_of_copied_rows(spark):
    """Each row copied once for each round, drawn by the hash of cluster, round and seed."""
    df = spark.createDataFrame([(f"c{i % 37}", float((i * 7919) % 50), int((i * 31) % 7 > 4)) for i in range(400)], "cluster string, score double, y int")
    u = (F.pmod(F.xxhash64("cluster", "round", F.lit(7)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cdf = np.cumsum([np.exp(-1.0) / np.prod(range(1, k + 1)) for k in range(8)])
    drawn = df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn("m", sum((F.when(u > float(x), 1).otherwise(0) for x in cdf), F.lit(0)))
    s = drawn.groupBy("round", "score").agg(F.sum(F.col("m") * F.col("y")).alias("p"), F.sum(F.col("m") * (1 - F.col("y"))).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("round").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = {r["round"]: r.auc for r in s.withColumn("won", F.col("p") * (below + F.col("n") / 2)).groupBy("round").agg((F.sum("won") / (F.sum("p") * F.sum("n"))).alias("auc")).collect()}
    got = {r["round"]: r.auc for r in models.bootstrap_auc(df, 60).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def closing(edges):
    """Edges u->v with a way back of 2 to 7 hops that isn't the hop v->u, by breadth-first search."""
    out = defaultdict(set)
    for u, v in edges:
        out[u].add(v)
    found = set()
    for u, v in edges:
        front, seen = {x for x in out[v] if x not in (u, v)}, {v}
        for _ in range(6):
            seen |= front
            reached = {y for x in front for y in out[x]}
            if u in reached:
                found.add((u, v))
                break
            front = reached - seen
    return found


@pytest.mark.parametrize("n, m, seed", [(9, 20, 1), (14, 26, 2), (40, 60, 3), (60, 75, 4), (25, 120, 5), (12, 40, 6)])
def test_closing_edges(spark, n, m, seed):
    rng = random.Random(seed)
    edges = sorted({(str(a), str(b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})
    core = graph.core(spark.createDataFrame(edges, "sender string, receiver string"))
    inside = [tuple(r) for r in core.collect()]
    got = [tuple(r) for r in graph.closing_edges(core).collect()] if inside else []
    assert len(got) == len(set(got)) and set(got) == closing(inside) == closing(edges)


def numpy_pagerank(edges):
    names = sorted({x for e in edges for x in e[:2]})
    at, n = {x: i for i, x in enumerate(names)}, len(names)
    w = np.zeros((n, n))
    for a, b, k in edges:
        w[at[a], at[b]] += k
    out = w.sum(1)
    p, r = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0), np.ones(n)
    for _ in range(600):
        r = 0.15 + 0.85 * (r @ p + r[out == 0].sum() / n)
    return dict(zip(names, r, strict=True))


@pytest.mark.parametrize("n, m, seed", [(3, 3, 1), (30, 60, 2), (80, 700, 3), (12, 11, 4)])
def test_converged_pagerank(spark, monkeypatch, n, m, seed):
    monkeypatch.setattr(graph, "CHUNK", 4)
    rng = random.Random(seed)
    edges = [(str(rng.randrange(n)), str(rng.choice([0, rng.randrange(n)])), rng.randint(1, 3)) for _ in range(m)]
    ledger = spark.createDataFrame([(a, b) for a, b, k in edges for _ in range(k)], "sender string, receiver string").selectExpr("sender", "receiver", "cast(1 as decimal(18,4)) as amount", "timestamp_seconds(0) as ts")
    want, got = numpy_pagerank(edges), {r.node: r.pagerank for r in graph.converged_pagerank(ledger, 1e-7).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_communities_are_connected(spark):
    rng = random.Random(9)
    u = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", 1.0) for a, b in {tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)}], "a string, b string, weight double")
    split = spark.createDataFrame([("00", "x"), ("01", "x"), ("02", "y"), ("03", "y"), ("04", "y")], "node string, community string")
    links = spark.createDataFrame([("00", "02", 1.0), ("03", "04", 1.0), ("01", "02", 1.0)], "a string, b string, weight double")
    assert {r.node: r.community for r in graph.connected(links, split).collect()} == {"00": "00", "01": "01", "02": "02", "03": "03", "04": "03"}
    part = {r.node: r.community for r in graph.communities(u).collect()}
    edges = [(r.a, r.b) for r in u.collect()]
    assert set(part) == {x for e in edges for x in e}
    for name in set(part.values()):
        inside, reached, front = {x for x, c in part.items() if c == name}, {name}, {name}
        while front:
            front = {y for a, b in edges for x, y in ((a, b), (b, a)) if x in front and y in inside} - reached
            reached |= front
        assert name == min(inside) and reached == inside


def test_moves_are_the_same_however_links_are_dealt(spark, monkeypatch):
    rng = random.Random(5)
    links = [(f"{a:02d}", f"{b:02d}", 1.0) for a, b in {tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)}]
    both = graph.cut(spark.createDataFrame([t for a, b, w in links for t in ((a, b, w), (b, a, w))], "x string, y string, w double"))
    none = spark.createDataFrame([], "node string, w double")
    part, moved = graph._local_moves(both, none, 2.0 * len(links), 8)
    assert moved and part.count() == 40
    monkeypatch.setattr(graph, "PART", 60)  # the same moves when links are dealt out
    assert graph._local_moves(both, none, 2.0 * len(links), 8)[0].exceptAll(part).isEmpty()


def test_together_runs_at_the_same_time():
    from threading import Barrier

    from tallyweave.work import together

    meet = Barrier(3, timeout=30)
    assert sorted(together(*[meet.wait] * 3)) == [0, 1, 2]


def plain_moves(links, total, rounds, half):
    """Local moving of all accounts of a half against the state before the round, one account after the other."""
    names = sorted({x for x, _, _ in links})
    k, part = defaultdict(float), {x: x for x in names}
    for x, _, w in links:
        k[x] += w
    for r in range(rounds):
        tot, new = defaultdict(float), dict(part)
        for x in names:
            tot[part[x]] += k[x]
        for x in (x for x in names if half[x] == r % 2):
            kin = defaultdict(float)
            for a, b, w in links:
                if a == x:
                    kin[part[b]] += w
            gain = lambda c: round(kin.get(c, 0.0) - k[x] * (tot[c] - (k[x] if c == part[x] else 0.0)) / total, 9)  # noqa: E731, B023
            best = min(kin, key=lambda c: (-gain(c), c != part[x], c))
            if gain(best) > gain(part[x]) and (best < part[x] if r // 2 % 2 == 0 else best > part[x]):
                new[x] = best
        part = new
    return part


def test_moves_are_those_of_a_plain_version_without_joins_of_links(spark, monkeypatch):
    rng = random.Random(11)
    links = [t for a, b in {tuple(sorted(rng.sample(range(45), 2))) for _ in range(140)} for w in (float(rng.randint(1, 4)),) for t in ((f"{a:02d}", f"{b:02d}", w), (f"{b:02d}", f"{a:02d}", w))]
    both, none, total = spark.createDataFrame(links, "x string, y string, w double"), spark.createDataFrame([], "node string, w double"), sum(w for _, _, w in links)
    half = {r.x: r.h for r in both.select("x", F.pmod(F.xxhash64("x"), F.lit(2)).alias("h")).distinct().collect()}
    monkeypatch.setattr(graph, "CHUNK", 2)  # an account's links in several rows
    rounds, written = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or written(df))
    part, moved = graph._local_moves(both, none, total, 7)
    assert moved and {r.node: r.community for r in part.collect()} == plain_moves(links, total, 7, half)
    assert rounds[-7:] == [2] * 7  # with the community's strength, and with the rows of links; nothing after these are dealt


def test_local_features_of_heavy_accounts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(str(rng.choice([0, rng.randrange(1, 9)])), str(rng.randrange(10, 14)), f"{rng.randint(1, 9999)}.{rng.randint(0, 9999):04d}", 1_700_000_000 + rng.randrange(400_000)) for _ in range(120)]
    ledger = spark.createDataFrame(rows, "sender string, receiver string, amount string, t long").selectExpr("sender", "receiver", "cast(amount as decimal(18,4)) as amount", "timestamp_seconds(t) as ts")
    told = lambda: {r[0]: tuple(pytest.approx(v, rel=1e-12) for v in r[1:]) for r in graph.local_features(ledger).collect()}
    whole = {r[0]: tuple(r[1:]) for r in graph.local_features(ledger).collect()}
    for most in (0, 12, 30):
        monkeypatch.setattr(graph, "HEAVY", most)
        assert whole == told()


@pytest.mark.parametrize("chunk", [3, 1024])
def test_clustering_sorts_no_lists(spark, monkeypatch, capsys, chunk):
    """Directed clustering by the adjacency matrix; edges that bring lists of neighbours along aren't sorted."""
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(12)
    edges = sorted({(str(rng.randrange(25)), str(rng.choice([0, 1, rng.randrange(25)]))) for _ in range(170)} - {("0", "0")})
    ledger = spark.createDataFrame(edges, "sender string, receiver string").selectExpr("sender", "receiver", "cast(1 as decimal(18,4)) as amount", "timestamp_seconds(0) as ts").where("sender <> receiver")
    names = sorted({x for e in edges if e[0] != e[1] for x in e})
    a = np.zeros((len(names), len(names)))
    for x, y in edges:
        if x != y:
            a[names.index(x), names.index(y)] = 1
    s = a + a.T
    t, d, b = np.diag(s @ s @ s), s.sum(1), (a * a.T).sum(1)
    possible = 2 * (d * (d - 1) - 2 * b)
    made = graph.clustering(ledger)
    got = {r[0]: r[1] for r in made.collect()}
    assert got == pytest.approx({x: t[i] / possible[i] if possible[i] > 0 else 0.0 for i, x in enumerate(names)})
    made.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[1]
    assert "ShuffledHashJoin" in plan and plan.count("SortMergeJoin") <= 2  # by v, and accounts with their sums


def test_rounds_of_moves_deal_numbers(spark, monkeypatch):
    """Names are numbered in their order, with their half as the last bit; rounds have no names and aren't planned again."""
    names = ["b", "a", "é", "10", "9"]
    numbers = {r.node: r.i for r in graph._numbers(spark.createDataFrame([(x,) for x in names], "node string")).collect()}
    assert sorted(names, key=numbers.get) == ["10", "9", "a", "b", "é"] and len(set(numbers.values())) == 5
    half = {r.node: r.h for r in spark.createDataFrame([(x,) for x in names], "node string").select("node", F.pmod(F.xxhash64("node"), F.lit(2)).alias("h")).collect()}
    assert all(i % 2 == half[x] for x, i in numbers.items())
    seen, written = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: seen.append((dict(df.dtypes), df.sparkSession.conf.get("spark.sql.adaptive.enabled"))) or written(df))
    u = spark.createDataFrame([("b", "a", 1.0), ("a", "é", 2.0), ("10", "9", 1.0)], "a string, b string, weight double")
    assert {r.node: r.community for r in graph.communities(u, 1, 1).collect()} == {r.node: r.community for r in graph.communities(u, 1, 1).collect()}
    rounds = [s for s in seen if "moved" in s[0]]
    assert rounds and all(t["node"] == t["community"] == "bigint" and adaptive == "false" for t, adaptive in rounds)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


@pytest.mark.parametrize("kind", ["random", "chain", "weights"])
def test_communities_of_one_task(spark, monkeypatch, kind):
    """The same communities as by rounds of jobs, which aren't run."""
    rng = random.Random(21)
    n = 50
    ends = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(120)} if kind != "chain" else {(i, i + 1) for i in range(n)}
    u = spark.createDataFrame([(f"{a:02d}", f"{b:02d}", float(rng.randint(1, 6)) if kind == "weights" else 1.0) for a, b in sorted(ends)] + [("00", "00", 2.0)], "a string, b string, weight double")
    want = graph.communities(u)
    monkeypatch.setattr(graph, "communities", lambda *a: pytest.fail("rounds of jobs"))
    monkeypatch.setattr(graph.arrays, "CHUNK", 16)
    got = graph.partitioned(u.repartition(3))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_pagerank_of_one_task(spark, monkeypatch):
    rng = random.Random(22)
    rows = [(str(rng.randrange(40)), str(rng.choice([0, rng.randrange(30, 70)]))) for _ in range(300)]
    ledger = spark.createDataFrame(rows, "sender string, receiver string").selectExpr("sender", "receiver", "cast(1 as decimal(18,4)) as amount", "timestamp_seconds(0) as ts")
    runs = (lambda: graph.pagerank(ledger, 9), lambda: graph.pagerank(ledger, 40, 1e-4, False), lambda: graph.converged_pagerank(ledger, 1e-8))
    held = [{r.node: r.pagerank for r in run().collect()} for run in runs]
    monkeypatch.setattr(graph, "ALONE", 0)
    for one, run in zip(held, runs, strict=True):
        assert one == pytest.approx({r.node: r.pagerank for r in run().collect()}, abs=1e-7) and one
