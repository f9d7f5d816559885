"""Every query with SQL gives the rows of the independent engine; fixed graphs have their known values."""

import glob

import duckdb
import pytest

from tallyweave.operators import graph
from tallyweave.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {p.split('/')[-1][:-8]} as select * from '{p}'")
    return con


def told(v):
    return f"{v:.7g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, other, name):
    df = catalog.QUERIES[name](spark, DATA)
    r = other.execute(catalog.SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(told(row[columns.index(c)]) for c in sorted(columns)) for row in r.fetchall())
    assert sorted(tuple(told(row[c]) for c in sorted(columns)) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_others_answer(spark, name):
    """Those without SQL give rows, all columns of which have a kind."""
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows and all(kind != "void" for _, kind in df.dtypes)


def ledger(spark, *edges):
    rows = [(a, b, "10.0", 1_700_000_000 + 60 * i) for a, b, n in edges for i in range(n)]
    return spark.createDataFrame(rows, "sender string, receiver string, amount string, t long").selectExpr("sender", "receiver", "cast(amount as decimal(18,4)) as amount", "timestamp_seconds(t) as ts")


CASES = {
    "ring": ([("A", "B", 2), ("B", "C", 2), ("C", "A", 2)], {"A": (1, 0.5, 1), "B": (1, 0.5, 1), "C": (1, 0.5, 1)}),
    "single": ([("A", "B", 1), ("B", "C", 1), ("C", "A", 1)], {"A": (1, 0.5, 0), "B": (1, 0.5, 0), "C": (1, 0.5, 0)}),
    "mutual": ([("A", "B", 2), ("B", "A", 2)], {"A": (1, 0, 0), "B": (1, 0, 0)}),
    "mixed": ([("A", "B", 2), ("B", "A", 2), ("B", "C", 2), ("C", "A", 2)], {"A": (1.192199, 0.5, 1), "B": (1.163369, 0.5, 1), "C": (0.644432, 1, 1)}),
    "chain": ([("A", "B", 3), ("B", "C", 3), ("C", "D", 3)], {"A": (0.464623, 0, 0), "D": (1.48058, 0, 0)}),
    "fed": ([("A", "B", 2), ("B", "C", 2), ("C", "A", 2), ("f1", "A", 1), ("f2", "A", 3)], {"A": (1.660836, 0.083333, 0.666667), "f1": (0.15, 0, 0), "f2": (0.15, 0, 0)}),
    "nine": ([(str(i), str((i + 1) % 9), 2) for i in range(9)], {"0": (1, 0, 0)}),
    "eight": ([(str(i), str((i + 1) % 8), 2) for i in range(8)], {"0": (1, 0, 1)}),
}


@pytest.mark.parametrize("name", CASES)
def test_fixed_graphs(spark, name):
    edges, want = CASES[name]
    e = ledger(spark, *edges)
    rank = {r[0]: r[1] for r in graph.pagerank(e, 300, 1e-10).collect()}
    tri = {r[0]: r[1] for r in graph.clustering(e).collect()}
    cyc = {r[0]: r[1] for r in graph.cycle_participation(e).collect()}
    for node, (p, t, c) in want.items():
        assert (rank[node], tri[node], cyc[node]) == pytest.approx((p, t, c), abs=2e-5)


def test_empty_ledger(spark):
    e = ledger(spark, ("A", "B", 1)).where("sender = 'none'")
    assert graph.local_features(e).count() == 0
    assert graph.cycle_participation(e).count() == 0
    assert graph.window_days(e).first()["scale"] == 1.0


def test_communities_cover_all(spark):
    e = ledger(spark, ("A", "B", 5), ("B", "C", 5), ("C", "A", 5), ("X", "Y", 5), ("Y", "Z", 5), ("Z", "X", 5), ("A", "X", 1))
    part = {r[0]: r[1] for r in graph.communities(graph.undirected(graph.pairs(e))).collect()}
    assert len({part[x] for x in "ABC"}) == 1 and len({part[x] for x in "XYZ"}) == 1 and part["A"] != part["X"]
