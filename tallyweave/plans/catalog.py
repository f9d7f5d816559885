"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import scalars
from tallyweave.operators import graph, labels, models, partition, serving
from tallyweave.plans import evaluation, labelled, labelled_sql, relational, report, training
from tallyweave.sources import generator
from tallyweave.sources import ledger as src
from tallyweave.work import cut


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns if c not in keys])


def top_pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = graph.local_features(src.commerce_ledger(spark, sf_dir)).select("node", "in_degree", "out_degree", "in_amount_sum", "out_amount_sum", F.round("flow_passthrough", 6).alias("flow_passthrough"))
    return f.orderBy(F.desc("flow_passthrough"), "node").limit(20)


LOCAL = ("degree_ratio", "degree_balance", "flow_passthrough", "reciprocity", "fan_in_concentration", "txn_velocity", "burst_ratio", "amount_cv", "counterparty_amount_cv", "repeat_ratio")


COUNTS = ("in_degree", "out_degree", "in_amount_sum", "out_amount_sum")


def _one(feature: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(graph.local_features(src.handoff_ledger(spark, sf_dir)).select("node", feature), "node")

    return run


def _local(frame):
    return lambda spark, d: _rounded(graph.local_features(frame(spark, d)), "node", "in_degree", "out_degree", "in_amount_sum", "out_amount_sum")


_LOCAL_SQL = """
with {n} as ({rel}), e as (select sender as node, receiver as other, 1 as o, amount, ts from {n} union all select receiver, sender, 0, amount, ts from {n}),
w as (select case when d >= 1 then 60.0 / d else 1.0 end as scale from (select (max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000.0 as d from {n})),
p as (select node, other, sum(o) as n_out, sum(1 - o) as n_in, cast(coalesce(sum(amount) filter (o = 0), 0) as double) as s_in, cast(coalesce(sum(amount) filter (o = 1), 0) as double) as s_out, avg(cast(amount as double)) as mean from e group by 1, 2),
c as (select node, count(*) filter (n_in > 0) as in_degree, count(*) filter (n_out > 0) as out_degree, count(*) filter (n_in > 0 and n_out > 0) as mutual, count(*) as others, sum(s_in) as in_sum, sum(s_out) as out_sum, sum(s_in * s_in) as sq, avg(mean) as m, stddev_pop(mean) as sd from p group by 1),
t as (select node, count(*) as n, avg(cast(amount as double)) as mean, stddev_pop(cast(amount as double)) as sdev, (max(epoch_us(ts)) - min(epoch_us(ts))) / 3600000000.0 as hours from e group by 1),
h as (select node, max(k) * 1.0 / sum(k) as burst_ratio from (select node, count(*) as k from e group by node, floor(epoch_us(ts) / 3600000000)) group by 1)
select c.node, in_degree, out_degree, round(out_degree / greatest(in_degree, 1), 6) as degree_ratio, round(case when greatest(in_degree, out_degree) > 0 then least(in_degree, out_degree) / greatest(in_degree, out_degree) else 0.0 end, 6) as degree_balance,
 round(in_sum * scale, 2) as in_amount_sum, round(out_sum * scale, 2) as out_amount_sum, round(case when greatest(in_sum, out_sum) > 0 then least(in_sum, out_sum) / greatest(in_sum, out_sum) else 0.0 end, 6) as flow_passthrough,
 round(mutual / others, 6) as reciprocity, round(case when in_sum > 0 then sq / (in_sum * in_sum) else 1.0 end, 6) as fan_in_concentration, round(case when n >= 2 and hours > 0 then n / hours else 0.0 end, 6) as txn_velocity, round(burst_ratio, 6) as burst_ratio,
 round(case when n >= 2 and mean <> 0 then sdev / mean else 1.0 end, 6) as amount_cv, round(case when others >= 2 and m <> 0 then sd / m else 1.0 end, 6) as counterparty_amount_cv, round(n / others * scale, 6) as repeat_ratio
from c join t using (node) join h using (node) cross join w
"""


def _local_sql(name: str) -> str:
    return _LOCAL_SQL.format(n=name, rel=src.SQL[name])


_P = "p as (select sender as s, receiver as r, count(*) as w from ledger group by 1, 2)"
_CLUSTER_SQL = f"""
with ledger as ({{rel}}), {_P}, m as (select i, j, count(*) as k from (select s as i, r as j from p union all select r, s from p) group by 1, 2),
t as (select a.i, sum(a.k * b.k * c.k) as t from m a join m b on a.j = b.i join m c on b.j = c.i and c.j = a.i where b.j <> a.i group by 1),
d as (select i, sum(k) as dt, count(*) filter (k = 2) as db from m group by 1)
select d.i as node, round(case when t is not null and 2 * (dt * (dt - 1) - 2 * db) > 0 then t / (2 * (dt * (dt - 1) - 2 * db)) else 0.0 end, 6) as clustering_coefficient from d left join t on t.i = d.i
"""


def _rank_sql(rel: str, rounds: int = 20) -> str:
    head = f"with ledger as ({rel}), {_P}, o as (select s, sum(w) as ws from p group by 1), v as (select s as node from p union select r from p), l as (select p.s, p.r, p.w / o.ws as share from p join o on p.s = o.s), n as (select count(*) as n from v), r0 as (select node, 1.0::double as k from v)"
    for i in range(rounds):
        head += f", r{i + 1} as materialized (select v.node, 0.15 + 0.85 * (coalesce(g.k, 0) + coalesce((select sum(k) from r{i} where node not in (select s from o)), 0) / (select n from n)) as k from v left join (select l.r as node, sum(x.k * l.share) as k from l join r{i} x on x.node = l.s group by 1) g on g.node = v.node)"
    return head + f" select node, k as pagerank from r{rounds}"


_PEEL = """peel(d, s, r) as (select 0, s, r from rep union all (with cur as (select * from peel where d = (select max(d) from peel)) select d + 1, s, r from cur where s in (select r from cur) and r in (select s from cur) and d < 12))"""
_CORE = f"with recursive ledger as ({{rel}}), {_P}, rep as (select s, r from p where w >= 2), {_PEEL}, core as (select s, r from peel where d = 12)"
_CYCLE_SQL = _CORE + """,
walk(u, v, x, d) as (select a.s, a.r, b.r, 2 from core a join core b on b.s = a.r where b.r <> a.s and b.r <> a.r union select w.u, w.v, c.r, w.d + 1 from walk w join core c on c.s = w.x where w.x <> w.u and c.r <> w.v and w.d < 8),
cl as (select distinct u, v from walk where x = u), near as (select s as node, r as other from rep union select r, s from rep), hit as (select u as node, v as other from cl union select v, u from cl),
sh as (select near.node, count(hit.other) / count(*) as k from near left join hit on hit.node = near.node and hit.other = near.other group by 1), nodes as (select s as node from p union select r from p)
select nodes.node, round(coalesce(k, 0.0), 6) as cycle_participation from nodes left join sh on sh.node = nodes.node
"""


def g_core_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.core(graph.repeated(src.commerce_ledger(spark, sf_dir)))


def f_community_internal_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = src.commerce_ledger(spark, sf_dir)
    part = graph.nodes(ledger).select("node", (F.col("node").cast("bigint") % 10).alias("community"))
    return _rounded(graph.internal_ratio(graph.undirected(graph.pairs(ledger)), part), "node")


_COMM_SQL = """with ledger as ({rel}), u as (select distinct least(sender, receiver) as a, greatest(sender, receiver) as b from ledger), e as (select cast(a as bigint) % 10 as ca, cast(b as bigint) % 10 as cb from u),
t as (select ca as c, (ca = cb)::int as i from e union all select cb, 0 from e where ca <> cb), r as (select c, sum(i) / count(*) as r from t group by 1), v as (select sender as node from ledger union select receiver from ledger)
select node, round(coalesce(r, 0.0), 6) as community_internal_ratio from v left join r on r.c = cast(node as bigint) % 10"""


def g_bfs_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.repeated(src.handoff_ledger(spark, sf_dir))
    return graph.hops(edges, "1", 3)


_BFS_SQL = f"""with recursive ledger as ({src.SQL['handoff']}), {_P}, e as (select s, r from p where w >= 2), b(node, d) as (select '1', 0 union select e.r, b.d + 1 from b join e on e.s = b.node where b.d < 3)
select node, min(d) as hops from b where node <> '1' group by node"""


def g_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = src.handoff_ledger(spark, sf_dir)
    seeds = graph.nodes(ledger).where("node in ('1', '2', '3')")
    return graph.k_hop(ledger, seeds, 40)


_KHOP_SQL = f"""with ledger as ({src.SQL['handoff']}), s as (select node from (select sender as node from ledger union select receiver from ledger) where node in ('1', '2', '3')),
l as (select node, count(*) as c from (select sender as node, receiver as o from ledger union all select receiver, sender from ledger) where o in (select node from s) and node not in (select node from s) group by 1)
select node, 0 as hop from s union all (select node, 1 from l order by c desc, node limit (select 40 - count(*) from s))"""


def g_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(graph.undirected(graph.pairs(src.handoff_ledger(spark, sf_dir))))


def _communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account with its community and the account of the same community that it is linked with and that is
    nearer to the community's smallest member (that one: itself). Hops fall by one along these, so every community
    is connected."""
    u = cut(graph.undirected(graph.pairs(src.handoff_ledger(spark, sf_dir))))
    part = graph.communities(u)
    both = u.select("a", "b").union(u.select("b", "a"))
    inside = cut(both.join(part.toDF("a", "ca"), "a").join(part.toDF("b", "cb"), "b").where("ca = cb").select("a", "b"))
    front = part.where("node = community").select("node", "community", F.col("node").alias("via"), F.lit(0).alias("hops"))
    seen, k = front, 0
    while not front.isEmpty():
        k += 1
        reached = front.select(F.col("node").alias("a"), "community").join(inside, "a").groupBy(F.col("b").alias("node"), "community").agg(F.min("a").alias("via"))
        front = cut(reached.join(seen.select("node"), "node", "left_anti").select("node", "community", "via", F.lit(k).alias("hops")))
        seen = cut(seen.union(front))
    return part.join(seen.select("node", "via", "hops"), "node", "left").select("node", "community", "via", "hops")


def m_platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope, intercept = models.platt(src.scored_frame(spark, sf_dir).where("split = 'val'"))
    return spark.createDataFrame([(round(slope, 6), round(intercept, 6))], "slope double, intercept double")


def m_platt_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores, calibrated by what is fitted on the validation split."""
    s = src.scored_frame(spark, sf_dir)
    slope, intercept = models.platt(s.where("split = 'val'"))
    return s.select("id", F.round(scalars.calibrated(F.col("score"), slope, intercept), 6).alias("p"))


#: Newton's steps without backtracking, from another start, to the same least loss.
_PLATT_SQL = f"""with recursive s as ({src.SQL['scored']}), c as (select sum(y)::double as np, sum(1 - y)::double as nn from s where split = 'val'),
v as (select ln(q / (1 - q)) as x, case when y = 1 then (np + 1) / (np + 2) else 1 / (nn + 2) end as t from (select greatest(1e-6::double, least(1 - 1e-6::double, score)) as q, y from s where split = 'val') cross join c),
n(k, a, b) as (select 0, 0.0::double, 0.0::double union all select k + 1, a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab)
  from (select k, a, b, sum(e * x) as ga, sum(e) as gb, sum(h * x * x) + 1e-8 as aa, sum(h * x) as ab, sum(h) + 1e-8 as bb from (select k, a, b, x, q - t as e, q * (1 - q) as h
    from (select k, a, b, x, t, 1 / (1 + exp(-(a * x + b))) as q from n cross join v where k < 30)) group by k, a, b)),
f as (select a, b from n where k = 30)"""


def m_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = src.scored_frame(spark, sf_dir).where("split = 'test'")
    cluster = F.when(F.col("ring_id") >= 0, F.concat(F.lit("ring:"), "ring_id")).otherwise(F.concat(F.lit("acct:"), "id"))
    r = models.bootstrap_auc(f.select(cluster.alias("cluster"), "score", "y"), 1000)
    return r.agg(F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"), F.count("*").alias("rounds"))


def _frozen(ledger: DataFrame) -> DataFrame:
    return graph.nodes(ledger).select("node", (F.col("node").cast("bigint") % 10).alias("community"))


def g_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.fingerprint(_frozen(src.handoff_ledger(spark, sf_dir)))


_PRINT_SQL = f"""with ledger as ({src.SQL['handoff']}), p as (select node, cast(node as bigint) % 10 as c from (select sender as node from ledger union select receiver from ledger)), r as (select c, row_number() over (order by min(node)) - 1 as k from p group by c)
select concat(substr(sha256(string_agg(concat(node, ':', k), ';' order by node)), 1, 12), '/', count(distinct c), 'c/', count(*), 'n') as fingerprint from p join r using (c)"""


def g_extend_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the accounts is unknown to the frozen partition."""
    ledger = src.handoff_ledger(spark, sf_dir)
    known = _frozen(ledger).where(F.col("node").cast("bigint") % 3 > 0)
    return partition.extend(graph.undirected(graph.pairs(ledger)), known)


def g_cycles_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.cycles(src.commerce_ledger(spark, sf_dir))


_ENUM_SQL = _CORE + """, cyc(path, tip) as (select [s, r], r from core where s < r union all select list_append(path, c.r), c.r from cyc join core c on c.s = tip where c.r > path[1] and not list_contains(path, c.r) and len(path) < 8),
shown as (select path from cyc join core on core.s = tip and core.r = path[1] where len(path) >= 3 order by path limit 15) select array_to_string(path, '>') as cycle, len(path) as n, count(*) over () >= 15 as truncated from shown"""


def s_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of the test split's payments, scored against all before by the trained model, with all
    features, the communities of the payments before, and the threshold that is cheapest on the validation split."""
    e = labelled.edges(spark, sf_dir).where("split = 'test'")
    ledger = labels.payments(e).select(*(F.concat(F.lit("acct-"), c).alias(c) for c in ("sender", "receiver")), "amount", "ts")
    end = ledger.agg(F.max("ts").alias("end"))
    dated = cut(ledger.crossJoin(F.broadcast(end)).withColumn("new", F.col("ts") > F.col("end") - F.expr("interval 1 day")).drop("end"))
    context, batch = dated.where("not new").drop("new"), dated.where("new").drop("new")
    frozen = cut(partition.numbered(graph.partitioned(graph.undirected(graph.pairs(context)))))
    return serving.score_batch(batch, context, frozen, training.model(spark, sf_dir), training.FEATURES, training.threshold(spark, sf_dir), relational.P_STAR)


QUERIES = relational.QUERIES | evaluation.QUERIES | labelled.QUERIES | training.QUERIES | {
    "g_fingerprint": g_fingerprint,
    "g_extend_partition": g_extend_partition,
    "g_cycles_enum": g_cycles_enum,
    "gen_ledger": lambda spark, d: generator.ledger(spark),
    "m_report": report.lines,
    "s_score": s_score,
    "m_platt_fit": m_platt_fit,
    "m_platt_apply": m_platt_apply,
    "m_summary": report.m_summary,
    "m_bootstrap_ci": m_bootstrap_ci,
    "top_pass_through": top_pass_through,
    "f_local_commerce": _local(src.commerce_ledger),
    "f_local_handoff": _local(src.handoff_ledger),
    **{f"f_{x}": _one(x) for x in (*LOCAL, *COUNTS)},
    "f_clustering": lambda spark, d: _rounded(graph.clustering(src.commerce_ledger(spark, d)), "node"),
    "f_pagerank": lambda spark, d: _rounded(graph.pagerank(src.commerce_ledger(spark, d)), "node"),
    "g_core_peel": g_core_peel,
    "f_cycle_participation": lambda spark, d: _rounded(graph.cycle_participation(src.commerce_ledger(spark, d)), "node"),
    "f_community_internal_ratio": f_community_internal_ratio,
    "g_bfs_bounded": g_bfs_bounded,
    "g_khop": g_khop,
    "g_louvain": g_louvain,
    "f_pagerank_converged": lambda spark, d: graph.converged_pagerank(src.commerce_ledger(spark, d), 1e-8).select("node", F.round("pagerank", 4).alias("pagerank")),
    "g_communities": lambda spark, d: _communities(spark, d),
}
SQL = relational.SQL | evaluation.SQL | training.SQL | labelled_sql.build(lambda n, rel: _LOCAL_SQL.format(n=n, rel=rel), _CLUSTER_SQL, _rank_sql, _CYCLE_SQL, _COMM_SQL) | {
    "top_pass_through": f"select node, in_degree, out_degree, in_amount_sum, out_amount_sum, flow_passthrough from ({_local_sql('ledger')}) order by flow_passthrough desc, node limit 20",
    "f_local_commerce": _local_sql("ledger"),
    "f_local_handoff": _local_sql("handoff"),
    **{f"f_{x}": f"select node, {x} from ({_local_sql('handoff')})" for x in (*LOCAL, *COUNTS)},
    "g_fingerprint": _PRINT_SQL,
    "m_platt_fit": _PLATT_SQL + " select round(a, 6) as slope, round(b, 6) as intercept from f",
    "m_platt_apply": _PLATT_SQL + " select id, round(1 / (1 + exp(-(a * ln(q / (1 - q)) + b))), 6) as p from (select id, greatest(1e-6::double, least(1 - 1e-6::double, score)) as q from s) cross join f",
    "g_cycles_enum": _ENUM_SQL.format(rel=src.SQL["ledger"]),
    "f_clustering": _CLUSTER_SQL.format(rel=src.SQL["ledger"]),
    "f_pagerank_converged": f"select node, round(pagerank, 4) as pagerank from ({_rank_sql(src.SQL['ledger'], 130)})",
    "f_pagerank": f"select node, round(pagerank, 6) as pagerank from ({_rank_sql(src.SQL['ledger'])})",
    "g_core_peel": (_CORE + " select s as sender, r as receiver from core").format(rel=src.SQL["ledger"]),
    "f_cycle_participation": _CYCLE_SQL.format(rel=src.SQL["ledger"]),
    "f_community_internal_ratio": _COMM_SQL.format(rel=src.SQL["ledger"]),
    "g_bfs_bounded": _BFS_SQL,
    "g_khop": _KHOP_SQL,
}
