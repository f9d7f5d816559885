"""Operators that are one relational query each. The text is run by Spark over DataFrames, and by the
independent engine over the same relations; only MICROS and PCT differ in name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import scan, selection
from tallyweave.sources import ledger as src
from tallyweave.work import cut

#: Prices of a missed positive and of a false alarm, and the break-even probability.
FN, FP = 200000, 15000
P_STAR = FP / (FP + FN)

_PAIRS = "select sender, receiver, count(*) as weight, sum(amount) as total from {ledger} group by sender, receiver"
_CONF = "count_if(y = 1 and score >= t) as tp, count_if(y = 0 and score >= t) as fp, count_if(y = 1 and score < t) as fn, count_if(y = 0 and score < t) as tn"
#: Every distinct threshold, strictest first, with cumulative counts; ties are one row. Running sums are
#: taken within 1,024 score buckets and over the buckets' totals, so no task gets all the scores. `sweep`
#: has the thresholds that flag someone, `cuts` also the one that flags nobody.
_SWEEP = """by_score as (select score, floor(score * 1024) as b, sum(y) as p, sum(1 - y) as n from {scored} where split = 'SPLIT' group by score, floor(score * 1024)),
buckets as (select b, max(score) as top, sum(p) as bp, sum(n) as bn, count(*) as bk from by_score group by b),
tot as (select cast(sum(bp) as bigint) as np, cast(sum(bn) as bigint) as nn, max(top) as top from buckets),
above as (select b, sum(bp) over w as ap, sum(bn) over w as an, sum(bk) over w as ak, lead(top) over (order by b desc) as next_top from buckets window w as (order by b desc rows between unbounded preceding and 1 preceding)),
sweep as (select score as threshold, cast(p as bigint) as p, cast(coalesce(ap, 0) + sum(p) over w as bigint) as tp, cast(coalesce(an, 0) + sum(n) over w as bigint) as fp, np, nn,
  cast(coalesce(ak, 0) + row_number() over (partition by s.b order by score desc) as bigint) as rn, coalesce(lead(score) over (partition by s.b order by score desc), next_top) as lower
  from by_score s join above on s.b = above.b cross join tot window w as (partition by s.b order by score desc rows between unbounded preceding and current row)),
cuts as (select threshold, tp, fp, np, nn, rn, lower from sweep union all select NEXTUP(top), cast(0 as bigint), cast(0 as bigint), np, nn, cast(0 as bigint), top from tot)"""
#: From c (g, threshold, lower, rn, cost): of each g the widest run of cheapest rows, the strictest of equals,
#: and the middle of its range (lo, hi].
_BEST = """m as (select *, coalesce(lower, NEXTDOWN(threshold)) as low, rn - row_number() over (partition by g order by rn) as island from (select *, min(cost) over (partition by g) as least_cost from c) x where cost = least_cost),
i as (select g, island, max(threshold) as hi, min(low) as lo, min(cost) as cost, count(*) as n from m group by g, island),
opt as (select g, case when (hi + lo) / 2 > lo then (hi + lo) / 2 + 0.0 else hi end as t, hi, lo, cost, n from (select *, row_number() over (partition by g order by hi - lo desc, hi desc) as k from i) x where k = 1)"""


def _sweep(split: str = "val") -> str:
    return _SWEEP.replace("SPLIT", split)


def _cost(tp: str = "tp", fp: str = "fp") -> str:
    return f"cast((np - {tp}) * {FN} + {fp} * {FP} as bigint)"


TEXTS: dict[str, str] = {
    # sources, filters, projections
    "src_window_probe": "select round((max(MICROS(ts)) - min(MICROS(ts))) / 86400000000.0, 6) as days from {ledger}",
    "flt_self_loop": "select count(*) as n from {ledger} where sender <> receiver",
    "flt_window": "select sender, receiver, MICROS(ts) as us from {handoff} where MICROS(ts) >= (select max(MICROS(ts)) - 7 * 86400000000 from {handoff})",
    "flt_outside": "with b as (select max(MICROS(ts)) as hi, max(MICROS(ts)) - 7 * 86400000000 as lo from {handoff}) select sender, receiver, MICROS(ts) as us, round(greatest(0, lo - MICROS(ts)) / 86400000000.0, 6) as early_days, round(greatest(0, MICROS(ts) - hi) / 86400000000.0, 6) as late_days from {handoff} cross join b where MICROS(ts) < lo or MICROS(ts) > hi",
    "flt_repeat": "select sender, receiver, weight from (" + _PAIRS + ") p where weight >= 2",
    "flt_score_ge": "select id from {scored} where score >= 0.9",
    "flt_mask_fp": "select id, score from {scored} where y = 0 and score >= 0.95",
    "flt_mask_fn": "select id, score from {scored} where y = 1 and score < 0.05",
    "prj_windows": "with b as (select min(MICROS(ts)) as lo, max(MICROS(ts)) as hi from {handoff}), w as (select 0 as k union all select 1 union all select 2) select cast(k as bigint) as window_id, cast(floor(lo + k * (hi - lo) / 3.0) as bigint) as start_us, cast(case when k = 2 then hi else floor(lo + (k + 1) * (hi - lo) / 3.0) end as bigint) as end_us from b cross join w",
    "prj_shown": "select id, nullif(score, 0.5) as shown, case when ring_id < 0 then null else ring_id end as ring_id from {scored}",
    # graph
    "g_pairs": "select sender, receiver, weight, round(cast(total as double), 4) as total from (" + _PAIRS + ") p",
    "g_nodes": "select sender as node from {ledger} union select receiver from {ledger}",
    "g_window_days": "select round(coalesce((max(MICROS(ts)) - min(MICROS(ts))) / 86400000000.0, 0.0), 6) as days from {handoff}",
    "g_window_scale": "select round(case when d >= 1 then 60 / d else 1.0 end, 9) as scale from (select (max(MICROS(ts)) - min(MICROS(ts))) / 86400000000.0 as d from {handoff}) x",
    "g_undirected": "select least(sender, receiver) as a, greatest(sender, receiver) as b, count(*) as weight, round(cast(sum(amount) as double), 4) as total from {ledger} group by 1, 2",
    "g_members": "select ring_id, count(distinct id) as members from {scored} where ring_id >= 0 group by ring_id",
    "g_ring_options": "select ring_id, concat('ring ', cast(ring_id as varchar(20)), ' (', min(ring_type), ', ', cast(count(*) as varchar(20)), ')') as label from {scored} where ring_id >= 0 group by ring_id",
    "g_classify": "select id, case when y is null then 'unlabelled' when y = 1 and score >= 0.5 then 'caught' when y = 1 then 'missed' when score >= 0.5 then 'false_alarm' when ring_type <> 'organic' then 'victim' else 'clear' end as class from {scored}",
    # aggregates
    "agg_hash": "select receiver, count(*) as n, round(cast(sum(amount) as double), 4) as total, round(cast(sum(amount) as double) / count(*), 6) as mean, cast(max(amount) as double) as top from {ledger} group by receiver",
    "agg_distinct": "select count(distinct sender) as senders, count(distinct receiver) as receivers from {ledger}",
    "agg_value_counts": "select ring_type, count(*) as n from {scored} group by ring_type",
    "agg_any_mean_first": "select ring_id, max(case when score >= 0.5 then 1 else 0 end) as hit, round(avg(case when score >= 0.5 then 1.0 else 0.0 end), 6) as share, min(ring_type) as ring_type from {scored} where ring_id >= 0 group by ring_id",
    "agg_quantile": "select ring_type, round(PCT(score, 0.5), 9) as p50, round(PCT(score, 0.9), 9) as p90, round(PCT(score, 0.99), 9) as p99 from {scored} group by ring_type",
    "agg_median": "select split, ring_type, round(PCT(score, 0.5), 9) as median_score from {scored} group by split, ring_type",
    "agg_moments": "select receiver, count(*) as n, round(stddev_pop(cast(amount as double)), 4) as sd, round(avg(cast(amount as double)), 4) as mean from {ledger} group by receiver",
    "agg_confusion": "select split, " + _CONF + " from (select *, 0.5 as t from {scored}) x group by split",
    "agg_describe": "select split, count(*) as accounts, cast(sum(y) as bigint) as positives, round(avg(cast(y as double)), 6) as prevalence, count(distinct case when ring_id >= 0 then ring_id end) as rings from {scored} group by split",
    "agg_risk_counts": "select count_if(score >= 0.75) as critical, count_if(score >= 0.5 and score < 0.75) as high, count_if(score >= 0.069767 and score < 0.5) as medium, count_if(score < 0.069767) as low from {scored}",
    "agg_view_counts": "select count_if(score >= 0.5) as flagged, count_if(score >= 0.5 and y = 0) as false_alarms, count_if(score < 0.5 and y = 1) as missed from {scored} where split = 'test'",
    "agg_cost_breakdown": f"select fn * {FN} as fn_cost, fp * {FP} as fp_cost, round(fn * {FN}.0 / (fn * {FN} + fp * {FP}), 6) as fn_share from (select " + _CONF + " from (select *, 0.5 as t from {scored}) x) y",
    "agg_archetype_dash": "select ring_type, count(*) as accounts, count_if(score >= 0.5) as caught, round(count_if(score >= 0.5) * 1.0 / count(*), 6) as recall from {scored} where y = 1 group by ring_type",
    # ordered analytics
    "w_cumsum": "with " + _sweep() + " select threshold, tp, fp from sweep",
    "w_avg_rank": "select id, rank() over (partition by split order by score) + (count(*) over (partition by split, score) - 1) / 2.0 as avg_rank from {scored}",
    "w_diff": "with " + _sweep() + " select threshold, round(tp * 1.0 / np - lag(tp * 1.0 / np, 1, 0.0) over (order by threshold desc), 9) as gained from sweep",
    "w_lead_bound": "with " + _sweep() + " select threshold, lead(threshold) over (order by threshold desc) as lower_bound from sweep",
    "w_islands": "with " + _sweep() + ", c as (select threshold, " + _cost() + " as cost, row_number() over (order by threshold desc) as rn from sweep), m as (select *, rn - row_number() over (order by threshold desc) as island from c where cost = (select min(cost) from c)) select cast(island as bigint) as island, cast(min(cost) as bigint) as cost, max(threshold) as hi, min(threshold) as lo, count(*) as n from m group by island",
    "w_first": "select sender, receiver from (select sender, receiver, row_number() over (partition by sender order by ts, receiver, amount) as r from {handoff}) x where r = 1",
    "w_dedup": "select sender, receiver, cast(amount as double) as amount, MICROS(ts) as us from (select *, row_number() over (partition by sender, receiver, amount, ts order by ts) as r from {ledger}) x where r = 1",
    "w_round_robin": "select id, cast((row_number() over (order by id) - 1) % 5 as bigint) as fold from {scored} where y = 1",
    "w_canonical_rank": "select id, cast(dense_rank() over (order by m) - 1 as bigint) as community from (select id, min(id) over (partition by ring_id) as m from {scored} where ring_id >= 0) x",
    "ord_top_seeds": "select id, score from {scored} where y = 0 order by score desc, id limit 12",
    "top_view": "select receiver, n from (select receiver, count(*) as n from {ledger} group by receiver) x order by n desc, receiver limit 12",
    "set_union_all": "select count(*) as n from (select sender from {ledger} union all select receiver from {ledger}) x",
    "set_intersect": "select sender as node from {ledger} intersect select receiver from {ledger}",
    "set_except": "select sender as node from {ledger} except select receiver from {ledger}",
    # joins
    "join_self_reciprocal": "with p as (" + _PAIRS + ") select p.sender, p.receiver, p.weight as there, q.weight as back from p join p q on p.sender = q.receiver and p.receiver = q.sender",
    "join_left_range": "with c as (select sender, max(MICROS(ts)) - 86400000000 as cutoff from {handoff} group by sender) select h.sender, count_if(MICROS(h.ts) > c.cutoff) as late, count(*) as n from {handoff} h left join c on h.sender = c.sender group by h.sender",
    # evaluation
    "m_cost_config": f"select cast({FN} as double) / {FP} as fn_fp_ratio, round(cast({FP} as double) / ({FP} + {FN}), 9) as break_even",
    "m_prf": "select split, round(tp / nullif(tp + fp, 0), 9) as p, round(tp / nullif(tp + fn, 0), 9) as r, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) as f1 from (select split, " + _CONF + " from (select *, 0.7 as t from {scored}) x group by split) y",
    "m_auc": "with s as (select split, score, floor(score * 1024) as b, sum(y) as p, sum(1 - y) as n from {scored} group by split, score, floor(score * 1024)), k as (select split, b, sum(sum(n)) over (partition by split order by b rows between unbounded preceding and 1 preceding) as below from s group by split, b), r as (select s.split, p, n, coalesce(below, 0) + sum(n) over (partition by s.split, s.b order by score rows between unbounded preceding and current row) - n / 2.0 as beaten from s join k on s.split = k.split and s.b = k.b) select split, round(sum(p * beaten) / nullif(sum(p) * sum(n), 0), 9) as auc from r group by split",
    "m_ap": "with " + _sweep("test") + " select round(sum(p * 1.0 / np * tp / (tp + fp)), 9) as ap from sweep",
    "m_brier": "select split, round(avg((score - y) * (score - y)), 9) as brier from {scored} group by split",
    "m_reliability": "with b as (select 0 as bin, 0.0 as lo, 0.2 as hi union all select 1, 0.2, 0.4 union all select 2, 0.4, 0.6 union all select 3, 0.6, 0.8 union all select 4, 0.8, 1.0) select bin, count(id) as n, round(avg(score), 9) as predicted, round(avg(cast(y as double)), 9) as observed from b left join {scored} s on s.score >= lo and (s.score < hi or bin = 4 and s.score <= 1) group by bin",
    "m_ece": "select round(sum(n * abs(p - o)) / sum(n), 9) as ece from (select least(floor(score * 5), 4) as bin, count(*) as n, avg(score) as p, avg(cast(y as double)) as o from {scored} group by 1) x",
    "m_compute_cost": f"select split, fn * {FN} + fp * {FP} as total_cost from (select split, " + _CONF + " from (select *, 0.5 as t from {scored}) x group by split) y",
    "m_sweep": "with " + _sweep() + f" select threshold, tp, fp, nn - fp as tn, np - tp as fn, {_cost()} as total_cost, (np - tp) * {FN} as fn_cost_total, fp * {FP} as fp_cost_total, tp + fp as n_flagged, round((tp + fp) * 1.0 / (np + nn), 9) as alert_rate, round(tp * 1.0 / nullif(tp + fp, 0), 9) as p, round(tp * 1.0 / nullif(np, 0), 9) as r, round(2.0 * tp / nullif(tp + fp + np, 0), 9) as f1 from cuts",
    "m_opt_threshold": "with " + _sweep() + ", c as (select 1 as g, threshold, lower, rn, " + _cost() + " as cost from cuts), " + _BEST + " select t as threshold, hi, lo, cost, n as n_equivalent from opt",
    "m_alert_budget": "with " + _sweep() + " select coalesce(min(case when rn > 0 and (tp + fp) * 1000 <= 20 * (np + nn) then threshold end), max(threshold)) as threshold, count_if(rn > 0 and (tp + fp) * 1000 <= 20 * (np + nn)) as affordable, count_if(rn > 0 and (tp + fp) * 1000 <= 20 * (np + nn)) > 0 as budget_feasible, round(min(case when rn > 0 then (tp + fp) * 1.0 / (np + nn) end), 9) as strictest_rate from cuts",
    "m_ratio_sensitivity": "with " + _sweep() + f", k as (select 2.0 as g union all select 5.0 union all select 10.0 union all select 25.0 union all select 50.0 union all select {FN}.0 / {FP}), c as (select g, threshold, lower, rn, (np - tp) * g + fp as cost from cuts cross join k), " + _BEST + ", e as (select g, t, " + _CONF + " from opt cross join (select y, score from {scored} where split = 'test') s group by g, t) select round(g, 6) as ratio, t as threshold, round(1.0 / (1.0 + g), 9) as break_even, tp, fp, fn, round(tp * 1.0 / nullif(tp + fp, 0), 9) as p, round(tp * 1.0 / nullif(tp + fn, 0), 9) as r, round(fn * g + fp, 6) as cost from e",
    "m_prec_at_prev": "with c as (select tp * 1.0 / (tp + fn) as tpr, fp * 1.0 / (fp + tn) as fpr from (select " + _CONF + " from (select *, 0.7 as t from {scored}) x) y), pi as (select 0.02 as pi union all select 0.01 union all select 0.005 union all select 0.002 union all select 0.001) select cast(pi as double) as pi, round(pi * tpr / nullif(pi * tpr + (1 - pi) * fpr, 0), 9) as projected from c cross join pi",
    "m_prev_for_prec": f"select round({P_STAR} * fpr / (tpr * (1 - {P_STAR}) + {P_STAR} * fpr), 9) as prevalence from (select cast(tp as double) / (tp + fn) as tpr, cast(fp as double) / (fp + tn) as fpr from (select " + _CONF + " from (select *, 0.7 as t from {scored}) x) y) z",
    "m_rates": "select split, round(tp * 1.0 / nullif(tp + fn, 0), 9) as tpr, round(fp * 1.0 / nullif(fp + tn, 0), 9) as fpr from (select split, " + _CONF + " from (select *, 0.7 as t from {scored}) x group by split) y",
    "m_trivial": f"select split, cast(sum(y) as bigint) * {FN} as flag_none, cast(sum(1 - y) as bigint) * {FP} as flag_all from {{scored}} group by split",
    "m_archetype": "select coalesce(ring_type, 'all') as archetype, count(*) as accounts, count_if(score >= 0.5) as caught, count(distinct ring_id) as rings, count(distinct case when score >= 0.5 then ring_id end) as rings_hit from {scored} where y = 1 group by rollup(ring_type)",
    "m_bootstrap_clusters": "select id, case when ring_id >= 0 then concat('ring:', cast(ring_id as varchar(20))) else concat('acct:', cast(id as varchar(20))) end as cluster from {scored}",
    "m_split_integrity": "select a.split as first, b.split as second, count(*) as shared from (select distinct split, ring_id from {scored} where ring_id >= 0) a join (select distinct split, ring_id from {scored} where ring_id >= 0) b on a.ring_id = b.ring_id and a.split < b.split group by a.split, b.split",
    "r_bin_side": "select bin, case when p - o > 0.0005 then 'over' when o - p > 0.0005 then 'under' else 'on' end as side from (select cast(least(floor(score * 5), 4) as bigint) as bin, avg(score) as p, avg(cast(y as double)) as o from {scored} group by 1) x",
    "r_missed_archetypes": "select ring_type from {scored} where y = 1 group by ring_type having count(distinct case when score >= 0.999 then ring_id end) < count(distinct ring_id)",
    "ml_spw": "select split, round(sum(1 - y) * 1.0 / sum(y), 9) as weight from {scored} group by split",
    "ml_groups": "select split, count(distinct case when ring_id >= 0 then concat('r', cast(ring_id as varchar(20))) else concat('a', cast(id as varchar(20))) end) as n from {scored} group by split",
    "ml_folds": "with r as (select ring_id, count(*) as n from {scored} where ring_id >= 0 group by ring_id) select ring_id, n, cast((row_number() over (order by n desc, ring_id) - 1) % 5 as bigint) as fold from r",
    # quality assertions: no rows, or the offending ones
    "q_difficulty": "select a.ring_type, round(a.p50, 9) as p50, round(b.p90, 9) as p90, a.p50 <= b.p90 as hard from (select ring_type, PCT(score, 0.5) as p50 from {scored} where y = 1 group by ring_type) a cross join (select PCT(score, 0.9) as p90 from {scored} where y = 0) b",
    # serving
    "s_merge": "with b as (select max(MICROS(ts)) as hi from {handoff}), c as (select h.*, 0 as origin from {handoff} h cross join b where MICROS(ts) between hi - 20 * 86400000000 and hi), n as (select h.*, 1 as origin from {handoff} h cross join b where MICROS(ts) > hi - 3 * 86400000000), m as (select *, row_number() over (partition by sender, receiver, amount, ts order by origin) as r from (select * from c union all select * from n) u) select origin, count_if(r = 1) as kept, count_if(r > 1) as dropped from m group by origin",
}


#: Literals with a point are doubles in both engines.
_LITERAL = re.compile(r"(?<![\w.])\d+\.\d+(?![\w.])")


def _spark(text: str) -> str:
    text = _LITERAL.sub(lambda m: m[0] + "D", text)
    text = re.sub(r"MICROS\(", "unix_micros(", text)
    text = re.sub(r"SERIES\((\d+)\)", r"(select explode(sequence(0, \1)) as k)", text)
    text = re.sub(r"SETTEXT\((\w+)\)", r"array_join(array_sort(collect_set(\1)), '|')", text)
    text = re.sub(r"NEXT(UP|DOWN)\((\w+)\)", lambda m: f"cast(java_method('java.lang.Math', 'next{m[1].capitalize()}', {m[2]}) as double)", text)
    return re.sub(r"PCT\(", "percentile(", text).replace("varchar(20)", "string")


def _other(text: str) -> str:
    text = re.sub(r"MICROS\(", "epoch_us(", text)
    text = re.sub(r"SERIES\((\d+)\)", lambda m: f"(select unnest(range(0, {int(m[1]) + 1})) as k)", text)
    text = re.sub(r"SETTEXT\((\w+)\)", r"string_agg(distinct \1, '|' order by \1)", text).replace("{orders}", "orders")
    text = re.sub(r"NEXT(UP|DOWN)\((\w+)\)", lambda m: f"nextafter({m[2]}, cast('{'' if m[1] == 'UP' else '-'}inf' as double))", text)
    text = _LITERAL.sub(lambda m: f"cast({m[0]} as double)", text)
    # The other engine's count_if is wider than a bigint.
    while (at := text.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}count(*) filter (where {text[at + 9 : end - 1]}){text[end:]}"
    used = [n for n in src.SQL if "{" + n + "}" in text]
    for n in used:
        text = text.replace("{" + n + "}", n)
    text = re.sub(r"PCT\(", "quantile_cont(", text)
    ctes = ", ".join(f"{n} as ({src.SQL[n]})" for n in used)
    if not ctes:
        return text
    return f"with {ctes}, {text[5:]}" if text.startswith("with ") else f"with {ctes} {text}"


_FRAMES = {"orders": lambda spark, d: src.table(spark, d, "orders").selectExpr("o_orderkey", "cast(o_orderdate as timestamp) as o_orderdate"), "ledger": src.commerce_ledger, "handoff": src.handoff_ledger, "scored": src.scored_frame}


def query(text: str):
    text = _spark(text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {n: f(spark, sf_dir) for n, f in _FRAMES.items() if "{" + n + "}" in text}
        return spark.sql(text, **frames)

    return run


def registered(texts: dict[str, str]) -> tuple[dict, dict[str, str]]:
    """Queries and SQL of texts by name."""
    return {name: query(t) for name, t in texts.items()}, {name: _other(t) for name, t in texts.items()}


QUERIES, SQL = registered(TEXTS)


# Orders over all rows: DataFrame programs whose SQL, the texts above, has plain windows.

_SWEPT = query("with " + _sweep() + f" select threshold, tp, fp, np, nn, rn, {_cost()} as cost from sweep")


def w_avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of equal scores are told apart by nothing: all get the middle one."""
    s = src.scored_frame(spark, sf_dir).select("id", "split", "score")
    by_score = scan.running(s.groupBy("split", "score").agg(F.count("*").alias("n")), [F.col("split"), F.col("score")], {"upto": F.col("n")})
    first = by_score.groupBy("split").agg(F.min(F.col("upto") - F.col("n")).alias("before"))
    ranks = by_score.join(F.broadcast(first), "split").select("split", "score", (F.col("upto") - F.col("n") - F.col("before") + 1 + (F.col("n") - 1) / 2.0).alias("avg_rank"))
    return s.join(ranks, ["split", "score"]).select("id", "avg_rank")


def w_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _SWEPT(spark, sf_dir).select("threshold", (F.col("tp") * 1.0 / F.col("np")).alias("r"))
    return scan.neighbour(s, [F.desc("threshold")], F.col("r"), "was", ahead=False).select("threshold", F.round(F.col("r") - F.coalesce("was", F.lit(0.0)), 9).alias("gained"))


def w_lead_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.neighbour(_SWEPT(spark, sf_dir).select("threshold"), [F.desc("threshold")], F.col("threshold"), "lower_bound", ahead=True)


def w_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cut(_SWEPT(spark, sf_dir))
    cheapest = s.join(F.broadcast(s.agg(F.min("cost").alias("cost"))), "cost")
    m = scan.running(cheapest, [F.desc("threshold")], place="k")
    return m.groupBy((F.col("rn") - F.col("k")).alias("island")).agg(F.min("cost").alias("cost"), F.max("threshold").alias("hi"), F.min("threshold").alias("lo"), F.count("*").alias("n"))


def w_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.scored_frame(spark, sf_dir).where("y = 1").select("id")
    return scan.running(s, [F.col("id")], place="k").select("id", ((F.col("k") - 1) % 5).alias("fold"))


def w_canonical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.scored_frame(spark, sf_dir).where("ring_id >= 0").select("id", "ring_id")
    rings = scan.running(s.groupBy("ring_id").agg(F.min("id").alias("m")), [F.col("m")], place="k")
    return s.join(rings, "ring_id").select("id", (F.col("k") - 1).alias("community"))


def ml_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = src.scored_frame(spark, sf_dir).where("ring_id >= 0").groupBy("ring_id").agg(F.count("*").alias("n"))
    return scan.running(rings, [F.desc("n"), F.col("ring_id")], place="k").select("ring_id", "n", ((F.col("k") - 1) % 5).alias("fold"))


def agg_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = selection.quantiles(src.scored_frame(spark, sf_dir), ["ring_type"], "score", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return q.select("ring_type", *[F.round(c, 9).alias(c) for c in ("p50", "p90", "p99")])


def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = selection.quantiles(src.scored_frame(spark, sf_dir), ["split", "ring_type"], "score", {"median_score": 0.5})
    return q.select("split", "ring_type", F.round("median_score", 9).alias("median_score"))


QUERIES |= {q.__name__: q for q in (w_avg_rank, w_diff, w_lead_bound, w_islands, w_round_robin, w_canonical_rank, ml_folds, agg_quantile, agg_median)}
