"""Operators of the evaluation's reports: operating points, projections, policies, calibration tables,
derived statements, contracts. Texts as in `relational`."""

from __future__ import annotations

from tallyweave.plans.relational import _BEST, _CONF, FN, FP, P_STAR, _cost, _sweep, registered

#: Outcomes on the test rows at a threshold, as one row.
_AT = "(select " + _CONF + ", count(*) as n, cast(sum(y) as bigint) as positives from (select *, {t} as t from {{scored}} where split = 'test') x)"
_PRF = "round(tp * 1.0 / nullif(tp + fp, 0), 9) as p, round(tp * 1.0 / nullif(tp + fn, 0), 9) as r, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) as f1"
_BINS = "bins as (select k, cast(k as double) * 0.2 as lo, case when k = 4 then 2.0 else cast(k + 1 as double) * 0.2 end as hi from SERIES(4) q)"

def _calibrated(value: str) -> str:
    return "select k as bin, count(v) as n, avg(v) as m, avg(case when v is not null then cast(y as double) end) as o, sum((v - y) * (v - y)) as sq from bins left join (select y, " + value + " as v from {scored} where split = 'test') s on v >= lo and v < hi group by k"


def _at(t: str = "0.7") -> str:
    return _AT.format(t=t)


TEXTS: dict[str, str] = {
    "m_eval_at": f"select tp, fp, tn, fn, {_PRF}, fn * {FN} + fp * {FP} as total_cost, tp + fp as n_flagged, round((tp + fp) * 1.0 / n, 9) as alert_rate from {_at()} c",
    "m_confusion_table": f"with c as {_at()} select 'positive' as class, tp as hits, {_PRF} from c union all select 'negative', tn, round(tn * 1.0 / nullif(tn + fn, 0), 9), round(tn * 1.0 / nullif(tn + fp, 0), 9), round(2.0 * tn / nullif(2 * tn + fp + fn, 0), 9) from c",
    # Both ends, the cheapest row and evenly spaced rows in between: at most 200.
    "m_cost_curve": "with " + _sweep() + ", c as (select threshold, rn, " + _cost() + " as cost from cuts), b as (select min(rn) as best from c where cost = (select min(cost) from c)), z as (select max(rn) as last from c), kept as (select cast(floor(k * (last / 196.0)) as bigint) as rn from SERIES(196) q cross join z union select last from z union select best from b union select cast(0 as bigint)) select threshold, cost from c where rn in (select rn from kept)",
    "m_break_even_prev": f"select round({P_STAR} * fpr / nullif(tpr * (1 - {P_STAR}) + {P_STAR} * fpr, 0), 9) as prevalence from (select tp * 1.0 / (tp + fn) as tpr, fp * 1.0 / (fp + tn) as fpr from {_at()} c) z",
    "m_project_prev": f"with c as (select tp * 1.0 / (tp + fn) as tpr, fp * 1.0 / (fp + tn) as fpr, round(positives * 1.0 / n, 6) as seen from {_at()} a), pi as (select 0.02 as pi union select 0.01 union select 0.005 union select 0.002 union select 0.001 union select seen from c), j as (select pi, pi = seen as is_observed, tpr, fpr, pi * tpr / nullif(pi * tpr + (1 - pi) * fpr, 0) as q from pi cross join c) select pi as prevalence, is_observed, round(tpr, 9) as r, round(q, 9) as projected, q >= {P_STAR} as clears, round(1000 * (pi * tpr + (1 - pi) * fpr), 6) as alerts_per_1000, round(1000 * pi * (1 - tpr) * {FN} + 1000 * (1 - pi) * fpr * {FP}, 3) as cost_per_1000 from j",
    "r_break_even_bracket": f"with c as (select tp * 1.0 / (tp + fn) as tpr, fp * 1.0 / (fp + tn) as fpr from {_at()} a), j as (select pi, pi * tpr / nullif(pi * tpr + (1 - pi) * fpr, 0) >= {P_STAR} as clears from (select 0.02 as pi union all select 0.1 union all select 0.05 union all select 0.01 union all select 0.001) p cross join c) select min(case when clears then pi end) as lowest_clearing, max(case when not clears then pi end) as highest_failing from j",
    "m_attr_slack": "with a as (select id, ring_id as own, concat(cast(ring_id as varchar(20)), case when id % 11 = 0 then concat('|', cast((ring_id + 1) % 40 as varchar(20))) else '' end) as rings from {scored} where ring_id >= 0), e as (select id, own, split_part(rings, '|', 1) as ring from a union all select id, own, split_part(rings, '|', 2) from a), r as (select id, own, cast(ring as bigint) as ring from e where ring <> ''), k as (select id, count(distinct ring) as rings, count(distinct ring % 3) as types from r group by id) select (select count(*) from k) as n_positives, (select count_if(rings > 1) from k) as multi, (select count_if(types > 1) from k) as bridging, (select count(distinct ring) from r where ring <> own) as short_rings",
    "m_select_points": "with " + _sweep() + ", c as (select 1 as g, threshold, lower, rn, " + _cost() + " as cost from cuts), " + _BEST + " select 'cost_optimal' as point, t as threshold from opt union all select 'capacity', coalesce(min(case when rn > 0 and (tp + fp) * 1000 <= 20 * (np + nn) then threshold end), max(threshold)) from cuts",
    "m_eval_test": "with " + _sweep() + ", c as (select 1 as g, threshold, lower, rn, " + _cost() + " as cost from cuts), " + _BEST + ", e as (select t, " + _CONF + " from (select y, score, t from {scored} cross join opt where split = 'test') x group by t) select t as threshold, tp, fp, tn, fn, " + _PRF + f", fn * {FN} + fp * {FP} as total_cost from e",
    "m_price_baseline": f"select fn * 100000 + fp * 5000 as total_cost, coalesce(tp * 1.0 / nullif(tp + fp, 0), 0.0) as p, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0.0) as r from {_at('2.0')} c",
    "argmax_f1": "with " + _sweep() + " select threshold, round(2.0 * tp / (tp + fp + np), 9) as f1 from sweep order by 2.0 * tp / (tp + fp + np) desc, threshold desc limit 1",
    "m_calib_report": "with " + _BINS + ", b as (" + _calibrated("score") + ") select bin, n, round(m, 9) as predicted, round(o, 9) as observed, round(sq / nullif(n, 0), 9) as brier from b where n > 0",
    "r_direction": "with a as (select split, avg(score) as m from {scored} group by split) select p.split as first, q.split as second, case when abs(q.m - p.m) <= 0.0005 then 'flat' when q.m > p.m then 'up' else 'down' end as moved from a p join a q on p.split < q.split",
    "r_fp_reconstruct": f"select round(round((tp + fp) * 1000.0 / n, 1) / 1000 * n) - round(round(tp * 1.0 / positives, 3) * positives) as fp, fp as exact from {_at()} c",
    "agg_set_string": "select ring_id, SETTEXT(split) as splits from {scored} where ring_id >= 0 group by ring_id",
    "agg_dataset_panel": "select split, count(*) as accounts, cast(sum(y) as bigint) as positives, round(avg(cast(y as double)), 9) as prevalence, count(distinct case when ring_id >= 0 then ring_id end) as rings, count_if(ring_type = 'fast') as fast, count_if(ring_type = 'stealth') as stealth, count_if(ring_type = 'layered') as layered from {scored} group by split",
    "q_grid": "with w as (select split, min(d) as lo, max(d) as hi from (select o_orderkey as id, floor(MICROS(o_orderdate) / 86400000000) as d from {orders}) o join (select id, split from {scored}) s on o.id = s.id group by split), g as (select split, lo - lag(hi) over (order by lo) as gap, hi - lo + 1 as days from w) select split, cast(gap as bigint) as gap, cast(days as bigint) as days, coalesce(gap = 1, true) as contiguous from g",
    "gen_allocate": "with a as (select 'fast_cycle' as name, 0.35 as share, 1 as o union all select 'stealth_cycle', 0.4, 2 union all select 'layered_fanin', 0.25, 3), r as (select 'train' as split, 40 as n union all select 'val', 24 union all select 'test', 24), e as (select split, name, o, n, floor(n * share) as base, n * share - floor(n * share) as rest from a cross join r), k as (select *, row_number() over (partition by split order by round(rest, 9) desc, o) as rk, n - sum(base) over (partition by split) as spare from e) select split, name, cast(base + case when rk <= spare then 1 else 0 end as bigint) as rings from k",
    "gen_round_nice": "select amount, case when amount >= 10000 then round(amount / 500) * 500 when amount >= 1000 then round(amount / 50) * 50 else greatest(10.0, round(amount / 10) * 10) end as nice from (select distinct cast(amount as double) + 0.125 as amount from {ledger}) x",
}

QUERIES, SQL = registered(TEXTS)
