"""SQL of the queries in `labelled`, for the independent engine. It is written from what the operators mean:
one window over all rows where Spark takes ranges, joins where Spark aggregates."""

from __future__ import annotations

from tallyweave.functions import contract
from tallyweave.operators import serving
from tallyweave.plans.relational import FN, FP, P_STAR
from tallyweave.sources import ledger as src

LOCAL = tuple(f for f in contract.FEATURES if f not in contract.GRAPH_FEATURES or f == "reciprocity")
SPLITS = ("train", "val", "test")
E = f"edges as materialized ({src.SQL['edges']})"
KINDS = {"node": "varchar"}


def build(local, cluster: str, rank, cycle: str, community: str) -> dict[str, str]:
    """local(name, relation), rank(relation, rounds) and the rest are templates of statements that give a
    feature by node; {rel} stands for a relation of payments."""

    def features(rel: str) -> str:
        first = f"({local('l', rel)}) f"
        rest = "".join(f" join ({part}) {n} using (node)" for n, part in (("c", cluster.format(rel=rel)), ("r", rank(rel)), ("y", cycle.format(rel=rel)), ("m", community.format(rel=rel))))
        return f"select node, {', '.join(contract.FEATURES)} from {first}{rest}"

    payments = "select sender, receiver, amount, ts from ({e}) where split = '{s}'"
    own = {s: payments.format(e=src.SQL["edges"], s=s) for s in SPLITS}
    ends = "select sender as node, * from edges where edge_role = 'ring' union all select receiver as node, * from edges where edge_role = 'ring'"
    rings = f"""rings as (select split, node, arg_min(ring_id, row(ts, pos)) as ring_id, arg_min(ring_type, row(ts, pos)) as ring_type,
      array_to_string(list_sort(list_distinct(list(ring_id))), '|') as rings_attributed, array_to_string(list_sort(list_distinct(list(ring_type))), '|') as ring_types_attributed from ({ends}) group by split, node)"""
    acc = f"""{E}, {rings}, accounts as materialized (select f.*, case when r.node is null then 0 else 1 end as y from ({' union all '.join(f"select '{s}' as split, node, {', '.join(LOCAL)} from ({local('l', own[s])})" for s in SPLITS)}) f left join rings r on f.split = r.split and f.node = r.node)"""
    high = " union all ".join(f"select split, y, '{f}' as feature, 'high' as direction, cast({f} as double) as x from accounts" for f in LOCAL)
    cand = f"{acc}, high as ({high}), cand as materialized (select * from high union all select split, y, feature, 'low', 0.0 - x from high)"
    sweep = """s as (select feature, direction, x, sum(y) as p, sum(1 - y) as n from cand where split = 'val' group by all),
    w as (select feature, direction, x as threshold, sum(p) over o as tp, sum(n) over o as fp, sum(p) over k as np, sum(n) over k as nn, row_number() over o as rn, lead(x) over (partition by feature, direction order by x desc) as lower from s window o as (partition by feature, direction order by x desc), k as (partition by feature, direction)),
    cuts as (select * from w union all select feature, direction, nextafter(max(x), cast('inf' as double)), 0, 0, sum(p), sum(n), 0, max(x) from s group by 1, 2)"""
    cheap = f"""priced as (select *, (np - tp) * {FN} + fp * {FP} as cost from cuts), least as (select feature, direction, min(cost) as cost from priced group by 1, 2),
    m as (select p.*, coalesce(p.lower, nextafter(p.threshold, cast('-inf' as double))) as low, p.rn - row_number() over (partition by p.feature, p.direction order by p.rn) as island from priced p join least l on p.feature = l.feature and p.direction = l.direction and p.cost = l.cost),
    runs as (select feature, direction, island, max(threshold) as hi, min(low) as lo, min(cost) as cost from m group by 1, 2, 3),
    best as (select *, row_number() over (partition by feature, direction order by hi - lo desc, hi desc) as k from runs),
    chosen as (select feature, direction, case when (hi + lo) / 2 > lo then (hi + lo) / 2 else hi end as threshold, cast(cost as bigint) as val_cost from best where k = 1)"""
    afford = "chosen as (select feature, direction, coalesce(min(threshold) filter (where rn > 0 and (tp + fp) * 1000 <= 20 * (np + nn)), max(threshold)) as threshold, count(*) filter (where rn > 0 and (tp + fp) * 1000 <= 20 * (np + nn)) > 0 as feasible from cuts group by 1, 2)"
    f1 = "q as (select feature, direction, threshold, 2.0 * tp / (tp + fp + np) as val_f1, row_number() over (partition by feature, direction order by 2.0 * tp / (tp + fp + np) desc, threshold desc) as k from cuts where tp > 0), chosen as (select feature, direction, threshold, val_f1 from q where k = 1)"
    test = """test as (select c.*, tp, fp, fn, tn, tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r, 2.0 * tp / nullif(2 * tp + fp + fn, 0) as f1, fn * {fn} + fp * {fp} as total_cost, (tp + fp) * 1000.0 / (tp + fp + fn + tn) as alerts_per_1000
      from chosen c join (select d.feature, d.direction, count(*) filter (where x >= threshold and y = 1) as tp, count(*) filter (where x >= threshold and y = 0) as fp, count(*) filter (where x < threshold and y = 1) as fn, count(*) filter (where x < threshold and y = 0) as tn from cand d join chosen h on d.feature = h.feature and d.direction = h.direction where split = 'test' group by 1, 2) t on c.feature = t.feature and c.direction = t.direction)""".replace("{fn}", str(FN)).replace("{fp}", str(FP))
    auc = "ranks as (select feature, direction, y, rank() over (partition by feature, direction order by x) + (count(*) over (partition by feature, direction, x) - 1) / 2.0 as r from cand where split = 'val'), auc as (select feature, direction, (sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) as auc from ranks group by 1, 2)"
    whole = " union all ".join(f"select 'val' as split, y, '{f}' as feature, 'high' as direction, round(cast({f} as double), 6) as x from every" for f in contract.FEATURES)
    by_cost, by_f1, capped = (f"{cand}, {sweep}, {how}, {test}" for how in (cheap, f1, afford))
    six = ", ".join(f"round({f}, 6) as {f}" for f in contract.FEATURES)
    process = f"""with {E}, {rings}, f as ({features(own['val'])}) select f.node, {six}, cast(f.node as bigint) % 10 as louvain_community, 'val' as split, coalesce(r.ring_id, -1) as ring_id, coalesce(r.ring_type, 'organic') as ring_type,
      coalesce(r.rings_attributed, '') as rings_attributed, coalesce(r.ring_types_attributed, '') as ring_types_attributed, cast(r.node is not null as integer) as is_mule from f left join rings r on r.split = 'val' and r.node = f.node"""
    pay = "cast(amount as double) as amount, epoch_us(ts) as us"
    day = "cast(l_shipdate as date)"
    scored = f"scored as ({src.SQL['scored']})"
    c = serving.cutoffs(0.5, P_STAR)
    level = lambda s: f"case when {s} >= {c['CRITICAL']!r} then 'CRITICAL' when {s} >= {c['HIGH']!r} then 'HIGH' when {s} >= {c['MEDIUM']!r} then 'MEDIUM' else 'LOW' end"
    act = lambda t: f"case {t} when 'MEDIUM' then 'REQUIRE_ADDITIONAL_AUTH' when 'LOW' then 'ALLOW' else 'HOLD_FOR_REVIEW' end"
    resp = f"{scored}, resp as (select node, risk_score, risk_level, {act('risk_level')} as action, seen_in_context from (select id as node, score as risk_score, {level('score')} as risk_level, id % 2 = 0 as seen_in_context from scored))"
    k = "o_orderkey"
    names = [*("ALLOW", "allow", "FLAG_FOR_REVIEW", "HOLD_FOR_REVIEW", "REQUIRE_ADDITIONAL_AUTH", "BAN_USER", "LOCK_ACCOUNT", "Limit_Transfers", "NOTHING", "REVIEW", ""), *serving.FORBIDDEN, *serving.VERBS]
    dash = "select sender, receiver, count(*) as weight, sum(amount) as total, avg(cast(amount as double)) as mean, max(is_mule) as is_mule, string_agg(distinct edge_role, ', ' order by edge_role) as roles from edges group by 1, 2"
    organic = "select split, count(*) as n from edges where edge_role like 'organic%' and edge_role <> 'organic_camouflage' group by split"
    # Orders whose number 7 divides are no documents; 5 an override that is none.
    req = f"""select l_orderkey as request_id, row_number() over (partition by l_orderkey order by l_linenumber, 'supp-' || l_suppkey, cast(l_extendedprice as double), l_shipdate) - 1 as position, 'cust-' || o_custkey as sender, 'supp-' || l_suppkey as receiver, cast(cast(cast(l_extendedprice as double) as decimal(18,4)) as double) as amount, epoch_us(cast(l_shipdate as timestamp)) as us from orders join lineitem on l_orderkey = o_orderkey where {k} % 7 > 0 and {k} % 5 > 0"""
    some = "select distinct l_orderkey as id from lineitem join orders on l_orderkey = o_orderkey"
    out = {
        "src_edges_csv": f"with {E} select sender, receiver, {pay}, is_mule, edge_role, ring_id, ring_type, split from edges",
        "src_context_csv": f"with {E} select sender, receiver, {pay} from edges where split = 'val' and sender <> receiver",
        "src_features_csv": process,
        "src_all_splits": f"with {E} select split || '_edges' as name, count(*) as n from edges group by split union all select 'val_features', count(*) from (select sender from edges where split = 'val' union select receiver from edges where split = 'val')",
        "src_request_json": f"select request_id, cast(position as integer) as position, sender, receiver, amount, us, cast(null as varchar) as refused from ({req}) union all select id, null, null, null, null, null, case when id % 7 = 0 then 'transactions' else 'threshold_override' end from ({some}) where id % 7 = 0 or id % 5 = 0",
        "snk_json_safe": f"with {scored} select id, case when score > 0 then round(1 / score, 6) end as inverse, case when score > 0 then round(ln(score), 6) end as log, case when id % 3 > 0 then score end as other from scored",
        "prj_tz": f"select {k} as id, case {k} % 4 when 0 then epoch_us(cast(cast(o_orderdate as date) as timestamp)) + 23400000000 when 1 then epoch_us(cast(cast(o_orderdate as date) as timestamp)) + 72000000000 when 2 then epoch_us(cast(cast(o_orderdate as date) as timestamp)) + 43200250000 end as us from orders",
        "flt_role": f"with {E} select edge_role, count(*) as n from edges where edge_role in ('ring', 'organic_merchant', 'organic_oneoff') group by 1",
        "prj_split": f"select case when d < lo + t then 'train' when d < lo + 2 * t then 'val' else 'test' end as split, min(us) as first_us, max(us) as last_us, count(*) as n from (select {day} as d, epoch_us(cast(l_shipdate as timestamp)) as us from lineitem join orders on l_orderkey = o_orderkey where o_custkey <> l_suppkey) cross join (select min({day}) as lo, cast((max({day}) - min({day}) + 1) // 3 as integer) as t from lineitem) group by 1",
        "ord_ts": f"with {E} select epoch_us(ts) // 86400000000 as day, pos, cast(row_number() over (partition by epoch_us(ts) // 86400000000 order by ts, pos) as integer) as place from edges",
        "g_pairs_dash": f"with {E} select sender, receiver, weight, round(cast(total as double), 4) as total, round(mean, 4) as mean, is_mule, roles from ({dash})",
        "g_graph_dash": f"with {E}, p as (select distinct sender, receiver from edges where is_mule = 1) select node, (select count(*) from p where sender = node) as n_out, (select count(*) from p where receiver = node) as n_in from (select sender as node from edges union select receiver from edges)",
        "g_label": f"with {E}, {rings} select node, ring_id, ring_type, rings_attributed, ring_types_attributed from rings where split = 'val'",
        "g_victims": f"with {E} (select sender as node from edges where is_mule = 1 union select receiver from edges where is_mule = 1) except (select sender from edges where edge_role = 'ring' union select receiver from edges where edge_role = 'ring')",
        "g_khop_induced": f"""with h as ({src.SQL['handoff']}), seeds as (select node from (select sender as node from h union select receiver from h) where node in ('1', '2', '3')),
          near as (select node, count(*) as c from (select sender as node, receiver as o from h union all select receiver, sender from h) where o in (select node from seeds) and node not in (select node from seeds) group by 1),
          kept as (select node from seeds union all (select node from near order by c desc, node limit (select 40 - count(*) from seeds))) select sender, receiver, count(*) as weight, round(cast(sum(amount) as double), 4) as total from h where sender in (select node from kept) and receiver in (select node from kept) group by 1, 2""",
        "prj_features": f"select node, {', '.join(contract.FEATURES)} from ({process})",
        "g_process": process,
        "g_features": f"select node, {six}, cast(node as bigint) % 10 as community from ({features(src.SQL['handoff'])})",
        "g_pagerank": f"with v as ({rank(src.SQL['ledger'])}) select node, round(pagerank / (select count(*) from v), 9) as pagerank from v",
        "q_contract": " union all ".join(f"select '{f}' as feature, cast({i} as bigint) as place, cast(0 as bigint) as unusable" for i, f in enumerate(contract.FEATURES, 1)),
        "q_entity": f"with {E}, r as (select * from edges where edge_role = 'ring') select entity, count(distinct split) as splits from (select 'acct:' || sender as entity, split from r union all select 'acct:' || receiver, split from r union all select 'ring:' || ring_id, split from r) group by 1 having count(distinct split) > 1",
        "q_temporal": f"with {E}, s as (select split, min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from edges group by 1), o as (select *, lead(split) over (order by lo) as second, lead(lo) over (order by lo) as next_lo from s) select split as first, second, next_lo - hi as gap_us, hi <= next_lo as in_order from o where second is not null",
        "q_equal_windows": f"with {E}, d as (select (max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000.0 as d from edges group by split) select round(max(d) - min(d), 6) as spread_days, max(d) - min(d) <= 1.5 as equal from d",
        "q_volume": f"with {E}, v as ({organic}) select round((max(n) - min(n)) / max(n), 6) as spread, (max(n) - min(n)) / max(n) <= 0.10 as balanced from v",
        "q_sanity": f"with {E} select split, count(*) as n, count(*) filter (where sender = receiver) as self_loops, count(*) filter (where amount <= 0) as not_positive, count(distinct ring_type) filter (where ring_id >= 0) as kinds, count(*) filter (where sender = receiver or amount <= 0) = 0 and count(distinct ring_type) filter (where ring_id >= 0) = 3 as sane from edges group by split",
        "q_log1p_rule": f"with {acc}, high as ({high}) select feature, round(skewness(x), 5) as skew, min(x) >= 0 and skewness(x) >= 1.5 as use_log1p from high where split = 'train' group by feature",
        "m_rule_baseline": f"with {by_cost}, {auc} select t.feature, t.direction, round(threshold, 9) as threshold, val_cost, tp, fp, round(p, 9) as p, round(r, 9) as r, round(f1, 9) as f1, total_cost, round(alerts_per_1000, 9) as alerts_per_1000, round(auc, 9) as screen_auc from test t join auc a on t.feature = a.feature and t.direction = a.direction",
        "m_rule_baseline_f1": f"with {by_f1} select feature, direction, round(threshold, 9) as threshold, round(val_f1, 9) as val_f1, tp, fp, total_cost from test",
        "top_rules": f"with {by_cost} select feature, direction, val_cost, total_cost from test order by val_cost, feature, direction limit 10",
        "m_rule_text": f"with {by_cost} select feature, direction, feature || case direction when 'low' then ' <= ' else ' >= ' end || printf('%.9f', case direction when 'low' then 0.0 - threshold else threshold end) as rule from test",
        "m_capacity_fair": f"with {capped} select feature, direction, round(threshold, 9) as threshold, feasible, tp, fp, round(p, 9) as p, round(r, 9) as r, round(f1, 9) as f1, round(alerts_per_1000, 9) as alerts_per_1000, alerts_per_1000 > 20 as overflows, total_cost from test",
        "r_overflow": f"with {capped} select feature, direction, round(alerts_per_1000, 9) as alerts_per_1000 from test where alerts_per_1000 > 20",
        "r_capped_vs_rule": f"select c.feature, c.direction, c.total_cost as capped_cost, r.total_cost as uncapped_cost, round(r.alerts_per_1000 / 20.0, 6) as queue_multiple from (with {capped} select * from test) c join (with {by_cost} select * from test) r on c.feature = r.feature and c.direction = r.direction",
        "r_best_rival": f"select c.feature || ' ' || c.direction as rival, c.total_cost as rival_cost, r.feature || ' ' || r.direction as rule, r.total_cost as rule_cost, c.total_cost - r.total_cost as saved from (with {capped} select * from test where feasible order by total_cost, feature, direction limit 1) c cross join (with {by_cost} select * from test order by val_cost, feature, direction limit 1) r",
        "m_baselines": f"""with t as (with {acc} select sum(y) as np, sum(1 - y) as nn from accounts where split = 'test')
          select policy, round(threshold, 9) as threshold, tp, fp, round(p, 9) as p, round(r, 9) as r, round(f1, 9) as f1, total_cost from (
          select 'flag_none' as policy, cast(null as double) as threshold, cast(0 as bigint) as tp, cast(0 as bigint) as fp, cast(null as double) as p, 0.0::double as r, 0.0::double as f1, cast(np * {FN} as bigint) as total_cost from t
          union all select 'flag_all', 0.0, np, nn, np / (np + nn), 1.0, 2.0 * np / (2 * np + nn), nn * {FP} from t
          union all select 'rule_by_cost', threshold, tp, fp, p, r, f1, total_cost from (with {by_cost} select * from test order by val_cost, feature, direction limit 1)
          union all select 'rule_by_f1', threshold, tp, fp, p, r, f1, total_cost from (with {by_f1} select * from test order by val_f1 desc, feature, direction limit 1))""",
        "q_leakage_gate": f"with {E}, {rings}, f as ({features(own['val'])}), every as materialized (select f.*, case when r.node is null then 0 else 1 end as y from f left join rings r on r.split = 'val' and r.node = f.node), cand as ({whole}), {auc}, g as (select feature, greatest(auc, 1 - auc) as m from auc) select feature, round(m, 9) as strongest, m < 0.99 as passes from g order by round(m, 9) desc, feature desc limit 1",
        "m_row_report": f"""with {scored}, s as (select score as x, sum(y) as p, sum(1 - y) as n from scored where split = 'val' group by 1), t as (select sum(p) as np, sum(n) as nn, max(x) as top from s),
          w as (select x as threshold, sum(p) over (order by x desc) as tp, sum(n) over (order by x desc) as fp from s union all select nextafter(top, cast('inf' as double)), 0, 0 from t)
          select threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(nn - fp as bigint) as tn, cast(np - tp as bigint) as fn, round(tp / nullif(tp + fp, 0), 9) as p, round(tp / nullif(np, 0), 9) as r, round(2.0 * tp / (tp + fp + np), 9) as f1, round((tp + fp) * 1000.0 / (np + nn), 9) as alerts_per_1000, cast((np - tp) * {FN} + fp * {FP} as bigint) as total_cost, round(((np - tp) * {FN} + fp * {FP}) / (np + nn), 6) as cost_per_account from w cross join t""",
        "r_price_not_peeking": f"""with {scored}, cand as (select split, y, 'score' as feature, 'high' as direction, score as x from scored), {sweep}, {cheap}, {test},
          o as (select min((np - tp) * {FN} + fp * {FP}) as least from (select sum(y) over (order by x desc) as tp, sum(1 - y) over (order by x desc) as fp, sum(y) over () as np from cand where split = 'test') z)
          select total_cost - least(cast(o.least as bigint), np * {FN}) as gap, round((total_cost - least(o.least, np * {FN})) / total_cost, 9) as share from test cross join o cross join (select cast(sum(y) as bigint) as np from scored where split = 'test') n""",
        "m_sigmoid": f"with {scored}, a as (select id, (score - 0.5) * 4000 as a from scored) select id, round(case when a >= 0 then 1 / (1 + exp(-greatest(a, 0))) else exp(least(a, 0)) / (1 + exp(least(a, 0))) end, 9) as p from a",
        "s_validate": f"""select reason, count(*) as n from (select case when {k} % 11 in (0, 1, 2) then 'sender' when {k} % 13 = 1 then 'receiver' when {k} % 17 in (0, 1, 2) or {k} % 17 > 3 and {k} + 0.5 > 10000000 then 'amount' when {k} % 19 = 0 then 'ts' when {k} % 13 = 0 then 'self' else 'ok' end as reason from orders) group by 1""",
        "s_quantize": f"select {k} as id, cast(({k} // 10 + cast({k} % 10 > 5 or {k} % 10 = 5 and {k} // 10 % 2 = 1 as integer)) as double) / 1000000 as score from orders",
        "s_cutoffs": f"select 0.1257::double + (1 - 0.1257::double) / 2 as critical, 0.1257::double as high, round({P_STAR!r}::double, 6) as medium",
        "s_tier": f"with {resp} select node as id, risk_level as tier from resp",
        "s_action": f"with {resp} select risk_level as tier, action, count(*) as n from resp group by 1, 2",
        "s_build": f"with {resp} select node, risk_score, risk_level, action, seen_in_context from resp",
        "s_validate_batch": f"""with {resp}, bad as (select node, risk_level as t, action as a, case when node % 10 = 2 then 'HIGH' else risk_level end as risk_level, case node % 10 when 0 then 'ALLOW' when 1 then 'BLOCK_ACCOUNT' else action end as action from resp) select node, risk_level, action from bad where t <> risk_level or a <> action""",
        "s_allowlist": "select * from (values " + ", ".join(f"('{n}', {str(n.upper() in serving.PERMITTED).lower()})" for n in names) + ") v(name, permitted)",
        "q_louvain": f"with h as ({src.SQL['handoff']}), v as (select sender as node from h union select receiver from h) select count(*) as accounts, count(*) as placed, true as no_worse from v",
        "q_extension": f"with h as ({src.SQL['handoff']}), v as (select sender as node from h union select receiver from h) select count(*) as placed, count(*) as accounts, count(*) filter (where cast(node as bigint) % 3 > 0) as kept from v",
        "q_generator": "select * from (values ('train', 0::bigint, 0::bigint, 40::bigint, 3::bigint), ('val', 0, 0, 24, 3), ('test', 0, 0, 24, 3)) v(split, self_loops, not_positive, rings, kinds)",
        "q_platt": "select true as slope_is_still, true as intercept_is_still",
        "q_bootstrap": "select 1000::bigint as rounds, true as holds",
        "st_hourly": "select epoch_us(ts) // 3600000000 * 3600000000 as hour_us, user_id, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
        "st_replays": "select event_type, count(*) as n, count(distinct event_id) as events from events group by 1",
        "st_scored": f"select risk_level, {act('risk_level')} as action, count(*) as n from (select {level('(event_id % 1000) / 1000.0')} as risk_level from events where value is not null) group by 1, 2",
    }
    return out | {"src_edges_dash": out["src_edges_csv"], "src_features_dash": process, "prj_order": process, "snk_edges_csv": out["src_edges_csv"], "snk_features_csv": process}
