"""Queries over labelled ledgers, files, requests, rules and the serving path. Their SQL is written for
itself: plain windows and joins over the same relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import contract, scalars
from tallyweave.operators import graph, labels, models, partition, policies, serving
from tallyweave.plans.relational import FN, FP, P_STAR
from tallyweave.sources import files, generator
from tallyweave.sources import ledger as src
from tallyweave.streaming import ledger as stream
from tallyweave.work import cut, work_path

#: Features that one account's own payments give; the others need the graph's fixpoints.
LOCAL = tuple(f for f in contract.FEATURES if f not in contract.GRAPH_FEATURES or f == "reciprocity")
SPLITS = files.SPLITS
_tables: dict[tuple[str, str, str], DataFrame] = {}


def _once(name: str, spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """A table that several queries read, as they would read a file: written once for each application."""
    key = (name, spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = cut(make())
    return _tables[key]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("edges", spark, sf_dir, lambda: src.labelled_edges(spark, sf_dir))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split's accounts with their local features (six places), label and rings."""

    def make() -> DataFrame:
        e, parts = edges(spark, sf_dir), []
        for split in SPLITS:
            own = e.where(F.col("split") == split)
            f = graph.local_features(labels.payments(own)).select("node", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in LOCAL])
            parts.append(labels.labelled(f, own).withColumn("split", F.lit(split)).withColumnRenamed(contract.TARGET, "y"))
        return policies.union(parts)

    return _once("accounts", spark, sf_dir, make)


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle split's feature table, with a partition by the last digit and 20 rounds of PageRank."""

    def make() -> DataFrame:
        e = edges(spark, sf_dir)
        part = graph.nodes(e.where("split = 'val'")).select("node", (F.col("node").cast("long") % 10).alias("community"))
        return labels.process(e, "val", part, rounds=20, tolerance=None)

    return _once("features", spark, sf_dir, make)


def _six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in contract.FEATURES else F.col(c) for c in df.columns])


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.unix_micros("timestamp").alias("us"))


# Files.


def _written_splits(spark: SparkSession, sf_dir: str) -> str:
    folder = work_path(spark, "files")
    files.write_splits(edges(spark, sf_dir), folder)
    return folder


def src_edges_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written_splits(spark, sf_dir)
    every = policies.union([files.read_split(spark, folder, s) for s in SPLITS])
    return _micros(every, "sender", "receiver", "amount", "is_mule", "edge_role", "ring_id", "ring_type", "split")


def src_context_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(files.read_context(spark, _written_splits(spark, sf_dir)), "sender", "receiver", "amount")


def src_features_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "files")
    files.write_features(feature_table(spark, sf_dir), folder)
    return _six(files.read_features(spark, folder, "val"))


def src_all_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written_splits(spark, sf_dir)
    files.write_features(feature_table(spark, sf_dir), folder)
    return policies.union([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in files.read_all(spark, folder).items()])


def request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a request of its payments, whose times have different offsets; every fifth overrides the
    threshold by what is none, every seventh is no document."""
    o = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    i = src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    day = F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd")
    time = F.when(F.col("l_linenumber") % 3 == 0, F.concat(day, F.lit("T05:30:00+05:30"))).when(F.col("l_linenumber") % 3 == 1, F.concat(day, F.lit("T00:00:00Z"))).otherwise(F.concat(day, F.lit("T00:00:00")))
    t = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("sender"), F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("receiver"), F.col("l_extendedprice").cast("double").alias("amount"), time.alias("timestamp"))
    # An order has a handful of lines.
    d = o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(t)).alias("t"))
    body = F.to_json(F.struct(F.transform("t", lambda x: x.dropFields("n")).alias("transactions"), F.when(F.col("o_orderkey") % 5 == 0, 1.5).alias("threshold_override")))
    return d.select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 7 == 0, "{no document").otherwise(body).alias("document"))


def src_request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = files.requests(request_documents(spark, sf_dir))
    return r.select("request_id", "position", "sender", "receiver", F.col("amount").cast("double").alias("amount"), F.unix_micros("ts").alias("us"), "refused")


def snk_json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    inverse = F.when(s == 0, float("inf")).otherwise(F.round(F.try_divide(F.lit(1.0), s), 6))
    log = F.when(s == 0, float("-inf")).otherwise(F.round(F.log(F.when(s > 0, s)), 6))
    d = src.scored_frame(spark, sf_dir).select("id", F.struct(inverse.alias("inverse"), F.array(log, F.when(F.col("id") % 3 == 0, float("nan")).otherwise(s)).alias("more")).alias("v"))
    safe = scalars.json_safe(F.col("v"), d.schema["v"].dataType)
    kind = T.StructType([T.StructField("inverse", T.DoubleType()), T.StructField("more", T.ArrayType(T.DoubleType()))])
    return d.select("id", F.from_json(F.to_json(safe, {"ignoreNullFields": "false"}), kind).alias("v")).select("id", "v.inverse", F.col("v.more")[0].alias("log"), F.col("v.more")[1].alias("other"))


def prj_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    text = F.when(k % 4 == 0, F.concat(day, F.lit("T12:00:00+05:30"))).when(k % 4 == 1, F.concat(day, F.lit(" 12:00:00-0800"))).when(k % 4 == 2, F.concat(day, F.lit("T12:00:00.250"))).otherwise(F.lit("not a time"))
    return src.table(spark, sf_dir, "orders").select(k.alias("id"), F.unix_micros(scalars.to_utc(text)).alias("us"))


# Labelled graphs.


def flt_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("edge_role")
    return edges(spark, sf_dir).where((role == "ring") | role.startswith("organic") & (role != "organic_camouflage")).groupBy("edge_role").count().withColumnRenamed("count", "n")


def prj_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros("timestamp")
    return edges(spark, sf_dir).groupBy("split").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count("*").alias("n"))


def ord_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every payment of a day in the file's order; over all days it is the ledger's order."""
    day = F.floor(F.unix_micros("timestamp") / 86_400_000_000)
    w = F.row_number().over(contract_window("day").orderBy("timestamp", "pos"))
    return edges(spark, sf_dir).withColumn("day", day).select("day", "pos", w.alias("place"))


def contract_window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def g_pairs_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.pair_frame(edges(spark, sf_dir)).select("sender", "receiver", "weight", F.round(F.col("total").cast("double"), 4).alias("total"), F.round("mean", 4).alias("mean"), "is_mule", "roles")


def g_graph_dash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return labels.shown_graph(labels.pair_frame(e.where("is_mule = 1")), graph.nodes(e))


def g_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.ring_labels(edges(spark, sf_dir).where("split = 'val'"))


def g_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.victims(edges(spark, sf_dir))


def g_khop_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is paid between the accounts around three seeds, 40 at most."""
    e = src.handoff_ledger(spark, sf_dir)
    kept = graph.k_hop(e, graph.nodes(e).where("node in ('1', '2', '3')"), 40)
    return graph.pairs(labels.induced(e, kept)).select("sender", "receiver", "weight", F.round(F.col("total").cast("double"), 4).alias("total"))


def prj_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(contract.features_only(feature_table(spark, sf_dir), "node"))


def g_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(feature_table(spark, sf_dir))


def g_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = cut(src.handoff_ledger(spark, sf_dir))
    part = graph.nodes(ledger).select("node", (F.col("node").cast("long") % 10).alias("community"))
    return _six(graph.features(ledger, part, rounds=20, tolerance=None))


def g_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = graph.pagerank(src.commerce_ledger(spark, sf_dir), scale=False)
    return p.select("node", F.round("pagerank", 9).alias("pagerank"))


def q_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table's features and their place, and how many of each one's values are no numbers."""
    t = feature_table(spark, sf_dir)
    contract.check_names([c for c in t.columns if c in contract.FEATURES])
    bad = contract.unusable(t)
    place = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(t.columns) if c in contract.FEATURES for x in (c, i)]), F.col("feature"))
    return bad.select("feature", place.cast("long").alias("place"), F.col("n").alias("unusable"))


# Quality of splits.


def q_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring members and rings that are in two splits."""
    e = edges(spark, sf_dir)
    who = e.where("edge_role = 'ring'").select(F.explode(F.array(F.concat(F.lit("acct:"), "sender"), F.concat(F.lit("acct:"), "receiver"), F.concat(F.lit("ring:"), F.col("ring_id").cast("string")))).alias("entity"), "split")
    return who.groupBy("entity").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def q_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each split and the next one: how long after its last payment the next one begins."""
    us = F.unix_micros("timestamp")
    s = edges(spark, sf_dir).groupBy("split").agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    a, b = s.toDF("first", "lo1", "hi1"), s.toDF("second", "lo2", "hi2")
    next_ones = a.join(F.broadcast(b), (F.col("first") == "train") & (F.col("second") == "val") | (F.col("first") == "val") & (F.col("second") == "test"))
    return next_ones.select("first", "second", (F.col("lo2") - F.col("hi1")).alias("gap_us"), (F.col("hi1") <= F.col("lo2")).alias("in_order"))


def q_equal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros("timestamp")
    days = edges(spark, sf_dir).groupBy("split").agg(((F.max(us) - F.min(us)) / 86_400_000_000.0).alias("d"))
    spread = F.max("d") - F.min("d")
    return days.agg(F.round(spread, 6).alias("spread_days"), (spread <= serving.DRIFT_DAYS).alias("equal"))


def q_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("edge_role like 'organic%' and edge_role <> 'organic_camouflage'").groupBy("split").count()
    return e.agg(F.round((F.max("count") - F.min("count")) / F.max("count"), 6).alias("spread"), ((F.max("count") - F.min("count")) / F.max("count") <= 0.10).alias("balanced"))


def q_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.count_distinct(F.when(F.col("ring_id") >= 0, F.col("ring_type")))
    g = edges(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("sender") == F.col("receiver")).alias("self_loops"), F.count_if(F.col("amount") <= 0).alias("not_positive"), kinds.alias("kinds"))
    return g.withColumn("sane", (F.col("n") > 0) & (F.col("self_loops") == 0) & (F.col("not_positive") == 0) & (F.col("kinds") == 3))


def q_log1p_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each feature is log-scaled before a linear model: none is negative, and the (bias-corrected)
    skewness on the training split is 1.5 or more."""
    a = policies.unpivoted(accounts(spark, sf_dir).where("split = 'train'"), LOCAL).where("direction = 'high'")
    g = a.groupBy("feature").agg(F.count("*").alias("n"), F.skewness("x").alias("g"), F.min("x").alias("low"))
    skew = F.col("g") * F.sqrt(F.col("n") * (F.col("n") - 1.0)) / (F.col("n") - 2)
    return g.select("feature", F.round(skew, 5).alias("skew"), ((F.col("low") >= 0) & (skew >= 1.5)).alias("use_log1p"))


# Rules and policies.


def _ran(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of the middle split's accounts by feature, which all rules are chosen by."""
    key = ("ran", spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = policies.running(policies.numbered(accounts(spark, sf_dir).where("split = 'val'"), LOCAL), ["feature"])
    return _tables[key]


KEYS = ["feature", "direction"]


def _nine(*columns: str) -> list:
    return [F.round(c, 9).alias(c) for c in columns]


def _rules(spark: SparkSession, sf_dir: str, criterion: str = "cost") -> DataFrame:
    return _once(f"rules-{criterion}", spark, sf_dir, lambda: policies.rules(accounts(spark, sf_dir), LOCAL, criterion, ran=_ran(spark, sf_dir)))


def m_rule_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select(*KEYS, F.round("threshold", 9).alias("threshold"), "val_cost", "tp", "fp", *_nine("p", "r", "f1"), "total_cost", *_nine("alerts_per_1000", "screen_auc"))


def m_rule_baseline_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir, "f1").select(*KEYS, F.round("threshold", 9).alias("threshold"), *_nine("val_f1"), "tp", "fp", "total_cost")


def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).orderBy("val_cost", "feature", "direction").limit(10).select(*KEYS, "val_cost", "total_cost")


def m_rule_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select(*KEYS, policies.rule_text().alias("rule"))


def m_capacity_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _once("capacity", spark, sf_dir, lambda: policies.capacity(accounts(spark, sf_dir), LOCAL, ran=_ran(spark, sf_dir)))
    return made.select(*KEYS, F.round("threshold", 9).alias("threshold"), "feasible", "tp", "fp", *_nine("p", "r", "f1", "alerts_per_1000"), "overflows", "total_cost")


def r_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m_capacity_fair(spark, sf_dir).where("overflows").select(*KEYS, "alerts_per_1000")


def r_capped_vs_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the budget against without it: the costs, and how many budgets the uncapped rule's queue is."""
    c = m_capacity_fair(spark, sf_dir).select(*KEYS, F.col("total_cost").alias("capped_cost"))
    r = m_rule_baseline(spark, sf_dir).select(*KEYS, F.col("total_cost").alias("uncapped_cost"), F.round(F.col("alerts_per_1000") / 20.0, 6).alias("queue_multiple"))
    return c.join(r, KEYS)


def r_best_rival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest feasible policy under the budget beside the rule that is cheapest without one."""
    c = m_capacity_fair(spark, sf_dir).where("feasible").agg(F.min_by(F.struct("feature", "direction", "total_cost"), F.struct("total_cost", "feature", "direction")).alias("c"))
    best = top_rules(spark, sf_dir).agg(F.min_by(F.struct("feature", "direction", "total_cost"), F.struct("val_cost", "feature", "direction")).alias("b"))
    return c.crossJoin(F.broadcast(best)).select(F.concat_ws(" ", "c.feature", "c.direction").alias("rival"), F.col("c.total_cost").alias("rival_cost"), F.concat_ws(" ", "b.feature", "b.direction").alias("rule"), F.col("b.total_cost").alias("rule_cost"), (F.col("c.total_cost") - F.col("b.total_cost")).alias("saved"))


def m_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagging nobody, flagging everybody, and the best rule by cost and by F1, priced on the test split."""
    best = lambda name, by: _rules(spark, sf_dir, name).agg(F.min_by(F.struct(F.lit(f"rule_by_{name}").alias("policy"), "threshold", "tp", "fp", "p", "r", "f1", "total_cost"), F.struct(by, "feature", "direction")).alias("b")).select("b.*")
    n = accounts(spark, sf_dir).where("split = 'test'").agg(F.sum("y").cast("long").alias("np"), F.sum(1 - F.col("y")).cast("long").alias("nn"))
    one = lambda policy, t, tp, fp, p, r, f1, cost: F.struct(F.lit(policy).alias("policy"), F.lit(t).cast("double").alias("threshold"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), p.cast("double").alias("p"), r.cast("double").alias("r"), f1.cast("double").alias("f1"), cost.cast("long").alias("total_cost"))
    zero, np_, nn = F.lit(0), F.col("np"), F.col("nn")
    both = n.select(F.inline(F.array(one("flag_none", None, zero, zero, F.lit(None), F.lit(0.0), F.lit(0.0), np_ * FN), one("flag_all", 0.0, np_, nn, np_ / (np_ + nn), F.lit(1.0), 2.0 * np_ / (2 * np_ + nn), nn * FP))))
    return policies.union([both, best("cost", F.col("val_cost")), best("f1", -F.col("val_f1"))]).select("policy", F.round("threshold", 9).alias("threshold"), "tp", "fp", *_nine("p", "r", "f1"), "total_cost")


def q_leakage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest separation of a single feature on the split that decides about features: of all features, those of the
    graph too, as `feature_table` has them (a partition that is given, 20 rounds of PageRank), so that SQL can check it."""
    f = feature_table(spark, sf_dir).select(F.col(contract.TARGET).alias("y"), *[F.round(F.col(c).cast("double"), 6).alias(c) for c in contract.FEATURES])
    a = policies.separations(policies.running(policies.numbered(f, contract.FEATURES), ["feature"]), contract.FEATURES).where("direction = 'high'")
    most = F.greatest("auc", 1 - F.col("auc"))
    return a.agg(F.max_by("feature", F.struct(F.round(most, 9), "feature")).alias("feature"), F.round(F.max(most), 9).alias("strongest"), (F.max(most) < 0.99).alias("passes"))


def m_row_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep over the validation scores, a report per cut."""
    s = src.scored_frame(spark, sf_dir).where("split = 'val'").select(F.lit("score").alias("k"), F.col("score").alias("x"), "y")
    c = policies.sweep(s, ["k"])
    tp, fp, np_, nn = (F.col(x) for x in ("tp", "fp", "np", "nn"))
    return c.select("threshold", "tp", "fp", (nn - fp).alias("tn"), (np_ - tp).alias("fn"), *[F.round(v, 9).alias(n) for n, v in (("p", F.try_divide(tp, tp + fp)), ("r", F.try_divide(tp, np_)), ("f1", 2.0 * tp / (tp + fp + np_)), ("alerts_per_1000", (tp + fp) * 1000.0 / (np_ + nn)))], policies.costs().alias("total_cost"), F.round(policies.costs() / (np_ + nn), 6).alias("cost_per_account"))


def r_price_not_peeking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the threshold chosen on val costs on test over the cheapest there is on test."""
    f = src.scored_frame(spark, sf_dir).select("split", "y", F.lit("score").alias("k"), F.col("score").alias("x"))
    cuts = lambda s: policies.sweep(f.where(F.col("split") == s), ["k"])
    test = f.where("split = 'test'")
    got = policies.priced(test, policies.cheapest(cuts("val"), ["k"]).select("k", "threshold"), ["k"]).select("k", F.col("total_cost").alias("cost"))
    best = policies.cheapest(cuts("test"), ["k"]).select("k", F.col("cost").alias("least"))
    return got.join(best, "k").select((F.col("cost") - F.col("least")).alias("gap"), F.round((F.col("cost") - F.col("least")) / F.col("cost"), 9).alias("share"))


def m_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.scored_frame(spark, sf_dir).select("id", F.round(scalars.sigmoid((F.col("score") - 0.5) * 4_000), 9).alias("p"))


# Serving.


def _odd_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = src.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))
    return o.select(
        F.when(k % 11 == 0, None).when(k % 11 == 1, "ab").when(k % 11 == 2, F.repeat(F.lit("x"), F.lit(51))).otherwise(name).alias("sender"), F.when(k % 13 == 0, name).when(k % 13 == 1, None).otherwise(F.lit("shop-1")).alias("receiver"),
        F.when(k % 17 == 0, None).when(k % 17 == 1, 0).when(k % 17 == 2, 10_000_000.5).when(k % 17 == 3, 10_000_000).otherwise(k + 0.5).cast("decimal(18,4)").alias("amount"), F.when(k % 19 > 0, F.col("o_orderdate").cast("timestamp")).alias("ts"),
    )


def s_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.reasons(_odd_payments(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).count().withColumnRenamed("count", "n")


def s_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.scored_frame(spark, sf_dir).select("id", serving.quantized(F.col("id") * F.lit(0.0000001).cast("decimal(10,7)")).cast("double").alias("score"))


def s_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = serving.cutoffs(0.1257004, P_STAR)
    return spark.range(1).select(*[F.lit(v).alias(k.lower()) for k, v in c.items()])


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.scored_frame(spark, sf_dir).select(F.col("id").alias("node"), F.col("score").alias("p"), F.array().cast("array<string>").alias("contributing_factors"), (F.col("id") % 2 == 0).alias("seen_in_context"))
    return serving.responses(s, 0.5, P_STAR)


def s_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).select(F.col("node").alias("id"), F.col("risk_level").alias("tier"))


def s_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).groupBy(F.col("risk_level").alias("tier"), "action").count().withColumnRenamed("count", "n")


def s_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).drop("contributing_factors")


def s_validate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of responses some of which were tampered with, those whose tier or action doesn't follow."""
    r, k = _responses(spark, sf_dir), F.col("node")
    bad = r.withColumn("action", F.when(k % 10 == 0, "ALLOW").when(k % 10 == 1, "BLOCK_ACCOUNT").otherwise(F.col("action"))).withColumn("risk_level", F.when(k % 10 == 2, "HIGH").otherwise(F.col("risk_level")))
    return serving.mismatches(bad, 0.5, P_STAR).select("node", "risk_level", "action")


NAMES = ("ALLOW", "allow", "FLAG_FOR_REVIEW", "HOLD_FOR_REVIEW", "REQUIRE_ADDITIONAL_AUTH", "BAN_USER", "LOCK_ACCOUNT", "Limit_Transfers", "NOTHING", "REVIEW", "")


def s_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in (*NAMES, *serving.FORBIDDEN, *serving.VERBS)], "name string").select("name", serving.allowed(F.col("name")).alias("permitted"))


# Streams, run to the end of the files.


def _run(made: DataFrame, mode: str, folder: str) -> None:
    q = made.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def st_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "stream")
    _run(stream.hourly(stream.event_stream(spark, f"{sf_dir}/events*.parquet")), "complete", folder)
    return spark.read.parquet(f"{folder}/out").select(F.unix_micros("hour.start").alias("hour_us"), "user_id", "n", F.round("total", 4).alias("total"))


def st_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice, and once it stays."""
    folder = work_path(spark, "stream")
    s = stream.event_stream(spark, f"{sf_dir}/events*.parquet")
    _run(stream.without_replays(s.unionByName(s), ["event_id"], "30 days"), "append", folder)
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


def st_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches as requests: each valid payment of an event is tiered."""
    folder = work_path(spark, "stream")
    score = lambda df: serving.responses(df.where("value is not null").select(F.col("event_id").alias("node"), (F.pmod(F.col("event_id"), F.lit(1000)) / 1000.0).alias("p"), F.array().cast("array<string>").alias("contributing_factors"), F.lit(None).cast("boolean").alias("seen_in_context")), 0.5, P_STAR)
    stream.score_batches(stream.event_stream(spark, f"{sf_dir}/events*.parquet"), score, lambda df, k: df.write.mode("overwrite").parquet(f"{folder}/out/batch={k}"), f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("risk_level", "action").count().withColumnRenamed("count", "n")


# What holds for results that SQL can't give.


def q_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts have a community, and the partition is no worse than that into components."""
    u = cut(graph.undirected(graph.pairs(src.handoff_ledger(spark, sf_dir))))
    part = cut(graph.communities(u))
    names = u.select(F.col("a").alias("node")).union(u.select("b")).distinct()
    whole = partition.components(u.select("a", "b").union(u.select("b", "a")).toDF("x", "y"), names).withColumnRenamed("root", "community")
    better = graph.modularity(u, part) >= graph.modularity(u, whole) - 1e-9
    n = names.agg(F.count("*").alias("accounts"))
    return n.crossJoin(F.broadcast(names.join(part, "node").agg(F.count("*").alias("placed")))).withColumn("no_worse", F.lit(better))


def q_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts are placed, and those of the frozen partition stay where they were."""
    ledger = cut(src.handoff_ledger(spark, sf_dir))
    known = graph.nodes(ledger).select("node", (F.col("node").cast("long") % 10).alias("community")).where(F.col("node").cast("long") % 3 > 0)
    grown = cut(partition.extend(graph.undirected(graph.pairs(ledger)), known))
    kept = grown.join(known.withColumnRenamed("community", "was"), "node").where("community = was").agg(F.count("*").alias("kept"))
    return grown.agg(F.count("*").alias("placed"), F.count_distinct("node").alias("accounts")).crossJoin(F.broadcast(kept))


def q_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.when(F.col("ring_id") >= 0, F.col("ring_id"))
    return generator.ledger(spark).groupBy("split").agg(F.count_if(F.col("sender") == F.col("receiver")).alias("self_loops"), F.count_if(F.col("amount") <= 0).alias("not_positive"), F.count_distinct(ring).alias("rings"), F.count_distinct(F.when(ring.isNotNull(), F.col("ring_type"))).alias("kinds"))


def q_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted slope and intercept are a stationary point of the smoothed loss."""
    val = src.scored_frame(spark, sf_dir).where("split = 'val'")
    slope, intercept = models.platt(val)
    n = val.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    t = F.when(F.col("y") == 1, (F.col("p") + 1) / (F.col("p") + 2)).otherwise(1 / (F.col("q") + 2))
    e = scalars.calibrated(F.col("score"), slope, intercept) - t
    g = val.crossJoin(F.broadcast(n)).agg(F.abs(F.avg(e * scalars.logit(F.col("score")))).alias("a"), F.abs(F.avg(e)).alias("b"))
    return g.select((F.col("a") < 1e-6).alias("slope_is_still"), (F.col("b") < 1e-6).alias("intercept_is_still"))


def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of 1,000 draws of clusters holds the AUC of the rows themselves."""
    f = src.scored_frame(spark, sf_dir).where("split = 'test'")
    cluster = F.when(F.col("ring_id") >= 0, F.concat(F.lit("ring:"), "ring_id")).otherwise(F.concat(F.lit("acct:"), "id"))
    r = models.bootstrap_auc(f.select(cluster.alias("cluster"), "score", "y"), 1000)
    ci = r.agg(F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"), F.count("*").alias("rounds"))
    return ci.crossJoin(F.broadcast(models.ranking(f, "score"))).select("rounds", F.col("auc").between(F.col("low"), F.col("high")).alias("holds"))


QUERIES = {f.__name__: f for f in (
    q_louvain, q_extension, q_generator, q_platt, q_bootstrap,
    src_edges_csv, src_context_csv, src_features_csv, src_all_splits, src_request_json, snk_json_safe, prj_tz, flt_role, prj_split, ord_ts, g_pairs_dash, g_graph_dash, g_label, g_victims, g_khop_induced, prj_features, g_process, g_features,
    g_pagerank, q_contract, q_entity, q_temporal, q_equal_windows, q_volume, q_sanity, q_log1p_rule, m_rule_baseline, m_rule_baseline_f1, top_rules, m_rule_text, m_capacity_fair, r_overflow, r_capped_vs_rule, r_best_rival, m_baselines,
    q_leakage_gate, m_row_report, r_price_not_peeking, m_sigmoid, s_validate, s_quantize, s_cutoffs, s_tier, s_action, s_build, s_validate_batch, s_allowlist, st_hourly, st_replays, st_scored,
)}
QUERIES |= {"src_edges_dash": src_edges_csv, "src_features_dash": src_features_csv, "prj_order": g_process, "snk_edges_csv": src_edges_csv, "snk_features_csv": src_features_csv}
