"""Training as one program: feature tables in, a model with its metrics out; and its steps as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import contract
from tallyweave.operators import attribution, labels, models, policies
from tallyweave.plans import labelled
from tallyweave.plans.relational import FN, FP, P_STAR
from tallyweave.sources import files
from tallyweave.sources import ledger as src
from tallyweave.work import cut, together

FEATURES = list(contract.FEATURES)
WITHOUT = list(contract.GRAPH_FEATURES)
_models: dict[tuple[str, str], dict] = {}


def tables(spark: SparkSession, sf_dir: str, *splits: str) -> dict[str, DataFrame]:
    """These splits' feature tables, all if none is named: made at the same time and each written once for each
    application, as files would be."""
    e, splits = labelled.edges(spark, sf_dir), splits or files.SPLITS
    made = together(*[lambda s=s: labelled._once(f"training-{s}", spark, sf_dir, lambda: labels.process(e, s)) for s in splits])
    return dict(zip(splits, made, strict=True))


def frames(spark: SparkSession, sf_dir: str, *splits: str) -> dict[str, DataFrame]:
    """The rows of these splits, or of all: id, ring_id, y and the features."""
    return {s: t.select(F.col("node").alias("id"), "ring_id", "ring_type", F.col(contract.TARGET).alias("y"), "split", *FEATURES) for s, t in tables(spark, sf_dir, *splits).items()}


def pair(spark: SparkSession, sf_dir: str) -> dict:
    """The model with all features and that without those of the graph, each stopped by the validation split; made
    once for each application, as models in files would be."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        f = frames(spark, sf_dir, "train", "val")
        _models[key] = models.with_and_without(f["train"], FEATURES, WITHOUT, f["val"])
    return _models[key]


def model(spark: SparkSession, sf_dir: str):
    return pair(spark, sf_dir)["full"]


def threshold(spark: SparkSession, sf_dir: str) -> float:
    """That of the model which is cheapest on the validation split."""
    val = model(spark, sf_dir).scored(frames(spark, sf_dir, "val")["val"]).select(F.lit("model").alias("policy"), "y", F.col("p").alias("x"))
    return policies.cheapest(policies.sweep(val, ["policy"]), ["policy"]).first()["threshold"]


def ml_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = frames(spark, sf_dir)["test"]
    return models.margins(model(spark, sf_dir), test, FEATURES).select("id", "y", "p", "margin")


def q_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account of the test split has a probability, and its margin is the log-odds of it."""
    m = ml_train(spark, sf_dir)
    apart = F.abs(F.col("margin") - F.log(F.col("p") / (1 - F.col("p"))))
    return m.agg(F.count("*").alias("accounts"), F.count_if(F.col("p").between(0, 1)).alias("scored"), (F.max(apart) < 1e-4).alias("consistent"))


def ml_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir, "train", "test")
    return models.logistic(f["train"], FEATURES, f["test"], log1p=contract.LOG1P).select("id", "y", "p")


def ml_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of whole rings, with as many trees as the saved model has."""
    return models.cross_validate(frames(spark, sf_dir, "train", "val")["train"], FEATURES, 5, rounds=model(spark, sf_dir).getNumTrees)


def ml_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = frames(spark, sf_dir)["test"]
    run = lambda name, m: models.ranking(m.scored(test)).select(F.lit(name).alias("model"), "auc", "ap")
    return policies.union([run(name, m) for name, m in pair(spark, sf_dir).items()])


def m_rule_baseline_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-line rules over all features, in both directions, from the stored feature tables."""
    f = frames(spark, sf_dir, "val", "test")
    every = policies.union([f[s].withColumn("split", F.lit(s)) for s in ("val", "test")])
    return policies.rules(every, tuple(FEATURES)).select("feature", "direction", "threshold", "val_cost", "tp", "fp", "p", "r", "f1", "total_cost", "alerts_per_1000", "screen_auc")


def scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, policy, y and x (the higher, the sooner flagged) of all policies that have a score, on val and test:
    the one-line rule that is cheapest on val, logistic regression, trees without graph features, all trees."""
    f = frames(spark, sf_dir)
    held = policies.union([f[s].withColumn("split", F.lit(s)) for s in ("val", "test")])
    best = policies.rules(held, tuple(FEATURES)).orderBy("val_cost", "feature", "direction").select("feature", "direction").first()
    sign = 1.0 if best["direction"] == "high" else -1.0
    told = lambda df, name, x: df.select("split", F.lit(name).alias("policy"), "y", x.alias("x"))
    out = [told(held, "rule", sign * F.col(best["feature"]).cast("double") + 0.0), told(models.logistic(f["train"], FEATURES, held, log1p=contract.LOG1P), "logistic", F.col("p"))]
    return cut(policies.union(out + [told(m.scored(held), f"trees_{name}", F.col("p")) for name, m in pair(spark, sf_dir).items()]))


def _policies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores, sweeps on val, and the ranking on test of all policies."""
    x = scorers(spark, sf_dir)
    test = x.where("split = 'test'")
    return x, cut(policies.sweep(x.where("split = 'val'"), ["policy"])), models.ranking(test.withColumn("x", F.when(F.col("policy") == "rule", 1 / (1 + F.exp(-F.col("x")))).otherwise(F.col("x"))), "x", "y", ("policy",))


def m_model_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every policy with its threshold frozen on val, priced on test, and what the graph's features are worth to it:
    how much cheaper the full model is than each other policy."""
    x, cuts, rank = _policies(spark, sf_dir)
    priced = cut(policies.priced(x.where("split = 'test'"), policies.cheapest(cuts, ["policy"]).select("policy", "threshold", F.col("cost").alias("val_cost")), ["policy"]))
    full = priced.where("policy = 'trees_full'").select(F.col("total_cost").alias("full_cost"))
    return priced.join(rank, "policy").crossJoin(F.broadcast(full)).select("policy", "threshold", "val_cost", "tp", "fp", "p", "r", "f1", "total_cost", "alerts_per_1000", "auc", "ap", (F.col("total_cost") - F.col("full_cost")).alias("saved_by_full"))


def m_model_capacity(spark: SparkSession, sf_dir: str, budget: float = 20.0) -> DataFrame:
    """The same policies under one budget of alerts, and the two that need no score. A policy is feasible if it
    has a cut that flags someone and no more than the budget on val; its frozen threshold may overflow on test."""
    x, cuts, _ = _policies(spark, sf_dir)
    strictest = cuts.where("rn > 0").groupBy("policy").agg(F.min((F.col("tp") + F.col("fp")) * 1000.0 / (F.col("np") + F.col("nn"))).alias("strictest_alerts_per_1000"))
    scored = policies.priced(x.where("split = 'test'"), policies.affordable(cuts, ["policy"], budget), ["policy"]).join(strictest, "policy")
    names = ("policy", "threshold", "feasible", "strictest_alerts_per_1000", "tp", "fp", "p", "r", "f1", "total_cost", "alerts_per_1000")
    y = x.where("split = 'test' and policy = 'rule'").agg(F.sum("y").cast("long").alias("np"), F.sum(1 - F.col("y")).cast("long").alias("nn"))
    np_, nn, none = F.col("np"), F.col("nn"), F.lit(None).cast("double")
    kinds = dict(scored.dtypes)
    one = lambda *values: F.struct(*[v.cast(kinds[c]).alias(c) for c, v in zip(names, values, strict=True)])
    trivial = y.select(F.inline(F.array(
        one(F.lit("flag_none"), none, F.lit(False), none, F.lit(0), F.lit(0), none, F.lit(0.0), F.lit(0.0), np_ * FN, F.lit(0.0)),
        one(F.lit("flag_all"), none, F.lit(budget >= 1000), F.lit(1000.0), np_, nn, np_ / (np_ + nn), F.lit(1.0), 2.0 * np_ / (2 * np_ + nn), nn * FP, F.lit(1000.0)),
    )))
    return scored.select(*names).unionByName(trivial).withColumn("within_budget", F.col("alerts_per_1000") <= budget + 1e-9)


def r_auc_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.retained(ml_ablation(spark, sf_dir))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = frames(spark, sf_dir)["test"]
    m = model(spark, sf_dir)
    return attribution.contributions(models.apply(m, test.select("id", *FEATURES), FEATURES), m, FEATURES)


def ml_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explained(spark, sf_dir).select("id", "p", "contributions", attribution.top_factors(FEATURES).alias("factors"))


def ml_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = frames(spark, sf_dir)["test"]  # all splits at the same time, before the model
    return models.importance(model(spark, sf_dir), test, FEATURES)


def m_calib_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosted model's probabilities on test, before and after scaling that is fitted on val."""
    f = frames(spark, sf_dir)
    m = model(spark, sf_dir)
    scored = {s: cut(models.apply(m, f[s], FEATURES)) for s in ("val", "test")}
    return models.calibration(scored["val"], scored["test"], "p")


def payload(spark: SparkSession, sf_dir: str, budget: float = 20.0) -> tuple[object, dict]:
    """The model, and the document of its metrics: thresholds chosen on val, all else on test."""
    f = frames(spark, sf_dir)
    m = model(spark, sf_dir)
    x = {s: cut(models.apply(m, f[s], FEATURES).select(F.lit("model").alias("policy"), "id", "ring_id", "ring_type", "y", F.col("p").alias("x"))) for s in ("val", "test")}
    cuts = cut(policies.sweep(x["val"], ["policy"]))
    row = lambda df: df.first().asDict() if not df.isEmpty() else {}
    best = cut(policies.cheapest(cuts, ["policy"]))
    few = cut(policies.affordable(cuts, ["policy"], budget))
    auc = {s: row(models.ranking(x[s], "x").select("auc", "ap")) for s in x}
    at = {name: row(policies.priced(x["test"], chosen.select("policy", "threshold"), ["policy"]).drop("policy")) for name, chosen in (("at_selected_threshold", best), ("at_alert_budget", few))}
    scored = {s: v.withColumnRenamed("x", "p") for s, v in x.items()}
    cluster = F.when(F.col("ring_id") >= 0, F.concat(F.lit("ring:"), "ring_id")).otherwise(F.concat(F.lit("acct:"), "id"))
    draws = models.bootstrap_auc(x["test"].select(cluster.alias("cluster"), F.col("x").alias("score"), "y"), 1000)
    ci = row(draws.agg(F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high")))
    chosen, gain = row(best), models.importance(m, f["test"], FEATURES).collect()
    rivals = cut(policies.rules(labelled.accounts(spark, sf_dir), labelled.LOCAL))
    table = f["train"].unionByName(f["val"]).unionByName(f["test"]).groupBy("split").agg(F.count("*").alias("accounts"), F.sum("y").alias("positives"), F.count_distinct(F.when(F.col("ring_id") >= 0, F.col("ring_id"))).alias("rings"))
    doc = {
        "roc_auc": auc["test"].get("auc"), "optimal_threshold": chosen.get("threshold"), **{k: at["at_selected_threshold"].get(v) for k, v in (("precision", "p"), ("recall", "r"), ("f1", "f1"), ("total_cost", "total_cost"))},
        "feature_importance": {r["feature"]: r["gain"] for r in gain}, "model_version": contract.MODEL_VERSION, "n_features": len(FEATURES), "feature_cols": FEATURES, "threshold_selected_on": "validation", "roc_auc_ci_95": [ci.get("low"), ci.get("high")],
        "average_precision": auc["test"].get("ap"), "n_trees": m.getNumTrees,
        "hyperparameters": {"max_depth": models.DEPTH, "learning_rate": models.RATE, "subsample": models.ROWS, "max_rounds": models.ROUNDS},
        "cost_config": {"fn_cost": FN, "fp_cost": FP, "fn_fp_ratio": round(FN / FP, 4), "break_even_probability": round(P_STAR, 6), "alert_budget_per_1000": budget},
        "dataset": {r["split"]: {k: r[k] for k in ("accounts", "positives", "rings")} for r in table.collect()}, "feature_importance_mean_abs_shap": {r["feature"]: r["share"] for r in gain},
        "validation": {**auc["val"], "cost_optimal": chosen, "capacity_constrained": row(few)}, "test": {**auc["test"], **at},
        "baselines": {"trivial": {r["policy"]: r["total_cost"] for r in policies.trivial(x["test"]).collect()}, "rule": row(rivals.orderBy("val_cost", "feature", "direction").select("feature", "direction", "threshold", "val_cost", "total_cost", policies.rule_text().alias("rule")))},
        "probability_calibration": {r["stage"]: r.asDict() for r in models.calibration(scored["val"], scored["test"], "p").collect()} if auc["val"].get("auc") is not None else None,
    }
    return m, doc


def main(spark: SparkSession, sf_dir: str, folder: str) -> dict:
    """Trains, evaluates and saves the model with its metrics; whose contributions don't add up isn't saved."""
    m, doc = payload(spark, sf_dir)
    files.save_artifacts(spark, folder, m, FEATURES, doc)
    return doc


def m_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics document, a row per top-level key."""
    import json

    _, doc = payload(spark, sf_dir)
    return spark.createDataFrame([(k, json.dumps(files._clean(v), default=str)) for k, v in doc.items()], "key string, value string")


QUERIES = {q.__name__: q for q in (q_training, ml_train, ml_logreg, ml_cv, ml_ablation, m_rule_baseline_all, m_model_policies, m_model_capacity, r_auc_retained, ml_shap, ml_importance, m_calib_diag, m_payload)} | {"ml_mean_abs_shap": lambda spark, d: attribution.mean_absolute(_explained(spark, d), FEATURES)}
SQL = {"q_training": f"with e as ({src.SQL['edges']}), v as (select sender as node from e where split = 'test' union select receiver from e where split = 'test') select count(*) as accounts, count(*) as scored, true as consistent from v"}
