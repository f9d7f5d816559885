"""Scoring a batch of payments against a frozen context: validation, merging, tiers, actions, responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import contract
from tallyweave.operators import attribution, graph, partition
from tallyweave.sources import files
from tallyweave.work import cut

DAY = 86_400_000_000
DRIFT_DAYS = 1.5
BIAS_TOLERANCE = 1e-6
# The only actions there are, each tier's action, and what no action may be called. All leave
# the decision to a person; no action blocks anything.
PERMITTED = ("ALLOW", "FLAG_FOR_REVIEW", "HOLD_FOR_REVIEW", "REQUIRE_ADDITIONAL_AUTH")
ACTIONS = {"CRITICAL": "HOLD_FOR_REVIEW", "HIGH": "HOLD_FOR_REVIEW", "MEDIUM": "REQUIRE_ADDITIONAL_AUTH", "LOW": "ALLOW"}
FORBIDDEN = ("BAN_USER", "BLOCK_ACCOUNT", "FREEZE_FUNDS", "SUSPEND_ACCOUNT", "TERMINATE_USER", "AUTO_BLOCK", "AUTO_BAN")
VERBS = ("BAN", "BLOCK", "FREEZE", "SUSPEND", "TERMINATE", "DISABLE", "REVOKE", "SEIZE", "CLOSE", "LOCK", "QUARANTINE", "RESTRICT", "HALT", "BLACKLIST", "DENY", "LIMIT", "REVERSE")


class DefenseOnlyError(ValueError):
    """An action that isn't one of those that leave the decision to a person."""


def allowed(name: Column) -> Column:
    """Whether a name is a permitted action and holds no forbidden name or verb, in any case. Null is none."""
    upper = F.upper(name)
    forbidden = upper.isin(*FORBIDDEN)
    for verb in VERBS:
        forbidden = forbidden | upper.contains(verb)
    return F.coalesce(upper.isin(*PERMITTED) & ~forbidden, F.lit(False))


def check_actions(names: tuple[str, ...] | list[str]) -> None:
    """Raises if one of the names isn't permitted, is forbidden or has a forbidden verb in it."""
    for name in names:
        upper = name.upper()
        if upper not in PERMITTED or upper in FORBIDDEN or any(verb in upper for verb in VERBS):
            raise DefenseOnlyError(f"{name} is no action that leaves the decision to a person")


check_actions([*PERMITTED, *ACTIONS.values()])


def reasons(batch: DataFrame) -> DataFrame:
    """batch with `reason`: why a payment is refused, null if it isn't. Nulls are refused."""
    size = lambda c: F.coalesce(F.length(c).between(3, 50), F.lit(False))
    amount = F.coalesce((F.col("amount") > 0) & (F.col("amount") <= 10_000_000), F.lit(False))
    return batch.withColumn("reason", F.when(~size("sender"), "sender").when(~size("receiver"), "receiver").when(~amount, "amount").when(F.col("ts").isNull(), "ts").when(F.col("sender") == F.col("receiver"), "self"))


def merge(batch: DataFrame, context: DataFrame, days: float) -> DataFrame:
    """The context's last `days` (anchored at its own end) and all of the batch, with `origin` 0 or 1 and
    `copies`: how often it was given (`old` in the context, `new` in the batch). The context's row wins."""
    end = context.agg(F.max(F.unix_micros("ts")).alias("hi"))
    kept = context.crossJoin(F.broadcast(end)).where(F.unix_micros("ts").between(F.col("hi") - int(days * DAY), F.col("hi")))
    both = kept.select(*graph_columns(), F.lit(0).alias("origin")).unionByName(batch.select(*graph_columns(), F.lit(1).alias("origin")))
    # Replays are counted by map-side aggregation, so a payment repeated without end isn't one task's work.
    n = both.groupBy(*graph_columns()).agg(F.sum(1 - F.col("origin")).alias("old"), F.sum("origin").alias("new"))
    return n.select(*graph_columns(), F.when(F.col("old") > 0, 0).otherwise(1).alias("origin"), (F.col("old") + F.col("new")).alias("copies"), "old", "new")


def graph_columns() -> list[str]:
    return ["sender", "receiver", "amount", "ts"]


def diagnostics(merged: DataFrame, context: DataFrame, days: float) -> DataFrame:
    """One row: used context payments, submitted ones, dropped replays, the observed window, whether it is
    comparable with the trained one, and how many submitted payments lie outside the context's window."""
    hi = context.agg(F.max(F.unix_micros("ts")).alias("hi"))
    us = F.unix_micros("ts")
    late, early = us > F.col("hi"), us < F.col("hi") - int(days * DAY)
    d = merged.crossJoin(F.broadcast(hi)).agg(
        F.coalesce(F.sum("old"), F.lit(0)).alias("n_context"), F.coalesce(F.sum("new"), F.lit(0)).alias("n_submitted"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_dropped"),
        F.coalesce(F.sum(F.when(late, F.col("new"))), F.lit(0)).alias("n_late"), F.coalesce(F.sum(F.when(early, F.col("new"))), F.lit(0)).alias("n_early"), F.coalesce((F.max(us) - F.min(us)) / float(DAY), F.lit(0.0)).alias("observed_days"),
    )
    return d.withColumn("comparable", F.abs(F.col("observed_days") - days) <= DRIFT_DAYS)


def quantized(x: Column) -> Column:
    """Scores as they are reported and compared: six places, halves to even."""
    return F.bround(x, 6)


def cutoffs(threshold: float, break_even: float) -> dict[str, float]:
    """The least score of each tier but the lowest. Threshold and break-even are rounded as scores are; the
    critical one lies half-way from there to 1 and is left as it is."""
    if not 0 < threshold <= 1 or not 0 < break_even <= 1:
        raise ValueError("threshold and break-even must lie between 0 and 1")
    t = round(threshold, 6)
    return {"CRITICAL": t + (1 - t) / 2, "HIGH": t, "MEDIUM": min(round(break_even, 6), t)}


def tier(score: Column, threshold: float, break_even: float) -> Column:
    """Of a score from 0 to 1; others fail."""
    least = cutoffs(threshold, break_even)
    s = quantized(score)
    checked = F.when(score.between(0, 1), s).otherwise(F.raise_error(F.lit("a score lies outside of 0 to 1")).cast("double"))
    return F.when(checked >= least["CRITICAL"], "CRITICAL").when(checked >= least["HIGH"], "HIGH").when(checked >= least["MEDIUM"], "MEDIUM").otherwise("LOW")


def action(level: Column) -> Column:
    chosen = F.raise_error(F.lit("unknown tier"))
    for name, act in ACTIONS.items():
        chosen = F.when(level == name, act).otherwise(chosen)
    return chosen


def mismatches(responses: DataFrame, threshold: float, break_even: float) -> DataFrame:
    """Responses whose tier or action isn't what their score gives, or whose action isn't permitted; must be
    empty."""
    wrong = lambda t: ~F.col("risk_level").eqNullSafe(t) | ~F.col("action").eqNullSafe(action(t)) | ~allowed(F.col("action"))
    # The tier is computed once, as the element of an array that the rest refers to.
    return responses.where(F.exists(F.array(tier(F.col("risk_score"), threshold, break_even)), wrong))


def attributed(scored: DataFrame, model, features: list[str], explain=attribution.contributions, k: int = 3) -> tuple[DataFrame, list[str]]:
    """scored (features, p) with contributing_factors, and warnings. The factors of all are withheld, and a
    warning says why, if contributions and bias don't add up to the model's log-odds (each within 1e-4), if a row has
    no sum or no log-odds to compare, or if the bias isn't one number: then names and contributions don't belong
    together. Scores stay as they are; a failure to score isn't one to explain, and is raised."""
    none = F.array().cast("array<struct<feature:string,description:string,value:double,contribution:double,effect:string>>")
    scored = cut(scored)
    try:
        explained = cut(explain(scored, model, features))
    except Exception as e:  # the explanation may fail, the score must not
        why = (str(e).splitlines() or [""])[0][:200]
        return scored.withColumn("contributing_factors", none), [f"explanations are missing: {type(e).__name__}: {why}"]
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    gap = F.abs(total - F.log(F.try_divide(F.col("p"), 1 - F.col("p"))))
    bias = F.element_at("contributions", -1)
    found = explained.agg(F.count("*").alias("n"), F.count(gap).alias("compared"), F.max(gap).alias("gap"), (F.max(bias) - F.min(bias)).alias("spread")).first()
    if found["compared"] < found["n"]:
        why = f"{found['n'] - found['compared']} of {found['n']} rows have no contributions or log-odds to compare; explanations are withheld"
    elif found["n"] and not found["gap"] <= attribution.TOLERANCE:
        why = f"contributions miss the log-odds by {found['gap']:.2e}; explanations are withheld"
    elif found["n"] > 1 and not found["spread"] <= BIAS_TOLERANCE:
        why = f"the bias varies by {found['spread']:.2e}; explanations are withheld"
    else:
        return explained.withColumn("contributing_factors", attribution.top_factors(features, k)), []
    return explained.withColumn("contributing_factors", none), [why]


def responses(scored: DataFrame, threshold: float, break_even: float) -> DataFrame:
    """scored (node, p, contributing_factors, seen_in_context) as responses: the score is rounded before it is
    tiered, so no tier contradicts the number beside it."""
    level = tier(F.col("p"), threshold, break_even)
    return scored.select("node", quantized(F.col("p")).alias("risk_score"), level.alias("risk_level"), action(level).alias("action"), "contributing_factors", F.coalesce("seen_in_context", F.lit(False)).alias("seen_in_context"))


def validated(made: DataFrame, threshold: float, break_even: float) -> DataFrame:
    """The responses, if each tier and action follows from its score and every action is permitted."""
    made = cut(made)
    if wrong := mismatches(made, threshold, break_even).select("node").take(3):
        raise DefenseOnlyError(f"tier or action doesn't follow from the score: {[r['node'] for r in wrong]}")
    return made


def score_batch(batch: DataFrame, context: DataFrame, frozen: DataFrame, model, features: list[str], threshold: float, break_even: float, days: float = 60.0, with_context: bool = False, warnings: list[str] | None = None) -> DataFrame:
    """One row per account of the batch (with_context: of the graph): score, tier, action, factors, whether the
    context knows it, and `factors_withheld`: why there are no factors, null where there are. Refused payments take no
    part; the frozen partition is extended. Why factors are withheld is added to `warnings`, too."""
    good = reasons(batch).where("reason is null")
    merged = cut(merge(good, context, days))
    ledger = merged.select(*graph_columns())
    part = partition.extend(graph.undirected(graph.pairs(ledger)), frozen)
    table = cut(graph.features(ledger, part).na.fill(0.0))
    asked = table if with_context else table.join(graph.nodes(good), "node", "left_semi")
    scored = model.scored(asked)
    explained, said = attributed(scored.select("node", *features, "p"), model, features)
    if warnings is not None:
        warnings += said
    known = graph.nodes(context).withColumn("seen_in_context", F.lit(True))
    made = responses(explained.join(known, "node", "left"), threshold, break_even)
    return validated(made.withColumn("factors_withheld", F.lit("; ".join(said) or None).cast("string")), threshold, break_even)


@dataclass
class Service:
    """What scoring needs, frozen when it starts; what is missing is said in `reason` and nothing is scored."""

    model: object | None = None
    model_version: str = contract.MODEL_VERSION
    threshold: float | None = None
    threshold_source: str = "none"
    break_even: float | None = None
    context: DataFrame | None = None
    context_payments: int = 0
    days: float | None = None
    frozen: DataFrame | None = None
    fingerprint: str | None = None
    contract_verified: bool = False
    reason: str | None = None

    @property
    def ready(self) -> bool:
        return self.reason is None

    def health(self) -> dict:
        """The readiness document. A missing threshold is null, not a number that would flag everybody."""
        return {
            "status": "healthy" if self.ready else "degraded", "model_loaded": self.model is not None, "model_version": self.model_version, "optimal_threshold": self.threshold, "threshold_source": self.threshold_source,
            "n_features": len(contract.FEATURES), "feature_contract_verified": self.contract_verified, "context_graph_loaded": self.context is not None, "context_transactions": self.context_payments,
            "partition_fingerprint": self.fingerprint, "detail": self.reason,
        }

    def score(self, batch: DataFrame, override: float | None = None, with_context: bool = False, warnings: list[str] | None = None) -> DataFrame:
        """The responses to a batch (sender, receiver, amount, ts)."""
        if not self.ready:
            raise RuntimeError(f"not ready: {self.reason}")
        return score_batch(batch, self.context, self.frozen, self.model, list(contract.FEATURES), override or self.threshold, self.break_even, self.days, with_context, warnings)


def start(spark: SparkSession, artifacts: str, data: str) -> Service:
    """Loads model, threshold, costs and context, freezes the context's partition and takes its fingerprint.
    It never raises for what is missing: the service starts degraded and says why."""
    s, missing = Service(), []
    try:
        s.model = files.load_model(spark, artifacts)
        s.contract_verified = True
    except Exception as e:
        missing.append(f"model: {type(e).__name__}: {str(e).splitlines()[0][:120]}")
    s.threshold, s.threshold_source, doc = files.load_metrics(spark, artifacts)
    s.break_even = files.break_even(doc)
    if s.threshold is None:
        missing.append("no usable threshold")
    if s.break_even is None:
        missing.append("no costs")
    try:
        context = files.read_context(spark, data).select("sender", "receiver", F.col("amount").cast("decimal(18,4)").alias("amount"), F.col("timestamp").alias("ts"))
        s.context = cut(context)
        s.context_payments = s.context.count()
        s.days = files.window_days(spark, data)
        s.frozen = cut(partition.numbered(graph.partitioned(graph.undirected(graph.pairs(s.context)))))
        s.fingerprint = partition.fingerprint(s.frozen).first()["fingerprint"]
    except Exception as e:
        missing.append(f"context: {type(e).__name__}: {str(e).splitlines()[0][:120]}")
    s.reason = "; ".join(missing) or None
    return s
