"""The results as Markdown, from the catalog's one-row and few-row tables; splicing into a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import models, policies
from tallyweave.plans import evaluation, labelled, relational
from tallyweave.sources import ledger as src
from tallyweave.work import cut

BEGIN, END = "<!-- results:begin -->", "<!-- results:end -->"


def rupees(amount: float | None) -> str:
    """Grouped the Indian way: the last three digits, then pairs."""
    if amount is None:
        return "n/a"
    digits = str(abs(round(amount)))
    head, tail = digits[:-3], digits[-3:]
    pairs = [head[max(0, i - 2) : i] for i in range(len(head), 0, -2)][::-1]
    return ("-" if round(amount) < 0 else "") + "₹" + ",".join([*pairs, tail])


def share(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f} %"


def render(spark: SparkSession, sf_dir: str) -> str:
    """The tables behind it have a row per policy, ratio, rate or bin."""
    every = relational.QUERIES | evaluation.QUERIES | labelled.QUERIES
    rows = lambda name: every[name](spark, sf_dir).collect()
    test, trivial = rows("m_eval_test")[0], {r.split: r for r in rows("m_trivial")}["test"]
    auc = {r.split: r.auc for r in rows("m_auc")}
    best = min(trivial.flag_none, trivial.flag_all)
    out = ["## Results", "", f"AUC on the test split: {auc['test']:.4f}. Threshold {test.threshold:.4f}, chosen on the validation split.", ""]
    out += [f"Precision {share(test.p)}, recall {share(test.r)}; total cost {rupees(test.total_cost)}, {'less than' if test.total_cost < best else 'no less than'} the better of flagging nobody ({rupees(trivial.flag_none)}) and everybody ({rupees(trivial.flag_all)}).", ""]
    out += ["| policy | precision | recall | cost |", "|-|-|-|-|"] + [f"| {r.policy} | {share(r.p)} | {share(r.r)} | {rupees(r.total_cost)} |" for r in sorted(rows("m_baselines"), key=lambda r: r.policy)]
    out += ["", "| FN:FP | break-even | threshold | precision | recall |", "|-|-|-|-|-|"] + [f"| {r.ratio:.2f} | {share(r.break_even)} | {r.threshold:.4f} | {share(r.p)} | {share(r.r)} |" for r in sorted(rows("m_ratio_sensitivity"), key=lambda r: r.ratio)]
    out += ["", "| base rate | precision | alerts per 1,000 | cost per 1,000 | pays |", "|-|-|-|-|-|"] + [f"| {share(r.prevalence)} | {share(r.projected)} | {r.alerts_per_1000:.1f} | {rupees(r.cost_per_1000)} | {'yes' if r.clears else 'no'} |" for r in sorted(rows("m_project_prev"), key=lambda r: -r.prevalence)]
    sides = [r.side for r in rows("r_bin_side")]
    out += ["", f"Of {len(sides)} reliability bins, {sides.count('over')} predict too much and {sides.count('under')} too little."]
    return "\n".join(out) + "\n"


def summary(df: DataFrame, budget: float = 20.0, wide: float = 0.05) -> list[str]:
    """What scores (x, y) cost at their cheapest cut and under a budget of alerts, in words. A figure that has no
    value at a cut that flags nobody is n/a."""
    keyed = df.select(F.lit("scores").alias("policy"), "x", "y")
    cuts = cut(policies.sweep(keyed, ["policy"]))
    best, few = cut(policies.cheapest(cuts, ["policy"])), cut(policies.affordable(cuts, ["policy"], budget))
    if best.isEmpty():
        return ["No scores."]
    b, f = best.first(), few.first()
    at = {name: policies.priced(keyed, chosen.select("policy", "threshold"), ["policy"]).first() for name, chosen in (("best", best), ("few", few))}
    auc = models.ranking(keyed, "x").first()["auc"]
    trivial = {r["policy"]: r["total_cost"] for r in policies.trivial(keyed).collect()}
    rival = min(trivial, key=lambda k: (trivial[k], k != "flag_none"))
    saved = trivial[rival] - at["best"]["total_cost"]
    four = lambda x: "n/a" if x is None else f"{x:.4f}"
    told = lambda r: [f"  precision {four(r['p'])}, recall {four(r['r'])}, F1 {four(r['f1'])}", f"  {r['alerts_per_1000']:.1f} alerts per 1,000 accounts"]
    width = b["hi"] - b["lo"]
    out = [f"Costs: {rupees(policies.FN_COST)} a miss, {rupees(policies.FP_COST)} a false alarm ({policies.FN_COST / policies.FP_COST:.1f} to 1); alerts pay above a precision of {share(policies.FP_COST / (policies.FN_COST + policies.FP_COST))}", f"AUC {four(auc)}", ""]
    out += ["Cheapest cut", f"  threshold {b['threshold']:.4f}, as good from {b['lo']:.4f} to {b['hi']:.4f} (a {'wide' if width > wide else 'narrow'} range: {width:.4f})", *told(at["best"])]
    out += [f"  {at['best']['tp']} hits, {at['best']['fp']} false alarms, {at['best']['fn']} misses, {at['best']['tn']} left alone", f"  misses {rupees(at['best']['fn'] * policies.FN_COST)} and false alarms {rupees(at['best']['fp'] * policies.FP_COST)}: {rupees(at['best']['total_cost'])}", ""]
    out += [f"Under {budget:.0f} alerts per 1,000" + ("" if f["feasible"] else ": no cut that flags anyone fits"), f"  threshold {f['threshold']:.4f}", *told(at["few"]), f"  {rupees(at['few']['total_cost'])}, {rupees(at['few']['total_cost'] - at['best']['total_cost'])} more than the cheapest cut", ""]
    out += [f"The better of flagging nobody and everybody is {rival.replace('_', ' ')}: {rupees(trivial[rival])}"]
    return out + ([f"The scores save {rupees(saved)} of it ({share(saved / trivial[rival])})"] if trivial[rival] else [])


def m_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = src.scored_frame(spark, sf_dir).where("split = 'test'").select(F.col("score").alias("x"), "y")
    return spark.createDataFrame(list(enumerate(summary(s))), "line int, text string")


def splice(document: str, block: str) -> str:
    """The document with block between the two marks; raises if a mark is missing or repeated."""
    if document.count(BEGIN) != 1 or document.count(END) != 1 or document.index(BEGIN) > document.index(END):
        raise ValueError("the document needs each mark once, in order")
    head, rest = document.split(BEGIN)
    return f"{head}{BEGIN}\n{block}{END}{rest.split(END)[1]}"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(render(spark, sf_dir).splitlines())), "line int, text string")
