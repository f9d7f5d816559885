"""Threshold policies over many scores at once: sweeps, cheapest and affordable cuts, one-line rules, and
what they do on rows that they weren't chosen on.

A frame of candidates has one row per account and policy (keys, x, y); the higher x, the sooner flagged.
All of a key's distinct x would be one task's window, so running sums are taken within ranges of keys and x
(`scan.ranges`), and over the ranges' totals. What flags small values first is the same order read from its other end,
so a feature's two directions share all sums (`running`)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyweave.operators import scan
from tallyweave.work import cut

FN_COST, FP_COST = 200_000, 15_000


def unpivoted(df: DataFrame, features: tuple[str, ...], *keep: str) -> DataFrame:
    """Two candidates of every feature: the feature itself (high) and its negative (low)."""
    one = lambda f, d, x: F.struct(F.lit(f).alias("feature"), F.lit(d).alias("direction"), x.alias("x"))
    both = [one(f, d, s * F.col(f).cast("double")) for f in features for d, s in (("high", 1.0), ("low", -1.0))]
    return df.select(*keep, F.inline(F.array(*both))).withColumn("x", F.col("x") + 0.0)  # no negative zero


def running(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key and distinct x: its rows with y (p) and without (n), those of x and all above (tp, fp), of all
    (np, nn), place from the top (rn) of how many (kinds), and the next smaller and larger x (lower, higher). Written."""
    s = scan.ranges(df.groupBy(*keys, "x").agg(F.sum("y").cast("long").alias("p"), F.sum(1 - F.col("y")).cast("long").alias("n")), [*[F.col(k) for k in keys], F.col("x")])
    on = [*keys, scan.RANGE]
    total = s.groupBy(*on).agg(F.sum("p").alias("rp"), F.sum("n").alias("rn_"), F.count("*").alias("rk"), F.max("x").alias("top"), F.min("x").alias("bottom"))
    down, whole, zero = Window.partitionBy(*keys).orderBy(F.desc(scan.RANGE)), Window.partitionBy(*keys), F.lit(0)  # a row for each range
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    t = total.select(*on, *[F.coalesce(F.sum(c).over(above), zero).alias(name) for c, name in (("rp", "ap"), ("rn_", "an"), ("rk", "ak"))], F.lead("top").over(down).alias("next_top"), F.lag("bottom").over(down).alias("last_bottom"), *[F.sum(c).over(whole).alias(name) for c, name in (("rp", "np"), ("rn_", "nn"), ("rk", "kinds"))])
    inside = Window.partitionBy(*on).orderBy(F.desc("x"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut(s.join(F.broadcast(t), on).select(
        *keys, "x", "p", "n", (F.col("ap") + F.sum("p").over(upto)).alias("tp"), (F.col("an") + F.sum("n").over(upto)).alias("fp"), "np", "nn", "kinds",
        (F.col("ak") + F.row_number().over(inside)).alias("rn"), F.coalesce(F.lead("x").over(inside), "next_top").alias("lower"), F.coalesce(F.lag("x").over(inside), "last_bottom").alias("higher"),
    ))


def _low(c: str) -> Column:
    return -F.col(c) + 0.0  # no negative zero


def cuts(ran: DataFrame, keys: list[str], low: bool = False) -> DataFrame:
    """Every distinct confusion matrix of each key, from `running`: threshold, tp, fp, np, nn, rn (0 flags nobody, at the
    next number above the largest x), and lower, the next smaller threshold; with `low`, those of -x."""
    zero = F.lit(0).cast("long")
    one = lambda x, tp, fp, rn, lower: F.struct(x.cast("double").alias("threshold"), tp.alias("tp"), fp.alias("fp"), "np", "nn", rn.cast("long").alias("rn"), lower.cast("double").alias("lower"))
    if low:
        x, rn = _low("x"), F.col("kinds") - F.col("rn") + 1
        own = one(x, F.col("np") - F.col("tp") + F.col("p"), F.col("nn") - F.col("fp") + F.col("n"), rn, _low("higher"))
    else:
        x, rn = F.col("x").cast("double"), F.col("rn")
        own = one(x, F.col("tp"), F.col("fp"), rn, F.col("lower"))
    up = F.call_function("java_method", F.lit("java.lang.Math"), F.lit("nextUp"), x).cast("double")
    return ran.select(*keys, F.inline(F.array(own))).unionByName(ran.where(rn == 1).select(*keys, F.inline(F.array(one(up, zero, zero, zero, x)))))


def sweep(df: DataFrame, keys: list[str]) -> DataFrame:
    """The cuts of each key."""
    return cuts(running(df, keys), keys)


def numbered(frame: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """frame (y, features) by feature, which is its number here: feature, x, y."""
    return frame.select("y", F.posexplode(F.array(*[F.col(f).cast("double") + 0.0 for f in features])).alias("feature", "x"))


def both_ways(ran: DataFrame) -> DataFrame:
    """The cuts of each feature, by its number, in both directions: feature, direction and those of `cuts`."""
    on = ["feature"]
    return cuts(ran, on).withColumn("direction", F.lit("high")).unionByName(cuts(ran, on, True).withColumn("direction", F.lit("low")))


def _named(df: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return df.withColumn("feature", F.array(*[F.lit(f) for f in features])[F.col("feature")])


def costs(fn: int = FN_COST, fp: int = FP_COST) -> Column:
    return ((F.col("np") - F.col("tp")) * fn + F.col("fp") * fp).cast("long")


def cheapest(cuts: DataFrame, keys: list[str], cost: Column | None = None) -> DataFrame:
    """Of each key the widest run of cheapest cuts (the strictest of equals): threshold (the middle of (lo, hi],
    or hi where that rounds onto lo), hi, lo, cost, and how many cuts the run has."""
    c = cuts.withColumn("cost", costs() if cost is None else cost)
    least = c.groupBy(*keys).agg(F.min("cost").alias("least"))
    # Few cuts share the least cost, and an empty last range ends below the smallest x.
    m = c.join(F.broadcast(least), keys).where("cost = least")
    down = F.call_function("java_method", F.lit("java.lang.Math"), F.lit("nextDown"), F.col("threshold")).cast("double")
    m = m.withColumn("low", F.coalesce("lower", down)).withColumn("island", F.col("rn") - F.row_number().over(Window.partitionBy(*keys).orderBy("rn")))
    runs = m.groupBy(*keys, "island").agg(F.max("threshold").alias("hi"), F.min("low").alias("lo"), F.min("cost").alias("cost"), F.count("*").alias("n_equivalent"))
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("hi", "lo", "cost", "n_equivalent"), F.struct((F.col("hi") - F.col("lo")).alias("w"), "hi")).alias("b")).select(*keys, "b.*")
    middle = (F.col("hi") + F.col("lo")) / 2
    return best.select(*keys, F.when(middle > F.col("lo"), middle).otherwise(F.col("hi")).alias("threshold"), "hi", "lo", "cost", "n_equivalent")


def best_f1(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the cut of the largest F1, the strictest of equals."""
    f1 = 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("np"))
    return cuts.where("tp > 0").groupBy(*keys).agg(F.max_by("threshold", F.struct(f1, "threshold")).alias("threshold"), F.max(f1).alias("f1"))


def affordable(cuts: DataFrame, keys: list[str], per_1000: float = 20.0) -> DataFrame:
    """Of each key the loosest cut that flags someone and no more than per_1000 of 1,000; if there is none,
    that which flags nobody, and feasible is false."""
    fits = (F.col("rn") > 0) & ((F.col("tp") + F.col("fp")) * 1000 <= per_1000 * (F.col("np") + F.col("nn")))
    return cuts.groupBy(*keys).agg(F.coalesce(F.min(F.when(fits, F.col("threshold"))), F.max("threshold")).alias("threshold"), (F.count_if(fits) > 0).alias("feasible"))


def priced(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """chosen with what its thresholds do on df: tp, fp, fn, tn, p, r, f1 (null where undefined), cost, alerts
    per 1,000. Thresholds are a row per policy."""
    hit = F.col("x") >= F.col("threshold")
    is_y = F.col("y") == 1
    names = [c for c in chosen.columns if c not in keys]
    c = df.join(F.broadcast(chosen), keys).groupBy(*keys, *names).agg(F.count_if(hit & is_y).alias("tp"), F.count_if(hit & ~is_y).alias("fp"), F.count_if(~hit & is_y).alias("fn"), F.count_if(~hit & ~is_y).alias("tn"))
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return c.withColumns({"p": F.try_divide(tp, tp + fp), "r": F.try_divide(tp, tp + fn), "f1": F.try_divide(2.0 * tp, 2 * tp + fp + fn), "total_cost": fn * FN_COST + fp * FP_COST, "alerts_per_1000": (tp + fp) * 1000.0 / (tp + fp + fn + F.col("tn"))})


def _auc(ran: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auc and low, that of -x: ties count half; null for one class."""
    t = ran.groupBy(*keys).agg(F.max("np").alias("np"), F.max("nn").alias("nn"), F.sum(F.col("p") * (F.col("fp") - F.col("n") / 2)).alias("lost"))
    pairs, both = F.col("np") * F.col("nn"), (F.col("np") > 0) & (F.col("nn") > 0)
    return t.select(*keys, F.when(both, 1 - F.col("lost") / pairs).alias("auc"), F.when(both, 1 - (pairs - F.col("lost")) / pairs).alias("low"))


def separation(df: DataFrame, keys: list[str]) -> DataFrame:
    """AUC of each key, ties counting half; null for one class."""
    return _auc(running(df, keys), keys).drop("low")


def separations(ran: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """feature, direction, auc of all features in both directions."""
    return _named(_auc(ran, ["feature"]), features).select("feature", F.inline(F.array(F.struct(F.lit("high").alias("direction"), "auc"), F.struct(F.lit("low").alias("direction"), F.col("low").alias("auc")))))


def rules(frame: DataFrame, features: tuple[str, ...], criterion: str = "cost", screen: str = "val", ran: DataFrame | None = None) -> DataFrame:
    """All one-line rules over frame (split, y, features): the threshold is chosen on val, by cost or f1, and
    priced on test. screen_auc is the rule's on the split that decides about features, which can't be
    test. val_cost is null by f1, val_f1 by cost; threshold_on_score is that of x, which is the negative of
    the feature where the direction is low. `ran` is `running` of val's `numbered` rows, where that is there already."""
    if criterion not in ("cost", "f1"):
        raise ValueError("the criterion is cost or f1")
    if screen == "test":
        raise ValueError("features aren't judged on the test split")
    keys = ["feature", "direction"]
    of = lambda split: running(numbered(frame.where(F.col("split") == split), features), ["feature"])
    ran = of("val") if ran is None else ran
    both = both_ways(ran)
    if criterion == "cost":
        chosen = cheapest(both, keys).select(*keys, "threshold", F.col("cost").alias("val_cost"), F.lit(None).cast("double").alias("val_f1"))
    else:
        chosen = best_f1(both, keys).select(*keys, "threshold", F.lit(None).cast("long").alias("val_cost"), F.col("f1").alias("val_f1"))
    out = priced(unpivoted(frame.where("split = 'test'"), features, "split", "y"), _named(chosen, features), keys)
    return out.join(separations(ran if screen == "val" else of(screen), features).withColumnRenamed("auc", "screen_auc"), keys)


def rule_text(feature: str = "feature", direction: str = "direction", threshold: str = "threshold") -> Column:
    """The rule as it is read: a low one bounds the feature from above, by the threshold with its sign turned."""
    low = F.col(direction) == "low"
    return F.concat(feature, F.when(low, " <= ").otherwise(" >= "), F.format_string("%.9f", F.when(low, -F.col(threshold)).otherwise(F.col(threshold)) + 0.0))


def trivial(df: DataFrame) -> DataFrame:
    """What flagging nobody and flagging everybody cost."""
    n = df.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    return n.select(F.inline(F.array(F.struct(F.lit("flag_none").alias("policy"), (F.col("p") * FN_COST).cast("long").alias("total_cost")), F.struct(F.lit("flag_all").alias("policy"), (F.col("n") * FP_COST).cast("long").alias("total_cost")))))


def capacity(frame: DataFrame, features: tuple[str, ...], per_1000: float = 20.0, ran: DataFrame | None = None) -> DataFrame:
    """All one-line rules over frame (split, y, features) under one budget of alerts: thresholds frozen on val, priced on
    test; overflows tells whether the frozen threshold flags more there than the budget has. `ran` as in `rules`."""
    keys = ["feature", "direction"]
    ran = running(numbered(frame.where("split = 'val'"), features), ["feature"]) if ran is None else ran
    chosen = _named(affordable(both_ways(ran), keys, per_1000), features)
    return priced(unpivoted(frame.where("split = 'test'"), features, "split", "y"), chosen, keys).withColumn("overflows", F.col("alerts_per_1000") > per_1000)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
