"""Model operators: weighted logistic regression and boosted trees, Platt scaling, cluster bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyweave.functions.scalars import calibrated
from tallyweave.operators import scan, trees
from tallyweave.work import cut

EPS, RIDGE, TOLERANCE = 1e-6, 1e-8, 1e-10


def weighted(df: DataFrame, label: str = "y") -> DataFrame:
    """Balanced class weights as a column w."""
    n = df.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
    positive, negative = n["n"] / (2 * max(n["p"] or 0, 1)), n["n"] / (2 * max(n["n"] - (n["p"] or 0), 1))
    return df.withColumn("w", F.when(F.col(label) == 1, positive).otherwise(negative))


def logistic(train: DataFrame, features: list[str], test: DataFrame, label: str = "y", log1p: tuple[str, ...] = ()) -> DataFrame:
    """test with p: log1p of skewed columns, z-scores of the training rows, balanced weights, L2."""
    shaped = lambda df: VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_raw").transform(df.withColumns({f"_{c}": F.log1p(c) if c in log1p else F.col(c).cast("double") for c in features}))
    scaler = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(shaped(train))
    data = weighted(scaler.transform(shaped(train)), label)
    model = LogisticRegression(featuresCol="_z", labelCol=label, weightCol="w", regParam=1.0 / max(data.count(), 1), standardization=False).fit(data)
    return model.transform(scaler.transform(shaped(test))).select(*test.columns, vector_to_array("probability")[1].alias("p"))


DEPTH, RATE, ROWS, ROUNDS = trees.DEPTH, trees.RATE, trees.ROWS, trees.ROUNDS


def fit_boosted(train: DataFrame, features: list[str], label: str = "y", rounds: int = 20, valid: DataFrame | None = None) -> trees.Boosted:
    """Gradient boosted trees, a positive weighing as much as the negatives that there are for each; with `valid`
    as many as its average precision asks for."""
    return trees.fit(train, features, label, rounds, valid)


def boosted(train: DataFrame, features: list[str], test: DataFrame, label: str = "y", rounds: int = 20, valid: DataFrame | None = None) -> DataFrame:
    """test with p from such trees."""
    return apply(fit_boosted(train, features, label, rounds, valid), test, features)


def margins(model: trees.Boosted, df: DataFrame, features: list[str]) -> DataFrame:
    """df with p and margin, its log-odds: the sum of the trees."""
    return model.scored(df)


def apply(model: trees.Boosted, df: DataFrame, features: list[str]) -> DataFrame:
    """df with p from a fitted model."""
    return model.scored(df).drop("margin")


def platt(df: DataFrame, score: str = "score", label: str = "y", rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of sigmoid(slope * logit + intercept) by Newton steps with backtracking on
    smoothed targets; each step is one aggregate. Raises if there is one class only."""
    c = df.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
    pos, neg = int(c["p"] or 0), int(c["n"] - (c["p"] or 0))
    if not pos or not neg:
        raise ValueError("calibration needs both classes")
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(score)))
    d = df.select(F.log(p / (1 - p)).alias("x"), F.when(F.col(label) == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2)).alias("t")).groupBy("x", "t").agg(F.count("*").alias("n")).cache()

    def loss(a: float, b: float) -> float:
        z = F.col("x") * a + b
        softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        return d.agg(F.sum(F.col("n") * (softplus - F.col("t") * z)).alias("l")).first()["l"]

    a, b = 1.0, 0.0
    now = loss(a, b)
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.col("x") * a + b)))
        e, h, n = q - F.col("t"), q * (1 - q), F.col("n")
        g = d.agg(F.sum(n * e * F.col("x")).alias("ga"), F.sum(n * e).alias("gb"), F.sum(n * h * F.col("x") * F.col("x")).alias("aa"), F.sum(n * h * F.col("x")).alias("ab"), F.sum(n * h).alias("bb")).first()
        aa, bb, ab = g["aa"] + RIDGE, g["bb"] + RIDGE, g["ab"]
        det = aa * bb - ab * ab
        da, db = (bb * g["ga"] - ab * g["gb"]) / det, (aa * g["gb"] - ab * g["ga"]) / det
        step, slope = 1.0, da * g["ga"] + db * g["gb"]
        while step > 1e-8 and (new := loss(a - step * da, b - step * db)) > now - 1e-4 * step * slope:
            step /= 2
        a, b = a - step * da, b - step * db
        if max(abs(step * da), abs(step * db)) < TOLERANCE or step <= 1e-8:
            break
        now = new
    d.unpersist()
    return a, b


def multiplicities(cluster: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Rows of how often a cluster (the hash of its name) is drawn in each round: Poisson numbers by the hash of
    cluster, round and seed, so no draw depends on the order of rows."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))

    def hashed(number: np.ndarray, h: np.ndarray) -> np.ndarray:
        """xxHash64 of a 32-bit number, seeded by h, as xxhash64() chains its columns."""
        h = (h + five + np.uint64(4)) ^ (number.astype(np.uint64) * one)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * two + three
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        return h ^ (h >> np.uint64(32))

    h = hashed(np.array([seed]), hashed(np.arange(1, rounds + 1)[None, :], cluster.view(np.uint64)[:, None]))
    u = ((h & np.uint64((1 << 30) - 1)).astype(float) + 0.5) / float(1 << 30)
    cdf, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        cdf.append(total)
        term /= k + 1
    return sum((u > x).astype(np.int64) for x in cdf)


def bootstrap_auc(df: DataFrame, rounds: int, seed: int = 7) -> DataFrame:
    """AUC of each round, clusters drawn with replacement; rounds of one class are left out.

    Rows are dealt once, by ranges of score. A task goes through its range with vectors of one weight for each
    round: positives and negatives so far, and the pairs that positives have won; what a range gives is one row of
    three vectors, and ranges meet by round."""
    schema = pa.schema([("range", pa.int32()), ("p", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("won", pa.list_(pa.float64()))])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n, won = np.zeros(rounds, np.int64), np.zeros(rounds, np.int64), np.zeros(rounds)
        now, tie_p, tie_n, at = None, np.zeros(rounds, np.int64), np.zeros(rounds, np.int64), None
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                at, score, y = part.column(0)[0].as_py(), part.column(1).to_numpy(), part.column(3).to_numpy()
                m = multiplicities(part.column(2).to_numpy(), rounds, seed)
                heads = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
                ps, ns = (np.add.reduceat(m * w[:, None], heads, 0) for w in (y, 1 - y))
                if score[0] == now:  # the last score of the rows before goes on
                    ps[0] += tie_p
                    ns[0] += tie_n
                else:
                    won += tie_p * (n + tie_n / 2)
                    p, n = p + tie_p, n + tie_n
                now, tie_p, tie_n = score[-1], ps[-1], ns[-1]
                below = n + np.cumsum(ns, 0) - ns
                won += (ps[:-1] * (below[:-1] + ns[:-1] / 2)).sum(0)
                p, n = p + ps[:-1].sum(0), n + ns[:-1].sum(0)
        if at is not None:
            won += tie_p * (n + tie_n / 2)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([at], [p + tie_p], [n + tie_n], [won]), schema, strict=True)], schema=schema)

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Equal scores are in one range: a score's rows beyond what a task can stream make no range larger in memory.
    dealt = df.select(F.col("score").cast("double").alias("score"), F.xxhash64("cluster").alias("c"), F.col("y").cast("long").alias("y")).repartitionByRange(parts, "score").sortWithinPartitions("score")
    vectors = cut(dealt.select(F.spark_partition_id().alias("range"), "score", "c", "y").mapInArrow(stream, "range int, p array<long>, n array<long>, won array<double>"))
    each = vectors.select("range", F.posexplode(F.arrays_zip("p", "n", "won")).alias("round", "v")).select((F.col("round") + 1).alias("round"), "range", "v.p", "v.n", "v.won")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("round").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = each.withColumn("won", F.col("won") + F.col("p") * below).groupBy("round").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return r.where("p > 0 and n > 0").select("round", (F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


def ranking(df: DataFrame, score: str = "p", label: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """AUC (ties count half) and average precision, by group; null for a group of one class. Running sums
    are taken within 1,024 score buckets and over the buckets' totals."""
    keys = [F.col(c) for c in by]
    s = df.groupBy(*keys, F.col(score).alias("_s"), F.floor(F.col(score) * 1024).alias("_b")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    b = s.groupBy(*by, "_b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    before = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    above = b.select(*by, "_b", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("an"))
    upto = Window.partitionBy(*by, "_b").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = s.join(above, [*by, "_b"]).select(*by, "p", "n", (F.col("ap") + F.sum("p").over(upto)).alias("tp"), (F.col("an") + F.sum("n").over(upto)).alias("fp"))
    t = r.groupBy(*by).agg(F.sum("p").alias("np"), F.sum("n").alias("nn"), F.sum(F.col("p") * (F.col("fp") - F.col("n") / 2)).alias("lost"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("area"))
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return t.select(*by, F.when(both, 1 - F.col("lost") / (F.col("np") * F.col("nn"))).alias("auc"), F.when(both, F.col("area") / F.col("np")).alias("ap"))


def folds(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """df with `fold`: whole rings, largest first, are dealt in turn; others by a seeded hash of their id."""
    rings = df.where("ring_id >= 0").groupBy("ring_id").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.xxhash64("ring_id", F.lit(seed)), F.col("ring_id")]
    dealt = scan.running(rings, order, place="_place").select("ring_id", ((F.col("_place") - 1) % k).cast("int").alias("_dealt"))
    return df.join(dealt, "ring_id", "left").withColumn("fold", F.coalesce("_dealt", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).cast("int"))).drop("_dealt")


def cross_validate(df: DataFrame, features: list[str], k: int = 5, seed: int = 42, rounds: int = 100) -> DataFrame:
    """Each fold (its AUC and average precision, fitted on the others), with the mean and the deviation (of all
    folds) of both in all rows. All folds grow together, `rounds` trees each: there is no third part to stop by."""
    d = cut(folds(df, k, seed))
    copies = d.withColumn("model", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i != F.col("fold")))).withColumn("valid", F.lit(False))
    fitted = trees.fit_many(copies, features, "y", rounds)
    held = [fitted[i].scored(d.where(F.col("fold") == i)) for i in range(k) if i in fitted]
    scored = held[0]
    for h in held[1:]:
        scored = scored.union(h)
    r = cut(ranking(scored, "p", "y", ("fold",)).select("fold", "auc", "ap"))
    return r.crossJoin(F.broadcast(r.agg(*[f(c).alias(f"{c}_{n}") for c in ("auc", "ap") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])))


def with_and_without(train: DataFrame, features: list[str], without: list[str], valid: DataFrame | None = None, rounds: int = ROUNDS) -> dict[str, trees.Boosted]:
    """Two models that grow together: `full` has all features, `without` isn't shown some."""
    part = lambda df, v: df.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("model"), F.lit(v).alias("valid"), "y", *features)
    both = part(train, False) if valid is None else part(train, False).unionByName(part(valid, True))
    fitted = trees.fit_many(both, features, "y", rounds, without={1: without})
    return {"full": fitted[0], "without": fitted[1]}


def ablation(train: DataFrame, test: DataFrame, features: list[str], without: list[str], valid: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, trees.Boosted]]:
    """AUC and average precision with all features and without some; and the two models."""
    named = with_and_without(train, features, without, valid, rounds)
    run = lambda name: ranking(named[name].scored(test)).select(F.lit(name).alias("model"), "auc", "ap")
    return run("full").union(run("without")), named


def importance(model, test: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature, the most important first: gain (the model's) and share (mean absolute contribution,
    normalised). Raises if the contributions don't add up to the model's log-odds within 1e-4: what explains
    another model than the one that scores isn't saved."""
    from tallyweave.operators import attribution

    explained = cut(attribution.contributions(apply(model, test.select(*features), features), model, features))
    gap = attribution.margin_gap(explained)
    if not gap <= attribution.TOLERANCE:
        raise ValueError(f"contributions miss the log-odds by {gap:.2e}")
    gain = test.sparkSession.createDataFrame([(f, float(g)) for f, g in zip(features, model.importances(), strict=True)], "feature string, gain double")
    return attribution.mean_absolute(explained, features).join(gain, "feature").orderBy(F.desc("share"), "feature")


def calibration(val: DataFrame, test: DataFrame, score: str = "score", label: str = "y", bins: int = 10) -> DataFrame:
    """Platt scaling fitted on val, and test before and after it: Brier score, expected calibration error over
    equal bins (the last one closed), and AUC, which a rising curve leaves as it is."""
    slope, intercept = platt(val, score, label)
    both = test.select(F.col(label).alias("y"), F.inline(F.array(*[F.struct(F.lit(stage).alias("stage"), v.alias("p")) for stage, v in (("before", F.col(score).cast("double")), ("after", calibrated(F.col(score), slope, intercept)))])))
    edges = [i / bins for i in range(1, bins)]
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("p")))
    b = both.groupBy("stage", place.alias("bin")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    out = b.groupBy("stage").agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"))
    return out.join(ranking(both, "p", "y", ("stage",)).select("stage", "auc"), "stage").withColumns({"slope": F.lit(slope), "intercept": F.lit(intercept)})


def retained(table: DataFrame) -> DataFrame:
    """Of an ablation (model: full, without; auc): how much of what the full model has over chance is left."""
    a = table.groupBy().pivot("model", ["full", "without"]).agg(F.first("auc"))
    share = F.try_divide(F.col("without") - 0.5, F.col("full") - 0.5)
    return a.select(F.col("full").alias("auc_full"), F.col("without").alias("auc_without"), share.alias("retained"), F.when(share >= 0.9, "most").when(share >= 0.5, "half").otherwise("little").alias("band"))
