"""A synthetic payment ledger with planted rings, as a DataFrame program.

Every draw is a seeded hash of what it is drawn for, so a lost task draws the same again and no result
depends on partitions. Roles hold blocks of account numbers, so a random partner is arithmetic, not a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyweave.sources.ledger import EDGES

# Shares, intensities and hours of the simulated population, and the shapes of rings.
START, DAYS, SPLITS = 1_735_689_600, 180, ("train", "val", "test")
ROLES = {"merchant": 0.045, "employer": 0.010, "landlord": 0.030, "biller": 0.015, "gig": 0.050, "trader": 0.040}
HOURS = (0.4, 0.2, 0.1, 0.1, 0.2, 0.5, 1.2, 2.2, 3.4, 4.6, 5.2, 5.6, 5.4, 4.8, 4.4, 4.6, 5.0, 5.8, 6.6, 7.0, 6.2, 4.4, 2.6, 1.2)
RINGS = {"train": 40, "val": 24, "test": 24}
PREFIX = {"train": "MULE_T_", "val": "MULE_V_", "test": "MULE_S_"}
SOCIAL_PAIRS, SETTLEMENTS, ONE_OFFS, POPULARITY = 1_100, 60, 10_000, 1.1
SUBSCRIPTIONS = (99, 149, 199, 299, 499, 649, 799)
PAYDAY_SHARE, PAYDAY_COUNT, PAYDAY_SECONDS = 0.35, (1, 4), (600, 8 * 3_600)
COVER_PARTNERS, COVER_PAYMENTS, COVER_AMOUNT, COVER_OUT = (1, 3), (2, 6), (80, 4_000), 0.7
#: Draws of a time in a short span before the last one stands.
TRIES = 24


@dataclass(frozen=True)
class Shape:
    name: str
    share: float
    size: tuple[int, int]
    payments: tuple[int, int]
    jitter: float
    hijack: float
    burst: tuple[int, int] | None
    feeders: tuple[int, int]
    open: float


SHAPES = (
    Shape("fast_cycle", 0.35, (3, 6), (8, 18), 0.05, 0.35, (2, 12), (4, 10), 0.0),
    Shape("stealth_cycle", 0.40, (4, 8), (2, 5), 0.30, 0.65, None, (1, 3), 0.35),
    Shape("layered_fanin", 0.25, (3, 5), (3, 8), 0.20, 0.45, (12, 72), (15, 40), 0.50),
)


def allocate(rings: int) -> list[Shape]:
    """Shapes of a split's rings by largest remainder."""
    whole = {s.name: math.floor(rings * s.share + 1e-9) for s in SHAPES}
    by_rest = sorted(SHAPES, key=lambda s: whole[s.name] - rings * s.share)
    for s in by_rest[: rings - sum(whole.values())]:
        whole[s.name] += 1
    return [s for s in SHAPES for _ in range(whole[s.name])]


class Draw:
    """Uniform draws in (0, 1) that depend on the seed, a name and key columns."""

    def __init__(self, seed: int) -> None:
        self.seed = seed

    def u(self, name: str, *keys: Column) -> Column:
        return (F.pmod(F.xxhash64(F.lit(self.seed), F.lit(name), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    def between(self, name: str, low: float, high: float, *keys: Column) -> Column:
        return F.lit(float(low)) + self.u(name, *keys) * float(high - low)

    def whole(self, name: str, low: int | Column, high: int | Column, *keys: Column) -> Column:
        low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
        return (low + F.floor(self.u(name, *keys) * (high - low + 1))).cast("long")

    def normal(self, name: str, *keys: Column) -> Column:
        return F.sqrt(-2 * F.log(self.u(name + ".r", *keys))) * F.cos(2 * math.pi * self.u(name + ".a", *keys))

    def of(self, name: str, values: tuple, *keys: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.floor(self.u(name, *keys) * len(values))).cast("int"))


def nice(amount: Column) -> Column:
    """Amounts as they are billed."""
    step = lambda n: F.bround(amount / n) * n
    return F.when(amount >= 10_000, step(500)).when(amount >= 1_000, step(50)).otherwise(F.greatest(step(10), F.lit(10.0)))


def _name(number: Column) -> Column:
    return F.concat(F.lit("UPI_"), F.lpad(number.cast("string"), 5, "0"))


def blocks(accounts: int) -> dict[str, tuple[int, int]]:
    """First and last account number of each role; the rest are consumers."""
    at, found = 0, {}
    for role, share in ROLES.items():
        n = max(2, round(accounts * share))
        found[role] = (at, at + n - 1)
        at += n
    return found | {"consumer": (at, accounts - 1)}


def relationships(spark: SparkSession, accounts: int, seed: int) -> DataFrame:
    """Standing payments: sender, receiver, base, cadence (days), jitter, hour (-1: any), role."""
    d, at, me = Draw(seed), blocks(accounts), F.col("id")
    pick = lambda name, role, *k: d.whole(name, *at[role], me, *k)

    def rel(sender: Column, receiver: Column, base: Column, cadence: Column | float, jitter: float, hour: Column | int, role: str, when: Column | None = None) -> Column:
        as_col = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
        s = F.struct(sender.cast("long").alias("s"), receiver.cast("long").alias("r"), base.cast("double").alias("base"), as_col(cadence, "double").alias("cadence"), F.lit(float(jitter)).alias("jitter"), as_col(hour, "int").alias("hour"), F.lit("organic_" + role).alias("role"))
        return s if when is None else F.when(when, s)

    tier = F.when(d.u("tier", me) < 0.6, 0).when(d.u("tier", me) < 0.9, 1).otherwise(2)
    by_tier = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), tier + 1)
    salary = nice(d.between("salary", 18_000, 140_000, me))
    consumer = [
        rel(pick("employer", "employer"), me, salary, 30.0, 0, 10, "salary"),
        rel(me, pick("landlord", "landlord"), nice(salary * d.between("rent", 0.15, 0.35, me)), 30.0, 0, d.of("rent.h", (9, 11, 20), me), "rent", d.u("rents", me) < 0.72),
        rel(me, pick("emi", "biller"), nice(salary * d.between("emi.a", 0.08, 0.22, me)), 30.0, 0, 7, "emi", d.u("has.emi", me) < by_tier(0.20, 0.55, 0.75)),
        *[rel(me, pick(f"sub{i}", "biller"), d.of(f"sub{i}.a", SUBSCRIPTIONS, me), 30.0, 0, -1, "subscription", by_tier(1, 2, 2) > i) for i in range(2)],
        rel(me, pick("utility", "biller"), nice(d.between("utility.a", 600, 4_500, me)), 30.0, 0.18, d.of("utility.h", (19, 20, 21), me), "utility"),
        rel(me, pick("often", "merchant"), d.between("often.a", 60, 900, me), d.u("often.c", me) * by_tier(0.0, 5.0, 4.0) + by_tier(1.0, 5.0, 3.0), 0.45, -1, "frequent", tier > 0),
        *[rel(me, pick(f"shop{i}", "merchant"), d.between(f"shop{i}.a", 400, 9_000, me), d.u(f"shop{i}.c", me) * by_tier(13.0, 10.0, 8.0) + by_tier(12.0, 10.0, 8.0), 0.55, -1, "merchant", by_tier(1, 1, 2) > i) for i in range(2)],
    ]
    gig = [
        *[rel(pick(f"payer{i}", "merchant"), me, d.between(f"payer{i}.a", 2_500, 22_000, me), d.between(f"payer{i}.c", 3, 8, me), 0.30, -1, "payout", d.whole("payers", 1, 2, me) > i) for i in range(2)],
        *[rel(me, F.when(d.u(f"fwd{i}.k", me) < 0.2, pick(f"fwd{i}.l", "landlord")).otherwise(pick(f"fwd{i}.o", "consumer")), d.between(f"fwd{i}.a", 3_000, 25_000, me), d.between(f"fwd{i}.c", 6, 14, me), 0.25, -1, "forward", d.whole("fwds", 2, 3, me) > i) for i in range(3)],
    ]
    merchant = [rel(me, F.when(d.u(f"sup{i}.k", me) < 0.3, pick(f"sup{i}.b", "biller")).otherwise(pick(f"sup{i}.t", "trader")), nice(d.between(f"sup{i}.a", 20_000, 250_000, me)), d.between(f"sup{i}.c", 7, 20, me), 0.22, d.of(f"sup{i}.h", (17, 18, 22), me), "settlement", d.whole("sups", 1, 3, me) > i) for i in range(3)]
    parts = [spark.range(at[role][0], at[role][1] + 1).select(F.inline(F.filter(F.array(*rels), lambda s: s.isNotNull()))) for role, rels in (("consumer", consumer), ("gig", gig), ("merchant", merchant))]
    # Friends pay each other both ways; traders settle in loops.
    a, b = d.whole("friend", *at["consumer"], me), d.whole("friend.b", *at["consumer"], me)
    social = spark.range(SOCIAL_PAIRS * accounts // 3000).select(F.inline(F.array(*[rel(x, y, d.between("friend.a", 100, 4_000, me), 4 + 40 * F.pow(d.u("friend.c", me), 2), 0.6, -1, "social") for x, y in ((a, b), (b, a))])))
    size = d.whole("loop.n", 3, 5, me)
    first, width = at["trader"][0], at["trader"][1] - at["trader"][0] + 1
    seat = lambda i: F.lit(first) + (F.floor(d.u("loop.at", me) * width) + i % size).cast("long") % width
    loop = spark.range(SETTLEMENTS * accounts // 3000).select("id", F.explode(F.sequence(F.lit(0), size - 1)).alias("i")).select(F.inline(F.array(rel(seat(F.col("i")), seat(F.col("i") + 1), d.between("loop.a", 5_000, 60_000, me, F.col("i")), d.between("loop.c", 6, 15, me), 0.25, -1, "b2b_cycle"))))
    out = parts[0]
    for p in (*parts[1:], social, loop):
        out = out.union(p)
    return out


def _hour(d: Draw, *keys: Column) -> Column:
    total, cdf = 0.0, []
    for w in HOURS[:-1]:
        total += w
        cdf.append(total / sum(HOURS))
    u = d.u("hour", *keys)
    return sum((F.when(u > c, 1).otherwise(0) for c in cdf), F.lit(0))


def diurnal_in_span(d: Draw, start: Column, seconds: Column, *keys: Column) -> Column:
    """A second of a span too short for whole days, whose hour follows the day's profile as far as the span
    has it: uniform draws, each accepted with its hour's share of the busiest one's weight."""
    at = lambda i: (start + F.floor(d.u("try", *keys, i) * seconds)).cast("long")
    weight = lambda t: F.element_at(F.array(*map(F.lit, HOURS)), (F.floor(F.pmod(t, F.lit(86_400)) / 3_600) + 1).cast("int"))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(TRIES)), lambda i: F.struct(at(i).alias("t"), (d.u("accept", *keys, i) < weight(at(i)) / max(HOURS)).alias("ok")))
    taken = F.filter(drawn, lambda x: x["ok"])
    return F.coalesce(F.get(taken, F.lit(0)), F.element_at(drawn, -1))["t"]


def _stamp(d: Draw, day: Column, hour: Column, *keys: Column) -> Column:
    """Seconds of a whole day at an hour, with a drawn minute and second."""
    return (F.lit(START) + F.floor(day).cast("long") * 86_400 + hour.cast("long") * 3_600 + F.floor(d.u("second", *keys) * 3_600)).cast("long")


def organic(spark: SparkSession, accounts: int, seed: int) -> DataFrame:
    """s, r (account numbers), amount, t (seconds), role."""
    d = Draw(seed)
    r = relationships(spark, accounts, seed)
    key = [F.xxhash64("s", "r", "base", "role", "cadence")]
    most = F.ceil(F.lit(DAYS) / (0.8 * F.col("cadence"))).cast("int") + 1
    gap = lambda k: F.col("cadence") * (0.8 + 0.4 * d.u("gap", *key, k))
    days = F.aggregate(F.sequence(F.lit(1), most), F.array(F.col("cadence") * d.u("first", *key)), lambda acc, k: F.array_append(acc, F.element_at(acc, -1) + gap(k)))
    e = r.select("*", F.posexplode(days).alias("k", "day")).where(F.col("day") < DAYS)
    ks = [*key, F.col("k")]
    amount = F.when(F.col("jitter") == 0, F.col("base")).otherwise(F.greatest(F.lit(10.0), F.col("base") * F.exp(F.col("jitter") * d.normal("amount", *ks) - F.col("jitter") * F.col("jitter") / 2)))
    hour = F.when(F.col("hour") < 0, _hour(d, *ks)).otherwise(F.col("hour"))
    standing = e.select("s", "r", F.round(amount, 2).alias("amount"), _stamp(d, F.col("day"), hour, *ks).alias("t"), "role")
    # Within hours of a third of the salaries some of the account's other standing payments are made once more.
    paid = standing.where("role = 'organic_salary'").select(F.col("r").alias("account"), F.col("t").alias("paid"))
    each = [F.col("account"), F.col("paid")]
    paid = paid.where(d.u("payday", *each) < PAYDAY_SHARE).withColumn("n", d.whole("payday.n", *PAYDAY_COUNT, *each))
    other = r.where("role <> 'organic_salary'").select("s", "r", "base", "jitter", F.xxhash64(*key).alias("rel"))
    once_more = [*each, F.col("rel")]
    nth = F.row_number().over(Window.partitionBy(*each).orderBy(d.u("payday.o", *once_more), "rel"))
    burst = paid.join(other, paid["account"] == other["s"]).withColumn("nth", nth).where("nth <= n")
    spent = F.when(F.col("jitter") == 0, F.col("base")).otherwise(F.greatest(F.lit(10.0), F.col("base") * F.exp(F.col("jitter") * d.normal("payday.a", *once_more) - F.col("jitter") * F.col("jitter") / 2)))
    when = (F.col("paid") + F.floor(d.between("payday.t", *PAYDAY_SECONDS, *once_more))).cast("long")
    bursts = burst.select("s", "r", F.round(spent, 2).alias("amount"), when.alias("t"), F.lit("organic_burst").alias("role")).where(F.col("t") < START + DAYS * 86_400)
    # One-off partners are popular by a power law: the inverse of its distribution, then a fixed shuffle.
    me, slope = F.col("id"), POPULARITY - 1
    rank = F.floor(F.pow(1 - d.u("one.r", me) * (1 - (accounts + 1) ** -slope), -1 / slope)) - 1
    at = blocks(accounts)
    prime = next(p for p in (7_919, 104_729, 15_485_863) if accounts % p)
    to = F.when(d.u("one.m", me) < 0.45, d.whole("one.shop", *at["merchant"], me)).otherwise((F.least(rank, F.lit(accounts - 1)).cast("long") * prime) % accounts)
    band = d.u("one.b", me)
    size = F.when(band < 0.55, d.between("one.a", 20, 600, me)).when(band < 0.85, d.between("one.a", 600, 4_000, me)).when(band < 0.97, d.between("one.a", 4_000, 25_000, me)).otherwise(d.between("one.a", 25_000, 150_000, me))
    once = spark.range(ONE_OFFS * accounts // 3000).select(d.whole("one.s", 0, accounts - 1, me).alias("s"), to.alias("r"), F.when(d.u("one.n", me) < 0.3, nice(size)).otherwise(F.round(size, 2)).alias("amount"), _stamp(d, d.u("one.d", me) * DAYS, _hour(d, me), me).alias("t"), F.lit("organic_oneoff").alias("role"))
    return standing.union(bursts).union(once)


def rings(spark: SparkSession, accounts: int, seed: int) -> DataFrame:
    """Payments inside rings and from feeders: sender, receiver, amount, t, edge_role, ring_id, ring_type.
    A seat is a new account or a consumer; the consumers of different seats are different ones."""
    d, at = Draw(seed), blocks(accounts)
    plan, number = [], 0
    for k, split in enumerate(SPLITS):
        for shape in allocate(RINGS[split]):
            plan.append((number, k, PREFIX[split], shape.name, *shape.size, *shape.payments, shape.jitter, shape.hijack, *(shape.burst or (0, 0)), *shape.feeders, shape.open))
            number += 1
    df = spark.createDataFrame(plan, "ring_id int, k int, prefix string, ring_type string, n0 int, n1 int, p0 int, p1 int, jitter double, hijack double, b0 int, b1 int, f0 int, f1 int, open double")
    ring = F.col("ring_id")
    df = df.withColumns({"n": d.whole("size", F.col("n0"), F.col("n1"), ring), "base": d.between("base", 4_000, 60_000, ring), "shut": d.u("open", ring) >= F.col("open"), "origin": F.col("k") * (DAYS // 3) + d.u("origin", ring) * (DAYS // 3 - 4)})
    low, high = at["consumer"]
    width = high - low + 1
    stride = next(p for p in (7_919, 104_729, 15_485_863) if width % p)
    if width < number * 8:
        raise ValueError("too few consumers for the rings' seats")
    slot = lambda i: ring * 8 + i
    seat = lambda i: F.when(d.u("hijack", ring, i) < F.col("hijack"), _name(F.lit(low) + (slot(i).cast("long") * stride) % width)).otherwise(F.concat("prefix", F.lpad(slot(i).cast("string"), 4, "0")))
    i = F.col("i")
    pairs = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).where("shut or i < n - 1").select("*", seat(i).alias("sender"), seat((i + 1) % F.col("n")).alias("receiver"), F.lit("ring").alias("edge_role"), d.whole("count", F.col("p0"), F.col("p1"), ring, i).alias("m"))
    fed = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), d.whole("feeders", F.col("f0"), F.col("f1"), ring) - 1)).alias("i")).select("*", _name(d.whole("feeder", low, high, ring, i)).alias("sender"), seat(i % F.col("n")).alias("receiver"), F.lit("fan_in").alias("edge_role"), d.whole("count.f", 1, 2, ring, i).alias("m"))
    e = pairs.unionByName(fed).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("j")).where("sender <> receiver")
    ks = [ring, i, F.col("j"), F.col("edge_role")]
    amount = F.col("base") * F.exp(F.col("jitter") * d.normal("amount", *ks) - F.col("jitter") * F.col("jitter") / 2)
    grain = d.u("grain", *ks)
    smeared = _stamp(d, F.col("k") * (DAYS // 3) + d.u("day", *ks) * (DAYS // 3), _hour(d, *ks), *ks)
    span = (F.col("b0") + d.u("span", ring) * (F.col("b1") - F.col("b0"))) * 3_600
    burst = diurnal_in_span(d, (F.lit(START) + F.floor(F.col("origin") * 86_400)).cast("long"), span, *ks)
    inside = e.select("sender", "receiver", F.when(grain < 0.16, nice(amount)).when(grain < 0.31, F.round(amount)).otherwise(F.round(amount, 2)).alias("amount"), F.when(F.col("b1") == 0, smeared).otherwise(burst).alias("t"), "edge_role", "ring_id", "ring_type", F.col("k").alias("k"))
    # New accounts get a thin ordinary life: partners of their own, none of whom has a seat or another mule.
    own = F.xxhash64("node", "k", "p")
    mules = df.select("k", "prefix", "hijack", "n", "ring_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).where(d.u("hijack", ring, i) >= F.col("hijack"))
    # As many rows as the rings have seats, a few hundred.
    mules = mules.select("k", F.concat("prefix", F.lpad(slot(i).cast("string"), 4, "0")).alias("node"), (F.row_number().over(Window.orderBy(slot(i))) - 1).cast("long").alias("place"))
    partner = mules.select("*", F.posexplode(F.sequence(F.lit(1), d.whole("cover", *COVER_PARTNERS, F.col("node")).cast("int"))).alias("p", "_")).withColumn("at", F.lit(number * 8).cast("long") + F.col("place") * COVER_PARTNERS[1] + F.col("p"))
    free = F.when(F.col("at") < width, _name(F.lit(low) + (F.col("at") * stride) % width)).otherwise(F.raise_error(F.lit("too few consumers for the mules' partners")).cast("string"))
    partner = partner.select("k", "node", free.alias("other"), (d.u("cover.out", own) < COVER_OUT).alias("out"), own.alias("key"), d.whole("cover.n", *COVER_PAYMENTS, own).alias("m"))
    cover = partner.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("j"))
    js = [F.col("key"), F.col("j")]
    cover = cover.select(
        F.when(F.col("out"), F.col("node")).otherwise(F.col("other")).alias("sender"), F.when(F.col("out"), F.col("other")).otherwise(F.col("node")).alias("receiver"), F.round(d.between("cover.a", *COVER_AMOUNT, *js), 2).alias("amount"),
        _stamp(d, F.col("k") * (DAYS // 3) + d.u("cover.d", *js) * (DAYS // 3), _hour(d, *js), *js).alias("t"), F.lit("organic_camouflage").alias("edge_role"), F.lit(-1).alias("ring_id"), F.lit("organic").alias("ring_type"), "k",
    )
    return inside.unionByName(cover)


def ledger(spark: SparkSession, accounts: int = 3000, seed: int = 42) -> DataFrame:
    """The whole ledger: no self-transfers, amounts over 0. A ring's consumer is known by another name once
    the ring's window is over, so that no account is a positive of one split and active in a later one."""
    o = organic(spark, accounts, seed).where("s <> r").select(_name(F.col("s")).alias("sender"), _name(F.col("r")).alias("receiver"), "amount", "t", F.col("role").alias("edge_role"), F.lit(-1).alias("ring_id"), F.lit("organic").alias("ring_type"))
    ringed = rings(spark, accounts, seed)
    seats = ringed.where("edge_role = 'ring'").select(F.explode(F.array("sender", "receiver")).alias("node"), "k").groupBy("node").agg((F.lit(START) + (F.min("k") + 1) * (DAYS // 3) * 86_400).alias("until"))
    e = o.unionByName(ringed.drop("k"))
    for side in ("sender", "receiver"):
        gone = seats.toDF(side, "until")
        e = e.join(gone, side, "left").withColumn(side, F.when(F.col("t") >= F.col("until"), F.concat(side, F.lit("__SUCC"))).otherwise(F.col(side))).drop("until")
    third = DAYS // 3 * 86_400
    split = F.when(F.col("t") < START + third, "train").when(F.col("t") < START + 2 * third, "val").otherwise("test")
    full = e.where("sender <> receiver").select("*", F.timestamp_seconds("t").alias("timestamp"), (F.col("ring_id") >= 0).cast("int").alias("is_mule"), split.alias("split"))
    return full.select(*[F.col(f.name).cast(f.dataType) for f in EDGES.fields])
