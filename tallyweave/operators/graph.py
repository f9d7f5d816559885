"""The payment graph: pairs, per-account features, fixpoints. Every function is DataFrame to DataFrame.

Fixpoint loops write each round to the shared folder, so the lineage stays short and a lost
executor costs one round's tasks at most."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyweave.functions.contract import FEATURES
from tallyweave.operators import arrays, scan
from tallyweave.work import PART, cut, dealt, handed, looping, together

DAMPING, MIN_REPEATS, MIN_CYCLE, MAX_CYCLE = 0.85, 2, 3, 8
WINDOW_DAYS = 60.0
#: Neighbours of one row of links, and hops between two written states.
CHUNK, HOPS = 1024, 5
#: Links of a graph whose fixpoints one task computes over arrays (`arrays`).
ALONE = 4_000_000
#: Ends of payments of one account that one task may hold for its local features.
HEAVY = 1_000_000


def pairs(ledger: DataFrame) -> DataFrame:
    """One row per ordered pair: weight (payments) and total."""
    return ledger.groupBy("sender", "receiver").agg(F.count("*").alias("weight"), F.sum("amount").alias("total"))


def nodes(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.col("sender").alias("node")).union(ledger.select("receiver")).distinct()


def undirected(p: DataFrame) -> DataFrame:
    return p.groupBy(F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b")).agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def window_days(ledger: DataFrame) -> DataFrame:
    """One row: days between the first and the last payment (0.0 if none), and the scale to 60 days."""
    days = F.coalesce((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 86_400_000_000.0, F.lit(0.0))
    return ledger.agg(days.alias("days")).select("days", F.when(F.col("days") >= 1, WINDOW_DAYS / F.col("days")).otherwise(1.0).alias("scale"))


def ends(ledger: DataFrame) -> DataFrame:
    """Each payment once for each of its two accounts: node, other, out (1 for the sender), amount, ts."""
    side = lambda a, b, out: ledger.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(out).alias("out"), "amount", "ts")
    return side("sender", "receiver", 1).union(side("receiver", "sender", 0))


def _ratio(a: Column, b: Column, undefined: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(undefined))


def _by_node(e: DataFrame) -> DataFrame:
    """Sums of the ends (node, other, out, amount, ts) of each account: over its payments, its counterparties, its hours."""
    us = F.unix_micros("ts")
    amount = F.col("amount").cast("double")
    # Squares of four-decimal amounts are summed exactly, so partial sums in any order agree.
    square = (F.col("amount") * F.col("amount")).cast("decimal(38,8)")
    by_other = e.groupBy("node", "other").agg(
        F.sum("out").alias("n_out"), F.sum(1 - F.col("out")).alias("n_in"), F.sum(F.when(F.col("out") == 0, F.col("amount"))).alias("s_in"), F.sum(F.when(F.col("out") == 1, F.col("amount"))).alias("s_out"),
        F.count("*").alias("n"), F.sum("amount").alias("s"), F.sum(square).alias("q"), F.min(us).alias("first"), F.max(us).alias("last"), F.avg(amount).alias("mean"),
    )
    s_in = F.col("s_in").cast("double")
    f = by_other.groupBy("node").agg(
        F.count_if(F.col("n_in") > 0).alias("in_degree"), F.count_if(F.col("n_out") > 0).alias("out_degree"), F.count_if((F.col("n_in") > 0) & (F.col("n_out") > 0)).alias("mutual"), F.count("*").alias("others"),
        F.coalesce(F.sum("s_in"), F.lit(0)).cast("double").alias("in_sum"), F.coalesce(F.sum("s_out"), F.lit(0)).cast("double").alias("out_sum"), F.sum(s_in * s_in).alias("in_squares"),
        F.sum("n").alias("n"), F.sum("s").cast("double").alias("s"), F.sum("q").cast("double").alias("q"), F.min("first").alias("first"), F.max("last").alias("last"), F.avg("mean").alias("m"), F.stddev_pop("mean").alias("sd"),
    )
    hour = e.groupBy("node", F.floor(us / 3_600_000_000).alias("hour")).count().groupBy("node").agg((F.max("count") / F.sum("count")).alias("burst_ratio"))
    return f.join(hour, "node")


def local_features(ledger: DataFrame) -> DataFrame:
    """All features that need an account's own payments only: degrees, flows, concentration, reciprocity,
    velocity, bursts, dispersion, repeats. Payments are dealt by account, five columns wide, and all sums are
    taken where they are then. Accounts of over HEAVY payments aren't dealt whole: theirs meet as sums by
    counterparty and by hour."""
    e = ends(ledger)
    heavy = F.broadcast(e.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("node"))
    f = _by_node(e.join(heavy, "node", "left_anti").repartition("node")).union(_by_node(e.join(heavy, "node", "left_semi")))
    low, high = F.least("in_degree", "out_degree"), F.greatest("in_degree", "out_degree")
    hours = (F.col("last") - F.col("first")) / 3_600_000_000.0
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    scale = window_days(ledger).select("scale")
    return f.crossJoin(F.broadcast(scale)).select(
        "node", "in_degree", "out_degree", (F.col("out_degree") / F.greatest("in_degree", F.lit(1))).alias("degree_ratio"), _ratio(low, high, 0.0).alias("degree_balance"),
        F.round(F.col("in_sum") * F.col("scale"), 2).alias("in_amount_sum"), F.round(F.col("out_sum") * F.col("scale"), 2).alias("out_amount_sum"),
        _ratio(F.least("in_sum", "out_sum"), F.greatest("in_sum", "out_sum"), 0.0).alias("flow_passthrough"), (F.col("mutual") / F.col("others")).alias("reciprocity"),
        _ratio(F.col("in_squares"), F.col("in_sum") * F.col("in_sum"), 1.0).alias("fan_in_concentration"),
        F.when((F.col("n") >= 2) & (hours > 0), F.col("n") / hours).otherwise(0.0).alias("txn_velocity"), "burst_ratio",
        F.when((F.col("n") >= 2) & (mean != 0), spread / mean).otherwise(1.0).alias("amount_cv"),
        F.when((F.col("others") >= 2) & (F.col("m") != 0), F.col("sd") / F.col("m")).otherwise(1.0).alias("counterparty_amount_cv"),
        (F.col("n") / F.col("others") * F.col("scale")).alias("repeat_ratio"),
    )


def clustering(ledger: DataFrame) -> DataFrame:
    """Directed clustering: triangles over all possible ones, from the symmetric multiplicities. Each triangle is
    found once, at the edge of its two ends with the fewest links: what both of these are linked with further up
    is where their lists of neighbours meet. Lists are cut into buckets of some CHUNK accounts, so there is a row for
    each edge and bucket at most, and no list is a hub's."""
    one_way = lambda x, y: F.max((F.col(x) < F.col(y)).cast("int"))
    pair = ledger.groupBy(F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b"))
    s = cut(pair.agg((one_way("sender", "receiver") + one_way("receiver", "sender")).alias("m")).withColumn("m", F.when(F.col("a") == F.col("b"), 2).otherwise(F.col("m"))))
    deg = s.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node"), "m").groupBy("node").agg(F.sum("m").alias("dt"), F.count_if(F.col("m") == 2).alias("db"), F.count("*").alias("d"))
    # Any number of its own does for an account; lists of numbers are half as wide as those of names.
    deg = cut(deg.withColumn("i", F.monotonically_increasing_id()))
    end = lambda x: deg.select(F.col("node").alias(x), F.struct("d", "i").alias(f"of_{x}"))
    up = s.where("a <> b").join(end("a"), "a").join(end("b"), "b").select(F.least("of_a", "of_b")["i"].alias("i"), F.greatest("of_a", "of_b")["i"].alias("j"), "m")
    up = cut(up)
    # Neighbours with more links are at most the root of all edges; the same buckets for all, so lists meet by bucket.
    widest = up.groupBy("i").count().agg(F.max("count")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("j"), F.lit(max(1, -(-widest // CHUNK))))
    lists = cut(up.groupBy("i", bucket.alias("bucket")).agg(*[F.collect_list(F.when(F.col("m") == k, F.col("j"))).alias(f"n{k}") for k in (1, 2)]))
    first, second = lists.toDF("u", "bucket", "a1", "a2"), lists.toDF("v", "bucket", "b1", "b2")
    # The list of the end with more links is the shorter one, so that is what an edge brings to its other end;
    # edges come by v, so equal lists follow each other there, and nothing as wide is sorted after that.
    both = up.toDF("u", "v", "m").join(second.hint("merge"), "v").join(first.hint("shuffle_hash"), ["u", "bucket"])
    third = lambda x, y: F.transform(F.array_intersect(f"a{x}", f"b{y}"), lambda w: F.struct(w.alias("i"), (F.col("m") * x * y).alias("t")))
    met = both.select("u", "v", F.concat(third(1, 1), third(1, 2), third(2, 1), third(2, 2)).alias("w")).where(F.size("w") > 0)
    sums = F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + x["t"])
    per = met.select(F.inline(F.concat(F.array(F.struct(F.col("u").alias("i"), sums.alias("t")), F.struct(F.col("v").alias("i"), sums.alias("t"))), "w"))).groupBy("i").agg((2 * F.sum("t")).alias("t"))
    possible = 2 * (F.col("dt") * (F.col("dt") - 1) - 2 * F.col("db"))
    return deg.join(per, "i", "left").select("node", F.when(F.col("t").isNotNull() & (possible > 0), F.col("t") / possible).otherwise(0.0).alias("clustering_coefficient"))


def _alone(p: DataFrame) -> bool:
    """Whether one task holds these pairs, all of whose ends have names."""
    n = p.agg(F.count("*").alias("n"), F.count_if(F.col("sender").isNull() | F.col("receiver").isNull()).alias("odd")).first()
    return n["n"] <= ALONE and not n["odd"]


def pagerank(ledger: DataFrame, rounds: int = 20, tolerance: float | None = None, scale: bool = True) -> DataFrame:
    """PageRank times the number of accounts (mean 1; without `scale` the probabilities), weighted by payments;
    dangling mass is spread evenly. A fixed number of rounds, or until the summed change is under
    tolerance times accounts (looked at every fifth round).

    Links and accounts are held on disk, dealt by payer, so a round shuffles what accounts give, summed up
    before, and writes the sums once; the share of accounts that pay nobody comes in the same pass. Rounds over links that
    one task holds run there."""
    p = cut(pairs(ledger).select("sender", "receiver", "weight"))
    if _alone(p):
        return cut(p.coalesce(1).mapInArrow(arrays.pagerank(rounds, tolerance, DAMPING, scale), "node string, pagerank double"))
    out = p.groupBy("sender").agg(F.sum("weight").alias("w"))
    n_parts = int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = lambda df: df.repartition(n_parts, "node").persist(StorageLevel.DISK_ONLY)
    links = p.join(out, "sender").select(F.col("sender").alias("node"), "receiver", (F.col("weight") / F.col("w")).alias("share"))
    every = cut(nodes(ledger))
    lost = every.join(out.select(F.col("sender").alias("node")), "node", "left_anti").select("node", F.lit(None).cast("string").alias("receiver"), F.lit(1.0).alias("share"))
    links, names = held(cut(links.union(lost))), held(every)
    n = every.count()
    rank = names.select("node", F.lit(1.0).alias("rank"))
    for k in range(rounds):
        got = cut(links.join(rank, "node").groupBy("receiver").agg(F.sum(F.col("rank") * F.col("share")).alias("got")))
        spread = got.where("receiver is null").agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("lost"))
        new = names.join(got.withColumnRenamed("receiver", "node"), "node", "left").crossJoin(F.broadcast(spread)).select("node", (1 - DAMPING + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if tolerance is not None and k % 5 == 4:
            change = new.join(rank.select("node", F.col("rank").alias("was")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("c")).first()["c"]
            if (change or 0.0) < n * tolerance:
                rank = new
                break
        rank = new
    made = cut(rank.select("node", (F.col("rank") if scale else F.col("rank") / max(n, 1)).alias("pagerank")))
    links.unpersist()
    names.unpersist()
    return made


def _peeled(every: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of all accounts and their links (node, receiver, share): those (node, rank) whose payers all are among them,
    with their rank before scaling; the others (node, left) with what these give to them; and the links of the others."""
    done, state, n = None, cut(every.withColumn("left", F.lit(1.0))), links.count()
    while n:
        paid = links.select(F.col("receiver").alias("node")).distinct()
        gone = cut(state.join(paid, "node", "left_anti"))
        rest = cut(links.join(gone.select("node"), "node", "left_anti"))
        m = rest.count()
        if 10 * (n - m) < n:
            break
        given = links.join(gone, "node").groupBy(F.col("receiver").alias("node")).agg(F.sum(F.col("share") * F.col("left")).alias("given"))
        state = cut(state.join(gone.select("node"), "node", "left_anti").join(given, "node", "left").select("node", (F.col("left") + F.coalesce("given", F.lit(0.0))).alias("left")))
        finished = gone.select("node", F.col("left").alias("rank"))
        done, links, n = finished if done is None else done.union(finished), rest, m
    return state.select("node", F.col("left").alias("rank")).limit(0) if done is None else done, state, links


def converged_pagerank(ledger: DataFrame, tolerance: float = 1e-6, scale: bool = True, most: int = 400) -> DataFrame:
    """PageRank to its fixpoint, by pushes of what is left to send: only accounts with a residual over a share of
    the tolerance send, so rounds shrink. What accounts that pay nobody hold is spread evenly, which scales all
    ranks alike; so it isn't sent, and ranks are scaled at the end.

    Accounts that nobody pays send once, and need no rounds: they go first, then those that only these had paid, and
    so on while that takes a tenth of the links that are left (`_peeled`). Rounds run over the others alone.

    A hop is one shuffle: accounts meet their links (in rows of CHUNK receivers at most, held dealt by payer), and
    give out their own state and what others get of it together. The state is written every HOPS hops.

    Links that one task holds need neither: it sends whatever is left, and peels nothing."""
    p = cut(pairs(ledger).select("sender", "receiver", "weight"))
    if _alone(p):
        return cut(p.coalesce(1).mapInArrow(arrays.converged_pagerank(tolerance * (1 - DAMPING) / 2, DAMPING, scale, most), "node string, pagerank double"))
    out = p.groupBy("sender").agg(F.sum("weight").alias("w"))
    shares = p.join(out, "sender").select(F.col("sender").alias("node"), "receiver", (DAMPING * F.col("weight") / F.col("w")).alias("share"))
    done, state, shares = _peeled(cut(nodes(ledger)), cut(shares))
    chunks = shares.groupBy("node").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    links = shares.join(chunks, "node").select("node", F.pmod(F.xxhash64("receiver"), F.col("chunks")).cast("int").alias("chunk"), F.struct("receiver", "share").alias("to"))
    n_parts = 1 if shares.count() <= PART else int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = lambda df: df.coalesce(1) if n_parts == 1 else df
    links = links.groupBy("node", "chunk").agg(F.collect_list("to").alias("to"))  # some CHUNK receivers
    none = F.array().cast("array<struct<receiver:string,share:double>>")
    held = dealt(cut(links.union(state.select("node", F.lit(-1), none))), n_parts, "node").persist(StorageLevel.DISK_ONLY)
    bound = tolerance * (1 - DAMPING) / 2
    state = state.select("node", F.lit(0.0).alias("rank"), "left")
    sends = F.col("left") > bound
    for _ in range(0, most, HOPS):
        for _ in range(HOPS):
            own = F.array(F.struct(F.col("node"), (F.col("rank") + F.when(sends, F.col("left")).otherwise(0.0)).alias("rank"), F.when(sends, 0.0).otherwise(F.col("left")).alias("left")))
            given = F.when(sends, F.transform("to", lambda t: F.struct(t["receiver"].alias("node"), F.lit(0.0).alias("rank"), (t["share"] * F.col("left")).alias("left")))).otherwise(F.array().cast("array<struct<node:string,rank:double,left:double>>"))
            state = one(state).join(held.hint("merge"), "node").select(F.inline(F.when(F.col("chunk") < 0, own).otherwise(given))).groupBy("node").agg(F.sum("rank").alias("rank"), F.sum("left").alias("left"))
        state = cut(state)
        if state.where(sends).isEmpty():
            break
    state = state.select("node", "rank").union(done)
    total = state.agg(F.sum("rank").alias("total"), F.count("*").alias("n"))
    unit = F.col("n") / F.col("total") if scale else 1 / F.col("total")
    made = cut(state.crossJoin(F.broadcast(total)).select("node", (F.col("rank") * unit).alias("pagerank")))
    held.unpersist()
    return made


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that edges lead to. Each round hooks
    nodes to their smallest neighbour and that one's, and contracts the edges; at least half of the nodes go."""
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known: DataFrame | None = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        step = cut(hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up", "left").select("node", F.coalesce("upper", "up").alias("root")))
        known = step if known is None else cut(known.withColumnRenamed("root", "was").join(step.withColumnRenamed("node", "was"), "was", "left").select("node", F.coalesce("root", "was").alias("root")))
        moved = left.join(step.toDF("a", "x"), "a").join(step.toDF("b", "y"), "b").where("x <> y")
        left = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if known is None else known


def connected(u: DataFrame, partition: DataFrame) -> DataFrame:
    """The partition (node, community) with each community cut into its connected parts, each named by its smallest
    account. What isn't connected gains nothing by standing together, so modularity doesn't fall."""
    p = partition.select("node", "community")
    inside = u.select("a", "b").join(p.toDF("a", "ca"), "a").join(p.toDF("b", "cb"), "b").where("ca = cb").select("a", "b")
    roots = components(inside)
    return cut(p.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("community")))


def repeated(ledger: DataFrame, least: int = MIN_REPEATS) -> DataFrame:
    return pairs(ledger).where(F.col("weight") >= least).select("sender", "receiver")


def core(edges: DataFrame) -> DataFrame:
    """Peels accounts without an edge in or out until none is left to peel."""
    edges = cut(edges)
    n = edges.count()
    while n:
        smaller = cut(edges.join(edges.select(F.col("receiver").alias("sender")).distinct(), "sender", "left_semi").join(edges.select(F.col("sender").alias("receiver")).distinct(), "receiver", "left_semi").select("sender", "receiver"))
        m = smaller.count()
        if m == n:
            break
        edges, n = smaller, m
    return edges


def _walks(front: DataFrame, seen: list[DataFrame], wanted: DataFrame, step: DataFrame) -> DataFrame:
    """The next hop of walks (end, x, via) from the wanted ends: of each end and account two first hops are kept
    at most, those of earlier rounds counted, so that one is left whichever is forbidden."""
    reached = front.join(wanted, "end", "left_semi").join(step, "x").where("y <> end").groupBy("end", F.col("y").alias("x")).agg(F.array_distinct(F.array(F.min("via"), F.max("via"))).alias("new"))
    before = seen[0]
    for more in seen[1:]:
        before = before.union(more)
    before = before.join(wanted, "end", "left_semi").groupBy("end", "x").agg(F.collect_set("via").alias("old"))  # two at most
    fresh = reached.join(before, ["end", "x"], "left").withColumn("old", F.coalesce("old", F.array().cast("array<string>")))
    return cut(fresh.select("end", "x", F.explode(F.slice(F.array_except("new", "old"), 1, 2 - F.size("old"))).alias("via")))


def closing_edges(edges: DataFrame) -> DataFrame:
    """The edges u->v of a core that lie on a directed cycle of 3 to 8 accounts: a way from v back to u of at
    most 7 hops, other than the one hop v->u.

    Walks go out from v and back from u in turn, and meet: for cycles of 3 after a hop each, for those of 8 after
    four and three. An edge whose shortest cycle is found is dropped, and walks go on from the ends of those alone
    that are left; in a dense core these are few after two rounds. A walk is known by its ends and its first hop,
    of which two are kept, as one may be the hop v->u."""
    succ = edges.select(F.col("sender").alias("x"), F.col("receiver").alias("y"))
    pred = succ.toDF("y", "x")
    left = cut(edges.select(F.col("sender").alias("u"), F.col("receiver").alias("v")).distinct())
    outs = [cut(succ.select(F.col("x").alias("end"), F.col("y").alias("x"), F.col("y").alias("via")).where("end <> x"))]
    backs = [cut(succ.select(F.col("y").alias("end"), "x", F.col("x").alias("via")).where("end <> x"))]
    closed = None
    for length in range(3, MAX_CYCLE + 1):
        if length > 3:
            if length % 2 == 0:
                outs.append(_walks(outs[-1], outs, left.select(F.col("v").alias("end")).distinct(), succ))
            else:
                backs.append(_walks(backs[-1], backs, left.select(F.col("u").alias("end")).distinct(), pred))
        out, back = outs[-1].toDF("v", "x", "first"), backs[-1].toDF("u", "x", "last")
        met = left.join(out, "v").where("x <> u and first <> u").join(back, ["u", "x"]).where("x <> v and last <> v").select("u", "v").distinct()
        met = cut(met)
        closed = met if closed is None else closed.union(met)
        left = cut(left.join(met, ["u", "v"], "left_anti"))
        if left.isEmpty():
            break
    return closed


def cycle_participation(ledger: DataFrame) -> DataFrame:
    """Share of an account's repeated counterparties that are with it on such a cycle."""
    r = cut(repeated(ledger))
    near = r.union(r.select("receiver", "sender")).toDF("node", "other").distinct()
    c = closing_edges(core(r))
    on = c.select("u", "v").union(c.select("v", "u")).toDF("node", "other").distinct()
    share = near.groupBy("node").agg(F.count("*").alias("d")).join(on.groupBy("node").agg(F.count("*").alias("k")), "node", "left")
    return nodes(ledger).join(share, "node", "left").select("node", F.coalesce(F.col("k") / F.col("d"), F.lit(0.0)).alias("cycle_participation"))


def hops(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """Accounts within `depth` hops of start and their distances; start itself is left out."""
    e = edges.select(F.col("sender").alias("x"), F.col("receiver").alias("node"))
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node string, hops int")
    front = seen
    for k in range(1, depth + 1):
        front = cut(front.select(F.col("node").alias("x")).join(e, "x").select("node").distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.where("hops > 0")


def k_hop(ledger: DataFrame, seeds: DataFrame, most: int, rounds: int = 1) -> DataFrame:
    """Accounts around the seeds, at most `most` of them: of a round that has too many, those with the
    most linking payments, then the smaller id."""

    kept = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for k in range(1, rounds + 1):
        have = kept.count()
        links = ends(ledger).join(kept.select(F.col("node").alias("other")), "other", "left_semi").join(kept.select("node"), "node", "left_anti").groupBy("node").count()
        # The view is a bounded one (`most` rows), so this rank is a top-k.
        top = links.orderBy(F.desc("count"), "node").limit(max(0, most - have))
        kept = cut(kept.union(top.select("node", F.lit(k))))
    return kept


def internal_ratio(undirected_edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Of each community (node, community): edges inside over edges inside and on its boundary."""
    a, b = partition.toDF("a", "ca"), partition.toDF("b", "cb")
    e = undirected_edges.join(a, "a").join(b, "b")
    touched = e.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community"), (F.col("ca") == F.col("cb")).cast("int").alias("inside"))
    ratio = touched.groupBy("community").agg((F.sum("inside") / F.count("*")).alias("r"))
    return partition.join(ratio, "community", "left").select("node", F.coalesce("r", F.lit(0.0)).alias("community_internal_ratio"))


def modularity(u: DataFrame, partition: DataFrame, resolution: float = 1.0) -> float:
    """Of a partition (node, community) of an undirected graph (a, b, weight; a loop counts once)."""
    e = u.select("a", "b", F.col("weight").cast("double").alias("w"))
    p = partition.select("node", "community")
    both = e.join(p.toDF("a", "ca"), "a").join(p.toDF("b", "cb"), "b")
    inside = both.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w"))).alias("i"), F.sum("w").alias("m")).first()
    if not inside["m"]:
        return 0.0
    ends = both.select(F.inline(F.array(F.struct(F.col("ca").alias("c"), "w"), F.struct(F.col("cb").alias("c"), "w")))).groupBy("c").agg(F.sum("w").alias("k"))
    return (inside["i"] or 0.0) / inside["m"] - resolution * ends.agg(F.sum(F.col("k") * F.col("k")).alias("s")).first()["s"] / (2 * inside["m"]) ** 2


def _numbers(names: DataFrame) -> DataFrame:
    """(node, i): a number for each of the names (node), in their order; its last bit is the half that the name is in."""
    number = F.shiftleft("place", 1) + F.pmod(F.xxhash64("node"), F.lit(2))
    return cut(scan.running(names, [F.col("node")], place="place").select("node", number.alias("i")))


def _renamed(df: DataFrame, names: DataFrame, old: str, new: str, *columns: str) -> DataFrame:
    """df with each of the columns in the words of `new`, by names (old, new)."""
    order = df.columns
    for c in columns:
        df = df.join(names.select(F.col(old).alias(c), F.col(new).alias("_new")), c).withColumn(c, F.col("_new")).drop("_new")
    return df.select(*order)


def _local_moves(both: DataFrame, loops: DataFrame, total: float, rounds: int) -> tuple[DataFrame, bool]:
    """Local moving (`_numbered_moves`) over accounts with names: both (x, y, w), loops (node, w)."""
    names = _numbers(both.select(F.col("x").alias("node")).union(loops.select("node")).distinct())
    part, moved = _numbered_moves(_renamed(both, names, "node", "i", "x", "y"), _renamed(loops, names, "node", "i", "node"), total, rounds)
    return _renamed(part, names, "i", "node", "node", "community"), moved


def _numbered_moves(both: DataFrame, loops: DataFrame, total: float, rounds: int) -> tuple[DataFrame, bool]:
    """A level of local moving over both (x, y, w) and loops (node, w): (node, community), and whether any
    moved. Halves of the accounts, by hash, move in turn, to communities of smaller names and then to those
    of larger ones, so no two accounts can swap for ever; it ends when all four turns are still. Accounts and
    communities are numbers (`_numbers`), so a round compares, sums and deals nothing wider.

    Each half's links are held dealt by y, in rows of CHUNK accounts at most, which bring x's strength along, beside
    a row of y's own. Accounts meet these and give out their community with its strength to x, and their own
    state to themselves; so a round shuffles the links of one half once, by x, and what an account gets is all that its
    move and its new state need. Links of PART rows or less are in one partition, and such rounds shuffle nothing; others
    are in as many as the session's shuffles, but of PART to 4 * PART rows. Rounds run in a session of their own
    (`looping`)."""
    spark, n = both.sparkSession, both.count()
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * PART))), -(-n // PART)) or 1
    half = lambda i: F.col(i).bitwiseAND(F.lit(1).cast("long"))
    strength = cut(both.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("k")).join(loops, "node", "full").select("node", (F.coalesce("k", F.lit(0.0)) + 2 * F.coalesce("w", F.lit(0.0))).alias("k")))
    links = both.toDF("to", "from", "w").join(strength.select(F.col("node").alias("to"), "k"), "to")
    chunks = both.groupBy(F.col("y").alias("from")).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    links = links.join(chunks, "from").groupBy(F.col("from").alias("node"), half("to").alias("half"), F.pmod(F.xxhash64("to"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct(F.col("to").alias("x"), "w", "k")).alias("to"))
    loop = looping(spark, parts)
    links, state = handed(links, loop), handed(strength, loop)
    own = state.select("node", F.array(F.struct(F.col("node").alias("x"), F.lit(0.0).alias("w"), "k")).alias("to"), F.lit(True).alias("self"))
    held = [dealt(links.where(F.col("half") == h).select("node", "to", F.lit(False).alias("self")).union(own), parts, "node").sortWithinPartitions("node").persist(StorageLevel.DISK_ONLY) for h in (0, 1)]
    part = state.select("node", F.col("node").alias("community"), "k")
    still, any_moved = 0, False
    for r in range(rounds):
        part = part.coalesce(1) if parts == 1 else part
        tot = part.groupBy("community").agg(F.sum("k").alias("tot"))
        placed = dealt(part.select("node", "community").join(tot.hint("merge") if parts == 1 else tot, "community"), parts, "node")
        given = placed.join(held[r % 2].hint("merge"), "node").select(F.explode("to").alias("t"), "community", "tot", "self").select("t.*", "community", "tot", "self")
        kin = dealt(given, parts, "x").groupBy("x", "community").agg(F.sum("w").alias("kin"), F.max("tot").alias("tot"), F.max("k").alias("k"), F.max("self").alias("stays"))
        # The own community is a choice too, if only with what the account brings along.
        g = kin.withColumn("gain", F.round(F.col("kin") - F.col("k") * (F.col("tot") - F.when(F.col("stays"), F.col("k")).otherwise(0.0)) / total, 9))
        # Ties stay where they are, then go to the smaller name.
        best = g.groupBy("x").agg(F.min_by("community", F.struct(-F.col("gain"), (~F.col("stays")).cast("int"), "community")).alias("target"), F.max("gain").alias("top"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("now"), F.max(F.when(F.col("stays"), F.col("community"))).alias("own"), F.max("k").alias("k"))
        moves = (half("x") == r % 2) & (F.col("top") > F.col("now")) & (F.col("target") < F.col("own") if r // 2 % 2 == 0 else F.col("target") > F.col("own"))
        seen = Observation()
        part = cut(best.select(F.col("x").alias("node"), F.when(moves, F.col("target")).otherwise(F.col("own")).alias("community"), "k", moves.alias("moved")).observe(seen, F.count_if("moved").alias("moved"))).drop("moved")
        moved = seen.get["moved"] > 0
        any_moved, still = any_moved or moved, 0 if moved else still + 1
        if still == 4:
            break
    for rows in held:
        rows.unpersist()
    return handed(part.select("node", "community"), spark), any_moved


def communities(u: DataFrame, rounds: int = 40, levels: int = 10) -> DataFrame:
    """A deterministic partition of an undirected graph (a, b, weight) by modularity: accounts move to the
    community with the largest gain, then communities become the nodes of a smaller graph, on which the
    same is done, until nothing moves or modularity doesn't rise. In the end every community is connected: parts that
    moves have left without a link between them are communities of their own. Accounts are numbers (`_numbers`) until
    the end. (node, community: its smallest member's name)"""
    names = _numbers(u.select(F.col("a").alias("node")).union(u.select("b")).distinct())
    e = cut(_renamed(u.select("a", "b", F.col("weight").cast("double").alias("weight")), names, "node", "i", "a", "b"))
    total = 2.0 * (e.agg(F.sum("weight").alias("m")).first()["m"] or 0.5)
    members = names.select(F.col("i").alias("node"), F.col("i").alias("community"))
    level, best = e, modularity(e, members)
    for _ in range(levels):
        apart = level.where("a <> b")
        both = cut(apart.select("a", "b", "weight").union(apart.select("b", "a", "weight")).toDF("x", "y", "w"))
        loops = level.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("w"))
        part, moved = _numbered_moves(both, loops, total, rounds)
        if not moved:
            break
        merged = cut(members.join(part.toDF("community", "into"), "community", "left").select("node", F.coalesce("into", "community").alias("community")))
        now = modularity(e, merged)
        if now <= best + 1e-9:
            break
        members, best = merged, now
        named = level.join(part.toDF("a", "ca"), "a").join(part.toDF("b", "cb"), "b")
        level = cut(named.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")))
    return cut(_renamed(connected(e, members), names, "i", "node", "node", "community"))


def partitioned(u: DataFrame, rounds: int = 40, levels: int = 10) -> DataFrame:
    """`communities`, in one task where that holds all links."""
    e = cut(u.select("a", "b", F.col("weight").cast("double").alias("weight")))
    if e.count() > ALONE:
        return communities(e, rounds, levels)
    names = _numbers(e.select(F.col("a").alias("node")).union(e.select("b")).distinct())
    links = cut(_renamed(e, names, "node", "i", "a", "b"))
    part = cut(links.coalesce(1).mapInArrow(arrays.communities(rounds, levels), "node long, community long"))
    return cut(_renamed(part, names, "i", "node", "node", "community"))


def features(ledger: DataFrame, partition: DataFrame | None = None, rounds: int = 200, tolerance: float | None = 1e-4) -> DataFrame:
    """All eighteen features and the community of every account, in the order of the contract."""
    u = undirected(pairs(ledger))
    partition = partitioned(u) if partition is None else partition
    out = local_features(ledger)
    loops = together(lambda: pagerank(ledger, rounds, tolerance), lambda: clustering(ledger), lambda: cycle_participation(ledger))
    for more in (*loops, internal_ratio(u, partition), partition):
        out = out.join(more, "node", "left")
    return out.select("node", *FEATURES, "community")
