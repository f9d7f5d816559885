"""Payment ledgers, scored frames, and adapters of the test tables; files are in `files`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tallyweave.functions.scalars import split_at

LEDGER = T.StructType([T.StructField("sender", T.StringType()), T.StructField("receiver", T.StringType()), T.StructField("amount", T.DecimalType(18, 4)), T.StructField("ts", T.TimestampType())])
EDGES = T.StructType([*LEDGER.fields[:2], T.StructField("amount", T.DoubleType()), T.StructField("timestamp", T.TimestampType()), T.StructField("is_mule", T.IntegerType()), T.StructField("edge_role", T.StringType()), T.StructField("ring_id", T.IntegerType()), T.StructField("ring_type", T.StringType()), T.StructField("split", T.StringType())])
CONTEXT_COLUMNS = ("sender", "receiver", "amount", "timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def commerce_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers pay suppliers on ship dates; both share one space of ids."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    j = o.join(i, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.col("o_custkey").cast("string").alias("sender"), F.col("l_suppkey").cast("string").alias("receiver"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("amount"), F.col("l_shipdate").cast("timestamp").alias("ts")).where("sender <> receiver")


#: Seconds of a slice of events in which the next one is looked for.
SLICE = 6 * 3_600


def handoff_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user of an event hands over to the next user of the same event type.

    There are a handful of types, so the next event is looked for within slices of time; the last event of
    a slice takes the first one of the type's next slice, a table of one row per type and slice."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "user_id", "value").withColumn("slice", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (SLICE * 1_000_000)))
    place = F.struct("ts", "event_id")
    first = e.groupBy("event_type", "slice").agg(F.min_by("user_id", place).alias("head"))
    heads = first.withColumn("next_head", F.lead("head").over(Window.partitionBy("event_type").orderBy(F.col("slice").asc_nulls_first()))).select("event_type", "slice", "next_head")
    inside = e.withColumn("to", F.lead(F.struct("user_id")).over(Window.partitionBy("event_type", "slice").orderBy("ts", "event_id")))
    joined = inside.join(heads, inside["event_type"].eqNullSafe(heads["event_type"]) & inside["slice"].eqNullSafe(heads["slice"])).select(inside["*"], "next_head")
    return joined.select(F.col("user_id").cast("string").alias("sender"), F.when(F.col("to").isNotNull(), F.col("to.user_id")).otherwise(F.col("next_head")).cast("string").alias("receiver"), F.col("value").cast("decimal(18,4)").alias("amount"), F.col("ts").cast("timestamp").alias("ts")).where("sender <> receiver and amount is not null")


def labelled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commerce ledger with all columns of a split ledger, and `pos`, the order of its file. Orders whose
    number leaves 0 by 61 pay into a ring, 1 feed one, 2 are the cover of one; windows are equal thirds of
    whole days, of which the last takes what is left."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    d = o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).where("o_custkey <> l_suppkey").withColumn("timestamp", F.col("l_shipdate").cast("timestamp"))
    day = 86_400_000_000
    t, k = F.unix_micros("timestamp"), F.col("l_orderkey") % 61
    b = i.agg(F.floor(F.min(F.unix_micros(F.col("l_shipdate").cast("timestamp"))) / day).alias("lo"), (F.floor(F.max(F.unix_micros(F.col("l_shipdate").cast("timestamp"))) / day) + 1).alias("hi")).select("lo", F.floor((F.col("hi") - F.col("lo")) / 3).alias("third"))
    d = d.crossJoin(F.broadcast(b)).withColumn("split", split_at(t, (F.col("lo") + F.col("third")) * day, (F.col("lo") + 2 * F.col("third")) * day))
    role = F.when((k == 0) & (F.col("l_linenumber") == 1), "ring").when((k == 1) & (F.col("l_linenumber") == 1), "fan_in").when(k == 2, "organic_camouflage").when(F.col("l_orderkey") % 2 == 0, "organic_merchant").otherwise("organic_oneoff")
    d = d.withColumn("edge_role", role).withColumn("is_mule", F.col("edge_role").isin("ring", "fan_in").cast("int"))
    ring = F.when(F.col("is_mule") == 1, F.col("o_custkey") % 13 + 13 * F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)).otherwise(-1).cast("int")
    d = d.withColumn("ring_id", ring)
    kind = F.when(F.col("ring_id") < 0, "organic").when(F.col("ring_id") % 3 == 0, "fast_cycle").when(F.col("ring_id") % 3 == 1, "layered_fanin").otherwise("stealth_cycle")
    return d.select(
        F.col("o_custkey").cast("string").alias("sender"), F.col("l_suppkey").cast("string").alias("receiver"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("amount"), "timestamp",
        "is_mule", "edge_role", "ring_id", kind.alias("ring_type"), "split", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("pos"),
    )


def scored_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with a score full of ties, a label, a split by date and a ring of the positives."""
    o = table(spark, sf_dir, "orders")
    y = F.col("o_orderstatus") == "F"
    d = F.col("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"), (((F.col("o_orderkey") * 7919) % 1000) / 1000.0).cast("double").alias("score"), y.cast("int").alias("y"),
        F.when(d < "1997-03-12", "train").when(d < "1999-05-22", "val").otherwise("test").alias("split"),
        F.when(y, F.col("o_custkey") % 40).otherwise(-1).cast("bigint").alias("ring_id"),
        F.when(~y, "organic").when(F.col("o_custkey") % 40 % 3 == 0, "fast").when(F.col("o_custkey") % 40 % 3 == 1, "stealth").otherwise("layered").alias("ring_type"),
    )


#: The same relations for the independent engine.
SQL = {
    "ledger": "select * from (select cast(o_custkey as varchar) as sender, cast(l_suppkey as varchar) as receiver, cast(l_extendedprice * (1 - l_discount) as decimal(18,4)) as amount, cast(l_shipdate as timestamp) as ts from orders join lineitem on o_orderkey = l_orderkey) where sender <> receiver",
    "handoff": "select * from (select cast(user_id as varchar) as sender, cast(lead(user_id) over (partition by event_type order by ts, event_id) as varchar) as receiver, cast(value as decimal(18,4)) as amount, cast(ts as timestamp) as ts from events) where sender <> receiver and amount is not null",
    "edges": """select cast(o_custkey as varchar) as sender, cast(l_suppkey as varchar) as receiver, cast(l_extendedprice * (1 - l_discount) as decimal(18,4)) as amount, cast(l_shipdate as timestamp) as ts,
      cast(role in ('ring', 'fan_in') as integer) as is_mule, role as edge_role, ring_id, case when ring_id < 0 then 'organic' else ['fast_cycle', 'layered_fanin', 'stealth_cycle'][ring_id % 3 + 1] end as ring_type, split, l_orderkey * 8 + l_linenumber as pos
    from (select *, cast(case when role in ('ring', 'fan_in') then o_custkey % 13 + case split when 'train' then 0 when 'val' then 13 else 26 end else -1 end as integer) as ring_id
      from (select *, case when l_orderkey % 61 = 0 and l_linenumber = 1 then 'ring' when l_orderkey % 61 = 1 and l_linenumber = 1 then 'fan_in' when l_orderkey % 61 = 2 then 'organic_camouflage' when l_orderkey % 2 = 0 then 'organic_merchant' else 'organic_oneoff' end as role,
          case when cast(l_shipdate as date) < lo + third then 'train' when cast(l_shipdate as date) < lo + 2 * third then 'val' else 'test' end as split
        from orders join lineitem on o_orderkey = l_orderkey cross join (select min(cast(l_shipdate as date)) as lo, cast((max(cast(l_shipdate as date)) - min(cast(l_shipdate as date)) + 1) // 3 as integer) as third from lineitem)
        where o_custkey <> l_suppkey))""",
    "scored": "select o_orderkey as id, cast(((o_orderkey * 7919) % 1000) / 1000.0 as double) as score, cast(o_orderstatus = 'F' as integer) as y, case when o_orderdate < timestamp '1997-03-12' then 'train' when o_orderdate < timestamp '1999-05-22' then 'val' else 'test' end as split, cast(case when o_orderstatus = 'F' then o_custkey % 40 else -1 end as bigint) as ring_id, case when o_orderstatus <> 'F' then 'organic' when o_custkey % 40 % 3 = 0 then 'fast' when o_custkey % 40 % 3 = 1 then 'stealth' else 'layered' end as ring_type from orders",
}
