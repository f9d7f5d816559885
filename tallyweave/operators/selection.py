"""Exact quantiles by radix selection: no group's values are held together.

Doubles are taken as 64-bit numbers of the same order. Each of four rounds counts, of the rows whose leading digits
are those of a wanted rank, the next 16 bits, and keeps the digit that the rank falls on. So a group and rank has at
most 65,536 counts at a time, whatever its size and ties, and rows are only counted, where they are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tallyweave.work import cut

DIGIT, MASK = 16, (1 << 16) - 1


@F.pandas_udf(LongType())
def _ordered(x: pd.Series) -> pd.Series:
    """A 64-bit number for each double, in the same order as signed numbers."""
    raw = (x.to_numpy(float) + 0.0).view(np.int64)
    return pd.Series(np.where(raw < 0, raw ^ np.int64(2**63 - 1), raw))


@F.pandas_udf(DoubleType())
def _double(v: pd.Series) -> pd.Series:
    raw = v.to_numpy(np.int64)
    return pd.Series(np.where(raw < 0, raw ^ np.int64(2**63 - 1), raw).view(float))


def ranked(df: DataFrame, keys: list[str], value: str | Column, ranks: Column) -> DataFrame:
    """keys, n, rank, value: of each group the values at `ranks` (an array of places from 0, of n, the group's
    rows with a value)."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = cut(df.select(*keys, v.alias("_x")).where("_x is not null").select(*keys, _ordered("_x").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    sizes = rows.groupBy(*keys).agg(F.sum("_c").alias("n"))
    wanted = sizes.select(*keys, "n", F.explode(F.array_distinct(ranks)).alias("rank")).withColumns({"_pre": F.lit(0).cast("long"), "_below": F.lit(0).cast("long")})
    on = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    for r in range(64 // DIGIT):
        shift = 64 - DIGIT * (r + 1)
        # The first digit is signed: smaller numbers first.
        digit = F.shiftright("_v", shift) if r == 0 else F.shiftright("_v", shift).bitwiseAND(F.lit(MASK).cast("long"))
        pre = F.lit(0).cast("long") if r == 0 else F.shiftright("_v", shift + DIGIT)
        w = cut(wanted)
        asked = w.select(*keys, "_pre").distinct()
        counted = rows.select(*keys, "_c", pre.alias("_p"), digit.alias("_d")).alias("r")
        near = counted.join(asked.alias("a"), [F.col("r._p") == F.col("a._pre"), *[F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]], "left_semi")
        counts = near.groupBy(*keys, "_p", "_d").agg(F.sum("_c").alias("_n"))
        each = counts.alias("c").join(w.alias("w"), [F.col("c._p") == F.col("w._pre"), *[F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]]).select(*[F.col(f"w.{k}") for k in keys], "n", "rank", "_pre", "_below", "_d", "_n")
        upto = Window.partitionBy(*keys, "rank").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 65,536 digits at most
        placed = each.withColumn("_upto", F.col("_below") + F.sum("_n").over(upto)).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_n") <= F.col("rank")))
        wanted = placed.select(*keys, "n", "rank", (F.col("_d") if r == 0 else F.shiftleft("_pre", DIGIT).bitwiseOR(F.col("_d"))).alias("_pre"), (F.col("_upto") - F.col("_n")).alias("_below"))
    return wanted.select(*keys, "n", "rank", _double("_pre").alias("value"))


def quantiles(df: DataFrame, keys: list[str], value: str | Column, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each of `shares`: the quantile with linear interpolation between neighbours."""
    at = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    ranks = F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)])
    found = ranked(df, keys, value, ranks)
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", "value")))
    g = found.groupBy(*keys, "n").agg(by_rank.alias("_at"))  # two ranks for each share
    low, high = (lambda x: F.col("_at")[F.floor(x).cast("long")]), (lambda x: F.col("_at")[F.ceil(x).cast("long")])
    return g.select(*keys, *[(low(x) + (high(x) - low(x)) * (x - F.floor(x))).alias(name) for name, x in at.items()])
