"""The feature contract: which columns a feature table has, in which order, and what may be in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and order of the features, of what accompanies them, and the version they define.
MODEL_VERSION = "v4"
FEATURES = (
    "in_degree", "out_degree", "degree_ratio", "degree_balance", "in_amount_sum", "out_amount_sum", "flow_passthrough", "pagerank", "clustering_coefficient",
    "cycle_participation", "reciprocity", "fan_in_concentration", "txn_velocity", "burst_ratio", "amount_cv", "counterparty_amount_cv", "repeat_ratio", "community_internal_ratio",
)
GRAPH_FEATURES = ("pagerank", "clustering_coefficient", "cycle_participation", "reciprocity", "community_internal_ratio")
LOG1P = ("in_degree", "out_degree", "degree_ratio", "in_amount_sum", "out_amount_sum", "txn_velocity", "burst_ratio", "repeat_ratio", "pagerank", "clustering_coefficient", "cycle_participation", "community_internal_ratio")
METADATA = ("node", "louvain_community", "split")
LABELS = ("ring_id", "ring_type", "rings_attributed", "ring_types_attributed")
TARGET = "is_mule"

#: What each feature says, for analysts.
DESCRIPTIONS = {
    "in_degree": "Number of accounts that paid this one", "out_degree": "Number of accounts this one paid", "degree_ratio": "Payees for each payer", "degree_balance": "How alike the numbers of payers and payees are",
    "in_amount_sum": "Money received, for a window of 60 days", "out_amount_sum": "Money sent, for a window of 60 days", "flow_passthrough": "How much of the larger flow the smaller one matches", "pagerank": "Importance in the flow of payments (average: 1)",
    "clustering_coefficient": "How often partners pay each other", "cycle_participation": "Share of regular partners that are on a short loop of payments with it", "reciprocity": "Share of partners that both pay and are paid",
    "fan_in_concentration": "How far received money comes from few payers", "txn_velocity": "Payments an hour while active", "burst_ratio": "Share of payments in the busiest hour", "amount_cv": "Spread of single amounts",
    "counterparty_amount_cv": "Spread of mean amounts over partners", "repeat_ratio": "Payments for each partner, for a window of 60 days", "community_internal_ratio": "Share of its community's links that stay inside",
}

_TYPES = {"node": T.StringType(), "louvain_community": T.LongType(), "split": T.StringType(), "ring_id": T.IntegerType(), "ring_type": T.StringType(), "rings_attributed": T.StringType(), "ring_types_attributed": T.StringType(), TARGET: T.IntegerType()}
#: All 26 columns in their order. Attributions are strings: "1" and "1|2" are one kind.
ORDER = ("node", *FEATURES, *METADATA[1:], *LABELS, TARGET)
SCHEMA = T.StructType([T.StructField(c, _TYPES.get(c, T.DoubleType())) for c in ORDER])


class ContractError(ValueError):
    """A table or a model doesn't have the features that were agreed on."""


def check_names(names: list[str] | tuple[str, ...]) -> None:
    """Raises unless the names are the features, all of them, in their order."""
    if list(names) != list(FEATURES):
        missing, more = [c for c in FEATURES if c not in names], [c for c in names if c not in FEATURES]
        raise ContractError(f"missing {missing}, undeclared {more}" if missing or more else "the features are in another order")


def ordered(df: DataFrame) -> DataFrame:
    """df with exactly the declared columns, in order and of their types; raises if one is missing or more."""
    if set(df.columns) != set(ORDER) or len(df.columns) != len(ORDER):
        raise ContractError(f"missing {sorted(set(ORDER) - set(df.columns))}, undeclared {sorted(set(df.columns) - set(ORDER))}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA])


def features_only(df: DataFrame, *keys: str) -> DataFrame:
    """The features (after the keys) by name, so nothing that knows the label can come along."""
    return df.select(*keys, *FEATURES)


def unusable(df: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row per feature: how many values are null, not a number or infinite; from one aggregate."""
    bad = {c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in names}
    row = df.agg(*[v.alias(c) for c, v in bad.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in names])))


def checked(df: DataFrame) -> DataFrame:
    """df, if all its features are numbers; one small aggregate runs."""
    wrong = [c for c in FEATURES if c not in df.columns or not isinstance(df.schema[c].dataType, T.NumericType)]
    if wrong:
        raise ContractError(f"missing or not numeric: {wrong}")
    bad = [(r["feature"], r["n"]) for r in unusable(df).where("n > 0").collect()]
    if bad:
        raise ContractError(f"values that are no numbers: {bad}")
    return df
