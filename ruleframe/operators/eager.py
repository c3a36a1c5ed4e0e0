"""Problem 6: counts and totals per key where a few keys hold most rows, by eager aggregation through joins.

Both inputs are reduced by join key (and by what the result is grouped by) before they meet, map-side first, so no task ever
sees the rows of a hot key: only compact states are shuffled and joined. A joined count is the product of the two counts, a
joined total the sum of one side times the count of the other; roll-ups then add these up.

Defined cases: rows with a NULL join key join nothing (they are kept by ``how="left"`` with the other side counted as one);
NULL group keys form a group; NULL values add nothing to totals; an empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical, plain_number


def state(df: DataFrame, keys: list[str], sums: list[str], prefix: str) -> DataFrame:
    """The compact state of ``df`` by ``keys``: row count and the sums of ``sums``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}n"), *(F.sum(c).alias(f"{prefix}{c}") for c in sums))


def joined_states(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_groups: list[str],
    right_groups: list[str],
    left_sums: list[str],
    right_sums: list[str],
    how: str = "inner",
) -> DataFrame:
    """Counts and totals of ``left JOIN right`` by join key and groups, without forming the join's rows.

    Columns: ``on``, the groups, ``n`` (joined rows), ``l_<sum>`` and ``r_<sum>`` (totals over the joined rows). Names of the
    two sides must differ but for ``on``.
    """
    a = state(left, on + left_groups, left_sums, "__l_")
    b = state(right, on + right_groups, right_sums, "__r_")
    j = a.join(b, on, how)
    count = F.coalesce("__r_n", F.lit(1))
    totals = [(F.col(f"__l_{c}") * count).alias(f"l_{c}") for c in left_sums] + [(F.col(f"__r_{c}") * F.col("__l_n")).alias(f"r_{c}") for c in right_sums]
    return j.select(*on, *left_groups, *right_groups, (F.col("__l_n") * count).alias("n"), *totals)


def roll_up(states: DataFrame, sets: list[list[str]], sums: list[str]) -> DataFrame:
    """Add states up to each grouping set: columns ``field``, ``key_value`` (text), ``n`` and ``sums``; one column per set."""
    keys = [k for s in sets for k in s]
    grouped = states.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys)).agg(
        *(F.grouping(k).alias(f"__g_{k}") for k in keys), F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums)
    )
    field = F.coalesce(*(F.when(F.col(f"__g_{k}") == 0, F.lit(k)) for k in keys))
    value = F.coalesce(*(F.when(F.col(f"__g_{k}") == 0, F.col(k).cast("string")) for k in keys))
    return grouped.select(field.alias("field"), value.alias("key_value"), "n", *sums)


def _readings(eadv: DataFrame) -> DataFrame:
    return eadv.select("eid", canonical(F.col("att")).alias("att"), plain_number(F.col("val")).alias("num"))


def _names(catalog: DataFrame) -> DataFrame:
    return catalog.select(canonical(F.col("att")).alias("att"), "data_type").dropDuplicates(["att"]).withColumn("listed", F.lit(1))


def key_totals(eadv: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows, rows of a catalogued name and the total of plain numbers, for every ``eid`` and every canonical ``att``."""
    s = joined_states(_readings(eadv), _names(catalog), ["att"], ["eid"], [], ["num"], ["listed"], how="left")
    return roll_up(s, [["eid"], ["att"]], ["l_num", "r_listed"]).select("field", "key_value", "n", F.coalesce("r_listed", F.lit(0)).alias("n_listed"), F.round("l_num", 4).alias("total"))


def heavy_keys(eadv: DataFrame, catalog: DataFrame, share: int = 20) -> DataFrame:
    """Keys that hold at least one ``share``-th of all rows, with their counts and totals; NULL is no key."""
    rows = eadv.agg(F.count(F.lit(1))).scalar()
    return key_totals(eadv, catalog).where((F.col("n") * share >= rows) & F.col("key_value").isNotNull())


def pair_totals(left: DataFrame, right: DataFrame, on: str, group: str, value: str) -> DataFrame:
    """Per ``group`` of ``left``: joined rows with ``right`` on ``on`` and the total of ``value`` over them."""
    s = joined_states(left, right, [on], [group], [], [value], [])
    return s.groupBy(group).agg(F.sum("n").alias("n"), F.round(F.sum(f"l_{value}"), 4).alias("total"))

