"""Problem 2: the N highest-scoring rows of every group, by score histograms.

1. One pass counts the rows of every group by score bin, map-side first; bins never fall as the score rises. Counting down from
   the top, the bin in which the N-th row falls is a threshold that at least N rows reach.
2. Rows below their group's threshold are dropped before any shuffle of rows. The thresholds are broadcast: those of all groups
   of at least ``WORTH`` times N rows, or, where these are more than ``EDGES``, of the groups that hold more than an
   ``EDGES``-th of the rows, of which there cannot be more.
3. Survivors are ranked exactly: score, then the tie keys. Spark limits each task's share of a group to N before the shuffle,
   so ties that all reach the threshold do not pile up either.

A group without a broadcast threshold is ranked as it is: a threshold could drop little of it, or could only be joined by the
very shuffle it should spare. The rows that come out are the same either way.

Defined cases: rows without a score are no rows of the group; NULL group keys form a group; NULL tie keys come last; -0 equals
0 and NaN ranks above all numbers; repeated rows each count; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import plain_number
from ..session import materialize
from ..sources.tables import catalogued

#: Thresholds that are broadcast at most (some 8 MB).
EDGES = 100_000
#: Times N rows that a group needs for its threshold to drop a good part of it.
WORTH = 8
#: Bins per power of two of the score.
BINS = 64


def bin_of(score: Column) -> Column:
    """A whole number that never falls as the score rises: the power of two and ``BINS`` equal parts within it."""
    size = F.abs(score)
    exponent = F.floor(F.log2(size))
    part = F.least(F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * BINS), F.lit(BINS - 1))
    at = F.when(size == 0, F.lit(0)).otherwise((exponent + 1100) * BINS + F.greatest(part, F.lit(0)))
    at = F.when(size == float("inf"), F.lit(1 << 40)).otherwise(at)
    return F.when(F.isnan(score), F.lit(1 << 41)).when(score < 0, -at).otherwise(at).cast("long")


def thresholds(rows: DataFrame, groups: list[str], score: str, n: int) -> DataFrame:
    """``__<group>, __edge``: the bin that at least ``n`` rows of the group reach; at most ``EDGES`` rows."""
    counts = rows.groupBy(*groups, bin_of(F.col(score)).alias("__bin")).agg(F.count(F.lit(1)).alias("__n"))
    of = Window.partitionBy(*groups)
    down = of.orderBy(F.desc("__bin"))
    binned = counts.withColumn("__size", F.sum("__n").over(of)).where(F.col("__size") >= WORTH * n).withColumn("__above", F.sum("__n").over(down) - F.col("__n"))
    edges = binned.where(F.col("__above") < n).groupBy(*groups).agg(F.min("__bin").alias("__edge"), F.max("__size").alias("__size"))
    edges = materialize(edges.select(*(F.col(g).alias(f"__{g}") for g in groups), "__edge", "__size"), "edges")
    found, held = edges.agg(F.count(F.lit(1)), F.sum("__size")).first()
    return (edges if found <= EDGES else edges.where(F.col("__size") * EDGES > held)).drop("__size")


def top(rows: DataFrame, groups: list[str], score: str, n: int, ties: list[Column]) -> DataFrame:
    """The first ``n`` rows of every group by ``score`` descending, then ``ties``; adds ``rank``.

    The test against the threshold is exact: a row is dropped only if its bin lies below the threshold's, which means that its
    score is below those of at least ``n`` rows.
    """
    rows = rows.where(F.col(score).isNotNull())
    edges = thresholds(rows, groups, score, n)
    same = [rows[g].eqNullSafe(edges[f"__{g}"]) for g in groups]
    kept = rows.join(F.broadcast(edges), same, "left").where(F.col("__edge").isNull() | (bin_of(F.col(score)) >= F.col("__edge")))
    order = Window.partitionBy(*groups).orderBy(F.desc(score), *ties)
    return kept.select(*rows.columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_readings(eadv: DataFrame, catalog: DataFrame, n: int = 3) -> DataFrame:
    """Per ``eid`` and canonical name of type NUMERIC: the ``n`` rows of the highest plain number, newer, then lower ``rid`` first."""
    rows = catalogued(eadv, catalog, ["rid", "eid", "att", "dt", "val"], ("NUMERIC",))
    rows = rows.select("rid", "eid", "att_id", "dt", plain_number(F.col("val")).alias("num"))
    ties = [F.desc_nulls_last("dt"), F.asc_nulls_last("rid")]
    return top(rows, ["eid", "att_id"], "num", n, ties)
