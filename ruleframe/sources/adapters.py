"""Other tables as observations: ``eid, att, dt, val``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical
from .tables import table


def eadv(spark: SparkSession, folder: str) -> DataFrame:
    """The delivered observations, names in canonical form."""
    return table(spark, folder, "eadv").select("eid", canonical(F.col("att")).alias("att"), "dt", "val", "loc")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("eid"), F.col("event_type").alias("att"), F.col("ts").alias("dt"), F.col("value").alias("val"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("eid"), F.concat(F.lit("ord_"), "o_orderstatus").alias("att"), F.col("o_orderdate").alias("dt"), F.col("o_totalprice").alias("val")
    )


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("eid"), F.concat(F.lit("li_"), "l_returnflag").alias("att"), F.col("l_shipdate").alias("dt"), F.col("l_quantity").alias("val")
    )
