"""Tables of a data folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical

#: The catalogue becomes the columns of wide tables, so it has to fit a schema; beyond this it is refused, not cut.
MAX_ATTRIBUTES = 20_000


@dataclass(frozen=True)
class Attribute:
    att: str
    data_type: str
    unit: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def attributes(catalog: DataFrame) -> list[Attribute]:
    """The catalogue on the driver, by name; names that are NULL or repeat one seen before (canonically) are left out."""
    rows = catalog.select(canonical(F.col("att")).alias("att"), "data_type", "unit").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"the catalogue has more than {MAX_ATTRIBUTES} names")
    by_name = {r.att: Attribute(r.att, r.data_type, r.unit) for r in sorted(rows, key=lambda r: (r.att or "", r.data_type or "", r.unit or ""), reverse=True) if r.att is not None}
    return [by_name[a] for a in sorted(by_name)]


def catalogued(eadv: DataFrame, catalog: DataFrame, columns: list[str], types: tuple[str, ...] | None = None, extra: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """``columns`` of ``eadv`` with the canonical ``att`` and the catalogue's ``data_type``, ``unit`` and ``extra``.

    Rows whose name is NULL or not in the catalogue are left out (``how="left"`` keeps them). Only the named columns are read, so others cannot clash.
    The catalogue is broadcast because ``attributes`` bounds its size.
    """
    names = attributes(catalog)
    spark = eadv.sparkSession
    kept = [a for a in names if types is None or a.data_type in types]
    lookup = spark.createDataFrame([(a.att, a.data_type, a.unit, i) for i, a in enumerate(names) if a in set(kept)], "__att string, data_type string, unit string, att_id int")
    if extra:  # of as many rows as the list above at most
        first = catalog.groupBy(canonical(F.col("att")).alias("__att")).agg(*(F.min(c).alias(c) for c in extra))
        lookup = lookup.join(F.broadcast(first), "__att", "left")
    rows = eadv.select(*(c for c in columns if c != "att"), canonical(F.col("att")).alias("att"))
    return rows.join(F.broadcast(lookup), rows.att == lookup["__att"], how).drop("__att")
