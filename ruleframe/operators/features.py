"""Problem 4: one feature row per entity from its observations, by cumulative counts and totals.

The stored form has one row per entity, type and day with observations: the counts and totals so far and the last time
stamp. A window's features are the difference of two as-of endpoints, recency comes from the maximum time stamp, so any
as-of date and any window are answered from the same stored table without the raw rows.

Resent rows (equal but for ``rid``, ``loaded_ts`` and the writing of ``att``) count once. Rows are placed by ``dt`` only, so
late rows count where they belong and future rows lie after the as-of date.

Skew: rows are hashed by (entity, type, day), where a hot entity or type spreads over its days; resends and days are folded
there. (Resends arrive apart from each other, so folding them before that shuffle would cost a hash table and save little.)
Day rows are hashed by (entity, type); only the answers, one per type, are hashed by entity.

Defined cases: an entity without a row before the as-of date has counts 0 and NULL elsewhere; NULL ``eid`` has no row; rows
with NULL ``dt`` or of an uncatalogued name only keep their entity; totals add the numbers read from ``val`` and are NULL if
there are none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..expr import literal, quoted
from ..functions.values import number
from ..session import materialize
from ..sources.tables import attributes, catalogued


def daily(eadv: DataFrame, catalog: DataFrame) -> DataFrame:
    """``eid, att_id, day, n, total, last_dt``: distinct observations per entity, type and day; ``att_id`` -1 if uncatalogued."""
    names = attributes(catalog)
    rows = catalogued(eadv, catalog, ["eid", "att", "dt", "val", "loc"], how="left").where("eid is not null")
    key = ["eid", "att_id", "day"]
    rows = rows.select("eid", F.coalesce("att_id", F.lit(-1)).alias("att_id"), F.to_date("dt").alias("day"), "dt", "val", "loc")
    once = rows.repartition(*key).distinct()
    units = eadv.sparkSession.createDataFrame([(i, a.unit) for i, a in enumerate(names) if a.data_type == "NUMERIC"], "att_id int, unit string")
    once = once.join(F.broadcast(units.withColumn("numeric", F.lit(True))), "att_id", "left")
    value = F.when(F.col("numeric"), number(F.col("val"), F.col("unit")))
    return once.select(*key, "dt", value.alias("num")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("num").alias("total"), F.max("dt").alias("last_dt"))


def cumulative(eadv: DataFrame, catalog: DataFrame) -> DataFrame:
    """What is stored: ``eid, att_id, day, cum_n, cum_total, last_dt``."""
    w = Window.partitionBy("eid", "att_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily(eadv, catalog).select("eid", "att_id", "day", F.sum("n").over(w).alias("cum_n"), F.sum("total").over(w).alias("cum_total"), "last_dt")


def store(eadv: DataFrame, catalog: DataFrame, path: str | None = None) -> DataFrame:
    """The cumulative table as a table: at ``path``, to be answered from later, or below the shared folder."""
    table = cumulative(eadv, catalog)
    if path is None:
        return materialize(table, "cumulative")
    table.write.mode("overwrite").parquet(path)
    return eadv.sparkSession.read.schema(table.schema).parquet(path)


def as_of(table: DataFrame, when: date, windows: tuple[int, ...] = ()) -> DataFrame:
    """Per entity and type: ``n, days_since, total`` before ``when`` and ``n_<w>d, total_<w>d`` of the last w days."""
    point = F.struct("day", "cum_n", "cum_total", "last_dt")
    end = F.lit(when)
    ends = [F.max(F.when(F.col("day") < end, point)).alias("p")]
    ends += [F.max(F.when(F.col("day") < F.date_sub(end, w), point)).alias(f"p{w}") for w in windows]
    out = table.groupBy("eid", "att_id").agg(*ends)
    minus = lambda w, c: F.col(f"p.{c}") - F.coalesce(f"p{w}.{c}", F.lit(0))
    extra = [x for w in windows for x in (minus(w, "cum_n").alias(f"n_{w}d"), minus(w, "cum_total").alias(f"total_{w}d"))]
    return out.select("eid", "att_id", F.col("p.cum_n").alias("n"), F.datediff(end, "p.last_dt").alias("days_since"), F.col("p.cum_total").alias("total"), *extra)


def features(table: DataFrame, catalog: DataFrame, when: date, windows: tuple[int, ...] = ()) -> DataFrame:
    """One row per ``eid`` of a stored table; per catalogued name ``<att>__n``, ``__days_since``, and for numbers ``__total``, and each window's."""
    names = attributes(catalog)
    long = as_of(table, when, windows).repartition("eid")  # at most one row per name: no entity is large any more
    measures = [c for c in long.columns if c not in ("eid", "att_id")]
    ids = list(range(len(names))) or [-1]
    wide = long.groupBy("eid").pivot("att_id", ids).agg(*(F.max(c).alias(c) for c in measures))
    out = []
    for i, a in enumerate(names):
        for c in measures:
            if c.startswith("total") and a.data_type != "NUMERIC":
                continue
            cell, name = f"`{i}_{c}`", f"{a.att}__{c}".replace("`", "``")
            out.append(f"coalesce({cell}, 0L) AS `{name}`" if c.startswith("n") else f"{cell} AS `{name}`")
    return wide.selectExpr("eid", *out)


def features_long(table: DataFrame, catalog: DataFrame, when: date, windows: tuple[int, ...] = ()) -> DataFrame:
    """The same features by entity and name, where there is an observation before ``when``."""
    names = attributes(catalog)
    lookup = table.sparkSession.createDataFrame([(i, a.att) for i, a in enumerate(names)], "att_id int, att string")
    long = as_of(table, when, windows).where("n is not null")
    return long.join(F.broadcast(lookup), "att_id").drop("att_id")


def sums(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per catalogued name of a feature table: ``att`` and the sums of its columns over all entities."""
    names = attributes(catalog)
    column = lambda a, c: quoted(f"{a.att}__{c}")
    total = lambda a: f"round(sum({column(a, 'total')}), 2)" if a.data_type == "NUMERIC" else "CAST(NULL AS double)"
    wide = [x for i, a in enumerate(names) for x in (f"sum({column(a, 'n')}) AS n{i}", f"sum({column(a, 'days_since')}) AS d{i}", f"{total(a)} AS t{i}")]
    out = ", ".join(f"struct({literal(a.att)} AS att, n{i} AS n, d{i} AS days_since, t{i} AS total)" for i, a in enumerate(names))
    return rows.selectExpr(*wide).selectExpr(f"inline(array({out}))")
