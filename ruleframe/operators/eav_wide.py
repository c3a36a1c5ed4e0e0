"""Problem 1: attribute-value rows into one typed row per entity, by column-block pivoting.

1. Every row's text is read into its catalogued type. Rows combine per (entity, attribute) to the newest readable value
   (``dt``, then ``rid``; NULL ``dt`` is oldest), map-side first, so a hot entity arrives as at most one row per attribute.
   A row that cannot fill its column becomes a cell of its own, keyed by its ``rid``: it stays apart from its entity's row
   and spreads over all buckets, however many of them a hot entity has.
2. The cells are written once, hashed by (entity, rid of a reject) into n buckets and separated by block of attributes. n
   grows with the input, so that a bucket keeps its size.
3. Each block reads its own files alone and is pivoted inside its buckets; all blocks share one bucketing, so neither the
   pivots nor the joins of the blocks shuffle again (merge joins over buckets, whatever the sizes).
4. The joined blocks are stored; wide rows and rejects are read from that one table.

Defined cases: NULL ``eid`` gives no wide row, its rejects do come out; NULL and blank ``val`` neither fill nor are
rejected; repeated rows count once; an empty table gives an empty wide table with all columns; names not in the catalogue
are left out; further columns of the input are ignored; a name equal to ``eid`` becomes the column ``att_eid``. A row whose
``dt`` is ``as_of`` or later does not fill a cell, as its time has not come, but is rejected like any other; without
``as_of`` the newest time wins, however far in the future.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import literal, quoted
from ..functions.values import encoded, trimmed
from ..session import estimated_bytes, materialize, partitions, spread, workspace
from ..sources.tables import Attribute, attributes, catalogued

#: Attributes per block.
BLOCK = 128
#: Kinds of cells.
VALUE, REJECT, NOBODY = 0, 1, 2


def cells(eadv: DataFrame, catalog: DataFrame, as_of: date | None = None) -> DataFrame:
    """One row per (entity, attribute) with its newest readable value, and one per row that cannot be read.

    Columns: ``eid, kind, reject, att_id, num, txt``; ``reject`` is the ``rid`` of a row of kind ``REJECT``, else 0. Readable rows
    without an entity or not before ``as_of`` are of kind ``NOBODY``.
    """
    columns = ["rid", "eid", "att", "dt", "val"]
    rows = catalogued(spread(eadv.select(*columns)), catalog, columns)
    rows = rows.select("rid", "eid", "att_id", "dt", "val", "data_type", encoded(F.col("val"), F.col("data_type"), F.col("unit")).alias("num"))
    text = F.col("data_type") == "TEXT"
    filled = F.length(trimmed(F.col("val"))) > 0
    owned = F.col("eid").isNotNull() & (F.lit(True) if as_of is None else F.coalesce(F.col("dt") < F.lit(as_of), F.lit(True)))
    # nothing that depends on the value read is filtered here: the filter would be pushed down and read every text twice
    kind = F.when(~text & F.col("num").isNull(), F.lit(REJECT)).when(owned, F.lit(VALUE)).otherwise(F.lit(NOBODY))
    rows = rows.where(filled).withColumn("kind", kind)
    value = F.struct(F.struct("dt", "rid").alias("at"), "num", F.when(text, F.col("val")).alias("txt"))
    best = rows.groupBy("eid", "kind", F.when(F.col("kind") == REJECT, F.col("rid")).otherwise(F.lit(0)).alias("reject"), "att_id").agg(F.max(F.when(F.col("kind") == VALUE, value)).alias("v"))
    return best.select("eid", "kind", "reject", "att_id", "v.num", "v.txt")


def _typed(a: Attribute, column: str) -> str:
    """SQL of a cell in its type. Wide projections are written as SQL: a thousand Column objects take seconds to build."""
    if a.data_type == "BOOLEAN":
        return f"{column} != 0D"
    if a.data_type == "DATE":
        return f"date_add(DATE'1970-01-01', CAST({column} AS int))"
    return column


def _label(a: Attribute) -> str:
    return f"att_{a.att}" if a.att in ("eid", "rejected_rid") else a.att


def reshape(eadv: DataFrame, catalog: DataFrame, block: int = BLOCK, buckets: int | None = None, as_of: date | None = None) -> DataFrame:
    """Wide rows and rejects in one stored table below the shared folder.

    Columns ``eid``, ``rejected_rid`` and one per catalogued attribute. Where ``rejected_rid`` is NULL the row is its entity's
    wide row; otherwise it stands for that input row, which could not fill its column.
    """
    spark = eadv.sparkSession
    names = attributes(catalog)
    n = buckets or partitions(spark, estimated_bytes(eadv))
    fixed = [(i, a) for i, a in enumerate(names) if a.data_type != "TEXT"]
    texts = [(i, a) for i, a in enumerate(names) if a.data_type == "TEXT"]
    blocks = [fixed[k : k + block] for k in range(0, len(fixed), block)] + [texts[k : k + block] for k in range(0, len(texts), block)]
    number_of = {i: b for b, members in enumerate(blocks) for i, _ in members}
    lookup = spark.createDataFrame(list(number_of.items()) or [(-1, 0)], "att_id int, block int")

    key = ["eid", "kind", "reject"]
    name = f"ruleframe_cells_{uuid.uuid4().hex}"
    stored = cells(eadv, catalog, as_of).join(F.broadcast(lookup), "att_id").select(F.coalesce("eid", F.lit(0)).alias("eid"), "kind", F.coalesce("reject", F.lit(0)).alias("reject"), "att_id", "num", "txt", "block")
    stored.repartition(n, *key).write.partitionBy("block").bucketBy(n, *key).sortBy(*key).option("path", workspace(spark, "cells")).saveAsTable(name)

    try:
        return materialize(_joined(spark.table(name), names, blocks, key), "wide")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _joined(cells: DataFrame, names: list[Attribute], blocks: list[list[tuple[int, Attribute]]], key: list[str]) -> DataFrame:
    """The blocks pivoted and joined inside the buckets of ``cells``."""
    table = cells.where(F.col("kind") != NOBODY)
    wide = table.select(*key).distinct()
    columns: dict[int, str] = {}
    for b, members in enumerate(blocks):
        part = table.where(F.col("block") == b)
        if members[0][1].data_type == "TEXT":
            pivoted = part.groupBy(*key).agg(F.max("kind").alias(f"r{b}"), *(F.expr(f"max(CASE WHEN att_id = {i} THEN txt END) AS c{i}") for i, _ in members))
            kept = [f"r{b}", *(f"c{i}" for i, _ in members)]
        else:
            pivoted = part.groupBy(*key).pivot("att_id", [i for i, _ in members]).agg(F.max("num"))
            kept = [f"kind AS r{b}", *(f"`{i}` AS c{i}" for i, _ in members)]
        pivoted = pivoted.selectExpr(*(f"{k} AS {k}_{b}" for k in key), *kept)
        wide = wide.join(pivoted.hint("merge"), [wide[k] == pivoted[f"{k}_{b}"] for k in key], "left")
        columns |= {i: _typed(a, f"c{i}") for i, a in members}
    rejected = f"coalesce({', '.join(f'r{b}' for b in range(len(blocks)))}, {VALUE}) = {REJECT}" if blocks else "false"
    return wide.selectExpr(
        f"CASE WHEN NOT ({rejected}) THEN eid END AS eid", f"CASE WHEN {rejected} THEN reject END AS rejected_rid", *(f"{columns[i]} AS {quoted(_label(names[i]))}" for i in sorted(columns))
    )


def wide(eadv: DataFrame, catalog: DataFrame, **options: int | date | None) -> DataFrame:
    """One row per entity that has any readable value, one typed column per catalogued attribute."""
    return reshape(eadv, catalog, **options).where("rejected_rid is null").drop("rejected_rid")


def rejects(eadv: DataFrame, catalog: DataFrame, **options: int | date | None) -> DataFrame:
    """``rid`` of every row whose non-blank ``val`` cannot fill its typed column."""
    return reshape(eadv, catalog, **options).where("rejected_rid is not null").select(F.col("rejected_rid").alias("rid")).distinct()


def filled(wide_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per catalogued name of a wide table: ``att, cells`` filled and ``total`` over them (of numbers, trues, days since 1970, lengths of texts)."""
    form = {"NUMERIC": "{}", "BOOLEAN": "CAST({} AS int)", "DATE": "unix_date({})", "TEXT": "length({})"}
    names = attributes(catalog)
    sums = [x for i, a in enumerate(names) for x in (f"count({quoted(_label(a))}) AS n{i}", f"CAST(sum({form[a.data_type].format(quoted(_label(a)))}) AS double) AS s{i}")]
    rows = ", ".join(f"struct({literal(a.att)} AS att, n{i} AS cells, round(s{i}, 2) AS total)" for i, a in enumerate(names))
    return wide_rows.selectExpr(*sums).selectExpr(f"inline(array({rows}))")
