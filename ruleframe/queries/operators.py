"""Queries of the core operators over whole tables, with production parameters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical, plain_number
from ..operators import eager, eav_wide, features, spikes
from ..sources.tables import table

#: The as-of date of the registered feature queries.
AS_OF = date(2024, 1, 1)


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "eadv"), table(spark, folder, "att_catalog")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return eav_wide.rejects(*_tables(spark, folder))


def p1_wide(spark: SparkSession, folder: str) -> DataFrame:
    return eav_wide.wide(*_tables(spark, folder), as_of=AS_OF)


def p1_filled(spark: SparkSession, folder: str) -> DataFrame:
    """What fills the columns of the wide table, by name."""
    eadv, catalog = _tables(spark, folder)
    return eav_wide.filled(eav_wide.wide(eadv, catalog, as_of=AS_OF), catalog)


def p4_features(spark: SparkSession, folder: str) -> DataFrame:
    eadv, catalog = _tables(spark, folder)
    return features.features(features.store(eadv, catalog), catalog, AS_OF)


def p4_sums(spark: SparkSession, folder: str) -> DataFrame:
    """What fills the columns of the feature table, by name."""
    return features.sums(p4_features(spark, folder), table(spark, folder, "att_catalog"))


def p4_window_features(spark: SparkSession, folder: str) -> DataFrame:
    eadv, catalog = _tables(spark, folder)
    long = features.features_long(features.store(eadv, catalog), catalog, AS_OF, (30, 365))
    return long.withColumns({c: F.round(c, 4) for c in long.columns if c.startswith("total")})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.judged(*_tables(spark, folder)).select("rid").distinct()


def p5_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.judged(*_tables(spark, folder)).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return eager.heavy_keys(*_tables(spark, folder)).select("field", "key_value")


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    return eager.key_totals(*_tables(spark, folder))


def p6_note_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Per name: pairs of an observation and a note of the same entity, and the total over them of the observation's number."""
    eadv, catalog = _tables(spark, folder)
    rows = eadv.select("eid", canonical(F.col("att")).alias("att"), plain_number(F.col("val")).alias("num"))
    notes = eadv.select("eid", canonical(F.col("att")).alias("note")).join(catalog.where("data_type = 'TEXT'").select(F.col("att").alias("note")), "note", "left_semi").select("eid")
    return eager.pair_totals(rows, notes, "eid", "att", "num")


QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p1_filled, p4_features, p4_sums, p4_window_features, p5_found, p5_kinds, p6_found, p6_totals, p6_note_pairs)}

_NAMES = "SELECT eid, lower(trim(att)) AS att, CASE WHEN regexp_full_match(trim(val), '-?[0-9]+([.][0-9]+)?') THEN CAST(trim(val) AS DOUBLE) END AS num FROM eadv"

SQL = {
    "p6_found": """
        WITH k AS (SELECT 'eid' AS field, CAST(eid AS VARCHAR) AS key_value, count(*) AS n FROM eadv GROUP BY eid
                   UNION ALL SELECT 'att', lower(trim(att)), count(*) FROM eadv GROUP BY 2)
        SELECT field, key_value FROM k WHERE key_value IS NOT NULL AND n * 20 >= (SELECT count(*) FROM eadv)""",
    "p6_totals": f"""
        WITH r AS (SELECT r.*, CASE WHEN c.att IS NOT NULL THEN 1 ELSE 0 END AS listed FROM ({_NAMES}) r LEFT JOIN att_catalog c USING (att))
        SELECT 'eid' AS field, CAST(eid AS VARCHAR) AS key_value, count(*) AS n, sum(listed)::BIGINT AS n_listed, round(sum(num), 4) AS total FROM r GROUP BY eid
        UNION ALL SELECT 'att', att, count(*), sum(listed)::BIGINT, round(sum(num), 4) FROM r GROUP BY att""",
    "p6_note_pairs": f"""
        WITH r AS ({_NAMES}), notes AS (SELECT r.eid FROM r JOIN att_catalog c USING (att) WHERE c.data_type = 'TEXT')
        SELECT r.att, count(*) AS n, round(sum(r.num), 4) AS total FROM r JOIN notes USING (eid) GROUP BY r.att""",
}

_ONCE = """once AS (SELECT DISTINCT e.eid, c.att, c.data_type, c.unit, e.dt, e.val, e.loc FROM eadv e JOIN att_catalog c ON c.att = lower(trim(e.att))
                   WHERE e.eid IS NOT NULL AND e.dt < TIMESTAMP '2024-01-01')"""
#: The number a text states, in the forms that occur: steps of one replacement each.
_NUMBER = r"""
bare AS (SELECT *, regexp_replace(translate(trim(val, E' \t\n  '), '０１２３４５６７８９', '0123456789'), '^= *|^x +', '') AS a FROM once),
unmarked AS (SELECT * REPLACE (trim(regexp_replace(a, '([0-9 ]) *(\((H|L)\)|H|L|\*|!|x)$', '\1')) AS a) FROM bare),
unitless AS (SELECT * REPLACE (CASE WHEN unit IS NOT NULL AND ends_with(a, unit) THEN trim(left(a, length(a) - length(unit))) ELSE a END AS a) FROM unmarked),
numbers AS (SELECT eid, att, dt, CASE WHEN data_type <> 'NUMERIC' THEN NULL
    WHEN regexp_full_match(a, '[1-9][0-9]{0,2}([,.\x{202f}\x{a0} ][0-9]{3})[,.][0-9]+') THEN
        try_cast(replace(regexp_replace(a, '^([1-9][0-9]{0,2})[,.\x{202f}\x{a0} ]', '\1'), ',', '.') AS DOUBLE)
    WHEN regexp_full_match(a, '[-+]?[0-9]+([.,][0-9]+)?([eE][-+]?[0-9]+)?') THEN try_cast(replace(a, ',', '.') AS DOUBLE) END AS num FROM unitless)"""

SQL |= {
    "p4_window_features": f"""
        WITH {_ONCE}, {_NUMBER}
        SELECT eid, att, count(*) AS n, CAST(date_diff('day', max(dt), TIMESTAMP '2024-01-01') AS INTEGER) AS days_since, round(sum(num), 4) AS total,
               count(*) FILTER (WHERE dt >= TIMESTAMP '2023-12-02') AS n_30d,
               CASE WHEN count(num) > 0 THEN round(coalesce(sum(num) FILTER (WHERE dt >= TIMESTAMP '2023-12-02'), 0), 4) END AS total_30d,
               count(*) FILTER (WHERE dt >= TIMESTAMP '2023-01-01') AS n_365d,
               CASE WHEN count(num) > 0 THEN round(coalesce(sum(num) FILTER (WHERE dt >= TIMESTAMP '2023-01-01'), 0), 4) END AS total_365d
        FROM numbers GROUP BY eid, att""",
}

SQL["p1_found"] = (
    f"""
        WITH once AS (SELECT e.rid, e.eid, c.att, c.data_type, c.unit, e.dt, e.val, e.loc FROM eadv e JOIN att_catalog c ON c.att = lower(trim(e.att))
                      WHERE c.data_type <> 'TEXT' AND length(trim(e.val, E' \\t\\n')) > 0), {_NUMBER.replace("numbers AS (SELECT eid,", "numbers AS (SELECT rid, data_type, val, eid,")},"""
    + r"""
        words AS (SELECT *, lower(trim(val)) AS w FROM numbers)
        SELECT rid FROM words WHERE CASE data_type WHEN 'NUMERIC' THEN num IS NULL OR isnan(num) OR isinf(num)
            WHEN 'BOOLEAN' THEN w NOT IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', '1', '0')
            ELSE coalesce(try_strptime(w, ['%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y', '%d.%m.%Y', '%d %b %Y', '%d-%b-%Y', '%b %d, %Y', '%Y-%m-%dt%H:%M:%S']),
                          CASE WHEN regexp_full_match(w, '[0-9]{8}') THEN try_strptime(w, '%Y%m%d') END) IS NULL END"""
)

SQL["p1_filled"] = (
    f"""
        WITH once AS (SELECT e.rid, e.eid, c.att, c.data_type, c.unit, e.dt, e.val, e.loc FROM eadv e JOIN att_catalog c ON c.att = lower(trim(e.att))
                      WHERE e.eid IS NOT NULL AND (e.dt IS NULL OR e.dt < TIMESTAMP '2024-01-01') AND length(trim(e.val, E' \\t\\n')) > 0),
        {_NUMBER.replace("numbers AS (SELECT eid,", "numbers AS (SELECT rid, data_type, val, eid,")},"""
    + r"""
        words AS (SELECT *, lower(trim(val)) AS w FROM numbers),
        read AS (SELECT eid, att, dt, rid, CASE data_type WHEN 'NUMERIC' THEN CASE WHEN NOT isnan(num) AND NOT isinf(num) THEN num END WHEN 'TEXT' THEN length(val)
            WHEN 'BOOLEAN' THEN CASE WHEN w IN ('true', 't', 'yes', 'y', '1') THEN 1 WHEN w IN ('false', 'f', 'no', 'n', '0') THEN 0 END
            ELSE date_diff('day', TIMESTAMP '1970-01-01', coalesce(try_strptime(w, ['%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y', '%d.%m.%Y', '%d %b %Y', '%d-%b-%Y', '%b %d, %Y', '%Y-%m-%dt%H:%M:%S']),
                          CASE WHEN regexp_full_match(w, '[0-9]{8}') THEN try_strptime(w, '%Y%m%d') END)) END::DOUBLE AS x FROM words),
        newest AS (SELECT * FROM read WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY eid, att ORDER BY dt DESC NULLS LAST, rid DESC) = 1)
        SELECT c.att, count(n.x) AS cells, round(sum(n.x), 2) AS total FROM att_catalog c LEFT JOIN newest n ON n.att = c.att GROUP BY c.att"""
)

SQL["p4_sums"] = f"""
        WITH {_ONCE}, {_NUMBER},
        f AS (SELECT eid, att, count(*) AS n, date_diff('day', max(dt), TIMESTAMP '2024-01-01') AS days_since, sum(num) AS total FROM numbers GROUP BY eid, att)
        SELECT c.att, coalesce(sum(f.n), 0)::BIGINT AS n, sum(f.days_since)::BIGINT AS days_since, CASE WHEN c.data_type = 'NUMERIC' THEN round(sum(f.total), 2) END AS total
        FROM att_catalog c LEFT JOIN f ON f.att = c.att GROUP BY c.att, c.data_type"""
