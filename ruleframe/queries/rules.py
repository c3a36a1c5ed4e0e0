"""Queries of the rules language over whole tables, one per operator, and hand-written SQL that checks each.

A query is a program over a source that is presented as observations; its result is the last block of the program. Floating
point results are rounded on both sides, as engines add in different orders.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine, read_blocks
from ..graph import find_cycle
from ..manifest import generate_manifest, write_manifest
from ..model import Options, RuleblockInput
from ..session import workspace
from ..sources import adapters
from ..sources.tables import table

#: The day that stands for today in all queries.
TODAY = "2024-02-01"
DIGITS = 8

#: Sources as observations, for the SQL side.
_SOURCE = {
    "events": "SELECT user_id AS eid, event_type AS att, ts AS dt, value AS val FROM events",
    "orders": "SELECT o_custkey AS eid, 'ord_' || o_orderstatus AS att, o_orderdate AS dt, o_totalprice AS val FROM orders",
    "lineitem": "SELECT l_suppkey AS eid, 'li_' || l_returnflag AS att, l_shipdate AS dt, l_quantity AS val FROM lineitem",
    "eadv": "SELECT eid, lower(trim(att)) AS att, dt, val, loc FROM eadv WHERE eid IS NOT NULL",
}


#: The same with the number that a text states.
_NUMBERS = {source: "SELECT *, try_cast(trim(val) AS DOUBLE) AS n FROM o" if source == "eadv" else "SELECT *, val AS n FROM o" for source in _SOURCE}


@dataclass(frozen=True)
class Query:
    source: str
    programs: tuple[tuple[str, str], ...]
    sql: str
    options: Options = Options(static_sysdate=TODAY)

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        tables = {"eadv": getattr(adapters, self.source)(spark, folder)}
        blocks = [RuleblockInput(n, t) for n, t in self.programs]
        result = Engine(spark, tables).compile(blocks, self.options)
        if not result.success:
            raise ValueError("; ".join(m.message for m in result.errors))
        return rounded(list(result.dataframes.values())[-1])


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f"`{f.name}`", DIGITS).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields))


def _one(source: str, program: str, sql: str) -> Query:
    """A program of one block; ``sql`` gives ``eid`` and the columns for entities that have any, others get NULL."""
    return Query(source, (("main", program),), f"WITH o AS ({_SOURCE[source]}), u AS (SELECT DISTINCT eid FROM o), x AS ({_NUMBERS[source]}) SELECT * FROM u LEFT JOIN ({sql}) v USING (eid)")


def _ranked(columns: str, order: str, where: str, n: int = 1) -> str:
    return f"SELECT eid, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY {order}) AS rn FROM o WHERE {where}) WHERE rn = {n}"


def _grouped(columns: str, where: str) -> str:
    return f"SELECT eid, {columns} FROM o WHERE {where} GROUP BY eid"


_NEW = "dt DESC NULLS LAST, att, val NULLS LAST"
_OLD = "dt NULLS LAST, att, val NULLS LAST"
_R = "att = 'li_R'"
_CLICK = "att = 'click'"
_POTASSIUM = "att = 'lab_bld_potassium'"
_DAYS = "date_diff('day', first, dt)"
_FIT = f"(SELECT *, min(dt) OVER (PARTITION BY eid) AS first FROM o WHERE {_CLICK})"

RULES: dict[str, Query] = {
    # fetch functions
    "fetch_last": _one("lineitem", "v => eadv.li_R.val.last();", _ranked("val AS v", _NEW, _R)),
    "fetch_first": _one("lineitem", "v => eadv.li_R.val.first();", _ranked("val AS v", _OLD, _R)),
    "fetch_nth": _one("lineitem", "v => eadv.li_R.val.nth(3);", _ranked("val AS v", _NEW, _R, 3)),
    "fetch_count": _one("orders", "v => eadv.ord_P.val.count();", _grouped("count(val) AS v", "att = 'ord_P'")),
    "fetch_sum": _one("lineitem", "v => eadv.li_R.val.sum();", _grouped("round(sum(val), 8) AS v", _R)),
    "fetch_avg": _one("lineitem", "v => eadv.li_R.val.avg();", _grouped("round(avg(val), 8) AS v", _R)),
    "fetch_min": _one("lineitem", "v => eadv.li_R.val.min();", _grouped("min(val) AS v", _R)),
    "fetch_max": _one("lineitem", "v => eadv.li_R.val.max();", _grouped("max(val) AS v", _R)),
    "fetch_min_dt": _one("lineitem", "v => eadv.li_R.dt.min(); w => eadv.li_A.dt.max();",
        "SELECT eid, min(dt) FILTER (WHERE att = 'li_R') AS v, max(dt) FILTER (WHERE att = 'li_A') AS w FROM o GROUP BY eid"),
    "fetch_median": _one("orders", "v => eadv.ord_F.val.median();", _grouped("round(median(val), 8) AS v", "att = 'ord_F'")),
    "fetch_distinct_count": _one("lineitem", "v => eadv.li_R.val.distinct_count();", _grouped("count(DISTINCT val) AS v", _R)),
    "fetch_lastdv": _one("lineitem", "v => eadv.li_R.val.lastdv();", _ranked("val AS v_val, dt AS v_dt", _NEW, _R)),
    "fetch_firstdv": _one("lineitem", "v => eadv.li_R.val.firstdv();", _ranked("val AS v_val, dt AS v_dt", _OLD, _R)),
    "fetch_maxldv": _one("lineitem", "v => eadv.li_R.val.maxldv();", _ranked("val AS v_val, dt AS v_dt", "val DESC NULLS LAST, dt DESC, att", _R)),
    "fetch_minldv": _one("lineitem", "v => eadv.li_R.val.minldv();", _ranked("val AS v_val, dt AS v_dt", "val NULLS LAST, dt DESC, att", _R)),
    "fetch_minfdv": _one("lineitem", "v => eadv.li_R.val.minfdv();", _ranked("val AS v_val, dt AS v_dt", "val NULLS LAST, dt, att", _R)),
    "fetch_serialize": _one("lineitem", "v => eadv.li_R.val.serialize(|);", _grouped(f"string_agg(val::VARCHAR, '|' ORDER BY {_OLD}) AS v", _R)),
    "fetch_serialize2": _one("lineitem", 'v => eadv.li_R.val.serialize2("; ");', _grouped(f"string_agg(val::VARCHAR, '; ' ORDER BY {_OLD}) AS v", _R)),
    "fetch_serializedv": _one("lineitem", "v => eadv.li_R.val.serializedv();", _grouped(f"string_agg(val::VARCHAR || '~' || strftime(dt, '%Y-%m-%d'), ',' ORDER BY {_OLD}) AS v", _R)),
    "fetch_serializedv2": _one("events", "v => eadv.click.val.serializedv2(floor(val)~dt~att);",
        _grouped(f"string_agg(floor(val)::BIGINT::VARCHAR || '~' || strftime(dt, '%Y-%m-%d') || '~' || att, ',' ORDER BY {_OLD}) AS v", _CLICK)),
    "fetch_regr_slope": _one("events", "v => eadv.click.val.regr_slope();",
        f"SELECT eid, CASE WHEN NOT isnan(s) THEN round(s, 8) END AS v FROM (SELECT eid, regr_slope(val, {_DAYS}) AS s FROM {_FIT} GROUP BY eid)"),
    "fetch_regr_intercept": _one("events", "v => eadv.click.val.regr_intercept();",
        f"SELECT eid, CASE WHEN NOT isnan(s) THEN round(s, 8) END AS v FROM (SELECT eid, regr_intercept(val, {_DAYS}) AS s FROM {_FIT} GROUP BY eid)"),
    "fetch_regr_r2": _one("events", "v => eadv.click.val.regr_r2();",
        f"SELECT eid, CASE WHEN NOT isnan(s) THEN round(s, 8) END AS v FROM (SELECT eid, regr_r2(val, {_DAYS}) AS s FROM {_FIT} GROUP BY eid)"),
    "fetch_exists": _one("orders", "v => eadv.ord_P.val.exists();", _grouped("1 AS v", "att = 'ord_P'")),
    "fetch_stats_mode": _one("lineitem", "v => eadv.li_R.val.stats_mode();",
        f"SELECT eid, val AS v FROM (SELECT eid, val, row_number() OVER (PARTITION BY eid ORDER BY count(*) DESC, val) AS rn FROM o WHERE {_R} AND val IS NOT NULL GROUP BY eid, val) WHERE rn = 1"),
    "fetch_max_neg_delta_dv": _one("lineitem", "v => eadv.li_R.val.max_neg_delta_dv();",
        f"""SELECT eid, d AS v_val, dt AS v_dt FROM (SELECT eid, d, dt, row_number() OVER (PARTITION BY eid ORDER BY d, dt DESC) AS rn FROM (
            SELECT eid, dt, val - lag(val) OVER (PARTITION BY eid ORDER BY {_OLD}) AS d FROM o WHERE {_R}) WHERE d < 0) WHERE rn = 1"""),
    "fetch_temporal_regularity": _one("orders", "v => eadv.ord_F.val.temporal_regularity();",
        f"""SELECT eid, CASE WHEN count(g) <= 1 THEN NULL WHEN avg(g) = 0 THEN 0 ELSE round(stddev_samp(g) / avg(g), 8) END AS v FROM (
            SELECT eid, date_diff('day', lag(dt) OVER (PARTITION BY eid ORDER BY {_OLD}), dt) AS g FROM o WHERE att = 'ord_F') GROUP BY eid"""),
    # attributes, properties, predicates
    "attr_multi": _one("lineitem", "v => eadv.[li_R, li_A].val.sum();", _grouped("round(sum(val), 8) AS v", "att IN ('li_R', 'li_A')")),
    "attr_wildcard": _one("eadv", "v => eadv.lab_bld%.val.count(); w => eadv.[obs_pulse, dx%c0_].att.count(); x => eadv.%flow%.dt.count();",
        r"""SELECT eid, CASE WHEN bool_or(a) THEN count(val) FILTER (WHERE a) END AS v, CASE WHEN bool_or(b) THEN count(att) FILTER (WHERE b) END AS w, CASE WHEN bool_or(c) THEN count(dt) FILTER (WHERE c) END AS x
            FROM (SELECT *, att LIKE 'lab\_bld%' ESCAPE '\' AS a, att = 'obs_pulse' OR att LIKE 'dx%c0\_' ESCAPE '\' AS b, att LIKE '%flow%' AS c FROM o) GROUP BY eid"""),
    "property_underscore": _one("events", "v => eadv.click._.max();", _grouped("max(val) AS v", _CLICK)),
    "property_att": _one("events", "v => eadv.%.att.stats_mode(); n => eadv.%.att.distinct_count();",
        """SELECT eid, v, n FROM (SELECT eid, att AS v, row_number() OVER (PARTITION BY eid ORDER BY count(*) DESC, att) AS rn FROM o GROUP BY eid, att) a
           JOIN (SELECT eid, count(DISTINCT att) AS n FROM o GROUP BY eid) b USING (eid) WHERE rn = 1"""),
    "where_predicate": _one("orders", "v => eadv.[ord_F, ord_O].val.sum()\n  .where(val > 1000 and (dt >= date '1995-01-01' or not val between 2000 and 100000));",
        _grouped("round(sum(val), 8) AS v", "att IN ('ord_F', 'ord_O') AND val > 1000 AND (dt >= DATE '1995-01-01' OR NOT val BETWEEN 2000 AND 100000)")),
    "where_or": _one("orders", "v => eadv.ord_F.val.count().where(val < 1000 or val > 300000);",
        _grouped("count(val) AS v", "att = 'ord_F' AND (val < 1000 OR val > 300000)")),
    "where_sysdate": _one("events", "v => eadv.click.val.count().where(dt > sysdate - 10); w => eadv.click.dt.max().where(dt <= sysdate - 20);",
        """SELECT eid, CASE WHEN count(*) FILTER (WHERE dt > DATE '2024-01-22') > 0 THEN count(val) FILTER (WHERE dt > DATE '2024-01-22') END AS v,
                  max(dt) FILTER (WHERE dt <= DATE '2024-01-12') AS w FROM o WHERE att = 'click' GROUP BY eid"""),
    "where_dependent": Query("events", (("main", "a => eadv.click.val.avg(); n => eadv.click.val.count().where(val > a); l => eadv.click.val.last().where(val > a * 2); s => eadv.view.val.sum().where(val < a);"),),
        f"""WITH o AS ({_SOURCE['events']}), u AS (SELECT DISTINCT eid FROM o), m AS (SELECT eid, avg(val) AS a FROM o WHERE att = 'click' GROUP BY eid),
            j AS (SELECT o.*, m.a FROM o LEFT JOIN m USING (eid))
            SELECT u.eid, round(m.a, 8) AS a, coalesce(n.n, 0) AS n, l.l, round(s.s, 8) AS s FROM u LEFT JOIN m USING (eid)
            LEFT JOIN (SELECT eid, count(val) AS n FROM j WHERE att = 'click' AND val > a GROUP BY eid) n USING (eid)
            LEFT JOIN (SELECT eid, val AS l FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY {_NEW}) AS rn FROM j WHERE att = 'click' AND val > a * 2) WHERE rn = 1) l USING (eid)
            LEFT JOIN (SELECT eid, sum(val) AS s FROM j WHERE att = 'view' AND val < a GROUP BY eid) s USING (eid)"""),
    "where_dependent_all": Query("lineitem", (("main", """m => eadv.li_R.val.median(); d => eadv.li_R.val.firstdv();
            x => eadv.li_A.val.maxldv().where(val < m); t => eadv.li_A.val.nth(2).where(dt > d_dt + 30); e => eadv.li_N.val.exists().where(val > m and dt > d_dt);"""),),
        f"""WITH o AS ({_SOURCE['lineitem']}), u AS (SELECT DISTINCT eid FROM o), m AS (SELECT eid, median(val) AS m FROM o WHERE {_R} GROUP BY eid),
            d AS ({_ranked('val AS d_val, dt AS d_dt', _OLD, _R)}), j AS (SELECT o.*, m, d_dt FROM o LEFT JOIN m USING (eid) LEFT JOIN d USING (eid))
            SELECT u.eid, round(m.m, 8) AS m, d_val, d.d_dt, x_val, x_dt, t, e FROM u LEFT JOIN m USING (eid) LEFT JOIN d USING (eid)
            LEFT JOIN (SELECT eid, val AS x_val, dt AS x_dt FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY val DESC, dt DESC, att) AS rn FROM j WHERE att = 'li_A' AND val < m) WHERE rn = 1) x USING (eid)
            LEFT JOIN (SELECT eid, val AS t FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY {_NEW}) AS rn FROM j WHERE att = 'li_A' AND dt > CAST(d_dt AS DATE) + 30) WHERE rn = 2) t USING (eid)
            LEFT JOIN (SELECT eid, 1 AS e FROM j WHERE att = 'li_N' AND val > m AND dt > d_dt GROUP BY eid) e USING (eid)"""),
    "absent_entity_null": _one("orders", "c => eadv.ord_P.val.count(); e => eadv.ord_P.val.exists(); d => eadv.ord_P.val.distinct_count(); s => eadv.nothing.val.sum();",
        "SELECT eid, count(val) AS c, 1 AS e, count(DISTINCT val) AS d, NULL::DOUBLE AS s FROM o WHERE att = 'ord_P' GROUP BY eid"),
    "text_values": _one("eadv", "s => eadv.lab_bld_creat.val.sum(); l => eadv.note_nurse.val.lastdv(); n => eadv.lab_bld_creat.val.count().where(val > 80); m => eadv.lab_bld_potassium.val.max().where(loc? or loc > 200);",
        f"""SELECT eid, s, l_val, l_dt, n, m FROM (SELECT DISTINCT eid FROM o)
            LEFT JOIN (SELECT eid, round(sum(x), 8) AS s, CASE WHEN count(*) FILTER (WHERE x > 80) > 0 THEN count(val) FILTER (WHERE x > 80) END AS n
                       FROM (SELECT *, try_cast(trim(val) AS DOUBLE) AS x FROM o WHERE att = 'lab_bld_creat') WHERE x IS NULL OR NOT isnan(x) OR TRUE GROUP BY eid) USING (eid)
            LEFT JOIN ({_ranked('val AS l_val, dt AS l_dt', _NEW, "att = 'note_nurse'")}) USING (eid)
            LEFT JOIN (SELECT eid, max(try_cast(trim(val) AS DOUBLE)) AS m FROM o WHERE att = 'lab_bld_potassium' AND (loc IS NULL OR loc > 200) GROUP BY eid) USING (eid)"""),
    # computes
    "compute_case": _one("events", "c => eadv.click.val.last(); n => eadv.click.dt.count(); band : {c? => 0}, {c < 20 => 2}, {c >= 20 and n > 10 => 3}, {=> 1}; label : {band = 2 => `low`}, {band > 2 => 'high; //'};",
        f"""SELECT *, CASE WHEN band = 2 THEN 'low' WHEN band > 2 THEN 'high; //' END AS label FROM (
            SELECT eid, c, n, CASE WHEN c IS NULL THEN 0 WHEN c < 20 THEN 2 WHEN c >= 20 AND n > 10 THEN 3 ELSE 1 END AS band FROM
            ({_ranked('val AS c', _NEW, _CLICK)}) JOIN ({_grouped('count(dt) AS n', _CLICK)}) USING (eid))"""),
    "compute_null_ops": Query("orders", (("main", "p => eadv.ord_P.val.last(); f => eadv.ord_F.val.last(); a : {p? => 1}, {=> 0}; b : {p!? and f? => 1}, {nvl(p, 0) = 0 => 2}, {=> 3}; c : {. => coalesce(p, f, -1)}; d : {nvl(p, f)!? => 1};"),),
        f"""WITH o AS ({_SOURCE['orders']}), w AS (SELECT * FROM (SELECT DISTINCT eid FROM o) LEFT JOIN ({_ranked('val AS p', _NEW, "att = 'ord_P'")}) USING (eid) LEFT JOIN ({_ranked('val AS f', _NEW, "att = 'ord_F'")}) USING (eid))
            SELECT *, CASE WHEN p IS NULL THEN 1 ELSE 0 END AS a, CASE WHEN p IS NOT NULL AND f IS NULL THEN 1 WHEN coalesce(p, 0) = 0 THEN 2 ELSE 3 END AS b, coalesce(p, f, -1) AS c,
            CASE WHEN coalesce(p, f) IS NOT NULL THEN 1 END AS d FROM w"""),
    "compute_date_math": _one("events", "f => eadv.click.dt.min(); l => eadv.click.dt.max(); span : {. => l - f}; age : {. => sysdate - l}; next : {. => l + 7}; back : {. => sysdate - 30}; y : {. => extract(year from l) * 100 + extract(month from l)}; late : {l > sysdate - 5 => 1}, {=> 0};",
        """SELECT eid, f, l, date_diff('day', f, l) AS span, date_diff('day', l, TIMESTAMP '2024-02-01') AS age, CAST(l AS DATE) + 7 AS next, DATE '2024-01-02' AS back,
           year(l) * 100 + month(l) AS y, CASE WHEN l > DATE '2024-01-27' THEN 1 ELSE 0 END AS late
           FROM (SELECT eid, min(dt) AS f, max(dt) AS l FROM o WHERE att = 'click' GROUP BY eid)"""),
    "compute_string_funcs": _one("events", "a => eadv.%.att.last(); d => eadv.%.dt.max(); s1 : {. => substr(a, 2, 3)}; s2 : {. => substr(a, -2)}; s3 : {. => 'x-' + upper(a)}; s4 : {. => to_char(d, 'YYYY/MM/DD')}; s5 : {a in ('click', 'view') => 1}, {a like 'p%' => 2}, {=> length(a)};",
        f"""SELECT eid, a, d, substr(a, 2, 3) AS s1, right(a, 2) AS s2, 'x-' || upper(a) AS s3, strftime(d, '%Y/%m/%d') AS s4,
            CASE WHEN a IN ('click', 'view') THEN 1 WHEN a LIKE 'p%' THEN 2 ELSE length(a) END AS s5
            FROM ({_ranked('att AS a', _NEW, 'TRUE')}) JOIN (SELECT eid, max(dt) AS d FROM o GROUP BY eid) USING (eid)"""),
    "compute_least_greatest": Query("orders", (("main", "p => eadv.ord_P.val.max(); f => eadv.ord_F.val.max(); lo : {. => least(p, f)}; hi : {. => greatest(p, f, 1000)};"),),
        f"""WITH o AS ({_SOURCE['orders']}) SELECT eid, p, f, CASE WHEN p IS NOT NULL AND f IS NOT NULL THEN least(p, f) END AS lo, CASE WHEN p IS NOT NULL AND f IS NOT NULL THEN greatest(p, f, 1000) END AS hi
            FROM (SELECT eid, max(val) FILTER (WHERE att = 'ord_P') AS p, max(val) FILTER (WHERE att = 'ord_F') AS f FROM o GROUP BY eid)"""),
    "compute_least_greatest_date": Query("orders", (("main", "p => eadv.ord_P.dt.max(); f => eadv.ord_F.dt.max(); lo : {. => least_date(p, f)}; hi : {. => greatest_date(p, f)}; z : {least_date(p, f) > lower__bound__dt and p < upper__bound__dt => 1};"),),
        f"""WITH o AS ({_SOURCE['orders']}) SELECT eid, p, f, least(p, f) AS lo, greatest(p, f) AS hi, CASE WHEN least(p, f) IS NOT NULL AND p IS NOT NULL THEN 1 END AS z
            FROM (SELECT eid, max(dt) FILTER (WHERE att = 'ord_P') AS p, max(dt) FILTER (WHERE att = 'ord_F') AS f FROM o GROUP BY eid)"""),
    "compute_arithmetic": Query("orders", (("main", "p => eadv.ord_P.val.sum(); f => eadv.ord_F.val.sum(); r : {. => round(p / f, 3)}; z : {. => p / (f - f)}; c : {. => ceil(f / 1000) + floor(f / 1000) - abs(-2) * power(2, 3)}; t : {. => to_number('12.5') + nvl(p, 0)};"),),
        f"""WITH o AS ({_SOURCE['orders']}) SELECT eid, round(p, 8) AS p, round(f, 8) AS f, round(p / f, 3) AS r, NULL::DOUBLE AS z, ceil(f / 1000) + floor(f / 1000) - 16.0::DOUBLE AS c, round(12.5::DOUBLE + coalesce(p, 0), 8) AS t
            FROM (SELECT eid, sum(val) FILTER (WHERE att = 'ord_P') AS p, sum(val) FILTER (WHERE att = 'ord_F') AS f FROM o GROUP BY eid)"""),
    "compute_case_when": _one("events", "c => eadv.click.val.max(); k : {. => case when c > 90 then 'top' when c is null then 'none' else 'rest' end}; m : {case when c > 50 then 1 else 0 end = 1 => c}, {=> `text`};",
        f"SELECT eid, c, CASE WHEN c > 90 THEN 'top' WHEN c IS NULL THEN 'none' ELSE 'rest' END AS k, CASE WHEN c > 50 THEN c::VARCHAR ELSE 'text' END AS m FROM ({_grouped('max(val) AS c', _CLICK)})"),
    "compute_helpers": _one("events", """c => eadv.click.val.max(); f => eadv.click.dt.min(); l => eadv.click.dt.max(); t1 : {. => to_char(floor(c))}; t2 : {. => ltrim('  a') + rtrim('b  ') + trim(' c ') + lower('D') + replace('xyx', 'x', 'z')};
            n1 : {. => nullif(floor(c), 99)}; n2 : {. => instr('clicks', 'ick') + length('abc') + mod(17, 5) + sign(-3) + trunc(-2.7)}; n3 : {. => round(sqrt(c) + exp(1) + ln(10) + log(2, 8), 6)};
            d1 : {. => date_add(f, 10)}; d2 : {. => date_diff(l, f)}; d3 : {. => add_months(l, 2)}; d4 : {. => trunc(l)}; d5 : {. => to_date('2020-02-29')}; d6 : {. => to_date('03/02/2021', 'DD/MM/YYYY')}; s1 : {. => concat('a', 'b', substring('xyz', 2))};""",
        """SELECT eid, c, f, l, floor(c)::BIGINT::VARCHAR AS t1, 'abcdzyz' AS t2, CASE WHEN floor(c) <> 99 THEN floor(c)::BIGINT END AS n1, (instr('clicks', 'ick') + length('abc') + 17 % 5 + sign(-3) + trunc(-2.7))::DOUBLE AS n2, round(sqrt(c) + exp(1) + ln(10) + 3, 6) AS n3,
           CAST(f AS DATE) + 10 AS d1, date_diff('day', f, l) AS d2, CAST(CAST(l AS DATE) + INTERVAL 2 MONTH AS DATE) AS d3, CAST(l AS DATE) AS d4, DATE '2020-02-29' AS d5, DATE '2021-02-03' AS d6, 'abyz' AS s1
           FROM (SELECT eid, max(val) AS c, min(dt) AS f, max(dt) AS l FROM o WHERE att = 'click' GROUP BY eid)"""),
    "prose_block": _one("events", "the patient's record; v => eadv.click.val.count(); clinicians' notes; it's done; w : {v > 3 => 'it is; so'};",
        f"SELECT eid, n AS v, CASE WHEN n > 3 THEN 'it is; so' END AS w FROM ({_grouped('count(val) AS n', _CLICK)})"),
    # fetches over the delivered observations: NULL, text that is no number, copies, ties
    "dirty_numbers": _one("eadv", "s => eadv.lab_bld_creat.val.sum(); a => eadv.lab_bld_creat.val.avg(); m => eadv.lab_bld_creat.val.median(); lo => eadv.lab_bld_creat.val.min(); hi => eadv.lab_bld_creat.val.max(); k => eadv.[lab_bld_creat, obs_pulse].val.regr_slope(); b => eadv.lab_bld_creat.val.maxldv();",
        f"""SELECT eid, s, a, m, lo, hi, k, b_val, b_dt FROM (SELECT DISTINCT eid FROM x)
            LEFT JOIN (SELECT eid, round(sum(n), 8) AS s, round(avg(n), 8) AS a, round(median(n), 8) AS m, min(n) AS lo, max(n) AS hi FROM x WHERE att = 'lab_bld_creat' GROUP BY eid) USING (eid)
            LEFT JOIN (SELECT eid, CASE WHEN NOT isnan(k) AND NOT isinf(k) THEN round(k, 8) END AS k FROM (SELECT eid, regr_slope(n, date_diff('day', DATE '1970-01-01', dt::DATE)) AS k FROM x WHERE att IN ('lab_bld_creat', 'obs_pulse') GROUP BY eid)) USING (eid)
            LEFT JOIN (SELECT eid, val AS b_val, dt AS b_dt FROM x WHERE att = 'lab_bld_creat' QUALIFY row_number() OVER (PARTITION BY eid ORDER BY n DESC NULLS LAST, dt DESC NULLS LAST, att, val NULLS LAST) = 1) USING (eid)"""),
    "dirty_values": _one("eadv", "l => eadv.lab_bld_potassium.val.last(); f => eadv.lab_bld_potassium.val.firstdv(); n => eadv.lab_bld_potassium.val.nth(2); d => eadv.lab_bld_potassium.val.distinct_count(); m => eadv.lab_bld_potassium.val.stats_mode(); c => eadv.lab_bld_potassium.val.count(); x => eadv.lab_bld_potassium._.exists(); s => eadv.lab_bld_potassium.val.serialize(|);",
        f"""SELECT eid, l, f_val, f_dt, n, d, m, c, x, s FROM (SELECT DISTINCT eid FROM o)
            LEFT JOIN ({_ranked('val AS l', _NEW, _POTASSIUM)}) USING (eid) LEFT JOIN ({_ranked('val AS f_val, dt AS f_dt', _OLD, _POTASSIUM)}) USING (eid) LEFT JOIN ({_ranked('val AS n', _NEW, _POTASSIUM, 2)}) USING (eid)
            LEFT JOIN (SELECT eid, val AS m FROM (SELECT eid, val, row_number() OVER (PARTITION BY eid ORDER BY count(*) DESC, val) AS rn FROM o WHERE {_POTASSIUM} AND val IS NOT NULL GROUP BY eid, val) WHERE rn = 1) USING (eid)
            LEFT JOIN (SELECT eid, count(DISTINCT val) AS d, count(val) AS c, 1 AS x, string_agg(val, '|' ORDER BY {_OLD}) FILTER (WHERE val IS NOT NULL) AS s FROM o WHERE {_POTASSIUM} GROUP BY eid) USING (eid)"""),
    "dirty_times": _one("eadv", "g => eadv.lab_bld_potassium.val.max_neg_delta_dv(); r => eadv.lab_bld_potassium.dt.temporal_regularity(); d => eadv.lab_bld_potassium.dt.distinct_count(); y => eadv.lab_bld_potassium.dt.nth(3);",
        f"""SELECT eid, g_val, g_dt, r, d, y FROM (SELECT DISTINCT eid FROM x)
            LEFT JOIN (SELECT eid, round(k, 8) AS g_val, dt AS g_dt FROM (SELECT eid, dt, n - lag(n) OVER (PARTITION BY eid ORDER BY {_OLD}) AS k FROM x WHERE {_POTASSIUM}) WHERE k < 0 QUALIFY row_number() OVER (PARTITION BY eid ORDER BY k, dt DESC) = 1) USING (eid)
            LEFT JOIN (SELECT eid, CASE WHEN count(g) <= 1 THEN NULL WHEN avg(g) = 0 THEN 0 ELSE round(stddev_samp(g) / avg(g), 8) END AS r FROM (
                SELECT eid, date_diff('day', lag(dt) OVER (PARTITION BY eid ORDER BY {_OLD}), dt) AS g FROM x WHERE {_POTASSIUM}) GROUP BY eid) USING (eid)
            LEFT JOIN (SELECT eid, count(DISTINCT dt) AS d FROM x WHERE {_POTASSIUM} GROUP BY eid) USING (eid)
            LEFT JOIN (SELECT eid, dt AS y FROM x WHERE {_POTASSIUM} QUALIFY row_number() OVER (PARTITION BY eid ORDER BY {_NEW}) = 3) USING (eid)"""),
    # several blocks
    "bind_cross_block": Query("events", (("derived", "c => rout_base.c.val.bind(); t => rout_base.l_dt.dt.bind(); hot : {c > 50 => 1}, {=> 0}; days : {. => sysdate - t};"), ("base", "c => eadv.click.val.last(); l => eadv.view.val.lastdv();")),
        f"""WITH o AS ({_SOURCE['events']}) SELECT eid, c, t, CASE WHEN c > 50 THEN 1 ELSE 0 END AS hot, date_diff('day', t, TIMESTAMP '2024-02-01') AS days FROM (SELECT DISTINCT eid FROM o)
            LEFT JOIN ({_ranked('val AS c', _NEW, _CLICK)}) USING (eid) LEFT JOIN ({_ranked('dt AS t', _NEW, "att = 'view'")}) USING (eid)"""),
    "bind_chain": Query("events", (("rb3", "z => rout_rb2.y.val.bind(); w : {z > 10 => z}, {=> 0};"), ("rb1", "x => eadv.click.val.count();"), ("rb2", "x => rout_rb1.x.val.bind(); y : {. => x * 2};")),
        f"WITH o AS ({_SOURCE['events']}) SELECT eid, 2 * n AS z, CASE WHEN 2 * n > 10 THEN 2 * n ELSE 0 END AS w FROM ({_grouped('count(val) AS n', _CLICK)})"),
    "mixed_block": _one("events", """// all kinds at once
            #doc({a: "b"});
            l => eadv.click.val.last(); a => eadv.[click, view].val.avg(); c => eadv.click.val.count();
            s => eadv.purchase.val.serialize(,); r => eadv.click.val.regr_slope(); e => eadv.error.val.exists();
            flag : {l < 60 and c > 2 => 1}, {=> 0}; /* end */""",
        f"""SELECT eid, l, a, c, s, r, e, CASE WHEN l < 60 AND c > 2 THEN 1 ELSE 0 END AS flag FROM (SELECT DISTINCT eid FROM o)
            LEFT JOIN ({_ranked('val AS l', _NEW, _CLICK)}) USING (eid) LEFT JOIN ({_grouped('round(avg(val), 8) AS a', "att IN ('click', 'view')")}) USING (eid)
            LEFT JOIN ({_grouped('count(val) AS c', _CLICK)}) USING (eid) LEFT JOIN ({_grouped(f"string_agg(val::VARCHAR, ',' ORDER BY {_OLD}) AS s", "att = 'purchase'")}) USING (eid)
            LEFT JOIN (SELECT eid, CASE WHEN NOT isnan(k) THEN round(k, 8) END AS r FROM (SELECT eid, regr_slope(val, {_DAYS}) AS k FROM {_FIT} GROUP BY eid)) USING (eid)
            LEFT JOIN ({_grouped('1 AS e', "att = 'error'")}) USING (eid)"""),
    "empty_block": Query("orders", (("main", "this is no statement"),), f"WITH o AS ({_SOURCE['orders']}) SELECT DISTINCT eid FROM o"),
}


# the given programs: linking and choosing


def _programs(spark: SparkSession, folder: str, options: Options) -> list:
    """Blocks of the given programs in execution order, as the engine chooses them; nothing is planned."""
    from ..engine import parse
    from ..graph import ordered, transform

    blocks, _ = read_blocks(table(spark, folder, "ruleblocks"))
    parsed = parse([b for b in blocks if b.is_active or options.include_inactive])
    return transform(ordered(parsed), options.subset, options.prune_inputs, options.prune_outputs)


def _names(options: Options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.createDataFrame([(b.name,) for b in _programs(spark, folder, options)], "name string")

    return run


def program_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of the manifest of the given programs, without the order, which may differ between valid orders."""
    m = generate_manifest(_programs(spark, folder, Options()))
    rows = [(e.ruleblock_id, e.target_table, ",".join(sorted(e.dependencies)), ",".join(e.output_variables)) for e in m.entries]
    return spark.createDataFrame(rows, "name string, target_table string, dependencies string, output_variables string")


def program_order(spark: SparkSession, folder: str) -> DataFrame:
    """Number of blocks, dependencies, dependencies that come too late, and cycles of the given programs."""
    m = generate_manifest(_programs(spark, folder, Options()))
    at = {e.ruleblock_id: e.execution_order for e in m.entries}
    edges = [(e.ruleblock_id, d) for e in m.entries for d in e.dependencies]
    late = sum(at[d] > at[n] for n, d in edges if d in at)
    return spark.createDataFrame([(len(at), len(edges), late, 0 if find_cycle(m.dependency_graph) is None else 1)], "blocks long, edges long, late long, cycles long")


def program_run(spark: SparkSession, folder: str) -> DataFrame:
    """A given program and all it depends on, over the delivered observations."""
    blocks, _ = read_blocks(table(spark, folder, "ruleblocks"))
    engine = Engine(spark, {"eadv": adapters.eadv(spark, folder)})
    result = engine.compile(blocks, Options(static_sysdate=TODAY, prune_outputs=("garsi_02",)))
    if not result.success:
        raise ValueError("; ".join(m.message for m in result.errors))
    return rounded(engine.run(result)["garsi_02"])


def program_all(spark: SparkSession, folder: str) -> DataFrame:
    """All active given programs over the delivered observations, written block by block: ``name, eid, row`` of every block and entity, ``row`` as JSON."""
    blocks, _ = read_blocks(table(spark, folder, "ruleblocks"))
    engine = Engine(spark, {"eadv": adapters.eadv(spark, folder)})
    result = engine.compile(blocks, Options(static_sysdate=TODAY))
    if not result.success:
        raise ValueError("; ".join(m.message for m in result.errors))
    stored = {name: spark.read.parquet(path) for name, path in engine.write(result, workspace(spark, "programs")).items()}
    parts = [df.select(F.lit(name).alias("name"), "eid", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")) for name, df in stored.items()]
    return reduce(DataFrame.unionAll, parts)


# what a compile reports, writes and reads back

_BASE = RuleblockInput("base", "n => eadv.click.val.count().where(dt > sysdate - 20); l => eadv.click.val.lastdv();")
_NEXT = RuleblockInput("next", "n => rout_base.n.val.bind(); t => rout_base.l_dt.dt.bind(); age : {t!? => sysdate - t}; busy : {n > 2 => 1}, {=> 0};")
_RECENT = f"""WITH o AS ({_SOURCE['events']}), b AS (SELECT eid, CASE WHEN count(*) FILTER (WHERE dt > DATE '2024-01-12') > 0 THEN count(val) FILTER (WHERE dt > DATE '2024-01-12') END AS n, max(dt) AS t FROM o WHERE att = 'click' GROUP BY eid)
    SELECT eid, n, t, date_diff('day', t, TIMESTAMP '2024-02-01') AS age, CASE WHEN n > 2 THEN 1 ELSE 0 END AS busy FROM (SELECT DISTINCT eid FROM o) LEFT JOIN b USING (eid)"""


def write_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Results written twice, with the options of their compile, and read back; the second run replaces the first."""
    engine = Engine(spark, {"eadv": adapters.events(spark, folder)})
    path = workspace(spark, "written")
    for options in (Options(static_sysdate="2023-06-01"), Options(static_sysdate=TODAY)):
        written = engine.write(engine.compile([_NEXT, _BASE], options), path)
    return spark.read.parquet(written["next"])


def late_bind(spark: SparkSession, folder: str) -> DataFrame:
    """A block whose source is pruned away and was saved by an earlier run."""
    engine = Engine(spark, {"eadv": adapters.events(spark, folder)})
    written = engine.write(engine.compile([_BASE], Options(static_sysdate=TODAY)), workspace(spark, "written"))
    later = Engine(spark, engine.catalog | {"rout_base": spark.read.parquet(written["base"])})
    return later.compile([_BASE, _NEXT], Options(static_sysdate=TODAY, subset=("next",))).dataframes["next"]


#: Programs that cannot be compiled, and what the result says.
_FAULTS = {
    "forward": ("v : {w > 1 => 1}; w => eadv.click.val.last();", "Undefined variable: w in v"), "unknown variable": ("v => eadv.click.val.count().where(val > q);", "Undefined variable: q in v"),
    "unknown function": ("v => eadv.click.val.lowest();", "Unsupported function: lowest"), "unknown table": ("v => nowhere.click.val.last();", "Unknown table: nowhere"), "twice": ("v => eadv.a.val.last(); V => eadv.b.val.last();", "Variable defined twice: v"),
    "unknown source": ("v => rout_gone.x.val.bind();", "Unknown ruleblock in bind: gone"), "cycle": ("v => rout_main.v.val.bind();", "Circular dependency detected: main -> main"), "types": ("v : {sysdate > 5 => 1};", "A date is compared with a number"),
}


def compile_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Each faulty program leaves a result without success and DataFrames, with the cause."""
    engine = Engine(spark, {"eadv": adapters.events(spark, folder)})
    results = {k: engine.compile([RuleblockInput("main", text)]) for k, (text, _) in _FAULTS.items()}
    return spark.createDataFrame([(k, r.success, len(r.dataframes), r.errors[0].message) for k, r in results.items()], "fault string, success boolean, frames long, message string")


def compile_report(spark: SparkSession, folder: str) -> DataFrame:
    """What a compile of all given programs reports: input blocks, results, warnings, stages timed, cache hits."""
    blocks, _ = read_blocks(table(spark, folder, "ruleblocks"))
    r = Engine(spark, {"eadv": adapters.eadv(spark, folder)}).compile(blocks, Options(static_sysdate=TODAY))
    timed = all(r.metrics[f"{k}_ms"] >= 0 for k in ("parse", "link", "transform", "plan")) and r.metrics["total_ms"] >= r.metrics["plan_ms"]
    return spark.createDataFrame([(r.success, r.metrics["ruleblocks"], len(r.dataframes), timed, r.metrics["cache_hit_rate"])], "success boolean, given long, results long, timed boolean, hits long")


def manifest_file(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of the given programs as written to a file of the driver and read back."""
    with tempfile.TemporaryDirectory() as d:
        write_manifest(generate_manifest(_programs(spark, folder, Options())), f"{d}/deep/manifest.json")
        m = json.loads(Path(f"{d}/deep/manifest.json").read_text())
    rows = [(e["ruleblockId"], e["targetTable"], len(e["dependencies"]), e["outputVariables"], m["totalRuleblocks"], len(m["dependencyGraph"])) for e in m["entries"]]
    return spark.createDataFrame(rows, "name string, target_table string, dependencies long, output_variables array<string>, total long, graph long").withColumn("output_variables", F.array_join("output_variables", ","))


_EDGES = "e AS (SELECT ruleblockId AS n, unnest(dependencies) AS d FROM manifest_entries)"
_DOWN = f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'marnu_01' AS n UNION SELECT e.n FROM e JOIN r ON e.d = r.n) SELECT n AS name FROM r"
_UP = f"WITH RECURSIVE {_EDGES}, r AS (SELECT 'cobli_49' AS n UNION SELECT e.d FROM e JOIN r ON e.n = r.n) SELECT n AS name FROM r"
_V = "eadv"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **RULES,
    "prune_inputs": _names(Options(prune_inputs=("marnu_01",))),
    "prune_outputs": _names(Options(prune_outputs=("COBLI_49",))),
    "prune_both": _names(Options(prune_inputs=("sulpa_00",), prune_outputs=("cobli_49",))),
    "subset": _names(Options(subset=("Garsi_02", "sulpa_00", "unknown"))),
    "program_manifest": program_manifest,
    "program_order": program_order,
    "program_run": program_run,
    "program_all": program_all,
} | {f.__name__: f for f in (write_round_trip, late_bind, compile_faults, compile_report, manifest_file)}

SQL: dict[str, str] = {name: q.sql for name, q in RULES.items()} | {
    "prune_inputs": _DOWN,
    "prune_outputs": _UP,
    "prune_both": f"""WITH RECURSIVE {_EDGES}, up AS (SELECT 'cobli_49' AS n UNION SELECT e.d FROM e JOIN up ON e.n = up.n),
        down AS (SELECT 'sulpa_00' AS n UNION SELECT e.n FROM e JOIN down ON e.d = down.n) SELECT n AS name FROM up INTERSECT SELECT n FROM down""",
    "subset": "SELECT name FROM ruleblocks WHERE lower(name) IN ('garsi_02', 'sulpa_00')",
    "program_manifest": "SELECT ruleblockId AS name, targetTable AS target_table, array_to_string(list_sort(dependencies), ',') AS dependencies, array_to_string(outputVariables, ',') AS output_variables FROM manifest_entries",
    "program_order": "SELECT count(*) AS blocks, sum(len(dependencies))::BIGINT AS edges, 0::BIGINT AS late, 0::BIGINT AS cycles FROM manifest_entries",
    "write_round_trip": _RECENT,
    "late_bind": _RECENT,
    "compile_faults": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', false, 0::BIGINT, '{m}')" for k, (_, m) in _FAULTS.items()) + ") AS t(fault, success, frames, message)",
    "compile_report": """SELECT true AS success, (SELECT count(*) FROM ruleblocks WHERE regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*')) AS given, (SELECT count(*) FROM manifest_entries) AS results, true AS timed, 0::BIGINT AS hits""",
    "manifest_file": """SELECT ruleblockId AS name, targetTable AS target_table, len(dependencies) AS dependencies, array_to_string(outputVariables, ',') AS output_variables,
        (SELECT count(*) FROM manifest_entries) AS total, (SELECT count(*) FROM manifest_entries) AS graph FROM manifest_entries""",
    "program_run": rf"""
        WITH o AS ({_SOURCE['eadv']}), u AS (SELECT DISTINCT eid FROM o),
        ser AS (SELECT eid, string_agg(val, '|' ORDER BY dt NULLS LAST, att, val NULLS LAST) AS v FROM o WHERE att = 'dev_press_ven' AND val IS NOT NULL GROUP BY eid),
        dv AS (SELECT eid, val, dt FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY {_NEW}) AS rn FROM o WHERE att = 'lab_ua_acr' OR att LIKE 'rx\_sulfepril%' ESCAPE '\') WHERE rn = 1),
        osm AS (SELECT eid, string_agg(val || '~' || strftime(dt, '%Y-%m-%d'), '|' ORDER BY dt NULLS LAST, att, val NULLS LAST) AS v FROM o WHERE att = 'lab_ua_osmol' GROUP BY eid),
        wcc AS (SELECT eid, sum(try_cast(trim(val) AS DOUBLE)) AS v FROM o WHERE att = 'lab_bld_wcc' AND dt > DATE '2024-02-01' - 878 GROUP BY eid),
        bic AS (SELECT eid, string_agg(val || '~' || strftime(dt, '%Y-%m-%d'), '|' ORDER BY dt NULLS LAST, att, val NULLS LAST) AS v FROM o WHERE att = 'lab_bld_bicarb' GROUP BY eid)
        SELECT u.eid, ser.v AS v0_serialize2, dv.val AS v1_lastdv_val, dv.dt AS v1_lastdv_dt, osm.v AS v2_serializedv, round(wcc.v, 8) AS b0_v0_sum,
               CASE WHEN bic.v IS NOT NULL THEN 1 ELSE 0 END AS b1_has_0, CASE WHEN ser.v IS NOT NULL THEN 1 ELSE 0 END AS has_2
        FROM u LEFT JOIN ser USING (eid) LEFT JOIN dv USING (eid) LEFT JOIN osm USING (eid) LEFT JOIN wcc USING (eid) LEFT JOIN bic USING (eid)""",
}
