"""Queries of this subpackage over whole tables, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import encode, keyword_spam, mixing, terms, top_items


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_items.top_readings(table(spark, folder, "eadv"), table(spark, folder, "att_catalog")).select("rid")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return terms.kinds(table(spark, folder, "eadv"), table(spark, folder, "att_catalog"))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return terms.marked(table(spark, folder, "eadv"), table(spark, folder, "att_catalog"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(table(spark, folder, "documents"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as its token ids give it back."""
    return encode.decode(encode.encode(table(spark, folder, "documents")))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_met(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.met(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_spam.found(table(spark, folder, "documents"))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_spam.scores(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_counts, p7_ids, p7_round_trip, p8_mix, p8_shares, p8_met, p9_found, p9_scores)}

_NUMERIC = """
SELECT e.rid, e.eid, c.att, e.dt, CAST(trim(e.val) AS DOUBLE) AS num
FROM eadv e JOIN att_catalog c ON c.att = lower(trim(e.att))
WHERE c.data_type = 'NUMERIC' AND regexp_full_match(trim(e.val), '-?[0-9]+([.][0-9]+)?')
"""

_TERMS = """
rows AS (SELECT c.att, regexp_extract_all(lower(e.val), '[\\p{L}\\p{Nd}]+') AS ws
         FROM eadv e JOIN att_catalog c ON c.att = lower(trim(e.att)) WHERE c.data_type = 'TEXT' AND e.val IS NOT NULL),
names AS (SELECT att, count(*) AS n FROM rows WHERE len(ws) > 0 GROUP BY att),
counts AS (SELECT att, term, sum(k)::BIGINT AS occurrences, count(*) AS records
           FROM (SELECT att, unnest(list_distinct(ws)) AS term, ws FROM rows) t, LATERAL (SELECT len(list_filter(t.ws, lambda w: w = t.term)) AS k)
           GROUP BY att, term),
marked AS (SELECT att, term, occurrences, records, records <= 2 AS rare, records * 4 > n AS common FROM counts JOIN names USING (att))
"""

SQL = {
    "p2_found": f"""
        SELECT rid FROM ({_NUMERIC}) r
        QUALIFY row_number() OVER (PARTITION BY eid, att ORDER BY num DESC, dt DESC NULLS LAST, rid) <= 3""",
    "p3_found": f"""
        WITH {_TERMS} SELECT att, term, 'rare' AS kind FROM marked WHERE rare
        UNION ALL SELECT att, term, 'common' AS kind FROM marked WHERE common""",
    "p3_counts": f"WITH {_TERMS} SELECT * FROM marked",
}

SQL["p8_met"] = r"""
    WITH boards AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s\-./_]+', '_', 'g') AS source FROM documents WHERE length(text) > 0),
    t AS (SELECT m.source, m.target_share, b.source IS NOT NULL AS there FROM mix_targets m LEFT JOIN boards b USING (source))
    SELECT source, CASE WHEN there THEN round(target_share / sum(target_share) FILTER (WHERE there) OVER (), 6) END AS goal, there AS met, true AS kept FROM t"""
SQL["p7_round_trip"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
