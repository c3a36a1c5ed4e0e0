from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from ruleframe.functions import values

NUMBERS = {
    "5": 5.0, " 5.25 ": 5.25, "-3": -3.0, "+4.42": 4.42, "= 4": 4.0, "4,08": 4.08, "2.000000e+00": 2.0, "４.５６": 4.56, "٣٫٥": 3.5, "4,303.0": 4303.0, "1.778,0": 1778.0,
    "4 737.0": 4737.0, "1,250": 1250.0, "1.250": 1.25, "1.234.567": 1234567.0, "4.40 mmol/L": 4.4, "4.40mmol/l": 4.4, "3 H": 3.0, "71*": 71.0, "4 (H)": 4.0, "86!": 86.0, "4 x": 4.0, "4x": 4.0,
    "4.4 mmol/L H": 4.4, ".5": 0.5, " 7 ": 7.0, "−5": -5.0,
}
NOT_NUMBERS = ["", "   ", None, "<5", "> 5", "≤5", "3-5", "3–5", "3 to 5", "328/67", "317.1.4", "4.14.8.5", "nan", "NaN", "inf", "1e999", "n/a", "-", "+", "++", "?", "...", "NULL", "\\N",
               "2019-04-02", "true", "Y", "over 85", "at least 3", "tube 2 rejected", '{"code": "E7"}', "#DIV/0!", "pending"]
DATES = {
    "1962-02-27": date(1962, 2, 27), " 1991-08-02": date(1991, 8, 2), "21.06.1967": date(1967, 6, 21), "19860204": date(1986, 2, 4), "27/03/1997": date(1997, 3, 27), "2020/01/07": date(2020, 1, 7),
    "1944-10-18T00:00:00": date(1944, 10, 18), "26 Oct 2010": date(2010, 10, 26), "7-MAY-2001": date(2001, 5, 7), "Sep 17, 1980": date(1980, 9, 17), "4 December 2008": date(2008, 12, 4),
    "12/25/2001": date(2001, 12, 25), "2024-02-29": date(2024, 2, 29), "２０２０-０１-０２": date(2020, 1, 2),
}
NOT_DATES = ["", None, "31.04.1993", "2023-02-29", "1962-00-02", "0000-00-00", "1970", "2023-07", "77", "spring 1951", "approx 1949", "see letter", "unknown", "20101301", "4 Foo 2008"]
BOOLEANS = {"true": True, " TRUE": True, "T": True, "yes": True, "y": True, "1": True, "１": True, "false": False, "F": False, "No": False, "n": False, "0": False}
NOT_BOOLEANS = ["", None, "2", "3.5", "Y/N", "true false", "maybe", "-", "10", "2019-04-02"]


def read(spark, texts, column):
    df = spark.createDataFrame([(t, "mmol/L") for t in texts], "t string, u string")
    return [r[0] for r in df.select(column(F.col("t"), F.col("u"))).collect()]


def test_numbers(spark):
    assert dict(zip(NUMBERS, read(spark, NUMBERS, values.number))) == pytest.approx(NUMBERS)
    assert read(spark, NOT_NUMBERS, values.number) == [None] * len(NOT_NUMBERS)


def test_unit_is_taken_off_before_reading(spark):
    df = spark.createDataFrame([("26210*9/L", "10*9/L"), ("25.8kg/m2", "kg/m2"), ("5", None), ("5 mmol/L", None)], "t string, u string")
    assert [r[0] for r in df.select(values.number(F.col("t"), F.col("u"))).collect()] == [262.0, 25.8, 5.0, None]


def test_dates_and_booleans(spark):
    assert read(spark, DATES, lambda t, u: values.date(t)) == list(DATES.values())
    assert read(spark, NOT_DATES, lambda t, u: values.date(t)) == [None] * len(NOT_DATES)
    assert read(spark, BOOLEANS, lambda t, u: values.boolean(t)) == list(BOOLEANS.values())
    assert read(spark, NOT_BOOLEANS, lambda t, u: values.boolean(t)) == [None] * len(NOT_BOOLEANS)


def test_filter_on_a_read_number_above_a_join(spark, catalog):
    rows = spark.createDataFrame([("lab_k", "4 mmol/L"), ("lab_k", "x"), ("lab_free", "7U/L")], "att string, val string")
    j = rows.join(F.broadcast(catalog.select("att", "unit")), "att").select(values.number(F.col("val"), F.col("unit")).alias("n")).where("n is not null")
    assert sorted(r.n for r in j.collect()) == [4.0, 7.0]


def test_plain_number(spark):
    texts = ["5", " -5.5 ", "+5", "5.", "5e3", None, "１", "4,0"]
    assert read(spark, texts, lambda t, u: values.plain_number(t)) == [5.0, -5.5, None, None, None, None, None, None]
