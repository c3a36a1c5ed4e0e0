from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from ruleframe import Engine, Options, RuleblockInput, RuleError, read_blocks

OPTIONS = Options(static_sysdate="2020-03-01")


@pytest.fixture(scope="module")
def eadv(spark):
    d = date
    rows = [
        (1, "lab_bld_egfr", d(2020, 1, 1), 60.0), (1, "lab_bld_egfr", d(2020, 1, 11), 50.0), (1, "lab_bld_egfr", d(2020, 1, 21), 55.0), (1, "lab_bld_egfr", d(2020, 1, 31), 40.0),
        (2, "lab_bld_egfr", d(2020, 2, 1), 90.0), (2, "lab_bld_egfr", d(2020, 2, 1), 80.0), (3, "lab_bld_haemoglobin", d(2020, 1, 5), 110.0), (4, "labXbld_egfr", d(2020, 1, 5), 1.0),
        (None, "lab_bld_egfr", d(2020, 1, 5), 5.0),
    ]
    return spark.createDataFrame(rows, "eid long, att string, dt date, val double")


def run(spark, df, text, options=OPTIONS, *others):
    result = Engine(spark, {"eadv": df}).compile([*(RuleblockInput(n, t) for n, t in others), RuleblockInput("main", text)], options)
    assert result.success, result.errors
    return {r.eid: r for r in result.dataframes["main"].collect()}


def errors(spark, df, text):
    result = Engine(spark, {"eadv": df}).compile([RuleblockInput("main", text)])
    assert not result.success and not result.dataframes
    return result.errors[0]


EXPECTED = {
    "last()": (40.0, 80.0), "first()": (60.0, 80.0), "nth(2)": (55.0, 90.0), "count()": (4, 2), "distinct_count()": (4, 2), "exists()": (1, 1), "sum()": (205.0, 170.0), "avg()": (51.25, 85.0),
    "median()": (52.5, 85.0), "min()": (40.0, 80.0), "max()": (60.0, 90.0), "stats_mode()": (40.0, 80.0), "serialize(|)": ("60.0|50.0|55.0|40.0", "80.0|90.0"), "serialize2(|)": ("60.0|50.0|55.0|40.0", "80.0|90.0"),
    "serializedv(|)": ("60.0~2020-01-01|50.0~2020-01-11|55.0~2020-01-21|40.0~2020-01-31", "80.0~2020-02-01|90.0~2020-02-01"),
    "serializedv2(round(val,0)~dt)": ("60.0~2020-01-01,50.0~2020-01-11,55.0~2020-01-21,40.0~2020-01-31", "80.0~2020-02-01,90.0~2020-02-01"),
    "regr_slope()": (-0.55, None), "regr_intercept()": (59.5, None), "regr_r2()": (0.6914285714, None), "temporal_regularity()": (0.0, None),
}
PAIRS = {
    "lastdv()": ((40.0, date(2020, 1, 31)), (80.0, date(2020, 2, 1))), "firstdv()": ((60.0, date(2020, 1, 1)), (80.0, date(2020, 2, 1))),
    "maxldv()": ((60.0, date(2020, 1, 1)), (90.0, date(2020, 2, 1))), "minldv()": ((40.0, date(2020, 1, 31)), (80.0, date(2020, 2, 1))),
    "minfdv()": ((40.0, date(2020, 1, 31)), (80.0, date(2020, 2, 1))), "max_neg_delta_dv()": ((-15.0, date(2020, 1, 31)), (None, None)),
}


def test_every_function_on_the_hand_checked_rows(spark, eadv):
    calls = list(EXPECTED) + list(PAIRS)
    got = run(spark, eadv, "".join(f"v{i} => eadv.lab_bld_egfr.val.{c};" for i, c in enumerate(calls)))
    assert set(got) == {1, 2, 3, 4}
    for i, c in enumerate(calls):
        for k, eid in enumerate((1, 2)):
            if c in EXPECTED:
                want = EXPECTED[c][k]
                assert got[eid][f"v{i}"] == (pytest.approx(want, abs=1e-9) if isinstance(want, float) else want), c
            else:
                assert (got[eid][f"v{i}_val"], got[eid][f"v{i}_dt"]) == PAIRS[c][k], c
    assert all(v is None for eid in (3, 4) for v in got[eid][1:])


def test_wildcards_take_underscores_literally(spark, eadv):
    got = run(spark, eadv, "a => eadv.lab_bld%.val.count(); b => eadv.[lab_bld_haemoglobin, lab%egfr].val.count();")
    assert [(got[e].a, got[e].b) for e in (1, 2, 3, 4)] == [(4, 4), (2, 2), (1, 1), (None, 1)]


def test_dependent_fetches(spark, eadv):
    got = run(spark, eadv, "m => eadv.lab_bld_egfr.val.avg(); c => eadv.lab_bld_egfr.val.count().where(val > m); l => eadv.lab_bld_egfr.val.last().where(val > m); n => eadv.lab_bld_egfr.val.nth(2).where(val >= m);")
    assert [(got[e].c, got[e].l, got[e].n) for e in (1, 2, 3, 4)] == [(2, 55.0, 60.0), (1, 90.0, None), (0, None, None), (0, None, None)]


def test_computes(spark, eadv):
    got = run(spark, eadv, """l => eadv.lab_bld_egfr.val.last(); d => eadv.lab_bld_egfr.val.lastdv();
        a : {l < 45 => `low; //`}, {l? => null}, {=> 1}; days : {d_dt!? => sysdate - d_dt}, {=> -1}; z : {. => l / 0}; t : {. => 'x' + l}; up : {. => d_dt + 1};
        g : {. => greatest(l, null)}; gd : {. => greatest_date(d_dt, null)}; w : {l in (40, 80) and not l between 50 and 90 => 1}, {=> 0}; x : {a = 'low; //' => 1};""")
    r = got[1]
    assert (r.a, r.days, r.z, r.t, r.up, r.g, r.gd, r.w, r.x) == ("low; //", 30, None, "x40.0", date(2020, 2, 1), None, date(2020, 1, 31), 1, 1)
    assert (got[2].a, got[3].a, got[3].days) == ("1", None, -1)


def test_binds(spark, eadv):
    got = run(spark, eadv, "x => rout_base.l.val.bind(); y : {x > 50 => 1}, {=> 0};", OPTIONS, ("base", "l => eadv.lab_bld_egfr.val.last();"))
    assert [(got[e].x, got[e].y) for e in (1, 2, 3)] == [(40.0, 0), (80.0, 1), (None, 0)]


@pytest.mark.parametrize(("text", "message"), [
    ("v => eadv.a.val.unknown();", "Unsupported function: unknown"), ("v : {x > 1 => 1};", "Undefined variable: x"), ("v : {w > 1 => 1}; w => eadv.a.val.last();", "Undefined variable: w"),
    ("v => eadv.a.val.last(); V => eadv.b.val.last();", "defined twice"), ("v => nowhere.a.val.last();", "Unknown table"), ("v => eadv.a.nothing.last();", "Unknown property"),
    ("v => rout_gone.x.val.bind();", "Unknown ruleblock"), ("v => rout_main.x.val.bind();", "Circular dependency"), ("v => eadv.a.val.last().where(foo(val) > 1);", "Unsupported function"),
    ("v => eadv.a.val.nth(x);", "positive number"), ("d => eadv.a.dt.max(); v : {. => d * 2};", "A date stands"),
])
def test_errors(spark, eadv, text, message):
    e = errors(spark, eadv, text)
    assert message in e.message and e.ruleblock == "main"


def test_inactive_blocks_metrics_and_warnings(spark, eadv, tmp_path):
    engine = Engine(spark, {"EADV": eadv})
    blocks = [RuleblockInput("a", "v => eadv.x.val.last(); prose"), RuleblockInput("b", "v => eadv.x.val.nope();", is_active=False)]
    r = engine.compile(blocks, Options(manifest_path=str(tmp_path / "m.json")))
    assert r.success and [w.ruleblock for w in r.warnings] == ["a"] and r.metrics["ruleblocks"] == 2 and (tmp_path / "m.json").exists()
    assert not engine.compile(blocks, Options(include_inactive=True)).success
    with pytest.raises(RuleError):
        engine.run(engine.compile(blocks, Options(include_inactive=True)))


def test_write_and_bind_what_was_written(spark, eadv, tmp_path):
    engine = Engine(spark, {"eadv": eadv})
    r = engine.compile([RuleblockInput("d1", "x => rout_b1.l_dt.dt.bind();"), RuleblockInput("b1", "l => eadv.lab_bld_egfr.val.lastdv();")], OPTIONS)
    for _ in range(2):  # a second run replaces the first
        paths = engine.write(r, str(tmp_path))
    assert list(paths) == ["b1", "d1"]
    assert spark.read.parquet(paths["d1"]).where("eid = 1").first().x == date(2020, 1, 31)
    engine.run(r)
    assert spark.table("rout_b1").count() == 4
    later = Engine(spark, {"eadv": eadv}).compile([RuleblockInput("late", "y => rout_b1.l_val.val.bind(); z : {y > 50 => 1};")])
    assert later.success and later.dataframes["late"].where("z = 1").count() == 1


def test_programs_of_a_table(spark):
    rows = spark.createDataFrame([("ok", "v => eadv.a.val.last();", True), ("7th", "x", True), ("off", None, False)], "name string, text string, isActive boolean")
    blocks, warnings = read_blocks(rows)
    assert [(b.name, b.is_active) for b in blocks] == [("ok", True), ("off", False)] and [w.ruleblock for w in warnings] == ["7th"]


def test_text_values_nulls_and_clashing_columns(spark):
    rows = [(1, "a", datetime(2020, 1, 1, 8), "5", "x", 1.0), (1, "a", datetime(2020, 1, 2), None, "y", 2.0), (1, "a", datetime(2020, 1, 3), "abc", "z", 3.0), (1, "a", None, "9", "z", 3.0), (2, "a", None, None, None, None)]
    df = spark.createDataFrame(rows, "eid long, att string, dt timestamp_ntz, val string, v string, __p0 double")
    got = run(spark, df, "v => eadv.a.val.sum(); l => eadv.a.val.last(); f => eadv.a.val.firstdv(); s => eadv.a.val.serialize(); c => eadv.a.val.count(); m => eadv.a.val.maxldv(); n => eadv.a.val.nth(1); t => eadv.a.val.serializedv();")
    assert tuple(got[1][1:]) == (14.0, "abc", "5", datetime(2020, 1, 1, 8), "5,abc,9", 3, "9", None, "abc", "5~2020-01-01,abc~2020-01-03")
    assert tuple(got[2][1:]) == (None, None, None, None, None, 0, None, None, None, None)
    empty = run(spark, df.limit(0), "v => eadv.a.val.sum();")
    assert empty == {}
    bad = Engine(spark, {"eadv": df}).compile([RuleblockInput("main", "v => eadv.a.val.sum();")], Options(strict_cast=True))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.dataframes["main"].collect()


def test_numbers_that_are_not_finite(spark):
    """NaN is the largest number in every function; no line is fitted through numbers that are not finite."""
    day = [datetime(2020, 1, d) for d in (1, 2, 3)]
    texts = {1: ("NaN", "7", "5"), 2: ("inf", " nan", "-inf"), 3: ("5", "Infinity", None), 4: ("1", "2", "3"), 5: ("x", None, "7")}
    df = spark.createDataFrame([(e, "a", day[i], v) for e, vs in texts.items() for i, v in enumerate(vs)], "eid long, att string, dt timestamp_ntz, val string")
    calls = ["maxldv()", "minldv()", "minfdv()", "max()", "min()", "regr_slope()", "regr_intercept()", "regr_r2()"]
    # the same over a variable, which goes another way
    free = run(spark, df, "".join(f"v{i} => eadv.a.val.{c};" for i, c in enumerate(calls)))
    late = run(spark, df, "n => eadv.a.dt.count();" + "".join(f"v{i} => eadv.a.val.{c}.where(n > 0);" for i, c in enumerate(calls)))
    for got in (free, late):
        assert {e: (r.v0_val, r.v0_dt) for e, r in got.items()} == {1: ("NaN", day[0]), 2: (" nan", day[1]), 3: ("Infinity", day[1]), 4: ("3", day[2]), 5: ("7", day[2])}
        assert {e: (r.v1_val, r.v2_val) for e, r in got.items()} == {1: ("5", "5"), 2: ("-inf", "-inf"), 3: ("5", "5"), 4: ("1", "1"), 5: ("7", "7")}
        assert {e: (str(r.v3), r.v4) for e, r in got.items()} == {1: ("nan", 5.0), 2: ("nan", float("-inf")), 3: ("inf", 5.0), 4: ("3.0", 1.0), 5: ("7.0", 7.0)}
        assert {e: (r.v5, r.v6, r.v7) for e, r in got.items()} == {e: (pytest.approx(1.0), pytest.approx(1.0), pytest.approx(1.0)) if e == 4 else (None, None, None) for e in texts}


def test_numbers_as_java_writes_them_are_text(spark):
    rows = [(1, "a", datetime(2020, 1, 1), v) for v in ("5d", "98.6F", "1.D ", "0x1p3", " +7", "1e1", "2.")] + [(2, "a", datetime(2020, 1, 1), v) for v in ("inf", "3f")]
    df = spark.createDataFrame(rows, "eid long, att string, dt timestamp_ntz, val string")
    got = run(spark, df, "s => eadv.a.val.sum(); m => eadv.a.val.median(); h => eadv.a.val.max(); n => eadv.a.val.count().where(val > 4);")
    assert tuple(got[1][1:]) == (19.0, 7.0, 10.0, 2) and tuple(got[2][1:]) == (float("inf"), float("inf"), float("inf"), 1)
    bad = Engine(spark, {"eadv": df}).compile([RuleblockInput("main", "v => eadv.a.val.sum();")], Options(strict_cast=True))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.dataframes["main"].collect()


def test_ordered_functions_against_brute_force(spark):
    rng = random.Random(3)
    start = datetime(2021, 1, 1)
    rows = [(rng.randrange(40), rng.choice("abc"), start + timedelta(hours=rng.randrange(400)), rng.choice([None, 1.0, 2.5, 2.5, 7.0, -3.0])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "eid long, att string, dt timestamp_ntz, val double")
    fns = ["last", "first", "nth(3)", "lastdv", "maxldv", "minldv", "minfdv", "max_neg_delta_dv"]
    got = run(spark, df, "".join(f"v{i} => eadv.[a, b].val.{f if '(' in f else f + '()'};" for i, f in enumerate(fns)))
    nul = lambda v: (v is None, v if v is not None else 0)
    neg = lambda t: -t.timestamp()
    for eid, r in got.items():
        mine = [x for x in rows if x[0] == eid and x[1] in "ab"]
        down = sorted(mine, key=lambda x: (neg(x[2]), x[1], nul(x[3])))
        up = sorted(mine, key=lambda x: (x[2], x[1], nul(x[3])))
        assert (r.v0, r.v1, r.v2, (r.v3_val, r.v3_dt)) == (down[0][3], up[0][3], down[2][3], (down[0][3], down[0][2]))
        assert (r.v4_val, r.v4_dt) == tuple(min(mine, key=lambda x: (x[3] is None, -(x[3] or 0), neg(x[2]), x[1]))[3:1:-1])
        assert (r.v5_val, r.v5_dt) == tuple(min(mine, key=lambda x: (*nul(x[3]), neg(x[2]), x[1]))[3:1:-1])
        assert (r.v6_val, r.v6_dt) == tuple(min(mine, key=lambda x: (*nul(x[3]), x[2], x[1]))[3:1:-1])
        falls = [(b[3] - a[3], neg(b[2]), b[2]) for a, b in zip(up, up[1:]) if a[3] is not None and b[3] is not None and b[3] < a[3]]
        assert (r.v7_val, r.v7_dt) == ((min(falls)[0], min(falls)[2]) if falls else (None, None))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def plan_of(spark, df, text):
    return Engine(spark, {"eadv": df}).compile([RuleblockInput("m", text)], OPTIONS).dataframes["m"]


def test_plan_shapes(spark, eadv):
    fused = plan_of(spark, eadv, "".join(f"v{i} => eadv.lab_bld_egfr.val.{c}();" for i, c in enumerate(["last", "first", "sum", "count", "serialize", "maxldv", "regr_slope"])))
    assert exchanges(fused) == 2  # entities; their matching rows
    ranked = plan_of(spark, eadv, "a => eadv.x.val.last(); b => eadv.x.val.nth(2); c => eadv.y.val.nth(3);")
    assert exchanges(ranked) == 4  # and (entity, fetch), entity
    assert ranked._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_scans_read_the_named_attributes_only(spark, eadv, tmp_path):
    eadv.write.parquet(str(tmp_path / "eadv"))
    stored = spark.read.parquet(str(tmp_path / "eadv"))
    plan = plan_of(spark, stored, "a => eadv.lab_bld_egfr.val.count(); b => eadv.[lab_bld_haemoglobin, labX%].val.sum();")._jdf.queryExecution().executedPlan().toString()
    assert "Or(In(att, [lab_bld_egfr,lab_bld_haemoglobin]),StringStartsWith(att,labX))" in plan and "ReadSchema: struct<eid:bigint>" in plan
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    dependent = plan_of(spark, stored, "m => eadv.lab_bld_egfr.val.avg(); n => eadv.lab_bld_egfr.val.count().where(val > m);")
    assert dependent._jdf.queryExecution().executedPlan().toString().count("EqualTo(att,lab_bld_egfr)") == 2


def test_plans_grow_with_the_length_of_a_program(spark, eadv, tmp_path):
    eadv.write.parquet(str(tmp_path / "eadv"))
    stored = spark.read.parquet(str(tmp_path / "eadv"))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    levels = "v0 => eadv.lab_bld_egfr.val.avg();" + "".join(f"v{i} => eadv.lab_bld_egfr.val.{f}().where(val >= v{i - 1} - 50);" for i, f in enumerate(["min", "median", "nth", "max", "temporal_regularity", "sum"], 1))
    deep = plan_of(spark, stored, levels)
    assert scans(deep) == 8 and deep.count() == 4
    blocks = [RuleblockInput("b0", "x => eadv.lab_bld_egfr.val.count();"), RuleblockInput("b1", "x => rout_b0.x.val.bind();")]
    blocks += [RuleblockInput(f"b{i}", f"y => rout_b{i - 1}.x.val.bind(); z => rout_b{i - 2}.x.val.bind(); x : {{. => y + z}};") for i in range(2, 12)]
    result = Engine(spark, {"eadv": stored}).compile(blocks, OPTIONS)
    assert scans(result.dataframes["b11"]) < 6
    assert {r.eid: r.x for r in result.dataframes["b11"].collect()} == {1: 4 * 144, 2: 2 * 144, 3: None, 4: None}


def test_stages_of_their_own_against_the_fused_ones(spark):
    """Functions whose free form is spread over tasks give what their form inside an entity's partition gives."""
    rng = random.Random(11)
    start = datetime(2021, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.choice("ab"), rng.choice([None, start + timedelta(hours=rng.randrange(300))]), rng.choice([None, 1.0, 2.5, 2.5, 7.0, -3.0, 0.0])) for _ in range(900)]
    df = spark.createDataFrame(rows, "eid long, att string, dt timestamp_ntz, val double")
    fns = ["val.median", "val.distinct_count", "val.stats_mode", "att.distinct_count", "dt.stats_mode", "val.nth(3)", "att.nth(2)", "val.max_neg_delta_dv", "val.temporal_regularity"]
    call = lambda f: f if "(" in f else f + "()"
    text = "one : {. => 1};" + "".join(f"f{i} => eadv.[a, b].{call(f)}; d{i} => eadv.[a, b].{call(f)}.where(one = 1);" for i, f in enumerate(fns))
    for r in run(spark, df, text).values():
        d = r.asDict()
        for k, v in d.items():
            if k.startswith("f"):
                assert d["d" + k[1:]] == (pytest.approx(v) if isinstance(v, float) else v), k


@pytest.mark.parametrize("text", ["v : {sysdate > 5 => 1};", "v => eadv.a.dt.sum();", "d => eadv.a.dt.max(); v : {d in (1, 2) => 1};", "v : {" + "(" * 3000 + "1" + ")" * 3000 + " = 1 => 1};", "v : {date 'soon' < sysdate => 1};"])
def test_compile_reports_whatever_goes_wrong(spark, eadv, text):
    assert errors(spark, eadv, text).message


def test_a_failing_source_is_reported(spark):
    class Broken:
        @property
        def schema(self):
            raise OSError("no such file")

    r = Engine(spark, {"eadv": Broken()}).compile([RuleblockInput("m", "v => eadv.a.val.last();")])
    assert not r.success and "no such file" in r.errors[0].message


def test_written_results_keep_the_options_of_the_compile(spark, eadv, tmp_path):
    engine = Engine(spark, {"eadv": eadv})
    r = engine.compile([RuleblockInput("m", "n => eadv.lab_bld_egfr.val.count().where(dt > sysdate - 30); d : {. => sysdate};")], Options(static_sysdate="2020-02-01"))
    got = spark.read.parquet(engine.write(r, str(tmp_path))["m"]).where("eid = 1").first()
    assert (got.n, got.d) == (3, date(2020, 2, 1))
