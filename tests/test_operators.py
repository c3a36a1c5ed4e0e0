from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import CATALOG, EADV
from ruleframe.operators import eager, eav_wide, features, spikes
from ruleframe.sources.tables import attributes

T0 = datetime(2023, 1, 1)


def eadv(spark, rows, extra=False):
    """Rows ``(eid, att, dt, val)``; rids count from 1."""
    df = spark.createDataFrame([(i + 1, e, a, d, v, None, d) for i, (e, a, d, v) in enumerate(rows)], EADV)
    return df.withColumns({c: F.lit("x") for c in ("kind", "num", "data_type", "att_id", "chunk", "n", "day")}) if extra else df


DIRTY = [
    (1, "lab_k", T0, "4.5"), (1, " LAB_K ", T0 + timedelta(days=2), "4,7 mmol/L"), (1, "lab_k", T0 + timedelta(days=3), "<5"), (1, "dx_a", T0, "Yes"), (1, "dmg_d", T0, "31.12.1999"),
    (1, "note", T0, "some text"), (2, "dx_a", T0, "2"), (2, "lab_k", T0, None), (2, "lab_k", T0, "  "), (2, "dmg_d", None, "2001-02-03"), (3, "unlisted", T0, "1"), (None, "lab_k", T0, "9"),
    (None, "lab_k", T0, "nan"), (4, None, T0, "1"), (5, "enc_n", T0, "1"), (5, "enc_n", T0, "2"), (5, "enc_n", None, "3"),
]


@pytest.mark.parametrize("block", [1, 3, 128])
def test_wide_rows_and_rejects(spark, catalog, block):
    df = eadv(spark, DIRTY, extra=True)
    wide = {r.eid: r for r in eav_wide.wide(df, catalog, block=block).collect()}
    assert set(wide) == {1, 2, 5}
    r = wide[1]
    assert (r.lab_k, r.dx_a, r.dmg_d, r.note, r.enc_n) == (4.7, True, date(1999, 12, 31), "some text", None)
    assert (wide[2].dmg_d, wide[2].lab_k, wide[5].enc_n) == (date(2001, 2, 3), None, 2.0)  # the higher rid at equal times
    assert dict(eav_wide.wide(df, catalog).dtypes)["dx_a"] == "boolean"
    assert sorted(x.rid for x in eav_wide.rejects(df, catalog, block=block).collect()) == [3, 7, 13]


def test_wide_before_a_day_and_no_table_left_behind(spark, catalog):
    rows = [(1, "lab_k", T0, "1"), (1, "lab_k", datetime(2070, 1, 1), "2"), (1, "lab_k", datetime(2070, 1, 1), "bad"), (2, "lab_k", datetime(2070, 1, 1), "3"), (3, "lab_k", None, "4")]
    assert {r.eid: r.lab_k for r in eav_wide.wide(eadv(spark, rows), catalog).collect()} == {1: 2.0, 2: 3.0, 3: 4.0}
    w = eav_wide.wide(eadv(spark, rows), catalog, as_of=date(2024, 1, 1))
    assert {r.eid: r.lab_k for r in w.collect()} == {1: 1.0, 3: 4.0}
    assert [r.rid for r in eav_wide.rejects(eadv(spark, rows), catalog, as_of=date(2024, 1, 1)).collect()] == [3]
    assert {r.att: (r.cells, r.total) for r in eav_wide.filled(w, catalog).collect()}["lab_k"] == (2, 5.0)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ruleframe_cells")]


def test_wide_of_nothing_and_of_clashing_names(spark):
    names = spark.createDataFrame([("eid", "NUMERIC", None, None, None, None), ("a`b", "TEXT", None, None, None, None), (None, "TEXT", None, None, None, None), ("A`B", "NUMERIC", None, None, None, None)], CATALOG)
    assert [a.att for a in attributes(names)] == ["a`b", "eid"]
    assert eav_wide.wide(eadv(spark, []), names).columns == ["eid", "a`b", "att_eid"]
    got = eav_wide.wide(eadv(spark, [(1, "eid", T0, "7")]), names).collect()
    assert [(r.eid, r.att_eid) for r in got] == [(1, 7.0)]


def test_wide_against_brute_force_with_a_hot_entity(spark, catalog):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(50), rng.choice(["lab_k", "enc_n", "lab_free"]), T0 + timedelta(hours=rng.randrange(500)), rng.choice(["1.5", "2", "y1", "", None, "7 H"])) for _ in range(4000)]
    want, bad = {}, []
    for rid, (e, a, d, v) in enumerate(rows, 1):
        if v in ("y1",):
            bad.append(rid)
        elif v:
            x = float(v.split()[0])
            want[e, a] = max(want.get((e, a), (d, 0, 0)), (d, rid, x))
    got = {r.eid: r for r in eav_wide.wide(eadv(spark, rows), catalog, block=2).collect()}
    assert {(e, a): got[e][a] for e, a in want} == {k: v[2] for k, v in want.items()}
    assert sorted(r.rid for r in eav_wide.rejects(eadv(spark, rows), catalog, block=2).collect()) == bad


def stored(spark, catalog, rows, **options):
    return features.store(eadv(spark, rows, **options), catalog)


def test_one_stored_table_answers_any_day(spark, catalog, tmp_path):
    rows = [(1, "lab_k", T0 + timedelta(days=d), str(d)) for d in (0, 3, 3, 10)]
    table = features.store(eadv(spark, rows), catalog, str(tmp_path / "cumulative"))
    ask = lambda day, *w: features.features_long(table, catalog, day, w).first()
    assert (ask(date(2023, 1, 4)).n, ask(date(2023, 1, 5)).n, ask(date(2024, 1, 1), 360).n_360d) == (1, 2, 1)
    assert spark.read.parquet(str(tmp_path / "cumulative")).count() == 3


def test_features(spark, catalog):
    at = date(2024, 1, 1)
    d = lambda n: datetime(2024, 1, 1) - timedelta(days=n)
    rows = [
        (1, "lab_k", d(40), "2"), (1, " Lab_K", d(40), "2"), (1, "lab_k", d(40), "3"), (1, "lab_k", d(3), "4,5"), (1, "lab_k", d(-5), "100"), (1, "dx_a", d(10), "true"),
        (2, "lab_k", d(-1), "1"), (3, "unlisted", d(5), "1"), (4, "lab_k", None, "1"), (None, "lab_k", d(5), "1"), (5, "lab_k", d(5), None), (5, "lab_k", d(5), None), (5, "note", d(1), "x"),
    ]
    got = {r.eid: r.asDict() for r in features.features(stored(spark, catalog, rows, extra=True), catalog, at, (30,)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    one = got[1]
    assert [one[f"lab_k__{c}"] for c in ("n", "days_since", "total", "n_30d", "total_30d")] == [3, 3, 9.5, 1, 4.5]
    assert (one["dx_a__n"], one["dx_a__days_since"], one["note__n"]) == (1, 10, 0) and "dx_a__total" not in one
    for e in (2, 3, 4):
        assert (got[e]["lab_k__n"], got[e]["lab_k__days_since"], got[e]["lab_k__total"]) == (0, None, None)
    assert (got[5]["lab_k__n"], got[5]["lab_k__total"], got[5]["note__days_since"]) == (1, None, 1)
    long = features.features_long(stored(spark, catalog, rows), catalog, at, (30,)).collect()
    assert {(r.eid, r.att) for r in long} == {(1, "lab_k"), (1, "dx_a"), (5, "lab_k"), (5, "note")}
    assert features.features(stored(spark, catalog, []), catalog, at).count() == 0


def test_features_against_brute_force(spark, catalog):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.choice(["lab_k", "enc_n"]), T0 + timedelta(hours=rng.randrange(9000)), str(rng.randrange(5))) for _ in range(800)]
    rows += rng.sample(rows, 200)
    at = date(2023, 10, 1)
    for r in features.features_long(stored(spark, catalog, rows), catalog, at, (60,)).collect():
        mine = {x for x in rows if x[:2] == (r.eid, r.att) and x[2].date() < at}
        late = [x for x in mine if x[2].date() >= at - timedelta(days=60)]
        assert (r.n, r.total, r.n_60d, r.total_60d) == (len(mine), sum(int(x[3]) for x in mine), len(late), sum(int(x[3]) for x in late))
        assert r.days_since == (at - max(x[2] for x in mine).date()).days


def source(eid, att, numbers, rng=None, hours=7):
    return [(eid, att, T0 + timedelta(hours=hours * i), f"{x:g}") for i, x in enumerate(numbers)]


def verdicts(spark, catalog, rows, **options):
    return {r.rid: r.kind for r in spikes.judged(eadv(spark, rows, extra=True), catalog, **options).collect()}


def noisy(rng, n, level=100.0, noise=4.0):
    return [round(level + rng.gauss(0, noise), 1) for _ in range(n)]


def test_spikes_stuck_and_impossible(spark, catalog):
    rng = random.Random(5)
    a = noisy(rng, 60)
    a[20], a[40], a[41] = 210.0, 30.0, 33.0  # one reading, two readings
    shift = noisy(rng, 30) + noisy(rng, 30, 160.0)  # a new level that stays
    drift = [round(100 + 2 * i + rng.gauss(0, 2), 1) for i in range(60)]
    stuck = noisy(rng, 40)
    stuck[10:16] = [101.0] * 6
    stuck[30:35] = [99.0] * 5  # too short
    setting = [5.0] * 12 + [7.0] * 15 + [5.0] * 10
    k = [round(4 + rng.gauss(0, 0.2), 2) for _ in range(30)]
    k[5] = 45.0  # above the limit
    few = noisy(rng, 19)
    few[9] = 500.0
    rows = [r for eid, att, xs in ((1, "lab_free", a), (2, "lab_free", shift), (3, "lab_free", drift), (4, "lab_free", stuck), (5, "set_x", setting), (6, "lab_k", k), (7, "lab_free", few), (8, "lab_k", [50.0, 4.0])) for r in source(eid, att, xs)]
    at = lambda eid, i: next(n for n, r in enumerate(rows, 1) if r[0] == eid) + i
    want = {at(1, i): "spike" for i in (20, 40, 41)} | {at(4, i): "stuck" for i in range(10, 16)} | {at(6, 5): "impossible", at(8, 0): "impossible"}
    assert verdicts(spark, catalog, rows) == want
    # resent copies share the verdict and make no stretch longer; rows of no source or time only meet the limits
    copies = [(1, " LAB_FREE", rows[at(1, 20) - 1][2], "210"), (4, "lab_free", rows[at(4, 30) - 1][2], "99"), (4, "lab_free", rows[at(4, 10) - 1][2], "101.0")]
    lone = [(None, "lab_k", T0, "99"), (None, "lab_k", T0, "4"), (6, "lab_k", None, "0.1"), (6, "lab_k", T0, "no number"), (6, "note", T0, "99"), (6, "enc_n", T0, "999")]
    n = len(rows)
    assert verdicts(spark, catalog, rows + copies + lone) == want | {n + 1: "spike", n + 3: "stuck", n + 4: "impossible", n + 6: "impossible"}
    # another reading at the same time neither breaks a stretch nor joins it
    contradiction = [(4, "lab_free", rows[at(4, 13) - 1][2], x) for x in ("103", "100")]
    for c in contradiction:
        assert verdicts(spark, catalog, [*rows, c]) == want
    assert verdicts(spark, catalog, []) == {}


def test_every_delivered_row_counts_for_the_least_number(spark, catalog):
    rng = random.Random(7)
    ks = [round(4 + rng.gauss(0, 0.2), 2) for _ in range(17)]
    ks[8] = 9.0
    rows = source(1, "lab_k", ks)
    late = lambda i: T0 + timedelta(days=30, hours=i)
    others = [(1, "lab_k", late(0), None), (1, "lab_k", late(0), "haemolysed"), (1, "lab_k", late(1), "99")]
    assert verdicts(spark, catalog, rows + others) == {9: "spike", 20: "impossible"}
    # copies, of texts too, and rows without a time do not count
    copies = [*others[:2], others[0], rows[0], (1, "lab_k", None, "4")]
    assert verdicts(spark, catalog, rows + others[:2] + copies) == {}
    assert verdicts(spark, catalog, rows + others + copies) == {9: "spike", 20: "impossible"}


def test_spikes_near_the_ends_of_a_source(spark, catalog):
    rng = random.Random(8)
    spiked = {1: (0,), 2: (1,), 3: (0, 1), 4: (38,), 5: (39,), 6: (38, 39), 7: (1, 2), 8: (37, 38), 9: (), 10: ()}
    rows, want = [], {}
    for eid, at in spiked.items():
        xs = noisy(rng, 40)
        for i in at:
            xs[i] = 210.0 + i % 2
        if eid == 9:  # new levels that stay
            xs[:3], xs[-3:] = [200.0, 203.0, 201.0], [40.0, 42.0, 41.0]
        if eid == 10:
            xs = [round(100 + 3 * i + rng.gauss(0, 2), 1) for i in range(40)]
        want |= {len(rows) + 1 + i: "spike" for i in at}
        rows += source(eid, "lab_free", xs)
    assert verdicts(spark, catalog, rows) == want
    unread = [(11, "lab_free", T0 + timedelta(hours=-1), "less than 90"), *source(11, "lab_free", [101.0, 30.0, *noisy(rng, 30)])]
    assert verdicts(spark, catalog, unread + [unread[2]]) == {3: "spike", len(unread) + 1: "spike"}
    assert verdicts(spark, catalog, source(12, "lab_free", [5.0, 90.0, 6.0]), least=3) == {}


def test_cutting_a_hot_source_changes_nothing(spark, catalog):
    rng = random.Random(6)
    xs = noisy(rng, 6000)
    for _ in range(60):
        xs[rng.randrange(10, 5990)] *= 2.2
    for i in range(300, 6000, 500):
        xs[i : i + 7] = [xs[i]] * 7
    rows = source(1, "lab_free", xs, hours=1) + source(2, "lab_free", noisy(rng, 50))
    whole = verdicts(spark, catalog, rows)
    assert len(whole) > 100 and verdicts(spark, catalog, rows, heavy=700) == whole


def test_cutting_a_bursty_source_changes_nothing(spark, catalog):
    rng = random.Random(9)
    times = sorted(rng.sample(range(3000), 500)) + [3000 + i / 3600 for i in range(4000)] + sorted(3002 + 20 * x for x in rng.sample(range(4000), 1500))
    xs = noisy(rng, len(times))
    for i in range(20, 5980, 60):
        xs[i] *= 2.2
    for i in (498, 4499, 4502, 4520):  # at the edges of the burst
        xs[i] = 230.0
    for i in (490, 2500, 4506, 4700):
        xs[i : i + 7] = [xs[i + 1]] * 7
    rows = [(1, "lab_free", T0 + timedelta(hours=h), f"{x:g}") for h, x in zip(times, xs)]
    whole = verdicts(spark, catalog, rows)
    assert len(whole) > 100 and verdicts(spark, catalog, rows, heavy=700) == whole
    seen = spikes._chunked(spikes.readings(eadv(spark, rows, extra=True), catalog), spikes._chunks(eadv(spark, rows, extra=True), catalog, 700))
    own = seen.where("not halo").groupBy("chunk").count().collect()
    assert sum(r["count"] for r in own) == len(rows) and len(own) > 5 and max(r["count"] for r in own) <= 1400
    # every row of a chunk has its HALO readings on either side there
    order = {rid: k for k, rid in enumerate(sorted(range(1, len(rows) + 1), key=lambda i: rows[i - 1][2]))}
    for r in seen.groupBy("chunk").agg(F.collect_list("rid").alias("all"), F.collect_list(F.when(~F.col("halo"), F.col("rid"))).alias("own")).collect():
        a, o = sorted(order[x] for x in r["all"]), sorted(order[x] for x in r["own"])
        assert a == list(range(a[0], a[-1] + 1)) and a[0] <= max(0, o[0] - spikes.HALO) and a[-1] >= min(len(rows) - 1, o[-1] + spikes.HALO)


def test_cutting_changes_nothing_between_junk_copies_and_future_rows(spark, catalog):
    rng = random.Random(12)
    rows = []
    for eid in range(1, 7):
        hour, mine = 0.0, []
        for i in range(700):
            hour += rng.choice([1 / 3600, 0.1, 1, 1, 24])
            x = f"{100 + rng.gauss(0, 4):.1f}"
            if i % 90 == 40:
                x = f"{rng.choice([230, 20]) + rng.random():.1f}"
                junk = [(hour + rng.uniform(-1, 1) / 7200, rng.choice([None, "haemolysed", "<5"])) for _ in range(rng.choice([0, 300]))]
                mine += junk
            if 300 <= i < 307:
                x = "101.5"
            mine.append((hour, x))
            if rng.random() < 0.1:
                mine.append((hour, rng.choice([x, "99.5", "9999"])))
        mine.append((9_000_000.0, "100"))
        rows += [(eid, "lab_free", T0 + timedelta(hours=h), x) for h, x in mine]
    whole = verdicts(spark, catalog, rows)
    assert len(whole) > 60 and set(whole.values()) == {"spike", "stuck"}
    for heavy in (50, 450):
        assert verdicts(spark, catalog, rows, heavy=heavy) == whole


def test_a_rate_of_change_out_of_the_ordinary(spark, catalog):
    rng = random.Random(14)
    xs = noisy(rng, 80, 60.0, 5.5)
    at = [T0 + timedelta(hours=i) for i in range(80)]
    for i in (40, 60):
        xs[i - 3 : i + 4] = [59.0, 60.0, 61.0, 78.0, 61.0, 60.0, 59.0]
    slow = [(1, "lab_free", t, f"{x:g}") for t, x in zip(at, xs)]
    assert verdicts(spark, catalog, slow) == {}
    at[39], at[41] = at[40] - timedelta(minutes=1), at[40] + timedelta(minutes=1)
    assert verdicts(spark, catalog, [(1, "lab_free", t, f"{x:g}") for t, x in zip(at, xs)]) == {41: "spike"}


def test_heavy_keys_and_totals(spark, catalog):
    rows = [(1, "lab_k", T0, "2")] * 30 + [(i, "enc_n", T0, "x") for i in range(2, 20)] + [(None, None, T0, "3"), (None, " ENC_N", T0, "4"), (50, "odd", T0, "5")]
    df = eadv(spark, rows, extra=True)
    assert {(r.field, r.key_value) for r in eager.heavy_keys(df, catalog).collect()} == {("eid", "1"), ("att", "lab_k"), ("att", "enc_n")}
    totals = {(r.field, r.key_value): (r.n, r.n_listed, r.total) for r in eager.key_totals(df, catalog).collect()}
    assert totals["eid", "1"] == (30, 30, 60.0) and totals["att", "enc_n"] == (19, 19, 4.0) and totals["att", "odd"] == (1, 0, 5.0) and totals["eid", None] == (2, 1, 7.0)
    assert eager.heavy_keys(df.limit(0), catalog).count() == 0


def test_joined_states_equal_the_join(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, None]), rng.choice("ab"), float(rng.randrange(9))) for _ in range(300)], "k long, g string, x double")
    right = spark.createDataFrame([(rng.choice([1, 1, 2, 4, None]), rng.choice("uv"), rng.choice([1.0, 2.0, None])) for _ in range(200)], "k long, h string, y double")
    for how in ("inner", "left"):
        direct = left.join(right, "k", how).groupBy("g", "h").agg(F.count("*").alias("n"), F.sum("x").alias("l_x"), F.sum("y").alias("r_y"))
        s = eager.joined_states(left, right, ["k"], ["g"], ["h"], ["x"], ["y"], how).groupBy("g", "h").agg(F.sum("n").alias("n"), F.sum("l_x").alias("l_x"), F.sum("r_y").alias("r_y"))
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, direct.collect()), key=key) == sorted(map(tuple, s.collect()), key=key)
