"""Problem 5: implausible readings per source (entity and canonical name), judged by that source's own behaviour.

* Impossible: outside the catalogued physical limits of the name.
* Spike: one or two readings far off the level before and after them. The level is the median of up to three readings on
  either side, so a drift or a new level that stays is none. Near an end of a source, where one side has fewer than ``SIDE``
  readings, that side's level is the middle one of its reading, the other side's level and the source's median, or the source's
  median if it has none. "Far" is relative to the interquartile range of the source's
  residuals, taken from quantile sketches that are merged across partitions by hour context, with the whole source as
  fallback where a context holds too few readings. A reading less far off is a spike, too, if it rises and falls again (or
  falls and rises) at a rate that is implausible for the source: ``RATE`` times the upper quartile of its rates of change.
* Stuck: ``RUN`` or more readings in a row, at different times, of one number, in a source that normally varies (how often a
  reading repeats the one before is counted per source and per name, stuck stretches left aside).

Sources of more than ``heavy`` rows are cut along time into chunks of about that size, so no task holds a whole hot source.
Each chunk has a halo of the readings at the ``HALO`` instants before and after it that hold a usable one, however many other
rows lie between and however far away they are; a verdict looks at ``RUN`` readings on either side at most, so it is the same
as without the cut. The limit grows with the table, which bounds the list of such sources; only that list is broadcast.

Defined cases: rows with NULL ``eid`` or ``dt`` are only held against the limits; a ``val`` that states no number is no reading;
resent copies (same source, time and number) count once and share the verdict; NaN or NULL limits are unknown; sources of
fewer than ``least`` delivered rows with a time, copies aside, have no spikes or stretches (rows that are NULL, unreadable or
impossible are delivered too, though only the others make the sketches); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import let, number
from ..session import materialize, small, spread
from ..sources.tables import catalogued

#: Readings of one number in a row that make a stuck stretch.
RUN = 6
#: Delivered rows, copies aside, that a source needs to be judged.
LEAST = 20
#: Interquartile ranges of the residual beyond which a reading is a spike, if it is also SHARE of the level away from it ...
FENCE = 3.5
SHARE = 0.21
#: ... or a spike anyhow; the range counts as RESOLUTION of the level at least.
FAR = 5.0
RESOLUTION = 0.04
#: Readings that a level needs of its own; with fewer on both sides (a source of three readable readings at most) there is no verdict.
SIDE = 2
#: Share of repeated numbers from which a source or a name is taken for a setting, which stays put.
SETTING = 0.5
#: Hours per context.
CONTEXT = 6
#: Readings a context needs for a sketch of its own.
CONTEXT_LEAST = 40
#: At most so many sources are cut into chunks: a proven bound of the broadcast list (about 8 MB).
HEAVY_SOURCES = 200_000
#: Buckets of time that a chunk has on average, and parts of a bucket that is split again.
PARTS = 64
#: Instants with a usable reading on either side of a chunk that it sees besides its own, at least.
HALO = 200
#: Rows above which a source is cut.
HEAVY = 10_000
#: Interquartile ranges of the residual, and upper quartiles of the rate of change, from which both together make a spike.
NEAR = 2.5
RATE = 10.0


def limits(catalog: DataFrame) -> DataFrame:
    return catalog.select("*", *(F.when(~F.isnan(c), F.col(c)).alias(n) for c, n in (("phys_low", "lo"), ("phys_high", "hi"))))


def readings(eadv: DataFrame, catalog: DataFrame) -> DataFrame:
    """``rid, eid, att_id, dt, num, text, lo, hi`` of every row with a catalogued measurement; ``num`` is NULL if it states no number.

    ``text`` tells values without a number apart and is NULL for numbers. Rows without a number are kept, as they count as delivered.
    """
    rows = catalogued(spread(eadv.select("rid", "eid", "att", "dt", "val")), limits(catalog), ["rid", "eid", "att", "dt", "val"], ("NUMERIC",), extra=("lo", "hi")).where("unit is not null")
    rows = rows.select("rid", "eid", "att_id", "dt", number(F.col("val"), F.col("unit")).alias("num"), F.xxhash64("val").alias("text"), "lo", "hi")
    return rows.withColumn("text", F.when(F.col("num").isNull(), F.col("text")))


def _chunks(eadv: DataFrame, catalog: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame] | None:
    """How sources of more than ``limit`` rows are cut; None if there are none.

    First ``eid, att_id, t0, width`` of each such source: at most ``HEAVY_SOURCES`` rows, as the limit grows with the table.
    Then ``eid, att_id, bucket, places``: the chunks, with their times and those of their halo, that a bucket of ``width`` meets.

    A source's time is split into buckets, those of more than ``limit`` rows (bursts) again until they hold fewer or are one
    instant. Buckets in order make chunks of about ``limit`` rows, twice that at most but for one instant, which is never split.
    The halo of a chunk reaches over at least ``HALO`` usable instants on either side, however far away in time and over however many chunks.
    """
    rows = catalogued(eadv, limits(catalog), ["eid", "att", "dt", "val"], ("NUMERIC",), extra=("lo", "hi")).where("unit is not null and eid is not null and dt is not null")
    rows = rows.select("eid", "att_id", _micros().alias("us"), "val", "unit", "lo", "hi")
    limit = max(heavy, eadv.count() // HEAVY_SOURCES + 1)
    large = rows.groupBy("eid", "att_id").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("t0"), F.max("us").alias("t1")).where(F.col("n") > limit)
    large = materialize(large.select("eid", "att_id", "t0", "t1", _width(F.col("t1") - F.col("t0") + 1, limit).alias("width")), "heavy")
    if large.isEmpty():
        return None
    leaves = _leaves(rows, large.select("eid", "att_id", F.col("t0").alias("at"), (F.col("t1") + 1).alias("end"), "width"))
    while not (over := leaves.where((F.col("n") > limit) & (F.col("end") - F.col("at") > 1))).isEmpty():
        again = over.select("eid", "att_id", "at", "end", _width(F.col("end") - F.col("at"), limit).alias("width"))
        leaves = materialize(leaves.join(over, ["eid", "att_id", "at"], "left_anti").unionByName(_leaves(rows, again)), "leaves")
    source = Window.partitionBy("eid", "att_id")
    so_far = lambda c: F.sum(c).over(source.orderBy("at")) - F.col(c)
    before = leaves.withColumns({"k": so_far("n"), "seen": so_far("usable")}).withColumn("back", -F.col("seen"))
    far = before.withColumn("lo", F.max("at").over(source.orderBy("seen").rangeBetween(Window.unboundedPreceding, -HALO)))
    far = far.withColumn("hi", F.min("at").over(source.orderBy("back").rangeBetween(Window.unboundedPreceding, -HALO)))
    chunks = far.groupBy("eid", "att_id", F.floor(F.col("k") / limit).alias("part")).agg(F.min("at").alias("start"), F.min_by("lo", "at").alias("lo"), F.min_by("hi", "at").alias("hi"))
    parts = source.orderBy("part")
    chunks = chunks.withColumns({"chunk": F.row_number().over(parts), "stop": F.lead("start").over(parts), "hi": F.lead("hi").over(parts)}).join(F.broadcast(large), ["eid", "att_id"])
    end = F.col("t1") + 1
    chunks = chunks.select("eid", "att_id", "t0", "width", "chunk", "start", F.coalesce("stop", end).alias("stop"), F.coalesce("lo", "t0").alias("lo"), F.coalesce("hi", end).alias("hi"))
    met = chunks.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("lo")), _bucket(F.col("hi") - 1))))
    places = met.groupBy("eid", "att_id", "bucket").agg(F.collect_list(F.struct("chunk", "lo", "start", "stop", "hi")).alias("places"))
    return large.select("eid", "att_id", "t0", "width"), materialize(places, "chunks")


def _width(time: Column, limit: int) -> Column:
    """Width of the parts of a bucket of ``n`` rows."""
    return F.ceil(time / (F.ceil(F.col("n") / limit) * PARTS))


def _leaves(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``eid, att_id, at, end, n, usable`` of the parts of buckets that hold rows, each of ``width`` and inside its bucket; ``usable`` counts instants."""
    j = rows.join(F.broadcast(buckets), ["eid", "att_id"]).where("us >= at and us < end")
    num = number(F.col("val"), F.col("unit"))
    j = j.select("eid", "att_id", F.expr("at + ((us - at) div width) * width").alias("at"), "width", "end", "us", num.alias("num"), "lo", "hi")
    instants = F.count_distinct(F.when(F.col("num").isNotNull() & ~_bad(), F.col("us"))).alias("usable")
    leaves = j.groupBy("eid", "att_id", "at", "width", "end").agg(F.count(F.lit(1)).alias("n"), instants)
    return materialize(leaves.select("eid", "att_id", "at", F.least("end", F.col("at") + F.col("width")).alias("end"), "n", "usable"), "leaves")


def _bad() -> Column:
    """Outside the limits of its name."""
    return F.coalesce(F.col("num") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("num") > F.col("hi"), F.lit(False))


def _micros() -> Column:
    return F.unix_micros(F.col("dt").cast("timestamp"))


def _bucket(us: Column) -> Column:
    return F.call_function("div", us - F.col("t0"), F.col("width"))


def _place(chunk: Column, halo: Column) -> Column:
    return F.struct(chunk.alias("chunk"), halo.alias("halo"))


def _chunked(rows: DataFrame, cut: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """Add ``chunk`` and ``halo``; readings near an edge come once more as halo of the neighbouring chunk.

    Rows of no source or time are spread over chunks of their own.
    """
    lone = F.when(F.col("eid").isNull() | F.col("dt").isNull(), -1 - F.pmod(F.hash("rid"), F.lit(1000))).otherwise(F.lit(0))
    if cut is None:
        return rows.withColumn("chunk", lone).withColumn("halo", F.lit(False))
    large, chunks = cut
    j = rows.withColumn("us", _micros()).join(F.broadcast(large), ["eid", "att_id"], "left").withColumn("bucket", _bucket(F.col("us")))
    j = j.join(small(chunks), ["eid", "att_id", "bucket"], "left")
    inside = F.filter("places", lambda x: (x["lo"] <= F.col("us")) & (F.col("us") < x["hi"]))
    own = F.transform(inside, lambda x: _place(x["chunk"], (F.col("us") < x["start"]) | (F.col("us") >= x["stop"])))
    placed = j.select(*rows.columns, F.inline(F.coalesce(own, F.array(_place(lone, F.lit(False))))))
    return placed.where(~F.col("halo") | (F.col("num").isNotNull() & ~_bad()))


def _median(values: list[Column]) -> Column:
    middle = lambda a: F.when(F.size(a) > 0, (F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2)
    return let(F.sort_array(F.array_compact(F.array(*values))), middle)


_ORDER = "PARTITION BY eid, att_id, chunk ORDER BY dt, num, text, rid"


def observed(rows: DataFrame) -> DataFrame:
    """Per reading: level before and after, residual, how far off both levels it is, and the run of its number.

    One shuffle by (source, chunk), one sort. Copies of a reading, impossible readings, and one of two readings at the same
    time that breaks a repetition which the other continues, are no neighbours of others.
    """
    by = ["eid", "att_id", "chunk"]
    w = Window.partitionBy(*by).orderBy("dt", "num", "text", "rid")
    again = F.coalesce((F.lag("dt").over(w) == F.col("dt")) & F.lag("num").over(w).eqNullSafe(F.col("num")) & F.lag("text").over(w).eqNullSafe(F.col("text")), F.lit(False))
    rows = rows.withColumn("first", ~again)
    rows = rows.withColumn("bad", _bad()).withColumn("s", F.when(F.col("first") & ~F.col("bad") & F.col("num").isNotNull(), F.struct("dt", "num")))
    rows = rows.withColumns({n: F.expr(f"{f}(s, {k}) IGNORE NULLS OVER ({_ORDER})") for n, f, k in (("p1", "lag", 1), ("p2", "lag", 2), ("q1", "lead", 1), ("q2", "lead", 2))})
    rows = rows.withColumn("v", F.when(F.col("s").isNotNull() & ~_contradicted(), F.col("num"))).drop("s", "p1", "p2", "q1", "q2")
    near = {n: F.expr(f"{f}(CASE WHEN v IS NOT NULL THEN unix_micros(CAST(dt AS timestamp)) END) IGNORE NULLS OVER ({_ORDER})") for n, f in (("ta", "lag"), ("tb", "lead"))}
    for k in range(1, RUN):
        near[f"a{k}"] = F.expr(f"lag(v, {k}) IGNORE NULLS OVER ({_ORDER})")
        near[f"b{k}"] = F.expr(f"lead(v, {k}) IGNORE NULLS OVER ({_ORDER})")
    rows = rows.withColumns(near).where("not halo")
    c = F.col
    same = {s: sum((F.when(F.coalesce(_all_equal(s, k), F.lit(False)), 1).otherwise(0) for k in range(1, RUN)), F.lit(0)) for s in "ab"}
    rows = rows.withColumns({
        "before": _median([c(f"a{k}") for k in (1, 2, 3)]), "after": _median([c(f"b{k}") for k in (1, 2, 3)]),
        "level": _median([c(f"{s}{k}") for s in "ab" for k in (1, 2, 3)]), "run": F.lit(1) + same["a"] + same["b"],
    })
    up, down = c("num") - F.greatest("before", "after"), F.least("before", "after") - c("num")
    hours = lambda t: F.greatest(t / 3.6e9, F.lit(1 / 3600))
    come, go = (c("num") - c("a1")) / hours(_micros() - c("ta")), (c("b1") - c("num")) / hours(c("tb") - _micros())
    known = {s: c(f"{s}{SIDE}").isNotNull() for s in "ab"}
    enough = known["a"] & known["b"]
    # near an end: the full side's level, the short side's reading, and whether the next reading of the full side is no part of the same excursion
    ends = {
        "one": F.when(known["a"] & ~known["b"], c("before")).when(known["b"] & ~known["a"], c("after")),
        "few": F.when(known["a"] & ~known["b"], c("b1")).when(known["b"] & ~known["a"], c("a1")),
        "next": F.when(known["a"] & ~known["b"], c("a1")).when(known["b"] & ~known["a"], c("b1")),
    }
    return rows.select(
        "rid", "eid", "att_id", "dt", "num", "first", "bad", "run", (c("num") - c("level")).alias("residual"), c("level"),
        F.when(enough & ~c("bad"), F.greatest(up, down, F.lit(0.0))).alias("off"), (c("a1") == c("num")).alias("repeats"),
        F.abs(come).alias("rate"), F.when(come * go < 0, F.least(F.abs(come), F.abs(go))).alias("swing"), F.floor(F.hour("dt") / CONTEXT).alias("context"), *(v.alias(k) for k, v in ends.items()),
    )


def _off_at_end() -> Column:
    """How far a reading near an end of its source is off the full side's level and what stands for the short side's.

    The short side's one reading may be the second one of a spike, so it is checked against the other side and the source's
    median; not if the full side's next reading is of the same excursion, which then is longer than a spike: a new level.
    """
    c = F.col
    longer = F.abs(c("num") - c("next")) < F.abs(c("next") - c("one"))
    short = F.when(c("few").isNull(), c("middle")).when(longer, c("few")).otherwise(_median([c("few"), c("one"), c("middle")]))
    return F.greatest(c("num") - F.greatest("one", short), F.least("one", short) - c("num"), F.lit(0.0))


def _contradicted() -> Column:
    """A reading that shares its time with another one, where the other one and not this one repeats a neighbour in time."""
    c = F.col
    other_next, other_before = c("q1.dt") == c("dt"), c("p1.dt") == c("dt")
    mine = lambda x, p, q: F.coalesce(x == p, F.lit(False)) | F.coalesce(x == q, F.lit(False))
    a = other_next & ~mine(c("num"), c("p1.num"), c("q2.num")) & mine(c("q1.num"), c("p1.num"), c("q2.num"))
    b = other_before & ~mine(c("num"), c("p2.num"), c("q1.num")) & mine(c("p1.num"), c("p2.num"), c("q1.num"))
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def _all_equal(side: str, k: int) -> Column:
    out = F.col(f"{side}1") == F.col("num")
    for i in range(2, k + 1):
        out = out & (F.col(f"{side}{i}") == F.col("num"))
    return out


def _sketches(seen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Residual quantiles by source and hour context, by source, and how often names repeat a number."""
    delivered = seen.where("first and eid is not null and dt is not null")
    delivered = delivered.select("eid", "att_id", "context", *(F.when(F.col("num").isNotNull() & ~F.col("bad"), F.col(k)).alias(k) for k in ("num", "residual", "run", "repeats", "rate")))
    seen = delivered.where("run is not null")
    quartiles = F.percentile_approx("residual", [0.25, 0.75], 200)
    free = F.when(F.col("run") < RUN, F.col("repeats").cast("int"))
    by_context = seen.groupBy("eid", "att_id", "context").agg(quartiles.alias("cq"), F.count("residual").alias("cn"))
    by_source = delivered.groupBy("eid", "att_id").agg(quartiles.alias("sq"), F.percentile_approx("num", 0.5, 200).alias("middle"), F.percentile_approx("rate", 0.75, 200).alias("rates"), F.count(F.lit(1)).alias("n"), F.avg(free).alias("source_repeats"))
    by_name = seen.groupBy("att_id").agg(F.avg(F.col("repeats").cast("int")).alias("name_repeats"))
    return by_context, by_source, by_name


def judged(eadv: DataFrame, catalog: DataFrame, least: int = LEAST, heavy: int = HEAVY) -> DataFrame:
    """``rid, kind`` of every implausible reading; ``kind`` is impossible, spike or stuck."""
    seen = materialize(observed(_chunked(readings(eadv, catalog), _chunks(eadv, catalog, heavy))), "readings")
    by_context, by_source, by_name = _sketches(seen)
    iqr = lambda q: F.get(q, F.lit(1)) - F.get(q, F.lit(0))
    c = F.col
    suspects = seen.where(f"first and not bad and num is not null and (run >= {RUN} or off > 0 or one is not null)").drop("repeats", "rate")
    j = suspects.join(by_source.where(c("n") >= least), ["eid", "att_id"]).join(by_context, ["eid", "att_id", "context"], "left").join(F.broadcast(by_name), "att_id")
    j = j.where((F.coalesce("source_repeats", F.lit(1.0)) < SETTING) & (F.coalesce("name_repeats", F.lit(1.0)) < SETTING))
    j = j.withColumn("off", F.when(c("one").isNotNull(), _off_at_end()).otherwise(c("off")))
    spread = F.when(c("cn") >= CONTEXT_LEAST, F.greatest(iqr("cq"), iqr("sq") / 2)).otherwise(iqr("sq"))
    level = F.abs("level")
    spike = ((c("off") > FENCE * spread) & (c("off") > SHARE * level)) | (c("off") > FAR * F.greatest(spread, RESOLUTION * level))
    sudden = (c("off") > NEAR * F.greatest(spread, RESOLUTION * level)) & (c("off") > SHARE * level) & (c("swing") > RATE * c("rates"))
    kind = F.when(c("run") >= RUN, "stuck").when(spike | F.coalesce(sudden, F.lit(False)), "spike")
    found = j.select("rid", "eid", "att_id", "dt", "num", kind.alias("kind")).where("kind is not null")
    copies = seen.where("not first and not bad").select(c("rid").alias("copy"), "eid", "att_id", "dt", "num")
    copied = found.join(copies, ["eid", "att_id", "dt", "num"]).select(c("copy").alias("rid"), "kind")
    return seen.where("bad").select("rid", F.lit("impossible").alias("kind")).unionAll(found.select("rid", "kind")).unionAll(copied)
