"""The 26 fetch functions as SQL.

Most are one aggregate expression over the rows of an entity, guarded by the fetch's own filter, so any number of them share
one ``GROUP BY``. Order among rows goes into the key of a ``min_by`` instead of a window: times become whole numbers that can
be negated, so newest-first order with ascending tie keys (name, then value; NULL last) is still one minimum, combined
map-side. The others would hold an entity's rows in one task, so the planner gives them stages of their own: ``COUNTED``
functions work on counts per (entity, value), ``RANKED`` ones on a window that keeps the first rows of each task only, and
``DAILY`` ones on days.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..expr import Typed

#: Functions with two outputs, ``<variable>_val`` and ``<variable>_dt``.
PAIRS = frozenset({"lastdv", "firstdv", "maxldv", "minldv", "minfdv", "max_neg_delta_dv"})
COUNTED = frozenset({"median", "distinct_count", "stats_mode"})
RANKED = frozenset({"nth"})
DAILY = frozenset({"max_neg_delta_dv", "temporal_regularity"})
#: Functions of numbers; a date is none.
NUMERIC = frozenset({"sum", "avg", "median", "maxldv", "minldv", "minfdv", "max_neg_delta_dv", "regr_slope", "regr_intercept", "regr_r2"})
#: Functions that join values in order of time; the planner writes them, as their order is part of the aggregate.
SERIAL = frozenset({"serialize", "serialize2", "serializedv", "serializedv2"})
#: Functions of which no row gives NULL, while the aggregate would give a number.
NULL_IF_NONE = frozenset({"count", "distinct_count", "exists"})

#: A time as microseconds of its calendar reading, whatever the session's zone.
MICROS = (
    "unix_date(to_date({dt})) * 86400000000L + CAST(hour({dt}) * 3600 + minute({dt}) * 60 AS bigint) * 1000000L + CAST(date_part('SECOND', {dt}) * 1000000 AS bigint)"
)
NEWEST = "struct(__us IS NULL, - __us, __att, __val IS NULL, __val)"
OLDEST = "struct(__us IS NULL, __us, __att, __val IS NULL, __val)"
#: The same orders as sort keys.
NEWEST_FIRST = "__us DESC NULLS LAST, __att, __val NULLS LAST"
OLDEST_FIRST = "__us NULLS LAST, __att, __val NULLS LAST"
_DAY = "CAST(floor(__us / 86400000000) AS double)"


@dataclass(frozen=True)
class Rows:
    """What a fetch sees: its filter, its property as read and as a number."""

    hit: str
    prop: Typed
    number: str

    def when(self, x: str) -> str:
        return f"CASE WHEN {self.hit} THEN {x} END"


def by_number(r: Rows, largest: bool, newest_first: bool) -> str:
    """NaN is the largest number, as in ``max``; a minus sign does not turn it round, so it has a key of its own."""
    number = f"NOT isnan({r.number}), - {r.number}" if largest else r.number
    return f"struct({r.number} IS NULL, {number}, __us IS NULL, {'- ' if newest_first else ''}__us, __att, __val IS NULL, __val)"


def _first(key: Callable[[Rows], str]) -> Callable[[Rows], str]:
    return lambda r: f"min_by({r.prop.sql}, {r.when(key(r))})"


def _numeric(f: str) -> Callable[[Rows], str]:
    return lambda r: f"{f}({r.when(r.number)})"


def _extreme(f: str) -> Callable[[Rows], str]:
    return lambda r: f"{f}({r.when(r.prop.sql if r.prop.type == 'date' else r.number)})"


def _finite(x: str) -> str:
    """A fit over a number that is not finite, or that overflows, is none."""
    return f"CASE WHEN abs({x}) < double('Infinity') THEN {x} END"


def _regression(f: str) -> Callable[[Rows], str]:
    return lambda r: _finite(f"{f}({r.when(r.number)}, {r.when(_DAY)})")


def _intercept(r: Rows) -> str:
    """The fit is over days since the first matching row; a shift of x moves the intercept by slope times the shift."""
    y, x, near = r.when(r.number), r.when(f"{_DAY} - 18000D"), f"min({r.when(_DAY)}) - 18000D"
    return _finite(f"(regr_intercept({y}, {x}) + regr_slope({y}, {x}) * ({near}))")


#: name -> aggregate over the rows; the dv functions give a struct of value and time.
AGGREGATES: dict[str, Callable[[Rows], str]] = {
    "last": _first(lambda r: NEWEST), "first": _first(lambda r: OLDEST), "lastdv": _first(lambda r: NEWEST), "firstdv": _first(lambda r: OLDEST),
    "maxldv": _first(lambda r: by_number(r, True, True)), "minldv": _first(lambda r: by_number(r, False, True)), "minfdv": _first(lambda r: by_number(r, False, False)),
    "count": lambda r: f"count({r.when(r.prop.sql)})", "exists": lambda r: "1",
    "sum": _numeric("sum"), "avg": _numeric("avg"), "median": _numeric("median"), "min": _extreme("min"), "max": _extreme("max"),
    "distinct_count": lambda r: f"CAST(size(collect_set({r.when(r.prop.sql)})) AS bigint)", "stats_mode": lambda r: f"mode({r.when(r.prop.sql)}, true)",
    "regr_slope": _regression("regr_slope"), "regr_intercept": _intercept, "regr_r2": _regression("regr_r2"),
}
FUNCTIONS = frozenset(AGGREGATES) | SERIAL | RANKED | DAILY


def result_type(function: str, prop: str) -> str:
    """Type of a function's value, by the type of the property."""
    if function in SERIAL:
        return "text"
    if function in ("min", "max"):
        return "date" if prop == "date" else "num"
    if function in ("last", "first", "nth", "lastdv", "firstdv", "maxldv", "minldv", "minfdv", "stats_mode"):
        return prop
    return "num"
