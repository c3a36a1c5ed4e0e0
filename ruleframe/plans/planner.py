"""A parsed ruleblock as one SQL statement: one row per entity, one column per variable.

All fetches of a table that need no variable share one scan, which reads the named attributes only, one shuffle by entity and
one aggregate. Fetches whose exact answer would hold an entity's rows in one task have stages of their own, hashed by
(entity, fetch, value) or (entity, fetch, day), so that a hot entity spreads. The entities are the distinct ``eid`` of
``eadv``; the stages are left joins onto them, all hashed by entity. A fetch whose predicate names variables is computed
together with all others that are possible at that point: the row so far meets the matching observations in one join and is
carried through the aggregate, so each level reads it once and a program's plan grows with its length only. Computes are
projections, binds left joins.

Nothing here calls the JVM: tables and outputs of other blocks are known by name and types, and ``sql`` names them as views.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..expr import Compiler, Typed, literal, quoted, variables
from ..functions import fetch as fn
from ..model import Bind, Compute, Fetch, Options, Ruleblock, RuleError, Statement
from ..parser import split

#: The table whose entities are the rows of every result.
UNIVERSE = "eadv"


@dataclass
class Output:
    """The types of a ruleblock's columns and how they are spelled, by lower-case name."""

    types: dict[str, str]
    spelled: dict[str, str]


@dataclass
class Plan(Output):
    """And the statement that computes them, over the views of ``tables`` and of the ``blocks`` it binds."""

    sql: str = ""
    tables: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ()


def type_of(data_type: T.DataType, raw: bool) -> str:
    if isinstance(data_type, T.StringType):
        return "raw" if raw else "text"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "bool" if isinstance(data_type, T.BooleanType) else "num"


@dataclass(frozen=True)
class Observations:
    """A table of observations: its columns' types and spelling. Its view has them as ``__<name>``, which no variable can clash with."""

    types: dict[str, str]
    names: dict[str, str]

    @staticmethod
    def of(schema: T.StructType) -> "Observations":
        names = {f.name.lower(): f for f in schema.fields}
        if missing := {"eid", "att", "dt", "val"} - names.keys():
            raise RuleError(f"The observations have no column {', '.join(sorted(missing))}")
        kept = [c for c in ("eid", "att", "dt", "val", "loc") if c in names]
        return Observations({c: type_of(names[c].dataType, c == "val") for c in kept}, {c: names[c].name for c in kept})

    def column(self, name: str) -> Typed | None:
        name = "val" if name == "_" else name
        return Typed(f"__{name}", self.types[name]) if name in self.types else None


def attribute_filter(attributes: tuple[str, ...]) -> str:
    """Any of the names; ``%`` stands for any text, ``_`` for itself."""
    exact = [literal(a) for a in attributes if "%" not in a]
    parts = [f"__att IN ({', '.join(exact)})"] if exact else []
    for a in attributes:
        if "%" in a:
            prefix = a.endswith("%") and "%" not in a[:-1]
            parts.append(f"startswith(__att, {literal(a[:-1])})" if prefix else f"__att LIKE {literal(a.replace('\\', '\\\\').replace('_', '\\_'))}")
    return "(" + " OR ".join(dict.fromkeys(parts)) + ")"


@dataclass
class Wide:
    """The row so far: the common table that holds it and its columns' types."""

    name: str
    types: dict[str, str] = field(default_factory=dict)


class Planner:
    def __init__(self, tables: Callable[[str], T.StructType | None], outputs: Callable[[str], Output | None], options: Options, prefix: str = "ruleframe"):
        self.tables, self.outputs, self.options, self.prefix = tables, outputs, options, prefix
        self.opened: dict[str, Observations] = {}

    def observations(self, table: str) -> Observations:
        key = table.lower()
        if key not in self.opened:
            schema = self.tables(key)
            if schema is None:
                raise RuleError(f"Unknown table: {table}")
            self.opened[key] = Observations.of(schema)
        return self.opened[key]

    def table_view(self, table: str) -> str:
        return quoted(f"{self.prefix}_table_{table.lower()}")

    def block_view(self, block: str) -> str:
        return quoted(f"{self.prefix}_block_{block.lower()}")

    def references(self, s: Statement) -> set[str]:
        if isinstance(s, Fetch):
            return variables(s.predicate, True)
        if isinstance(s, Compute):
            return set().union(*(variables(c.predicate, False) | variables(c.value, False) for c in s.conditions))
        return set()

    def check(self, block: Ruleblock) -> None:
        """Functions exist, variables are defined once and before their use."""
        known: set[str] = set()
        for s in block.rules:
            if isinstance(s, Fetch) and s.function not in fn.FUNCTIONS:
                raise RuleError(f"Unsupported function: {s.function}", block.name)
            for name in sorted(self.references(s)):
                if name not in known:
                    raise RuleError(f"Undefined variable: {name} in {s.variable}", block.name)
            made = self.made(s)
            if repeated := known & set(made) or ({"eid"} & set(made)):
                raise RuleError(f"Variable defined twice: {sorted(repeated)[0]}", block.name)
            known |= set(made)

    @staticmethod
    def made(s: Statement) -> list[str]:
        v = s.variable.lower()
        return [f"{v}_val", f"{v}_dt"] if isinstance(s, Fetch) and s.function in fn.PAIRS else [v]

    @staticmethod
    def spelling(s: Statement) -> list[str]:
        return [f"{s.variable}_val", f"{s.variable}_dt"] if isinstance(s, Fetch) and s.function in fn.PAIRS else [s.variable]

    def build(self, block: Ruleblock) -> Plan:
        self.check(block)
        self.ctes: list[str] = []
        used: dict[str, None] = {UNIVERSE: None}
        self.observations(UNIVERSE)
        free = [s for s in block.rules if isinstance(s, Fetch) and not self.references(s)]
        wide = Wide(self.add(f"SELECT DISTINCT __eid AS eid FROM {self.table_view(UNIVERSE)}"))
        for table in dict.fromkeys(s.table.lower() for s in free):
            used[table] = None
            wide = self.fetched(table, [s for s in free if s.table.lower() == table], wide)
        todo = [s for s in block.rules if s not in free]
        while todo:
            ready = [s for s in todo if self.references(s) <= wide.types.keys()]
            dependent = [s for s in ready if isinstance(s, Fetch)]
            others = [s for s in ready if not isinstance(s, Fetch)]
            if others:
                wide = self.projected(wide, others)
                todo = [s for s in todo if s not in others]
            else:
                for table in dict.fromkeys(s.table.lower() for s in dependent):
                    used[table] = None
                    wide = self.dependent(table, [s for s in dependent if s.table.lower() == table], wide)
                todo = [s for s in todo if s not in dependent]
        order = [(low, high) for s in block.rules for low, high in zip(self.made(s), self.spelling(s))]
        sql = "WITH " + ",\n".join(self.ctes) + f"\nSELECT {', '.join(['eid', *(f'`{low}` AS `{high}`' for low, high in order)])} FROM {wide.name}"
        blocks = dict.fromkeys(s.source.lower() for s in block.rules if isinstance(s, Bind))
        return Plan(wide.types, dict(order), sql, tuple(used), tuple(blocks))

    def add(self, sql: str) -> str:
        name = f"c{len(self.ctes)}"
        self.ctes.append(f"{name} AS ({sql})")
        return name

    # computes and binds

    def projected(self, wide: Wide, statements: list[Statement]) -> Wide:
        types, joins, columns = dict(wide.types), [], ["w.*"]
        sources: dict[str, list[Bind]] = {}
        for s in statements:
            if isinstance(s, Bind):
                sources.setdefault(s.source.lower(), []).append(s)
        for k, (source, binds) in enumerate(sources.items()):
            out = self.outputs(source)
            if out is None:
                raise RuleError(f"Unknown ruleblock in bind: {binds[0].source}")
            for b in binds:
                low = b.source_variable.lower()
                if low not in out.types:
                    raise RuleError(f"Ruleblock {b.source} has no variable {b.source_variable}")
                types[b.variable.lower()] = out.types[low]
                columns.append(f"b{k}.{quoted(out.spelled.get(low, low))} AS `{b.variable.lower()}`")
            joins.append(f" LEFT JOIN {self.block_view(source)} AS b{k} ON w.eid = b{k}.eid")
        name = self.add(f"SELECT {', '.join(columns)} FROM {wide.name} AS w{''.join(joins)}") if joins else wide.name
        made: dict[str, Typed] = {}
        compiler = self.compiler(lambda v: Typed(f"`{v}`", types[v]) if v in types and v not in made else None)
        for s in statements:
            if isinstance(s, Compute):
                made[s.variable.lower()] = self.computed(compiler, s)
        if made:
            name = self.add(f"SELECT *, {', '.join(f'{t.sql} AS `{v}`' for v, t in made.items())} FROM {name}")
        return Wide(name, types | {v: t.type for v, t in made.items()})

    def compiler(self, scope: Callable[[str], Typed | None]) -> Compiler:
        return Compiler(scope, self.options.static_sysdate, self.options.strict_cast)

    @staticmethod
    def computed(compiler: Compiler, s: Compute) -> Typed:
        conditions, values = [], []
        for c in s.conditions:
            values.append(compiler.compile(c.value))
            if c.predicate is None:
                break  # nothing after an unconditional value can be reached
            conditions.append(compiler.predicate(c.predicate))
        out = compiler.choose(conditions, values)
        return Typed(f"CAST({out.sql} AS string)", "text") if out.type == "null" else out

    # fetches

    def flagged(self, obs: Observations, fetches: list[Fetch], scope: Callable[[str], Typed | None]) -> tuple[list[str], list[fn.Rows]]:
        """Columns that a scan adds for its fetches (whether a row matches, its number, its text), and each fetch's view of them."""
        compiler = self.compiler(scope)
        columns, rows = [], []
        for i, s in enumerate(fetches):
            prop = obs.column(s.property.lower())
            if prop is None:
                raise RuleError(f"Unknown property: {s.property} in {s.variable}")
            if prop.type == "date" and s.function in fn.NUMERIC:
                raise RuleError(f"{s.function} needs numbers, and {s.property} is a date: {s.variable}")
            hit = attribute_filter(s.attributes) + (f" AND {compiler.predicate(s.predicate)}" if s.predicate else "")
            columns.append(f"coalesce({hit}, false) AS __p{i}")
            number = "CAST(NULL AS double)"
            if s.function in fn.SERIAL:
                columns.append(f"{self.serial(compiler, s, prop)} AS __s{i}")
            elif prop.type != "date":
                columns.append(f"CAST({compiler.number(prop)} AS double) AS __n{i}")
                number = f"__n{i}"
            rows.append(fn.Rows(f"__p{i}", prop, number))
        return columns, rows

    @staticmethod
    def times() -> str:
        return f"{fn.MICROS.format(dt='__dt')} AS __us"

    def fetched(self, table: str, fetches: list[Fetch], wide: Wide) -> Wide:
        """The row so far and the outputs of fetches that need no variable."""
        obs = self.observations(table)
        columns, views = self.flagged(obs, fetches, obs.column)
        names = attribute_filter(tuple(dict.fromkeys(a for s in fetches for a in s.attributes)))
        rows = self.add(f"SELECT *, {', '.join([self.times(), *columns])} FROM {self.table_view(table)} WHERE {names}")
        stages: list[tuple[str, list[int]]] = []
        kinds: dict[str, list[int]] = {}
        for i, s in enumerate(fetches):
            kind = "counted " + ("number" if s.function == "median" else views[i].prop.sql) if s.function in fn.COUNTED else s.function if s.function in fn.DAILY else "ranked" if s.function in fn.RANKED else "plain"
            kinds.setdefault(kind, []).append(i)
        for kind, chosen in kinds.items():
            make = {"plain": self.plain, "ranked": self.ranked, "temporal_regularity": self.regularity, "max_neg_delta_dv": self.falls}.get(kind, self.counted)
            stages.append((self.add(make(rows, fetches, views, chosen)), chosen))
        joins = "".join(f" LEFT JOIN {name} ON w.eid = {name}.eid" for name, _ in stages)
        made, types = self.outputs_of(obs, fetches, lambda i: next(f"{name}.__a{i}" for name, chosen in stages if i in chosen))
        return Wide(self.add(f"SELECT {', '.join(['w.*', *made])} FROM {wide.name} AS w{joins}"), wide.types | types)

    def dependent(self, table: str, fetches: list[Fetch], wide: Wide) -> Wide:
        """The same for fetches that need variables: the row so far meets the observations once and is carried along."""
        obs, types = self.observations(table), wide.types
        columns, views = self.flagged(obs, fetches, lambda v: obs.column(v) or (Typed(f"`{v}`", types[v]) if v in types else None))
        names = attribute_filter(tuple(dict.fromkeys(a for s in fetches for a in s.attributes)))
        met = self.add(f"SELECT w.*, o.* FROM {wide.name} AS w LEFT JOIN (SELECT *, {self.times()} FROM {self.table_view(table)} WHERE {names}) AS o ON w.eid = o.__eid")
        rows = self.add(f"SELECT *, {', '.join(columns)} FROM {met}")
        windows: list[str] = []
        out: list[str] = []
        for i, (s, r) in enumerate(zip(fetches, views)):
            by = f"PARTITION BY eid, {r.hit} ORDER BY"
            if s.function in fn.RANKED:
                windows.append(f"row_number() OVER ({by} {fn.NEWEST_FIRST}) AS __r{i}")
                out.append(f"max(CASE WHEN {r.hit} AND __r{i} = {self.rank(s)} THEN {r.prop.sql} END)")
            elif s.function == "max_neg_delta_dv":
                windows.append(f"{r.number} - lag({r.number}) OVER ({by} {fn.OLDEST_FIRST}) AS __r{i}")
                fall = f"{r.hit} AND __us IS NOT NULL AND __r{i} < 0"
                out.append(f"min_by(struct(__r{i} AS v, __dt AS t), CASE WHEN {fall} THEN struct(__r{i}, - __us) END)")
            elif s.function == "temporal_regularity":
                windows.append(f"datediff(__dt, lag(__dt) OVER ({by} {fn.OLDEST_FIRST})) AS __r{i}")
                gap = f"CASE WHEN {r.hit} THEN __r{i} END"
                out.append(f"CASE WHEN count({gap}) > 1 THEN CASE WHEN avg({gap}) = 0 THEN 0D ELSE stddev_samp({gap}) / avg({gap}) END END")
            else:
                out.append(self.aggregate(i, s, r, True))
        if windows:
            rows = self.add(f"SELECT *, {', '.join(windows)} FROM {rows}")
        kept = [f"any_value(`{v}`) AS `{v}`" for v in types]
        grouped = self.add(f"SELECT {', '.join(['eid', *kept, *(f'{x} AS __a{i}' for i, x in enumerate(out))])} FROM {rows} GROUP BY eid")
        made, new = self.outputs_of(obs, fetches, lambda i: f"__a{i}")
        return Wide(self.add(f"SELECT {', '.join(['eid', *(f'`{v}`' for v in types), *made])} FROM {grouped}"), types | new)

    def outputs_of(self, obs: Observations, fetches: list[Fetch], where: Callable[[int], str]) -> tuple[list[str], dict[str, str]]:
        columns, types = [], {}
        for i, s in enumerate(fetches):
            kind = fn.result_type(s.function, obs.column(s.property.lower()).type)
            if s.function in fn.PAIRS:
                value, time = self.made(s)
                columns += [f"{where(i)}.v AS `{value}`", f"{where(i)}.t AS `{time}`"]
                types |= {value: kind, time: "date"}
            else:
                columns.append(f"{where(i)} AS `{self.made(s)[0]}`")
                types[self.made(s)[0]] = kind
        return columns, types

    # stages of free fetches

    def plain(self, rows: str, fetches: list[Fetch], views: list[fn.Rows], chosen: list[int]) -> str:
        out = [f"{self.aggregate(i, fetches[i], views[i])} AS __a{i}" for i in chosen]
        return f"SELECT __eid AS eid, {', '.join(out)} FROM {rows} GROUP BY __eid"

    @staticmethod
    def aggregate(i: int, s: Fetch, r: fn.Rows, dependent: bool = False) -> str:
        if s.function in fn.SERIAL:
            delimiter = "," if s.function == "serializedv2" or not s.params or not s.params[0] else s.params[0]
            return f"listagg(__s{i}, {literal(delimiter)}) WITHIN GROUP (ORDER BY {fn.OLDEST_FIRST}) FILTER (WHERE {r.hit})"
        if s.function in fn.PAIRS:
            r = fn.Rows(r.hit, Typed(f"struct({r.prop.sql} AS v, __dt AS t)", r.prop.type), r.number)
        out = fn.AGGREGATES[s.function](r)
        # a count over variables is 0 where nothing matches, not NULL
        return f"CASE WHEN count_if({r.hit}) > 0 THEN {out} END" if s.function in fn.NULL_IF_NONE - ({"count"} if dependent else set()) else out

    @staticmethod
    def serial(compiler: Compiler, s: Fetch, prop: Typed) -> str:
        day = "date_format(__dt, 'yyyy-MM-dd')"
        if s.function == "serializedv2":
            form = ",".join(s.params) if s.params else "val"
            parts = [day if p.strip().lower() == "dt" else compiler.text(compiler.compile(p.strip())) for p in split(form, "~")]
            return f"concat({", '~', ".join(parts)})"
        value = compiler.text(prop)
        return f"concat({value}, '~', {day})" if s.function == "serializedv" else value

    @staticmethod
    def matching(rows: str, views: list[fn.Rows], chosen: list[int], columns: str) -> str:
        """A row for each of the chosen fetches that a row matches, with its number as ``__f``."""
        which = ", ".join(f"CASE WHEN {views[i].hit} THEN {i} END" for i in chosen)
        return f"SELECT {columns}, explode(array_compact(array({which}))) AS __f FROM {rows}"

    def counted(self, rows: str, fetches: list[Fetch], views: list[fn.Rows], chosen: list[int]) -> str:
        """Counts per (entity, fetch, value) first, where a hot entity spreads over its values; the rest needs the counts only."""
        x = "CASE " + " ".join(f"WHEN __f = {i} THEN {views[i].number if fetches[i].function == 'median' else views[i].prop.sql}" for i in chosen) + " END"
        used = dict.fromkeys(["__eid", *(views[i].number if fetches[i].function == "median" else views[i].prop.sql for i in chosen)])
        counts = f"SELECT __eid, __f, {x} AS x, count(*) AS k FROM ({self.matching(rows, views, chosen, ', '.join(used))}) GROUP BY 1, 2, 3"
        form = {
            "median": "percentile(CASE WHEN __f = {i} THEN x END, 0.5D, k)",
            "distinct_count": "CASE WHEN count_if(__f = {i}) > 0 THEN count(CASE WHEN __f = {i} THEN x END) END",
            "stats_mode": "min_by(x, CASE WHEN __f = {i} AND x IS NOT NULL THEN struct(- k, x) END)",
        }
        return f"SELECT __eid AS eid, {', '.join(f'{form[fetches[i].function].format(i=i)} AS __a{i}' for i in chosen)} FROM ({counts}) GROUP BY __eid"

    @staticmethod
    def rank(s: Fetch) -> int:
        n = s.params[0].strip() if s.params else "1"
        if not n.isdigit() or int(n) < 1:
            raise RuleError(f"nth needs a positive number: {n}")
        return int(n)

    def ranked(self, rows: str, fetches: list[Fetch], views: list[fn.Rows], chosen: list[int]) -> str:
        """The newest rows of each (entity, fetch); no task passes on more of them than the highest rank asked for."""
        props = dict.fromkeys(["__eid", "__us", "__att", "__val", *(views[i].prop.sql for i in chosen)])
        ranks = f"SELECT *, row_number() OVER (PARTITION BY __eid, __f ORDER BY {fn.NEWEST_FIRST}) AS __r FROM ({self.matching(rows, views, chosen, ', '.join(props))})"
        out = [f"max(CASE WHEN __f = {i} AND __r = {self.rank(fetches[i])} THEN {views[i].prop.sql} END) AS __a{i}" for i in chosen]
        return f"SELECT __eid AS eid, {', '.join(out)} FROM ({ranks}) WHERE __r <= {max(self.rank(fetches[i]) for i in chosen)} GROUP BY __eid"

    def regularity(self, rows: str, fetches: list[Fetch], views: list[fn.Rows], chosen: list[int]) -> str:
        """Gaps lie between days, so rows fold to days first; a day of n rows holds n - 1 gaps of nothing."""
        days = f"SELECT __eid, __f, to_date(__dt) AS d, count(*) AS k FROM ({self.matching(rows, views, chosen, '__eid, __dt')}) WHERE __dt IS NOT NULL GROUP BY 1, 2, 3"
        gaps = f"SELECT *, CAST(datediff(d, lag(d) OVER (PARTITION BY __eid, __f ORDER BY d)) AS double) AS g FROM ({days})"
        sums = f"SELECT __eid, __f, sum(k) - 1 AS m, coalesce(sum(g), 0D) AS s, coalesce(sum(g * g), 0D) AS q FROM ({gaps}) GROUP BY 1, 2"
        value = "CASE WHEN m > 1 THEN CASE WHEN s = 0 THEN 0D ELSE sqrt(greatest(q - s * s / m, 0D) / (m - 1)) / (s / m) END END"
        return f"SELECT __eid AS eid, {', '.join(f'max(CASE WHEN __f = {i} THEN {value} END) AS __a{i}' for i in chosen)} FROM ({sums}) GROUP BY __eid"

    def falls(self, rows: str, fetches: list[Fetch], views: list[fn.Rows], chosen: list[int]) -> str:
        """Falls between neighbours inside a day, then between the last row of a day and the first of the next day with rows."""
        x = "CASE " + " ".join(f"WHEN __f = {i} THEN {views[i].number}" for i in chosen) + " END"
        used = dict.fromkeys(["__eid", "__us", "__dt", "__att", "__val", *(views[i].number for i in chosen)])
        mine = f"SELECT *, {x} AS x, to_date(__dt) AS d FROM ({self.matching(rows, views, chosen, ', '.join(used))}) WHERE __us IS NOT NULL"
        by = f"PARTITION BY __eid, __f, d ORDER BY {fn.OLDEST_FIRST}"
        inside = f"SELECT *, x - lag(x) OVER ({by}) AS g, row_number() OVER ({by}) AS r FROM ({mine})"
        fall = "min_by(struct(g AS v, __dt AS t, __us AS us), CASE WHEN g < 0 THEN struct(g, - __us) END)"
        days = f"SELECT __eid, __f, d, {fall} AS b, min_by(struct(x, __dt AS t, __us AS us), r) AS a, max_by(struct(x), r) AS z FROM ({inside}) GROUP BY 1, 2, 3"
        between = f"SELECT __eid, __f, b, struct(a.x - (lag(z) OVER (PARTITION BY __eid, __f ORDER BY d)).x AS v, a.t AS t, a.us AS us) AS e FROM ({days})"
        both = f"SELECT __eid, __f, inline(array(b, e)) FROM ({between})"
        out = [f"min_by(struct(v, t), CASE WHEN __f = {i} AND v < 0 THEN struct(v, - us) END) AS __a{i}" for i in chosen]
        return f"SELECT __eid AS eid, {', '.join(out)} FROM ({both}) GROUP BY __eid"
