"""Programs in, DataFrames out: parse, link, transform, plan; then run or write."""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .expr import quoted, variables
from .graph import ordered, transform
from .manifest import generate_manifest, table_name, write_manifest
from .model import Bind, CompilationResult, Compute, Fetch, Message, Options, RuleblockInput, Ruleblock, RuleError
from .parser import parse_block
from .plans.planner import Observations, Output, Plan, Planner, type_of
from .session import materialize


def parse(blocks: Iterable[RuleblockInput]) -> list[Ruleblock]:
    """Statements of each block, with the variables that each refers to."""
    return [_resolved(parse_block(b)) for b in blocks]


def _resolved(block: Ruleblock) -> Ruleblock:
    def of(s):
        if isinstance(s, Fetch):
            found = variables(s.predicate, True)
        elif isinstance(s, Compute):
            found = set().union(*(variables(c.predicate, False) | variables(c.value, False) for c in s.conditions))
        else:
            found = {s.source_variable.lower()}
        return replace(s, references=tuple(sorted(found)))

    try:
        block.rules = [of(s) for s in block.rules]
    except RuleError as e:
        raise RuleError(str(e), block.name) from None
    return block


def read_blocks(rows: DataFrame) -> tuple[list[RuleblockInput], list[Message]]:
    """Programs from a table (``name, text, isActive``); rows with a bad name become warnings."""
    blocks, warnings = [], []
    active = next((c for c in rows.columns if c.lower() in ("isactive", "is_active")), None)
    for r in rows.collect():  # programs are written by hand: a small table
        try:
            blocks.append(RuleblockInput(r["name"], r["text"] or "", True if active is None or r[active] is None else r[active]))
        except RuleError as e:
            warnings.append(Message(str(e), r["name"]))
    return blocks, warnings


#: Blocks that one plan spans at most: Spark's time to plan grows faster than a plan does.
SPAN = 8


class Frames(Mapping[str, DataFrame]):
    """The DataFrames of a compiled program by block name, each built when it is asked for.

    A block that several of the blocks asked for bind is stored below the shared folder when the first of them is built: else
    its plan would be repeated in each, and doubled by every further level of binds. So is every block at which a plan would
    span ``SPAN`` blocks of a long chain. Nothing else runs before an action.
    """

    def __init__(self, engine: "Engine", plans: dict[str, Plan], names: dict[str, str], prefix: str):
        self._engine, self._plans, self._names, self._prefix = engine, plans, names, prefix
        self._built: dict[str, DataFrame] = {}
        self._stored: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        key = self._names[name]
        self.store_shared(key)
        return self._frame(key)

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def _above(self, *keys: str) -> set[str]:
        """The blocks that the named ones bind, and theirs, up to stored ones."""
        out: set[str] = set()
        todo = list(keys)
        while todo:
            fresh = {s for s in self._plans[todo.pop()].blocks if s in self._plans and s not in self._stored} - out
            out |= fresh
            todo += fresh
        return out

    def store_shared(self, *keys: str) -> None:
        """Store the blocks that two or more of the named blocks (of all, if none is named) and their sources bind, and every ``SPAN``-th of a chain."""
        keys = keys or tuple(self._plans)
        binders = Counter(source for k in self._above(*keys) | set(keys) for source in self._plans[k].blocks)
        span = {k: 0 for k in self._stored}
        for k in self._plans:  # sources first
            if k not in self._stored:
                span[k] = 1 + sum(span.get(source, 0) for source in self._plans[k].blocks)
                if binders[k] > 1 or binders[k] and span[k] >= SPAN:
                    self._stored[k], span[k] = materialize(self._frame(k), "block"), 0

    def _frame(self, key: str) -> DataFrame:
        if key not in self._stored and key not in self._built:
            above = self._above(key)
            for k in (*(k for k in self._plans if k in above), key):
                if k not in self._built:
                    self._built[k] = self.build(k, self._built | self._stored)
        return self._stored.get(key, self._built.get(key))

    def build(self, key: str, sources: dict[str, DataFrame]) -> DataFrame:
        """The block's statement over the tables and the given sources; sources that are no block of the program were saved earlier."""
        plan, e = self._plans[key], self._engine
        views = {f"{self._prefix}_table_{t}": e.view(t) for t in plan.tables}
        views |= {f"{self._prefix}_block_{b}": sources[b] if b in sources else e.saved(b) for b in plan.blocks}
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        try:
            return e.spark.sql(plan.sql)
        finally:
            for name in views:
                e.spark.catalog.dropTempView(name)


class Engine:
    """Compiles programs against named tables of observations; ``eadv`` gives the entities of every result."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.catalog = {k.lower(): v for k, v in (tables or {}).items()}
        self._schemas: dict[str, T.StructType] = {}
        self._views: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame | None:
        if name in self.catalog:
            return self.catalog[name]
        return self.spark.table(name) if self.spark.catalog.tableExists(name) else None

    def _schema(self, name: str) -> T.StructType | None:
        """Schemas of given tables are kept; others may have been replaced."""
        if name in self._schemas:
            return self._schemas[name]
        df = self._table(name)
        if df is None:
            return None
        if name in self.catalog:
            self._schemas[name] = df.schema
        return df.schema

    def view(self, name: str) -> DataFrame:
        """A table of observations under the names that statements use."""
        if name not in self._views or name not in self.catalog:
            df = self._table(name)
            names = Observations.of(df.schema).names
            self._views[name] = df.selectExpr(*(f"{quoted(column)} AS __{low}" for low, column in names.items())).where("__eid IS NOT NULL")
        return self._views[name]

    def saved(self, block: str) -> DataFrame:
        """The result of a block that an earlier run saved."""
        df = self._table(table_name(block))
        if df is None:
            raise RuleError(f"Unknown ruleblock in bind: {block}")
        return df

    def compile(self, blocks: Iterable[RuleblockInput], options: Options | None = None) -> CompilationResult:
        """All or nothing: any error, whatever its cause, leaves a result without DataFrames. Nothing runs."""
        options = options or Options()
        clock = [time.perf_counter()]
        tick = lambda: clock.append(time.perf_counter())
        try:
            given = list(blocks)
            parsed = parse([b for b in given if b.is_active or options.include_inactive])
            tick()
            linked = ordered(parsed)
            tick()
            chosen = transform(linked, options.subset, options.prune_inputs, options.prune_outputs)
            tick()
            prefix = f"ruleframe_{uuid.uuid4().hex[:8]}"
            plans = self._plan(chosen, options, prefix)
            tick()
            manifest = generate_manifest(chosen)
            if options.manifest_path:
                write_manifest(manifest, options.manifest_path)
        except RuleError as e:
            return CompilationResult(False, errors=[Message(str(e), e.ruleblock)], options=options)
        except RecursionError:
            return CompilationResult(False, errors=[Message("An expression is nested too deeply")], options=options)
        except Exception as e:  # noqa: BLE001 - whatever goes wrong is reported in the result
            return CompilationResult(False, errors=[Message(f"{type(e).__name__}: {e}")], options=options)
        ms = [(b - a) * 1000 for a, b in zip(clock, clock[1:])]
        metrics = dict(zip(("parse_ms", "link_ms", "transform_ms", "plan_ms"), ms)) | {"total_ms": (clock[-1] - clock[0]) * 1000, "ruleblocks": len(given), "cache_hit_rate": 0}
        warnings = [Message(w, b.name) for b in chosen for w in b.warnings]
        frames = Frames(self, plans, {b.name: b.key for b in chosen}, prefix)
        return CompilationResult(True, chosen, frames, [], warnings, metrics, manifest, options, {b.name: plans[b.key].sql for b in chosen})

    def _plan(self, blocks: list[Ruleblock], options: Options, prefix: str) -> dict[str, Plan]:
        done: dict[str, Plan] = {}

        def output(name: str) -> Output | None:
            if name in done:
                return done[name]
            schema = self._schema(table_name(name))  # of an earlier run
            return None if schema is None else Output({f.name.lower(): type_of(f.dataType, False) for f in schema.fields}, {f.name.lower(): f.name for f in schema.fields})

        planner = Planner(self._schema, output, options, prefix)
        for b in blocks:
            try:
                done[b.key] = planner.build(b)
            except RuleError as e:
                raise RuleError(str(e), e.ruleblock or b.name) from None
        return done

    def run(self, result: CompilationResult) -> dict[str, DataFrame]:
        """Register each block's result as the temporary view ``rout_<name>``, in execution order."""
        if not result.success:
            raise RuleError("; ".join(m.message for m in result.errors))
        result.dataframes.store_shared()
        frames = dict(result.dataframes)
        for name, df in frames.items():
            df.createOrReplaceTempView(table_name(name))
        return frames

    def write(self, result: CompilationResult, path: str | None = None, database: str | None = None) -> dict[str, str]:
        """Write each block's table, replacing an old one, in execution order; blocks that bind it read what was written."""
        if not result.success:
            raise RuleError("; ".join(m.message for m in result.errors))
        written: dict[str, str] = {}
        stored: dict[str, DataFrame] = {}
        for b in result.ruleblocks:
            frame = result.dataframes.build(b.key, stored)
            if path:
                target = f"{path.rstrip('/')}/{table_name(b.name)}"
                frame.write.mode("overwrite").parquet(target)
                stored[b.key] = self.spark.read.schema(frame.schema).parquet(target)
            else:
                target = f"{database}.{table_name(b.name)}" if database else table_name(b.name)
                frame.write.mode("overwrite").saveAsTable(target)
                stored[b.key] = self.spark.table(target)
            written[b.name] = target
        return written


def compile_blocks(spark: SparkSession, tables: dict[str, DataFrame], blocks: Iterable[RuleblockInput], options: Options | None = None) -> CompilationResult:
    return Engine(spark, tables).compile(blocks, options)
