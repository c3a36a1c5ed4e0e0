"""Records: programs, parsed statements, options, manifest and results."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame

NAME = re.compile(r"[a-z_][a-z0-9_]*", re.IGNORECASE)
MAX_TEXT = 1_000_000


class RuleError(ValueError):
    """A program that cannot be compiled."""

    def __init__(self, message: str, ruleblock: str | None = None):
        super().__init__(message)
        self.ruleblock = ruleblock


class RuleType(str, Enum):
    FETCH_STATEMENT = "FETCH_STATEMENT"
    COMPUTE_STATEMENT = "COMPUTE_STATEMENT"
    BIND_STATEMENT = "BIND_STATEMENT"


class DataType(str, Enum):
    NUMERIC = "NUMERIC"
    TEXT = "TEXT"
    DATE = "DATE"
    BOOLEAN = "BOOLEAN"


@dataclass(frozen=True)
class RuleblockInput:
    name: str
    text: str
    is_active: bool = True

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not 1 <= len(self.name) <= 100 or not NAME.fullmatch(self.name):
            raise RuleError(f"Invalid ruleblock name: {self.name!r}", str(self.name))
        if not isinstance(self.text, str) or len(self.text) > MAX_TEXT:
            raise RuleError(f"The text of {self.name} is no text of at most {MAX_TEXT} characters", self.name)


@dataclass(frozen=True)
class Options:
    """``static_sysdate`` (ISO date) stands for today; ``strict_cast`` makes text that is no number an error."""

    include_inactive: bool = False
    static_sysdate: str | None = None
    subset: tuple[str, ...] = ()
    prune_inputs: tuple[str, ...] = ()
    prune_outputs: tuple[str, ...] = ()
    manifest_path: str | None = None
    strict_cast: bool = False


@dataclass(frozen=True)
class Fetch:
    variable: str
    table: str
    attributes: tuple[str, ...]
    property: str
    function: str
    params: tuple[str, ...] = ()
    predicate: str | None = None
    references: tuple[str, ...] = ()
    rule_type = RuleType.FETCH_STATEMENT


@dataclass(frozen=True)
class Condition:
    predicate: str | None
    value: str


@dataclass(frozen=True)
class Compute:
    variable: str
    conditions: tuple[Condition, ...]
    references: tuple[str, ...] = ()
    rule_type = RuleType.COMPUTE_STATEMENT


@dataclass(frozen=True)
class Bind:
    variable: str
    source: str
    source_variable: str
    property: str
    references: tuple[str, ...] = ()
    rule_type = RuleType.BIND_STATEMENT


Statement = Fetch | Compute | Bind


@dataclass
class Ruleblock:
    name: str
    text: str
    is_active: bool = True
    rules: list[Statement] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def key(self) -> str:
        return self.name.lower()


@dataclass(frozen=True)
class ManifestEntry:
    ruleblock_id: str
    execution_order: int
    target_table: str
    dependencies: tuple[str, ...]
    output_variables: tuple[str, ...]
    sql_index: int


@dataclass(frozen=True)
class Manifest:
    version: str
    dialect: str
    compiled_at: str
    entries: tuple[ManifestEntry, ...]
    dependency_graph: dict[str, list[str]]

    @property
    def total_ruleblocks(self) -> int:
        return len(self.entries)


@dataclass
class Message:
    message: str
    ruleblock: str | None = None


@dataclass
class CompilationResult:
    """``dataframes`` are lazy, and ``sql`` has the statements they are made of. ``options`` are those of the compile."""

    success: bool
    ruleblocks: list[Ruleblock] = field(default_factory=list)
    dataframes: Mapping[str, DataFrame] = field(default_factory=dict)
    errors: list[Message] = field(default_factory=list)
    warnings: list[Message] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)
    manifest: Manifest | None = None
    options: Options = Options()
    sql: dict[str, str] = field(default_factory=dict)
