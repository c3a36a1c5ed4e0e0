"""The manifest of a compilation and its JSON form."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from .graph import dependencies
from .model import Manifest, ManifestEntry, Ruleblock

VERSION = "1.0.0"
DIALECT = "spark"


def table_name(ruleblock: str) -> str:
    return f"rout_{ruleblock.lower()}"


def generate_manifest(blocks: list[Ruleblock]) -> Manifest:
    """Of blocks in execution order."""
    graph = dependencies(blocks)
    entries = tuple(
        ManifestEntry(b.name, i, table_name(b.name), tuple(graph[b.name]), tuple(r.variable for r in b.rules), i) for i, b in enumerate(blocks)
    )
    return Manifest(VERSION, DIALECT, datetime.now(timezone.utc).isoformat(timespec="milliseconds"), entries, graph)


def as_dict(m: Manifest) -> dict[str, Any]:
    entry = lambda e: {
        "ruleblockId": e.ruleblock_id, "executionOrder": e.execution_order, "targetTable": e.target_table,
        "dependencies": list(e.dependencies), "outputVariables": list(e.output_variables), "sqlIndex": e.sql_index,
    }
    return {
        "version": m.version, "dialect": m.dialect, "compiledAt": m.compiled_at, "totalRuleblocks": m.total_ruleblocks,
        "entries": [entry(e) for e in m.entries], "dependencyGraph": m.dependency_graph,
    }


def serialize_manifest(m: Manifest, pretty: bool = True, indent: int = 2) -> str:
    return json.dumps(as_dict(m), indent=indent) if pretty else json.dumps(as_dict(m), separators=(",", ":"))


def write_manifest(m: Manifest, path: str, pretty: bool = True, indent: int = 2, create_dir: bool = True) -> None:
    target = Path(path)
    if create_dir:
        target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(serialize_manifest(m, pretty, indent), encoding="utf-8")
