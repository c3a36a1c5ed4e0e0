"""ruleframe: declarative rules over entity-attribute-date-value data, run as Spark DataFrames."""

from .engine import Engine, compile_blocks, parse, read_blocks
from .manifest import generate_manifest, serialize_manifest, write_manifest
from .model import CompilationResult, DataType, Manifest, ManifestEntry, Options, RuleblockInput, RuleError, RuleType

__all__ = [
    "CompilationResult", "DataType", "Engine", "Manifest", "ManifestEntry", "Options", "RuleError", "RuleType", "RuleblockInput",
    "compile_blocks", "generate_manifest", "parse", "read_blocks", "serialize_manifest", "write_manifest",
]
