"""Ordered permission rules compiled to one CASE expression."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.globs import glob_matches
from tessella.functions.text import any_of


@dataclass(frozen=True)
class Rule:
    paths: tuple[str, ...]
    mode: int
    allow_delete: bool = False


#: The protections in force without a manifest, in order.
DEFAULT_RULES = (
    Rule((".vfs/**",), 0o444),
    Rule((".git/**",), 0o444),
    Rule((".gitignore",), 0o444),
    Rule(("**/*.sum",), 0o444),
    Rule(("**/*.lock",), 0o444),
    Rule(("**/*.pb.go",), 0o444),
    Rule(("**/*.gen.go",), 0o444),
    Rule(("**/vendor/**",), 0o444),
    Rule(("**/node_modules/**",), 0o444),
    Rule((".github/workflows/**",), 0o444),
    Rule(("src/**",), 0o644, True),
    Rule(("lib/**",), 0o644, True),
    Rule(("cmd/**",), 0o644, True),
)


@dataclass(frozen=True)
class Permissions:
    """Modes of backends (by first path component), then rules, then the default."""

    rules: tuple[Rule, ...] = DEFAULT_RULES
    backends: dict[str, int] = field(default_factory=dict)
    default: int = 0o644

    def mode(self, path: Column) -> Column:
        plain = F.regexp_replace(path, r"^(\./)+", "")
        head = F.substring_index(plain, "/", 1)
        out = F.when(F.lit(False), F.lit(None).cast("int"))
        for name, mode in self.backends.items():
            out = out.when(head == name, mode)
        for rule in self.rules:
            out = out.when(any_of(glob_matches(plain, p) for p in rule.paths), rule.mode)
        return out.otherwise(self.default)

    def deletable(self, path: Column) -> Column:
        plain = F.regexp_replace(path, r"^(\./)+", "")
        out = F.when(F.lit(False), F.lit(False))
        for rule in self.rules:
            out = out.when(any_of(glob_matches(plain, p) for p in rule.paths), rule.allow_delete)
        return out.otherwise(True)

    def check(self, files: DataFrame) -> DataFrame:
        """``path, mode, readable, writable, executable``."""
        mode = F.col("mode")
        out = files.select("path", self.mode(F.col("path")).alias("mode"))
        return out.select("path", "mode", X.readable(mode).alias("readable"), X.writable(mode).alias("writable"), X.executable(mode).alias("executable"))
