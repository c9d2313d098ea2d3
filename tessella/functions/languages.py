"""File extensions of the 26 languages, and which files the scans skip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are parsed for imports.
PARSED = {
    "go": ["go"],
    "python": ["py"],
    "typescript": ["ts", "tsx"],
    "rust": ["rs"],
    "javascript": ["js", "jsx"],
    "java": ["java"],
    "c": ["c"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx"],
    "ruby": ["rb"],
    "csharp": ["cs"],
    "kotlin": ["kt", "kts"],
    "php": ["php", "phtml"],
    "swift": ["swift"],
    "elixir": ["ex", "exs"],
    "haskell": ["hs", "lhs"],
    "erlang": ["erl", "hrl"],
    "scala": ["scala", "sc"],
    "zig": ["zig"],
    "lua": ["lua"],
    "dart": ["dart"],
    "clojure": ["clj", "cljs", "cljc", "edn"],
    "ocaml": ["ml", "mli"],
    "r": ["r", "R"],
    "julia": ["jl"],
    "elm": ["elm"],
    "nim": ["nim"],
}
#: Headers are classified as C but never parsed for imports.
CLASSIFIED = PARSED | {"c": ["c", "h"], "r": ["r"]}
#: Parsed by name, but not collected by a scan.
NOT_COLLECTED = {"hpp", "hxx", "R"}
#: Folders that the two scans skip.
SKIPPED_BY_BUILD = ["target", "node_modules", "vendor", "__pycache__", ".venv"]
SKIPPED_BY_CLASSIFY = [".git", "target", "node_modules", ".vfs", "vendor", "__pycache__"]
#: The one extension that a language filter keeps.
FILTER = {name: found[0] for name, found in PARSED.items()}


def language(extension: Column, table: dict[str, list[str]] = PARSED) -> Column:
    """The language of an extension, null if none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, found in table.items():
        out = out.when(extension.isin(found), F.lit(name))
    return out


def collected() -> list[str]:
    return [e for found in PARSED.values() for e in found if e not in NOT_COLLECTED]
