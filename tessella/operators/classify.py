"""Roles of source files from path and content, as one native expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.languages import CLASSIFIED, language
from tessella.functions.text import any_of, extension

#: Paths of tests (lower case).  None of these patterns needs look-around.
TEST_PATH = (
    r"_test\.|\.test\.|_spec\.|__test__|^test_|^test-.*\.r$"
    r"|(^|[/\\])(tests?|benches|__tests__)([/\\]|$)"
    r"|(tests?\.(java|cs|kt|php|swift|hs|scala|elm)|spec\.(hs|scala)|_suite\.erl|runtests\.jl)$"
)
#: Names of entry points (lower case), without a boundary in front.
ENTRY_PATH = (
    r"(main\.(rs|go|py|c|cpp|js|ts|rb|kt|swift|hs|lhs|erl|scala|zig|lua|dart|clj|ml|r|jl|elm|nim)"
    r"|index\.(js|ts|php)|__main__\.py|program\.cs|mix\.exs|application\.ex|escript\.erl|app\.scala|init\.lua|core\.clj)$"
)
#: Marks of generated files.
GENERATED_PATHS, GENERATED_TEXTS = [".pb.go", ".gen.go", ".generated."], ["DO NOT EDIT", "auto-generated", "Code generated by"]
#: Configuration file endings.
CONFIG = [".toml", ".yaml", ".yml", ".json", ".lock", ".cfg", ".ini", ".env"]

#: Regular expressions over the whole text that mark an entry point of a language.
ENTRY_TEXT = {
    "rust": r"(?m)^[ \t]*fn main\(",
    "python": r"if __name__ == (\"__main__\"|'__main__')",
    "go": r"func main\(\)",
    "javascript": r"module\.exports|export default|exports\.",
    "typescript": r"module\.exports|export default|exports\.",
    "java": r"public static void main\(",
    "c": r"(int|void) main[ \t]*\([^;]*\)\s*\{",
    "cpp": r"(int|void) main[ \t]*\([^;]*\)\s*\{",
    "ruby": r"(?m)^[ \t]*#!/usr/bin/env ruby",
    "csharp": r"static (void|async Task) Main\(",
    "kotlin": r"(?m)^[ \t]*fun main\(",
    "php": r"(?m)^[ \t]*#!/usr/bin/(env )?php",
    "swift": r"@(main|UIApplicationMain|NSApplicationMain)\b",
    "elixir": r"def main\(|(?m)^[ \t]*#!",
    "haskell": r"(?m)^[ \t]*main",
    "erlang": r"-module\(main\)|(?m)^[ \t]*#!",
    "scala": r"def main\(|@main|extends App",
    "zig": r"pub fn main\(",
    "lua": r"\A#!",
    "dart": r"main\(\)|main\(List",
    "clojure": r"\(-main|\A#!",
    "ocaml": r"\A#!",
    "r": r"(?m)^[ \t]*#!",
    "julia": r"function main\(|(?m)^[ \t]*#!",
    "elm": r"(?m)^[ \t]*main[ =]",
}
#: What makes a library: each inner list is alternatives, all lists are needed.
PUBLIC = {
    "python": [["__all__", "def ", "class "]],
    "javascript": [["export ", "module.exports"]],
    "typescript": [["export ", "module.exports"]],
    "java": [["public class", "public interface"]],
    "ruby": [["def "], ["module ", "class "]],
    "csharp": [["public class", "public interface", "public static"]],
    "kotlin": [["class ", "object ", "fun "]],
    "php": [["function "], ["class ", "interface "]],
    "swift": [["public "], ["func ", "struct ", "class "]],
    "elixir": [["defmodule ", "def "]],
    "haskell": [["module "], ["where"]],
    "erlang": [["-export("]],
    "scala": [["class ", "object ", "trait ", "def "]],
    "zig": [["pub "]],
    "lua": [["function ", "return ", "local M"]],
    "dart": [["class ", "void ", "typedef "]],
    "clojure": [["(defn ", "(defmacro ", "(defrecord ", "(defprotocol ", "(def "]],
    "ocaml": [["let ", "type ", "module "]],
    "r": [["function(", "function (", "<- "]],
    "julia": [["function ", "struct ", "module ", "const "]],
    "nim": [["proc*", "func*", "type*", "var*", "const*", "macro*", "template*"]],
}


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATH)


def is_entry_path(path: Column) -> Column:
    return F.lower(path).rlike(ENTRY_PATH)


def is_generated(path: Column, text: Column) -> Column:
    return any_of(path.contains(p) for p in GENERATED_PATHS) | any_of(F.coalesce(text, F.lit("")).contains(m) for m in GENERATED_TEXTS)


def has_entry_text(lang: Column, text: Column) -> Column:
    found = any_of((lang == name) & text.rlike(pattern) for name, pattern in ENTRY_TEXT.items())
    return found | ((lang == "nim") & text.contains("isMainModule") & text.contains("when"))


def has_public_api(lang: Column, text: Column) -> Column:
    out = F.lit(False)
    for name, groups in PUBLIC.items():
        every = F.lit(True)
        for group in groups:
            every &= any_of(text.contains(g) for g in group)
        out |= (lang == name) & every
    out |= (lang == "rust") & (F.regexp_count(text, F.lit(r"(?m)^[ \t]*pub (async )?fn")) >= 3)
    out |= (lang == "go") & text.rlike(r"(?m)^\s*(func|type) +\p{Lu}")
    out |= lang.isin("c", "cpp") & (F.regexp_count(text, F.lit(r"\);")) >= 2)
    return out | ((lang == "elm") & ((text.contains("module ") & text.contains("exposing")) | text.contains("type ")))


def path_role(path: Column) -> Column:
    """example, config, script or unknown."""
    low = F.lower(path)
    example = low.contains("/example") | low.contains("\\examples\\") | low.rlike(r"^examples?/")
    return (
        F.when(example, "example")
        .when(any_of(low.endswith(e) for e in CONFIG), "config")
        .when(low.contains("/scripts/") | low.contains("\\scripts\\"), "script")
        .otherwise("unknown")
    )


def classified(files: DataFrame) -> DataFrame:
    """``files`` (``path, text``) with ``language, role, status``.

    The first that holds: generated, test, entry by name, entry by content,
    public API, then the folder.  Null texts count as empty.  Files of no known
    language get the role of their path only.
    """
    path, text = F.col("path"), F.coalesce(F.col("text"), F.lit(""))
    lang = F.col("language")
    out = files.withColumn("language", language(F.lower(extension(path)), CLASSIFIED))
    role = (
        F.when(is_generated(path, text), "generated")
        .when(is_test_path(path), "test")
        .when(is_entry_path(path) | has_entry_text(lang, text), "entrypoint")
        .when(has_public_api(lang, text), "library")
        .otherwise(path_role(path))
    )
    low = F.lower(path)
    library = F.when(low.contains("/src/") & ~low.contains("/test") & ~low.contains("/example"), "stable").otherwise("beta")
    r = F.col("role")
    status = F.when(r == "generated", "generated").when(r.isin("test", "script"), "beta").when(r == "library", library).when(r == "unknown", "unknown").otherwise("stable")
    return out.withColumn("role", role).withColumn("status", status)


def feature(path: Column, overrides: dict[str, str] | None = None, strategy: str = "directory") -> Column:
    """The feature of a path: an override, or ``<folder>-module`` from the folders; null if none.

    An override key that ends in ``/`` holds for what is below it, the longest
    first; an empty override means none.
    """
    rules = sorted((overrides or {}).items(), key=lambda kv: (kv[0].endswith("/"), -len(kv[0]), kv[0]))
    plain = F.translate(path, "\\", "/")
    after_src = F.regexp_extract(plain, r"^(?:.*?/src/|src/|.*?src/)([^/]+)", 1)
    slashed = F.regexp_extract(plain, r"^.*?/src/([^/]+)", 1)
    parts = F.filter(F.split(plain, "/"), lambda p: p != "")
    first = F.element_at(parts, 1)
    found = (
        F.when(slashed != "", F.concat(slashed, F.lit("-module")))
        .when(after_src != "", F.concat(after_src, F.lit("-module")))
        .when((F.size(parts) < 2) | first.startswith(".") | (first == "src"), F.lit(None))
        .otherwise(F.concat(first, F.lit("-module")))
    )
    if strategy != "directory":
        found = F.lit(None).cast("string")
    out = None
    for key, value in rules:
        hit = path.startswith(key) if key.endswith("/") else path == key
        value = F.lit(value or None).cast("string")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return found if out is None else out.otherwise(found)


def histogram(files: DataFrame, column: str) -> DataFrame:
    """``column, cnt``, most frequent first."""
    return files.groupBy(column).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), column)


def attributes(files: DataFrame) -> DataFrame:
    """``path, key, value`` rows of role, status and feature."""
    keys = F.array(*[F.struct(F.lit(f"user.vfs.{k}").alias("key"), F.col(k).alias("value")) for k in ("role", "status", "feature")])
    full = classified(files).withColumn("feature", feature(F.col("path")))
    return full.select("path", F.explode(keys).alias("e")).select("path", "e.key", "e.value").where("value is not null")
