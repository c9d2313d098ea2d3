"""Import edges and symbols from source text, by masked regular expressions.

Comments are blanked first (strings stay), then each language's patterns are
applied to the whole text; all but two languages are native expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.languages import language
from tessella.functions.text import extension

_STRING = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`"
#: Comments by family; strings are matched first, so that marks inside them do not count.
COMMENTS = {
    "slash": rf"({_STRING})|//[^\n]*|/\*[\s\S]*?\*/",
    "hash": rf"({_STRING})|#[^\n]*",
    "dash": r"(\"(?:\\.|[^\"\\\n])*\")|--[^\n]*|\{-[\s\S]*?-\}",
    "lua": rf"({_STRING})|--\[\[[\s\S]*?\]\]|--[^\n]*",
    "percent": r"(\"(?:\\.|[^\"\\\n])*\")|%[^\n]*",
    "semicolon": r"(\"(?:\\.|[^\"\\])*\")|;[^\n]*",
    "ocaml": r"(\"(?:\\.|[^\"\\])*\")|\(\*[\s\S]*?\*\)",
}
FAMILY = {
    **dict.fromkeys(["go", "typescript", "javascript", "rust", "java", "c", "cpp", "csharp", "kotlin", "php", "swift", "scala", "zig", "dart"], "slash"),
    **dict.fromkeys(["python", "ruby", "elixir", "r", "julia", "nim"], "hash"),
    **dict.fromkeys(["haskell", "elm"], "dash"),
    "lua": "lua",
    "erlang": "percent",
    "clojure": "semicolon",
    "ocaml": "ocaml",
}


def _pkg(x: Column) -> Column:
    return F.concat(F.lit("pkg:"), x)


def _local(x: Column) -> Column:
    return F.concat(F.lit("local:"), x)


def _go(x: Column) -> Column:
    return F.concat(F.when(x.contains("."), "pkg:").otherwise("std:"), x)


def _script(x: Column) -> Column:
    return F.concat(F.when(x.startswith(".") | x.startswith("/"), "local:").otherwise("pkg:"), x)


def _include(x: Column) -> Column:
    name = F.substring(x, 2, F.length(x) - 2)
    return F.concat(F.when(x.startswith('"'), "local:").otherwise("sys:"), name)


def _dart(x: Column) -> Column:
    return F.when(x.startswith("package:"), _pkg(F.substring(x, 9, 1 << 20))).when(x.startswith("dart:"), F.concat(F.lit("std:"), F.substring(x, 6, 1 << 20))).otherwise(_local(x))


def _nim(x: Column) -> Column:
    return F.when(x.startswith("std/"), F.concat(F.lit("std:"), F.substring(x, 5, 1 << 20))).otherwise(_pkg(x))


@dataclass(frozen=True)
class Rule:
    """Group 1 of every match of ``pattern``, within the matches of ``block`` if given."""

    pattern: str
    target: Callable[[Column], Column] = _pkg
    block: str | None = None


RULES: dict[str, list[Rule]] = {
    "go": [Rule(r'"([^"\n]+)"', _go, r'(?m)^[ \t]*import\s*(\([^)]*\)|[^\n(]+)')],
    "python": [Rule(r"(?m)^[ \t]*(?:import|from)[ \t]+(\S+)")],
    "typescript": [Rule(r"(?m)^[ \t]*import\b[^'\";]*['\"]([^'\"\n]+)['\"]", _script), Rule(r"(?<![\w.])require\(\s*['\"]([^'\"\n]+)['\"]", _script)],
    "java": [Rule(r"(?m)^[ \t]*import\s+([^;]*[^;\s])\s*;")],
    "c": [Rule(r"(?m)^[ \t]*#[ \t]*include[ \t]*(\"[^\"\n]+\"|<[^>\n]+>)", _include)],
    "ruby": [Rule(r"(?m)^[ \t]*require[ \t(]\s*['\"]([^'\"\n]+)['\"]")],
    "csharp": [Rule(r"(?m)^[ \t]*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;")],
    "kotlin": [Rule(r"(?m)^[ \t]*import[ \t]+(\S+)")],
    "php": [Rule(r"(?m)^[ \t]*use[ \t]+(?:(?:function|const)[ \t]+)?([^;{\s]+?)\\?\s*(?:[;{]|[ \t]as\b)")],
    "swift": [Rule(r"(?m)^[ \t]*(?:@testable[ \t]+)?import[ \t]+([^.\n]*[^.\s])")],
    "elixir": [Rule(r"(?m)^[ \t]*(?:alias|import|require|use)[ \t]+([^,\s]+)")],
    "haskell": [Rule(r"(?m)^import[ \t]+(?:qualified[ \t]+)?(\S+)")],
    "erlang": [Rule(r"-include(?:_lib)?\(\s*\"([^\"\n]+)\"", _local)],
    "scala": [Rule(r"(?m)^[ \t]*import[ \t]+([^{\n]*?)\.?[ \t]*(?:\{|$)")],
    "zig": [Rule(r"@import\(\"([^\"\n]+)\"", _local)],
    "lua": [Rule(r"\brequire[( ]\s*['\"]\s*([^'\"\n]*[^'\"\s])\s*['\"]")],
    "dart": [Rule(r"(?m)^[ \t]*(?:import|export)[ \t]+['\"]([^'\"\n]+)['\"]", _dart)],
    "ocaml": [Rule(r"(?m)^[ \t]*(?:open!?|include)[ \t]+([A-Z][\w.']*)"), Rule(r"(?m)^[ \t]*#(?:load|use)[ \t]+\"([^\"\n]+)\"", _local)],
    "r": [Rule(r"\b(?:library|require)\(\s*['\"]?([^'\",)\s]+)"), Rule(r"\bsource\(\s*['\"]([^'\"\n]+)['\"]", _local)],
    "julia": [Rule(r"(?m)^[ \t]*(?:using|import)[ \t]+(\p{L}[^:\s]*)"), Rule(r"(?m)^[ \t]*include[( ]\s*\"([^\"\n]+)\"", _local)],
    "elm": [Rule(r"(?m)^import[ \t]+(\S+)")],
    "nim": [Rule(r"(?:^|,)[ \t]*(\p{L}[\w/.]*)", _nim, r"(?m)^[ \t]*import[ \t]+([^\n]+)"), Rule(r"(?m)^[ \t]*from[ \t]+(\S+)[ \t]+import", _nim)],
}
RULES["javascript"], RULES["cpp"] = RULES["typescript"], RULES["c"]
#: Languages whose import syntax nests; they are parsed in Python.
NESTED = ("rust", "clojure")


def masked(text: Column, lang: str) -> Column:
    return F.regexp_replace(text, COMMENTS[FAMILY[lang]], "$1")


def _all_of(pattern: str):
    return lambda b: F.regexp_extract_all(b, F.lit(pattern), F.lit(1))


def targets(text: Column, lang: str) -> Column:
    """All import targets of a text of one language (not a nested one), in pattern order."""
    clean, found = masked(text, lang), []
    for rule in RULES[lang]:
        if rule.block:
            blocks = F.regexp_extract_all(clean, F.lit(rule.block), F.lit(1))
            hit = F.flatten(F.transform(blocks, _all_of(rule.pattern)))
        else:
            hit = F.regexp_extract_all(clean, F.lit(rule.pattern), F.lit(1))
        found.append(F.transform(F.filter(hit, lambda x: x != ""), rule.target))
    return F.concat(*found)


def rust_targets(text: str, modules: dict[str, str] | None = None) -> list[str]:
    """Targets of ``use`` and ``extern crate``.

    A plain use gives its crate, a group each member with its full path; names
    after ``as`` do not count, ``self`` and ``super`` paths are skipped, and
    ``crate`` paths count only with ``modules`` (module path to file).
    """
    clean = re.sub(COMMENTS["slash"], lambda m: m.group(1) or "", text)
    out = [f"pkg:{m}" for m in re.findall(r"(?m)^\s*extern\s+crate\s+(\w+)", clean)]
    for body in re.findall(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", clean):
        grouped = "{" in body
        for path in _members(re.sub(r"\s+", " ", body.strip())):
            parts = [p for p in path.split("::") if p]
            if not parts or parts[0] in ("self", "super"):
                continue
            if parts[0] == "crate" or (modules and parts[0] in modules):
                inner = parts[1:] if parts[0] == "crate" else parts
                hits = [modules["::".join(inner[:k])] for k in range(len(inner), 0, -1) if "::".join(inner[:k]) in (modules or {})]
                out += hits[:1]
            else:
                out.append("pkg:" + ("::".join(parts) if grouped else parts[0]))
    return list(dict.fromkeys(out))


def _members(body: str, prefix: str = "") -> list[str]:
    body = body.strip()
    if "{" not in body:
        name = re.sub(r"\s+as\s+\w+$", "", body).strip()
        if name == "self":
            return [prefix.removesuffix("::")]
        return [prefix + name] if name else []
    head, rest = body.split("{", 1)
    rest = rest[: rest.rindex("}")]
    out, depth, item = [], 0, ""
    for c in rest + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            out += _members(item, prefix + head.strip())
            item = ""
        else:
            item += c
    return out


def clojure_targets(text: str) -> list[str]:
    """Dotted namespaces of require and use forms, and the first class of an import form."""
    clean = re.sub(COMMENTS["semicolon"], lambda m: m.group(1) or "", text)
    out = []
    for m in re.finditer(r"\(\s*(:?)(require|use|import)\s", clean):
        depth, end = 1, m.end()
        while end < len(clean) and depth:
            depth += (clean[end] == "(") - (clean[end] == ")")
            end += 1
        body = clean[m.end() : end - 1]
        if m.group(2) == "import":
            words = [w for w in re.split(r"[\[\](){}\s]+", body) if w.strip("'") and not w.startswith(":")]
            out += [f"pkg:{words[0].strip(chr(39))}"] if words else []
        else:
            for part in body.split("["):
                part = part.strip()
                words = [w.strip("'") for w in re.split(r"[\s\]]+", part) if w.strip("'")]
                words = [w for w in words if not w.startswith(":") and re.fullmatch(r"[\w.\-]+", w)]
                if part and not part.startswith(":") and words and "." in words[0] and not words[0].startswith("-"):
                    out.append(f"pkg:{words[0]}")
    return list(dict.fromkeys(out))


def import_edges(files: DataFrame, modules: dict[str, str] | None = None) -> DataFrame:
    """``imports`` edges of ``files`` (``path, text``), each once; unknown languages and null texts give none.

    A map over files; only the two nested languages go through Python.
    """
    src = files.select("path", "text", language(extension(F.col("path"))).alias("language")).where("language is not null and text is not null")
    native = F.when(F.lit(False), F.array().cast("array<string>"))
    for lang in RULES:
        native = native.when(F.col("language") == lang, targets(F.col("text"), lang))
    plain = src.where(~F.col("language").isin(*NESTED)).select(F.col("path").alias("src"), F.explode(F.array_distinct(native)).alias("dst"))

    def nested(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for path, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = rust_targets(text, modules) if lang == "rust" else clojure_targets(text)
                a += [path] * len(found)
                b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["src", "dst"])

    deep = src.where(F.col("language").isin(*NESTED)).mapInArrow(nested, "src string, dst string")
    return plain.union(deep).select("src", "dst", F.lit("imports").alias("rel"), F.lit("ast_exact").alias("provenance"), F.lit(1.0).cast("float").alias("confidence"))


#: Lines that define a symbol, by language; group 1 is the name.
_MOD = r"(?:(?:public|private|protected|internal|open|override|static|final|abstract|sealed|data|async|export|default|partial|suspend|inline)\s+)*"
SYMBOLS = {
    "go": r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+|var\s+|const\s+)(\w+)",
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)",
    "typescript": rf"^\s*{_MOD}(?:function\*?|class|interface|type|enum)\s+(\w+)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const)\s+)*(?:fn|struct|enum|trait|impl(?:<[^>]*>)?|mod|macro_rules!)\s+(\w+)",
    "java": rf"^\s*{_MOD}(?:class|interface|enum|record)\s+(\w+)",
    "c": r"^(?:[A-Za-z_][\w\s*:<>,&]*?\s[*&]*)(\w+)\s*\([^;]*$",
    "ruby": r"^\s*(?:def\s+(?:self\.)?|class\s+|module\s+)(\w+[?!]?)",
    "csharp": rf"^\s*{_MOD}(?:class|interface|struct|enum|record)\s+(\w+)",
    "kotlin": rf"^\s*{_MOD}(?:fun|class|interface|object)\s+(\w+)",
    "php": rf"^\s*{_MOD}(?:function|class|interface|trait)\s+(\w+)",
    "swift": rf"^\s*{_MOD}(?:func|class|struct|enum|protocol|extension)\s+(\w+)",
    "elixir": r"^\s*(?:def|defp|defmodule|defmacro)\s+([\w.]+)",
    "haskell": r"^(?:data|newtype|type|class)\s+(\w+)|^(\w+)\s*::",
    "erlang": r"^([a-z]\w*)\(.*->",
    "scala": rf"^\s*(?:(?:case|implicit|lazy|private|protected|override|final|sealed|abstract)\s+)*(?:def|class|object|trait)\s+(\w+)",
    "zig": r"^\s*(?:pub\s+)?(?:fn|const|var)\s+(\w+)",
    "lua": r"^\s*(?:local\s+)?function\s+([\w.:]+)",
    "dart": r"^\s*(?:abstract\s+)?(?:class|enum|mixin|typedef)\s+(\w+)",
    "clojure": r"^\((?:defn-?|def|defmacro|defrecord|defprotocol)\s+(\S+)",
    "ocaml": r"^\s*(?:let(?:\s+rec)?|type|module)\s+(\w+)",
    "r": r"^\s*([\w.]+)\s*(?:<-|=)\s*function\b",
    "julia": r"^\s*(?:function|struct|mutable struct|module|macro)\s+(\w+)",
    "elm": r"^(?:type(?:\s+alias)?)\s+(\w+)|^([a-z]\w*)\s*:",
    "nim": r"^\s*(?:proc|func|method|template|macro|type)\s+(\w+)",
}
SYMBOLS["javascript"], SYMBOLS["cpp"] = SYMBOLS["typescript"], SYMBOLS["c"]


def symbols(files: DataFrame) -> DataFrame:
    """``path, name, line, signature`` (lines from 1, trimmed) of the definitions in each file."""
    src = files.select("path", "text", language(extension(F.col("path"))).alias("language")).where("language is not null and text is not null")
    lines = src.select("path", "language", F.posexplode(F.split("text", "\n")).alias("line", "signature"))
    name = F.when(F.lit(False), F.lit(""))
    for lang, pattern in SYMBOLS.items():
        first = F.regexp_extract("signature", pattern, 1)
        if re.compile(pattern).groups > 1:
            first = F.when(first != "", first).otherwise(F.regexp_extract("signature", pattern, 2))
        name = name.when(F.col("language") == lang, first)
    return lines.select("path", name.alias("name"), (F.col("line") + 1).alias("line"), F.trim("signature").alias("signature")).where("name <> ''")
