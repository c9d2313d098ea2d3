"""Edges that no parser finds: tests by name, declared extensions, other repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.globs import glob_matches
from tessella.functions.text import file_name, parent

#: Endings of test names and of the sources they test.
SUFFIXES = [
    ("_test.go", ".go"),
    ("_test.rs", ".rs"),
    ("_test.cpp", ".cpp"),
    ("_test.rb", ".rb"),
    ("Test.cs", ".cs"),
    ("Tests.cs", ".cs"),
    ("Test.kt", ".kt"),
    ("Tests.kt", ".kt"),
    ("Test.php", ".php"),
    ("Tests.php", ".php"),
    ("Test.swift", ".swift"),
    ("Tests.swift", ".swift"),
    ("_test.exs", ".ex"),
    ("Spec.hs", ".hs"),
    ("Test.hs", ".hs"),
    ("Tests.hs", ".hs"),
    ("_SUITE.erl", ".erl"),
    ("Test.scala", ".scala"),
    ("Tests.scala", ".scala"),
    ("Spec.scala", ".scala"),
    ("_test.zig", ".zig"),
    ("_test.lua", ".lua"),
    ("_test.dart", ".dart"),
    ("_test.clj", ".clj"),
    ("_test.cljs", ".cljs"),
    ("_test.ml", ".ml"),
    ("_test.mli", ".mli"),
    ("_test.jl", ".jl"),
    ("Test.elm", ".elm"),
    ("Tests.elm", ".elm"),
    ("_test.nim", ".nim"),
]
#: Endings that count only if no beginning does.
LATER_SUFFIXES = [
    (".test.ts", ".ts"),
    (".spec.ts", ".ts"),
    ("Test.java", ".java"),
]
#: Beginnings of test names and the endings they are used with.
BEGINNINGS = [("test_", [".py", ".c", ".clj", ".cljs", ".r", ".jl", ".nim"]), ("test-", [".r"])]
#: Names of tests by the ending of a source; ``*`` is its stem.
TESTS_OF = {
    ".go": ["*_test.go"],
    ".py": ["test_*.py"],
    ".ts": ["*.test.ts", "*.spec.ts"],
    ".rs": ["*_test.rs"],
    ".java": ["*Test.java"],
    ".c": ["test_*.c"],
    ".cpp": ["*_test.cpp"],
    ".rb": ["*_test.rb"],
    ".cs": ["*Test.cs", "*Tests.cs"],
    ".kt": ["*Test.kt", "*Tests.kt"],
    ".php": ["*Test.php", "*Tests.php"],
    ".swift": ["*Test.swift", "*Tests.swift"],
    ".ex": ["*_test.exs"],
    ".exs": ["*_test.exs"],
    ".hs": ["*Spec.hs", "*Test.hs"],
    ".lhs": ["*Spec.lhs"],
    ".erl": ["*_SUITE.erl"],
    ".scala": ["*Test.scala", "*Spec.scala"],
    ".sc": ["*Test.sc"],
    ".zig": ["*_test.zig"],
    ".lua": ["*_test.lua", "*_spec.lua"],
    ".dart": ["*_test.dart"],
    ".clj": ["*_test.clj", "test_*.clj"],
    ".cljs": ["*_test.cljs"],
    ".ml": ["*_test.ml"],
    ".mli": ["*_test.mli"],
    ".r": ["test_*.r", "test-*.r"],
    ".jl": ["*_test.jl", "test_*.jl"],
    ".elm": ["*Test.elm", "*Tests.elm"],
    ".nim": ["*_test.nim", "test_*.nim"],
}


def source_name(name):
    """The name of the source that a test file's name points to, null if none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    cut = lambda n: F.substring(name, 1, F.length(name) - n)
    for test, source in SUFFIXES:
        out = out.when(name.endswith(test), F.concat(cut(len(test)), F.lit(source)))
    for start, ends in BEGINNINGS:
        rest = F.substring(name, len(start) + 1, 1 << 30)
        fits = F.lit(False)
        for e in ends:
            fits |= rest.endswith(e)
        out = out.when(name.startswith(start), F.when(fits, rest))
    for test, source in LATER_SUFFIXES:
        out = out.when(name.endswith(test), F.concat(cut(len(test)), F.lit(source)))
    return out


def test_names(name):
    """All names that tests of a source may have."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for end, tests in TESTS_OF.items():
        stem = F.substring(name, 1, F.length(name) - len(end))
        out = out.when(name.endswith(end), F.array(*[F.concat(F.lit(t.split("*")[0]), stem, F.lit(t.split("*")[1])) for t in tests]))
    return F.coalesce(out, F.array().cast("array<string>"))


def _sibling(path, name):
    return F.when(parent(path) == "", name).otherwise(F.concat(parent(path), F.lit("/"), name))


def test_edges(files: DataFrame) -> DataFrame:
    """``tested_by`` edges from tests to sources and ``tests`` edges from sources to tests.

    Both ends must be in ``files`` (``path``) and in one folder; candidates are
    derived from a name and matched by equality.
    """
    paths = files.select("path").distinct()
    name = file_name(F.col("path"))
    known = paths.select(F.col("path").alias("dst"))
    backward = paths.select(F.col("path").alias("src"), _sibling(F.col("path"), source_name(name)).alias("dst")).where("dst is not null")
    forward = paths.select(F.col("path").alias("src"), F.explode(test_names(name)).alias("n")).select("src", _sibling(F.col("src"), F.col("n")).alias("dst"))
    made = lambda df, rel: df.join(known, "dst", "left_semi").select("src", "dst", F.lit(rel).alias("rel"), F.lit("heuristic").alias("provenance"), F.lit(0.8).cast("float").alias("confidence"))
    return made(backward, "tested_by").union(made(forward, "tests"))


def extension_edges(files: DataFrame, pattern: str, relation: str) -> DataFrame:
    """Edges between all files of two globs, ``from → to``; none for a malformed pattern.

    The product is what the rule declares; it is only as large as the globs
    make it, and self-pairs are left out.
    """
    ends = [p.strip() for p in pattern.split("→", 1)]
    side = files.select("path").distinct()
    if len(ends) != 2 or not all(ends):
        side, ends = side.limit(0), ["*", "*"]
    src = side.where(glob_matches(F.col("path"), ends[0], lenient=True)).select(F.col("path").alias("src"))
    dst = side.where(glob_matches(F.col("path"), ends[1], lenient=True)).select(F.col("path").alias("dst"))
    return src.join(dst, F.col("src") != F.col("dst")).select("src", "dst", F.lit(relation).alias("rel"), F.lit("heuristic").alias("provenance"), F.lit(0.5).cast("float").alias("confidence"))


def mark_external(edges: DataFrame, mounts: DataFrame) -> DataFrame:
    """Edges into a mounted repository rewritten to ``external:<repo>:<path>``.

    ``mounts`` has ``prefix, repo``.  A target meets only the mounts that equal
    one of its own leading folders; the longest wins, then the name.
    """
    parts = F.split("dst", "/")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    targets = edges.select("dst").distinct().where("contains(dst, '/')")
    near = targets.select("dst", F.explode(heads).alias("prefix")).join(mounts, "prefix")
    best = near.groupBy("dst").agg(F.min(F.struct((-F.length("prefix")).alias("k"), "repo", "prefix")).alias("m"))
    best = best.select("dst", F.concat(F.lit("external:"), "m.repo", F.lit(":"), F.expr("substring(dst, length(m.prefix) + 2)")).alias("marked"))
    return edges.join(best, "dst", "left").select("src", F.coalesce("marked", "dst").alias("dst"), "rel", "provenance", "confidence")


def parse_external(node):
    """``repo`` and ``path`` of an external node, both null for others."""
    pattern = r"^external:([^:]*):(.*)$"
    part = lambda k: F.when(node.startswith("external:"), F.regexp_extract(node, pattern, k))
    return F.struct(part(1).alias("repo"), part(2).alias("path"))
