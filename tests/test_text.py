import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.globs import glob_matches, glob_regex
from tessella.operators import classify, context
from tessella.operators.permissions import Permissions, Rule
from tessella.operators.search import Index, fuse


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_tokens(spark):
    cases = {
        "HTTPServer": ["http", "server"],
        "AuthMiddleware": ["auth", "middleware"],
        "rate_limiter": ["rate", "limiter"],
        "parseJSON2XML": ["parse", "json2xml"],
        "aB": [],
        "ABc": ["bc"],
        "x2Y": ["x2y"],
        "2Yx": ["yx"],
        "XMLHttpRequest": ["xml", "http", "request"],
        "foo__Bar": ["foo", "bar"],
        "a b c": [],
        "": [],
    }
    assert column(spark, list(cases), X.tokens) == list(cases.values())


def test_paths(spark):
    paths = ["a/b/c.tar.gz", "x", ".env", "d/.hid"]
    assert column(spark, paths, X.extension) == ["gz", "", "", ""]
    assert column(spark, paths, X.parent) == ["a/b", "", "", "d"]
    assert column(spark, paths[:2], X.ancestors) == [["a/b", "a", ""], [""]]


def test_small_functions(spark):
    assert column(spark, ["user.vfs.role", "role"], X.attribute_key) == ["user.vfs.role"] * 2
    assert column(spark, ["500ms", "2s", "3m", "70", "x", "xms"], X.duration_ms) == [500, 2000, 0, 70, 0, 0]
    assert column(spark, ["500ms", "2s", "3m", "0", "xms", "xs"], X.debounce_ms) == [500, 2000, 500, 1, 500, 1000]
    assert column(spark, ["2500ms", "2s", "3m", "0", "x", "xm", "10ms"], X.timeout_seconds) == [2, 2, 180, 1, 30, 60, 1]
    assert column(spark, ["  a\n\n    b  \n"], X.minified) == ["a\n  b"]
    assert column(spark, ["src/a.go"], lambda p: X.rendered("fmt {{ .FilePath }} in {{ .ModulePath }}", p, p)) == ["fmt src/a.go in src"]
    assert column(spark, ["0"], lambda p: X.iso_time(p.cast("long"))) == ["1970-01-01T00:00:00Z"]
    assert X.task_words("Fix the_auth flow, fix it") == ["fix", "the", "auth", "flow", "fix"]


def test_globs(spark):
    match = lambda pattern, paths: column(spark, paths, lambda p: glob_matches(p, pattern))
    assert match("**/*.rs", ["a.rs", "x/y/a.rs", "a.rs.txt"]) == [True, True, False]
    assert match("src/**", ["src/a", "src/a/b", "lib/a"]) == [True, True, False]
    assert match("*.go", ["a.go", "x/a.go"]) == [True, True]  # a star also crosses folders
    assert match("a[!b-d]?", ["axz", "abz"]) == [True, False]
    assert glob_regex("a**") is None and glob_regex("[") is None
    assert column(spark, ["x/README"], lambda p: glob_matches(p, "**/[", lenient=True)) == [False]


def test_permissions(spark):
    rules = Permissions((Rule(("**/*.rs",), 0o444), Rule(("src/main.rs",), 0o644)), {"readonly-dep": 0o444})
    rows = spark.createDataFrame([("src/main.rs",), ("readonly-dep/src/x.py",), ("other.txt",)], "path string")
    got = {r["path"]: (r["mode"], r["writable"], r["executable"]) for r in rules.check(rows).collect()}
    assert got == {"src/main.rs": (0o444, False, False), "readonly-dep/src/x.py": (0o444, False, False), "other.txt": (0o644, True, False)}
    nothing = Permissions((Rule(("secrets/**",), 0),)).check(spark.createDataFrame([("secrets/k",)], "path string")).first()
    assert not (nothing["readable"] or nothing["writable"] or nothing["executable"])


@pytest.mark.parametrize(
    ("paths", "want"),
    [
        (["src/foo_test.go", "lib/baz.test.ts", "spec/qux_spec.rb", "src/FooTest.java", "tests/json.rs", "benches/graph_bench.rs", "crates/ignore/tests/x.rs", "tests\\json.rs"], True),
        (["src/main.rs", "lib/util.py", "src/test_utils.rs", "crates/globset/src/test_util.rs"], False),
    ],
)
def test_test_paths(spark, paths, want):
    assert set(column(spark, paths, classify.is_test_path)) == {want}


def test_features(spark):
    paths = ["src/auth/login.go", "src/payments/internal/handler.go", "lib/utils.go", "README.md", ".github/workflows/ci.yaml", "src/main.rs"]
    assert column(spark, paths, classify.feature) == ["auth-module", "payments-module", "lib-module", None, None, "main.rs-module"]
    assert column(spark, paths[:1], lambda p: classify.feature(p, strategy="none")) == [None]


def test_null_and_unknown_files(spark):
    rows = spark.createDataFrame([("x.go", None), ("noext", "def "), ("a/__tests__/b", "")], "path string, text string")
    assert {r["path"]: r["role"] for r in classify.classified(rows).collect()} == {"x.go": "unknown", "noext": "unknown", "a/__tests__/b": "test"}


DOCS = [("handler.go", ["AuthHandler"]), ("middleware.go", ["AuthMiddleware"]), ("query.go", ["RunQuery"])]


def test_search(spark):
    docs = spark.createDataFrame([("auth/handler.go", []), ("auth/middleware.go", []), ("db/run/query.go", [])], "path string, symbols array<string>")
    index = Index(docs)
    scores = {r["path"]: round(r["score"], 9) for r in index.tfidf("auth").collect()}
    assert scores == {"auth/handler.go": 0.405465108, "auth/middleware.go": 0.405465108}
    assert index.tfidf("go").isEmpty() and index.bm25("go").count() == 3
    assert index.search("").isEmpty()
    best = [r["file_path"] for r in index.search("auth middleware").collect()]
    assert best == ["auth/middleware.go", "auth/handler.go"]


def test_stored_index(spark, tmp_path):
    index = Index(spark.createDataFrame(DOCS, "path string, symbols array<string>"))
    stored = index.write(f"file://{tmp_path}/index")
    want = [tuple(r) for r in index.search("auth query").collect()]
    assert [tuple(r) for r in stored.search("auth query").collect()] == want and want


def test_fusion(spark):
    a = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "path string, score double")
    b = spark.createDataFrame([("b", 2.0), ("c", 1.0)], "path string, score double")
    got = [(r["path"], r["score"]) for r in fuse(a, b).orderBy(F.desc("score")).collect()]
    assert got == [("b", 1 / 62 + 1 / 61), ("a", 1 / 61), ("c", 1 / 62)]


def test_positions(spark):
    rows = spark.range(5).select(context.interleaved(F.col("id"), F.lit(5)).alias("p")).collect()
    assert sorted(range(5), key=lambda i: rows[i]["p"]) == [0, 4, 1, 3, 2]
    assert [r[0] for r in spark.range(2).select(context.interleaved(F.col("id"), F.lit(2))).collect()] == [0, 1]


def test_understand_with_sources(spark):
    from tessella.schema import EDGE

    edges = spark.createDataFrame([("src/auth.go", "std:fmt", "imports", "ast_exact", 1.0), ("src/main.go", "src/auth.go", "imports", "ast_exact", 1.0)], EDGE)
    sources = spark.createDataFrame([("src/auth.go", "package a\n\n  func F() {}\n")], "path string, text string")
    symbols = spark.createDataFrame([("src/auth.go", "F", 3, "func F() {}")], "path string, name string, line int, signature string")
    out = context.understand(edges, "fix auth", sources, symbols)
    assert out["anchors"] == ["src/auth.go"]
    assert "src/auth.go → F\n" in out["text"] and "src/auth.go:3  func F() {}\n" in out["text"]
    assert "src/auth.go [provenance=ast_exact, score=1.00]\npackage a\n  func F() {}\n" in out["text"]
    assert [f["path"] for f in out["files"]] == ["src/auth.go", "src/main.go", "std:fmt"]
    flat = context.understand(edges, "fix auth", sources, options=context.Options(flat=True))["text"]
    assert flat.startswith("## DETAIL (flat)\n\nsrc/auth.go") and "(source unavailable)" in flat
    tiny = context.understand(edges, "fix auth", sources, options=context.Options(token_budget=5))["text"]
    assert tiny.endswith("<source (whitespace-minified)>\n\n")
