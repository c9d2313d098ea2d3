"""Worked cases and randomised graphs against plain Python."""

import random
from collections import defaultdict

import pytest

from tessella.operators import associate, graph
from tessella.schema import EDGE, edges_of, weight
from tessella.sources.edges import EdgeStore, distinct_edges, read_lines


def edges(spark, rows):
    full = [(*r, *("imports", "ast_exact", 1.0)[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame(full, EDGE)


def found(df):
    return {(r["path"], r["depth"]) for r in df.collect()}


CHAIN = [("a", "b"), ("b", "c"), ("c", "d")]


@pytest.mark.parametrize(
    ("rows", "start", "depth", "want"),
    [
        (CHAIN[:2], "c", 10, {("b", 1), ("a", 2)}),
        (CHAIN, "d", 3, {("c", 1), ("b", 2), ("a", 3)}),
        ([("a", "b"), ("b", "a")], "a", 10, {("b", 1)}),
        (CHAIN[:2], "c", 0, set()),
        (CHAIN[:2], "c", 1, {("b", 1)}),
        ([], "x", 10, set()),
    ],
)
def test_impact(spark, rows, start, depth, want):
    assert found(graph.impact(edges(spark, rows), start, depth)) == want


def test_impact_of_unknown_node_fails(spark):
    with pytest.raises(ValueError, match="not in the graph"):
        graph.impact_or_fail(edges(spark, CHAIN), "x")
    assert found(graph.impact_or_fail(edges(spark, CHAIN), "b")) == {("a", 1)}


def test_external_impact(spark):
    e = edges(spark, [("auth/handler.go", "external:shared:pkg/utils.go"), ("pay/handler.go", "shared/pkg/utils.go"), ("auth/router.go", "auth/handler.go")])
    assert found(graph.impact(e, "shared/pkg/utils.go")) == {("pay/handler.go", 1)}
    assert found(graph.impact(e, "shared/pkg/utils.go", external=True)) == {("pay/handler.go", 1), ("auth/handler.go", 1), ("auth/router.go", 2)}


def test_package_importers_count(spark):
    e = edges(spark, [("x.rs", "pkg:util"), ("y.rs", "lib/util/src/a.rs")])
    packages = graph.packages_of(spark.createDataFrame([("lib/util/src/a.rs",)], "node string"), spark.createDataFrame([("lib/util", "util"), ("", "top")], "dir string, name string"))
    assert found(graph.impact(e, "lib/util/src/a.rs", package=packages)) == {("x.rs", 1), ("y.rs", 1)}


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(60)})
    into = defaultdict(set)
    for a, b in rows:
        into[b].add(a)
    want, level, seen = set(), {"n3"}, {"n3"}
    for d in range(1, 5):
        level = {a for b in level for a in into[b]} - seen
        seen |= level
        want |= {(n, d) for n in level}
    e = edges(spark, rows)
    assert found(graph.impact(e, "n3", 4)) == want
    targets = {b for _, b in rows}
    assert {r["path"] for r in graph.orphans(e).collect()} == {a for a, _ in rows} - targets


def test_stats(spark):
    e = edges(spark, [("a.go", "std:fmt"), ("b.go", "std:os"), ("c.go", "std:fmt"), ("a_test.go", "a.go", "tested_by")])
    s = graph.stats(e).first()
    assert (s["total_edges"], s["total_files"], s["unique_dependencies"], s["most_connected"]) == (4, 4, 3, "std:fmt")
    assert {r["path"] for r in graph.orphans(e).collect()} == {"a_test.go", "b.go", "c.go"}
    assert {(r["rel"], r["cnt"]) for r in graph.edge_types(e).collect()} == {("imports", 3), ("tested_by", 1)}


def test_untested_and_module(spark):
    e = edges(spark, [("src/main.go", "pkg/utils.go"), ("src/auth.go", "pkg/crypto.go"), ("src/auth_test.go", "src/auth.go", "tested_by")])
    assert [r["path"] for r in graph.untested(e).collect()] == ["src/main.go"]
    m = edges(spark, [("src/auth/login.go", "pkg/crypto.go"), ("src/auth/session.go", "pkg/crypto.go"), ("src/auth/login_test.go", "src/auth/login.go", "tested_by"), ("src/main/server.go", "src/auth/login.go")])
    s = graph.module_stats(m, "src/auth").first()
    assert (s["file_count"], s["edge_count"], s["coverage"]) == (3, 4, 33.3)
    assert graph.module_stats(m, "nothing").first()["coverage"] == 0.0


def test_empty_graph(spark):
    e = edges(spark, [])
    s = graph.stats(e).first()
    assert (s["total_edges"], s["most_connected"], s["tested_pct"]) == (0, None, 0.0)
    assert graph.untested(e).isEmpty() and graph.top_dependencies(e).isEmpty()


def test_store(spark, tmp_path):
    store = EdgeStore(spark, f"file://{tmp_path}/graph").init().init()
    assert store.raw().isEmpty()
    three = edges(spark, CHAIN)
    assert store.append_new(three) == 3
    assert store.append_new(three) == 0
    assert store.append_new(edges(spark, [("a", "b"), ("n", "m"), ("n", "m")])) == 2  # duplicates in a batch are all written
    assert store.counts() == (5, 4)
    assert store.rebuild().count() == 4
    store.clean()
    assert store.raw().isEmpty()


def test_old_and_broken_lines(spark, tmp_path):
    (tmp_path / "edges.jsonl").write_text('{"from":"a","to":"b","rel":"imports"}\n\nnot json\n{"to":"b","rel":"x"}\n{"from":"a","to":"c","rel":"imports","provenance":"heuristic","confidence":0.5,"more":1}\n')
    got = sorted(tuple(r) for r in read_lines(spark, f"file://{tmp_path}/edges.jsonl").collect())
    assert got == [("a", "b", "imports", "ast_exact", 1.0), ("a", "c", "imports", "heuristic", 0.5)]


def test_first_writer_wins(spark):
    rows = spark.createDataFrame([("a", "b", "r", "p", 0.25, 2), ("a", "b", "r", "p", 0.5, 1)], "src string, dst string, rel string, provenance string, confidence float, seq int")
    assert distinct_edges(rows, ["seq"]).first()["confidence"] == 0.5
    assert edges_of(rows.drop("confidence", "provenance")).first()["provenance"] == "ast_exact"


def test_weights(spark):
    rows = spark.createDataFrame([("AST_exact",), ("heuristic",), ("unheard",)], "p string")
    assert [r[0] for r in rows.select(weight(rows["p"])).collect()] == [1.0, 0.5, None]


def test_external_marking(spark):
    e = edges(spark, [("x", "shared/pkg/a.go"), ("y", "other/b.go"), ("z", "shared")])
    m = spark.createDataFrame([("shared", "one"), ("shared/pkg", "two")], "prefix string, repo string")
    assert {r["dst"] for r in associate.mark_external(e, m).collect()} == {"external:two:a.go", "other/b.go", "shared"}


def test_malformed_extension(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert associate.extension_edges(files, "no arrow", "r").isEmpty()
    assert associate.extension_edges(files, "a → *", "r").count() == 1


def test_parsing_on_a_miss(spark):
    sources = spark.createDataFrame([("a.py", "import os\n"), ("b.py", "import sys\n")], "path string, text string")
    e = edges(spark, [("b.py", "pkg:known")])
    assert [r["dst"] for r in graph.related_or_parse(e, sources, "a.py").collect()] == ["pkg:os"]
    assert [r["dst"] for r in graph.related_or_parse(e, sources, "b.py").collect()] == ["pkg:known"]


def test_impact_attributes(spark):
    got = {r["path"]: r["value"] for r in graph.impact_attributes(edges(spark, CHAIN), "c").collect()}
    assert got == {"b": "imports (depth 1)", "a": "imports (depth 2)"}
