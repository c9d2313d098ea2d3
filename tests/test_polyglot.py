"""A small corpus in three languages: the build finds these edges, each time."""

from tessella.operators import associate, graph, imports
from tessella.operators.search import Index, documents_of
from tessella.sources.edges import distinct_edges

FILES = {
    "main.go": 'package main\n\nimport (\n\t"fmt"\n\t"example.com/internal/handler"\n)\n\nfunc main() { fmt.Println(handler.New()) }\n',
    "handler.go": 'package handler\n\nimport (\n\t"net/http"\n\n\t"example.com/internal/middleware"\n)\n',
    "middleware.go": 'package middleware\n\nimport "net/http"\n',
    "handler_test.go": 'package handler\n\nimport "testing"\n\nfunc TestNew(t *testing.T) {}\n',
    "utils.py": "import os\nimport sys\nfrom collections import OrderedDict\n\n\ndef slug(s):\n    return s\n",
    "app.ts": "import { handle } from './handler';\nimport express from 'express';\n\nexport const app = express();\n",
}
WANT = {
    ("main.go", "std:fmt", "imports"),
    ("main.go", "pkg:example.com/internal/handler", "imports"),
    ("handler.go", "std:net/http", "imports"),
    ("handler.go", "pkg:example.com/internal/middleware", "imports"),
    ("middleware.go", "std:net/http", "imports"),
    ("handler_test.go", "std:testing", "imports"),
    ("handler_test.go", "handler.go", "tested_by"),
    ("handler.go", "handler_test.go", "tests"),
    ("utils.py", "pkg:os", "imports"),
    ("utils.py", "pkg:sys", "imports"),
    ("utils.py", "pkg:collections", "imports"),
    ("app.ts", "local:./handler", "imports"),
    ("app.ts", "pkg:express", "imports"),
}


def built(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string").repartition(3)
    return distinct_edges(imports.import_edges(files).unionByName(associate.test_edges(files)))


def test_edges(spark):
    a, b = ({tuple(r) for r in built(spark).collect()} for _ in range(2))
    assert a == b and {r[:3] for r in a} == WANT
    assert {r[3:] for r in a if r[2] != "imports"} == {("heuristic", 0.800000011920929)}


def test_questions(spark):
    edges = built(spark).cache()
    assert [(r["path"], r["depth"]) for r in graph.impact(edges, "std:net/http").orderBy("depth", "path").collect()] == [("handler.go", 1), ("middleware.go", 1), ("handler_test.go", 2)]
    assert {r["path"] for r in graph.untested(edges).collect()} == {"main.go", "middleware.go", "utils.py", "app.ts"}
    found = [r["file_path"] for r in Index(documents_of(edges)).search("handler middleware").collect()]
    assert found[0] == "middleware.go" and "local:./handler" in found
    symbols = {(r["path"], r["name"]) for r in imports.symbols(spark.createDataFrame(list(FILES.items()), "path string, text string")).collect()}
    assert {("main.go", "main"), ("utils.py", "slug"), ("handler_test.go", "TestNew")} <= symbols
