import datetime

from pyspark.sql import functions as F

from tessella.operators import imports
from tessella.plans import rules
from tessella.plans.plugins import Plugin, Registry, plugin_edges
from tessella.schema import EDGE
from tessella.sources import files as S
from tessella.sources.edges import EdgeStore
from tessella.streaming import events as V


def tree(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return f"file://{root}"


def test_scan(spark, tmp_path):
    root = tree(tmp_path, {"a/x.go": "package a\n", "a/y.txt": "y", "vendor/z.go": "", ".hid/w.py": "", "m.py": "import os\n", "h.hpp": ""})
    got = {r["path"]: (r["language"], r["text"]) for r in S.scan(spark, root).collect()}
    assert got == {"a/x.go": ("go", "package a\n"), "m.py": ("python", "import os\n")}
    assert "a/y.txt" in {r["path"] for r in S.scan(spark, root, classify=True, with_text=False).collect()}
    assert S.of_language(S.scan(spark, root), "go").count() == 1
    assert S.changed(S.scan(spark, root), F.lit("2100-01-01").cast("timestamp")).isEmpty()
    edges = imports.import_edges(S.scan(spark, root))
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("m.py", "pkg:os")]


def test_build_is_incremental(spark, tmp_path):
    root = tree(tmp_path / "src", {"a.py": "import os\nimport sys\n"})
    store = EdgeStore(spark, f"file://{tmp_path}/graph").init()
    files = S.scan(spark, root)
    assert V.parse_and_diff(files, store) == 2
    assert V.parse_and_diff(files, store) == 0
    tree(tmp_path / "src", {"b.rs": "use serde::X;\n"})
    assert V.parse_and_diff(S.scan(spark, root), store) == 1


def test_attributes(spark):
    known = spark.createDataFrame([("a", "user.vfs.role", "old")], "path string, key string, value string")
    updates = spark.createDataFrame([("a", "role", "mid", 1), ("a", "role", "new", 2), ("b", "x", "y", 1), ("b", "", "no", 1)], "path string, key string, value string, seq long")
    got = {(r["path"], r["key"]): r["value"] for r in S.set_attributes(known, updates).collect()}
    assert got == {("a", "user.vfs.role"): "new", ("b", "user.vfs.x"): "y"}
    assert S.remove_attributes(known, spark.createDataFrame([("a", "role")], "path string, key string")).isEmpty()
    assert [r["previous"] for r in S.previous_values(updates.where("path = 'a'")).orderBy("seq").collect()] == [None, "mid"]
    assert S.get_attributes(known, "a", ["role"]).count() == 1 and S.get_attributes(known, "a", ["x"]).isEmpty()


def test_mounts(spark):
    paths = spark.createDataFrame([("/data/x",), ("/code/y",), ("/else",)], "path string")
    mounts = [{"name": "l", "backend_type": "local", "at": "/", "path": "/srv"}, {"name": "s", "backend_type": "s3", "at": "/data/", "path": "s3://b"}]
    got = {r["path"]: (r["backend"], r["backing"]) for r in S.resolve(paths, mounts).collect()}
    assert got["/data/x"] == ("s", "s3://bx") and got["/else"][0] == "l"
    assert {(r["name"], r["is_folder"]) for r in S.names_under(spark.createDataFrame([("a/b",), ("a/c/d",)], "path string"), "a").collect()} == {("b", False), ("c", True)}


def test_rules(spark):
    edges = spark.createDataFrame([("a", "b", "imports", "p", 1.0), ("b", "c", "imports", "p", 1.0), ("x", "y", "calls", "p", 1.0)], EDGE)
    rules.register(spark, edges)
    found = rules.check_all(spark, [rules.Rule("ok", "SELECT * FROM edges WHERE rel = 'imports'"), rules.Rule("bad", "SELEC 1"), rules.Rule("none", "SELECT 1 FROM nowhere")])
    assert found["ok"].count() == 2
    assert isinstance(found["bad"], rules.Failure) and isinstance(found["none"], rules.Failure)
    cut = rules.compatible(spark.sql("SELECT 1 AS a, NULL AS b, 3 AS c UNION ALL SELECT 1, 2, 3"))
    assert sorted(r["cells"] for r in cut.collect()) == [["1"], ["1", "2", "3"]]


def test_plugins(spark):
    registry = Registry()
    registry.load(Plugin("late", {"write": (".md", 5, lambda p, t: [("warning", t.upper())])}))
    registry.load(Plugin("first", {"write": ("", 1, lambda p, t: [("edge", "x.go", "documents")])}))
    files = spark.createDataFrame([("a.md", "hi"), ("b.go", None)], "path string, text string")
    got = registry.dispatch(files, "write")
    assert {(r["plugin"], r["path"], r["kind"]) for r in got.collect()} == {("first", "a.md", "edge"), ("late", "a.md", "warning"), ("first", "b.go", "edge")}
    assert plugin_edges(got).count() == 2
    assert registry.unload("late") and not registry.unload("late") and registry.names() == ["first"]


T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp"


def rows(times, key="a"):
    return [(key, T0 + datetime.timedelta(milliseconds=t)) for t in times]


def fired(df):
    return sorted((r["k"], round((r["ts"] - T0).total_seconds() * 1000)) for r in df.collect())


def test_debounce(spark):
    events = spark.createDataFrame(rows([0, 300, 499, 500, 900, 1000]) + rows([10, 600], "b"), SCHEMA)
    assert fired(V.debounced(events, ["k"], 500_000)) == [("a", 0), ("a", 500), ("a", 1000), ("b", 10), ("b", 600)]


def test_debounce_stream_equals_batch(spark, tmp_path):
    want = None
    folder = str(tmp_path / "in")
    events = spark.createDataFrame(rows([0, 300, 499, 500, 900, 1000, 5000]) + rows([10, 600], "b"), SCHEMA)
    events.coalesce(1).write.parquet(folder)
    want = fired(V.debounced(events, ["k"], 500_000))
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    q = V.debounced_stream(stream, ["k"], 500_000).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert fired(spark.table("fired")) == want


def test_build_stream(spark, tmp_path):
    folder = str(tmp_path / "files")
    spark.createDataFrame([("a.py", "import os\n")], "path string, text string").write.parquet(folder)
    store = EdgeStore(spark, f"file://{tmp_path}/graph").init()
    stream = spark.readStream.schema("path string, text string").parquet(folder)
    V.build_stream(stream, store, str(tmp_path / "cp")).awaitTermination(120)
    assert [r["dst"] for r in store.load().collect()] == ["pkg:os"]


def test_rate_limit(spark):
    calls = spark.createDataFrame(rows([0, 100, 200, 1300]), SCHEMA)
    got = [r["allowed"] for r in V.rate_limited(calls, ["k"], 2.0).orderBy("ts").collect()]
    assert got == [True, True, False, True]
    assert all(r["allowed"] for r in V.rate_limited(calls, ["k"], 0).collect())


def test_triggers(spark):
    events = spark.createDataFrame([("x/a.go", "write"), ("b.md", "write"), ("c.py", "delete")], "path string, event_type string")
    got = {(r["path"], r["trigger"]) for r in V.triggered(events, [*V.DEFAULT_TRIGGERS, V.Trigger("any", "*", ("delete",))]).collect()}
    assert got == {("x/a.go", "update-graph-go"), ("c.py", "any")}
    fired_ = spark.createDataFrame([("fmt", "a/b.go", T0)], "trigger string, path string, ts timestamp")
    assert V.commands(fired_, [V.Trigger("fmt", "*", command="gofmt {{ .FilePath }} {{ .Timestamp }}")]).first()["command"] == "gofmt a/b.go 2024-01-01T00:00:00Z"


def test_actions(spark):
    rows = spark.createDataFrame([("a/b.go", b"x", T0)], "path string, content binary, ts timestamp")
    got = {r["key"]: r["value"] for r in V.uploads(rows, "s3").collect()}
    assert got["user.vfs.backend"] == "s3" and got["user.vfs.hash"].startswith("sha256:") and got["user.vfs.uploaded_at"] == "2024-01-01T00:00:00Z"
    assert tuple(V.after_action(rows, "status=seen {{ .FilePath }}").first()) == ("a/b.go", "user.vfs.status", "seen a/b.go")


def test_objects(spark, tmp_path):
    import pytest

    store = S.ObjectStore(spark, f"file://{tmp_path}/o", writable=True)
    digest = store.put("d/k.txt", b"hello")
    assert store.get("d/k.txt").first()["hash"] == digest
    assert [(r["key"], r["size"]) for r in store.objects("d/").collect()] == [("d/k.txt", 5)]
    with pytest.raises(PermissionError):
        S.ObjectStore(spark, f"file://{tmp_path}/o").put("x", b"")


def test_mount_file(tmp_path):
    path = str(tmp_path / "mounts.yaml")
    assert S.read_mounts(path) == []
    S.write_mounts(path, [{"name": "a", "backend_type": "git", "path": "/x"}])
    assert S.read_mounts(path)[0]["backend_type"] == "git"


def test_findings(spark):
    got = rules.findings(spark.sql("SELECT 'a' AS p, 1 AS s"), spark).first()
    assert tuple(got) == ("a", "1", "")
    assert rules.findings(rules.Failure("x", "e"), spark).isEmpty()


def test_parse_state_reads_only_what_changed(spark, tmp_path):
    store = EdgeStore(spark, f"{tmp_path}/graph").init()
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    assert V.parse_and_diff(files(("a.py", "import os\n"), ("b.py", "import sys\n")), store) == 2
    assert V.parse_and_diff(files(("a.py", "import os\n")), store) == 0
    assert V.parse_and_diff(files(("a.py", "import os\nimport re\n")), store) == 1
    assert V.parse_and_diff(files(("a.py", "")), store) == 0  # edges are never retracted
    assert store.counts() == (3, 3)


def test_actions_beyond_the_limit_are_dropped(spark):
    rows = [(i,) for i in (0, 1, 2, 3, 4, 10, 11, 12, 13)]
    calls = spark.createDataFrame(rows, "t long").select(F.timestamp_seconds("t").alias("ts"))
    got = sorted((int(r["ts"].timestamp()), r["admitted"]) for r in V.admitted(calls, 10_000_000, 4).collect())
    assert [t for t, yes in got if not yes] == [4]
