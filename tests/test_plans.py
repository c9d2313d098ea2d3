import io
import json

import pytest

from tessella.plans import manifest as M
from tessella.plans.service import Service, ToolError
from tessella.plans.workspace import mount_entries, mount_order
from tessella.schema import EDGE

TEXT = """
project: {name: demo}
backends:
  local: [{path: /srv/x, at: /x}]
  s3: [{bucket: b, prefix: p, at: /data/}]
graph:
  extensions: [{name: docs, pattern: "docs/* → src/*", relation: documents}]
permissions:
  rules: [{paths: "secrets/**", mode: 0}]
triggers: [{name: t, when: "*.go", on: write, run: "gofmt {{ .FilePath }}", debounce: 2s}]
rules: [{name: all, query: "SELECT * FROM edges"}, {name: bad, query: "SELEC"}]
"""


def test_manifest():
    m = M.parse(TEXT)
    assert m.graph.extensions[0].relation == "documents" and m.graph.impact.max_depth == 5
    assert m.permission_rules().rules[0].mode == 0 and len(m.permission_rules().rules) == 14
    t = m.trigger_list()[0]
    assert (t.events, t.command, t.debounce_ms) == (("write",), "gofmt {{ .FilePath }}", 2000)
    assert [x["backend_type"] for x in m.mounts()] == ["s3", "local"]


@pytest.mark.parametrize(("text", "message"), [("project: {name: a}\nwrong: 1", "unknown key wrong"), ("version: 1", "project: missing"), ("project: {name: a}\nrepos: 3", "repos: a list"), ("project: [", "while parsing")])
def test_broken_manifest(text, message):
    with pytest.raises(M.ManifestError, match=message):
        M.parse(text)


def test_mount_order():
    assert mount_order(["auth", "shared", "pay"], {"auth": ["shared"], "pay": ["auth", "gone"]}) == ["shared", "auth", "pay"]
    assert mount_order(["a", "b", "c"], {"a": ["b"], "b": ["a"]}) == ["c", "a", "b"]
    assert mount_entries([{"name": "a"}])[0]["at"] == "a"


@pytest.fixture(scope="module")
def service(spark):
    rows = [("src/auth/login.go", "pkg/crypto.go"), ("src/main.go", "src/auth/login.go"), ("src/auth/login_test.go", "src/auth/login.go")]
    edges = spark.createDataFrame([(a, b, "tested_by" if "_test" in a else "imports", "ast_exact", 1.0) for a, b in rows], EDGE)
    return Service(spark, edges, M.parse(TEXT))


def ask(service, method, **params):
    return service.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))


def tool(service, name, /, **arguments):
    return json.loads(ask(service, "tools/call", name=name, arguments=arguments)["result"]["content"][0]["text"])


def test_tools(service):
    assert tool(service, "vfs_graph_related", path="./src/main.go")["rows"][0]["dst"] == "src/auth/login.go"
    assert [r["path"] for r in tool(service, "vfs_graph_impact", path="pkg/crypto.go")["rows"]] == ["src/auth/login.go", "src/auth/login_test.go", "src/main.go"]
    assert tool(service, "vfs_graph_stats")["types"] == {"imports": 2, "tested_by": 1}
    assert [r["path"] for r in tool(service, "vfs_graph_untested")["rows"]] == ["src/main.go"]
    assert tool(service, "vfs_graph_module", module_name="src/auth")["file_count"] == 2
    assert tool(service, "vfs_graph_search", query="login")["rows"]
    assert tool(service, "vfs_graph_understand", task="login flow")["anchors"]
    assert tool(service, "vfs_set_metadata", path="a", key="role", value="x")["previous"] is None
    assert tool(service, "vfs_set_metadata", path="a", key="role", value="y")["previous"] == "x"
    assert tool(service, "vfs_get_metadata", path="a")["attributes"] == {"user.vfs.role": "y"}
    assert tool(service, "vfs_resolve_path", path="/data/k")["backing"] == "s3a://b/pk"
    assert tool(service, "vfs_backend_status", path="/x/y")["type"] == "local"
    assert tool(service, "vfs_sync_backend", path="/x/y")["synced"] == 0
    assert tool(service, "vfs_list_directory", path="/")["mounts"] == ["/data/", "/x"]
    assert [r["name"] for r in tool(service, "vfs_rule_list")] == ["all", "bad"]
    assert tool(service, "vfs_rule_check", name="all")["total"] == 3
    assert "error" in tool(service, "vfs_rule_check", name="bad")


def test_protocol(service):
    assert service.answer("no json")["error"]["code"] == -32700
    assert ask(service, "nope")["error"]["code"] == -32601
    assert ask(service, "tools/call", name="nope")["error"]["code"] == -32603
    assert "not in the graph" in ask(service, "tools/call", name="vfs_graph_impact", arguments={"path": "x"})["error"]["message"]
    assert len(ask(service, "tools/list")["result"]["tools"]) == 15
    assert service.answer('{"method": "notifications/initialized"}') is None
    with pytest.raises(ToolError, match="missing argument"):
        service.call("vfs_graph_related")
    out = io.StringIO()
    service.serve(['{"id": 1, "method": "initialize"}\n', "\n", '{"id": 2, "method": "initialize"}\n'], out, rate=1.0)
    assert ["error" in json.loads(x) for x in out.getvalue().splitlines()] == [False, True]


def test_command_line(spark, tmp_path, capsys):
    from tessella.__main__ import main

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import os\n")
    (tmp_path / "src/test_a.py").write_text("import a\n")
    folder = ["--folder", f"file://{tmp_path}/graph"]
    assert main([*folder, "init"]) == 0
    assert main([*folder, "warm", f"file://{tmp_path}/src"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"written": 4}
    assert main([*folder, "impact", "pkg:os"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["total"] == 2
    assert main([*folder, "impact", "nowhere"]) == 1
    assert main([*folder, "classify", f"file://{tmp_path}/src"]) == 0
    assert main([*folder, "clean"]) == 0
