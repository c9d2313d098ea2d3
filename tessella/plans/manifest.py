"""The project manifest: a typed YAML document, read on the driver."""

from __future__ import annotations

import dataclasses
import typing
from dataclasses import dataclass, field

from tessella.operators.permissions import DEFAULT_RULES, Permissions, Rule
from tessella.plans import rules
from tessella.streaming.events import Trigger


class ManifestError(ValueError):
    pass


@dataclass
class Project:
    name: str
    description: str = ""


@dataclass
class Repo:
    name: str
    url: str = ""
    ref: str = "main"
    at: str = ""
    writable: bool = False
    auto_pull: bool = False
    manifest: str | None = None


@dataclass
class S3Backend:
    bucket: str
    prefix: str | None = None
    at: str = ""
    region: str = "us-east-1"
    cache: str | None = None
    ttl: int = 0
    writable: bool = False
    lazy_load: bool = True


@dataclass
class RemoteBackend:
    url: str
    at: str = ""
    ref: str = "main"
    cache: str | None = None
    auto_pull: int | None = None


@dataclass
class LocalBackend:
    path: str
    at: str = ""
    writable: bool = True


@dataclass
class Backends:
    s3: list[S3Backend] = field(default_factory=list)
    remote: list[RemoteBackend] = field(default_factory=list)
    local: list[LocalBackend] = field(default_factory=list)


@dataclass
class Extension:
    name: str
    pattern: str
    relation: str


@dataclass
class Impact:
    enabled: bool = True
    max_depth: int = 5
    parallel: bool = True


#: The languages discovered by default.
LANGUAGES = ["go", "python", "typescript", "rust", "javascript", "java", "c", "cpp", "ruby"]


@dataclass
class AutoDiscover:
    enabled: bool = True
    languages: list[str] = field(default_factory=lambda: list(LANGUAGES))
    on_first_read: bool = True
    on_write: bool = True
    on_mount: bool = False


@dataclass
class Graph:
    edges: str = ".vfs/graph/edges.jsonl"
    blob_index: str = ".vfs/blobs/index.jsonl"
    duckdb_cache: str = ".vfs/graph/graph.db"
    auto_discover: AutoDiscover = field(default_factory=AutoDiscover)
    impact: Impact = field(default_factory=Impact)
    cross_repo: bool = False
    max_edges_per_file: int = 10_000
    deduplicate: bool = True
    extensions: list[Extension] = field(default_factory=list)


@dataclass
class PermissionRule:
    paths: list[str]
    mode: str = "0644"
    allow_delete: bool | None = None


@dataclass
class BackendPermission:
    name: str
    mode: str = "0644"


@dataclass
class PermissionSection:
    rules: list[PermissionRule] = field(default_factory=list)
    default_mode: str = "0644"
    backends: list[BackendPermission] = field(default_factory=list)


@dataclass
class TriggerSection:
    name: str
    when: str
    on: list[str] = field(default_factory=lambda: ["write"])
    run: str = ""
    timeout: str = "30s"
    debounce: str | None = None
    on_failure: str | None = None
    on_success: dict | None = None


@dataclass
class RuleSection:
    name: str
    query: str
    description: str = ""


@dataclass
class Manifest:
    project: Project
    version: int = 1
    interfaces: dict = field(default_factory=dict)
    repos: list[Repo] = field(default_factory=list)
    backends: Backends = field(default_factory=Backends)
    metadata: dict = field(default_factory=dict)
    graph: Graph = field(default_factory=Graph)
    permissions: PermissionSection = field(default_factory=PermissionSection)
    triggers: list[TriggerSection] = field(default_factory=list)
    rules: list[RuleSection] = field(default_factory=list)
    plugins: list[dict] = field(default_factory=list)
    discovery: dict = field(default_factory=dict)
    sandbox: dict = field(default_factory=dict)
    performance: dict = field(default_factory=dict)

    def rule_list(self) -> list[rules.Rule]:
        return [rules.Rule(r.name, r.query, r.description) for r in self.rules]

    def trigger_list(self) -> list[Trigger]:
        out = []
        for t in self.triggers:
            builtin = t.run if t.run in ("parse-and-diff", "upload") else None
            out.append(Trigger(t.name, t.when, tuple(t.on), builtin, None if builtin else t.run or None, milliseconds(t.debounce or "500ms")))
        return out

    def permission_rules(self) -> Permissions:
        """The manifest's rules before the default protections."""
        own = tuple(Rule(tuple(r.paths), int(r.mode, 8), bool(r.allow_delete)) for r in self.permissions.rules)
        return Permissions(own + DEFAULT_RULES, {b.name: int(b.mode, 8) for b in self.permissions.backends}, int(self.permissions.default_mode, 8))

    def mounts(self) -> list[dict]:
        b = self.backends
        out = [{"name": x.bucket, "backend_type": "s3", "at": x.at, "path": f"s3a://{x.bucket}/{x.prefix or ''}"} for x in b.s3]
        out += [{"name": x.url, "backend_type": "git", "at": x.at, "path": x.cache or ""} for x in b.remote]
        return out + [{"name": x.path, "backend_type": "local", "at": x.at, "path": x.path} for x in b.local]


def milliseconds(text: str) -> int:
    """``500ms``, ``2s``, ``3m``; plain numbers are seconds."""
    for end, unit in (("ms", 1), ("s", 1000), ("m", 60_000)):
        if text.endswith(end) and text[: -len(end)].strip().isdigit():
            return int(text[: -len(end)]) * unit
    return int(text) * 1000 if text.strip().isdigit() else 0


def build(cls, value, where: str):
    """A dataclass from a mapping; unknown keys, missing keys and wrong kinds are errors that name the place."""
    if not isinstance(value, dict):
        raise ManifestError(f"{where}: a mapping is needed")
    value = {"on" if k is True else k: v for k, v in value.items()}  # YAML 1.1 reads a bare ``on`` as true
    hints, known = typing.get_type_hints(cls), {f.name: f for f in dataclasses.fields(cls)}
    if unknown := sorted(set(value) - set(known)):
        raise ManifestError(f"{where}: unknown key {unknown[0]}")
    out = {}
    for name, f in known.items():
        at = f"{where}.{name}" if where else name
        if name in value:
            out[name] = _convert(hints[name], value[name], at)
        elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            raise ManifestError(f"{at}: missing")
    return cls(**out)


def _convert(hint, value, at: str):
    options = [h for h in typing.get_args(hint) if h is not type(None)] if type(None) in typing.get_args(hint) else [hint]
    if value is None and options != [hint]:
        return None
    hint = options[0]
    if dataclasses.is_dataclass(hint):
        return build(hint, value, at)
    if typing.get_origin(hint) is list:
        inner = typing.get_args(hint)[0]
        if isinstance(value, str) and inner is str:
            value = [value]  # a single string stands for a list of one
        if not isinstance(value, list):
            raise ManifestError(f"{at}: a list is needed")
        return [_convert(inner, v, f"{at}[{i}]") for i, v in enumerate(value)]
    if hint is str and isinstance(value, int) and not isinstance(value, bool):
        return str(value)  # modes and the like may be written as numbers
    if hint is int and isinstance(value, bool) or not isinstance(value, hint if typing.get_origin(hint) is None else dict):
        raise ManifestError(f"{at}: {getattr(hint, '__name__', hint)} is needed")
    return value


def parse(text: str) -> Manifest:
    import yaml

    try:
        value = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ManifestError(str(e)) from e
    return build(Manifest, value or {}, "")
