"""Plugins: named Python functions over (path, text) that yield edges, attributes or warnings."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: kind is ``edge`` (a, b, c are target, relation, provenance), ``xattr`` (key, value) or ``warning`` (message).
SCHEMA = "plugin string, path string, kind string, a string, b string, c string"
Hook = Callable[[str, str], Iterable[tuple]]


@dataclass(frozen=True)
class Plugin:
    """``hooks`` maps an event (such as ``on_file_write``) to (pattern ending, priority, function)."""

    name: str
    hooks: dict[str, tuple[str, int, Hook]] = field(default_factory=dict)
    edge_types: tuple[str, ...] = ()


class Registry:
    def __init__(self):
        self._plugins: dict[str, Plugin] = {}

    def load(self, plugin: Plugin) -> None:
        self._plugins[plugin.name] = plugin

    def unload(self, name: str) -> bool:
        return self._plugins.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self._plugins)

    def matching(self, event: str) -> list[tuple[int, str, str, Hook]]:
        """(priority, plugin, ending, function), lowest priority first."""
        found = [(p, name, end, f) for name, plugin in self._plugins.items() for e, (end, p, f) in plugin.hooks.items() if e == event]
        return sorted(found, key=lambda h: (h[0], h[1]))

    def dispatch(self, files: DataFrame, event: str) -> DataFrame:
        """Rows that all plugins with a hook for ``event`` yield for ``files`` (``path, text``)."""
        hooks = self.matching(event)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                rows = []
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for _, name, end, hook in hooks:
                        if path is not None and path.endswith(end):
                            rows += [(name, path, *(list(r) + [None] * 3)[:4]) for r in hook(path, text or "")]
                columns = zip(*rows) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["plugin", "path", "kind", "a", "b", "c"])

        return files.select("path", "text").mapInArrow(run, SCHEMA)


def plugin_edges(results: DataFrame) -> DataFrame:
    """The edges among plugin results."""
    return results.where("kind = 'edge'").selectExpr("path AS src", "a AS dst", "coalesce(b, 'imports') AS rel", "coalesce(c, 'heuristic') AS provenance", "CAST(0.5 AS FLOAT) AS confidence")
