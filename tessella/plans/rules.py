"""User rules: SQL over views of the graph, with typed and compatible results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the compatible grid at most.
COLUMNS = 20


@dataclass(frozen=True)
class Rule:
    name: str
    query: str
    description: str = ""
    args: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Failure:
    """A rule that could not be run; errors are values, not exceptions."""

    rule: str
    error: str


def register(spark: SparkSession, edges: DataFrame, blobs: DataFrame | None = None, metadata: DataFrame | None = None) -> None:
    """The views ``edges`` (with `from` and `to`), ``nodes``, and where given ``blobs`` and ``file_registry``.

    ``file_registry`` has a row per path with its attributes as columns.
    """
    edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "rel", "provenance", "confidence").createOrReplaceTempView("edges")
    edges.select(F.col("src").alias("path")).union(edges.select("dst")).distinct().createOrReplaceTempView("nodes")
    if blobs is not None:
        blobs.createOrReplaceTempView("blobs")
    if metadata is not None:
        file_registry(metadata).createOrReplaceTempView("file_registry")


#: Attributes that the registry has as columns.
REGISTRY = ["role", "status", "feature", "backend", "hash", "last_modified", "impact"]


def file_registry(metadata: DataFrame) -> DataFrame:
    """``path`` and a column for each known attribute of ``path, key, value``."""
    short = metadata.withColumn("key", F.regexp_replace("key", r"^user\.vfs\.", ""))
    return short.groupBy("path").pivot("key", REGISTRY).agg(F.max("value"))


def rows(spark: SparkSession, rule: Rule) -> DataFrame:
    """The rule's typed result.  `from` and `to` are quoted with backticks; named ``args`` are bound."""
    return spark.sql(rule.query, args=rule.args) if rule.args else spark.sql(rule.query)


def compatible(result: DataFrame) -> DataFrame:
    """``cells`` array<string>: at most 20 columns, each row cut at its first null."""
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in result.columns[:COLUMNS]])
    until = F.array_position(F.transform(cells, lambda x: x.isNull()), True)
    return result.select(F.when(until > 0, F.slice(cells, F.lit(1), until.cast("int") - 1)).otherwise(cells).alias("cells"))


def findings(result: DataFrame | Failure, spark: SparkSession) -> DataFrame:
    """``path, severity, detail``: the first three columns of a result as strings; none for a failure."""
    if isinstance(result, Failure):
        return spark.createDataFrame([], "path string, severity string, detail string")
    columns = [F.col(f"`{c}`").cast("string") for c in result.columns[:3]] + [F.lit("")] * 3
    return result.select(*[c.alias(n) for c, n in zip(columns, ("path", "severity", "detail"))])


def check(spark: SparkSession, rule: Rule) -> DataFrame | Failure:
    try:
        return rows(spark, rule)
    except Exception as e:  # analysis and parse errors of user SQL
        return Failure(rule.name, str(e).splitlines()[0])


def check_all(spark: SparkSession, rules: list[Rule]) -> dict[str, DataFrame | Failure]:
    return {r.name: check(spark, r) for r in rules}


def find(rules: list[Rule], name: str) -> Rule:
    for r in rules:
        if r.name == name:
            return r
    raise KeyError(f"no rule {name}; there are: {', '.join(sorted(r.name for r in rules))}")


#: Documented rules, in this engine's SQL.
UNTESTED_CRITICAL = Rule(
    "untested-critical",
    "SELECT `to` AS path, count(*) AS dependents FROM edges e WHERE rel = 'imports' "
    "AND NOT EXISTS (SELECT 1 FROM edges t WHERE t.rel = 'tested_by' AND t.`to` = e.`to`) GROUP BY `to` HAVING count(*) > :least",
    "targets with many dependents and no test",
    {"least": 5},
)
TRANSITIVE_IMPACT = Rule(
    "transitive-impact",
    "WITH RECURSIVE hit(path, depth) AS (SELECT :path, 0 UNION ALL SELECT e.`from`, hit.depth + 1 FROM edges e JOIN hit ON e.`to` = hit.path WHERE hit.depth < :depth) "
    "SELECT path, min(depth) AS depth FROM hit WHERE depth > 0 GROUP BY path",
    "everything that depends on a path, to a depth",
    {"path": "", "depth": 2},
)
STALE_FILES = Rule("stale-files", "SELECT path, status FROM file_registry WHERE status IN ('deprecated', 'stale')", "files marked stale")
BLOB_TARGETS = Rule("blob-targets", "SELECT e.`from` AS path, b.backend, b.hash FROM edges e JOIN blobs b ON e.`to` = b.path", "files that depend on stored blobs")
