"""Questions about a dependency graph: neighbours, impact, coverage, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.text import any_of
from tessella.operators.classify import is_test_path
from tessella.plans.staging import once, stage

FORWARD, REVERSE = "forward", "reverse"
#: Depths used by the command line, the tool server and triggers when none is given.
DEPTHS = {"cli": 10, "tools": 5, "trigger": 3}


def direction(name: str) -> str:
    return REVERSE if name.lower() in ("reverse", "incoming", "in", "backward") else FORWARD


def related(edges: DataFrame, path: str, rel: str | None = None, way: str = FORWARD, package: str | None = None) -> DataFrame:
    """Edges out of a node, or into it and (if given) into its package's node.

    Equality filters, which stored edges push down to the scan; nothing is shuffled.
    """
    if direction(way) == FORWARD:
        out = edges.where(F.col("src") == path)
    else:
        out = edges.where(F.col("dst").isin([path, *([package] if package else [])]))
    return out.where(F.col("rel") == rel) if rel else out


def related_any(edges: DataFrame, path: str, rel: str | None = None, way: str = FORWARD) -> DataFrame:
    """``related`` of the first of several spellings of a path that has any row.

    Spellings, in order: the path itself, without leading ``/home/``, ``./``
    and ``/`` (each however often it is repeated).
    """
    spellings = [path]
    for prefix in ("/home/", "./", "/"):
        rest = path
        while rest.startswith(prefix):
            rest = rest[len(prefix) :]
        spellings.append(rest)
    end = "src" if direction(way) == FORWARD else "dst"
    rank = F.array_position(F.array(*[F.lit(s) for s in spellings]), F.col(end))
    found = edges.where(F.col(end).isin(spellings))
    found = (found.where(F.col("rel") == rel) if rel else found).withColumn("__rank", rank)
    least = found.agg(F.min("__rank").alias("__least"))
    return found.join(F.broadcast(least), F.col("__rank") == F.col("__least")).select(*edges.columns)


def node_exists(edges: DataFrame, path: str) -> bool:
    return not edges.where((F.col("src") == path) | (F.col("dst") == path)).limit(1).isEmpty()


def parsed_on_miss(edges: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """``edges``, with the imports of ``path`` parsed from ``sources`` (``path, text``) if it has no edge out yet."""
    from tessella.operators.imports import import_edges

    if not edges.where(F.col("src") == path).limit(1).isEmpty():
        return edges
    return edges.unionByName(import_edges(sources.where(F.col("path") == path)))


def related_or_parse(edges: DataFrame, sources: DataFrame, path: str, rel: str | None = None, way: str = FORWARD) -> DataFrame:
    """``related``, after parsing the file if the graph does not know the node."""
    known = edges if node_exists(edges, path) else parsed_on_miss(edges, sources, path)
    return related(known, path, rel, way)


def nodes(edges: DataFrame) -> DataFrame:
    """``node``: every end of an edge, once."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def external_target(path: Column) -> Column:
    """``repo:rest`` of ``repo/rest``: how a node is named in other repositories."""
    return F.regexp_replace(path, r"^([^/]*)/", "$1:")


def impact(edges: DataFrame, start: str, max_depth: int = 10, external: bool = False, package: DataFrame | None = None) -> DataFrame:
    """``path, relation, provenance, confidence, depth``: all that depends on a node.

    Breadth first against the edges, a join and an anti-join per level, so each
    node has its least depth and is expanded once.  Of several edges that reach
    a node at its depth the least (relation, provenance) labels it.  With
    ``external`` also edges to ``external:<repo>:<path>`` count as edges to
    ``<repo>/<path>``; the suffix is matched by an equality, not a scan.
    ``package`` (``node, package``) adds importers of a node's package.  The
    start itself is no result; an unknown start or depth 0 gives no rows.
    Edges that are no stored table are stored first, as each level reads them.
    """
    spark = edges.sparkSession
    edges = once(edges, "edges") if max_depth > 1 else edges
    to = edges.select("src", "dst", "rel", "provenance", "confidence")
    if external:
        outside = to.where(F.col("dst").startswith("external:")).withColumn("dst", F.substring(F.col("dst"), len("external:") + 1, 1 << 30))
        to = to.unionByName(outside)
    shape = "path string, relation string, provenance string, confidence double, depth int"
    frontier = spark.createDataFrame([(start,)], "node string")
    seen, levels = frontier, []
    for depth in range(1, max_depth + 1):
        keys = frontier.select("node", F.col("node").alias("via"))
        if external:
            keys = keys.union(frontier.select("node", external_target(F.col("node")).alias("via")))
        if package is not None:
            keys = keys.union(frontier.join(package, "node").select("node", "package"))
        hit = to.join(keys.select("via").distinct(), F.col("dst") == F.col("via"))
        label = F.min(F.struct("rel", "provenance", F.col("confidence").cast("double").alias("confidence"))).alias("e")
        found = hit.groupBy(F.col("src").alias("node")).agg(label).join(seen, "node", "left_anti")
        found = stage(found.select("node", "e.rel", "e.provenance", "e.confidence"), f"level{depth}")
        if found.isEmpty():
            break
        levels.append(found.select(F.col("node").alias("path"), F.col("rel").alias("relation"), "provenance", "confidence", F.lit(depth).alias("depth")))
        frontier = found.select("node")
        seen = seen.union(frontier)
    out = spark.createDataFrame([], shape)
    for level in levels:
        out = out.unionByName(level)
    return out


def impact_or_fail(edges: DataFrame, start: str, max_depth: int = 10, sources: DataFrame | None = None, **more) -> DataFrame:
    """``impact``, but an unknown node with no source file is an error."""
    known = node_exists(edges, start) or (sources is not None and not sources.where(F.col("path") == start).limit(1).isEmpty())
    if not known:
        raise ValueError(f"not in the graph: {start}")
    return impact(edges, start, max_depth, **more)


def packages_of(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """``node, package`` (``pkg:<name>``): the package of the nearest folder above a file.

    ``packages`` has ``dir, name``.  Each path meets only its own folders, by
    equality; nodes that are no files have no package.
    """
    plain = paths.where(~any_of(F.col("node").startswith(p) for p in ("pkg:", "std:", "sys:", "local:", "external:")))
    up = plain.select("node", F.posexplode(X.ancestors(F.col("node"))).alias("__up", "dir"))
    near = up.join(packages, "dir").groupBy("node").agg(F.min_by("name", "__up").alias("name"))
    return near.select("node", F.concat(F.lit("pkg:"), "name").alias("package"))


def untested(edges: DataFrame) -> DataFrame:
    """``path`` of importing files that no test edge points to and that are no tests themselves."""
    importing = edges.where("rel = 'imports'").select(F.col("src").alias("path")).distinct()
    tested = edges.where("rel = 'tested_by'").select(F.col("dst").alias("path")).distinct()
    return importing.join(tested, "path", "left_anti").where(~is_test_path(F.col("path")))


def orphans(edges: DataFrame) -> DataFrame:
    """``path`` of sources that nothing points to (an edge to itself counts)."""
    return edges.select(F.col("src").alias("path")).distinct().join(edges.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")


def group_by_dependency(edges: DataFrame) -> DataFrame:
    """``dst, rel, cnt``."""
    return edges.groupBy("dst", "rel").agg(F.count("*").alias("cnt"))


def well_formed(node: Column) -> Column:
    return ~node.startswith("pkg:{")


def top_dependencies(edges: DataFrame, k: int = 10) -> DataFrame:
    """``dst, cnt`` of the k most frequent targets, ties by name."""
    counted = edges.where(well_formed(F.col("dst"))).groupBy("dst").agg(F.count("*").alias("cnt"))
    return counted.orderBy(F.desc("cnt"), "dst").limit(k)


def edge_types(edges: DataFrame) -> DataFrame:
    """``rel, cnt``."""
    return edges.groupBy("rel").agg(F.count("*").alias("cnt"))


def distinct_files(edges: DataFrame) -> DataFrame:
    """``side, node``: distinct sources and distinct targets."""
    side = lambda name: edges.select(F.lit(name).alias("side"), F.col(name).alias("node")).distinct()
    return side("src").union(side("dst"))


def targets(edges: DataFrame) -> DataFrame:
    """``dst``: every target once, external ones too."""
    return edges.select("dst").distinct()


def stats(edges: DataFrame) -> DataFrame:
    """One row: total_edges, total_files, unique_dependencies, most_connected, orphan_count, unique_relations, tested_pct.

    The edges are read once, into counts by node and relation.
    """
    out = edges.select(F.col("src").alias("node"), "rel", F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select(F.col("dst").alias("node"), "rel", F.lit(0).alias("o"), F.lit(1).alias("i"))
    by = stage(out.unionAll(into).groupBy("node", "rel").agg(F.sum("o").alias("o"), F.sum("i").alias("i")), "degrees")
    relations = by.agg(F.countDistinct("rel").alias("unique_relations"))
    imports, tests = F.when(F.col("rel") == "imports", F.col("o")).otherwise(0), F.when(F.col("rel") == "tested_by", F.col("i")).otherwise(0)
    node = by.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum(imports).alias("imports"), F.sum(tests).alias("tests"))
    number = lambda condition: F.count(F.when(condition, 1))
    o, i = F.col("o"), F.col("i")
    top = F.min(F.when((i > 0) & well_formed(F.col("node")), F.struct((-i).alias("n"), "node")))
    one = node.agg(
        F.coalesce(F.sum("o"), F.lit(0)).alias("total_edges"),
        number(o > 0).alias("total_files"),
        number(i > 0).alias("unique_dependencies"),
        top["node"].alias("most_connected"),
        number((o > 0) & (i == 0)).alias("orphan_count"),
        number((F.col("imports") > 0) & (F.col("tests") == 0) & ~is_test_path(F.col("node"))).alias("untested_count"),
    )
    files = F.col("total_files")
    pct = F.when(files > 0, (files - F.col("untested_count")) / files * 100).otherwise(0.0)
    # two tables of one row each
    return one.crossJoin(relations).withColumn("tested_pct", F.round(pct, 9))


def inside(node: Column, module: str) -> Column:
    return node.startswith(module.rstrip("/") + "/")


def module_files(edges: DataFrame, module: str) -> DataFrame:
    """``path`` of all nodes under a prefix."""
    return nodes(edges).where(inside(F.col("node"), module)).select(F.col("node").alias("path"))


def module_stats(edges: DataFrame, module: str) -> DataFrame:
    """One row: file_count, edge_count, tested_count, coverage (percent, one decimal)."""
    src, dst = inside(F.col("src"), module), inside(F.col("dst"), module)
    files = module_files(edges, module).agg(F.count("*").alias("file_count"))
    near = edges.where(src | dst)
    counted = near.agg(F.count("*").alias("edge_count"), F.countDistinct(F.when(dst & (F.col("rel") == "tested_by"), F.col("dst"))).alias("tested_count"))
    share = F.when(F.col("file_count") > 0, F.round(F.col("tested_count") / F.col("file_count") * 1000) / 10).otherwise(0.0)
    return files.crossJoin(counted).withColumn("coverage", share)


def impact_attributes(edges: DataFrame, path: str, max_depth: int = DEPTHS["trigger"]) -> DataFrame:
    """``path, key, value`` rows that tell each dependent of a changed file how it is reached."""
    reached = impact(edges, path, max_depth)
    value = F.concat("relation", F.lit(" (depth "), F.col("depth").cast("string"), F.lit(")"))
    return reached.select("path", F.lit("user.vfs.impact").alias("key"), value.alias("value"))


def diff(current: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of ``current`` that are not in ``known`` by all five columns."""
    return current.join(known, current.columns, "left_anti")
