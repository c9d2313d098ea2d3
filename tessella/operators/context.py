"""Budgeted context for a task: anchors, a scored walk, tiers and text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.graph import nodes
from tessella.operators.search import Index, documents_of
from tessella.plans.staging import once, stage
from tessella.schema import weight


#: Symbols named for a file at most.
SYMBOLS = 8


@dataclass(frozen=True)
class Options:
    token_budget: int = 6000
    seed_limit: int = 8
    depth: int = 2
    max_nodes: int = 60
    flat: bool = False


def matched_words(path: Column, words: list[str]) -> Column:
    """How many of the task's words (repeats count) a path contains."""
    low = F.lower(path)
    total = F.lit(0)
    for w in words:
        total = total + low.contains(w).cast("int")
    return total


def anchors(edges: DataFrame, task: str, options: Options = Options()) -> DataFrame:
    """``path, matches``: the nodes that contain most words of the task; search results if none does."""
    words = X.task_words(task)
    hit = nodes(edges).select(F.col("node").alias("path"), matched_words(F.col("node"), words).alias("matches")).where("matches > 0")
    top = hit.orderBy(F.desc("matches"), "path").limit(options.seed_limit)
    if not words or top.isEmpty():
        found = Index(documents_of(edges)).search(task, options.seed_limit)
        return found.select(F.col("file_path").alias("path"), F.lit(0).alias("matches"))
    return top


def walk(edges: DataFrame, start: DataFrame, options: Options = Options()) -> DataFrame:
    """``path, score, provenance`` of the nodes near the anchors ``start`` (``path``).

    Undirected, breadth first from each anchor.  A node found at depth d has
    the weight of the edge that found it times 0.8, 0.5 and then 0.3 / (d - 1);
    anchors have 1.  Of several the greatest score counts, then the provenance
    by name.
    """
    edges = once(edges, "edges") if options.depth > 1 else edges
    both = edges.select("src", "dst", "provenance").union(edges.select("dst", "src", "provenance")).where("src <> dst")
    seen = stage(start.select(F.col("path").alias("anchor"), F.col("path").alias("node"), F.lit(1.0).alias("score"), F.lit("ast_exact").alias("provenance"), F.lit(0).alias("depth")), "anchors")
    frontier = seen
    for depth in range(1, options.depth + 1):
        factor = {1: 0.8, 2: 0.5}.get(depth, 0.3 / max(depth - 1, 1))
        near = both.join(frontier.select("anchor", F.col("node").alias("src")), "src")
        score = (F.coalesce(weight(F.col("provenance")), F.lit(0.0)) * factor).alias("score")
        near = near.select("anchor", F.col("dst").alias("node"), score, "provenance")
        best = near.groupBy("anchor", "node").agg(F.min(F.struct((-F.col("score")).alias("s"), "provenance")).alias("e"))
        found = best.join(seen.select("anchor", "node"), ["anchor", "node"], "left_anti")
        frontier = stage(found.select("anchor", "node", (-F.col("e.s")).alias("score"), "e.provenance", F.lit(depth).alias("depth")), f"walk{depth}")
        seen = seen.union(frontier)
        if frontier.isEmpty():
            break
    best = seen.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("s"), "provenance")).alias("e"))
    out = best.select(F.col("node").alias("path"), (-F.col("e.s")).alias("score"), "e.provenance")
    return out.orderBy(F.desc("score"), "path").limit(options.max_nodes)


def tiers(scored: DataFrame, options: Options = Options()) -> DataFrame:
    """``scored`` (at most ``max_nodes`` rows) with ``position`` from 0 and ``tier``: detail, signature or map."""
    w = Window.orderBy(F.desc("score"), "path")
    out = scored.withColumn("position", F.row_number().over(w) - 1)
    if options.flat:
        return out.withColumn("tier", F.lit("detail"))
    n = options.seed_limit
    return out.withColumn("tier", F.when(F.col("position") < n, "detail").when(F.col("position") < 2 * n, "signature").otherwise("map"))


def interleaved(position: Column, n: Column) -> Column:
    """The place of a position in the order first, last, second, last but one, ...; unchanged up to two."""
    half = F.ceil(n / 2)
    return F.when(n <= 2, position).otherwise(F.when(position < half, 2 * position).otherwise(2 * (n - 1 - position) + 1)).cast("int")


def within_budget(blocks: DataFrame, budget: int) -> DataFrame:
    """``blocks`` (``place``, ``size``) up to the first that passes the budget: a strict prefix."""
    w = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("used", F.sum("size").over(w)).where(F.col("used") <= budget)


def chosen_files(edges: DataFrame, seeds: DataFrame, sources: DataFrame | None = None, symbols: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """``path, score, provenance, position, tier, detail, found`` of the files near the anchors ``seeds``.

    At most ``max_nodes`` rows, which are broadcast: sources and symbols are
    filtered by them where they lie, before anything is minified or gathered.
    """
    files = stage(tiers(walk(edges, seeds, options), options), "files")
    wanted = F.broadcast(files.select("path"))
    if sources is not None:
        detail = sources.join(wanted, "path", "left_semi").select("path", X.minified(F.col("text")).alias("detail"))
        files = files.join(detail, "path", "left")
    else:
        files = files.withColumn("detail", F.lit(None).cast("string"))
    if symbols is not None:
        firsts = F.slice(F.sort_array(F.collect_list(F.struct("line", "name", "signature"))), 1, SYMBOLS)
        place = Window.partitionBy("path").orderBy("line", "name", "signature")
        near = symbols.join(wanted, "path", "left_semi").withColumn("__k", F.row_number().over(place)).where(F.col("__k") <= SYMBOLS)
        return files.join(near.groupBy("path").agg(firsts.alias("found")), "path", "left")
    return files.withColumn("found", F.lit(None).cast("array<struct<line:int,name:string,signature:string>>"))


def understand(edges: DataFrame, task: str, sources: DataFrame | None = None, symbols: DataFrame | None = None, options: Options = Options()) -> dict:
    """Text, files and token estimate for a task.

    ``sources`` has ``path, text``, ``symbols`` has ``path, name, line,
    signature``.  At most ``max_nodes`` files reach the driver.
    """
    edges = once(edges, "edges")
    seeds = stage(anchors(edges, task, options), "seeds")
    rows = chosen_files(edges, seeds, sources, symbols, options).orderBy("position").collect()
    seeds_found = [r["path"] for r in seeds.orderBy(F.desc("matches"), "path").collect()]
    text = render(rows, seeds_found, options)
    return {"text": text, "files": rows, "tokens_estimate": len(text.encode()) // 4, "anchors": seeds_found}


def _header(r) -> str:
    return f"{r['path']} [provenance={r['provenance']}, score={r['score']:.2f}]\n"


def render(rows: list, seeds: list[str], options: Options) -> str:
    """The sections MAP, SIGNATURES and DETAIL of a bounded list of files.

    Fixed values: headings, messages and line formats of the output.
    """
    if not rows:
        return f"## MAP\nNo files matched task: {seeds}\n\n(No anchors found — try a different task description.)\n"
    if options.flat:
        return "## DETAIL (flat)\n\n" + "".join(f"{_header(r)}{r['detail'] if r['detail'] is not None else '(source unavailable)'}\n\n" for r in rows)
    out = ["## MAP\n<file> → <key symbols>\n\n"]
    for r in sorted(rows, key=lambda r: r["path"]):
        names = ", ".join(s["name"] for s in r["found"] or []) or "(no symbols extracted)"
        out.append(f"{r['path']} → {names}\n")
    out.append("\n## SIGNATURES\n<file>:<line>  <signature>\n\n")
    for r in rows:
        if r["tier"] != "map":
            out += [f"{r['path']}:{s['line']}  {s['signature']}\n" for s in r["found"] or []] or [f"{r['path']}:0  (no symbols)\n"]
    out.append("\n## DETAIL\n<file> [provenance=…, score=…]\n<source (whitespace-minified)>\n\n")
    detail = [r for r in rows if r["tier"] == "detail"]
    order = detail if len(detail) <= 2 else [detail[i // 2] if i % 2 == 0 else detail[-1 - i // 2] for i in range(len(detail))]
    used = 0
    for r in order:
        if r["detail"] is not None:
            block = f"{_header(r)}{r['detail']}\n\n"
            used += len(block.encode())
            if used > options.token_budget * 4 * 60 // 100:
                break
            out.append(block)
    return "".join(out)
