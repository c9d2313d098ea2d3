"""Near-duplicate embeddings by an exact metric range join.

Vectors of one label whose cosine reaches the threshold are linked.  On the
unit sphere that is a range join with radius r = sqrt(2 - 2 * threshold).
Pivots, a bounded sample of each label's vectors, split it into cells: a vector
is owned by the cell of its nearest pivot.  By the triangle inequality a link
of a vector x owned by pivot p can only reach into the cell of pivot q if
d(x, q) - d(x, p) <= 2 r (and, on the plane between the two, if
(d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) <= r), so x is copied to just those
cells.  All links of an owned vector then lie in its own cell, and cells join
independently; large cells do so as pairs of blocks.

Equal vectors of a label are joined once, with their number.  Cells give each
vector's number of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.cluster import block_pairs, connected_components, lean, stage, whole_groups

#: Vectors aimed at in a cell; pivots of all labels together at most, and the bytes they may take.
CELL, PIVOTS, PIVOT_BYTES = 4096, 4096, 32 << 20
#: Vectors of a block.
BLOCK = 4096
#: Added to radii, so rounding in distances never loses a copy.
ROUNDING = 1e-6
#: Distance of two pivots below which rounding can swamp the plane between them.
APART = 1e-4


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    ``n_links`` counts the other rows linked directly (copies each count),
    ``component_id`` is the least id reachable by links, and ``kept`` whether
    it is the row's own.  Cosines are computed in double precision.  Rows with
    a null label, or a vector that is null, empty, zero, or holds nulls, NaN or
    infinities, have no links; vectors of different lengths are not linked.
    Finite components of any size are taken exactly as far as doubles go.
    Null ids have a null component and are not kept.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    keyed = rows.withColumn("v", F.when(valid, F.transform("v", lambda x: x + F.lit(0.0))))
    keyed = keyed.select("vec_id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(5), "v").alias("h2"), valid.alias("valid"))
    some = keyed.where("valid")
    nodes = some.groupBy("label", "h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors")
    sizes = nodes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    room = max(1, min(PIVOTS, PIVOT_BYTES // (8 * (sizes["width"] or 1))))
    wanted = min(room, -(-sizes["n"] // CELL))
    # the sample: the least hashes of all vectors; a label without a pivot is one cell
    sample = nodes.select("label", "v").orderBy(F.xxhash64("h1", "h2")).limit(wanted)
    radius = (2 - 2 * threshold) ** 0.5 + ROUNDING
    pivots = spark.sparkContext.broadcast(chosen_pivots([(r["label"], list(r["v"])) for r in sample.collect()], radius))

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        by: dict = {}
        for i, (name, v) in enumerate(pivots.value):
            by.setdefault((name, len(v)), ([], []))[0].append(i)
            by[name, len(v)][1].append(unit(np.array([v]))[0])
        by = {k: (np.array(i), np.stack(u)) for k, (i, u) in by.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                names, lists = part.column(1).to_pylist(), part.column(3)
                width = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                begin = np.cumsum(width) - width
                row, cell, own = [], [], []
                groups: dict = {}
                for i, k in enumerate(zip(names, width.tolist())):
                    groups.setdefault(k, []).append(i)
                for (name, w), at_rows in groups.items():
                    at_rows = np.array(at_rows)
                    found = by.get((name, w))
                    if found is None or len(found[0]) == 1:
                        row.append(at_rows)
                        cell.append(np.full(len(at_rows), -1))
                        own.append(np.ones(len(at_rows), bool))
                        continue
                    x = flat[begin[at_rows][:, None] + np.arange(w)]
                    x = unit(x)
                    p = found[1]
                    nearest, reach = reached(x, p, radius)
                    i, c = np.nonzero(reach)
                    row.append(at_rows[i])
                    cell.append(found[0][c])
                    own.append(c == nearest[i])
                row = pa.array(np.concatenate(row))
                out = [part.column(k).take(row) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.concatenate(cell)), pa.array(np.concatenate(own))], names=["node", "label", "copies", "v", "cell", "own"])

    kind = nodes.schema["label"].dataType.simpleString()
    placed = nodes.select("node", "label", "copies", "v").mapInArrow(lean(assign), f"node long, label {kind}, copies long, v array<double>, cell long, own boolean")
    placed = stage(placed, "cells")
    counts = placed.groupBy("label", "cell").agg(F.count("*").alias("m"))
    dealt = placed.join(counts, ["label", "cell"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = dealt.select(F.xxhash64("label", "cell").alias("key"), F.explode(block_pairs(F.col("blocks"), block)).alias("p"), block.cast("int").alias("block"), "node", "copies", "own", "v", "label", "cell")
    dealt = dealt.select("key", "p.i", "p.j", "block", "node", "copies", "own", "v").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def join(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for t in whole_groups(batches, 3, BLOCK):
            key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(3)])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            block, node, copies, own = (t.column(k).to_numpy(zero_copy_only=False) for k in range(3, 7))
            lists = t.column(7).combine_chunks() if t.column(7).num_chunks != 1 else t.column(7).chunk(0)
            width, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            begin = np.cumsum(width) - width
            who, linked, root = [], [], []
            for s, e in zip(starts, np.append(starts[1:], len(node))):
                for w in np.unique(width[s:e]):
                    at = s + np.flatnonzero(width[s:e] == w)
                    x = flat[begin[at][:, None] + np.arange(w)]
                    x = unit(x)
                    i, j = key[1, s], key[2, s]
                    # between two blocks only pairs across count; within one all do
                    label, number = range_join(x, copies[at], block[at] if i != j else None, threshold)
                    mine = own[at]
                    who.append(node[at])
                    linked.append(np.where(mine, number, 0))
                    root.append(node[at][label])
            cols = [np.concatenate(c) for c in (who, linked, root)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "linked", "root"])

    found = stage(dealt.mapInArrow(lean(join), "node long, linked long, root long"), "linked")
    links = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    parts = connected_components(found.where("node <> root").select("node", "root").distinct())
    named = nodes.select("node", "label", "h1", "h2", "copies", "least").join(links, "node").join(parts, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "h1", "h2", (F.col("linked") + F.col("copies") - 1).alias("n_links"), "component_id")
    named = stage(named, "components")
    out = some.drop("v").join(named, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    # the others all look alike and meet nobody
    out = out.union(keyed.where("not valid").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def unit(x):
    """Rows scaled to length 1; by a power of two first, so that no square overflows or vanishes."""
    import numpy as np

    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def chosen_pivots(sample: list[tuple], radius: float) -> list[tuple]:
    """Of each label's and length's sampled vectors as many, from the first, as make the least work.

    Each cell of p pivots holds c / p of the vectors, where a vector is copied
    to c cells; the pairs compared then grow with c * c / p.  Where distances
    concentrate, copies eat up what cells save, and one cell (in blocks) is best.
    """
    import numpy as np

    groups: dict = {}
    for name, v in sample:
        groups.setdefault((name, len(v)), []).append(v)
    out = []
    for (name, _), vectors in groups.items():
        x, best, take, p = unit(np.array(vectors, float)), 1.0, 1, 2
        while p <= len(x):
            copies = np.mean([reached(x[s : s + 512], x[:p], radius)[1].sum(1).mean() for s in range(0, len(x), 512)])
            if copies * copies / p < best:
                best, take = copies * copies / p, p
            p = p * 2 if p * 2 <= len(x) or p == len(x) else len(x)
        out += [(name, v) for v in vectors[:take]]
    return out


def reached(x, p, radius: float):
    """The nearest of the pivots ``p`` to each unit vector, and a mask of the cells within ``radius`` of it."""
    import numpy as np

    square = np.maximum(2 - 2 * (x @ p.T), 0)
    nearest = square.argmin(1)
    least = square[np.arange(len(x)), nearest][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[nearest]
    reach = np.sqrt(square) - np.sqrt(least) <= 2 * radius
    plane = (square - least) / (2 * np.maximum(apart, APART))
    reach &= (plane <= radius) | (apart <= APART)
    reach[np.arange(len(x)), nearest] = True
    return nearest, reach


def range_join(x, copies, block, threshold: float):
    """Component labels and numbers of linked others among unit vectors.

    With ``block`` only pairs of different blocks are counted.
    """
    import numpy as np

    n, step = len(x), 512
    number = np.zeros(n, np.int64)
    label = np.arange(n)
    open_ = np.ones(n, bool)
    near = []
    for s in range(0, n, step):
        hit = x[s : s + step] @ x.T >= threshold
        hit[np.arange(len(hit)), np.arange(s, s + len(hit))] = False
        if block is not None:
            hit &= block[s : s + step, None] != block[None, :]
        number[s : s + step] = hit @ copies
        near += [np.packbits(h) if h.any() else None for h in hit]
    for first in range(n):
        if open_[first]:
            open_[first], todo = False, [first]
            while todo:
                i = todo.pop()
                if near[i] is not None:
                    more = np.flatnonzero(np.unpackbits(near[i], count=n).astype(bool) & open_)
                    label[more], open_[more] = first, False
                    todo.extend(more.tolist())
    return label, number
