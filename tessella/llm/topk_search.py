"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are quantised to integers.  A task takes ROWS rows at a time and builds
their index: for each dimension, the rows in segments of neighbouring quantised
values (an impact level each).  A query visits (dimension, segment) pairs by
descending contribution above the dimension's least one.  A row's lower bound
is what it has gathered, plus the least of all open dimensions; its upper bound
adds the greatest unread impact of each dimension.  Processing stops only when
the bounds prove that few rows can still be among the k best, or reach the k-th
score that the task has met before; all of these are rescored exactly, so the
result is exact whatever the data; at worst all segments are read.

Queries go in rounds of a bounded size, broadcast to all tasks.  In a round
rows are read once, where they lie, an index is built once for each ROWS rows,
and only each index's k best rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.cluster import lean, release, stage

SCALE = 1024
#: Rows of an index, and bytes of the queries of a round (about).
ROWS, QUERY_BYTES = 16384, 16 << 20
#: Impact levels of a dimension, the shares of the segments after which the bounds
#: are looked at, and the share of an index's rows that may be rescored.
LEVELS, LOOK, RESCORE = 16, (0.4, 0.6, 0.7, 0.8, 0.9), 0.05
#: Squared length from which a quantised vector's scores may not fit into 64 bits.
LONGEST = float(1 << 62)


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, x``: floor(1024 * component) as longs, without vectors that take no part."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long"))
    square = F.aggregate(v, F.lit(0.0), lambda a, c: a + (c * F.lit(float(SCALE))) * (c * F.lit(float(SCALE))))
    long_ = F.raise_error(F.concat(F.lit("vector too long for scores of 64 bits: "), F.col(vec_id).cast("string")))
    kept = vectors.where(F.coalesce(fine, F.lit(False)) & F.col(vec_id).isNotNull())
    return kept.select(F.col(vec_id).alias("vec_id"), F.when(square < LONGEST, x).otherwise(long_.cast("array<bigint>")).alias("x"))


class Block:
    """The impact-ordered index of some rows, an integer matrix."""

    def __init__(self, x):
        import numpy as np

        self.x, (n, dims) = x, x.shape
        self.postings = np.argsort(x, axis=0, kind="stable").astype(np.int32).T.copy()
        self.values = np.take_along_axis(x.T, self.postings, 1)
        # a level holds neighbours in a dimension's order, about as many as any other
        self.edges = np.unique(np.linspace(0, n, LEVELS + 1).astype(int))
        self.low = self.values[:, self.edges[:-1]]
        self.high = self.values[:, self.edges[1:] - 1]

    def search(self, q, k: int, bar: int | None = None):
        """Positions and scores of all rows that can be among the k best for q and score ``bar`` or more."""
        import numpy as np

        n, dims = self.x.shape
        if n <= 4 * k or dims == 0:
            return np.arange(n), self.x @ q
        ends = self.low * q[:, None], self.high * q[:, None]
        least = np.minimum(*ends).min(1)
        impact = np.maximum(*ends) - least[:, None]
        order = np.argsort(-impact, axis=None, kind="stable")
        dim, level = np.unravel_index(order, impact.shape)
        base = int(least.sum())  # of every row
        if bar is not None and base + int(impact.max(1).sum()) < bar:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gained = np.zeros(n, np.int64)  # above the base
        at = 0
        for share in LOOK:
            upto = int(share * len(order))
            self.add(gained, q, least, dim[at:upto], level[at:upto])
            at = upto
            # an unread segment adds at most its impact; they come in descending order
            rest = np.zeros(dims, np.int64)
            np.maximum.at(rest, dim[at:], impact[dim[at:], level[at:]])
            own = int(np.partition(gained, n - k)[n - k])
            need = own if bar is None else max(own, bar - base)
            can = np.flatnonzero(gained + int(rest.sum()) >= need)
            if len(can) <= max(4 * k, RESCORE * n):  # proof: no other row gets there
                return can, self.x[can] @ q
        self.add(gained, q, least, dim[at:], level[at:])
        can = np.flatnonzero(gained >= np.partition(gained, n - k)[n - k])
        return can, self.x[can] @ q

    def add(self, gained, q, least, dims, levels) -> None:
        for d, s in zip(dims.tolist(), levels.tolist()):
            a, b = self.edges[s], self.edges[s + 1]
            gained[self.postings[d, a:b]] += self.values[d, a:b] * q[d] - least[d]


def matrices(ids, lists) -> dict[int, tuple]:
    """Ids and vectors by their length, from Arrow columns."""
    import numpy as np

    width, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    begin, ids = np.cumsum(width) - width, np.array(ids.to_pylist())
    return {int(w): (ids[at], flat[begin[at][:, None] + np.arange(w)]) for w in np.unique(width) for at in [np.flatnonzero(width == w)]}


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows of ``vectors``.

    Scores are inner products of the vectors times 1024, floored; ties go to
    the smaller id, and repeated rows count each, also as queries of their own
    (a repeated query id has its k best rows once).  A row with the query's own
    id is no candidate.  Vectors that are null or hold null, NaN or infinite
    components take no part on either side, nor do vectors of other lengths
    than the query's; queries or rows without an id take no part.  A vector of
    length 2^31 / 1024 or more, whose scores might not fit into 64 bits, is an
    error that names it.  With fewer than k candidates all are returned; an
    empty table gives none.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, embedding)
    rows = stage(rows.repartition(max(spark.sparkContext.defaultParallelism, 1)) if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else rows, "rows")
    asked = stage(quantised(queries, vec_id, embedding).withColumn("q", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.coalesce(F.sum(8 * F.size("x") + 16), F.lit(0))).first()[0]
    rounds = max(1, -(-size // QUERY_BYTES))
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for r in range(rounds):
        t = asked.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r).dropDuplicates(["vec_id", "x"]).select("vec_id", "x").toArrow().combine_chunks()
        if not t.num_rows:
            continue
        lists = t.column("x").chunk(0) if t.column("x").num_chunks == 1 else t.column("x").combine_chunks()
        sent = spark.sparkContext.broadcast(matrices(t.column("vec_id"), lists))

        def search(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            bars: dict[tuple[int, int], int] = {}

            def solve(held):
                found: list[list] = [[], [], []]
                t = pa.Table.from_batches(held).combine_chunks()
                for w, (ids, x) in matrices(t.column(0), t.column(1).chunk(0)).items():
                    if w not in sent.value:
                        continue
                    block = Block(x)
                    for i, (query, q) in enumerate(zip(*sent.value[w])):
                        same = int(np.count_nonzero(ids == query))
                        at, score = block.search(q, k + same, bars.get((w, i)))
                        other = ids[at] != query
                        at, score = at[other], score[other]
                        first = np.lexsort((ids[at], -score))[:k]
                        if len(first) == k:
                            bars[w, i] = max(int(score[first[-1]]), bars.get((w, i), -(1 << 63)))
                        found[0].append(np.full(len(first), query))
                        found[1].append(ids[at][first])
                        found[2].append(score[first])
                cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]
                types = [held[0].schema.field(0).type] * 2 + [pa.int64()]
                return pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(cols, types)], names=["query_id", "vec_id", "score"])

            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= ROWS:
                    yield solve(held)
                    held, n = [], 0
            if n:
                yield solve(held)

        near = rows.mapInArrow(lean(search), f"query_id {kind}, vec_id {kind}, score long")
        ranked = near.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
        out = out.union(stage(ranked.select("query_id", "rank", "vec_id", "score"), "round"))
        sent.unpersist()
    release(rows, asked)
    return out
