"""Helpers shared by the corpus operators: staging, sizing, components."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a local one
    is set; on a cluster each node would write to its own disk, so that fails.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows that a Python worker gets at once while a table is staged, as texts can be long.
ARROW_ROWS = 256
_batches = {"lock": threading.Lock(), "users": 0, "before": ""}


@contextmanager
def small_batches(spark: SparkSession):
    """Batches of ARROW_ROWS rows as long as any thread is in here."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _batches["lock"]:
        _batches["users"] += 1
        if _batches["users"] == 1:
            _batches["before"] = spark.conf.get(rows)
            spark.conf.set(rows, str(ARROW_ROWS))
    try:
        yield
    finally:
        with _batches["lock"]:
            _batches["users"] -= 1
            if _batches["users"] == 0:
                spark.conf.set(rows, _batches["before"])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, and a lost executor costs no recomputation.  The
    files stay until :func:`release` or the end of the job.  Python workers get
    small batches meanwhile.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker gives the memory of the task back.

    Workers are reused, and an executor keeps several; without this each holds
    on to the most that any of its tasks took.
    """

    def task(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(ctypes.CDLL(None), "malloc_trim"):
            ctypes.CDLL(None).malloc_trim(0)

    return task


def slices(texts, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs (start, count) of rows of an Arrow string column with about ``size`` bytes, a row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > size:
            yield start, i - start
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes) - start


def release(*staged: DataFrame) -> None:
    """Delete staged tables that no plan needs any longer."""
    for df in staged:
        spark, path = df.sparkSession, getattr(df, "_staged_at", None)
        if path:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_key(text: Column) -> list[Column]:
    """A 128-bit key of a text (null counts as empty), as two longs k1, k2."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(7), whole, F.octet_length(whole)).alias("k2")]


def one_of_each(texts: DataFrame) -> DataFrame:
    """One row per key of ``k1, k2, text``, whatever join follows.

    Copies already meet in the task that reads them, so a large group of copies
    sends one row from each task.
    """
    return texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars.

    ``edges`` has two columns of one ordered type; the result has ``node`` and
    ``component`` (the least node reachable) for each node on some edge that is
    no loop.  Every step is a hash aggregation and an equi-join; no group is
    gathered.  Least neighbours are staged, so that adaptive execution sees two
    plain shuffles under each join and splits a hub's partition.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = stage(now, "links"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (mark["n"], mark["h"]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v"), F.col("v")).distinct()
            )
        seen = (mark["n"], mark["h"])
        both = now.union(now.select("v", "u"))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "large")
        floor = stage(large.groupBy("u").agg(F.min("v").alias("m")), "floor")
        joined = large.join(floor, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(floor)
        after = stage(small.distinct(), "links")
        release(now, least, large, floor)
        now = after


def whole_groups(batches, keys: int, rows: int):
    """Arrow tables of whole groups from batches sorted by their first ``keys`` columns.

    A table has about ``rows`` rows, or one group if that is larger; the last,
    open group of a table goes on to the next.
    """
    import numpy as np
    import pyarrow as pa

    held, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            count += held[-1].num_rows
            if count >= rows:
                t = pa.Table.from_batches(held).combine_chunks()
                last = np.ones(count, bool)
                for k in range(keys):
                    column = t.column(k).to_numpy()
                    last &= column == column[-1]
                cut = int(np.argmax(last))  # sorted, so the open group is the tail
                if cut:
                    yield t.slice(0, cut)
                held, count = t.slice(cut).to_batches(), count - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def block_pairs(blocks: Column, own: Column) -> Column:
    """The pairs (i, j), i <= j, of blocks in which a row of block ``own`` takes part.

    With them each two rows of a group meet in one task, and a task holds two
    blocks at most, however large the group.
    """
    every = F.sequence(F.lit(0), blocks.cast("int") - 1)
    pairs = F.transform(every, lambda k: F.struct(F.least(own.cast("int"), k).alias("i"), F.greatest(own.cast("int"), k).alias("j")))
    return F.when(blocks <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)
