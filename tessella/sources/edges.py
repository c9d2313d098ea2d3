"""Edge files and tables: JSON lines as the record, Parquet as the fast copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.staging import stored
from tessella.schema import EDGE, KEY, edges_of

_LINE = T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("rel", T.StringType()), T.StructField("provenance", T.StringType()), T.StructField("confidence", T.FloatType())])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a JSON-lines file or folder, duplicates included.

    Blank and malformed lines are skipped, missing provenance and confidence
    get their defaults, a missing file gives no rows.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], EDGE)
    lines = spark.read.schema(_LINE).option("mode", "PERMISSIVE").json(path)
    return edges_of(lines.withColumnsRenamed({"from": "src", "to": "dst"}))


def to_lines(edges: DataFrame) -> DataFrame:
    """One compact JSON object per edge, keys in the order of the file format."""
    return edges.select(F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "rel", "provenance", "confidence")).alias("value"))


def distinct_edges(edges: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One edge per key, the first by ``order`` (highest confidence without one).

    A hash aggregation with partial results, so no key's rows are gathered.
    """
    if order is None:
        return edges_of(edges).groupBy(*KEY).agg(F.max("confidence").alias("confidence")).select(*EDGE.names)
    first = F.min_by("confidence", F.struct(*order)).alias("confidence")
    return edges.groupBy(*KEY).agg(first).select(*EDGE.names)


def dumped(edges: DataFrame) -> DataFrame:
    """``edges`` in the order of a dump: source, target, relation, provenance."""
    return edges.orderBy("src", "dst", "rel", "provenance")


def new_edges(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose key is not known; duplicates within ``edges`` all stay."""
    return edges.join(known.select(*KEY), KEY, "left_anti").select(*EDGE.names)


def ranked_by_arrival(edges: DataFrame, arrival: str) -> DataFrame:
    """The first writer of each key wins."""
    w = Window.partitionBy(*KEY).orderBy(arrival)
    return edges.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


class EdgeStore:
    """A folder with ``edges.jsonl`` (the record) and ``edges.parquet`` (rebuilt from it)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.lines, self.table = f"{self.folder}/edges.jsonl", f"{self.folder}/edges.parquet"

    def init(self) -> EdgeStore:
        """Create the folder; calling it again changes nothing."""
        where = self._path(self.folder)
        where.getFileSystem(self._conf()).mkdirs(where)
        return self

    def append(self, edges: DataFrame) -> None:
        """Append to the record without looking for duplicates."""
        to_lines(edges_of(edges)).write.mode("append").text(self.lines)

    def append_new(self, edges: DataFrame) -> int:
        """Append the edges that the record does not hold; how many were written.

        Duplicates within the batch are all written.
        """
        fresh = new_edges(edges_of(edges), self.raw()).cache()
        n = fresh.count()
        if n:
            self.append(fresh)
        fresh.unpersist()
        return n

    def raw(self) -> DataFrame:
        return read_lines(self.spark, self.lines)

    def load(self) -> DataFrame:
        """The distinct edges of the record."""
        return distinct_edges(self.raw())

    def rebuild(self, by: str = "dst") -> DataFrame:
        """Write the Parquet copy, sorted by ``by`` so that row groups can be skipped."""
        self.load().repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(self.table)
        return self.read()

    def read(self) -> DataFrame:
        """The Parquet copy as it was last rebuilt; a filter or join on its order prunes row groups."""
        return stored(self.spark.read.schema(EDGE).parquet(self.table))

    def counts(self) -> tuple[int, int]:
        """Raw lines and distinct edges."""
        return self.raw().count(), self.load().count()

    def clean(self) -> None:
        for p in (self.lines, self.table, f"{self.folder}/.last_warm"):
            where = self._path(p)
            where.getFileSystem(self._conf()).delete(where, True)

    def _path(self, p: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()
