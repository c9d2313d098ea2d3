"""Deterministic text search over graph nodes or documents: TF-IDF, BM25, rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.graph import nodes, well_formed
from tessella.plans.staging import stage

K1, B, FUSION = 1.2, 0.75, 60
LIMIT = 20


def documents_of(edges: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``path, symbols`` of all nodes; ``symbols`` (``path, symbols``) may add to some."""
    found = nodes(edges).select(F.col("node").alias("path"))
    if symbols is None:
        return found.withColumn("symbols", F.array().cast("array<string>"))
    return found.join(symbols, "path", "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))


def _count(terms: str, word: str):
    return F.size(F.filter(terms, lambda t: t == F.lit(word)))


class Index:
    """Term statistics of ``documents`` (``path`` unique, ``symbols`` array<string>).

    ``terms`` has a row per document; everything else is derived lazily, so a
    query only counts its own words.  These counts, a few numbers per document,
    are staged, so that texts are tokenised once a query.
    """

    def __init__(self, documents: DataFrame):
        self._counted: dict[str, tuple[list[str], DataFrame]] = {}
        self.terms = documents.select("path", X.document_tokens(F.col("path"), F.col("symbols")).alias("terms"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        """An index that :meth:`write` has stored; queries then read terms, not texts."""
        made = cls.__new__(cls)
        made._counted, made.terms = {}, spark.read.schema("path string, terms array<string>").parquet(path)
        return made

    def write(self, path: str) -> Index:
        self.terms.write.mode("overwrite").parquet(path)
        return Index.read(self.terms.sparkSession, path)

    def postings(self) -> DataFrame:
        """``path, term, tf``; counts are summed before the shuffle."""
        return self.terms.select("path", F.explode("terms").alias("term")).groupBy("path", "term").agg(F.count("*").alias("tf"))

    def document_frequency(self) -> DataFrame:
        """``term, df``: each document tells each of its terms once, and partial sums shrink the shuffle."""
        return self.terms.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    def corpus(self) -> DataFrame:
        """One row ``n_docs, avg_len``; documents without terms count."""
        return self.terms.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg(F.size("terms")), F.lit(0.0)).alias("avg_len"))

    def _count(self, query: str) -> tuple[list[str], DataFrame]:
        if query not in self._counted:
            spark = self.terms.sparkSession
            words = [r["w"] for r in spark.range(1).select(F.explode(X.tokens(F.lit(query))).alias("w")).collect()]
            counts = [_count("terms", w).alias(f"tf{k}") for k, w in enumerate(words)]
            self._counted[query] = words, stage(self.terms.select("path", F.size("terms").alias("len"), *counts), "counted")
        return self._counted[query]

    def _matches(self, query: str) -> DataFrame:
        """``path, len, term, tf, df, n_docs, avg_len`` for the query's words (each once).

        One pass finds term counts by array functions, without exploding texts.
        """
        words, counted = self._count(query)
        # one row: the corpus and each word's document frequency
        totals = counted.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"), *[F.count(F.when(F.col(f"tf{k}") > 0, 1)).alias(f"df{k}") for k in range(len(words))])
        rows = F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"tf{k}").alias("tf"), F.col(f"df{k}").alias("df")) for k, w in enumerate(words)])
        if not words:
            return self.terms.limit(0).select("path", F.lit(0).alias("len"), F.lit("").alias("term"), F.lit(0).alias("tf"), F.lit(0).alias("df"), F.lit(0).alias("n_docs"), F.lit(0.0).alias("avg_len"))
        hit = counted.where(" or ".join(f"tf{k} > 0" for k in range(len(words))))
        out = hit.crossJoin(F.broadcast(totals)).select("path", "len", "n_docs", "avg_len", F.explode(rows).alias("t"))
        return out.select("path", "len", "t.term", "t.tf", "t.df", "n_docs", "avg_len").where("tf > 0")

    def _scored(self, query: str, gain) -> DataFrame:
        # a fixed order of summation: words are few, and so are a document's rows
        parts = self._matches(query).withColumn("gain", gain).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("term", "gain"))).alias("g"))
        score = F.aggregate("g", F.lit(0.0), lambda a, x: a + x["gain"])
        return parts.select("path", score.alias("score")).where("score > 0")

    def tfidf(self, query: str) -> DataFrame:
        """``path, score``: sum of tf * ln(N / df); terms of every document add nothing."""
        return self._scored(query, F.col("tf") * F.log(F.col("n_docs") / F.col("df")))

    def bm25(self, query: str) -> DataFrame:
        """``path, score`` with k1 = 1.2 and b = 0.75."""
        df, tf = F.col("df"), F.col("tf")
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1.0)))
        return self._scored(query, idf * tf * (K1 + 1) / (tf + norm))

    def search(self, query: str, limit: int = LIMIT) -> DataFrame:
        """``file_path, symbols, score, provenance``, best first: both rankings fused.

        ``symbols`` are the query's words that the path holds.  Malformed nodes
        are left out after ranking.
        """
        fused = fuse(self.tfidf(query), self.bm25(query)).where(well_formed(F.col("path")))
        words = X.tokens(F.lit(query))
        inside = F.filter(words, lambda w: F.array_contains(X.tokens(F.col("path")), w))
        top = fused.orderBy(F.desc("score"), "path").limit(limit)
        return top.select(F.col("path").alias("file_path"), inside.alias("symbols"), "score", F.lit("lexical").alias("provenance"))


def ranked(scores: DataFrame, name: str) -> DataFrame:
    """``path`` and its rank from 1, by score and then path.

    A distributed sort: rows are dealt into ranges, ranked within their range,
    and shifted by the number of rows in the ranges before it.
    """
    dealt = scores.repartitionByRange(F.desc("score"), F.asc("path")).withColumn("part", F.spark_partition_id())
    dealt = stage(dealt.select("path", "score", "part"), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    shift = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), "path"))
    return dealt.withColumn("own", own).join(F.broadcast(shift), "part").select("path", (F.col("own") + F.col("shift")).alias(name))


def fuse(first: DataFrame, second: DataFrame, k: int = FUSION) -> DataFrame:
    """``path, score``: reciprocal rank fusion, sum of 1 / (k + rank)."""
    both = ranked(first, "a").join(ranked(second, "b"), "path", "full")
    share = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.select("path", (share("a") + share("b")).alias("score"))
