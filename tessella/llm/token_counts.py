"""Exact token counts for every context limit, from one histogram of lengths.

Documents are aggregated by encoded length as soon as they are encoded, so a
task sends on one row for each length it met.  Suffix sums over the histogram
then answer, for a context limit L: the documents and tokens at or above L, the
tokens left when each document is cut to L tokens, and the quantile at L.

The sums run in two levels (blocks of lengths, then lengths within a block), so
no task ever holds the whole histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import bpe
from tessella.llm.cluster import stage

#: Lengths in a block of the two-level sums.
BLOCK = 64


def histogram(docs: DataFrame, tokenizer_path: str, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``n_tokens`` and ``n_docs``: the documents of each encoded length.

    Null texts count as empty (length 0); repeated rows count each; null keys
    in ``by`` are a group of their own.
    """
    counted = bpe.lengths(docs, tokenizer_path, text, by).groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))
    return stage(counted, "lengths")  # the sums read it twice, the texts are encoded once


def context_totals(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Suffix sums of a length histogram, one row per length that occurs.

    For the row of length L: ``docs_ge`` and ``tokens_ge`` (documents of L
    tokens or more), ``truncated_tokens`` (all tokens left if each document is
    cut to L), ``total_docs``, ``total_tokens`` and ``quantile`` (the share of
    documents with at most L tokens).  Between two lengths that occur every
    answer is linear in the limit: see :func:`at_limit`.  An empty histogram
    gives no rows.
    """
    h = hist.withColumn("__block", (F.col("n_tokens") / BLOCK).cast("long"))
    mass = F.col("n_tokens") * F.col("n_docs")
    blocks = h.groupBy(*by, "__block").agg(F.sum("n_docs").alias("__d"), F.sum(mass).alias("__t"))
    above = Window.partitionBy(*by).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    blocks = blocks.select(
        *by,
        "__block",
        F.coalesce(F.sum("__d").over(above), F.lit(0)).alias("__d_above"),
        F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__t_above"),
        F.sum("__d").over(whole).alias("total_docs"),
        F.sum("__t").over(whole).alias("total_tokens"),
    )
    inner = Window.partitionBy(*by, "__block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.select(*by, "__block", "n_tokens", "n_docs", F.sum("n_docs").over(inner).alias("__d_in"), F.sum(mass).over(inner).alias("__t_in"))
    same = F.col("h.__block") == F.col("b.__block")
    for c in by:
        same &= F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}"))
    j = h.alias("h").join(blocks.alias("b"), same)
    docs_ge, tokens_ge = F.col("__d_in") + F.col("__d_above"), F.col("__t_in") + F.col("__t_above")
    return j.select(
        *[F.col(f"h.{c}").alias(c) for c in by],
        "n_tokens",
        "n_docs",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("total_tokens") - tokens_ge + F.col("n_tokens") * docs_ge).alias("truncated_tokens"),
        "total_docs",
        "total_tokens",
        ((F.col("total_docs") - docs_ge + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def at_limit(totals: DataFrame, limit: int) -> DataFrame:
    """Totals at any context limit: documents and tokens kept whole or cut.

    One row: ``n_docs``, ``n_cut`` (documents longer than the limit) and
    ``n_tokens`` left.  Zeros for an empty table.
    """
    over = F.col("n_tokens") > limit
    return totals.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("n_cut"),
        F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("n_tokens"),
    )


def quantile(totals: DataFrame, q: float) -> DataFrame:
    """One row ``n_tokens``: the least length with at least the share q of the documents."""
    return totals.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
