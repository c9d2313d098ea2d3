"""Mixing sources to target weights by capped water-filling (DataFrame only).

Sizes are words.  Each source gets its weight's share of the total; a source
that would pass ``max_epochs`` times its own size is clamped there and the
excess is shared again, by weight, until all targets are feasible.  With the
sources in the order of cap / weight this has a closed form: a source is
clamped if it fills up below the level that the sources behind it would share.

Documents are then repeated: each whole repetition of its source's rate, and
the fraction by a seeded order of the source's documents up to the target.  The
order is by hash; hash ranges below the cut are taken whole, those above not,
and only the range that holds the cut is sorted, so a source with a third of
all rows sorts a small part of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.cluster import WORD, stage

#: Hash ranges of a source: 3 hex digits of the seeded md5.
RANGE_DIGITS = 3

#: Sources up to this many (of 512 bytes at most) are broadcast; others are joined by shuffle.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` with ``__rank`` (from 0) and ``__<c>`` for each of ``sums``: the sum of ``c`` over all rows before.

    Rows are dealt into sampled ranges of ``order``, summed within their range
    and shifted by the sums of the ranges before it, so no task holds them all.
    """
    dealt = stage(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__part").agg(F.count("*").alias("__m"), *[F.sum(c).alias(f"__s_{c}") for c in sums])
    add = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    # one row for each range
    totals = totals.select("__part", add("__m").alias("__m"), *[add(f"__s_{c}").alias(f"__s_{c}") for c in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    dealt = dealt.select("*", own(F.lit(1)).alias("__rank"), *[own(c).alias(f"__{c}") for c in sums]).join(totals, "__part")
    names = [*rows.columns, (F.col("__rank") + F.col("__m")).alias("__rank")]
    return dealt.select(*names, *[(F.col(f"__{c}") + F.col(f"__s_{c}")).alias(f"__{c}") for c in sums])


def water_fill(sizes: DataFrame, max_epochs: int = 3, weights: Column | None = None) -> DataFrame:
    """Targets of the sources: ``source, source_size, weight, target``.

    ``sizes`` has a row for each source with ``source`` (null allowed) and
    ``source_size`` long.  Without ``weights`` the sources, by code point and
    null last, weigh 1, 2, 3, repeating.  Where even all caps do not hold the
    total, each target is its cap.  Empty sources get 0.
    """
    by_name = F.col("source").asc_nulls_last()
    s = sizes.select("source", "source_size", *([weights.alias("weight")] if weights is not None else []))
    if weights is None:
        s = running(s, [by_name], []).withColumn("weight", F.col("__rank") % 3 + 1).drop("__rank")
    s = s.withColumn("weight", F.col("weight").cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    s = running(s.withColumn("fill", F.col("cap") / F.col("weight")), [F.col("fill").asc(), by_name], ["cap", "weight"])
    s = stage(s, "levels")
    whole = s.agg(F.sum("source_size").alias("__all"), F.sum("weight").alias("__weights"))
    # the level that the sources from here on would share, if all before are clamped
    level = (F.col("__all") - F.col("__cap")) / (F.col("__weights") - F.col("__weight"))
    s = s.crossJoin(F.broadcast(whole)).withColumn("__level", level)
    free = s.where(F.col("__level") * F.col("weight") <= F.col("cap"))
    found = free.agg(F.min_by("__level", "__rank").alias("level"))  # one row; sources before it are clamped
    s = s.crossJoin(F.broadcast(found))
    cap = F.col("cap").cast("double")
    return s.select("source", "source_size", "weight", F.coalesce(F.least(F.col("level") * F.col("weight"), cap), cap).alias("target"))


def _digest(seed: int, doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _decided(rows: DataFrame, sizes: DataFrame, max_epochs: int) -> DataFrame:
    """``rows`` (with ``__tsl_id, __tsl_source, __tsl_size, __tsl_md5``) with ``__tsl_epochs`` and the plan of its source.

    ``sizes`` has the same four columns of all rows.  Only the rows of one hash
    range of each source are shuffled.
    """
    spot = F.substring("__tsl_md5", 1, RANGE_DIGITS)
    ranges = stage(sizes.groupBy(F.col("__tsl_source").alias("source"), spot.alias("__range")).agg(F.sum("__tsl_size").alias("__mass")), "ranges")
    plan = water_fill(ranges.groupBy("source").agg(F.sum("__mass").alias("source_size")), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    # words still wanted beyond the whole repetitions; a source without words is taken once
    plan = plan.withColumn("__whole", whole.cast("long")).withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    plan = stage(plan, "targets")
    below = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # the range in which the running sum passes the rest
    at = ranges.withColumn("__below", F.coalesce(F.sum("__mass").over(below), F.lit(0)))
    at = at.join(plan.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    cut = at.where("__below <= __rest and __below + __mass > __rest").groupBy("source").agg(F.min("__range").alias("__cut"), F.min("__below").alias("__cut_below"))
    plan = plan.join(cut.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    plan = stage(plan.select(*[F.col(c).alias("__tsl_" + c.strip("_")) for c in plan.columns]).withColumnRenamed("__tsl_source", "__tsl_s"), "plan")
    bound = plan.agg(F.count("*").alias("n"), F.max(F.octet_length("__tsl_s")).alias("widest")).first()
    small = bound["n"] <= BROADCAST_SOURCES and (bound["widest"] or 0) <= 512
    j = rows.join(F.broadcast(plan) if small else plan, F.col("__tsl_source").eqNullSafe(F.col("__tsl_s"))).drop("__tsl_s")
    here = F.coalesce(spot == F.col("__tsl_cut"), F.lit(False))
    # beyond the whole repetitions, documents without words or of a source that wants no more are not taken
    wanted = (F.col("__tsl_size") > 0) & (F.col("__tsl_rest") > 0)
    outside = j.where(~here).withColumn("__tsl_more", wanted & F.coalesce(spot < F.col("__tsl_cut"), F.lit(False)))
    through = Window.partitionBy("__tsl_source").orderBy("__tsl_md5", "__tsl_id", "__tsl_size", "__tsl_tie").rowsBetween(Window.unboundedPreceding, 0)
    # a document is taken if the middle of its words lies within the rest
    upto = F.col("__tsl_cut_below") + F.sum("__tsl_size").over(through) - F.col("__tsl_size") / 2
    inside = j.where(here).withColumn("__tsl_more", wanted & (upto <= F.col("__tsl_rest")))
    return outside.unionByName(inside).withColumn("__tsl_epochs", F.col("__tsl_whole") + F.col("__tsl_more").cast("long"))


def _keys(docs: DataFrame, seed: int, doc_id: str, text: str, source: str) -> list[Column]:
    return [F.col(doc_id).alias("__tsl_id"), F.col(source).alias("__tsl_source"), words(F.col(text)).alias("__tsl_size"), _digest(seed, F.col(doc_id)).alias("__tsl_md5")]


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each document.

    One row per row of ``docs``: ``doc_id, source, size, source_size, target,
    weight, epochs`` (whole repetitions taken, 0 to ``max_epochs``) and
    ``taken`` (= size * epochs).  The words taken of a source differ from its
    target by less than its longest document.  The order depends only on the
    seed, the id and the size, so reruns agree; rows that agree in all three
    are interchangeable.  Null and empty texts have size 0 and are taken at
    their source's whole rate (once in a source without any words);
    null ids sort as an empty string; null sources are a source; an empty table
    gives no rows.
    """
    rows = stage(docs.select(*_keys(docs, seed, doc_id, text, source)), "sizes")
    found = _decided(rows.withColumn("__tsl_tie", F.lit(0)), rows, max_epochs)
    names = {"id": "doc_id", "source": "source", "size": "size", "source_size": "source_size", "target": "target", "weight": "weight", "epochs": "epochs"}
    return found.select(*[F.col("__tsl_" + a).alias(b) for a, b in names.items()], (F.col("__tsl_size") * F.col("__tsl_epochs")).alias("taken"))


def mixed(docs: DataFrame, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` as often as :func:`mix` takes them.

    Rows stay where they are, but for those of one hash range of each source;
    of rows that agree in id, size and text any may be taken.
    """
    keys = _keys(docs, seed, "doc_id", "text", "source")
    rows = docs.select("*", *keys, F.xxhash64("text").alias("__tsl_tie"))
    found = _decided(rows, stage(docs.select(*keys), "sizes"), max_epochs).where("__tsl_epochs > 0")
    return found.withColumn("__tsl_copy", F.explode(F.sequence(F.lit(1), F.col("__tsl_epochs").cast("int")))).select(*docs.columns)
