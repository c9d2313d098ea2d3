"""A dependency graph derived from relational tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.schema import EDGE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _node(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + "/"), F.col(key).cast("string"))


def _edges(df: DataFrame, src: Column, dst: Column, rel: str = "imports", provenance: str = "ast_exact", confidence: float = 1.0) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), F.lit(provenance).alias("provenance"), F.lit(confidence).cast("float").alias("confidence"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from pages to the targets of their links, one per page and target."""
    target = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    links = table(spark, folder, "pages").select("page_id", target.alias("to")).distinct()
    dst = F.when(F.col("to").startswith(".") | F.col("to").startswith("/"), F.concat(F.lit("local:"), "to")).otherwise(F.concat(F.lit("pkg:"), "to"))
    return _edges(links, _node("pages", "page_id"), dst)


def edge_families(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Each family of edges; only the columns named here are read."""
    t = lambda name: table(spark, folder, name)
    item = t("lineitem")
    return {
        "orders_customer": _edges(t("orders"), _node("orders", "o_orderkey"), _node("customer", "o_custkey")),
        "orders_part": _edges(item.select("l_orderkey", "l_partkey").distinct(), _node("orders", "l_orderkey"), _node("part", "l_partkey")),
        "part_supplier": _edges(item.select("l_partkey", "l_suppkey").distinct(), _node("part", "l_partkey"), _node("supplier", "l_suppkey"), provenance="ast_inferred", confidence=0.8),
        "customer_nation": _edges(t("customer"), _node("customer", "c_custkey"), _node("nation", "c_nationkey")),
        "supplier_nation": _edges(t("supplier"), _node("supplier", "s_suppkey"), _node("nation", "s_nationkey")),
        "nation_region": _edges(t("nation"), _node("nation", "n_nationkey"), _node("region", "n_regionkey")),
        "labels_documents": _edges(t("labels"), _node("labels", "doc_id"), _node("documents", "doc_id"), "tested_by", "heuristic", 0.8),
        "documents_source": _edges(t("documents"), _node("documents", "doc_id"), F.concat(F.lit("pkg:"), "source")),
        "page_links": page_links(spark, folder),
    }


def edges(spark: SparkSession, folder: str, *families: str) -> DataFrame:
    """The chosen families (all without any), distinct by construction."""
    found = edge_families(spark, folder)
    parts = [found[f] for f in (families or found)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*EDGE.names)
