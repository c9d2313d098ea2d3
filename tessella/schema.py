"""The edge table, node kinds and provenance weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Internal column names; ``from`` and ``to`` are SQL keywords and used in files and rules only.
EDGE = T.StructType(
    [
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("rel", T.StringType(), False),
        T.StructField("provenance", T.StringType(), False),
        T.StructField("confidence", T.FloatType(), False),
    ]
)
KEY = ["src", "dst", "rel", "provenance"]

#: The weight of each provenance, and defaults of old edge files.
WEIGHTS = {"ast_exact": 1.0, "ast_inferred": 0.8, "heuristic": 0.5, "lexical": 0.3, "latent": 0.3, "unresolved": 0.0}
DEFAULT_PROVENANCE, DEFAULT_CONFIDENCE = "ast_exact", 1.0

#: Prefixes of nodes that are no files.
PREFIXES = {"pkg:": "package", "std:": "standard", "sys:": "system", "local:": "local", "external:": "external"}


def edges_of(df: DataFrame) -> DataFrame:
    """``df`` with exactly the edge columns: defaults for missing ones, no row without a key.

    Three-column tables of the first format get the default provenance and
    confidence, as do nulls in those columns.
    """
    for name, default in (("provenance", DEFAULT_PROVENANCE), ("confidence", DEFAULT_CONFIDENCE)):
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default))
    cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in EDGE.fields]
    return df.where("src is not null and dst is not null and rel is not null").select(*cast)


def node_kind(node: Column) -> Column:
    """package, standard, system, local, external or file."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, kind in PREFIXES.items():
        out = out.when(node.startswith(prefix), F.lit(kind))
    return out.otherwise(F.lit("file"))


def weight(provenance: Column) -> Column:
    """The weight of a provenance, whatever its case; null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.element_at(table, F.lower(provenance))
