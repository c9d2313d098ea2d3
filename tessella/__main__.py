"""Command line: ``python -m tessella [--folder GRAPH] COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description="Dependency-graph analytics on Spark")
    p.add_argument("--folder", default=".vfs/graph", help="folder of the edge record")
    p.add_argument("--manifest", help="manifest file")
    s = p.add_subparsers(dest="command", required=True)
    s.add_parser("init")
    warm = s.add_parser("warm")
    warm.add_argument("root")
    warm.add_argument("--language")
    warm.add_argument("--since", help="only files modified after this time")
    related = s.add_parser("related")
    related.add_argument("path")
    related.add_argument("--rel")
    related.add_argument("--direction", default="forward")
    impact = s.add_parser("impact")
    impact.add_argument("path")
    impact.add_argument("--depth", type=int, default=10)
    impact.add_argument("--external", action="store_true")
    for name in ("stats", "untested", "clean", "serve", "rules"):
        s.add_parser(name)
    s.add_parser("module").add_argument("name")
    s.add_parser("search").add_argument("query")
    s.add_parser("understand").add_argument("task")
    s.add_parser("check").add_argument("name")
    s.add_parser("classify").add_argument("root")
    return p


def main(argv: list[str] | None = None) -> int:
    from tessella.operators import associate, classify, imports
    from tessella.plans import manifest as M
    from tessella.plans.service import Service
    from tessella.sources import files as S
    from tessella.sources.edges import EdgeStore, distinct_edges

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessella").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    store = EdgeStore(spark, a.folder)
    if a.command == "init":
        store.init()
        return 0
    if a.command == "clean":
        store.clean()
        return 0
    if a.command == "classify":
        found = classify.classified(S.scan(spark, a.root, classify=True)).withColumn("feature", classify.feature(F.col("path")))
        print(json.dumps({r["role"]: r["cnt"] for r in classify.histogram(found, "role").collect()}))
        return 0
    if a.command == "warm":
        files = S.scan(spark, a.root)
        if a.language:
            files = S.of_language(files, a.language)
        if a.since:
            files = S.changed(files, F.lit(a.since).cast("timestamp"))
        found = imports.import_edges(files).unionByName(associate.test_edges(files))
        if a.manifest:
            with open(a.manifest) as f:
                for e in M.parse(f.read()).graph.extensions:
                    found = found.unionByName(associate.extension_edges(files, e.pattern, e.relation))
        print(json.dumps({"written": store.init().append_new(distinct_edges(found))}))
        return 0
    manifest = None
    if a.manifest:
        with open(a.manifest) as f:
            manifest = M.parse(f.read())
    service = Service(spark, store.load(), manifest)
    if a.command == "serve":
        service.serve()
        return 0
    calls = {
        "related": lambda: service.related(a.path, a.rel, a.direction),
        "impact": lambda: service.impact(a.path, a.depth, a.external),
        "stats": service.stats,
        "untested": service.untested,
        "module": lambda: service.module(a.name),
        "search": lambda: service.search(a.query),
        "understand": lambda: service.understand(a.task),
        "rules": service.rule_list,
        "check": lambda: service.rule_check(a.name),
    }
    try:
        print(json.dumps(calls[a.command](), ensure_ascii=False, default=str))
    except (ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
