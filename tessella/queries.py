"""Registered queries of the graph engine and their SQL for an independent engine.

The relational tables have no source code, so most queries run on a graph
derived from them in the same way on both sides; parsers and path rules run on
literal rows that both sides share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions.languages import language
from tessella.operators import associate, classify, context, graph, imports, permissions
from tessella.operators.search import Index, fuse
from tessella.plans import rules
from tessella.plans.staging import once, shared_dir, stage
from tessella.schema import node_kind
from tessella.sources import edges as E
from tessella.sources import files as S
from tessella.sources import relational as R
from tessella.streaming import events as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _double(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.col("confidence").cast("double"))


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    """A SQL common table of literal rows."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


_EDGES = """edges AS (
  SELECT concat('orders/', o_orderkey) AS src, concat('customer/', o_custkey) AS dst, 'imports' AS rel, 'ast_exact' AS provenance, CAST(1.0 AS REAL) AS confidence FROM orders
  UNION ALL SELECT DISTINCT concat('orders/', l_orderkey), concat('part/', l_partkey), 'imports', 'ast_exact', CAST(1.0 AS REAL) FROM lineitem
  UNION ALL SELECT DISTINCT concat('part/', l_partkey), concat('supplier/', l_suppkey), 'imports', 'ast_inferred', CAST(0.8 AS REAL) FROM lineitem
  UNION ALL SELECT concat('customer/', c_custkey), concat('nation/', c_nationkey), 'imports', 'ast_exact', CAST(1.0 AS REAL) FROM customer
  UNION ALL SELECT concat('supplier/', s_suppkey), concat('nation/', s_nationkey), 'imports', 'ast_exact', CAST(1.0 AS REAL) FROM supplier
  UNION ALL SELECT concat('nation/', n_nationkey), concat('region/', n_regionkey), 'imports', 'ast_exact', CAST(1.0 AS REAL) FROM nation
  UNION ALL SELECT concat('labels/', doc_id), concat('documents/', doc_id), 'tested_by', 'heuristic', CAST(0.8 AS REAL) FROM labels
  UNION ALL SELECT concat('documents/', doc_id), concat('pkg:', source), 'imports', 'ast_exact', CAST(1.0 AS REAL) FROM documents
  UNION ALL SELECT DISTINCT concat('pages/', page_id), CASE WHEN u[1:1] IN ('.', '/') THEN concat('local:', u) ELSE concat('pkg:', u) END, 'imports', 'ast_exact', CAST(1.0 AS REAL)
    FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS u FROM pages))"""
_W = f"WITH {_EDGES} "
_WR = f"WITH RECURSIVE {_EDGES}, "


# --- edges and sets ---------------------------------------------------------


@query(_W + "SELECT DISTINCT src, dst, rel, provenance, CAST(confidence AS DOUBLE) AS confidence FROM edges")
def edges_all(spark, d):
    return _double(E.distinct_edges(R.edges(spark, d)))


@query(_W + "SELECT count(*) AS raw_edges, (SELECT count(*) FROM (SELECT DISTINCT src, dst, rel, provenance FROM edges)) AS distinct_edges FROM edges")
def edge_count_raw_vs_distinct(spark, d):
    raw = R.edges(spark, d)
    return raw.agg(F.count("*").alias("raw_edges")).crossJoin(E.distinct_edges(raw).agg(F.count("*").alias("distinct_edges")))


@query("SELECT concat('{\"from\":\"nation/', n_nationkey, '\",\"to\":\"region/', n_regionkey, '\",\"rel\":\"imports\",\"provenance\":\"ast_exact\",\"confidence\":1.0}') AS value FROM nation")
def edge_lines(spark, d):
    return E.to_lines(R.edges(spark, d, "nation_region"))


@query(_W + "SELECT side, node FROM (SELECT DISTINCT 'src' AS side, src AS node FROM edges UNION ALL SELECT DISTINCT 'dst', dst FROM edges)")
def distinct_files(spark, d):
    return graph.distinct_files(R.edges(spark, d))


@query(_W + """SELECT kind, count(*) AS cnt FROM (SELECT CASE WHEN n LIKE 'pkg:%' THEN 'package' WHEN n LIKE 'std:%' THEN 'standard' WHEN n LIKE 'local:%' THEN 'local' ELSE 'file' END AS kind
  FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges)) GROUP BY kind""")
def node_kinds(spark, d):
    return graph.nodes(R.edges(spark, d)).groupBy(node_kind(F.col("node")).alias("kind")).agg(F.count("*").alias("cnt"))


@query(_W + "SELECT src, dst, rel, provenance, CAST(confidence AS DOUBLE) AS confidence FROM edges WHERE rel = 'tested_by' EXCEPT SELECT concat('labels/', doc_id), concat('documents/', doc_id), 'tested_by', 'heuristic', CAST(CAST(0.8 AS REAL) AS DOUBLE) FROM labels WHERE quality = 0")
def delta_edges(spark, d):
    now = R.edges(spark, d, "labels_documents")
    known = R.table(spark, d, "labels").where("quality = 0").select(F.concat(F.lit("labels/"), F.col("doc_id").cast("string")).alias("src"))
    return _double(graph.diff(now, now.join(known, "src", "left_semi").select(*now.columns)))


@query(_W + "SELECT src, dst, rel, provenance, CAST(confidence AS DOUBLE) AS confidence FROM edges WHERE rel = 'imports' AND dst LIKE 'region/%' AND dst <> 'region/1'")
def insert_or_ignore(spark, d):
    rows = R.edges(spark, d, "nation_region")
    return _double(E.new_edges(rows, rows.where("dst = 'region/1'")))


# --- neighbours -------------------------------------------------------------


@query(_W + "SELECT src, dst, rel, provenance, CAST(confidence AS DOUBLE) AS confidence FROM edges WHERE src = 'part/7'")
def related_forward(spark, d):
    return _double(graph.related(R.edges(spark, d), "part/7"))


@query(_W + "SELECT src, dst, rel, provenance, CAST(confidence AS DOUBLE) AS confidence FROM edges WHERE dst = 'supplier/3'")
def related_reverse(spark, d):
    return _double(graph.related(R.edges(spark, d), "supplier/3", way="incoming"))


@query(_W + "SELECT src, dst, rel, provenance, CAST(confidence AS DOUBLE) AS confidence FROM edges WHERE dst IN ('documents/0', 'pkg:src3') AND rel = 'tested_by'")
def related_rel_filter(spark, d):
    return _double(graph.related(R.edges(spark, d), "documents/0", "tested_by", "reverse", package="pkg:src3"))


@query(_W + "SELECT src, dst, rel, provenance, CAST(confidence AS DOUBLE) AS confidence FROM edges WHERE src = 'nation/4'")
def related_spellings(spark, d):
    return _double(graph.related_any(R.edges(spark, d), "./nation/4"))


@query(_W + "SELECT p AS path, EXISTS (SELECT 1 FROM edges WHERE src = p OR dst = p) AS known FROM (VALUES ('region/0'), ('region/99'), ('pkg:src1')) t(p)")
def node_exists(spark, d):
    edges = R.edges(spark, d)
    return spark.createDataFrame([(p, graph.node_exists(edges, p)) for p in ("region/0", "region/99", "pkg:src1")], "path string, known boolean")


@query(_W + "SELECT dst, rel, count(*) AS cnt FROM edges GROUP BY dst, rel")
def group_by_dependency(spark, d):
    return graph.group_by_dependency(R.edges(spark, d))


@query(_W + "SELECT dst, count(*) AS cnt FROM edges WHERE dst NOT LIKE 'pkg:{%' GROUP BY dst ORDER BY cnt DESC, dst LIMIT 10")
def top_dependencies(spark, d):
    return graph.top_dependencies(R.edges(spark, d))


@query(_W + "SELECT rel, count(*) AS cnt FROM edges GROUP BY rel")
def edge_types(spark, d):
    return graph.edge_types(R.edges(spark, d))


@query(_W + "SELECT DISTINCT src AS path FROM edges WHERE src NOT IN (SELECT dst FROM edges)")
def orphans(spark, d):
    return graph.orphans(R.edges(spark, d))


def _is_test(p: str) -> str:
    """The rules of test paths, one condition each (fixed values), on a lower-case path."""
    folders = [f"contains(concat('/', replace({p}, chr(92), '/'), '/'), '/{x}/')" for x in ("test", "tests", "benches", "__tests__")]
    anywhere = [f"contains({p}, '{x}')" for x in ("_test.", ".test.", "_spec.", "__test__")]
    endings = [f"ends_with({p}, '{x}.{e}')" for x in ("test", "tests") for e in ("java", "cs", "kt", "php", "swift", "hs", "scala", "elm")]
    endings += [f"ends_with({p}, '{x}')" for x in ("spec.hs", "spec.scala", "_suite.erl", "runtests.jl")]
    return "(" + " OR ".join([f"starts_with({p}, 'test_')", f"starts_with({p}, 'test-') AND ends_with({p}, '.r')", *anywhere, *folders, *endings]) + ")"


def _is_entry(p: str) -> str:
    """The names of entry points (fixed values), as endings of a lower-case path."""
    names = [f"main.{e}" for e in "rs go py c cpp js ts rb kt swift hs lhs erl scala zig lua dart clj ml r jl elm nim".split()]
    names += "index.js index.ts index.php __main__.py program.cs mix.exs application.ex escript.erl app.scala init.lua core.clj".split()
    return "(" + " OR ".join(f"ends_with({p}, '{n}')" for n in names) + ")"


_UNTESTED = f"SELECT DISTINCT src AS path FROM edges WHERE rel = 'imports' AND src NOT IN (SELECT dst FROM edges WHERE rel = 'tested_by') AND NOT {_is_test('lower(src)')}"


@query(_W + _UNTESTED)
def untested(spark, d):
    return graph.untested(R.edges(spark, d))


@query(
    _W + f"""SELECT count(*) AS total_edges, count(DISTINCT src) AS total_files, count(DISTINCT dst) AS unique_dependencies, count(DISTINCT rel) AS unique_relations,
  (SELECT dst FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1) AS most_connected,
  (SELECT count(DISTINCT src) FROM edges WHERE src NOT IN (SELECT dst FROM edges)) AS orphan_count, (SELECT count(*) FROM ({_UNTESTED})) AS untested_count,
  round((count(DISTINCT src) - (SELECT count(*) FROM ({_UNTESTED}))) / count(DISTINCT src) * 100, 9) AS tested_pct FROM edges"""
)
def graph_stats(spark, d):
    return graph.stats(R.edges(spark, d))


@query(_W + "SELECT n AS path FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) WHERE starts_with(n, 'supplier/')")
def module_files(spark, d):
    return graph.module_files(R.edges(spark, d), "supplier")


@query(
    _W + """, f AS (SELECT count(*) AS file_count FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) WHERE starts_with(n, 'documents/')),
e AS (SELECT count(*) AS edge_count, count(DISTINCT CASE WHEN starts_with(dst, 'documents/') AND rel = 'tested_by' THEN dst END) AS tested_count FROM edges WHERE starts_with(src, 'documents/') OR starts_with(dst, 'documents/'))
SELECT file_count, edge_count, tested_count, round(tested_count / file_count * 1000) / 10 AS coverage FROM f, e"""
)
def module_stats(spark, d):
    return graph.module_stats(R.edges(spark, d), "documents")


# --- impact -----------------------------------------------------------------


def _impact_sql(start: str, depth: int) -> str:
    return (
        _WR + f"""r(path, depth) AS (SELECT '{start}', 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.path WHERE r.depth < {depth}),
m AS (SELECT path, min(depth) AS depth FROM r GROUP BY path),
l AS (SELECT m.path, m.depth, min({{'rel': e.rel, 'provenance': e.provenance, 'confidence': CAST(e.confidence AS DOUBLE)}}) AS x
  FROM m JOIN edges e ON e.src = m.path JOIN m p ON p.path = e.dst AND p.depth = m.depth - 1 WHERE m.depth > 0 GROUP BY m.path, m.depth)
SELECT path, x.rel AS relation, x.provenance AS provenance, x.confidence AS confidence, CAST(depth AS INTEGER) AS depth FROM l"""
    )


@query(_impact_sql("nation/3", 1))
def impact_d1(spark, d):
    return graph.impact(R.edges(spark, d), "nation/3", 1)


@query(_impact_sql("customer/7", 3))
def impact_d3(spark, d):
    return graph.impact(R.edges(spark, d), "customer/7", 3)


@query(_impact_sql("supplier/1", 5))
def impact_closure(spark, d):
    return graph.impact(R.edges(spark, d), "supplier/1", 5)


def _external_edges(spark, d):
    """Every second part is used under its external name."""
    edges = R.edges(spark, d, "orders_part", "part_supplier")
    out = F.when(F.col("dst").startswith("part/") & (F.substring("dst", 6, 20).cast("long") % 2 == 0), F.concat(F.lit("external:part:"), F.substring("dst", 6, 20)))
    return edges.withColumn("dst", F.coalesce(out, "dst"))


_EXTERNAL = """x AS (SELECT src, CASE WHEN dst LIKE 'part/%' AND CAST(substr(dst, 6) AS BIGINT) % 2 = 0 THEN concat('external:part:', substr(dst, 6)) ELSE dst END AS dst
  FROM edges WHERE src LIKE 'part/%' OR (src LIKE 'orders/%' AND dst LIKE 'part/%'))"""


@query(
    _WR + _EXTERNAL + """, r(path, depth) AS (SELECT 'supplier/2', 0 UNION SELECT x.src, r.depth + 1 FROM r JOIN x ON x.dst = r.path OR x.dst = concat('external:', regexp_replace(r.path, '/', ':')) WHERE r.depth < 4)
SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY path"""
)
def impact_external(spark, d):
    return graph.impact(_external_edges(spark, d), "supplier/2", 4, external=True).select("path", "depth")


# --- associations -----------------------------------------------------------

PATHS = [
    "src/main.go", "src/auth/login.go", "src/auth/login_test.go", "src/auth/session.go", "pkg/util/strings.go", "pkg/util/strings_test.go", "lib/parser.py", "lib/test_parser.py", "tests/json.rs", "src/lib.rs",
    "src/lib_test.rs", "web/app.ts", "web/app.test.ts", "web/app.spec.ts", "web/index.js", "web/domain.rs", "core/Foo.java", "core/FooTest.java", "core/Bar.kt", "core/BarTests.kt", "core/Baz.cs", "core/BazTest.cs",
    "x/foo_SUITE.erl", "x/foo.erl", "x/Mod.hs", "x/ModSpec.hs", "r/test-plot.r", "r/plot.r", "test_top.py", "src/test_x.py", "src/x.py", "spec/qux_spec.rb", "a/b/__tests__/c.js", "benches/graph_bench.rs", "crates/ignore/tests/x.rs",
    "examples/demo.py", "docs/example/x.md", "config/app.yaml", "Cargo.lock", ".github/workflows/ci.yaml", "tools/scripts/run.sh", "README.md", "api/v1/service.pb.go", "gen/types.generated.ts", "src/payments/internal/handler.go",
    "julia/runtests.jl", "elm/Main.elm", "lua/init.lua", "clj/core.clj", "clj/core_test.clj", "a.go", "a_test.go", "secrets/key.env", "vendor/x/y.go", "web/node_modules/z/i.js", "go.sum", "cmd/tool/main.go", "./src/rel.go",
]


def _paths(spark) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


_P = _values("p", "path", [(p,) for p in PATHS])
_NAME, _DIR = "regexp_extract(path, '([^/]*)$', 1)", "regexp_extract(path, '^(.*/)[^/]*$', 1)"


def _association_sql() -> str:
    back = [f"WHEN ends_with(n, '{t}') THEN concat(left(n, -{len(t)}), '{s}')" for t, s in associate.SUFFIXES]
    back += [f"WHEN starts_with(n, '{b}') THEN CASE WHEN {' OR '.join(f'ends_with(n, {e!r})' for e in ends)} THEN substr(n, {len(b) + 1}) END" for b, ends in associate.BEGINNINGS]
    back += [f"WHEN ends_with(n, '{t}') THEN concat(left(n, -{len(t)}), '{s}')" for t, s in associate.LATER_SUFFIXES]
    ahead = [f"WHEN ends_with(n, '{e}') THEN [{', '.join('concat({!r}, left(n, -{}), {!r})'.format(t.split('*')[0], len(e), t.split('*')[1]) for t in tests)}]" for e, tests in associate.TESTS_OF.items()]
    return f"""WITH {_P}, q AS (SELECT path, {_DIR} AS f, {_NAME} AS n FROM p),
b AS (SELECT path AS src, concat(f, CASE {' '.join(back)} END) AS dst, 'tested_by' AS rel, CASE {' '.join(back)} END AS s FROM q),
a AS (SELECT path AS src, concat(f, unnest(CASE {' '.join(ahead)} ELSE [] END)) AS dst, 'tests' AS rel FROM q)
SELECT src, dst, rel FROM (SELECT src, dst, rel FROM b WHERE s IS NOT NULL UNION ALL SELECT * FROM a) WHERE dst IN (SELECT path FROM p)"""


@query(_association_sql())
def test_association(spark, d):
    return associate.test_edges(_paths(spark)).select("src", "dst", "rel")


@query("WITH n AS (SELECT concat('nation/', n_nationkey) AS a FROM nation), r AS (SELECT concat('region/', r_regionkey) AS b FROM region) SELECT a AS src, b AS dst, 'documents' AS rel, 'heuristic' AS provenance, CAST(0.5 AS DOUBLE) AS confidence FROM n, r")
def cross_extension_edges(spark, d):
    files = graph.nodes(R.edges(spark, d, "nation_region")).withColumnRenamed("node", "path")
    return _double(associate.extension_edges(files, "nation/* → region/*", "documents"))


MOUNTS = [("part", "part-repo"), ("customer", "crm"), ("part/1", "never")]


@query(
    _W + ", " + _values("m", "prefix, repo", MOUNTS) + """, t AS (SELECT DISTINCT dst FROM edges), b AS (SELECT dst, max_by(repo, length(prefix)) AS repo, max(length(prefix)) AS k FROM t JOIN m ON starts_with(dst, concat(prefix, '/')) GROUP BY dst)
SELECT src, CASE WHEN b.dst IS NULL THEN e.dst ELSE concat('external:', b.repo, ':', substr(e.dst, k + 2)) END AS dst, rel, provenance, CAST(confidence AS DOUBLE) AS confidence FROM edges e LEFT JOIN b ON e.dst = b.dst"""
)
def external_marking(spark, d):
    return _double(associate.mark_external(R.edges(spark, d), spark.createDataFrame(MOUNTS, "prefix string, repo string")))


PACKAGES = [("", "root"), ("src", "app"), ("src/auth", "auth"), ("crates/ignore", "ignore"), ("web", "web")]


@query(
    f"WITH {_P}, " + _values("k", "dir, name", PACKAGES) + """ SELECT path AS node, concat('pkg:', max_by(name, length(dir))) AS package FROM p JOIN k ON dir = '' OR starts_with(path, concat(dir, '/')) GROUP BY path"""
)
def pkg_resolution(spark, d):
    return graph.packages_of(_paths(spark).withColumnRenamed("path", "node"), spark.createDataFrame(PACKAGES, "dir string, name string"))


@query("SELECT 'external:repo:a/b:c' AS node, 'repo' AS repo, 'a/b:c' AS path UNION ALL SELECT 'src/x', NULL, NULL")
def parse_external(spark, d):
    rows = spark.createDataFrame([("external:repo:a/b:c",), ("src/x",)], "node string")
    return rows.select("node", associate.parse_external(F.col("node")).alias("e")).select("node", "e.repo", "e.path")


# --- text and search --------------------------------------------------------


def _tokens_sql(x: str) -> str:
    words = f"regexp_replace(regexp_replace({x}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '([\\p{{L}}\\p{{N}}])(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    return f"list_distinct(list_filter(string_split_regex(lower({words}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 2))"


@query(f"SELECT 'part' AS kind, p_partkey AS id, list_sort({_tokens_sql('p_name')}) AS tokens FROM part UNION ALL SELECT 'page', page_id, list_sort({_tokens_sql('url')}) FROM pages")
def tokenize(spark, d):
    part = R.table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.sort_array(X.tokens(F.col("p_name"))).alias("tokens"))
    return part.union(R.table(spark, d, "pages").select(F.lit("page"), "page_id", F.sort_array(X.tokens(F.col("url")))))


def _index(spark, d) -> Index:
    """Documents as files whose symbols are the words of their texts."""
    docs = R.table(spark, d, "documents")
    return Index(docs.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.split(F.coalesce("text", F.lit("")), "[ \t\n\r]+").alias("symbols")))


_TERMS = f"""d AS (SELECT concat('documents/', doc_id) AS path, coalesce(text, '') AS text FROM documents),
w AS (SELECT path, path AS s FROM d UNION ALL SELECT path, unnest(string_split_regex(text, '[ \\t\\n\\r]+')) FROM d),
t AS (SELECT path, unnest({_tokens_sql('s')}) AS term FROM w),
post AS (SELECT path, term, count(*) AS tf FROM t GROUP BY path, term),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sizes AS (SELECT d.path, count(t.term) AS len FROM d LEFT JOIN t ON d.path = t.path GROUP BY d.path),
corp AS (SELECT count(*) AS n_docs, avg(len) AS avg_len FROM sizes)"""
SEARCH = "moron clown the documents/12"
_SCORES = _TERMS + f""", q AS (SELECT unnest({_tokens_sql(repr(SEARCH))}) AS term),
hit AS (SELECT p.path, p.tf, f.df, n_docs, avg_len, len FROM post p JOIN q ON p.term = q.term JOIN freq f ON f.term = p.term JOIN sizes z ON z.path = p.path, corp),
tfidf AS (SELECT path, sum(tf * ln(n_docs / df)) AS score FROM hit GROUP BY path HAVING sum(tf * ln(n_docs / df)) > 0),
bm25 AS (SELECT path, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / greatest(avg_len, 1)))) AS score FROM hit GROUP BY path),
a AS (SELECT path, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS r FROM tfidf), b AS (SELECT path, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS r FROM bm25),
rrf AS (SELECT coalesce(a.path, b.path) AS path, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score FROM a FULL JOIN b ON a.path = b.path)"""


@query(f"WITH {_TERMS} SELECT path, term, tf FROM post")
def postings(spark, d):
    return _index(spark, d).postings()


@query(f"WITH {_TERMS} SELECT term, df FROM freq")
def doc_freq(spark, d):
    return _index(spark, d).document_frequency()


@query(f"WITH {_TERMS} SELECT n_docs, round(avg_len, 9) AS avg_len FROM corp")
def corpus_stats(spark, d):
    return _index(spark, d).corpus().select("n_docs", F.round("avg_len", 9).alias("avg_len"))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("path", F.round("score", 9).alias("score"))


@query(f"WITH {_SCORES} SELECT path, round(score, 9) AS score FROM tfidf")
def tfidf(spark, d):
    return _rounded(_index(spark, d).tfidf(SEARCH))


@query(f"WITH {_SCORES} SELECT path, round(score, 9) AS score FROM bm25")
def bm25(spark, d):
    return _rounded(_index(spark, d).bm25(SEARCH))


@query(f"WITH {_SCORES} SELECT path, round(score, 9) AS score FROM rrf")
def rrf(spark, d):
    index = _index(spark, d)
    return _rounded(fuse(_rounded(index.tfidf(SEARCH)), _rounded(index.bm25(SEARCH))))


@query(f"WITH {_SCORES}, top AS (SELECT path, score FROM rrf ORDER BY round(score, 12) DESC, path LIMIT 20) SELECT path AS file_path, round(score, 9) AS score, 'lexical' AS provenance FROM top")
def search(spark, d):
    return _index(spark, d).search(SEARCH).select("file_path", F.round("score", 9).alias("score"), "provenance")


_MINIFY = r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r]')) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(list_transform(x, lambda s: regexp_replace(substr(s, coalesce(list_min(list_transform(x, lambda y: length(regexp_extract(y, '^[ \t]*')))), 0) + 1), '[ \t\r]+$', '')), chr(10))) AS digest FROM l"""


@query(_MINIFY)
def minify(spark, d):
    docs = R.table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(X.minified(F.col("text"))).alias("digest"))


# --- context ----------------------------------------------------------------

TASK = "Which suppliers of nation and supplier data?"
_MATCH = "CAST(contains(lower(n), 'which') AS INT) + CAST(contains(lower(n), 'suppliers') AS INT) + CAST(contains(lower(n), 'nation') AS INT) + CAST(contains(lower(n), 'and') AS INT) + CAST(contains(lower(n), 'supplier') AS INT) + CAST(contains(lower(n), 'data') AS INT)"
_ANCHORS = f"anchors AS (SELECT n AS path, {_MATCH} AS matches FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) WHERE {_MATCH} > 0 ORDER BY matches DESC, n LIMIT 8)"
@query(_W + ", " + _ANCHORS + " SELECT path, matches FROM anchors")
def anchors(spark, d):
    return context.anchors(R.edges(spark, d), TASK)


_WALK = f"""{_W}, {_ANCHORS}, wt(provenance, w) AS (VALUES ('ast_exact', 1.0::DOUBLE), ('ast_inferred', 0.8), ('heuristic', 0.5), ('lexical', 0.3), ('latent', 0.3), ('unresolved', 0.0)),
both_ AS (SELECT src, dst, provenance FROM edges UNION SELECT dst, src, provenance FROM edges),
d0 AS (SELECT path AS anchor, path AS node FROM anchors),
d1 AS (SELECT d0.anchor, b.dst AS node, max(w) * 0.8::DOUBLE AS score, min(provenance) AS provenance FROM d0 JOIN both_ b ON b.src = d0.node JOIN wt USING (provenance) WHERE b.dst <> d0.anchor GROUP BY ALL),
d2 AS (SELECT d1.anchor, b.dst AS node, max(w) * 0.5::DOUBLE AS score, min(b.provenance) AS provenance FROM d1 JOIN both_ b ON b.src = d1.node JOIN wt ON wt.provenance = b.provenance
  WHERE b.dst <> d1.anchor AND NOT EXISTS (SELECT 1 FROM d1 o WHERE o.anchor = d1.anchor AND o.node = b.dst) GROUP BY ALL),
every AS (SELECT anchor, node, 1.0::DOUBLE AS score, 'ast_exact' AS provenance FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2),
walked AS (SELECT node AS path, max(score) AS score FROM every GROUP BY node ORDER BY score DESC, path LIMIT 60)"""


def _walked(spark, d):
    edges = once(R.edges(spark, d), "edges")
    return context.walk(edges, context.anchors(edges, TASK))


@query(_WALK + " SELECT path, round(score, 9) AS score FROM walked")
def traverse_score(spark, d):
    return _walked(spark, d).select("path", F.round("score", 9).alias("score"))


@query(_WALK + ", k AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) - 1 AS position FROM walked) SELECT path, CAST(position AS INTEGER) AS position, CASE WHEN position < 8 THEN 'detail' WHEN position < 16 THEN 'signature' ELSE 'map' END AS tier FROM k")
def tiers(spark, d):
    return context.tiers(_walked(spark, d)).select("path", "position", "tier")


@query("SELECT n, i, CAST(CASE WHEN n <= 2 THEN i WHEN i < ceil(n / 2) THEN 2 * i ELSE 2 * (n - 1 - i) + 1 END AS INTEGER) AS place FROM (SELECT unnest(range(1, 12)) AS n), LATERAL (SELECT unnest(range(0, n)) AS i)")
def position_order(spark, d):
    n = spark.range(1, 12).withColumnRenamed("id", "n")
    return n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("n", "i", context.interleaved(F.col("i"), F.col("n")).alias("place"))


@query("SELECT place, size, used FROM (SELECT doc_id AS place, length(text) AS size, CAST(sum(length(text)) OVER (ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE used <= 100000")
def budget_prefix(spark, d):
    blocks = R.table(spark, d, "documents").select(F.col("doc_id").alias("place"), F.char_length("text").cast("long").alias("size"))
    return context.within_budget(blocks, 100_000)


ABOUT = "documents and their labels"
_ABOUT = "CAST(contains(lower(n), 'documents') AS INT) + CAST(contains(lower(n), 'and') AS INT) + CAST(contains(lower(n), 'their') AS INT) + CAST(contains(lower(n), 'labels') AS INT)"
_ABOUT_ANCHORS = f"anchors AS (SELECT n AS path, {_ABOUT} AS matches FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) WHERE {_ABOUT} > 0 ORDER BY matches DESC, n LIMIT 8)"


def _sources(spark, d):
    return R.table(spark, d, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), "text")


def _symbols(spark, d):
    """Words of ten letters or more as symbols of a document, at their place."""
    words = F.posexplode(F.split("text", " ")).alias("line", "name")
    return _sources(spark, d).select("path", words).where("name rlike '^[a-z]{10,}$'").withColumn("signature", F.concat(F.lit("word "), F.col("name")))


@query(
    _WALK.replace(_ANCHORS, _ABOUT_ANCHORS) + """, k AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) - 1 AS position FROM walked),
m AS (""" + _MINIFY.removeprefix("WITH ").replace("l AS (", "SELECT concat('documents/', doc_id) AS path, digest FROM (WITH l AS (", 1) + """)),
w AS (SELECT concat('documents/', doc_id) AS path, unnest(string_split(text, ' ')) AS name, generate_subscripts(string_split(text, ' '), 1) - 1 AS line FROM documents),
y AS (SELECT path, string_agg(name, ' ' ORDER BY line) AS symbols FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM w WHERE regexp_full_match(name, '[a-z]{10,}')) WHERE r <= 8 GROUP BY path)
SELECT k.path, CAST(position AS INTEGER) AS position, CASE WHEN position < 8 THEN 'detail' WHEN position < 16 THEN 'signature' ELSE 'map' END AS tier, round(score, 9) AS score, m.digest AS detail, coalesce(y.symbols, '') AS symbols
FROM k LEFT JOIN m ON m.path = k.path LEFT JOIN y ON y.path = k.path"""
)
def understand(spark, d):
    edges = once(R.edges(spark, d), "edges")
    seeds = stage(context.anchors(edges, ABOUT), "seeds")
    files = context.chosen_files(edges, seeds, _sources(spark, d), _symbols(spark, d))
    names = F.coalesce(F.array_join(F.transform("found", lambda s: s["name"]), " "), F.lit(""))
    return files.select("path", "position", "tier", F.round("score", 9).alias("score"), F.md5("detail").alias("detail"), names.alias("symbols"))


# --- classification and permissions ----------------------------------------

TEXTS = {
    "src/auth/session.go": "package auth\nfunc Login() {}\n",
    "lib/parser.py": "def parse(x):\n    return x\n",
    "src/lib.rs": "pub fn a() {}\npub fn b() {}\npub async fn c() {}\n",
    "web/app.ts": "export const x = 1\n",
    "core/Foo.java": "public class Foo { public static void main(String[] a) {} }\n",
    "core/Bar.kt": "class Bar\n",
    "x/foo.erl": "-module(foo).\n-export([f/0]).\n",
    "pkg/util/strings.go": "// Code generated by tool. DO NOT EDIT.\npackage util\n",
}


@query(
    f"""WITH {_P}, q AS (SELECT path, lower(path) AS p FROM p) SELECT path,
  CASE WHEN contains(path, '.pb.go') OR contains(path, '.gen.go') OR contains(path, '.generated.') THEN 'generated' WHEN {_is_test('p')} THEN 'test' WHEN {_is_entry('p')} THEN 'entrypoint'
  WHEN contains(p, '/example') OR regexp_matches(p, '^examples?/') THEN 'example' WHEN regexp_matches(p, '\\.(toml|yaml|yml|json|lock|cfg|ini|env)$') THEN 'config' WHEN contains(p, '/scripts/') THEN 'script' ELSE 'unknown' END AS role FROM q"""
)
def classify_paths(spark, d):
    return classify.classified(_paths(spark).withColumn("text", F.lit(""))).select("path", "role")


@query(
    "SELECT * FROM (VALUES ('src/auth/session.go', 'library', 'beta'), ('lib/parser.py', 'library', 'beta'), ('src/lib.rs', 'library', 'beta'), ('web/app.ts', 'library', 'beta'), ('core/Foo.java', 'entrypoint', 'stable'), ('core/Bar.kt', 'library', 'beta'), ('x/foo.erl', 'library', 'beta'), ('pkg/util/strings.go', 'generated', 'generated')) t(path, role, status)"
)
def classify_contents(spark, d):
    return classify.classified(spark.createDataFrame(list(TEXTS.items()), "path string, text string")).select("path", "role", "status")


@query(f"SELECT page_id, url, {_is_test('lower(url)')} AS is_test, {_is_entry('lower(url)')} AS is_entry FROM pages")
def classify_urls(spark, d):
    return R.table(spark, d, "pages").select("page_id", "url", classify.is_test_path(F.col("url")).alias("is_test"), classify.is_entry_path(F.col("url")).alias("is_entry"))


@query("SELECT doc_id, contains(text, 'DO NOT EDIT') OR contains(text, 'auto-generated') OR contains(text, 'Code generated by') AS generated FROM documents")
def generated_detection(spark, d):
    return R.table(spark, d, "documents").select("doc_id", classify.is_generated(F.lit("x.go"), F.col("text")).alias("generated"))


@query(
    f"""WITH {_P}, q AS (SELECT path, list_filter(string_split(path, '/'), lambda c: c <> '') AS c FROM p) SELECT path, CASE WHEN path = 'README.md' THEN 'docs' WHEN starts_with(path, 'vendor/') THEN NULL
  WHEN regexp_matches(path, '(^|/)src/[^/]') THEN concat(regexp_extract(path, '(?:^|/)src/([^/]+)', 1), '-module') WHEN len(c) < 2 OR starts_with(c[1], '.') OR c[1] = 'src' THEN NULL ELSE concat(c[1], '-module') END AS feature FROM q"""
)
def features(spark, d):
    return _paths(spark).select("path", classify.feature(F.col("path"), {"README.md": "docs", "vendor/": ""}).alias("feature"))


#: The default protections, as SQL conditions on a path ``q`` and modes.
_DEFAULT_MODES = " ".join(
    f"WHEN {condition} THEN {mode}"
    for condition, mode in [
        ("starts_with(q, '.vfs/') OR starts_with(q, '.git/') OR q = '.gitignore'", 0o444),
        ("ends_with(q, '.sum') OR ends_with(q, '.lock') OR ends_with(q, '.pb.go') OR ends_with(q, '.gen.go')", 0o444),
        ("contains(concat('/', q), '/vendor/') OR contains(concat('/', q), '/node_modules/')", 0o444),
        ("starts_with(q, '.github/workflows/')", 0o444),
        ("starts_with(q, 'src/') OR starts_with(q, 'lib/') OR starts_with(q, 'cmd/')", 0o644),
    ]
)


@query(
    f"""WITH {_P}, z AS (SELECT path, regexp_replace(path, '^(\\./)+', '') AS q FROM p), m AS (SELECT path, CASE WHEN starts_with(q, 'web/') THEN 292 {_DEFAULT_MODES} ELSE 420 END AS mode FROM z)
SELECT path, CAST(mode AS INTEGER) AS mode, mode & 292 <> 0 AS readable, mode & 128 <> 0 AS writable, mode & 73 <> 0 AS executable FROM m"""
)
def permissions_check(spark, d):
    return permissions.Permissions(backends={"web": 0o444}).check(_paths(spark))


# --- metadata, rules --------------------------------------------------------


@query(
    """SELECT concat('users/', user_id) AS path, count(*) AS size, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS modified, 'local' AS backend,
  arg_max(json_extract_string(props, '$.k'), event_id) AS k, arg_max(CASE WHEN event_type = 'error' THEN 'stale' ELSE 'ok' END, event_id) AS status FROM events GROUP BY user_id"""
)
def metadata_kv(spark, d):
    e = _user_events(spark, d)
    files = e.groupBy("path").agg(F.count("*").alias("size"), F.max("ts").cast("timestamp").alias("modified"))
    updates = e.select("path", F.lit("user.vfs.k").alias("key"), F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("seq"))
    found = S.metadata(files, S.set_attributes(_attributes(spark, d), updates))
    return found.select("path", "size", "modified", "backend", F.col("attributes")["k"].alias("k"), F.col("attributes")["status"].alias("status"))


def _user_events(spark, d):
    return R.table(spark, d, "events").withColumn("path", F.concat(F.lit("users/"), F.col("user_id").cast("string")))


def _attributes(spark, d):
    e = R.table(spark, d, "events")
    path = F.concat(F.lit("users/"), F.col("user_id").cast("string"))
    status = F.when(F.col("event_type") == "error", "stale").otherwise("ok")
    updates = e.select(path.alias("path"), F.lit("status").alias("key"), status.alias("value"), F.col("event_id").alias("seq"))
    return S.set_attributes(updates.limit(0).select("path", "key", "value"), updates)


_STATUS = "SELECT concat('users/', user_id) AS path, arg_max(CASE WHEN event_type = 'error' THEN 'stale' ELSE 'ok' END, event_id) AS status FROM events GROUP BY user_id"


@query(f"SELECT path, 'user.vfs.status' AS key, status AS value FROM ({_STATUS})")
def attributes_latest(spark, d):
    return _attributes(spark, d)


@query(f"SELECT path, status FROM ({_STATUS}) WHERE status = 'stale'")
def rule_stale_files(spark, d):
    rules.register(spark, R.edges(spark, d), metadata=_attributes(spark, d))
    return rules.rows(spark, rules.STALE_FILES)


@query(_W + "SELECT dst AS path, count(*) AS dependents FROM edges e WHERE rel = 'imports' AND dst NOT IN (SELECT dst FROM edges WHERE rel = 'tested_by') GROUP BY dst HAVING count(*) > 5")
def rule_untested_critical(spark, d):
    rules.register(spark, R.edges(spark, d))
    return rules.rows(spark, rules.UNTESTED_CRITICAL)


@query(_WR + "r(path, depth) AS (SELECT 'customer/11', 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.path WHERE r.depth < 2) SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE depth > 0 GROUP BY path")
def rule_transitive(spark, d):
    rules.register(spark, R.edges(spark, d))
    return rules.rows(spark, rules.Rule("t", rules.TRANSITIVE_IMPACT.query, args={"path": "customer/11", "depth": 2}))


@query(_W + "SELECT [rel, cnt::VARCHAR] AS cells FROM (SELECT rel, count(*) AS cnt FROM edges GROUP BY rel)")
def rule_compatible_rows(spark, d):
    rules.register(spark, R.edges(spark, d))
    return rules.compatible(rules.rows(spark, rules.Rule("by-rel", "SELECT rel, count(*) AS cnt FROM edges GROUP BY rel")))


@query(_W + "SELECT e.src AS path, 's3' AS backend, concat('sha256:', sha256(e.dst)) AS hash FROM edges e WHERE e.dst LIKE 'region/%'")
def rule_blob_targets(spark, d):
    edges = R.edges(spark, d)
    region = R.table(spark, d, "region").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("path"))
    rules.register(spark, edges, blobs=S.blob_rows(region.withColumn("content", F.col("path").cast("binary")), "s3", F.lit(0)))
    return rules.rows(spark, rules.BLOB_TARGETS)


# --- events -----------------------------------------------------------------


def _debounce_sql(keys: str) -> str:
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    step = " AND ".join(f"f.{k} = n.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE u AS (SELECT DISTINCT {keys}, ts FROM events),
n AS (SELECT {own}, a.ts, min(b.ts) AS nxt FROM u a JOIN u b ON {same} AND b.ts >= a.ts + INTERVAL 6 HOUR GROUP BY {own}, a.ts),
f AS (SELECT {keys}, min(ts) AS ts FROM u GROUP BY {keys} UNION ALL SELECT {', '.join('n.' + k for k in keys.split(', '))}, n.nxt FROM f JOIN n ON {step} AND f.ts = n.ts)
SELECT {keys}, ts FROM f"""


SIX_HOURS = 6 * 3600 * 1_000_000


@query(_debounce_sql("user_id"))
def debounce(spark, d):
    return V.debounced(R.table(spark, d, "events"), ["user_id"], SIX_HOURS)


@query(_debounce_sql("user_id, event_type"))
def debounce_by_type(spark, d):
    return V.debounced(R.table(spark, d, "events"), ["user_id", "event_type"], SIX_HOURS)


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
h AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, max(ts) AS ts FROM h GROUP BY user_id, k"""
)
def debounce_trailing(spark, d):
    return V.trailing_debounced(R.table(spark, d, "events"), ["user_id"], "6 hours")


@query(
    """WITH RECURSIVE e AS (SELECT event_type, make_timestamp(epoch_us(ts) // 1500) AS ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM events),
g AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY k))) / 1e6::DOUBLE * 1.5::DOUBLE, 0) AS gain FROM e),
r AS (SELECT event_type, ts, k, true AS allowed, 0.5::DOUBLE AS tokens FROM g WHERE k = 1
  UNION ALL SELECT g.event_type, g.ts, g.k, least(1.5::DOUBLE, r.tokens + g.gain) >= 1, CASE WHEN least(1.5::DOUBLE, r.tokens + g.gain) >= 1 THEN least(1.5::DOUBLE, r.tokens + g.gain) - 1 ELSE least(1.5::DOUBLE, r.tokens + g.gain) END
  FROM r JOIN g ON g.event_type = r.event_type AND g.k = r.k + 1) SELECT event_type, ts, allowed FROM r"""
)
def rate_limit(spark, d):
    calls = R.table(spark, d, "events").select("event_type", F.timestamp_micros(F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1500")).cast("timestamp_ntz").alias("ts"))
    return V.rate_limited(calls, ["event_type"], 1.5)


TRIGGERS = [V.Trigger("all-writes", "*", ("click", "view")), V.Trigger("txt", "*7", ("click", "purchase")), V.Trigger("exact", "42", ("signup", "click"))]


@query(
    """WITH e AS (SELECT event_id, user_id, event_type FROM events), x AS (SELECT event_id, 0 AS ord, 'all-writes' AS "trigger" FROM e WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_id, 1, 'txt' FROM e WHERE user_id::VARCHAR LIKE '%7' AND event_type IN ('click', 'purchase') UNION ALL SELECT event_id, 2, 'exact' FROM e WHERE user_id = 42 AND event_type IN ('signup', 'click'))
SELECT event_id, CAST(ord AS INTEGER) AS ord, "trigger" FROM x"""
)
def events_by_rule(spark, d):
    e = R.table(spark, d, "events").select("event_id", F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), "event_type")
    return V.triggered(e, TRIGGERS).select("event_id", "ord", "trigger")


# --- stores, files, mounts ---------------------------------------------------

_FAMILY = lambda n: f"SELECT src, dst, rel, provenance, CAST(confidence AS DOUBLE) AS confidence FROM edges WHERE {n}"


def _store(spark, d) -> E.EdgeStore:
    """A new store to which three batches were appended, the last with known edges."""
    import uuid

    made = E.EdgeStore(spark, f"{shared_dir(spark)}/tessella/store-{uuid.uuid4().hex}").init()
    made.append(R.edges(spark, d, "customer_nation"))
    made.append(R.edges(spark, d, "nation_region"))
    made.append_new(R.edges(spark, d, "customer_nation", "supplier_nation"))
    made.append(R.edges(spark, d, "nation_region"))
    return made


@query(_W + _FAMILY("src LIKE 'customer/%' OR src LIKE 'supplier/%' AND dst LIKE 'nation/%' OR src LIKE 'nation/%'"))
def store_load(spark, d):
    return _double(_store(spark, d).load())


@query(_W + _FAMILY("src LIKE 'customer/%' OR src LIKE 'supplier/%' AND dst LIKE 'nation/%' OR src LIKE 'nation/%'"))
def store_rebuild(spark, d):
    return _double(_store(spark, d).rebuild())


@query("SELECT count(*) + (SELECT count(*) FROM supplier) + 2 * (SELECT count(*) FROM nation) AS raw_edges, count(*) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS distinct_edges FROM customer")
def store_counts(spark, d):
    return spark.createDataFrame([_store(spark, d).counts()], "raw_edges long, distinct_edges long")


@query(_W + "SELECT src, dst, rel, provenance, CAST(confidence AS DOUBLE) AS confidence FROM edges WHERE src LIKE 'nation/%' ORDER BY src, dst, rel, provenance")
def edge_dump(spark, d):
    return _double(E.dumped(R.edges(spark, d).where("src like 'nation/%'")))


@query(_W + "SELECT DISTINCT dst FROM edges")
def local_targets(spark, d):
    return graph.targets(R.edges(spark, d))


@query("SELECT concat('users/', user_id) AS path, event_id, CAST(ts AS TIMESTAMP) AS modified FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'")
def files_changed(spark, d):
    files = _user_events(spark, d).select("path", "event_id", F.col("ts").cast("timestamp_ntz").alias("modified"))
    return S.changed(files, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


def _tree(spark, d):
    """Orders as files with one of six extensions."""
    ends = F.element_at(F.array(*[F.lit(e) for e in ("go", "py", "ts", "tsx", "h", "md")]), (F.col("o_orderkey") % 6).cast("int") + 1)
    path = F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit("."), ends)
    files = R.table(spark, d, "orders").select(path.alias("path")).withColumn("extension", X.extension(F.col("path")))
    return files.withColumn("language", language(F.col("extension")))


_TREE = "tree AS (SELECT concat('src/o', o_orderkey, '.', ['go', 'py', 'ts', 'tsx', 'h', 'md'][o_orderkey % 6 + 1]) AS path, o_orderkey % 6 AS k FROM orders)"


@query(f"WITH {_TREE} SELECT language, count(*) AS cnt FROM (SELECT CASE k WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'typescript' END AS language FROM tree) WHERE language IS NOT NULL GROUP BY language")
def languages_seen(spark, d):
    return S.languages_seen(_tree(spark, d))


@query(f"WITH {_TREE} SELECT path FROM tree WHERE k = 2")
def files_of_language(spark, d):
    return S.of_language(_tree(spark, d), "typescript").select("path")


@query(f"WITH {_TREE} SELECT DISTINCT path, CASE k WHEN 0 THEN 'update-graph-go' WHEN 1 THEN 'update-graph-py' ELSE 'update-graph-ts' END AS \"trigger\" FROM tree WHERE k < 3")
def default_triggers(spark, d):
    return V.triggered(_tree(spark, d).select("path", F.lit("write").alias("event_type")), V.DEFAULT_TRIGGERS).select("path", "trigger")


@query(
    f"WITH {_TREE}, t(source, test) AS (SELECT path, concat(left(path, -3), '_test.go') FROM tree WHERE k = 0) SELECT test AS src, source AS dst, 'tested_by' AS rel FROM t UNION ALL SELECT source, test, 'tests' FROM t"
)
def go_tests(spark, d):
    go = _tree(spark, d).where("extension = 'go'").select("path")
    both = go.union(go.select(F.regexp_replace("path", r"\.go$", "_test.go")))
    return associate.test_edges(both).select("src", "dst", "rel")


BACKENDS = [{"name": "nations", "backend_type": "local", "at": "nation", "path": "/data/n"}, {"name": "bucket", "backend_type": "s3", "at": "nation/1", "path": "s3://b/"}, {"name": "repo", "backend_type": "git", "at": "customer/", "path": "/repo/"}]


@query(
    _W + """, n AS (SELECT src AS path FROM edges UNION SELECT dst FROM edges) SELECT path, CASE WHEN starts_with(path, 'nation/1') THEN 'bucket' WHEN starts_with(path, 'customer/') THEN 'repo' WHEN starts_with(path, 'nation') THEN 'nations' ELSE 'cwd' END AS backend,
  CASE WHEN starts_with(path, 'nation/1') THEN concat('s3://b', substr(path, 9)) WHEN starts_with(path, 'customer/') THEN concat('/repo', substr(path, 10)) WHEN starts_with(path, 'nation') THEN concat('/data/n', substr(path, 7)) ELSE path END AS backing FROM n"""
)
def mount_resolution(spark, d):
    return S.resolve(graph.nodes(R.edges(spark, d)).withColumnRenamed("node", "path"), BACKENDS)


@query(_W + """, n AS (SELECT src AS path FROM edges UNION SELECT dst FROM edges) SELECT name, bool_or(folder) AS is_folder FROM (SELECT split_part(path, '/', 1) AS name, contains(path, '/') AS folder FROM n) GROUP BY name""")
def folder_listing(spark, d):
    return S.names_under(graph.nodes(R.edges(spark, d)).withColumnRenamed("node", "path"), "/")


@query("SELECT path, key, value, seq, lag(value) OVER (PARTITION BY path ORDER BY seq) AS previous FROM (SELECT concat('users/', user_id) AS path, 'type' AS key, event_type AS value, event_id AS seq FROM events)")
def previous_values(spark, d):
    return S.previous_values(_user_events(spark, d).select("path", F.lit("type").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq")))


@query("SELECT o_orderpriority, count(*) AS cnt FROM orders GROUP BY o_orderpriority")
def role_histogram(spark, d):
    return classify.histogram(R.table(spark, d, "orders"), "o_orderpriority")


@query(_impact_sql("region/1", 2))
def impact_guarded(spark, d):
    return graph.impact_or_fail(R.edges(spark, d), "region/1", 2)


@query("WITH i AS (" + _impact_sql("customer/7", 3).replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + ") SELECT path, 'user.vfs.impact' AS key, concat(relation, ' (depth ', depth, ')') AS value FROM i")
def impact_attributes(spark, d):
    return graph.impact_attributes(R.edges(spark, d), "customer/7")


@query("SELECT * FROM (VALUES ('src/new.go', 'std:fmt', 'imports')) t(src, dst, rel)")
def parsed_on_miss(spark, d):
    sources = spark.createDataFrame([("src/new.go", 'package a\nimport "fmt"\n'), ("src/other.go", 'import "os"')], "path string, text string")
    return graph.related_or_parse(R.edges(spark, d), sources, "src/new.go").select("src", "dst", "rel")


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS name FROM pages) SELECT page_id, name, CASE WHEN contains(url, '/') THEN left(url, length(url) - length(name) - 1) ELSE '' END AS parent,
  CASE WHEN regexp_matches(name, '^.+\.') THEN regexp_extract(name, '[^.]*$') ELSE '' END AS extension, CASE WHEN regexp_matches(name, '^.+\.') THEN regexp_extract(name, '^(.*)\.[^.]*$', 1) ELSE name END AS stem FROM p"""
)
def path_parts(spark, d):
    u = F.col("url")
    return R.table(spark, d, "pages").select("page_id", X.file_name(u).alias("name"), X.parent(u).alias("parent"), X.extension(u).alias("extension"), X.stem(u).alias("stem"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_times(spark, d):
    return R.table(spark, d, "events").select("event_id", X.iso_time(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("at"))


@query(
    """WITH k AS (SELECT s_suppkey AS k FROM supplier), t AS (SELECT k, concat(k, 'ms') AS t, k AS a, greatest(k, 1) AS b, greatest(k // 1000, 1) AS c FROM k UNION ALL SELECT k, concat(k, 's'), k * 1000, greatest(k * 1000, 1), greatest(k, 1) FROM k
UNION ALL SELECT k, concat(k, 'm'), 0, 500, greatest(k * 60, 1) FROM k UNION ALL SELECT k, concat(k, ''), k, greatest(k, 1), greatest(k, 1) FROM k UNION ALL SELECT k, concat('x', k), 0, 500, 30 FROM k UNION ALL SELECT k, concat('x', k, 's'), 0, 1000, 30 FROM k)
SELECT t AS text, a AS duration_ms, b AS debounce_ms, c AS timeout_s FROM t"""
)
def durations(spark, d):
    k = F.col("s_suppkey").cast("string")
    texts = F.array(*[F.concat(*parts) for parts in ((k, F.lit("ms")), (k, F.lit("s")), (k, F.lit("m")), (k, F.lit("")), (F.lit("x"), k), (F.lit("x"), k, F.lit("s")))])
    t = R.table(spark, d, "supplier").select(F.explode(texts).alias("text"))
    return t.select("text", X.duration_ms(F.col("text")).alias("duration_ms"), X.debounce_ms(F.col("text")).alias("debounce_ms"), X.timeout_seconds(F.col("text")).alias("timeout_s"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS folder FROM pages")
def repository_names(spark, d):
    return R.table(spark, d, "pages").select("page_id", X.repository_name(F.col("url")).alias("folder"))


def _fired(spark, d):
    return _user_events(spark, d).select("event_id", "path", F.lit("t").alias("trigger"), "ts")


@query("SELECT 't' AS \"trigger\", concat('users/', user_id) AS path, concat('run users/', user_id, ' in users at ', strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS command FROM events")
def trigger_commands(spark, d):
    return V.commands(_fired(spark, d), [V.Trigger("t", "*", command="run {{ .FilePath }} in {{ .ModulePath }} at {{ .Timestamp }}")])


@query("SELECT concat('users/', user_id) AS path, 'user.vfs.checked' AS key, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS value FROM events")
def trigger_attributes(spark, d):
    return V.after_action(_fired(spark, d), "checked={{ .Timestamp }}")


@query(
    """WITH r AS (SELECT concat('region/', r_regionkey) AS path, r_name FROM region) SELECT path, 'user.vfs.backend' AS key, 's3' AS value FROM r UNION ALL SELECT path, 'user.vfs.hash', concat('sha256:', sha256(r_name)) FROM r
UNION ALL SELECT path, 'user.vfs.uploaded_at', '2024-01-01T00:00:00Z' FROM r"""
)
def upload_rows(spark, d):
    path = F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("path")
    return V.uploads(R.table(spark, d, "region").select(path, F.col("r_name").cast("binary").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("ts")), "s3")


@query(
    """WITH RECURSIVE e AS (SELECT event_type, make_timestamp(epoch_us(ts)) AS ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM events),
r AS (SELECT event_type, ts, k, true AS admitted, [ts + INTERVAL 3 HOUR] AS busy FROM e WHERE k = 1
  UNION ALL SELECT e.event_type, e.ts, e.k, len(list_filter(r.busy, lambda b: b > e.ts)) < 2, CASE WHEN len(list_filter(r.busy, lambda b: b > e.ts)) < 2 THEN list_append(list_filter(r.busy, lambda b: b > e.ts), e.ts + INTERVAL 3 HOUR) ELSE list_filter(r.busy, lambda b: b > e.ts) END
  FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1) SELECT event_type, ts, admitted FROM r"""
)
def concurrency_limit(spark, d):
    events = R.table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return V.admitted(events, 3 * 3600 * 1_000_000, 2, ["event_type"])


@query(_WALK + " SELECT path, printf('%.2f', score) AS shown FROM walked")
def score_format(spark, d):
    return _walked(spark, d).select("path", F.format_string("%.2f", "score").alias("shown"))


@query(_W + "SELECT rel AS path, CAST(count(*) AS VARCHAR) AS severity, '' AS detail FROM edges GROUP BY rel")
def rule_findings(spark, d):
    rules.register(spark, R.edges(spark, d))
    done = rules.check_all(spark, [rules.Rule("by-rel", "SELECT rel, count(*) AS cnt FROM edges GROUP BY rel"), rules.Rule("broken", "SELECT FROM nowhere at all")])
    return rules.findings(done["by-rel"], spark).union(rules.findings(done["broken"], spark))


# --- parsers ----------------------------------------------------------------

SOURCES: dict[str, tuple[str, str, list[str]]] = {
    "go": ("a/main.go", 'package main\n// import "no"\nimport (\n\t"fmt"\n\tx "example.com/internal/handler"\n)\nimport "os"\nvar s = "import \\"z\\""\n', ["std:fmt", "pkg:example.com/internal/handler", "std:os"]),
    "python": ("a/u.py", "import os\nfrom sys import argv\n# import no\nimport a, b\n  from collections import x\n", ["pkg:os", "pkg:sys", "pkg:a,", "pkg:collections"]),
    "typescript": ("a/app.ts", "import { h } from './handler';\nimport express from \"express\";\nconst fs = require('fs');\n// import x from 'no'\n", ["local:./handler", "pkg:express", "pkg:fs"]),
    "javascript": ("a/app.js", "import 'side-effect';\nconst q = require(\"/abs/q\");\n", ["pkg:side-effect", "local:/abs/q"]),
    "rust": ("a/l.rs", "use serde::Serialize;\nuse std::{collections::HashMap, io::{Read, Write}};\nuse foo::{self, Bar as B};\nuse self::x;\nextern crate libc;\n", ["pkg:libc", "pkg:serde", "pkg:std::collections::HashMap", "pkg:std::io::Read", "pkg:std::io::Write", "pkg:foo", "pkg:foo::Bar"]),
    "java": ("a/A.java", "package a;\nimport java.util.List;\nimport static org.x.Y.*;\n/* import no; */\n", ["pkg:java.util.List", "pkg:static org.x.Y.*"]),
    "c": ("a/a.c", '#include <stdio.h>\n#include "my.h"\n// #include "no.h"\n', ["sys:stdio.h", "local:my.h"]),
    "cpp": ("a/a.cpp", "#include <vector>\n  #  include \"x/y.hpp\"\n", ["sys:vector", "local:x/y.hpp"]),
    "ruby": ("a/a.rb", "require 'json'\nrequire_relative 'x'\n# require 'no'\n", ["pkg:json"]),
    "csharp": ("a/A.cs", "using System.Text;\nusing static System.Math;\n", ["pkg:System.Text", "pkg:System.Math"]),
    "kotlin": ("a/a.kt", "import a.b.C\nimport d.e as f\n", ["pkg:a.b.C", "pkg:d.e"]),
    "php": ("a/a.php", "<?php\nuse App\\Models\\User;\nuse function App\\f;\nuse App\\{A, B};\n", ["pkg:App\\Models\\User", "pkg:App\\f", "pkg:App"]),
    "swift": ("a/a.swift", "import Foundation\n@testable import My.Sub\n", ["pkg:Foundation", "pkg:My"]),
    "elixir": ("a/a.ex", "defmodule A do\n  alias A.B\n  use GenServer, x: 1\nend\n", ["pkg:A.B", "pkg:GenServer"]),
    "haskell": ("a/A.hs", "import qualified Data.Map as M\nimport Data.List (sort)\n-- import No\n", ["pkg:Data.Map", "pkg:Data.List"]),
    "erlang": ("a/a.erl", '-include("a.hrl").\n-include_lib("k/b.hrl").\n% -include("no.hrl").\n', ["local:a.hrl", "local:k/b.hrl"]),
    "scala": ("a/a.scala", "import a.b.{C, D}\nimport x.y.Z\n", ["pkg:a.b", "pkg:x.y.Z"]),
    "zig": ("a/a.zig", 'const std = @import("std");\n', ["local:std"]),
    "lua": ("a/a.lua", "local a = require('a.b')\nlocal c = require \"d\"\n-- require('no')\n", ["pkg:a.b", "pkg:d"]),
    "dart": ("a/a.dart", "import 'package:x/y.dart';\nimport 'dart:io';\nexport 'z.dart';\n", ["pkg:x/y.dart", "std:io", "local:z.dart"]),
    "clojure": ("a/a.clj", "(ns a.core\n  (:require [clojure.string :as s] [x.y])\n  (:import [java.util Date]))\n; (require 'no.no)\n", ["pkg:clojure.string", "pkg:x.y", "pkg:java.util"]),
    "ocaml": ("a/a.ml", 'open Core\ninclude Foo.Bar\n#use "top.ml"\n(* open No *)\n', ["pkg:Core", "pkg:Foo.Bar", "local:top.ml"]),
    "r": ("a/a.r", 'library(dplyr)\nrequire("ggplot2")\nsource("u.r")\n# library(no)\n', ["pkg:dplyr", "pkg:ggplot2", "local:u.r"]),
    "julia": ("a/a.jl", 'using Plots: plot\nimport Base\ninclude("b.jl")\n', ["pkg:Plots", "pkg:Base", "local:b.jl"]),
    "elm": ("a/A.elm", "import Html exposing (..)\nimport Json.Decode as D\n", ["pkg:Html", "pkg:Json.Decode"]),
    "nim": ("a/a.nim", "import std/os, strutils\nfrom tables import x\n", ["std:os", "pkg:strutils", "pkg:tables"]),
}


def _imports(lang: str) -> None:
    path, text, expected = SOURCES[lang]

    def run(spark, d):
        return imports.import_edges(spark.createDataFrame([(path, text)], "path string, text string")).select("src", "dst", "rel")

    QUERIES[f"imports_{lang}"] = run
    ORACLE_SQL[f"imports_{lang}"] = "WITH " + _values("v", "src, dst", [(path, x) for x in expected]) + " SELECT src, dst, 'imports' AS rel FROM v"


for _lang in SOURCES:
    _imports(_lang)


@query(
    "WITH "
    + _values("v", "path, name, line", [("a.go", "Handle", 2), ("a.go", "T", 3), ("b.py", "f", 1), ("b.py", "C", 3), ("c.rs", "run", 1), ("c.rs", "S", 2), ("d.ts", "g", 1), ("d.ts", "I", 2)])
    + " SELECT path, name, CAST(line AS INTEGER) AS line FROM v"
)
def symbols(spark, d):
    rows = [("a.go", "package a\nfunc Handle(x int) {}\ntype T struct{}"), ("b.py", "def f():\n    pass\nclass C:"), ("c.rs", "pub async fn run() {}\npub struct S;"), ("d.ts", "export function g() {}\ninterface I {}")]
    return imports.symbols(spark.createDataFrame(rows, "path string, text string")).select("path", "name", "line")


# --- pass-through SQL of rules ----------------------------------------------


def _rule(name: str, sql: str, oracle: str | None = None) -> None:
    def run(spark, d):
        rules.register(spark, R.edges(spark, d))
        for t in ("nation", "region", "orders", "customer", "events"):
            R.table(spark, d, t).createOrReplaceTempView(t)
        return rules.rows(spark, rules.Rule(name, sql))

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql


_rule("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS cnt FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
_rule("sql_filtered_aggregate", "SELECT n_regionkey, count(*) FILTER (WHERE n_name LIKE 'A%') AS a_names, count(DISTINCT n_name) AS names FROM nation GROUP BY ALL")
_rule("sql_full_join", "SELECT r_name, n_name FROM region FULL JOIN nation ON r_regionkey = n_regionkey AND n_nationkey < 10")
_rule("sql_window_frame", "SELECT user_id, event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM events", "SELECT user_id, event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM events")
_rule("sql_set_operations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey <> 1 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
_rule(
    "sql_as_of",
    "SELECT event_id, prior FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events) WHERE event_type = 'click'",
)
_rule("sql_lateral", "SELECT n_name, x.cnt FROM nation, LATERAL (SELECT count(*) AS cnt FROM customer WHERE c_nationkey = n_nationkey) x")
_rule("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS cnt FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_rule("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS cnt FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_rule(
    "sql_pivot",
    "SELECT * FROM (SELECT user_id, event_type FROM events) PIVOT (count(*) AS n FOR event_type IN ('click' AS clicks, 'error' AS errors))",
    "SELECT user_id, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS clicks, nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS errors FROM events GROUP BY user_id",
)
_rule(
    "sql_range_frame",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM events",
)
