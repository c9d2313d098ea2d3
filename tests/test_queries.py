"""Every registered query of the graph engine equals its SQL."""

import pytest
from oracle import both, database

from tessella.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, data, db):
    got, want = both(spark, data, QUERIES[name], ORACLE_SQL[name], db)
    assert got == want


def test_understand_is_deterministic(spark, data):
    from tessella.operators import context
    from tessella.queries import TASK
    from tessella.sources import relational

    a, b = (context.understand(relational.edges(spark, data), TASK) for _ in range(2))
    assert a == b and a["files"] and a["text"].startswith("## MAP\n")


def test_understand_gives_sources_and_symbols(spark, data):
    from tessella.operators import context
    from tessella.queries import ABOUT, _sources, _symbols
    from tessella.sources import relational

    out = context.understand(relational.edges(spark, data), ABOUT, _sources(spark, data), _symbols(spark, data))
    assert "(source unavailable)" not in out["text"] and "documents/" in out["text"]
    assert any(r["detail"] for r in out["files"]) and any(r["found"] for r in out["files"])
    assert {r["path"]: r["tier"] for r in out["files"]} == {r["path"]: r["tier"] for r in QUERIES["understand"](spark, data).collect()}


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())
