"""The registered corpus queries against their SQL or a brute-force version."""

import pytest
from oracle import both, database

from tessella.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, data, db):
    got, want = both(spark, data, QUERIES[name], ORACLE_SQL[name], db)
    assert got == want


def documents(spark, data):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bpe_equals_the_library(spark, data):
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    want = []
    for i, text in documents(spark, data):
        e = t.encode(text or "", add_special_tokens=False)
        ids = np.array(e.ids, "<u4").tobytes()
        want.append((i, len(e.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(QUERIES["op5_bpe"](spark, data), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_token_counts(spark, data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in documents(spark, data)]
    got = {r["n_tokens"]: r for r in QUERIES["op2_token_counts"](spark, data).collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert r["n_docs"] == n.count(limit)
        assert r["docs_ge"] == sum(x >= limit for x in n)
        assert r["tokens_ge"] == sum(x for x in n if x >= limit)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in n)
        assert r["quantile"] == sum(x <= limit for x in n) / len(n)


def test_near_duplicates(spark, data):
    from llm import brute

    assert rows(QUERIES["op8_minhash"](spark, data), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near_duplicates(documents(spark, data), 85))


def test_repeats(spark, data):
    from llm import brute

    docs = documents(spark, data)
    want = sorted((i, *r) for (i, _), r in zip(docs, brute.repeated_bytes([t for _, t in docs])))
    assert rows(QUERIES["op9_suffix_dedup"](spark, data), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_quality_on_held_out(spark, data):
    # the next larger tables, so that enough labels are held out
    folder = data.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scored = [r for r in QUERIES["op4_quality"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in scored)
    assert len(scored) > 50 and right / len(scored) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)


def test_licenses(spark, data):
    import re

    folder = data.replace("sf0.001", "sf0.01")
    found = {(r["doc_id"], r["license"]) for r in QUERIES["op10_licenses"](spark, folder).collect()}
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    for i, text in documents(spark, folder):
        for name, notice in notices.items():
            assert (notice in (text or "")) <= ((i, name) in found)
            if (i, name) in found:
                assert re.search(re.escape(notice.split()[-2]), text)


def test_pipeline(spark, data):
    import corpus_pipeline as P
    from llm import brute
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, step in P.STAGES:
        docs = step(spark, docs, data)
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
            docs = spark.createDataFrame(kept[name], docs.schema)
    # near copies: one of each component stays
    before = [(r["doc_id"], r["text"]) for r in kept["toxicity"]]
    wordless = {i for i, t in before if not (t or "").split()}
    want = {c for (_, n, c, _) in brute.near_duplicates(before, 80) if n} | wordless
    assert sorted(r["doc_id"] for r in kept["minhash"]) == sorted(want)
    # repeats: texts without any character of a repeated passage
    texts = {r["doc_id"]: r["text"] for r in kept["minhash"]}
    removed = dict(zip(texts, brute.repeated_bytes(list(texts.values()))))
    for r in kept["suffix_array"]:
        n, gone, _, digest = removed[r["doc_id"]]
        if not gone:
            assert r["text"] == texts[r["doc_id"]]
        assert len((r["text"] or "").encode()) <= n - gone and r["n_chars"] == len(r["text"] or "")
    # mixing: no document beyond three copies, each row as it was
    rows_before = {r["doc_id"]: r for r in kept["suffix_array"]}
    counts: dict = {}
    for r in kept["mixing"]:
        assert r == rows_before[r["doc_id"]]
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 3
    t = Tokenizer.from_file(tokenizer_file())
    ids = {r["doc_id"]: r["ids"] for r in kept["bpe"]}
    assert len(kept["bpe"]) == len(kept["mixing"])
    for i in list(ids)[:50]:
        assert ids[i] == t.encode(rows_before[i]["text"] or "", add_special_tokens=False).ids


def test_workers_need_no_installed_package(data):
    """From another folder and without PYTHONPATH, as on executors of a cluster."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()
print([e.queries()[q](s, {data!r}).count() for q in ('op5_bpe', 'op1_embed_dedup', 'op10_licenses', 'debounce', 'imports_rust')])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
