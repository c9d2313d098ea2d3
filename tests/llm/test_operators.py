"""Operators on small tables: nulls, ties, repeats, empty tables, clashing names, block limits."""

import random

import pytest
from llm import brute
from pyspark.sql import functions as F

from tessella.llm import bpe, cluster, embed_dedup, license_scan, mixing, near_dedup, quality, suffix_dedup, token_counts, topk_search, toxicity
from tessella.llm.queries import tokenizer_file

#: The last columns have names that operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, text_key string, epochs int, toxic int, k1 string, grp string, kept string, size string, n_tokens int"
CLASHING = (9, 1, "k", "g", "t", "s", 3)
P_DATA = "/root/testdata/sf0.001"
EXTRA = [
    (1, None, None, None, None, "x", "a"),
    (2, "", "en", "s1", 0, "x", "a"),
    (3, " \n\t ", "en", "s1", 4, "x", "a"),
    (4, "one two", "en", "s2", 7, "x", "a"),
    (4, "one two", "en", "s2", 7, "x", "a"),
    (None, "one two three four five six", "en", None, 1, "x", "a"),
    (None, "quite another text without an id here", "en", None, 1, "x", "a"),
    (7, "é" * 300 + " <|endoftext|> " + "word " * 400, "fr", "s3", 1, "x", "a"),
    (8, "A long text. " * 4000, "en", "s1", 1, "x", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASHING) for r in EXTRA], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (8, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


def test_every_operator_takes_odd_rows(docs, labels):
    n = len(EXTRA)
    path = tokenizer_file()
    assert bpe.encode(docs, path).count() == n
    assert token_counts.histogram(docs, path).agg(F.sum("n_docs")).first()[0] == n
    assert token_counts.histogram(docs, path, by=("source",)).where("source is null").agg(F.sum("n_docs")).first()[0] == 3
    assert mixing.mix(docs).count() == n
    assert quality.score(docs, labels).count() == n
    assert near_dedup.near_duplicates(docs).count() == n
    assert suffix_dedup.dedup(docs).count() == n
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == n
    assert license_scan.scan(docs).isEmpty()
    for step in (near_dedup.deduplicated, suffix_dedup.cleaned, mixing.mixed):
        assert step(docs).columns == docs.columns and all(tuple(r)[-7:] == CLASHING for r in step(docs).collect())
    import corpus_pipeline as P

    for name, step in P.STAGES[:1]:
        assert name == "toxicity" and step(docs.sparkSession, docs, P_DATA).columns == docs.columns


def test_every_operator_takes_empty_tables(spark, empty):
    path, none = tokenizer_file(), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert bpe.encode(empty, path).isEmpty()
    totals = token_counts.context_totals(token_counts.histogram(empty, path))
    assert totals.isEmpty() and tuple(token_counts.at_limit(totals, 10).first()) == (0, 0, 0)
    for out in (mixing.mix(empty), mixing.mixed(empty), quality.score(empty, none), near_dedup.near_duplicates(empty), near_dedup.deduplicated(empty), suffix_dedup.dedup(empty), suffix_dedup.cleaned(empty), license_scan.scan(empty)):
        assert out.isEmpty()
    assert toxicity.train(empty, none) is None and toxicity.score(empty, None).isEmpty()
    assert embed_dedup.near_duplicates(vectors).isEmpty() and topk_search.top_k(vectors, vectors).isEmpty()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file()), bpe.Bpe.load(tokenizer_file()).build()


def test_bpe_on_random_text(tokenizer):
    library, own = tokenizer
    rng = random.Random(3)
    pool = [chr(i) for i in (*range(1, 0x250), *range(0x370, 0x600), *range(0x3000, 0x3100), 0x1F600, 0x2028, 0x85, 0xA0)] + [" "] * 100 + ["the", "aaaa", "!!!", "\n\n", "'s", "'re"] * 30 + ["<|endoftext|>"] * 5
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == s
    for s in ("a" * 3000, " " * 2000, "ab" * 2000, "!?" * 1000, "aaab" * 500):
        assert own.encode(s) == library.encode(s, add_special_tokens=False).ids


def test_token_totals_at_any_limit(spark, docs):
    n = [r["n_tokens"] for r in bpe.lengths(docs, tokenizer_file()).collect()]
    totals = token_counts.context_totals(token_counts.histogram(docs, tokenizer_file()))
    for limit in (0, 1, 5, 1000, 10**6):
        assert tuple(token_counts.at_limit(totals, limit).first()) == (len(n), sum(x > limit for x in n), sum(min(x, limit) for x in n))
    assert token_counts.quantile(totals, 0.5).first()[0] == sorted(n)[(len(n) - 1) // 2]


def water(sizes, weights, caps):
    """Clamp and share again until nothing changes."""
    total, fixed = sum(sizes), {}
    while True:
        left, w = total - sum(fixed.values()), sum(x for i, x in enumerate(weights) if i not in fixed)
        over = [i for i in range(len(sizes)) if i not in fixed and left * weights[i] / w > caps[i]]
        if not over:
            return [fixed.get(i, left * weights[i] / w if i not in fixed else 0) for i in range(len(sizes))]
        fixed |= {i: caps[i] for i in over}


@pytest.mark.parametrize("seed", range(3))
def test_water_filling(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i:02}" for i in range(8)] + [None]
    sizes = [rng.choice([0, 5, 40, 300, 20_000]) for _ in names]
    got = {r["source"]: r["target"] for r in mixing.water_fill(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
    want = water(sizes, [i % 3 + 1 for i in range(len(names))], [3 * s for s in sizes])
    assert [got[n] for n in names] == pytest.approx(want)


def test_mix_reaches_targets_and_reruns_agree(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.mix(x).collect()), key=repr) for x in (df, df.repartition(7)))
    assert first == again
    by = {}
    for _, source, size, whole, target, _, epochs, taken in first:
        assert 0 <= epochs <= 3 and taken == size * epochs
        by.setdefault(source, [whole, target, 0])[2] += taken
    for whole, target, taken in by.values():
        assert abs(taken - target) <= 60 and target <= 3 * whole
    out = mixing.mixed(df)
    assert out.count() == sum(r[6] for r in first)


def near_copies(seed):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(300)]
    base = [rng.choice(voc) for _ in range(150)]
    rows = []
    for _ in range(150):
        b = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            b[rng.randrange(150)] = rng.choice(voc)
        rows.append(" ".join(b))
    for n in range(12):
        b = [rng.choice(voc) for _ in range(n)]
        rows += [" ".join(x).upper() for x in (b, b, [*b, "zz"], b[1:])]
    return list(enumerate([*rows, None, " \n"]))


@pytest.mark.parametrize("block", [4096, 25])
def test_near_duplicates_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    rows = near_copies(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(df, 85).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == sorted(brute.near_duplicates(rows, 85))


@pytest.mark.parametrize("threshold", ["60k", "1g", "-1"])
def test_each_node_sends_one_set_under_any_join(spark, tmp_path, threshold):
    rng = random.Random(8)
    noise = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    copied = noise(100)
    near = copied + " end"
    texts = []
    for k in range(60):
        texts += [noise(400), *([copied] if k % 4 == 0 else []), *([near] if k == 31 else [])]
    keyed = lambda df: df.select(*cluster.text_key(F.col("text")), "text")
    keyed(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)).write.parquet(f"{tmp_path}/texts")
    nodes = spark.createDataFrame([(7, copied), (9, near)], "node long, text string")
    members = nodes.select("node", F.lit(1).cast("long").alias("grp"), F.lit(100).cast("long").alias("n"), *cluster.text_key(F.col("text")))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        got = near_dedup.links(spark.read.parquet(f"{tmp_path}/texts"), members, 80).collect()
    finally:
        spark.conf.set(key, before)
    assert [sorted(r) for r in got] == [[7, 9]]


def test_sketch_estimates():
    import numpy as np

    rng, order = np.random.default_rng(0), near_dedup.probes()
    with np.errstate(over="ignore"):
        for n, share in ((40, 0.5), (400, 0.85), (4000, 0.3)):
            errors = []
            for _ in range(30):
                pool = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
                rng.shuffle(pool)
                common = int(share * n)
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
                agree = int((near_dedup.registers(a, order) == near_dedup.registers(b, order)).sum())
                errors.append(float(near_dedup.estimate(agree, np.array([n]), np.array([n]))[0]) - common / (2 * n - common))
            assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.1


def test_one_of_each_group_stays(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text), (3, text.upper()), (None, text), (9, "other words entirely for this one"), (None, "a text without an id but clean"), (9, "other words entirely for this one"), (2, None), (2, None)]
    got = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=repr) == sorted([(3, text.upper()), (9, rows[3][1]), (None, rows[4][1]), (2, None), (2, None)], key=repr)


def repeats(seed):
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(500))
    noise = lambda: "".join(rng.choice("ijklmnop ") for _ in range(rng.randint(0, 300)))
    texts = [noise() + passage[rng.randint(0, 150) : rng.randint(300, 500)] + noise() for _ in range(30)]
    return [*texts, None, "", "x" * 199, "x" * 200, "y" * 700, "ab" * 300, "é" * 150 + "tail", "Heat " * 80 + "end", texts[0]]


@pytest.mark.parametrize("hot", [5000, 3])
def test_repeats_with_and_without_hot_grams(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 12 if hot == 3 else 1 << 19)
    texts = repeats(2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in suffix_dedup.dedup(df).collect())
    assert got == [(i, *r) for i, r in enumerate(brute.repeated_bytes(texts))]


@pytest.mark.parametrize("threshold", ["60k", "1g", "-1"])
def test_copies_that_lie_apart_under_any_join(spark, tmp_path, threshold):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(n))
    shared = noise(400)
    copied, short = noise(100) + shared + noise(50), noise(50) + shared
    texts = []
    for k in range(60):
        texts += [noise(3000), *([copied] if k % 9 == 0 else []), *([short] if k == 31 else [])]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/texts")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        df = spark.read.parquet(f"{tmp_path}/texts")
        got = sorted(tuple(r) for r in suffix_dedup.dedup(df).collect())
        kept = suffix_dedup.cleaned(df).count()
    finally:
        spark.conf.set(key, before)
    assert got == [(i, *r) for i, r in enumerate(brute.repeated_bytes(texts))]
    assert kept == len(texts)


def test_cleaned_text_has_no_broken_characters(spark):
    shared = "€" * 100
    rows = [(1, "front " + shared + " tail", 7), (2, shared + " other", 7), (3, "clean", 7), (4, None, None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in suffix_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got[3] == ("clean", 5) and got[4] == (None, None)
    assert got[1][0].startswith("front") and got[1][0].endswith("tail") and "€" not in got[1][0]


def test_multikey_order():
    import numpy as np

    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order, tied = suffix_dedup.multikey_groups(columns)
    rows = [tuple(int(c[i]) for c in columns) for i in order]
    assert rows == sorted(rows)
    assert [bool(t) for t in tied[1:]] == [a == b for a, b in zip(rows, rows[1:])]


def vectors(seed):
    rng = random.Random(seed)
    rows, k = [], 0
    for c in range(4):
        b = [rng.gauss(0, 1) for _ in range(16)]
        for _ in range(40):
            s = rng.choice([0.02, 0.08, 0.14, 0.2])
            rows.append((k, [x + rng.gauss(0, s) for x in b], c % 3))
            k += 1
    odd = [[0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [], None, [None, 1.0], [1.0, 2.0], [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    rows += [(k + i, v, 1) for i, v in enumerate(odd)]
    k += len(odd)
    return [*rows, (k, rows[0][1], None), *[(k + 1 + i, rows[5][1], rows[5][2]) for i in range(6)]]


@pytest.mark.parametrize(("cell", "block"), [(4096, 4096), (15, 4096), (15, 7)])
def test_linked_vectors(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect())) == sorted(brute.linked_vectors(rows))


def test_cells_of_pivots_that_point_the_same_way():
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=48)
    scaled = lambda n: np.stack([c * v / np.linalg.norm(c * v) for c in rng.uniform(0.1, 9, n)])
    nearest, reach = embed_dedup.reached(scaled(3000), scaled(12), (2 - 2 * 0.98) ** 0.5 + embed_dedup.ROUNDING)
    assert reach.all()


@pytest.mark.parametrize(("n_rows", "n_queries"), [(16384, 1 << 24), (50, 200)])
def test_top_k(spark, monkeypatch, n_rows, n_queries):
    import numpy as np

    monkeypatch.setattr(topk_search, "ROWS", n_rows)
    monkeypatch.setattr(topk_search, "QUERY_BYTES", n_queries)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(260, 8))
    base[40:80] = base[40]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000, None), (1001, [float("nan")] * 8), (1002, [1.0]), (7, base[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk_search.top_k(df, df.where("vec_id % 20 = 0 and vec_id < 900"), 5).collect())
    x = np.floor(1024 * np.vstack([base, base[7]])).astype(int)
    ids, want = [*range(260), 7], []
    for q in range(0, 260, 20):
        best = sorted((-int(x[j] @ x[q]), ids[j]) for j in range(len(x)) if ids[j] != q)[:5]
        want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(best)]
    assert got == sorted(want)


def test_components_of_random_graphs(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r["node"]: r["component"] for r in cluster.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = sorted({x for p in pairs for x in p})
    least = dict(zip(ids, brute.components(ids, [(ids.index(a), ids.index(b)) for a, b in pairs])))
    assert got == {n: c for n, c in least.items() if any(n in p and p[0] != p[1] for p in pairs)}


def test_toxicity_is_learned(spark):
    rng = random.Random(0)
    voc = [f"{a}{b}" for a in "bcdfg" for b in ("ala", "enor", "ist", "omen", "urp")]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(voc) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["grumble", "nastyword", "vilest"] if i % 2 else ["vequala", "vequist", "vequorn"])
        rows.append((i, " ".join(words), "en" if i % 2 else "fr"))
        if i % 10 < 7:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert chain.categories == ["toxic_en", "toxic_fr", "toxic"]
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert sum(got[i]["toxic"] != (i % 5 == 0) for i in range(900)) <= 5
    assert [c["category"] for c in got[0]["categories"]] == chain.categories


def test_toxicity_with_many_languages(spark):
    rng = random.Random(1)
    voc = [f"{a}{b}" for a in "bcdfg" for b in ("ala", "enor", "ist", "omen", "urp")]
    rows, labels = [], []
    for i in range(2400):
        words = [rng.choice(voc) for _ in range(20)]
        if i % 2:
            words[rng.randrange(20)] = rng.choice(["grumble", "nastyword", "vilest"])
        rows.append((i, " ".join(words), f"x{i // 2}"))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert chain is not None and chain.categories == ["toxic"]
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, chain).collect()}
    assert sum(got[i] != bool(i % 2) for i in got) <= 5


def test_one_class_of_labels(spark, docs):
    one = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, one).collect()} == {0.5}
    assert toxicity.train(docs, one) is None


def best_alignment(template, text):
    """Smith-Waterman without a band: the best score."""
    h, best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)], 0
    for i, a in enumerate(template):
        for j, b in enumerate(text):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a == b else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_alignment_equals_full_alignment():
    rng = random.Random(0)
    template = license_scan.words(license_scan.TEMPLATES["MIT-text"])
    for _ in range(40):
        part = list(template)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(part))
            part[k : k + rng.randint(0, 1)] = [b"zz"] * rng.randint(0, 2)
        text = [b"front"] * rng.randint(0, 9) + part + [b"tail"] * rng.randint(0, 9)
        at = len(text) - len(part)
        matched, first, end = license_scan.align(template, text, -16, at + 16)
        assert best_alignment(template, text) == best_alignment(template, text[first:end])
        assert matched <= end - first


def test_license_spans(spark):
    T = license_scan.TEMPLATES
    edited = T["Apache-2.0-header"].replace("obtain a copy", "get one copy").replace("writing,", "writing\n * ,")
    rows = [(1, "é front\n" + T["MIT"] + "\nback " + T["MIT"].upper()), (2, edited), (3, "the MIT license is mentioned"), (4, None), (5, T["MIT-text"])]
    got = [tuple(r) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    spans = [(r[6], r[7]) for r in got if r[0] == 1 and r[1] == "MIT"]
    text = rows[0][1].encode()
    assert [text[a:b] for a, b in spans] == [b"Released under the MIT License", b"RELEASED UNDER THE MIT LICENSE"]
    header = next(r for r in got if r[0] == 2 and r[1] == "Apache-2.0-header")
    assert 0.9 < header[2] < 1
    assert not [r for r in got if r[0] in (3, 4)]
    assert ("MIT-text", 1.0) in {(r[1], r[2]) for r in got if r[0] == 5}
    with pytest.raises(ValueError, match="fewer than"):
        license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"x": "two words"})


def test_short_licenses_with_words_between(spark):
    rows = [
        (1, "Released under the terms of the MIT License"),
        (2, "Released under MIT License"),
        (3, "released it under some MIT like thing"),
        (4, "all our rights stay reserved"),
    ]
    got = {(r[0], r[1]): r[2] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx({(1, "MIT"): 5 / 5.75, (2, "MIT"): 0.8, (4, "all-rights-reserved"): 3 / 3.5})


def test_quality_factors():
    import numpy as np

    rng = np.random.default_rng(0)
    moments, data = {}, {}
    for k in (0, 1):
        x = rng.normal(k, 1 + k, size=(500, 10))
        data[k], moments[k] = x, (len(x), x.sum(0), x.T @ x)
    model = quality.Discriminant.fit(moments)
    x = rng.normal(size=(20, 10))
    want = []
    pooled = sum(np.diag(p / n - np.outer(s / n, s / n)) * n for n, s, p in moments.values()) / 1000
    for k in (0, 1):
        cov = np.cov(data[k].T)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.diag(np.diag(cov)) + quality.RIDGE * np.diag(pooled)
        d = x - data[k].mean(0)
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp((want[0] - want[1]) / quality.TEMPERATURE)))


def test_vectors_of_any_size(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [2e200, 2e200], 1), (3, [1e-200, 2e-200], 1), (4, [1.0, 0.1], 1), (5, [5e-324, 1e-323], 1), (6, [0.0, 0.0], 1), (7, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in embed_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False), (6, 0, 6, True), (7, 0, 7, True)]
    with pytest.raises(Exception, match="vector too long for scores of 64 bits"):
        topk_search.top_k(df, df)


def test_empty_texts_of_a_source_at_its_cap(spark):
    rows = [(i, "w " * 5, "a") for i in range(10)] + [(100 + i, "", "a") for i in range(3)] + [(200 + i, "v " * 400, "b") for i in range(9)] + [(300, None, "c"), (None, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["source"], r["size"], r["epochs"]) for r in mixing.mix(df).collect()]
    assert {e for s, n, e in got if s == "a"} == {3} and {e for s, n, e in got if s == "c"} == {1}
    assert max(e for _, _, e in got) == 3
    clashing = df.withColumn("__id", F.lit(1)).withColumn("__size", F.lit("x")).withColumn("__epochs", F.lit(2))
    out = mixing.mixed(clashing)
    assert out.columns == clashing.columns and out.count() == sum(e for _, _, e in got)


def test_one_notice_gives_one_license(spark):
    notices = {"CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, notice in notices.items():
        assert [m[:2] for m in index.scan(license_scan.words(f"front text {notice} and more"), 0.8)] == [(name, 1.0)]
    many = license_scan.words("Licensed under CC BY 4.0. " * 1000)
    assert [(m[0], m[3], m[4]) for m in index.scan(many, 0.8)] == [("CC-BY-4.0", 6 * i, 6 * i + 6) for i in range(1000)]


def full_scan(index, text, least=0.8):
    """All templates aligned without a band over the whole text, again beside each match."""
    found = set()
    for name, template in zip(index.names, index.words):
        parts = [(0, len(text))]
        while parts:
            a, b = parts.pop()
            matched, first, end = license_scan.align(template, text, -len(template), len(text), a, b)
            if matched:
                covered = matched / (len(template) + license_scan.GAP * (end - first - matched))
                if covered >= least:
                    found.add((name, covered, matched, first, end))
                parts += [(x, y) for x, y in ((a, first), (end, b)) if y - x >= least * len(template) and covered >= least]
    return license_scan.best_apart(found, {n: len(w) for n, w in zip(index.names, index.words)})


def test_scan_equals_a_scan_without_index_and_band():
    rng = random.Random(4)
    index = license_scan.Index(license_scan.TEMPLATES)
    filler = ["lorem", "under", "ipsum", "license", "the", "of", "rights"]
    for _ in range(60):
        text = [rng.choice(filler) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            text += license_scan.TEMPLATES[rng.choice(index.names)].split() + [rng.choice(filler) for _ in range(rng.randint(3, 25))]
        got = license_scan.words(" ".join(text))
        assert index.scan(got, 0.8) == full_scan(index, got)


def test_long_periodic_texts(spark):
    texts = ["ab" * 40_000, "x" * 60_000 + "end", "front" + "ab" * 3_000 + "back", "abc " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r)[:4] for r in suffix_dedup.dedup(df).collect())
    want = []
    for i, t in enumerate(texts):
        n = len(t)
        want.append({0: (i, n, n, 1), 1: (i, n, n - 3, 1), 2: (i, n, n - 9, 1), 3: (i, n, n, 1)}[i])
    assert got == want


def test_quality_equals_a_plain_discriminant(spark):
    import zlib

    import numpy as np

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["abc", "Word", "12", "x!", "tion"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    labels = [(i, rng.randint(0, 1)) for i in range(0, 400, 2)] + [(0, -1), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = {i: np.array(quality.statistics(t)) for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in x}
    data = {k: np.array([x[i] for i, y in labels if y == k and not held[i]]) for k in (0, 1)}
    every = sum(len(v) for v in data.values())
    pooled = sum(v.var(0) * len(v) for v in data.values()) / every
    density = []
    for k in (0, 1):
        cov = np.cov(data[k].T)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.diag(np.diag(cov)) + quality.RIDGE * np.diag(np.maximum(pooled, 1e-6))
        d = np.array([x[i] for i, _ in rows]) - data[k].mean(0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    odds = np.log(len(data[1]) / len(data[0]))
    want = 1 / (1 + np.exp(-((density[1] - density[0]) / quality.TEMPERATURE + odds)))
    assert [got[i]["score"] for i, _ in rows] == pytest.approx(want.tolist(), abs=1e-6)
    assert all(got[i]["held_out"] == held[i] for i in x)


def test_folder_that_all_nodes_share(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            _jsc = spark.sparkContext._jsc

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="all nodes share"):
            cluster.shared_dir(Elsewhere)
