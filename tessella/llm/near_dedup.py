"""Near-duplicate documents by HyperMinHash sketches, with exact verification.

A document is the set of its 5-word shingles.  Each set is hashed into BUCKETS
buckets; of each bucket's least hash the sketch keeps the number of leading
zeros and MANTISSA bits behind them, in 16 bits.  Empty buckets borrow from a
fixed random sequence of others.  BANDS bands of compressed registers put
documents into buckets; there pairs are estimated from all registers, corrected
for chance collisions, and those above a floor well below the threshold make
candidate groups.  Only within these are full sets compared, exactly.

Equal sets are one node from the start.  No pairs are emitted: each task gives
a spanning forest of what it links.  Large buckets and groups are dealt out as
pairs of blocks, so a task holds two blocks at most and no pair is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.cluster import block_pairs, connected_components, lean, one_of_each, release, stage, text_key, whole_groups

WORDS = 5
BUCKETS, MANTISSA = 128, 10
BANDS, ROWS = 25, 5
#: Standard errors that the estimate may lie below the threshold.
SLACK = 6
#: Documents of a band bucket, and shingles and documents of a candidate group, in one block.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 4_000_000
#: Documents of a candidate group that are always one block, and blocks made for parallelism at most.
SPLIT_DOCS, SPLITS = 128, 32
#: Distinct words that a worker remembers.
CACHE = 100_000


class WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, ids: WordIds):
    """Sorted 64-bit hashes of the distinct 5-word shingles of a text.

    A-Z count as a-z.  Fewer than five words make one shingle, none none.
    """
    import numpy as np

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    total = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(words))):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(total)


def probes():
    """For each bucket the order in which it asks others when it is empty."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(11))
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(hashes, order):
    """The HyperMinHash registers of a sorted, non-empty set of hashes."""
    import numpy as np

    bits = BUCKETS.bit_length() - 1
    edges = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - bits)
    at = np.searchsorted(hashes, edges)
    full = at < np.append(at[1:], len(hashes))
    rest = hashes[np.minimum(at, len(hashes) - 1)] << np.uint64(bits)
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 62)
    behind = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    r = (((zeros + 1) << MANTISSA) | behind.astype(np.int64)).astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        asked = order[empty]
        r[empty] = r[asked[np.arange(len(empty)), full[asked].argmax(1)]]
    return r


def chance(n, m):
    """The probability that registers of disjoint sets of n and m shingles agree."""
    import numpy as np

    zeros = np.arange(0, 57)[:, None]

    def spread(size):
        per = np.maximum(np.asarray(size, float) / BUCKETS, 1)
        return (1 - 2.0 ** -(zeros + 1)) ** per - (1 - 2.0**-zeros) ** per

    return (spread(n) * spread(m)).sum(0) / 2**MANTISSA


def estimate(agreeing, n, m):
    """Jaccard similarity from agreeing registers, corrected for chance collisions."""
    p = chance(n, m)
    return (agreeing / BUCKETS - p) / (1 - p)


def floor_of(percent: int) -> float:
    t = percent / 100
    return t - SLACK * (t * (1 - t) / BUCKETS) ** 0.5


def candidate_forest(regs, n, percent: int):
    """Labels that join documents of a band bucket whose estimate reaches the floor."""
    import numpy as np

    label, open_, floor = np.arange(len(regs)), np.arange(len(regs)), floor_of(percent)
    while len(open_):
        root, todo, open_ = open_[0], [open_[0]], open_[1:]
        while todo and len(open_):
            x = todo.pop()
            hit = estimate((regs[open_] == regs[x]).sum(1), n[x], n[open_]) >= floor
            label[open_[hit]] = root
            todo.extend(open_[hit])
            open_ = open_[~hit]
    return label


def exact_forest(sets: list, percent: int):
    """Labels of the components of sets with 100 * intersection >= percent * union."""
    import numpy as np

    size = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    of = np.repeat(label, size)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    alone = np.bincount(of, weights=count[token] == 1, minlength=len(sets)).astype(np.int64)
    open_ = 100 * (size - alone) >= percent * size
    shared = (count[token] > 1) & open_[of]
    of, token = of[shared], token[shared]
    own = np.searchsorted(of, np.arange(len(sets) + 1))
    indexed = 0
    while open_.any():
        root = int(np.argmax(open_))
        open_[root], todo = False, [root]
        while todo and open_.any():
            left = np.count_nonzero(open_)
            if indexed == 0 or 2 * left < indexed:
                live = open_[of]
                order = np.argsort(token[live], kind="stable")
                lists, docs = token[live][order], of[live][order]
                first = np.searchsorted(lists, np.arange(len(count) + 1))
                indexed = left
            x = todo.pop()
            t = token[own[x] : own[x + 1]]
            a, n = first[t], first[t + 1] - first[t]
            at = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
            common = np.bincount(docs[at], minlength=len(sets))
            hit = np.flatnonzero(open_ & ((100 + percent) * common >= percent * (size[x] + size)))
            label[hit], open_[hit] = root, False
            todo.extend(hit.tolist())
    return label


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, s1, s2, k1, k2, regs`` per row: set size, set signature, text key, registers.

    ``regs`` is null for empty sets and for sets that the task met before.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        ids, order, seen = WordIds(), probes(), set()
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    n, sig, regs = [], [], []
                    for t in part.column(3).to_pylist():
                        s = shingles(t, ids)
                        key = xxhash.xxh3_128_digest(s.tobytes())
                        n.append(len(s))
                        sig.append(key)
                        if not len(s) or key in seen:
                            regs.append(None)
                            continue
                        if len(seen) >= CACHE:
                            seen.clear()
                        seen.add(key)
                        regs.append(registers(s, order).tobytes())
                    s12 = np.frombuffer(b"".join(sig), np.int64).reshape(-1, 2)
                    cols = [part.column(0), pa.array(n, pa.int64()), pa.array(s12[:, 0].copy()), pa.array(s12[:, 1].copy()), part.column(1), part.column(2), pa.array(regs, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "s1", "s2", "k1", "k2", "regs"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id), *text_key(F.col(text)), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n long, s1 long, s2 long, k1 long, k2 long, regs binary")


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """``node, grp``: groups that hold every pair whose sketches may reach the threshold."""
    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substring(F.col("regs"), b * width + 1, F.lit(width)), b))
    keys = nodes.select("node", F.explode(bands).alias("key"))
    crowded = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = keys.join(crowded, "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK_DOCS))
    met = met.select("key", "node", F.explode(block_pairs(F.col("blocks"), F.pmod(F.xxhash64("node"), F.col("blocks")))).alias("p"))
    met = met.join(nodes.select("node", "n", "regs"), "node").select("key", "p.i", "p.j", "node", "n", "regs")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def solve(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for t in whole_groups(batches, 3, 8192):
            key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(3)])
            node, n = t.column(3).to_numpy(), t.column(4).to_numpy()
            regs = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            ends = np.append(starts[1:], len(node))
            two = starts[ends - starts == 2]
            close = estimate((regs[two] == regs[two + 1]).sum(1), n[two], n[two + 1]) >= floor_of(percent) if len(two) else np.zeros(0, bool)
            a, b = [node[two[close]]], [node[two[close] + 1]]
            for s, e in zip(starts, ends):
                if e - s > 2:
                    label = candidate_forest(regs[s:e], n[s:e], percent)
                    tied = np.flatnonzero(label != np.arange(e - s))
                    a.append(node[s:e][tied])
                    b.append(node[s:e][label[tied]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    found = connected_components(met.mapInArrow(lean(solve), "a long, b long"))
    return found.select("node", F.col("component").alias("grp"))


def links(texts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: a spanning forest of the exact links within candidate groups.

    ``members`` has ``node, grp, n, k1, k2``; ``texts`` has ``k1, k2, text``.
    """
    sizes = members.groupBy("grp").agg(F.sum("n").alias("w"), F.count("*").alias("m"))
    # a group is split for parallelism long before it has to be for memory
    each = F.greatest(F.lit(min(SPLIT_DOCS, BLOCK_DOCS)), F.least(F.lit(BLOCK_DOCS), F.ceil(F.col("m") / SPLITS)))
    blocks = F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("m") / each))
    asked = members.join(sizes.select("grp", blocks.alias("blocks")), "grp").select("k1", "k2", "node", "grp", "blocks")

    def sets(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids = WordIds()
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    rows = [(r["grp"], r["blocks"], r["node"], shingles(r["text"], ids).tobytes()) for r in batch.slice(at, 200).to_pylist()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows), [pa.int64(), pa.int64(), pa.int64(), pa.binary()])], names=["grp", "blocks", "node", "shingles"])

    joined = one_of_each(texts).join(asked, ["k1", "k2"]).select("node", "grp", "blocks", "text")
    full = joined.mapInArrow(lean(sets), "grp long, blocks long, node long, shingles binary")
    full = full.select("grp", F.explode(block_pairs(F.col("blocks"), F.pmod(F.xxhash64("node"), F.col("blocks")))).alias("p"), "node", "shingles")
    full = full.select("grp", "p.i", "p.j", "node", "shingles").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")

    def solve(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for t in whole_groups(batches, 3, 2000):
            key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(3)])
            node, packed = t.column(3).to_numpy(), t.column(4)
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            a, b = [], []
            for s, e in zip(starts, np.append(starts[1:], len(node))):
                if e - s > 1:
                    label = exact_forest([np.frombuffer(x, np.uint64) for x in packed.slice(s, e - s).to_pylist()], percent)
                    tied = np.flatnonzero(label != np.arange(e - s))
                    a += node[s:e][tied].tolist()
                    b += node[s:e][label[tied]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return full.mapInArrow(lean(solve), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Also ``grp``, a number of the group (null without shingles), and ``k1, k2``.

    Two documents are linked if 100 * intersection >= percent * union of their
    shingle sets; components are those of the links.  ``component_id`` is the
    least id in the component, ``kept`` whether it is the row's own.  Null and
    empty texts have no shingles and are linked with nothing, so they are kept.
    Equal texts under one id are all kept here.  Null ids never are.
    """
    rows = stage(sketches(docs, doc_id, text), "sketches")
    some = rows.where("n > 0").groupBy("s1", "s2")
    nodes = some.agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("regs", ignorenulls=True).alias("regs"), F.first(F.struct("k1", "k2")).alias("k"))
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "least", "n", "regs", "k.k1", "k.k2"), "nodes")
    groups = stage(candidates(nodes, percent), "groups")
    members = groups.join(nodes.select("node", "n", "k1", "k2"), "node")
    texts = docs.select(*text_key(F.col(text)), F.col(text).cast("string").alias("text"))
    found = stage(links(texts, members, percent), "found")
    release(groups)
    whole = connected_components(found).join(nodes.select("node", "s1", "s2", "least"), "node")
    named = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = whole.join(named, "component").select("s1", "s2", "component", "component_id")
    alone = nodes.select("s1", "s2", "node", F.col("least").alias("own"))
    alone = alone.join(linked, ["s1", "s2"], "left").withColumn("grp", F.coalesce("component", "node"))
    classes = alone.select("s1", "s2", "grp", F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"))
    classes = stage(classes, "classes")
    plain = rows.select("doc_id", "n", "s1", "s2", "k1", "k2")
    out = plain.where("n > 0").join(classes, ["s1", "s2"]).select("doc_id", "n", "component_id", "grp", "k1", "k2")
    # those without shingles all look alike and meet nobody
    out = out.union(plain.where("n = 0").select("doc_id", "n", "doc_id", F.lit(None).cast("long"), "k1", "k2"))
    own = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", own.alias("kept"), "grp", "k1", "k2")


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group.

    The one with the least id stays (null ids last, then by text key), once if
    its row is repeated.  Documents without words all stay.
    """
    keys = [k.alias(f"__tsl_{i}") for i, k in enumerate(text_key(F.col("text")))]
    rows = docs.select("*", *keys)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    chosen = near_duplicates(docs, percent).where("grp is not null").groupBy("grp").agg(first).select("first.*")
    same = rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["__tsl_0"] == chosen["k1"]) & (rows["__tsl_1"] == chosen["k2"])
    stay = rows.join(chosen, same, "left_semi")
    once = Window.partitionBy("doc_id", "__tsl_0", "__tsl_1").orderBy(F.lit(0))
    stay = stay.withColumn("__tsl_k", F.row_number().over(once)).where("__tsl_k = 1").select(*docs.columns)
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return stay.union(docs.where(wordless))
