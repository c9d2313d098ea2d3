"""Repeated passages by a sparse suffix array: every byte of a repeated 200-byte string.

A suffix counts by its first WINDOW bytes.  Sorting all suffixes of a corpus
would move each byte 200 times, so suffixes are first grouped by a leading
token that equal suffixes must share: the least (by hash) GRAM-byte string in
their first WINDOW bytes, an anchor.  One anchor leads a run of neighbouring
suffixes; about one in 70 positions is one.

1. ``anchors``: each text's anchors, with a fingerprint of all bytes that the
   suffixes led by it cover (its context).
2. Anchors whose gram occurs once lead no repeated suffix and are dropped.  If
   all contexts of a gram are equal, all its suffixes are repeated.
3. The others send one context of each kind to range partitions of the gram,
   whose splitters Spark samples.  A partition expands its suffixes, sorts them
   by their tokens (multikey quicksort) and compares neighbours.  A batch is cut
   only between grams, and the last, open one is carried over the boundary.
   A gram with more than HOT contexts is cut by further splitters, sampled on
   its suffixes' next tokens and places; neighbours are then also compared
   across the boundaries.
4. Each text's removed runs are the union of its repeated suffixes' bytes.

Texts that occur several times are read once; each byte of them is removed if
they are WINDOW bytes long.  Nulls count as empty; texts shorter than WINDOW
bytes lose nothing.  Fingerprints have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.cluster import lean, one_of_each, release, slices, stage, text_key

WINDOW, GRAM = 200, 64
#: Bytes handled at once, and texts whose keys a task remembers.
SLICE, SEEN = 1 << 18, 1 << 17
#: Contexts of a gram that are sorted in one place, and contexts sorted at once.
HOT, BATCH = 5_000, 5_000


class Rolling:
    """Polynomial fingerprints modulo 2^64 of all substrings of some bytes."""

    def __init__(self, seed: int):
        import numpy as np

        self.np, self.size = np, 0
        rng = np.random.Generator(np.random.PCG64(seed))
        self.of_byte = rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
        self.base = int(rng.integers(2**62, 2**63)) * 8 + 5

    def powers(self, n: int):
        np = self.np
        if n > self.size:
            self.size = max(n, 2 * SLICE + 4096)
            self.up = np.cumprod(np.full(self.size, self.base % 2**64, np.uint64)) * np.uint64(pow(self.base, -1, 2**64))
            self.down = np.cumprod(np.full(self.size, pow(self.base, -1, 2**64), np.uint64)) * np.uint64(self.base % 2**64)
        return self.up, self.down

    def load(self, data) -> Rolling:
        np = self.np
        _, down = self.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * down[: len(data)], out=self.sums[1:])
        return self

    def __call__(self, start, end):
        up, _ = self.powers(1)
        return mixed64((self.sums[end] - self.sums[start]) * up[start])


def mixed64(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def window_minimum(x, width: int):
    """The minimum of each run of ``width`` neighbours, by doubling."""
    import numpy as np

    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done :])


def pieces(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Concatenations of about SLICE bytes with (text, offset in it) of each part.

    A long text comes in parts that overlap by WINDOW - 1 bytes, so each suffix
    of WINDOW bytes starts in exactly one part.
    """
    where, parts, total = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - WINDOW + 1), SLICE):
            part = t[at : at + SLICE + WINDOW - 1]
            if parts and total + len(part) > SLICE:
                yield where, parts
                where, parts, total = [], [], 0
            where.append((i, at))
            parts.append(part)
            total += len(part)
    if parts:
        yield where, parts


def find_anchors(parts: list[bytes], one: Rolling, two: Rolling):
    """part, anchor, first and last suffix start (in the part), gram and context fingerprint."""
    import numpy as np

    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    one.load(data)
    two.load(data)
    n = len(data)
    at = np.arange(n - GRAM + 1)
    grams = one(at, at + GRAM)
    # of equal grams the leftmost is the least
    least = window_minimum((grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), WINDOW - GRAM + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), ends - starts)[: len(anchor)]
    valid = np.flatnonzero(np.arange(len(anchor)) + WINDOW <= ends[part])
    a = anchor[valid]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    low, high = valid[first], valid[np.append(first[1:], len(valid)) - 1]
    a = a[first]
    shape = ((a - low) * 512 + (high - low)).astype(np.uint64)
    context = mixed64(two(low, high + WINDOW) + shape * np.uint64(0x9E3779B97F4A7C15))
    part = part[low]
    base = starts[part]
    return part, a - base, low - base, high - base, grams[a], context


def anchors(texts: DataFrame) -> DataFrame:
    """``k1, k2, g, c, low, span, lead`` for each anchor of ``k1, k2, text``.

    ``low`` is the first suffix start it leads, ``span`` how many follow, and
    ``lead`` the anchor's distance from ``low``.  Of equal texts in one task
    only the first is read.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        one, two, seen = Rolling(1), Rolling(2), set()
        with np.errstate(over="ignore"):
            for batch in batches:
                keys, chosen = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), []
                for i, key in enumerate(keys):
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        chosen.append(i)
                text = batch.column(2).take(pa.array(chosen, pa.int32())).cast(pa.binary()).to_pylist()
                k1, k2 = (np.array([keys[i][c] for i in chosen], np.int64) for c in (0, 1))
                for where, parts in pieces(text):
                    part, a, low, high, g, c = find_anchors(parts, one, two)
                    which, offset = (np.array(x, np.int64)[part] for x in zip(*where))
                    cols = [k1[which], k2[which], g.view(np.int64), c.view(np.int64), low + offset, (high - low).astype(np.int16), (a - low).astype(np.int16)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["k1", "k2", "g", "c", "low", "span", "lead"])

    return texts.select("k1", "k2", "text").mapInArrow(lean(run), "k1 long, k2 long, g long, c long, low long, span short, lead short")


def multikey_groups(columns: list):
    """Sort rows by several token columns, one token at a time, among ties only.

    Returns the order and a mask of the rows that equal their predecessor in
    it.  This is multikey quicksort with all ties of one depth handled at once:
    rows that already differ are never compared again.
    """
    import numpy as np

    n = len(columns[0])
    order = np.argsort(columns[0], kind="stable")
    first = columns[0][order]
    tied = np.concatenate([[False], first[1:] == first[:-1]]) if n else np.zeros(0, bool)
    for column in columns[1:]:
        group = np.cumsum(~tied)
        open_ = tied | np.append(tied[1:], False)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        rows = order[at]
        rows = rows[np.lexsort((column[rows], group[at]))]
        order[at] = rows
        now = column[rows]
        tied[at[1:]] &= now[1:] == now[:-1]
    return order, tied


def expand(contexts: list[bytes], g, lead, one: Rolling, two: Rolling):
    """All suffixes of the contexts: (context, start in it, tokens)."""
    import numpy as np

    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum(sizes) - sizes
    one.load(data)
    two.load(data)
    count = sizes - WINDOW + 1
    which = np.repeat(np.arange(len(contexts)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    p = base[which] + start
    half = WINDOW // 2
    token = mixed64(g.view(np.uint64)[which] + (lead[which] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return which, start, [token, one(p, p + half), one(p + half, p + WINDOW), two(p, p + WINDOW)]


def sort_contexts(contexts: DataFrame) -> DataFrame:
    """``k1, k2, start, end`` of the bytes that the repeated suffixes of each context cover.

    Contexts are range-partitioned by their gram, the leading token; a bucket
    sorts the suffixes of whole grams.
    """
    few = contexts.select("g", "k1", "k2", "low", "lead", "n", "bytes").repartitionByRange("g").sortWithinPartitions("g")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        one, two = Rolling(1), Rolling(2)

        def solve(t):
            g, k1, k2, low, lead, n = (t.column(i).to_numpy().astype(np.int64) for i in range(6))
            which, start, tokens = expand(t.column(6).to_pylist(), g, lead, one, two)
            order, tied = multikey_groups(tokens)
            hit = order[tied | np.append(tied[1:], False)]
            least, most = np.full(len(g), 1 << 40), np.full(len(g), -1)
            np.minimum.at(least, which[hit], start[hit])
            np.maximum.at(most, which[hit], start[hit])
            keep = (most >= 0) & (n == 1)
            cols = [x[keep] for x in (k1, k2, low + least, low + most + WINDOW)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["k1", "k2", "start", "end"])

        held, rows = [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    held.append(batch.slice(at, BATCH))
                    rows += held[-1].num_rows
                    if rows >= BATCH:
                        t = pa.Table.from_batches(held).combine_chunks()
                        g = t.column(0).to_numpy()
                        cut = int(np.searchsorted(g, g[-1]))  # the last gram may go on
                        if cut:
                            yield solve(t.slice(0, cut))
                        held = t.slice(cut).to_batches()
                        rows = t.num_rows - cut
            if rows:
                yield solve(pa.Table.from_batches(held).combine_chunks())

    return few.mapInArrow(lean(run), "k1 long, k2 long, start long, end long")


def sort_suffixes(contexts: DataFrame) -> DataFrame:
    """As :func:`sort_contexts`, for grams too crowded for one bucket.

    Their suffixes themselves are range-partitioned: further splitters are
    sampled on the tokens behind the gram, and among equal suffixes on the
    place, so a crowd of any size is cut.  Each bucket compares sorted
    neighbours; its first and last suffix are compared with those of the other
    buckets, as equal suffixes on two sides of a boundary are at these ends.
    """

    def spell(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        one, two = Rolling(1), Rolling(2)
        with np.errstate(over="ignore"):
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    t = whole.slice(at, 2000)
                    g, k1, k2, low, lead, n = (t.column(i).to_numpy().astype(np.int64) for i in range(6))
                    which, start, tokens = expand(t.column(6).to_pylist(), g, lead, one, two)
                    cols = [*(x.view(np.int64) for x in tokens), k1[which], k2[which], low[which], start.astype(np.int32), n[which]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["t0", "t1", "t2", "t3", "k1", "k2", "low", "p", "n"])

    tokens, place = ["t0", "t1", "t2", "t3"], ["k1", "k2", "low", "p"]
    many = contexts.select("g", "k1", "k2", "low", "lead", "n", "bytes")
    suffixes = stage(many.mapInArrow(lean(spell), "t0 long, t1 long, t2 long, t3 long, k1 long, k2 long, low long, p int, n long"), "suffixes")
    dealt = suffixes.repartitionByRange(*tokens, *place).sortWithinPartitions(*tokens, *place)

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        before = None  # the last row of the batch before, and whether it was told already
        first = True

        def rows(t, edge):
            return pa.RecordBatch.from_arrays([*(t.column(c) for c in range(9)), pa.array(np.full(t.num_rows, edge))], names=[*tokens, *place, "n", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)])
            same = (keys[:, 1:] == keys[:, :-1]).all(0)
            tied = np.append(False, same) | np.append(same, False)
            if before is not None and (before[0] == keys[:, 0]).all():
                tied[0] = True
                if not before[2]:
                    yield rows(before[1], False)
            yield rows(batch.take(pa.array(np.flatnonzero(tied))), False)
            if first:
                yield rows(batch.slice(0, 1), True)
                first = False
            before = keys[:, -1], batch.slice(batch.num_rows - 1), bool(tied[-1])
        if before is not None:
            yield rows(before[1], True)

    told = stage(dealt.mapInArrow(lean(compare), "t0 long, t1 long, t2 long, t3 long, k1 long, k2 long, low long, p int, n long, edge boolean"), "told")
    ends = told.where("edge").drop("edge").distinct()  # two rows for each bucket at most
    across = ends.join(ends.groupBy(*tokens).agg(F.count("*").alias("m")).where("m > 1"), tokens, "left_semi")
    hit = told.where("not edge").drop("edge").union(across.select(*tokens, *place, "n")).where("n = 1")
    found = hit.groupBy("k1", "k2", "low").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    return found.select("k1", "k2", (F.col("low") + F.col("a")).alias("start"), (F.col("low") + F.col("b") + WINDOW).alias("end"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """``k1, k2, runs``: the union of each text's runs (``start, end``) as disjoint, ordered ones.

    A run has WINDOW bytes or more, so a text's list is a small part of its size.
    """
    w = Window.partitionBy("k1", "k2").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs.withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = fresh.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("k1", "k2", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def removals(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """``k1, k2, n_removed, n_spans, kept_sha256`` of the texts that lose bytes to other places.

    Texts without a row here lose nothing, except that a text of WINDOW bytes
    or more that itself occurs twice is removed whole (see :func:`dedup`).
    With ``with_text`` also ``kept``: the text without any character that lost
    a byte.
    """
    texts = docs.select(*text_key(F.col(text)), F.col(text).cast("string").alias("text")).where(F.octet_length("text") >= WINDOW)
    found = stage(anchors(texts), "anchors")
    by_gram = found.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).where("n > 1")
    by_gram = stage(by_gram, "grams")  # so that a frequent gram's partition can be split in the join
    led = stage(found.join(by_gram, "g").withColumn("same", F.expr("least = most")).drop("n", "least", "most"), "led")
    release(found, by_gram)
    # of the grams with several contexts, one anchor of each context is sorted
    open_ = led.where("not same")
    kinds = stage(open_.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "low")).alias("first")), "kinds")
    crowds = stage(kinds.groupBy("g").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT).select("g"), "crowds")
    rows = open_.join(kinds, ["g", "c"])
    asked = rows.where(F.struct("k1", "k2", "low") == F.col("first")).select("k1", "k2", F.struct("g", "low", "span", "lead", "n").alias("a"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list("a").alias("anchors"))
    until = (F.col("low") + F.col("span") + WINDOW).alias("end")
    known = led.where("same").select("k1", "k2", F.col("low").alias("start"), until)
    known = merged_runs(known.union(rows.where("n > 1").select("k1", "k2", F.col("low").alias("start"), until)))
    listed = stage(known.join(asked, ["k1", "k2"], "full"), "listed")
    release(led, kinds)
    # the only time that all whole texts move
    parts = stage(one_of_each(texts).join(listed, ["k1", "k2"]), "parts")
    release(listed)

    def cut_contexts(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["k1", "k2", "g", "low", "lead", "n", "bytes"]
        for batch in batches:
            for s, count in slices(batch.column(2), SLICE):
                part = batch.slice(s, count)
                lists = part.column(3)
                which = np.repeat(np.arange(count), np.diff(lists.offsets.to_numpy()))
                g, low, span, lead, n = (lists.flatten().field(c).to_numpy().astype(np.int64) for c in range(5))
                texts = [t.encode() for t in part.column(2).to_pylist()]
                cut = [texts[i][a:b] for i, a, b in zip(which.tolist(), low.tolist(), (low + span + WINDOW).tolist())]
                k1, k2 = (part.column(c).to_numpy()[which] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (k1, k2, g, low, lead, n)), pa.array(cut, pa.binary())], names=names)

    cut = parts.where("anchors is not null").select("k1", "k2", "text", "anchors")
    contexts = stage(cut.mapInArrow(lean(cut_contexts), "k1 long, k2 long, g long, low long, lead long, n long, bytes binary"), "contexts")
    if crowds.isEmpty():
        runs = sort_contexts(contexts)
    else:
        runs = sort_contexts(contexts.join(crowds, "g", "left_anti")).union(sort_suffixes(contexts.join(crowds, "g", "left_semi")))
    runs = stage(merged_runs(runs).withColumnRenamed("runs", "found"), "runs")
    release(contexts, crowds)
    whole = parts.select("k1", "k2", "text", F.col("runs").alias("known")).join(runs, ["k1", "k2"], "left").where("known is not null or found is not null")
    whole = whole.select("k1", "k2", "text", F.concat(F.coalesce("known", F.array()), F.coalesce("found", F.array())).alias("runs"))
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if with_text:
        schema = schema.add("kept", T.StringType())

    def remove(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for s, count in slices(batch.column(2), SLICE):
                part = batch.slice(s, count)
                lists = part.column(3)
                edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                start, end = (lists.flatten().field(c).to_numpy() for c in (0, 1))
                out = []
                for i, t in enumerate(part.column(2).to_pylist()):
                    b = t.encode()
                    order = edges[i] + np.argsort(start[edges[i] : edges[i + 1]], kind="stable")
                    gone = union_of(start[order], end[order])
                    row = [sum(y - x for x, y in gone), len(gone), hashlib.sha256(b"".join(left_of(b, gone))).hexdigest()]
                    if with_text:
                        row.append(b"".join(left_of(b, whole_characters(b, gone))).decode())
                    out.append(row)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, y) for x, y in zip(zip(*out), types))], names=schema.names)

    return whole.mapInArrow(lean(remove), schema)


def union_of(start, end) -> list[tuple[int, int]]:
    """Maximal runs that intervals, ordered by their start, cover."""
    import numpy as np

    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return list(zip(start[first].tolist(), reach[np.append(first[1:], len(reach)) - 1].tolist()))


def left_of(b: bytes, gone: list[tuple[int, int]]) -> Iterator[bytes]:
    """The pieces of ``b`` outside some ordered intervals, which may overlap."""
    at = 0
    for x, y in gone:
        if x > at:
            yield b[at:x]
        at = max(at, y)
    yield b[at:]


def whole_characters(b: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals widened to whole characters of UTF-8."""
    out = []
    for x, y in gone:
        while b[x] & 0xC0 == 0x80:
            x -= 1
        while y < len(b) and b[y] & 0xC0 == 0x80:
            y += 1
        out.append((x, y))
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: one row per row of ``docs``.

    A byte is removed if some WINDOW-byte string over it also starts anywhere
    else, judged on the input.  Null and empty texts have 0 bytes; rows are
    independent of their ids, which may be null or repeated.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *text_key(F.col(text)), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    lost = stage(removals(docs, text), "lost").join(copies, ["k1", "k2"], "full")
    j = rows.join(lost, ["k1", "k2"], "left")
    all_gone = F.coalesce(F.col("copies") > 1, F.lit(False)) & (F.col("n_bytes") >= WINDOW)
    pick = lambda gone, c, kept: F.when(all_gone, gone).otherwise(F.coalesce(F.col(c), kept)).alias(c)
    return j.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), "n_removed", F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("sha")),
    )


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of their texts.

    A character goes if any of its bytes is removed; ``n_chars``, if there, is
    set to the new length.  No row is dropped; null texts stay null.
    """
    keys = [k.alias(f"__tsl_{i}") for i, k in enumerate(text_key(F.col(text)))]
    rows = docs.select("*", *keys)
    copies = rows.groupBy("__tsl_0", "__tsl_1").agg(F.count("*").alias("__tsl_n")).where("__tsl_n > 1")
    lost = stage(removals(docs, text, with_text=True), "lost").select(F.col("k1").alias("__tsl_0"), F.col("k2").alias("__tsl_1"), F.col("kept").alias("__tsl_kept"))
    j = rows.join(lost.join(copies, ["__tsl_0", "__tsl_1"], "full"), ["__tsl_0", "__tsl_1"], "left")
    gone = F.coalesce(F.col("__tsl_n") > 1, F.lit(False)) & (F.octet_length(text) >= WINDOW)
    out = j.withColumn(text, F.when(gone, F.lit("")).otherwise(F.coalesce("__tsl_kept", text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.char_length(text).cast("long")))
    return out.select(*docs.columns)
