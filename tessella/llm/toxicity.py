"""Toxicity by a classifier chain of linear models.

Features of a text are its words and their beginnings.  Their document counts
by category over all labelled rows choose those that tell the categories apart.
The categories are then learned in order, each by a regularised logistic
regression on the chosen features and on the earlier categories' probabilities;
in training these are out-of-fold predictions, so a later model never sees a
probability fitted to the same row.

Counting and scoring cover all rows.  The regressions are fitted on at most
SAMPLE labelled rows (by hash of the id), as tasks of their own; only numbers
of chosen features are sent to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.cluster import lean, slices, stage

#: Features chosen for a category at most, labelled rows fitted on, folds.
CHOSEN, SAMPLE, FOLDS = 512, 20_000, 3
#: Evidence (a log-likelihood ratio, about chi-squared) that a feature needs.
EVIDENCE = 15.0
#: Different features that a worker counts before it tells its counts.
HELD = 1 << 18
#: Labels (16 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_LABELS = 4_000_000
#: Lengths of the word beginnings used beside whole words.
STARTS = (4, 5, 6)
#: Words remembered by a worker.
CACHE = 100_000
#: Languages with their own category at most, and toxic rows that one needs.
LANGUAGES, LEAST = 8, 20


class Names(dict):
    """What each feature of a word stands for; features that stand for nothing are left out."""

    def __init__(self, meaning):
        super().__init__()
        self.meaning = meaning

    def __missing__(self, word: str) -> tuple:
        names = [word, *("^" + word[:n] for n in STARTS if len(word) >= n)]
        found = tuple(m for m in map(self.meaning, names) if m is not None)
        if len(self) < CACHE:  # words met early are the frequent ones
            self[word] = found
        return found


def features(text: str | None, names: Names) -> list:
    import re

    found: set = set()
    for word in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
        found.update(names[word])
    return sorted(found)


def sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    """A logistic regression on sparse 0/1 features and a few dense ones."""

    sparse: object = None
    dense: object = None
    bias: float = 0.0

    def fit(self, rows, dense, y, n_sparse: int, steps: int = 150, ridge: float = 1e-4) -> Linear:
        """rows: (row, feature) of the ones.  Accelerated gradient descent.

        Features are scaled to one size, so rare ones are learned as fast as
        frequent ones.
        """
        import numpy as np

        i, j = rows
        n, k = dense.shape
        scale = np.concatenate([np.maximum(np.bincount(j, minlength=n_sparse), 1), np.maximum((dense**2).sum(0), 1)]) / n
        scale = 1 / np.sqrt(scale)
        own = scale[:n_sparse]
        z = np.zeros(n_sparse + k + 1)
        w, before, t = z.copy(), z.copy(), 1.0

        def times(w):
            return np.bincount(i, weights=(w[:n_sparse] * own)[j], minlength=n) + dense @ (w[n_sparse:-1] * scale[n_sparse:]) + w[-1]

        def back(r):
            return np.append(np.concatenate([np.bincount(j, weights=r[i], minlength=n_sparse), dense.T @ r]) * scale, r.sum())

        v = np.ones(len(z)) / len(z) ** 0.5
        for _ in range(12):
            v = back(times(v))
            norm = np.linalg.norm(v) or 1.0
            v = v / norm
        step = 1 / (0.3 * norm / n + ridge)
        for _ in range(steps):
            grad = back(sigmoid(times(z)) - y) / n + ridge * np.append(z[:-1], 0)
            w = z - step * grad
            t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
            z, before = w + (last - 1) / t * (w - before), w
        self.sparse, self.dense, self.bias = w[:n_sparse] * own, w[n_sparse:-1] * scale[n_sparse:], float(w[-1])
        return self

    def predict(self, rows, dense):
        import numpy as np

        i, j = rows
        return sigmoid(np.bincount(i, weights=self.sparse[j], minlength=len(dense)) + dense @ self.dense + self.bias)


@dataclass
class Chain:
    categories: list[str]
    chosen: dict[str, int]
    models: list = field(default_factory=list)
    threshold: float = 0.5

    def fit(self, rows, y, fold, fits) -> Chain:
        """y: a column for each category; fold: of each row; fits: gives a category's models."""
        import numpy as np

        i, j = rows
        earlier = np.zeros((len(y), 0))
        for c in range(len(self.categories)):
            out_of_fold = np.zeros(len(y))
            *parts, whole = fits(earlier, y[:, c])
            for f, model in enumerate(parts):
                out = fold == f
                use = out[i]
                place = np.cumsum(out) - 1
                out_of_fold[out] = model.predict((place[i[use]], j[use]), earlier[out])
            self.models.append(whole)
            earlier = np.column_stack([earlier, out_of_fold])
        # the cut that makes fewest errors out of fold (a false alarm counts double), in the middle of the gap
        p, truth = earlier[:, -1], y[:, -1]
        order = np.argsort(-p)
        wrong = np.concatenate([[0], np.cumsum(2 - 3 * truth[order])]) + truth.sum()
        best = np.flatnonzero(wrong == wrong.min())
        k = int(best[len(best) // 2])
        edge = np.concatenate([[1.0], p[order], [0.0]])
        self.threshold = float(min(0.9, max(0.2, (edge[k] + edge[k + 1]) / 2)))
        return self

    def predict(self, rows, n: int):
        import numpy as np

        earlier = np.zeros((n, 0))
        for model in self.models:
            earlier = np.column_stack([earlier, model.predict(rows, earlier)])
        return earlier


def ones(lists: list[list[int]]):
    import numpy as np

    sizes = [len(x) for x in lists]
    return np.repeat(np.arange(len(lists)), sizes), np.array([b for x in lists for b in x], np.int64)


def fits(spark: SparkSession, data: Broadcast, earlier, target, n_sparse: int) -> list[Linear]:
    """A category's model for each fold left out, and last the one on all rows; each is a task."""
    import numpy as np

    sent = spark.sparkContext.broadcast((earlier, target))
    schema = "k int, sparse array<double>, dense array<double>, bias double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        (i, j, fold), (earlier, target) = data.value, sent.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                out = fold == k
                use = ~out[i]
                place = np.cumsum(~out) - 1
                m = Linear().fit((place[i[use]], j[use]), earlier[~out], target[~out], n_sparse)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m.sparse]), pa.array([m.dense], pa.list_(pa.float64())), pa.array([m.bias])], names=["k", "sparse", "dense", "bias"])

    numbers = spark.range(0, FOLDS + 1, 1, FOLDS + 1).select(F.col("id").cast("int").alias("k"))
    found = sorted(numbers.mapInArrow(lean(run), schema).collect(), key=lambda r: r["k"])
    sent.unpersist()
    return [Linear(np.array(r["sparse"]), np.array(r["dense"]), r["bias"]) for r in found]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", languages: int = LANGUAGES) -> Chain | None:
    """Learn the chain from all labelled rows; None if nothing or one class only is labelled.

    Categories are toxicity within each of the ``languages`` languages with
    most toxic labelled rows, LEAST at least, and last ``label`` itself, which
    is learned from all rows, whatever their language.  Languages only make
    training targets: no model gets them as an input.  An id with several
    labels counts as toxic if one of them says so.  Null ids have no label;
    null and empty texts are rows without features.
    """
    import numpy as np

    spark = docs.sparkSession
    y = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("__toxic"))
    y = stage(y.where("doc_id is not null"), "labels")
    small = y.count() <= BROADCAST_LABELS
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # many labels: the labelled texts are brought together once, and kept for both passes
    known = known.join(F.broadcast(y), "doc_id") if small else stage(known.join(y, "doc_id"), "labelled")
    n, positive = known.agg(F.count("*"), F.count(F.when(F.col("__toxic") == 1, 1))).first()
    if not positive or positive == n:
        return None
    most = known.where("__toxic = 1 and lang is not null").groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    most = most.orderBy(F.desc("n"), "lang").limit(languages).collect()
    langs = [r["lang"] for r in most]
    categories = [*(f"toxic_{x}" for x in langs), "toxic"]
    inside = [*(r["n"] for r in most), positive]
    columns = [f"c{k}" for k in range(len(categories) + 1)]  # the last counts all rows

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids: dict[str, int] = {}
        names = Names(lambda f: ids.setdefault(f, len(ids)))
        met: list[list] = [[] for _ in columns]

        def told():
            counts = [np.bincount(np.concatenate(m) if m else np.zeros(0, np.int64), minlength=len(ids)) for m in met]
            out = pa.RecordBatch.from_arrays([pa.array(list(ids)), *(pa.array(c) for c in counts)], names=["feature", *columns])
            ids.clear()
            names.clear()
            for m in met:
                m.clear()
            return out

        for batch in batches:
            for text, lang, toxic in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = np.array(features(text, names), np.int32)
                met[-1].append(found)
                if toxic:
                    met[-2].append(found)
                    if lang in langs:
                        met[langs.index(lang)].append(found)
            if len(ids) >= HELD or sum(map(len, met[-1])) >= 16 * HELD:
                yield told()
        if ids:
            yield told()

    of_text = known.select("text", "lang", "__toxic")
    partial = of_text.mapInArrow(lean(count), "feature string, " + ", ".join(f"{c} long" for c in columns))
    counts = stage(partial.groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns]).where(F.col(columns[-1]) >= 3), "features")
    chosen: dict[str, int] = {}
    for k in range(len(categories)):
        for f in standing_out(counts, columns, k, inside[k], n):
            chosen.setdefault(f, len(chosen))

    def number(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = Names(chosen.get)
        for batch in batches:
            found = [features(t, names) for t in batch.column(0).to_pylist()]
            targets = [batch.column(1).to_pylist(), batch.column(2).to_pylist()]
            category = [(langs.index(x) if x in langs else len(langs)) if t else -1 for x, t in zip(*targets)]
            yield pa.RecordBatch.from_arrays([pa.array(category, pa.int32()), batch.column(3), batch.column(4), pa.array(found, pa.list_(pa.int32()))], names=["category", "fold", "part", "features"])

    # category: a toxic row's language by number, any other language after them, -1 if not toxic
    fold = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("part")
    sample = known.select("text", "lang", F.col("__toxic").alias("toxic"), fold, part).where(F.col("part") < int(min(1.0, SAMPLE / n) * (1 << 20)))
    sent = stage(sample.mapInArrow(lean(number), "category int, fold int, part long, features array<int>"), "sample")
    t = sent.orderBy("part", "category", "features").toArrow().combine_chunks()
    category, fold_of = t.column("category").to_numpy(), t.column("fold").to_numpy()
    lists = t.column("features").combine_chunks() if t.column("features").num_chunks != 1 else t.column("features").chunk(0)
    rows = np.repeat(np.arange(t.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    truth = np.column_stack([*(category == k for k in range(len(langs))), category >= 0]).astype(float)
    data = spark.sparkContext.broadcast((*rows, fold_of))
    chain = Chain(categories, chosen).fit(rows, truth, fold_of, lambda earlier, y: fits(spark, data, earlier, y, len(chosen)))
    data.unpersist()
    return chain


def standing_out(counts: DataFrame, columns: list[str], k: int, inside: int, n: int) -> list[str]:
    """The features that tell category ``k`` apart best and beyond chance, at most CHOSEN.

    A beginning that all its rows share with one word says no more than the
    word, and takes no place.
    """
    from math import log

    a, b = F.col(f"c{k}"), F.col(columns[-1]) - F.col(f"c{k}")
    p, q = (a + 0.5) / (inside + 1), (b + 0.5) / (n - inside + 1)
    gain = F.abs(F.log(p / q)) * F.sqrt(F.greatest(p, q))
    best = counts.orderBy(gain.desc(), "feature").limit(4 * CHOSEN).collect()

    def evidence(r) -> float:
        """The log-likelihood ratio that the shares in and out of the category differ."""
        x, total = r[f"c{k}"], r[columns[-1]]
        part = lambda m, e: m * log(m / e) if m else 0.0
        share = total / n
        seen = part(x, inside * share) + part(total - x, (n - inside) * share)
        return 2 * (seen + part(inside - x, inside * (1 - share)) + part(n - inside - total + x, (n - inside) * (1 - share)))

    words: dict[tuple, list[str]] = {}
    for r in best:
        if not r["feature"].startswith("^"):
            words.setdefault(tuple(r[c] for c in columns), []).append(r["feature"])
    found = []
    for r in best:
        f = r["feature"]
        alike = words.get(tuple(r[c] for c in columns), ()) if f.startswith("^") else ()
        if evidence(r) >= EVIDENCE and not any(w.startswith(f[1:]) for w in alike):
            found.append(f)
    return found[:CHOSEN]


def score(docs: DataFrame, chain: Chain | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", names: tuple[str, str, str] = ("toxicity", "toxic", "categories")) -> DataFrame:
    """``keep``, ``toxicity`` double, ``toxic`` boolean, ``categories`` (array of category and probability, in chain order) per row, under ``names``.

    Null and empty texts have no features and get the models' base rate, which
    is below the threshold.  Without a chain (nothing to learn from) toxicity
    is 0 and nothing is toxic.  Only the text goes to Python; the kept columns
    stay where they are.
    """
    from pyspark.sql.pandas.functions import ArrowUDFType

    if chain is None:
        empty = F.array().cast("array<struct<category:string,probability:double>>")
        return docs.select(*keep, F.lit(0.0).alias(names[0]), F.lit(False).alias(names[1]), empty.alias(names[2]))
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # CHOSEN features a category at most

    def judge(texts: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        chain = sent.value
        known = Names(chain.chosen.get)
        for batch in texts:
            p, some = [], []
            for start, count in slices(batch):
                found = [features(t, known) for t in batch.slice(start, count).to_pylist()]
                p.append(chain.predict(ones(found), len(found)))
                some += [len(f) > 0 for f in found]
            p = np.concatenate(p) if p else np.zeros((0, len(chain.categories)))
            # a text without any chosen feature has nothing to be judged by
            last = np.where(some, p[:, -1], np.minimum(p[:, -1], chain.threshold / 2)) if len(p) else np.zeros(0)
            each = pa.StructArray.from_arrays([pa.array(chain.categories * len(p), pa.string()), pa.array(p.ravel())], names=["category", "probability"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(chain.categories), pa.int32()), each)
            yield pa.StructArray.from_arrays([pa.array(last), pa.array(last >= chain.threshold), lists], names=["toxicity", "toxic", "categories"])

    judged = F.arrow_udf(judge, "struct<toxicity:double,toxic:boolean,categories:array<struct<category:string,probability:double>>>", ArrowUDFType.SCALAR_ITER)
    scored = docs.select(*keep, judged(F.col(text).cast("string")).alias("__tsl_judged"))
    return scored.select(*keep, *[F.col(f"__tsl_judged.{c}").alias(n) for c, n in zip(("toxicity", "toxic", "categories"), names)])
