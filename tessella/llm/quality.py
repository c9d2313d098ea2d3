"""Quality scores by a regularised quadratic discriminant on document statistics.

Each whole text gives a few statistics (lengths, shares of kinds of characters,
repetition), transformed so that good prose is about normal.  Both classes get
a mean and a covariance from all labelled training rows; covariances are shrunk
toward their diagonal.  A score is the logistic of the difference of the two
log densities, read from Mahalanobis distances with Cholesky factors that are
computed once and tempered, plus the log odds of the classes.

The moments are sums, so training uses every labelled row and sends the driver
a fixed number of figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.cluster import lean, stage

#: The statistics, in order.
NAMES = ("bytes", "word_length", "upper", "punctuation", "main_mark", "digits", "space", "distinct_words", "repeated_words", "lines")
#: Weight of the diagonal in a covariance, and the ridge added to it.
SHRINKAGE, RIDGE = 0.1, 0.01
#: The log-density difference is divided by this: tails are heavier than normal ones.
TEMPERATURE = 3.0
#: Characters or words of ordinary prose that are added to each text, so short texts are not extreme.
PRIOR = 40.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text (null counts as empty)."""
    import numpy as np

    data = (text or "").encode()
    words = data.split()
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    space = int(count[9:14].sum() + count[32])
    marks = np.concatenate([count[33:48], count[58:65], count[91:97], count[123:127]])
    letters = upper + lower + int(count[128:].sum())
    n, w = len(data), len(words)
    repeated = sum(a == b for a, b in zip(words, words[1:]))

    def share(part: float, whole: float, usual: float) -> float:
        p = (part + PRIOR * usual) / (whole + PRIOR)
        return float(np.log((p + 1e-3) / (1 - p + 1e-3)))

    return [
        float(np.log1p(n)),
        float(np.log((n - space + 5 * PRIOR) / (w + PRIOR))),
        share(upper, letters, 0.03),
        share(int(marks.sum()), n, 0.02),
        share(int(marks.max()), n, 0.01),
        share(digits, n, 0.005),
        share(space, n, 0.16),
        share(len(set(words)), w, 0.9),
        share(repeated, w, 0.01),
        share(int(count[10]), n, 0.003),
    ]


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, x``: the statistics of each row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = [statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of the two classes."""

    means: list
    inverse: list
    offset: float
    odds: float

    @classmethod
    def fit(cls, moments: dict) -> Discriminant | None:
        """From {class: (n, sums, sums of products)}; None unless both classes have rows."""
        import numpy as np

        if not all(k in moments and moments[k][0] >= 2 for k in (0, 1)):
            return None
        means, inverse, log_det, log_n = [], [], [], []
        pooled = sum(np.diag(p / n - np.outer(s / n, s / n)) * n for n, s, p in moments.values()) / sum(m[0] for m in moments.values())
        for k in (0, 1):
            n, s, p = moments[k]
            mean = s / n
            cov = (p - n * np.outer(mean, mean)) / (n - 1)
            own = np.diag(np.diag(cov))
            cov = (1 - SHRINKAGE) * cov + SHRINKAGE * own + RIDGE * np.diag(np.maximum(pooled, 1e-6))
            factor = np.linalg.cholesky(cov)
            means.append(mean)
            inverse.append(np.linalg.inv(factor))
            log_det.append(2 * np.log(np.diag(factor)).sum())
            log_n.append(np.log(n))
        return cls(means, inverse, float((log_det[0] - log_det[1]) / 2), float(log_n[1] - log_n[0]))

    def score(self, x):
        """The probability of class 1 for rows of statistics."""
        import numpy as np

        far = [(((x - m) @ i.T) ** 2).sum(1) for m, i in zip(self.means, self.inverse)]
        difference = (far[0] - far[1]) / 2 + self.offset
        return 1 / (1 + np.exp(-np.clip(difference / TEMPERATURE + self.odds, -500, 500)))


def moments(labelled: DataFrame) -> dict:
    """Counts, sums and products of ``y`` (0 or 1) and ``x`` over all rows, in one aggregation."""
    import numpy as np

    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in labelled.where("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n"), *sums, *products).collect():
        p = np.zeros((d, d))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[r["y"]] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), p)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``.

    Trained on the rows of ``labels`` (by ``doc_id``; the least label where an
    id has several; others than 0 and 1 ignored) with crc32(doc_id) mod 5 not
    0.  Null and empty texts are scored as empty.  If a class has fewer than
    two training rows, every score is 0.5.  Null ids are never trained on.
    """
    x = stage(features(docs, doc_id, text), "statistics")
    y = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(label).alias("y"))
    train = x.join(y.where(~held_out(F.col("doc_id"))), "doc_id")
    model = Discriminant.fit(moments(train))
    kind = x.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            p = model.score(values) if model else np.full(len(values), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    scored = x.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
