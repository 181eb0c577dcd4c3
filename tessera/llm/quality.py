"""Document quality by regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics. Each class has a mean and a covariance shrunk towards
the pooled covariance and a multiple of the identity; a score is the logistic of the difference of the
log-densities (Mahalanobis distances through cached Cholesky factors) and log-priors. Fitting needs only
the classes' counts, sums and sums of products, which are added up over all labelled rows, in integers so
that the result doesn't depend on their order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, free_name, slices

#: Share of the pooled covariance in a class's, then of the mean variance times identity.
POOLED, RIDGE = 0.2, 0.001
#: Log-odds are divided by this before the logistic; densities of correlated statistics are too sure.
TEMPERATURE = 2.0
THRESHOLD = 0.7
#: Statistics are rounded to multiples of 1 / SCALE.
SCALE = 1 << 12
NAMES = (
    "log_words", "mean_word", "distinct", "top_word", "symbols", "upper", "digits", "punctuation", "bars", "bangs",
    "long_words", "short_words", "dup_lines", "compression", "adjacent", "stop_ends",
)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PUNCTUATION = b".,;:?'\"()-"
_SYMBOLS = b"#*$%&<>{}[]\\^~_=+@/"


def statistics(text: bytes) -> tuple[float, ...]:
    """The statistics of NAMES; an empty text has zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return (0.0,) * len(NAMES)
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lens = np.fromiter(map(len, words), np.int64, n)
    solid = int(lens.sum())
    share = lambda chars: (size - len(text.translate(None, chars))) / solid
    lines = text.split(b"\n")
    bare = [x for x in lines if x.strip()]
    same = sum(map(eq, words, words[1:]))
    sample = zlib.compress(text, 1)
    root = lambda x: min(x, 1.0) ** 0.5
    return (
        float(np.log1p(n)),
        float(np.log1p(lens.mean())),
        float(np.log((len(distinct) + 1.0) / (n**0.8 + 1.0))),
        root(max(distinct.values()) / (n + 10)),
        root(share(_SYMBOLS)),
        root(share(_UPPER)),
        root(share(_DIGITS)),
        root(share(_PUNCTUATION)),
        root(share(b"|")),
        root(share(b"!")),
        root(float((lens > 12).mean())),
        root(float((lens < 4).mean())),
        root(1.0 - len(set(bare)) / len(bare)),
        float(np.log((len(sample) + 20.0) / (size + 40.0))),
        root(same / n),
        root(sum(x.rstrip()[-1:] in b".!?:" for x in bare) / len(bare)),
    )


@dataclass
class Model:
    """Class priors, means, Cholesky factors of the covariances and their inverses; None where rows of a class are lacking."""

    prior: tuple[float, float]
    mean: np.ndarray | None
    factor: np.ndarray | None
    constant: np.ndarray | None
    whitening: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability-like scores of rows of statistics."""
        if self.mean is None:
            return np.full(len(x), self.prior[1])
        logs = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.whitening[k].T
            logs.append(self.constant[k] - 0.5 * (z**2).sum(1))
        return 1.0 / (1.0 + np.exp(((logs[0] - logs[1]) / TEMPERATURE).clip(-50, 50)))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and ``stats`` (long multiples of 1 / SCALE)."""
    rest = [c for c in docs.columns if c != text_col]
    name = free_name(docs, "stats")
    slim = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`").cast("binary").alias(name))
    schema = slim.drop(name).schema.add(name, T.ArrayType(T.LongType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = rounded(b.column(b.num_columns - 1).to_pylist())
            at = np.arange(len(made) + 1, dtype=np.int32) * len(NAMES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(at), pa.array(made.ravel()))], names=[*rest, name])

    return slim.mapInArrow(run, schema)


def rounded(texts: list[bytes | None]) -> np.ndarray:
    made = np.array([statistics(t or b"") for t in texts]).reshape(-1, len(NAMES))
    return np.rint(made * SCALE).astype(np.int64)


def fit(labelled: DataFrame) -> Model:
    """A model of ``labelled(stats, label)``, label 0 or 1; adds up sums and products over all rows.

    Without rows of both classes every score is the share of label 1 (0.5 without any row).
    """
    p = len(NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, p + 1, p + 1), np.int64)  # with a constant 1 before: counts, sums, products
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            one = np.hstack([np.ones((len(x), 1), np.int64), x])
            label = b.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                sums[k] += one[label == k].T @ one[label == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "n"])

    parts = labelled.select("stats", F.col("label").cast("int").alias("label")).mapInArrow(run, "at long, n long")
    total = np.zeros(2 * (p + 1) ** 2, dtype=object)
    for r in parts.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        total[r["at"]] = int(r.n)
    total = total.reshape(2, p + 1, p + 1)
    count = [int(total[k, 0, 0]) for k in (0, 1)]
    if min(count) < 2:
        share = count[1] / sum(count) if sum(count) else 0.5
        return Model((1 - share, share), None, None, None)
    mean = [(total[k, 0, 1:] / count[k]).astype(float) / SCALE for k in (0, 1)]
    cov = [(total[k, 1:, 1:].astype(float) / SCALE**2) / count[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (cov[0] * count[0] + cov[1] * count[1]) / sum(count)
    factor, constant = [], []
    for k in (0, 1):
        own = (1 - POOLED) * cov[k] + POOLED * pooled
        own = (1 - RIDGE) * own + RIDGE * (np.trace(own) / p + 1e-6) * np.eye(p)
        factor.append(np.linalg.cholesky(own))
        constant.append(float(np.log(count[k] / sum(count)) - np.log(np.diag(factor[k])).sum()))
    return Model((count[0] / sum(count), count[1] / sum(count)), np.array(mean), np.array(factor), np.array(constant), np.linalg.inv(np.array(factor)))


def held_out(id_col: str, folds: int = 4, fold: int = 2):
    """True for rows that no label is learned from, by crc32 of the id as text (null ids: as empty text)."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % folds == fold


def training_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> DataFrame:
    """``id, label`` of the rows to learn from; an id with several labels has the least, other values than 0 and 1 are ignored."""
    own = labels.filter(~held_out(id_col, folds, fold) & F.col(f"`{label_col}`").isin(0, 1))
    return own.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(F.col(f"`{label_col}`").cast("int")).alias("label"))


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """A model of ``stats(id, stats)`` with those of ``labels(doc_id, quality)`` that may be learned from."""
    known = training_labels(labels, "quality")
    return fit(stats.join(known, "id").select("stats", "label"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``.

    A null text is scored as an empty one; null and repeated ids stay as they are; labels of ids that
    ``docs`` lacks are ignored. The statistics are computed once and kept in the shared folder.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    stats = cut(measured(keyed))
    model = train(stats, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)) / SCALE
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    schema = stats.select("id").schema.add("score", "double").add("predicted", "integer")
    made = stats.mapInArrow(run, schema)
    return made.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored under ``threshold``; columns as they were."""
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    model = train(cut(measured(keyed)), labels)  # statistics are joined to labels, not texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array(model.score(rounded(texts) / SCALE) >= threshold))

    return docs.mapInArrow(run, docs.schema)
