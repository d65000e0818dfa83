"""Quality classifier: regularised quadratic discriminant analysis of text statistics.

Each text gives a vector of transformed statistics. For each class, the mean and a
covariance shrunk towards the pooled one and then towards a scaled identity are
learned; the score is the logistic of the difference of the two Gaussian log
densities, from Mahalanobis distances with Cholesky factors computed once.

Null texts count as empty, and empty texts are scored like any other. Labels that are
null or neither 0 nor 1 are not learned from. Without rows of both classes every score
is the share of class 1 seen, or 0.5. Equal rows get equal scores; an empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolio.llm.common import columns_ddl, sampled, slices, texts_of, tidy
from kinfolio.llm.hashing import SPACE_BYTES, buffers, shingle_hashes, span_hashes, word_spans
from kinfolio.session import broadcast_if_small, cut

#: Labelled documents a class learns from at most, chosen by the hashes of their ids.
SAMPLE_PER_CLASS = 6000
#: Share of the pooled covariance, and of the scaled identity, in each class covariance.
POOL, RIDGE = 0.1, 0.02
#: Widest distance, in standard deviations, that one statistic may be from the mean.
CLIP = 6.0

FEATURES = (
    "log_words", "mean_word_bytes", "capitals", "digits", "symbols", "stops", "newlines",
    "bars", "exclamations", "distinct_words", "repeated_windows", "repeated_lines", "wide_bytes",
)


#: Byte classes whose share of the text is a statistic.
_CLASSES = {
    "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&<>@^~=+_{}[]\\/",
    "stops": b".,;:?", "newlines": b"\n", "bars": b"|", "exclamations": b"!", "wide_bytes": bytes(range(128, 256)),
}
_CLASS_OF = np.zeros(256, dtype=np.uint8)
for _i, _chars in enumerate(_CLASSES.values(), 1):
    _CLASS_OF[list(_chars)] = _i
_LINE = np.zeros(256, dtype=bool)
_LINE[ord("\n")] = True


def _grouped(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (owner, 44 bits of key) values and which of them equal the one before."""
    k = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)))
    same = np.zeros(len(k), dtype=bool)
    same[1:] = k[1:] == k[:-1]
    return k, same


def _owners(k: np.ndarray, n: int) -> np.ndarray:
    return np.bincount((k >> np.uint64(44)).astype(np.int64), minlength=n)


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each owner, how many of its keys equal another of its keys, the first included."""
    k, same = _grouped(keys, owner)
    twice = same.copy()
    twice[:-1] |= same[1:]
    return _owners(k[twice], n)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(texts)
    data, offsets = buffers(texts)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    kinds = len(_CLASSES) + 1
    cell = np.repeat(np.arange(n, dtype=np.int64) * kinds, np.diff(offsets)) + _CLASS_OF[data]
    shares = np.bincount(cell, minlength=n * kinds).reshape(n, kinds)[:, 1:] / size[:, None]
    share = dict(zip(_CLASSES, shares.T, strict=True))
    starts, ends, counts = word_spans(data, offsets, SPACE_BYTES)
    words = span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), counts)
    many = np.maximum(counts, 1)
    k, same = _grouped(words, owner)
    distinct = _owners(k[~same], n)
    window = shingle_hashes(words, 5)[: max(0, len(words) - 4)]
    inside = owner[: len(window)] == owner[4:] if len(words) > 4 else np.zeros(0, dtype=bool)
    repeated = _repeats(window[inside], owner[: len(window)][inside], n)
    at, to, lines = word_spans(data, offsets, _LINE)
    line_owner = np.repeat(np.arange(n), lines)
    same_lines = _repeats(span_hashes(data, at, to), line_owner, n)
    length = np.bincount(owner, weights=(ends - starts).astype(float), minlength=n)
    columns = {
        "log_words": np.log1p(counts), "mean_word_bytes": np.log1p(length / many),
        "distinct_words": np.log1p(distinct) - np.log1p(counts), "repeated_windows": np.sqrt(repeated / many),
        "repeated_lines": np.sqrt(same_lines / np.maximum(lines, 1)),
    } | {k: np.sqrt(v) for k, v in share.items()}
    return np.stack([columns[k] for k in FEATURES], axis=1)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiteners: list[np.ndarray]  # inverses of the covariances' Cholesky factors
    offsets: list[float]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.whiteners:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        density = [
            offset - 0.5 * (((z - mean) @ whitener.T) ** 2).sum(axis=1)
            for mean, whitener, offset in zip(self.means, self.whiteners, self.offsets, strict=True)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -50, 50)))


def build(x: np.ndarray, y: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> Model:
    """Class means and shrunk covariances from feature rows and 0/1 labels."""
    prior = float(y.mean()) if len(y) else 0.5
    centre = x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(len(FEATURES))
    if len(np.unique(y)) < 2:
        return Model(centre, scale, [], [], [], prior)
    z = np.clip((x - centre) / scale, -CLIP, CLIP)
    means = [z[y == k].mean(axis=0) for k in (0, 1)]
    spread = [(z[y == k] - m).T @ (z[y == k] - m) for k, m in enumerate(means)]
    pooled = sum(spread) / len(z)
    whiteners, offsets = [], []
    for k in (0, 1):
        cov = (1 - pool) * spread[k] / (y == k).sum() + pool * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        whiteners.append(np.linalg.inv(factor))
        offsets.append(float(np.log((y == k).mean()) - np.log(np.diag(factor)).sum()))
    return Model(centre, scale, means, whiteners, offsets, prior)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from at most ``per_class`` labelled documents of each class; their feature rows reach the driver."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y in (0, 1)")
    chosen = broadcast_if_small(cut(sampled(marked.distinct(), "y", "key", per_class)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(texts_of(batch, "text"))
            yield pa.record_batch([batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    found = rows.mapInArrow(tidy(run), "y int, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, found["y"]))  # sums in one order, whatever order the rows came in
    return build(x[order], found["y"].to_numpy()[order])


def predict(docs: DataFrame, model: Model, *keep: Column, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The ``keep`` columns with ``score`` and ``predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias("_text"))
    names = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            score = shared.value.scores(features(texts_of(batch, "_text")))
            out = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]
            yield pa.record_batch([*(batch.column(c) for c in names), *out], names=[*names, "score", "predicted"])

    return source.mapInArrow(tidy(run), columns_ddl(source.schema.fields[:-1], "score double, predicted int"))

