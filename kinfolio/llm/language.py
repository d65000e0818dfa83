"""Language identification with hyperdimensional profiles.

Every letter, of whatever script, has a random vector of +1 and -1 drawn from its code
point. A letter trigram is the elementwise
product of its letters' vectors, permuted by their places; a text, and a language's
prototype, is the sum of its trigram vectors. A text goes to the prototype with the
largest cosine. The text's vector itself is never built: by linearity its dot product
with a prototype is the sum of its trigrams' dot products, kept in a small table, and
its length is the expected one for nearly orthogonal trigram vectors, the same for
all languages, so it can't change which language wins.

Trigrams that no learned language has count for the length alone.

Null texts, empty texts and texts without a letter are ``und`` with score 0. Equal
cosines go to the language whose name sorts first. Repeated rows give repeated
results; an empty table gives an empty one; without any labelled text every text is
``und``. Texts of any length are read whole. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolio.llm.common import columns_ddl, sampled, slices, texts_of, tidy

UNKNOWN = "und"
#: Length of the letter vectors.
DIMENSIONS = 4096
#: Labelled documents a language learns from at most, chosen by the hashes of their ids.
SAMPLE_PER_LANGUAGE = 2000
#: Turns cosines into a score between 0 and 1.
SHARPNESS = 16.0
#: Bytes of text handled at a time; its trigrams take some forty times as much.
SLICE = 1 << 20

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    if not _letters:
        table = np.arange(0x110000, dtype=np.int32)
        table[[not chr(i).isalpha() for i in range(0x110000)]] = 0
        _letters.append(table)
    return _letters[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of lower-cased texts by code point (0: a run of other characters) and each one's text number."""
    joined = " \x00 ".join(t.lower().replace("\x00", " ") for t in texts)
    points = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.cumsum(points == 0, dtype=np.int64)
    found = letter_table()[points]
    keep = np.ones(len(found), dtype=bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    return found[keep], owner[keep]


def trigrams(found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each trigram starts in the symbols, and its text; none spans two texts."""
    at = np.arange(max(0, len(found) - 2))
    middle = found[1:-1] != 0
    keep = middle | ((owner[:-2] == owner[2:]) & (found[:-2] != 0) & (found[2:] != 0))
    at = at[keep]
    return at, np.where(middle[keep], owner[at + 1], owner[at])


def codes(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each trigram: its three code points."""
    a, b, c = (found[at + k].astype(np.int64) for k in range(3))
    return (a << 42) | (b << 21) | c


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # trigrams seen in training, sorted
    dots: np.ndarray  # their dot products with each unit prototype, over sqrt(DIMENSIONS)

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cosine with every prototype for each text, and whether it has a letter."""
        n = len(texts)
        found, owner = symbols(texts)
        has = np.bincount(owner[found != 0], minlength=n) > 0
        at, text = trigrams(found, owner)
        distinct, which = np.unique(codes(found, at), return_inverse=True)
        pairs, counts = np.unique(text * len(distinct) + which, return_counts=True)
        text, which = np.divmod(pairs, max(1, len(distinct)))
        length = np.sqrt(np.bincount(text, weights=counts.astype(float) ** 2, minlength=n))
        row = np.minimum(np.searchsorted(self.codes, distinct), len(self.codes) - 1)
        seen = (self.codes[row] == distinct)[which]
        text, row, counts = text[seen], row[which[seen]], counts[seen]
        sums = [np.bincount(text, weights=counts * self.dots[row, k], minlength=n) for k in range(len(self.languages))]
        return np.stack(sums, axis=1) / np.maximum(length, 1e-12)[:, None], has


def letter_vectors(points: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The vector of each code point, the same wherever it is drawn."""
    draw = lambda p: np.random.default_rng([seed, p]).choice(np.array([-1, 1], dtype=np.int8), size=dimensions)
    return np.stack([draw(int(p)) for p in points]) if len(points) else np.empty((0, dimensions), dtype=np.int8)


def bind(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Trigram vectors: the letters' vectors permuted twice, once and not at all, multiplied."""
    return np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c


def build(langs: np.ndarray, keys: np.ndarray, n: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 11) -> Model:
    """Model from the language, trigram number and count of each row."""
    languages, lang = np.unique(np.asarray(langs, dtype=str), return_inverse=True)
    seen, row = np.unique(keys, return_inverse=True)
    if not len(languages):
        return Model([], np.array([-1]), np.zeros((1, 0), dtype=np.float32))
    counts = np.zeros((len(languages), len(seen)))
    np.add.at(counts, (lang, row), n)
    mask = (1 << 21) - 1
    points, place = np.unique(np.stack([seen >> 42, seen >> 21 & mask, seen & mask]), return_inverse=True)
    vectors = letter_vectors(points, dimensions, seed)
    place = place.reshape(3, -1)
    blocks = [slice(i, i + 256) for i in range(0, len(seen), 256)]
    trigram = lambda s: bind(*(vectors[p[s]] for p in place)).astype(np.float32)
    prototypes = sum(counts[:, s] @ trigram(s) for s in blocks)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    dots = np.concatenate([trigram(s) @ prototypes.T for s in blocks]) / np.sqrt(dimensions)
    return Model(languages.tolist(), seen, dots.astype(np.float32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", limit=SLICE):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        found, owner = symbols(texts_of(batch, "text").to_pylist())
        at, text = trigrams(found, owner)
        for lang in sorted(set(langs)):
            keys, counts = np.unique(codes(found, at[langs[text] == lang]), return_counts=True)
            yield pa.record_batch(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())],
                names=["lang", "key", "n"],
            )


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn prototypes from at most ``per_language`` labelled documents of each language.

    What reaches the driver is one row for each language and letter trigram of the sample.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("key").isNotNull())
    counted = sampled(rows, "lang", "key", per_language).select("lang", "text")
    counted = counted.mapInArrow(tidy(_count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    return build(*(found.column(c).to_numpy() for c in ("lang", "key", "n")))


def predict(docs: DataFrame, model: Model, *keep: Column, text: str = "text") -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and ``cosine`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias("_text"))
    names = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        languages = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in slices(batches, "_text", limit=SLICE):
            n = batch.num_rows
            if m.languages:
                cosine, has = m.cosines(texts_of(batch, "_text").to_pylist())
                best = np.where(has, cosine.argmax(axis=1), len(languages) - 1)
                top = cosine.max(axis=1)
                score = np.where(has, 1 / np.exp(SHARPNESS * (cosine - top[:, None])).sum(axis=1), 0.0)
                top = np.where(has, np.clip(top, 0, 1), 0.0)
            else:
                best, score, top = np.zeros(n, dtype=int), np.zeros(n), np.zeros(n)
            extra = [pa.array(languages[best], pa.string()), pa.array(score, pa.float64()), pa.array(top, pa.float64())]
            yield pa.record_batch([*(batch.column(c) for c in names), *extra], names=[*names, "lang_pred", "score", "cosine"])

    return source.mapInArrow(tidy(run), columns_ddl(source.schema.fields[:-1], "lang_pred string, score double, cosine double"))
