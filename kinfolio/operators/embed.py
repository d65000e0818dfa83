"""Embedding of texts: a plug point for any embedder, and an offline default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed(rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 32) -> DataFrame:
    """``key, embedding`` by a callable over batches of texts; blank texts get a zero vector.

    It is an error if the callable returns another number of vectors than it got texts.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[list[float]] = []
            for at in range(0, len(pdf), batch):
                texts = [t or "" for t in pdf["text"].iloc[at : at + batch]]
                full = [t for t in texts if t.strip()]
                vectors = iter(embedder(full) if full else [])
                made = list(vectors)
                if len(made) != len(full):
                    raise ValueError(f"the embedder returned {len(made)} vectors for {len(full)} texts")
                found = iter(made)
                out.extend(next(found) if t.strip() else [0.0] * dimensions for t in texts)
            yield pd.DataFrame({key: pdf[key], "embedding": out})

    return rows.select(key, F.col(text).alias("text")).mapInPandas(run, f"`{key}` {kind}, embedding array<double>")


def embed_hashing(rows: DataFrame, key: str, text: str, dimensions: int) -> DataFrame:
    """Offline default: hashed word counts at unit length, all in the JVM."""
    source = rows.select(key, F.coalesce(text, F.lit("")).alias("_text"))
    tokens = Tokenizer(inputCol="_text", outputCol="_words").transform(source)
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions).transform(tokens)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    zero = F.array_repeat(F.lit(0.0), dimensions)
    return unit.select(key, F.when(F.trim("_text") == "", zero).otherwise(vector_to_array("_unit")).alias("embedding"))
