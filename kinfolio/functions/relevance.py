"""Similarity of vectors and explainable hybrid relevance as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the four signals.
WEIGHTS = {"semantic": 0.65, "tag_overlap": 0.20, "same_list": 0.10, "same_language": 0.05}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_raw(a: Column, b: Column) -> Column:
    """Plain cosine; 0 for a null, vectors of different length, or a zero vector."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNotNull() & b.isNotNull() & fits & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine clipped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine_raw(a, b)))


def l2_normalized(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    # Handed to the lambda as a variable: an expression would be added up again for each value.
    over = lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), over), F.lit(0))


def same(a: Column, b: Column) -> Column:
    """1 if both are present, not empty and equal, else 0."""
    return F.when((a == b) & (a.cast("string") != ""), 1.0).otherwise(0.0)


def score(semantic: Column, tags: Column, same_list: Column, same_language: Column) -> Column:
    """Weighted relevance, clipped to 0..1."""
    w = WEIGHTS
    total = w["semantic"] * semantic + w["tag_overlap"] * tags + w["same_list"] * same_list + w["same_language"] * same_language
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def reasons(semantic: Column, tags: Column, same_list: Column, same_language: Column) -> Column:
    """Short labels of the signals that speak for a pair."""
    meaning = F.when(semantic >= 0.78, "semantic:very-high").when(semantic >= 0.65, "semantic:high").when(semantic >= 0.5, "semantic:medium")
    overlap = F.when(tags >= 0.45, "tags:high-overlap").when(tags > 0, "tags:overlap")
    return F.array_compact(F.array(meaning, overlap, F.when(same_list > 0, "same-star-list"), F.when(same_language > 0, "same-language")))
