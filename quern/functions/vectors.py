"""Vector functions and the hashing encoder as columns (EMB-3..6, 8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors; 0 for empty vectors or different sizes."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b)).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    return let(v, lambda u: let(norm(u), lambda size: F.transform(u, lambda x: x.cast("double") / F.when(size > 0, size).otherwise(F.lit(1.0)))))


def mean_pooled(vectors: Column) -> Column:
    """Mean of an array of vectors at unit length."""
    total = F.aggregate(vectors, F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return normalised(F.transform(total, lambda x: x / F.size(vectors)))


def extended(v: Column, component: Column) -> Column:
    """A vector with one more component."""
    return F.concat(F.transform(v, lambda x: x.cast("double")), F.array(component.cast("double")))


def hashed_vector(text: Column, dim: int = 32) -> Column:
    """Counts of lower-cased words by hash bucket, at unit length: an encoder that needs no model."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    bucket = F.transform(words, lambda t: F.conv(F.right(F.md5(t), F.lit(2)), 16, 10).cast("int") % dim)
    counts = let(bucket, lambda have: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(have, lambda b: b == i)).cast("double")))
    return normalised(counts)
