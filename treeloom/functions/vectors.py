"""Embeddings and similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deterministic_embedding(text: Column, dimension: int = 8) -> Column:
    """The vector of a text made of the bytes of its SHA-256, scaled to -1..1 and repeated to the dimension."""
    if dimension <= 0:
        raise ValueError("the dimension must be positive")
    h = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / F.lit(255.0) * F.lit(2.0) - F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0, an error where lengths differ, null where a side is."""
    d = "double"
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast(d) * q.cast(d)), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions"))).otherwise(value)
