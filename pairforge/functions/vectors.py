"""Vector functions over ARRAY columns, inside the JVM and in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(x: Column) -> Column:
    """Half-up rounding to six digits that DuckDB repeats exactly."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def dot(a: Column, b: Column) -> Column:
    """F32."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """F30; a zero vector becomes null."""
    n = F.nullif(norm(a), F.lit(0.0))
    return F.when(n.isNotNull(), F.transform(a, lambda x: x.cast("double") / n))


def euclidean(a: Column, b: Column) -> Column:
    """F31."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """F33; null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def max_sim(q: Column, d: Column) -> Column:
    """for each query vector the best document vector, summed."""
    best = F.transform(q, lambda s: F.array_max(F.transform(d, lambda t: dot(s, t))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    """F35."""
    return 1.0 / (1.0 + F.exp(-x))


def split_vector(a: Column, parts: int, size: int) -> Column:
    """A vector as `parts` vectors of `size`."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(a, i * size + 1, size))


def block_pool(vectors: Column, target: int) -> Column:
    """A multi-vector brought to `target` vectors: zero vectors before, then means of equal consecutive blocks.

    A number that `target` does not divide is first filled up with zero vectors on the left.
    """
    n = F.size(vectors)
    per = F.ceil(n / F.lit(target)).cast("int")
    zero = F.transform(vectors[0], lambda x: F.lit(0.0))
    full = F.concat(F.array_repeat(zero, per * target - n), F.transform(vectors, lambda v: F.transform(v, lambda x: x.cast("double"))))
    add = lambda s, v: F.zip_with(s, v, lambda x, y: x + y)
    block = lambda i: F.slice(full, i * per + 1, per)
    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.transform(F.aggregate(block(i), zero, add), lambda x: x / per))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is set; null if none is (F64 selects them)."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"]), lambda x: x["v"])
    zero = F.transform(vectors[0], lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))
