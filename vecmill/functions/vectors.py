"""Functions of vectors and metadata maps, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_id(key: Column) -> Column:
    """Identity of a vector: a hash of its elements' bit patterns, so 0.0 and -0.0 differ.

    Spark's hashes take the two zeros for equal, so the elements are hashed as text.
    """
    return F.xxhash64(F.array_join(F.transform(key.cast("array<float>"), lambda x: x.cast("string")), ","))


def l2_normalize(v: Column, epsilon: float = 0.0) -> Column:
    """Unit length; a zero vector stays as it is. ``epsilon`` is added to the norm, which then is never zero."""
    numbers = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x * x)) + epsilon
    return F.when(norm == 0, numbers).otherwise(F.transform(numbers, lambda x: F.try_divide(x, norm)))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set, element by element; zeros if none is.

    tokens: array of equally long vectors; mask: array of 0 and 1.
    """
    weighted = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m.cast("double")))
    total = F.aggregate(weighted, F.array().cast("array<double>"), lambda a,
        t: F.when(F.size(a) == 0, t).otherwise(F.zip_with(a, t, lambda p, q: p + q)))
    count = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double"))
    return F.transform(total, lambda x: x / F.greatest(count, F.lit(1e-9)))


def cls_pool(tokens: Column) -> Column:
    return F.get(tokens, F.lit(0))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    powers = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(powers, lambda p: p / total)


def merged(old: Column, new: Column) -> Column:
    """One map of both, entries of ``new`` winning; whatever the session's policy on repeated keys."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def map_bytes(m: Column) -> Column:
    """Bytes of a metadata map's keys and values."""
    return F.aggregate(F.map_entries(m), F.lit(0).cast("long"), lambda a,
        e: a + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]["str"]), F.octet_length(e["value"]["bin"]), F.lit(0)))
