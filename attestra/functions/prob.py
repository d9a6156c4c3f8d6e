"""Column expressions over probabilities. Distributions are never repaired: what is invalid is named, not changed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-15
TOLERANCE = 1e-6


def distribution_error(dist: Column, labels: list[str], tolerance: float = TOLERANCE) -> Column:
    """What is wrong with a label to probability map: missing, keys, range, sum; null if nothing is."""
    values = F.map_values(dist)
    total = F.aggregate(values, F.lit(0.0), lambda s, p: s + p)
    bad = F.exists(values, lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
    return (
        F.when(dist.isNull(), "missing")
        .when(F.sort_array(F.map_keys(dist)) != F.array(*[F.lit(x) for x in sorted(labels)]), "keys")
        .when(bad, "range")
        .when(F.abs(total - 1) > tolerance, "sum")
    )


def brier(dist: Column, gold: Column, labels: list[str]) -> Column:
    """Sum over all labels of the squared error, from 0 to 2."""
    out = F.lit(0.0)
    for label in labels:
        out = out + F.pow(dist[label] - F.when(gold == label, 1.0).otherwise(0.0), 2)
    return out


def log_loss(dist: Column, gold: Column) -> Column:
    """Negative log of the gold label's probability, clipped at 1e-15."""
    return -F.log(F.greatest(F.try_element_at(dist, gold), F.lit(CLIP)))


def argmax_label(dist: Column, labels: list[str]) -> Column:
    """The most probable label; of equally probable ones the first in label order."""
    top = F.greatest(*[dist[x] for x in labels])
    out = F.lit(None).cast("string")
    for label in reversed(labels):
        out = F.when(dist[label] == top, label).otherwise(out)
    return out


def tempered(p: Column, temperature: Column | float) -> Column:
    """A binary probability after temperature scaling of its logits (probabilities clipped at 1e-15)."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    a, b = F.log(F.greatest(p, F.lit(CLIP))) / t, F.log(F.greatest(1 - p, F.lit(CLIP))) / t
    return 1 / (1 + F.exp(b - a))


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded; null where b is 0 or null."""
    return F.when(b != 0, F.round(a.cast("double") / b.cast("double"), digits))


def hash_bucket(key: Column, modulus: int) -> Column:
    """The first eight hexadecimal digits of the SHA-256 of a key, modulo `modulus`."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % modulus).cast("bigint")


def transformed(p: Column, temperature: float, weight: float = 1.0, bias: float = 0.0) -> Column:
    """A binary probability after temperature and bias on the positive logit, mixed with the original by `weight`; unchanged at
    temperature 1 without bias, and at weight 0."""
    if weight == 0 or (temperature == 1 and bias == 0):
        return p
    a, b = F.log(F.greatest(p, F.lit(CLIP))) / temperature + bias, F.log(F.greatest(1 - p, F.lit(CLIP))) / temperature
    return (1 - weight) * p + weight / (1 + F.exp(b - a))


def softmax(values: Column) -> Column:
    """Softmax of an array, stable by its greatest value."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Whether two numbers are equal within an absolute or relative tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))


def sigmoid(x: Column) -> Column:
    """The logistic function, in the form that doesn't overflow for either sign."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
