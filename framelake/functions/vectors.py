"""Vector arithmetic on array columns, and the deterministic hash encoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalized(v: Column) -> Column:
    return bound(F.struct(v.alias("v"), norm(v).alias("n")), lambda s: F.transform(s["v"], lambda x: x / s["n"]))


def hash_vector(value: Column, namespace: str, dimension: int, version: str = "0.1") -> Column:
    """Unit vector of floats from SHA-256 blocks of `namespace|value|version` and a counter; no meaning, only stability.

    Each four bytes are a little-endian unsigned integer, scaled to -1..1; the vector is scaled to length 1.
    """
    if dimension <= 0:
        raise ValueError("a vector needs at least one dimension")
    seed = F.encode(F.concat(F.lit(f"{namespace}|"), value, F.lit(f"|{version}")), "UTF-8")
    blocks = F.concat(*(F.sha2(F.concat(seed, F.unhex(F.lit(f"{k:08x}"))), 256) for k in range(-(-dimension // 8))))

    def number(digits: Column, k: Column) -> Column:
        word = F.substr(digits, k * 8 + 1, F.lit(8))
        swapped = F.concat(*(F.substr(word, F.lit(7 - 2 * j), F.lit(2)) for j in range(4)))
        return F.conv(swapped, 16, 10).cast("double") / F.lit(4294967295.0) * 2.0 - 1.0

    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    raw = bound(blocks, lambda digits: F.transform(places, lambda k: number(digits, k)))
    return bound(raw, lambda v: F.transform(normalized(v), lambda x: x.cast("float")))
