"""Vector functions over array columns: sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import col, let


def dot(a, b) -> Column:
    """Over the shorter length."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(col(v), lambda x: (x / n).cast("float"))).otherwise(col(v))


def project(v, dimensions: int, renormalize: bool = True) -> Column:
    """The first ``dimensions`` components; it's an error if there are fewer, or none asked for."""
    if dimensions < 1:
        raise ValueError("an output of no dimensions")
    v = col(v)
    short = F.slice(v, 1, dimensions)
    cut = F.when(F.size(v) > dimensions, normalize(short) if renormalize else short).otherwise(v)
    return F.when(F.size(v) < dimensions, F.raise_error(F.lit(f"a vector is narrower than {dimensions}"))).otherwise(cut)


def is_finite(v) -> Column:
    return F.forall(col(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def hash_bucket(token, dimensions: int) -> Column:
    """The first eight bytes of the token's SHA-256, little-endian, modulo ``dimensions``."""

    def total(h: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for i in range(8):
            out = out + F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("bigint") * pow(256, i, dimensions)
        return (out % dimensions).cast("int")

    return let(F.sha2(col(token), 256), total)


def rerank_probability(yes, no) -> Column:
    """Two-way softmax of the logits for yes and no."""
    return 1 / (1 + F.exp(col(no) - col(yes)))
