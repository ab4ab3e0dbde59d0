"""Token vectors of field names and concept texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct lowercase tokens, the empty one at either end included."""
    return F.array_distinct(F.split(F.lower(text), r"[\s_\-./]+"))


def hash_bucket(token: Column, size: int) -> Column:
    """md5 of the token as a 128-bit number, modulo ``size``, in steps of 32 bits."""
    digest, step = F.md5(token), (1 << 32) % size
    out = F.lit(0).cast("bigint")
    for part in range(4):
        word = F.conv(F.substring(digest, part * 8 + 1, 8), 16, 10).cast("bigint")
        out = (out * step + word) % size
    return out


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if either vector is zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)

    def dot(p: Column, q: Column) -> Column:
        products = F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0))
