"""Vector functions over array columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products, in double precision."""
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 for vectors that are empty, of other lengths or of norm 0; null for null."""
    a, b = _c(a), _c(b)
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine(a, b)


def encode_vector(a: Column | str) -> Column:
    """``[v1,v2,…]``."""
    return F.concat(F.lit("["), F.array_join(_c(a), ","), F.lit("]"))


def decode_vector(s: Column | str) -> Column:
    return F.from_json(_c(s), "array<float>")


def normalized(a: Column | str) -> Column:
    """Unit length; vectors of norm up to 1e-12 stay as they are."""
    a = _c(a)
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a)


def hash_embed(text: Column | str, dim: int) -> Column:
    """A vector from the text's SHA-256 stream; null stays null.

    Block k is the digest of the text and k as a little-endian word; each
    little-endian word of the stream is scaled to [-1, 1].
    """
    raw = F.encode(_c(text), "UTF-8")
    blocks = -(-dim // 8)
    hexes = F.concat(*[F.sha2(F.concat(raw, F.unhex(F.lit(k.to_bytes(4, "little").hex()))), 256) for k in range(blocks)])
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    byte = lambda h, i: F.substring(h, i * 2 + 1, F.lit(2))

    def word(i: Column) -> Column:
        b = i * 4
        big = F.concat(byte(hexes, b + 3), byte(hexes, b + 2), byte(hexes, b + 1), byte(hexes, b))
        return (F.conv(big, 16, 10).cast("double") / F.lit(4294967295.0) * 2 - 1).cast("float")

    return F.when(_c(text).isNull(), F.lit(None)).otherwise(normalized(F.transform(at, word)))


def name_vector(name: Column | str) -> Column:
    """Eight sums of the lowered name's bytes by position modulo eight, of unit length."""
    raw = F.hex(F.encode(F.lower(_c(name)), "UTF-8"))
    n = F.length(raw) / 2
    byte = lambda i: F.conv(F.substring(raw, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("float")
    places = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.aggregate(F.filter(places, lambda i: i % 8 == k), F.lit(0.0), lambda s, i: s + byte(i)).cast("float"))
    return normalized(sums)
