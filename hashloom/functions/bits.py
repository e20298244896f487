"""Column expressions on packed hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How the persisted text of a hash counts its length: bits, a list item a bit, a list item a byte.
RENDERINGS = ("bits", "list_bits", "list_bytes")


def differing_bits(a: Column, b: Column) -> Column:
    """Hamming distance of two arrays of 64-bit words; null if their lengths differ or either is null."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def hash_len(nbits: Column, rendering: str = "bits") -> Column:
    """Length that a hash of so many bits has in a rendering."""
    if rendering not in RENDERINGS:
        raise ValueError(f"rendering is one of {RENDERINGS}")
    return {"bits": nbits, "list_bits": nbits * 3, "list_bytes": (nbits / 8).cast("int") * 10}[rendering].cast("int")


def relative(distance: Column, length: Column) -> Column:
    """Distance as a 32-bit share of the length; null for length 0."""
    return F.try_divide(distance.cast("double"), length.cast("double")).cast("float")


def words_of(data: Column) -> Column:
    """Bytes to signed 64-bit words, most significant first; short ends are followed by zeros. Null stays null."""
    text = F.hex(data)
    count = F.ceil(F.length(text) / 16).cast("int")
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(F.rpad(F.substring(text, i * 16 + 1, F.lit(16)), 16, "0"), 16, -10).cast("bigint"))
    return F.when(data.isNotNull(), F.when(count > 0, each).otherwise(F.array().cast("array<bigint>")))


def bytes_of(words: Column, nbits: Column) -> Column:
    """The words' first nbits bits (whole bytes) as binary."""
    return F.unhex(F.left(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""), (nbits / 4).cast("int")))


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def bit_text(words: Column, nbits: Column) -> Column:
    """The hash as its bits, most significant first."""
    return F.left(F.array_join(F.transform(words, lambda w: F.lpad(F.bin(w), 64, "0")), ""), nbits)
