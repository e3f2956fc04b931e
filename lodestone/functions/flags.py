"""Chunk flags as column expressions: tests, labels and the way a chunk is decoded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import schema as S


def has(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) != 0


def is_compressed(flags: Column) -> Column:
    return has(flags, S.COMPRESSED)


def first_match(flags: Column, table: list[tuple[int, str]], otherwise: str) -> Column:
    """The label of the first mask that matches; flags may be null."""
    return F.coalesce(reduce(lambda c, x: c.when(has(flags, x[0]), x[1]), table[1:], F.when(has(flags, table[0][0]), table[0][1])), F.lit(otherwise))


#: The order in which a manifest looks for a method differs from the report's, and both from decoding's.
MANIFEST = [(S.ZLIB, "Zlib"), (S.BZIP, "Bzip"), (S.COPYCOMP, "Copy"), (S.ZERO, "Zero"), (S.MP3, "Mp3"), (S.JPEG, "Jpeg"), (S.LZMA, "Lzma"), (S.DZ, "Dz"), (S.COMBUF, "Combuf"), (S.RANDOMACCESS, "RandomAccess")]
REPORT = [(S.ZLIB, "Zlib"), (S.BZIP, "Bzip"), (S.LZMA, "LZMA"), (S.COPYCOMP, "Copy"), (S.ZERO, "Zero"), (S.DZ, "Dz")]


def manifest_method(first_flags: Column) -> Column:
    return first_match(first_flags, MANIFEST, "Dz")


def report_method(first_flags: Column) -> Column:
    return first_match(first_flags, REPORT, "Unknown")


def decode_route(flags: Column) -> Column:
    """zero, raw, zlib, bzip, lzma or unsupported, in the order in which a decoder asks."""
    return (
        F.when(has(flags, S.ZERO), "zero")
        .when(has(flags, S.COPYCOMP | S.MP3 | S.JPEG), "raw")
        .when(has(flags, S.RANDOMACCESS) & ~is_compressed(flags), "raw")
        .when(has(flags, S.ZLIB), "zlib")
        .when(has(flags, S.BZIP), "bzip")
        .when(has(flags, S.LZMA), "lzma")
        .otherwise("unsupported")
    )


def parse_method(name: Column) -> Column:
    """The method of a spelling in any case; null if there is none."""
    low = F.lower(name)
    return reduce(lambda c, x: c.when(low == x[0], x[1]), list(S.SPELLINGS.items())[1:], F.when(low == "dz", "Dz"))
