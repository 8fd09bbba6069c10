"""Reductions over elements, bytes and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound


def bytes_of(text: Column) -> Column:
    """array of the UTF-8 bytes of a text."""
    n = F.octet_length(text)
    values = bound(F.hex(F.encode(text, "UTF-8")), lambda h: F.transform(F.sequence(F.lit(1), n), lambda k: F.conv(F.substring(h, k * 2 - 1, F.lit(2)), 16, 10).cast("bigint")))
    return F.when(n > 0, values).when(n == 0, F.array().cast("array<bigint>"))


def count_byte(text: Column, needle: str) -> Column:
    """Occurrences of one ASCII byte: no byte of a longer UTF-8 sequence is below 128."""
    return F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))


def utf8_leading(text: Column) -> Column:
    """Bytes that begin a character: the number of characters of valid UTF-8."""
    return F.length(text)


def fnv1a(values: Column) -> Column:
    return F.aggregate(values, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295)))


def additive_checksum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda h, b: h + b).bitwiseAND(F.lit(4294967295))


def mixed_hash(v: Column) -> Column:
    """((v xor 0x9e3779b9) * 0x85ebca6b) mod 2^32, by 16-bit halves: the full product would pass 2^63."""
    x = v.bitwiseXOR(F.lit(0x9E3779B9)).bitwiseAND(F.lit(0xFFFFFFFF))
    k = 0x85EBCA6B
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return (low * k + F.shiftleft((high * k).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def pop_count(v: Column, bits: int) -> Column:
    """Set bits of the low ``bits`` bits: a negative narrow integer is not counted in its sign extension."""
    return F.bit_count(v.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1).cast("bigint")))


def runs(value: Column, window) -> Column:
    """1 where a run begins: its sum counts runs, so a non-empty sequence has one more than it has changes."""
    before = F.lag(value).over(window)
    return F.when(F.row_number().over(window) == 1, 1).when(~value.eqNullSafe(before), 1).otherwise(0)


def nearest_rank(value: str, q: float, default: float) -> Column:
    return F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})"), F.lit(default))


def upper_median(value: str) -> Column:
    """The element at n / 2 of the sorted values, counted from 0: neither the interpolated nor the lower median.

    Built on value counts, so equal values are one state each and no group is collected row by row."""
    return F.expr(f"percentile({value}, 0.5)")


def first_index(index: Column, holds: Column) -> Column:
    return F.coalesce(F.min(F.when(holds, index)), F.lit(-1))


def amdahl(share: Column, gain: Column) -> Column:
    return F.lit(1.0) / ((F.lit(1.0) - share) + share / gain)
