"""Quantised blocks: parsing, 6-bit scales, nibbles, dequantisation, dot products, repacking; 4x4 colour blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

#: fixed values: bytes of a block of 256 4-bit weights and of one of 256 8-bit activations
Q4_BYTES, Q8_BYTES = 144, 292


def _spans(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a batch, and per blob its start, its length and whether it is there."""
    blobs = blobs.cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset:blobs.offset + len(blobs) + 1]
    data = blobs.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets), ~np.asarray(blobs.is_null())


def _blocks(blobs: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which blobs have exactly ``width`` bytes, and those as the rows of a matrix."""
    data, starts, lengths, there = _spans(blobs)
    good = there & (lengths == width)
    return good, data[starts[good][:, None] + np.arange(width)]


def _lists(good: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list of int per blob from the rows of a matrix; NULL where a blob is not good."""
    offsets = np.r_[0, np.cumsum(np.where(good, values.shape[1], 0))].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values, np.int32).ravel()), mask=pa.array(~good))
    return lists


def _doubles(good: np.ndarray, values: np.ndarray) -> pa.Array:
    out = np.zeros(len(good))
    out[good] = values
    return pa.array(out, mask=~good)


def blob_bytes(raw: Column, start: int, count: int) -> Column:
    """array of ``count`` unsigned bytes from 0-based ``start``; fewer where the blob ends before, NULL for NULL.

    An Arrow batch at a time, on the batch's own buffer: there is no built-in expression from a binary to the array of its
    bytes."""
    @F.arrow_udf("array<int>")
    def cut(blobs: pa.Array) -> pa.Array:
        data, starts, lengths, there = _spans(blobs)
        part = np.where(there, np.clip(lengths - start, 0, count), 0)
        offsets = np.r_[0, np.cumsum(part)]
        at = np.repeat(starts + start - offsets[:-1], part) + np.arange(offsets[-1])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(data[at].astype(np.int32)), mask=pa.array(~there))
    return cut(raw)


def scale_min(packed: Column) -> tuple[Column, Column]:
    """12 packed bytes -> 8 scales and 8 minima of 6 bits: four plain ones, four with their high bits in the first eight."""
    def scales(b: Column) -> Column:
        return F.array(*[b[k].bitwiseAND(F.lit(63)) for k in range(4)], *[b[k + 8].bitwiseAND(F.lit(15)).bitwiseOR(F.shiftleft(F.shiftright(b[k], 6), 4)) for k in range(4)])

    def minima(b: Column) -> Column:
        return F.array(*[b[k + 4].bitwiseAND(F.lit(63)) for k in range(4)], *[F.shiftright(b[k + 8], 4).bitwiseOR(F.shiftleft(F.shiftright(b[k + 4], 6), 4)) for k in range(4)])
    return bound(packed, scales), bound(packed, minima)


def pack_scale_min(scales: Column, minima: Column) -> Column:
    """The inverse; a value outside 0..63 is an error."""
    ok = F.assert_true(F.forall(F.concat(scales, minima), lambda v: (v >= 0) & (v < 64)))
    first = [scales[k].bitwiseAND(F.lit(63)).bitwiseOR(F.shiftleft(F.shiftright(scales[k + 4], 4), 6)) for k in range(4)]
    second = [minima[k].bitwiseAND(F.lit(63)).bitwiseOR(F.shiftleft(F.shiftright(minima[k + 4], 4), 6)) for k in range(4)]
    third = [scales[k + 4].bitwiseAND(F.lit(15)).bitwiseOR(F.shiftleft(minima[k + 4].bitwiseAND(F.lit(15)), 4)) for k in range(4)]
    return F.when(ok.isNull(), F.array(*first, *second, *third))


def nibbles(quants: Column) -> Column:
    """128 bytes -> 256 values: of every 32 bytes first the low, then the high halves."""
    def values(q: Column) -> Column:
        def group(g: Column) -> Column:
            return bound(F.slice(q, g * 32 + 1, 32), lambda part: F.concat(F.transform(part, lambda b: b.bitwiseAND(F.lit(15))), F.transform(part, lambda b: F.shiftright(b, 4))))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), group))
    return bound(quants, values)


def unpacked(raw: Column, start: int) -> Column:
    """The 256 values of 128 bytes from ``start`` of a blob, as ``nibbles`` orders them, a batch at a time; NULL where the blob is NULL or
    ends before."""
    @F.arrow_udf("array<int>")
    def unpack(blobs: pa.Array) -> pa.Array:
        data, starts, lengths, there = _spans(blobs)
        good = there & (lengths >= start + 128)
        q = data[starts[good][:, None] + start + np.arange(128)].reshape(-1, 4, 1, 32)
        return _lists(good, np.concatenate([q & 15, q >> 4], 2).reshape(-1, 256))
    return unpack(raw)


def half_value(bits: Column) -> Column:
    """Value of a 16-bit float given by its bits: subnormal, normal, infinite or NaN."""
    s = F.when(bits.bitwiseAND(F.lit(0x8000)) != 0, -1.0).otherwise(1.0)
    e, m = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    return F.when(e == 0, s * m * F.lit(2.0**-24)).when((e == 31) & (m == 0), s * float("inf")).when(e == 31, F.lit(float("nan"))).otherwise(s * F.pow(F.lit(2.0), e - 15) * (1 + m / F.lit(1024.0)))


def parse_q4(raw: Column) -> Column:
    """struct d, dmin, scales, minima, quants; a block of another length, or NULL, gives NULLs."""
    @F.arrow_udf("d double, dmin double, scales array<int>, minima array<int>, quants array<int>")
    def parse(blobs: pa.Array) -> pa.Array:
        good, b = _blocks(blobs, Q4_BYTES)
        halves = np.ascontiguousarray(b[:, :4]).view("<f2").astype(float)
        low, high, mixed = b[:, 4:8], b[:, 8:12], b[:, 12:16]
        scales = np.concatenate([low & 63, (mixed & 15) | (low >> 6 << 4)], 1)
        minima = np.concatenate([high & 63, (mixed >> 4) | (high >> 6 << 4)], 1)
        q = b[:, 16:].reshape(len(b), 4, 1, 32)
        quants = np.concatenate([q & 15, q >> 4], 2).reshape(len(b), 256)
        return pa.StructArray.from_arrays([_doubles(good, halves[:, 0]), _doubles(good, halves[:, 1]), _lists(good, scales), _lists(good, minima), _lists(good, quants)], ["d", "dmin", "scales", "minima", "quants"])
    return parse(raw)


def dequantise_q4(d: Column, dmin: Column, scales: Column, minima: Column, quants: Column) -> Column:
    """d * scale * q - dmin * min, one scale and minimum for 32 values each."""
    return F.transform(quants, lambda q, i: d * scales[(i / 32).cast("int")] * q - dmin * minima[(i / 32).cast("int")])


def parse_q8(raw: Column) -> Column:
    """struct d, quants (256 int8), sums (16 int16); little endian. Another length, or NULL, gives NULLs."""
    @F.arrow_udf("d double, quants array<int>, sums array<int>")
    def parse(blobs: pa.Array) -> pa.Array:
        good, b = _blocks(blobs, Q8_BYTES)
        d = np.ascontiguousarray(b[:, :4]).view("<f4").astype(float)[:, 0]
        sums = np.ascontiguousarray(b[:, 260:]).view("<i2")
        return pa.StructArray.from_arrays([_doubles(good, d), _lists(good, b[:, 4:260].view(np.int8)), _lists(good, sums)], ["d", "quants", "sums"])
    return parse(raw)


def dot_q4_q8(w: Column, a: Column) -> Column:
    """Integer dot products per 32 values times the scales, less the minima times the activation sums."""
    groups = F.sequence(F.lit(0), F.lit(7))
    part = lambda g: F.aggregate(F.zip_with(F.slice(w.quants, g * 32 + 1, 32), F.slice(a.quants, g * 32 + 1, 32), lambda x, y: x.cast("bigint") * y), F.lit(0).cast("bigint"), lambda s, v: s + v)
    main = F.aggregate(F.transform(groups, lambda g: part(g) * w.scales[g]), F.lit(0).cast("bigint"), lambda s, v: s + v)
    less = F.aggregate(F.transform(groups, lambda g: (a.sums[g * 2] + a.sums[g * 2 + 1]).cast("bigint") * w.minima[g]), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return w.d * a.d * main - w.dmin * a.d * less


def rgb565(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(F.shiftright(r, 3), 11).bitwiseOR(F.shiftleft(F.shiftright(g, 2), 5)).bitwiseOR(F.shiftright(b, 3))


def expanded565(c: Column) -> list[Column]:
    r, g, b = F.shiftright(c, 11).bitwiseAND(F.lit(31)), F.shiftright(c, 5).bitwiseAND(F.lit(63)), c.bitwiseAND(F.lit(31))
    return [F.shiftleft(r, 3).bitwiseOR(F.shiftright(r, 2)), F.shiftleft(g, 2).bitwiseOR(F.shiftright(g, 4)), F.shiftleft(b, 3).bitwiseOR(F.shiftright(b, 2))]
