"""Operators on positioned sequences: compaction, deltas, scans, stencils, recurrences, gathers, extents, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..session import Scratch


# ---- compaction and deltas


def changed(current: DataFrame, baseline: DataFrame, index: str, value: str) -> DataFrame:
    """Columns index, value: the positions whose value differs from the baseline's, with the new value.

    Positions present on one side only don't take part. NULL differs from every value but NULL."""
    base = baseline.select(F.col(index).alias("__i"), F.col(value).alias("__b"))
    return current.join(base, F.col(index) == F.col("__i")).where(~F.col(value).eqNullSafe(F.col("__b"))).select(index, value)


def with_capacity(selected: DataFrame, index: str, capacity: int, mode: str, extent: DataFrame | None = None) -> DataFrame:
    """``selected`` under an output capacity.

    ``truncate`` keeps the first ``capacity`` positions; ``fail-unchanged`` gives no rows if more are selected;
    ``fail-input-extent-unchanged`` gives no rows if the input ``extent`` has more rows than the capacity, however few
    are selected. The count is a scalar subquery over the same rows, so nothing is emitted before it is known."""
    if mode == "truncate":
        return selected.orderBy(index).limit(capacity)
    if mode == "fail-unchanged":
        counted = selected
    elif mode == "fail-input-extent-unchanged" and extent is not None:
        counted = extent
    else:
        raise ValueError(f"unknown capacity mode: {mode}")
    return selected.where(counted.agg(F.count(F.lit(1))).scalar() <= F.lit(capacity))


def capacity_status(selected: DataFrame, capacity: int) -> DataFrame:
    """One row: selected, and status (the number selected, or -1 where it exceeds the capacity)."""
    n = F.count(F.lit(1))
    return selected.agg(n.alias("selected"), F.when(n <= capacity, n).otherwise(F.lit(-1).cast("bigint")).alias("status"))


def transduce(current: DataFrame, baseline: DataFrame, index: str, value: str, capacity: int, tmp: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(delta, next state). If the delta exceeds the capacity both stay as they were: no delta, and the baseline.

    Both come from one written join, so a failure between them can't leave one without the other."""
    tmp = tmp or Scratch(current.sparkSession)
    base = baseline.select(F.col(index).alias("__i"), F.col(value).alias("__b"))
    both = tmp.keep(base.join(current.select(index, value), F.col(index) == F.col("__i"), "left").select(F.col("__i").alias(index), "__b", F.coalesce(value, "__b").alias(value)))
    moved = ~F.col(value).eqNullSafe(F.col("__b"))
    fits = both.where(moved).agg(F.count(F.lit(1))).scalar() <= F.lit(capacity)
    delta = both.where(moved & fits).select(index, value)
    return delta, both.select(index, F.when(fits, F.col(value)).otherwise(F.col("__b")).alias(value))


def offsets_by_mask(df: DataFrame, index: str, mask: Column, width: int = 64) -> DataFrame:
    """Mask/prefix/scatter form of a compaction: each selected position with its output offset.

    Offsets are an exclusive prefix sum over blocks of ``width`` positions, then within the block."""
    marked = df.withColumn("__m", mask.cast("int")).withColumn("__blk", F.floor(F.col(index) / width))
    totals = marked.groupBy("__blk").agg(F.sum("__m").alias("__t"))
    base = global_prefix_sum(totals, ["__blk"], "__t", "__upto").select(F.col("__blk").alias("__b2"), (F.col("__upto") - F.col("__t")).alias("__base"))
    inner = Window.partitionBy("__blk").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("__l", F.coalesce(F.sum("__m").over(inner), F.lit(0)))
    return local.where("__m = 1").join(base, F.col("__blk") == F.col("__b2")).withColumn("offset", F.col("__base") + F.col("__l")).drop("__m", "__blk", "__b2", "__base", "__l")


# ---- fixed-width field codec


def pack_fields(fields: list[Column], widths: list[int], big_endian: bool = False) -> Column:
    """Fields masked to their widths and packed from the lowest bit up into one bigint bit pattern."""
    if sum(widths) > 64 or any(w < 1 for w in widths):
        raise ValueError("widths must be positive and sum to 64 at most")
    out, at = F.lit(0).cast("bigint"), 0
    for f, w in zip(fields, widths):
        mask = (1 << w) - 1 if w < 64 else -1
        out = out.bitwiseOR(F.shiftleft(f.cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")), at))
        at += w
    return byte_swap(out) if big_endian else out


def unpack_fields(word: Column, widths: list[int], big_endian: bool = False) -> list[Column]:
    word = byte_swap(word) if big_endian else word
    out, at = [], 0
    for w in widths:
        out.append(F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << w) - 1).cast("bigint")))
        at += w
    return out


def byte_swap(word: Column) -> Column:
    """The 8 bytes of a bigint in reverse order."""
    out = F.lit(0).cast("bigint")
    for k in range(8):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(word, 8 * k).bitwiseAND(F.lit(255).cast("bigint")), 56 - 8 * k))
    return out


# ---- scans and recurrences


def _ranged(df: DataFrame, order: list[str], tmp: Scratch) -> DataFrame:
    # enough partitions that none holds more than about a million rows
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // 1_000_000), 1)
    return tmp.keep(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()))


def global_prefix_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the inclusive prefix sum over one sequence of any length, ordered by unique ``order``.

    Two levels: rows are range-partitioned and summed per partition, the partition sums (one row per partition, so
    their broadcast is bounded) are scanned, and each partition adds its offset to a scan of its own."""
    tmp = Scratch(df.sparkSession)
    ranged = _ranged(df, order, tmp)
    totals = ranged.groupBy("__pid").agg(F.sum(value).alias("__t"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__pid").alias("__p"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    local = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = ranged.withColumn("__l", F.sum(value).over(local)).join(F.broadcast(offsets), F.col("__pid") == F.col("__p"))
    return done.withColumn(out, F.coalesce("__l", F.lit(0)) + F.col("__o")).drop("__pid", "__p", "__o", "__l")


def global_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with its 0-based position in the order of unique ``order``."""
    return global_prefix_sum(df.withColumn("__one", F.lit(1).cast("bigint")), order, "__one", "__n").withColumn(out, F.col("__n") - 1).drop("__one", "__n")


def running(seq: list[str], order: list[str]):
    return Window.partitionBy(*seq).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_max(value: str, window) -> Column:
    """Largest value so far; a NaN counts only as the first value, where it sticks, as with a strict > against it."""
    first = F.first(value).over(window)
    return F.when(F.isnan(first), first).otherwise(F.max(F.when(~F.isnan(F.col(value)), F.col(value))).over(window))


def affine_recurrence(values: Column, keep: float, take: float, start: float = 0.0) -> Column:
    """array -> y_n = keep * y_(n-1) + take * x_n, at the end of the array."""
    return F.aggregate(values, F.lit(start), lambda y, x: y * F.lit(keep) + x * F.lit(take))


#: Values of a recurrence taken at once.
BLOCK = 64


def long_recurrence(df: DataFrame, order: list[str], value: str, keep: float, take: float, out: str, seq: list[str] | None = None) -> DataFrame:
    """The same recurrence at every row, over sequences of any length (one, or one per ``seq``); from a NULL or NaN on a
    sequence is NULL.

    Rows are range-partitioned by (seq, order), so a long sequence spans several partitions. y is affine in the state
    before a block: each partition reports (a, b) with y_end = a * y_start + b of its last sequence, those compositions
    (one row per partition) are scanned, and every partition then runs from its start."""
    import numpy as np
    import pandas as pd

    seq = seq or []
    tmp = Scratch(df.sparkSession)
    ranged = _ranged(df, [*seq, *order], tmp)
    names = df.columns

    def parts(pdf: pd.DataFrame):
        pdf = pdf.sort_values([*seq, *order], kind="stable")
        return [(repr(k), g) for k, g in pdf.groupby(seq, sort=False, dropna=False)] if seq else [("", pdf)]

    # a block of values at a time: what its own values give is a product with a triangle of powers, and only the ends are chained
    powers = keep ** np.arange(BLOCK + 1, dtype=float)
    triangle = np.tril(powers[np.abs(np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK)))]).T * take

    def fold(pdf: pd.DataFrame, y: float) -> np.ndarray:
        x = pdf[value].to_numpy(float)
        if not np.isfinite(x).all():
            # undefined values stay with what follows them and must not reach back in their block
            out = np.empty(len(x))
            for k, v in enumerate(x.tolist()):
                out[k] = y = keep * y + take * v
            return out
        rows = -(-len(x) // BLOCK)
        own = np.pad(x, (0, rows * BLOCK - len(x))).reshape(rows, BLOCK) @ triangle
        begin = np.empty(rows)
        for k, end in enumerate(own[:, -1].tolist()):
            begin[k] = y
            y = end + powers[BLOCK] * y
        return (own + begin[:, None] * powers[1:]).ravel()[:len(x)]

    def ends(key, pdf):
        p = parts(pdf)
        ys = fold(p[-1][1], 0.0)
        return pd.DataFrame({"pid": [key[0]], "first": [p[0][0]], "last": [p[-1][0]], "a": [keep ** len(ys)], "b": [ys[-1]]})

    start: dict[int, float] = {}
    at, state = None, 0.0
    for r in sorted(ranged.groupBy("__pid").applyInPandas(ends, "pid int, first string, last string, a double, b double").collect(), key=lambda r: r["pid"]):
        start[r["pid"]] = state if r["first"] == at else 0.0
        end = float("nan") if r["b"] is None else r["b"]
        state = end + (r["a"] * start[r["pid"]] if r["first"] == r["last"] else 0.0)
        at = r["last"]

    def run(key, pdf):
        out_parts = []
        for n, (_, g) in enumerate(parts(pdf)):
            g = g.copy()
            g[out] = fold(g, start[key[0]] if n == 0 else 0.0)
            out_parts.append(g)
        return pd.concat(out_parts)[[*names, out]]

    schema = ranged.select(*names).withColumn(out, F.lit(None).cast("double")).schema
    return ranged.groupBy("__pid").applyInPandas(run, schema)


# ---- stencils and gathers


def stencil3(value: str, seq: list[str], order: list[str]) -> Column:
    """.25, .5, .25 of neighbours; the first and last value are copied."""
    w = Window.partitionBy(*seq).orderBy(*order)
    left, right, n, count = F.lag(value).over(w), F.lead(value).over(w), F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*seq))
    return F.when((n == 1) | (n == count), F.col(value)).otherwise(left * 0.25 + F.col(value) * 0.5 + right * 0.25)


def centred_average(value: str, seq: list[str], order: list[str], reach: int = 2) -> Column:
    """Mean of 2 * reach + 1 neighbours; ``reach`` values at each end are copied."""
    w = Window.partitionBy(*seq).orderBy(*order)
    terms = [F.lag(value, k).over(w) for k in range(reach, 0, -1)] + [F.col(value)] + [F.lead(value, k).over(w) for k in range(1, reach + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    n, count = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*seq))
    return F.when((n <= reach) | (n > count - reach), F.col(value)).otherwise(total * F.lit(1.0 / (2 * reach + 1)))


def strided_mix(df: DataFrame, index: str, value: str, stride: int, far: float, near: float, out: str) -> DataFrame:
    """``df`` with src[(stride * i) mod n] * far + src[i] * near; positions are 0..n-1."""
    n = df.agg(F.count(F.lit(1))).scalar()
    # the product is taken in decimal: it can pass 2^63
    at = F.pmod(F.col(index).cast("decimal(20,0)") * F.lit(stride), n.cast("decimal(20,0)")).cast("bigint")
    source = df.select(F.col(index).alias("__j"), F.col(value).alias("__s"))
    return df.withColumn("__at", at).join(source, F.col("__at") == F.col("__j")).withColumn(out, F.col("__s") * F.lit(far) + F.col(value) * F.lit(near)).drop("__at", "__j", "__s")


# ---- extents


def prefix_extent(df: DataFrame, seq: list[str], index: str, holds: Column) -> DataFrame:
    """Per sequence the length of the leading run that satisfies ``holds`` (NULL doesn't)."""
    bad = ~F.coalesce(holds, F.lit(False))
    return df.groupBy(*seq).agg(F.coalesce(F.min(F.when(bad, F.col(index))), F.count(F.lit(1))).alias("extent"))


def suffix_extent(df: DataFrame, seq: list[str], index: str, holds: Column) -> DataFrame:
    bad = ~F.coalesce(holds, F.lit(False))
    n = F.count(F.lit(1))
    return df.groupBy(*seq).agg(F.coalesce(n - 1 - F.max(F.when(bad, F.col(index))), n).alias("extent"))


def common_extent(a: DataFrame, b: DataFrame, seq: str, index: str, value: str) -> DataFrame:
    """Per sequence present in both: the length of the common prefix."""
    other = b.select(F.col(seq).alias("__s"), F.col(index).alias("__i"), F.col(value).alias("__v"))
    both = a.join(other, (F.col(seq) == F.col("__s")) & (F.col(index) == F.col("__i")))
    return prefix_extent(both, [seq], index, F.col(value) == F.col("__v"))


# ---- layouts


def interleave(payloads: Column, block: int) -> Column:
    """array of equally long binaries -> one binary: block 0 of each, then block 1 of each, and so on."""
    blocks = F.sequence(F.lit(0), (F.octet_length(payloads[0]) / block).cast("int") - 1)
    return bound(F.transform(payloads, lambda p: F.hex(p)), lambda hs: F.unhex(F.array_join(F.flatten(
        F.transform(blocks, lambda k: F.transform(hs, lambda h: F.substring(h, k * (2 * block) + 1, F.lit(2 * block))))), "")))


def deinterleave(packed: Column, siblings: int, block: int) -> Column:
    """The inverse: array of ``siblings`` binaries."""
    count = (F.octet_length(packed) / (block * siblings)).cast("int")
    return bound(F.hex(packed), lambda h: F.transform(F.sequence(F.lit(0), F.lit(siblings - 1)), lambda s: F.unhex(F.array_join(F.transform(
        F.sequence(F.lit(0), count - 1), lambda k: F.substring(h, (k * siblings + s) * (2 * block) + 1, F.lit(2 * block))), ""))))
