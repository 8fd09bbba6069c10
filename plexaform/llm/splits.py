"""Splits that keep related records together, with totals as near the wanted shares as whole groups allow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.prefix import bucketed_prefix_sum
from ..session import Scratch

#: Runs of totals compared at a time; it bounds memory only, no result depends on it.
POOL = 1 << 22
#: Buckets of the order among components of one size, the same at every size, so that the order is too.
RANK_BUCKETS = 1 << 12


def linked_values(df: DataFrame, keys: dict[str, Column], tmp: Scratch) -> DataFrame:
    """Columns v, component: the values of all keys, joined wherever one record holds them together."""
    combos = tmp.keep(df.select(*[F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c)).alias(name) for name, c in keys.items()]).distinct())
    names = list(keys)
    hub = F.coalesce(*names[::-1])
    edges = combos.select(F.explode(F.array(*[F.struct(hub.alias("a"), F.col(n).alias("b")) for n in names])).alias("e")).select("e.a", "e.b")
    return connected_components(edges.where("b is not null"), "a", "b", tmp)


class _Totals:
    """The totals up to ``top`` that can be made, as sorted runs, and of each the first part that made it.

    Totals are laid out by their remainder by ``step``, then by size: total x stands at (x % step) * span + x // step. A
    size with many groups thus is one run and not as many totals, and every run is as long as ``copies`` of ``step`` allow."""

    def __init__(self, step: int, copies: int, top: int):
        self.step, self.top, self.span = step, top, top // step + 2
        self.low, self.high = np.array([0], np.int64), np.array([min(copies, top // step)], np.int64)
        self.parts: list[int] = []
        self.made = [(self.low, self.high)]

    def _place(self, total: int) -> int:
        return total % self.step * self.span + total // self.step

    def __contains__(self, total: int) -> bool:
        place = self._place(total)
        i = int(np.searchsorted(self.low, place, "right")) - 1
        return i >= 0 and place <= int(self.high[i])

    def add(self, part: int) -> None:
        """Every total may be made larger by ``part`` once."""
        rest, first = np.divmod(self.low, self.span)
        rest += part % self.step
        over = rest >= self.step
        rest -= self.step * over
        first += part // self.step + over
        last = np.minimum(first + (self.high - self.low), (self.top - rest) // self.step)
        fits = first <= last
        low, high = (rest * self.span + first)[fits], (rest * self.span + last)[fits]
        order = np.argsort(low, kind="stable")
        low, high = low[order], high[order]
        borders = np.sort(np.concatenate([self.low, low]))[::POOL].tolist() + [self.step * self.span]
        new, both = zip(*[_compared(self.low, self.high, low, high, *piece) for piece in zip(borders, borders[1:])])
        self.parts.append(part)
        self.made.append(_joined(new))
        self.low, self.high = _joined(both)

    def nearest(self, target: int) -> int:
        """Of two totals equally near, the smaller."""
        rest, first = np.divmod(self.low, self.span)
        last = first + (self.high - self.low)
        under = (target - rest) // self.step
        found = np.concatenate([np.clip(under, first, last) * self.step + rest, np.clip(under + 1, first, last) * self.step + rest])
        off = np.abs(found - target)
        return int(found[off == off.min()].min())

    def trace(self, total: int) -> tuple[list[int], int]:
        """The parts of a total, the largest that can be used first, and the number of groups of ``step``."""
        low = np.concatenate([m[0] for m in self.made])
        order = np.argsort(low)
        low, high = low[order], np.concatenate([m[1] for m in self.made])[order]
        label = np.repeat(np.arange(len(self.made)), [len(m[0]) for m in self.made])[order]
        used: list[int] = []
        for k in range(len(self.parts), 0, -1):
            rest = total - self.parts[k - 1]
            if rest < 0:
                continue
            place = self._place(rest)
            i = int(np.searchsorted(low, place, "right")) - 1
            if i >= 0 and place <= high[i] and label[i] < k:
                used.append(k - 1)
                total = rest
        return used, total // self.step


def _compared(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray, start: int, stop: int) -> tuple:
    """Of the places from ``start`` to before ``stop``: the runs of the second list alone, and those of both together."""
    at, change = [], []
    for a, b, by in ((low, high, 2), (low2, high2, 1)):
        i, j = int(np.searchsorted(b, start)), int(np.searchsorted(a, stop))
        at += [np.maximum(a[i:j], start), np.minimum(b[i:j], stop - 1) + 1]
        change += [np.full(j - i, by, np.int8), np.full(j - i, -by, np.int8)]
    places = np.concatenate(at)
    order = np.argsort(places, kind="stable")
    places = places[order]
    level = np.cumsum(np.concatenate(change)[order], dtype=np.int8)[:-1]
    begin, end = places[:-1], places[1:] - 1
    some = begin <= end
    new, both = some & (level == 1), some & (level > 0)
    return (begin[new], end[new]), (begin[both], end[both])


def _joined(pieces: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' runs in one list, runs that touch made one."""
    low, high = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
    if not len(low):
        return low, high
    apart = low[1:] > high[:-1] + 1
    return low[np.concatenate([[True], apart])], high[np.concatenate([apart, [True]])]


def closest_subset(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that the total comes as near ``target`` as it can.

    ``sizes``: size -> number of groups. One way at every size of the input, and no choice comes nearer: groups are taken
    largest first while they fit; if that leaves a gap, all totals of all groups are formed that could be nearer, smallest
    groups first, until the target is among them or all groups are in. A size with multiplicity m enters as groups of
    1, 2, 4, .. of that size, the most frequent size as a whole. Of two totals equally near, the smaller is taken; of several
    choices for a total, one with large groups. Totals are kept as runs (``_Totals``): at most about target / (multiplicity of
    the most frequent size) of them and as many as that size, and few where the small groups fill the space between the
    large. Sizes below 1 are ignored."""
    left = sorted((s, m) for s, m in sizes.items() if s > 0 and m > 0)
    chosen: dict[int, int] = {}
    gap = target
    for size, many in reversed(left):
        take = min(many, max(0, gap) // size)
        if take:
            chosen[size] = take
            gap -= size * take
    if gap <= 0 or chosen == dict(left):
        return chosen
    step, copies = max(left, key=lambda x: (x[1], -x[0]))
    totals = _Totals(step, copies, target + gap - 1)
    owner: list[tuple[int, int]] = []
    for size, many in left:
        part = 1
        while size != step and many > 0 and target not in totals:
            take = min(part, many)
            if size * take <= totals.top:
                totals.add(size * take)
                owner.append((size, take))
            many -= take
            part *= 2
    used, rest = totals.trace(totals.nearest(target))
    chosen = {step: rest} if rest else {}
    for k in used:
        size, take = owner[k]
        chosen[size] = chosen.get(size, 0) + take
    return chosen


def grouped_split(df: DataFrame, record: list[str], keys: dict[str, Column], shares: dict[str, float]) -> DataFrame:
    """Columns ``record``, component, split: one row per distinct record.

    Records that share a non-NULL value of any key, directly or through other records, come to the same split. The
    first name in ``shares`` takes what is left; the others get the subset of components whose record count is nearest
    to their share. Records without any value are components of their own. Record columns may be NULL (NULLs are equal).
    A component larger than a share simply can't be in it. An empty table gives no rows.

    Only the number of components of each size comes to the driver (at most about sqrt(2 x records) numbers).
    """
    spark = df.sparkSession
    tmp = Scratch(spark)
    component = linked_values(df, keys, tmp)
    names = list(keys)
    hub = F.coalesce(*[F.when(keys[n].isNotNull(), F.concat(F.lit(f"{n}="), keys[n])) for n in names[::-1]])
    own = F.concat_ws("\x00", F.lit("record"), *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in record])
    rows = df.select(*record, hub.alias("__hub"), own.alias("__own"))
    rows = rows.groupBy(*record).agg(F.max("__hub").alias("__hub"), F.first("__own").alias("__own"))
    labelled = rows.join(component, rows["__hub"] == component.v, "left").select(*record, F.coalesce("component", "__own").alias("component"))
    labelled = tmp.keep(labelled)
    sized = tmp.keep(labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    left = {r["n"]: r["m"] for r in sized.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
    total = sum(n * m for n, m in left.items())
    cuts: list[tuple[str, int, int, int]] = []
    used: dict[int, int] = {}
    first, *others = shares
    for name in others:
        chosen = closest_subset(left, round(shares[name] * total))
        for n, m in chosen.items():
            start = used.get(n, 0)
            cuts.append((name, n, start, start + m))
            used[n] = start + m
            left[n] -= m
    # the i-th component of its size, in a fixed order, decides
    ranked = bucketed_prefix_sum(sized.withColumn("one", F.lit(1)), ["n"], "component", "one", "rank", RANK_BUCKETS)
    table = spark.createDataFrame(cuts or [(first, -1, 0, 0)], "split string, size bigint, low bigint, high bigint")
    placed = ranked.join(F.broadcast(table), (ranked.n == table["size"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    placed = tmp.keep(placed.select(F.col("component").alias("c"), F.coalesce("split", F.lit(first)).alias("split")))
    return labelled.join(placed, labelled.component == placed.c).select(*record, "component", "split")
