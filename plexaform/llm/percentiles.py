"""Exact percentiles of very large columns by radix selection, and mergeable daily states with bounded error.

Values are mapped to 64-bit integers of the same order. The first pass counts the leading 20 bits (sign, exponent and
8 bits of mantissa) per group and day; those counts are the mergeable state: days add up by adding counts, and a
percentile read from them is off by at most 2^-9 of its value plus 2^-1030. Two more passes follow only the digits that
hold a wanted rank, 22 bits each, down to the exact value. Counts are combined on the map side before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..session import Scratch

DIGITS = (44, 22, 0)
#: bound of the error of a percentile read from daily states: STATE_ERROR x percentile + STATE_FLOOR
STATE_ERROR = 2.0 ** -9
STATE_FLOOR = 2.0 ** -1030
#: Digits to follow (of the whole, or of all days) that are sent to every task; more of them are joined by a shuffle.
SENT_DIGITS = 10_000
_ALL = "0001-01-01"
_MANTISSA = 1 << 52


def _power(e: Column) -> Column:
    """2 to a whole number, exactly."""
    return F.pow(F.lit(2.0), e.cast("double"))


def with_order_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with ``out``, a bigint that orders as the double ``value`` does (-0.0 with 0.0), in plain arithmetic.

    The exponent is the logarithm, put right by one where rounding misled it; the mantissa is the value over that power of
    two, both exact. Values below 2^-1022 are multiples of 2^-1074."""
    df = df.withColumn("__abs", F.abs(value))
    df = df.withColumn("__e0", F.greatest(F.floor(F.log2("__abs")), F.lit(-1022)))
    df = df.withColumn("__e", F.least(F.col("__e0") + F.when(F.col("__abs") < _power(F.col("__e0")), -1).when(F.col("__abs") >= _power(F.col("__e0") + 1), 1).otherwise(0), F.lit(1023)))
    small = F.col("__abs") < 2.0 ** -1022
    bits = F.when(small, (F.col("__abs") * 2.0 ** 537 * 2.0 ** 537).cast("bigint")).otherwise(
        (F.col("__e") + 1023) * _MANTISSA + ((F.col("__abs") / _power(F.col("__e")) - 1) * float(_MANTISSA)).cast("bigint"))
    df = df.withColumn("__bits", bits)
    return df.withColumn(out, F.when(F.col(value) < 0, -1 - F.col("__bits")).otherwise(F.col("__bits"))).drop("__abs", "__e0", "__e", "__bits")


def from_bits(key: Column) -> Column:
    """The double of an order key."""
    def value(k: Column) -> Column:
        e, m = F.shiftright(k, 52), k.bitwiseAND(F.lit(_MANTISSA - 1)).cast("double")
        # a power of two below 2^-1022 would lose digits, so the smallest numbers are scaled in two steps
        return F.when(e == 0, m * 2.0 ** -537 * 2.0 ** -537).otherwise((m / float(_MANTISSA) + 1) * _power(e - 1023))
    return bound(F.when(key >= 0, key).otherwise(-1 - key), lambda k: value(k)) * F.when(key >= 0, 1.0).otherwise(-1.0)


def valid_number(value: Column) -> Column:
    """The value as double; NULL for NULL, NaN, infinite and negative ones."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (v >= 0) & (v < float("inf")), v)


def daily_states(values: DataFrame) -> DataFrame:
    """values: grp, day, bits -> grp, day, digit, n. States of further days, or of the same day, add up by adding n."""
    return values.groupBy("grp", "day", F.shiftright("bits", DIGITS[0]).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def merged_states(states: DataFrame) -> DataFrame:
    """The states of all days as one, under the day 0001-01-01."""
    return states.groupBy("grp", F.lit(_ALL).cast("date").alias("day"), "digit").agg(F.sum("n").alias("n"))


def _locate(counts: DataFrame, targets: DataFrame | None, permille: list[int], within: list[str]) -> DataFrame:
    """The digit that holds each wanted rank, and the rank that is left inside it."""
    upto = Window.partitionBy(*within).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
    if targets is None:
        whole = Window.partitionBy(*within)
        run = run.withColumn("total", F.sum("n").over(whole)).withColumn("q", F.explode(F.array(*[F.lit(p) for p in permille])))
        # nearest rank: the smallest rank r with r >= q/1000 * total
        run = run.withColumn("rank", F.greatest(F.lit(1), F.floor((F.col("total") * F.col("q") + 999) / 1000)).cast("bigint"))
        hit = run
    else:
        t = targets.select(*[F.col(c).alias(f"t_{c}") for c in within], "total", "q", "rank")
        on = run[within[0]].eqNullSafe(t[f"t_{within[0]}"])
        for c in within[1:]:
            on = on & run[c].eqNullSafe(t[f"t_{c}"])
        hit = run.join(t.hint("merge"), on)
    hit = hit.where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto")))
    return hit.select("grp", "day", "digit", "total", "q", (F.col("rank") - F.col("before")).alias("rank"))


def records_once(df: DataFrame, group: Column, day: Column, value: Column, record: list[Column]) -> DataFrame:
    """grp, day, bits of every valid value. Deliveries that agree in ``record``, group, day and value count once.

    A row with a NULL in its ``record`` can't be told from others and counts for itself."""
    unknown = F.lit(False)
    for c in record:
        unknown = unknown | c.isNull()
    own = F.when(unknown, F.monotonically_increasing_id())
    base = df.select(group.alias("grp"), day.cast("date").alias("day"), valid_number(value).alias("v"), own.alias("own"), *[c.alias(f"r{i}") for i, c in enumerate(record)])
    once = base.where("v is not null").distinct()
    return with_order_bits(once.select("grp", "day", "v"), "v", "bits").select("grp", "day", "bits")


def _followed(rows: DataFrame, wanted: DataFrame, above: int, few: bool) -> DataFrame:
    """The rows (grp, day, bits) that lie in a wanted digit (wg, wd, w) of their group and day; no day is NULL.

    A few wanted digits are sent to every task; more are joined by a shuffle on (grp, day, digit)."""
    on = rows.grp.eqNullSafe(wanted.wg) & (rows.day == wanted.wd) & (F.shiftright(rows.bits, above) == wanted.w)
    return rows.join(F.broadcast(wanted) if few else wanted.hint("merge"), on, "left_semi")


def radix_percentiles(df: DataFrame, group: Column, day: Column, value: Column, record: list[Column], permille: list[int]) -> DataFrame:
    """Columns grp, day (NULL: all days), n, q (per mille), value: exact percentiles by nearest rank.

    A record delivered again (same ``record`` columns, group, day and value) counts once, a row without a whole record id
    for itself; invalid values (NULL, NaN, infinite, negative) are left out; a group or day without valid values gives no
    rows; values without a day count in the whole only; NULL is a group of its own. Ties share their rank range. An empty
    table gives no rows.
    """
    return percentiles_of(records_once(df, group, day, value, record), permille)


def percentiles_of(values: DataFrame, permille: list[int]) -> DataFrame:
    """The same from values: grp (of any type), day, bits, as ``records_once`` gives them; several sources may go through together."""
    tmp = Scratch(values.sparkSession)
    values = tmp.keep(values)
    states = tmp.keep(daily_states(values))
    whole = F.lit(_ALL).cast("date")
    # the whole has one set of digits a group, the days many; so rows are followed apart and counted together
    once, daily = values.select("grp", whole.alias("day"), "bits"), values.where("day is not null")
    targets = tmp.keep(_locate(merged_states(states).unionByName(states.where("day is not null")), None, permille, ["grp", "day"]))
    for above, shift in zip(DIGITS, DIGITS[1:]):
        wanted = targets.select(F.col("grp").alias("wg"), F.col("day").alias("wd"), F.col("digit").alias("w")).distinct()
        sizes = dict(wanted.groupBy((F.col("wd") == whole).alias("k")).count().collect())
        few = lambda k: sizes.get(k, 0) <= SENT_DIGITS  # noqa: B023, E731
        rows = tmp.keep(_followed(once, wanted.where(F.col("wd") == whole), above, few(True)).unionByName(_followed(daily, wanted.where(F.col("wd") != whole), above, few(False))))
        at = rows.groupBy("grp", "day", F.shiftright("bits", above).alias("above"), F.shiftright("bits", shift).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        targets = tmp.keep(_locate(at, targets.withColumn("above", F.col("digit")).drop("digit"), permille, ["grp", "day", "above"]))
        once, daily = rows.where(F.col("day") == whole), rows.where(F.col("day") != whole)
    return targets.select("grp", F.when(F.col("day") != whole, F.col("day")).alias("day"), F.col("total").alias("n"), "q", from_bits(F.col("digit")).alias("value"))


def state_percentiles(states: DataFrame, permille: list[int]) -> DataFrame:
    """Columns grp, day, n, q, value read from states alone: within ``STATE_ERROR`` of the exact value, relatively, or
    within ``STATE_FLOOR`` of it. The lowest digit holds zero and is read as zero."""
    at = _locate(states, None, permille, ["grp", "day"])
    low = from_bits(F.shiftleft("digit", DIGITS[0]))
    high = from_bits(F.shiftleft(F.col("digit") + 1, DIGITS[0]))
    middle = F.when(F.col("digit").isin(0, -1), F.lit(0.0)).otherwise(low / 2 + high / 2)
    return at.select("grp", "day", F.col("total").alias("n"), "q", middle.alias("value"))
