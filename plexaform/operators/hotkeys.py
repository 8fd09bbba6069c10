"""Per-key results where a few keys hold most rows.

Each aggregate is algebraic: every task folds its rows into a hash table of mergeable key states (spilling when full),
and only those compact states are shuffled. A key that holds a third of all rows reaches the final task as one state
per map task, so no task sees more than (map tasks x keys of its bucket) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_states(df: DataFrame, key: Column, record: list[Column], maxima: dict[str, Column] | None = None,
                 sums: dict[str, Column] | None = None, means: dict[str, Column] | None = None) -> DataFrame:
    """Columns key, rows, records, then one for each of ``maxima``, ``sums`` and ``means``.

    ``records`` counts distinct records; a record delivered again (same ``record`` columns under the same key) counts
    once, also in sums and means. A row without record id can't be told from others and counts as a record of its own.
    NULL keys form one group with a NULL key. Sums and means over no known value are NULL. An empty table gives no
    rows. Only the named columns are read; further columns, also with clashing names, are ignored.

    The first stage groups by (key, record): record ids spread evenly, whatever the key's skew. The second groups by
    key over states already combined on the map side.
    """
    maxima, sums, means = maxima or {}, sums or {}, means or {}
    unknown = F.lit(False)
    for col in record:
        unknown = unknown | col.isNull()
    ids = [col.alias(f"__r{i}") for i, col in enumerate(record)]
    values = [F.max(col).alias(f"__v{i}") for i, col in enumerate([*maxima.values(), *sums.values(), *means.values()])]
    base = df.select(key.alias("key"), *ids, unknown.alias("__u"), *[col.alias(f"__c{i}") for i, col in enumerate([*maxima.values(), *sums.values(), *means.values()])])
    # a row without id keeps its place in the sort order as its identity
    base = base.withColumn("__own", F.when(F.col("__u"), F.monotonically_increasing_id()))
    n = len(values)
    once = base.groupBy("key", *[f"__r{i}" for i in range(len(ids))], "__own").agg(
        F.count(F.lit(1)).alias("__n"), *[F.max(f"__c{i}").alias(f"__v{i}") for i in range(n)])
    names = [*maxima, *sums, *means]
    folds = [F.max] * len(maxima) + [F.sum] * len(sums) + [F.avg] * len(means)
    return once.groupBy("key").agg(
        F.sum("__n").alias("rows"), F.count(F.lit(1)).alias("records"),
        *[fold(f"__v{i}").alias(name) for i, (fold, name) in enumerate(zip(folds, names))])


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Columns key, rows: the non-NULL values, as written, on at least ``share`` of all rows (repeats and NULLs count
    in the whole). Ties at the limit are in. An empty table gives no rows."""
    states = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return states.where(F.col("key").isNotNull() & (F.col("rows") >= F.lit(share) * total))
