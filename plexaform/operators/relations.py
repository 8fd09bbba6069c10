"""Joins by meaning: integrity, dedup, delta, nearest, as-of, motifs and pair forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose non-NULL key is no key of ``parent``."""
    keys = parent.select(F.col(parent_key).alias("__k")).distinct()
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("__k"), "left_anti")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the order given; a struct minimum combines on the map side, unlike a window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in [*order, *rest]])


def record_delta(before: DataFrame, after: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """key, change: added, removed or changed (payloads differ, NULLs being equal)."""
    b = before.select(F.col(key).alias("bk"), F.struct(*payload).alias("bp"))
    a = after.select(F.col(key).alias("ak"), F.struct(*payload).alias("ap"))
    both = a.join(b, F.col("ak") == F.col("bk"), "full_outer")
    change = F.when(F.col("bk").isNull(), "added").when(F.col("ak").isNull(), "removed").when(~F.col("ap").eqNullSafe(F.col("bp")), "changed")
    return both.select(F.coalesce("ak", "bk").alias(key), change.alias("change")).where("change is not null")


def two_hops(edges: DataFrame, src: str, dst: str) -> DataFrame:
    a = edges.select(F.col(src).alias("first"), F.col(dst).alias("middle"))
    b = edges.select(F.col(src).alias("__m"), F.col(dst).alias("last"))
    return a.join(b, F.col("middle") == F.col("__m")).select("first", "middle", "last")


def hazards(accesses: DataFrame, op: str, order: str, resource: str, writes: str) -> DataFrame:
    """Pairs earlier < later of operations on one resource of which at least one writes (distinct)."""
    a = accesses.select(F.col(op).alias("earlier"), F.col(order).alias("o1"), F.col(resource).alias("r1"), F.col(writes).alias("w1"))
    b = accesses.select(F.col(op).alias("later"), F.col(order).alias("o2"), F.col(resource).alias("r2"), F.col(writes).alias("w2"))
    return a.join(b, (F.col("r1") == F.col("r2")) & (F.col("o1") < F.col("o2")) & (F.col("w1") | F.col("w2"))).select("earlier", "later").distinct()


def latest_at_or_before(left: DataFrame, group: list[str], at: str, right: DataFrame, right_at: str, value: str, out: str, otherwise_first: bool = False) -> DataFrame:
    """As-of join: for each left row the right value with the largest key at or below the row's; NULL values don't count.

    Both sides are merged into one stream in the order (group, key), right before left, and the last right value is
    carried forward, so no pairs are formed. The stream is range-partitioned, so a large group spans several partitions:
    each partition carries values inside itself, and one row per (partition, group) carries them from one to the next.
    With ``otherwise_first`` rows before the first right key take the first right value instead of NULL."""
    from ..session import Scratch

    spark = left.sparkSession
    kind = right.schema[value].dataType
    l = left.select("*", F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__v"))
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields if f.name not in group]
    r = right.where(F.col(value).isNotNull()).select(*[F.col(g) for g in group], *extra, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = Scratch(spark).keep(l.unionByName(r).repartitionByRange(n, *group, "__at", "__side").withColumn("__pid", F.spark_partition_id()))
    inner = Window.partitionBy("__pid", *group).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    spans = merged.groupBy("__pid", *group).agg(F.max(F.when(F.col("__side") == 0, F.struct("__at", "__v"))).alias("__e"))
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col("__pid").alias("__p"), *[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.last("__e", ignorenulls=True).over(before)["__v"].alias("__c"))
    on = F.col("__pid") == F.col("__p")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    rows = merged.withColumn("__l", F.last("__v", ignorenulls=True).over(inner)).where("__side = 1").join(carried, on, "left")
    found = F.coalesce("__l", "__c")
    if otherwise_first:
        first = right.where(F.col(value).isNotNull()).groupBy(*[F.col(g).alias(f"__f{k}") for k, g in enumerate(group)]).agg(F.min_by(value, right_at).alias("__first"))
        same = F.lit(True)
        for k, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"__f{k}"))
        rows = rows.join(first, same, "left")
        found = F.coalesce(found, "__first")
    return rows.select(*[F.col(c) for c in left.columns if c != out], found.alias(out))


def nearest_sets(queries: DataFrame, qid: str, qset: str, base: DataFrame, bset: str, within: bool = False) -> DataFrame:
    """qid, distance: smallest Jaccard distance of each query's token set to any base set (1.0 where none shares a token).

    An inverted index on tokens finds the base sets that share one; sizes give the union, so sets are never compared
    outright and queries without a shared token take the default. Equal base sets are one with their number. ``within``: the
    queries are rows of the base, and a set that only the query itself has is not compared with it."""
    from ..session import Scratch

    tmp = Scratch(queries.sparkSession)
    sets = base.select(F.array_sort(F.array_distinct(bset)).alias("s")).where("size(s) > 0").groupBy("s").agg(F.count(F.lit(1)).alias("held"))
    sets = tmp.keep(sets.withColumn("b", F.monotonically_increasing_id()))
    q = tmp.keep(queries.select(F.col(qid).alias("q"), F.array_distinct(qset).alias("s")))
    bt = sets.select("b", "held", F.size("s").alias("nb"), F.explode("s").alias("t"))
    qt = q.select("q", F.size("s").alias("nq"), F.explode("s").alias("u"))
    shared = qt.join(bt, F.col("t") == F.col("u")).groupBy("q", "b").agg(F.count(F.lit(1)).alias("c"), F.first("nq").alias("nq"), F.first("nb").alias("nb"), F.first("held").alias("held"))
    if within:
        shared = shared.where(~((F.col("c") == F.col("nq")) & (F.col("c") == F.col("nb")) & (F.col("held") == 1)))
    best = shared.groupBy("q").agg(F.min(1.0 - F.col("c") / (F.col("nq") + F.col("nb") - F.col("c"))).alias("d"))
    return q.select(F.col("q").alias(qid)).join(best, F.col(qid) == F.col("q"), "left").select(qid, F.coalesce("d", F.lit(1.0)).alias("distance"))


def resolution(references: DataFrame, symbol: str, definitions: DataFrame, unit: str) -> DataFrame:
    """Each referenced symbol: unique, unresolved or ambiguous, with its defining units."""
    d = definitions.groupBy(F.col(symbol).alias("__s")).agg(F.array_sort(F.collect_set(unit)).alias("units"))
    r = references.select(symbol).distinct().join(d, F.col(symbol) == F.col("__s"), "left")
    n = F.coalesce(F.size("units"), F.lit(0))
    return r.select(symbol, F.when(n == 0, "unresolved").when(n == 1, "unique").otherwise("ambiguous").alias("status"), n.alias("definitions"))


def set_parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys of one table only (``lost`` from a, ``extra`` in b)."""
    x = a.select(F.col(key)).distinct().withColumn("__a", F.lit(True))
    y = b.select(F.col(key).alias("__k")).distinct()
    both = x.join(y, F.col(key) == F.col("__k"), "full_outer")
    return both.where(F.col("__k").isNull() | F.col(key).isNull()).select(F.coalesce(key, "__k").alias(key), F.when(F.col("__k").isNull(), "lost").otherwise("extra").alias("side"))


def owners(df: DataFrame, content: Column, order: str, key: str) -> DataFrame:
    """key, owner: the first record (by order, key) with the same content; compared by content, not by digest."""
    w = df.select(F.col(key), F.col(order).alias("__o"), content.alias("__c"))
    first = w.groupBy("__c").agg(F.min(F.struct(F.col("__o"), F.col(key).alias("k"))).alias("f")).select(F.col("__c").alias("__d"), F.col("f.k").alias("owner"))
    return w.join(first, F.col("__c").eqNullSafe(F.col("__d"))).select(key, "owner")


#: Rows of a skyline that are sent to all tasks at once.
SKYLINE_BLOCK = 50_000


def pareto(df: DataFrame, maximise: list[str], minimise: list[str], key: str) -> DataFrame:
    """Rows that no other row dominates (at least as good in all, better in one); equal rows all stay.

    Every partition first drops what its own rows dominate. The survivors are written, and then every survivor is compared
    with all of them, a block of at most about SKYLINE_BLOCK rows at a time, so no task holds more than its own rows and
    one block. Rows with a NULL or NaN objective are left out. ``key`` is kept for symmetry with the ranking operators."""
    import numpy as np
    import pandas as pd

    from ..session import Scratch

    spark = df.sparkSession
    cols = [*maximise, *minimise]
    signs = np.array([1.0] * len(maximise) + [-1.0] * len(minimise))

    def beaten(v: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = np.zeros(len(v), bool)
        for k, x in enumerate(v):
            out[k] = ((by >= x).all(1) & (by > x).any(1)).any()
        return out

    def skyline(batches):
        kept = None
        for pdf in batches:
            pdf = pdf.dropna(subset=cols)
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            if not len(pdf):
                continue
            v = pdf[cols].to_numpy(float) * signs
            front: list[int] = []
            block = np.empty((0, len(cols)))
            # in descending order only rows already kept can dominate the next one
            for k in np.lexsort(tuple(-v[:, c] for c in range(len(cols) - 1, -1, -1))):
                if not beaten(v[k:k + 1], block)[0]:
                    front.append(k)
                    block = np.vstack([block, v[k]])
            kept = pdf.iloc[sorted(front)].reset_index(drop=True)
        if kept is not None:
            yield kept

    local = Scratch(spark).keep(df.mapInPandas(skyline, df.schema))
    blocks = max(1, -(-local.count() // SKYLINE_BLOCK))
    out = local
    for b in range(blocks):
        part = local.where(F.pmod(F.xxhash64(*cols), F.lit(blocks)) == b).select(*cols).distinct().toPandas()
        state = spark.sparkContext.broadcast(part.to_numpy(float) * signs)

        def survive(batches, state=state):
            for pdf in batches:
                yield pdf[~beaten(pdf[cols].to_numpy(float) * signs, state.value)] if len(pdf) else pdf

        out = out.mapInPandas(survive, df.schema)
    return out
