"""Vector operators on arrays: normalisation, rotary embedding, block dot products, attention and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def residual_add(x: Column, r: Column) -> Column:
    return F.zip_with(x, r, lambda a, b: a + b)


def rms_scale(s: Column, epsilon: float) -> Column:
    squares = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + v * v)
    return F.lit(1.0) / F.sqrt(squares / F.size(s) + F.lit(epsilon))


def rms_quantised(s: Column, scale: Column, weight: Column) -> Column:
    """int8 by truncation of 127 y, clamped to +-127, with y = s * scale * w."""
    y = F.zip_with(s, weight, lambda v, w: v * scale * w * F.lit(127.0))
    return F.transform(y, lambda v: F.greatest(F.lit(-127), F.least(F.lit(127), v.cast("int"))))


def rope(v: Column, cos: Column, sin: Column) -> Column:
    """Rotation of the pairs (v0, v1), (v2, v3), .. ; an odd length or too few angles is an error."""
    ok = F.assert_true((F.size(v) % 2 == 0) & (F.size(cos) >= F.size(v) / 2) & (F.size(sin) >= F.size(v) / 2))
    turned = F.flatten(F.transform(F.sequence(F.lit(0), (F.size(v) / 2).cast("int") - 1), lambda k: F.array(
        v[k * 2] * cos[k] - v[k * 2 + 1] * sin[k], v[k * 2] * sin[k] + v[k * 2 + 1] * cos[k])))
    return F.when(ok.isNull(), turned)


def blocked_dot(w: Column, x: Column, scales: Column, block: int) -> Column:
    """Sum over blocks of (integer dot product) * scale of the block."""
    blocks = F.sequence(F.lit(0), F.size(scales) - 1)
    part = lambda b: F.aggregate(F.zip_with(F.slice(w, b * block + 1, block), F.slice(x, b * block + 1, block), lambda p, q: p * q), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return F.aggregate(F.transform(blocks, lambda b: part(b) * scales[b]), F.lit(0.0), lambda a, v: a + v)


def silu_gate(y: Column, gate: Column) -> Column:
    return y / (F.lit(1.0) + F.exp(-y)) * gate


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def attention(pairs: DataFrame, group: str, score: str, value: str, dim: int) -> DataFrame:
    """softmax(score)-weighted mean of ``value`` per group, materialised: maximum, weights, then sums per component."""
    top = Window.partitionBy(group)
    w = pairs.withColumn("__w", F.exp(F.col(score) - F.max(score).over(top)))
    return w.groupBy(group).agg(F.array(*[F.sum(F.col("__w") * F.col(value)[k]) / F.sum("__w") for k in range(dim)]).alias("out"))


#: Keys that one running state of attention takes in.
ATTENTION_BLOCK = 10_000


def attention_online(pairs: DataFrame, group: str, order: str, score: str, value: str) -> DataFrame:
    """The same by running states (maximum, denominator, output), of which a group has one per block of its keys.

    A block is folded key by key; states are mergeable, each scaled to the common maximum, so a group of any size is shared among tasks
    and no array holds more than a block. ``order`` must be unique within the group."""
    from .prefix import group_buckets

    largest = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    start = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("d"), F.array().cast("array<double>").alias("o"))

    def step(s, x):
        m = F.greatest(s.m, x[score])
        keep, add = F.exp(s.m - m), F.exp(x[score] - m)
        out = F.when(F.size(s.o) == 0, F.transform(x[value], lambda v: v.cast("double") * add)).otherwise(F.zip_with(s.o, x[value], lambda o, v: o * keep + v.cast("double") * add))
        return F.struct(m.alias("m"), (s.d * keep + add).alias("d"), out.alias("o"))

    def merge(s, x):
        m = F.greatest(s.m, x.m)
        a, b = F.exp(s.m - m), F.exp(x.m - m)
        out = F.when(F.size(s.o) == 0, F.transform(x.o, lambda v: v * b)).otherwise(F.zip_with(s.o, x.o, lambda v, w: v * a + w * b))
        return F.struct(m.alias("m"), (s.d * a + x.d * b).alias("d"), out.alias("o"))

    blocks = pairs.withColumn("__b", F.pmod(F.xxhash64(order), F.lit(group_buckets(largest, ATTENTION_BLOCK))))
    folded = blocks.groupBy(group, "__b").agg(F.array_sort(F.collect_list(F.struct(order, score, value))).alias("__r")).select(group, "__b", F.aggregate("__r", start, step).alias("__s"))
    states = folded.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__b", "__s"))).alias("__r"))
    return states.select(group, F.aggregate(F.transform("__r", lambda x: x["__s"]), start, merge, lambda s: F.transform(s.o, lambda v: v / s.d)).alias("out"))


def greedy(df: DataFrame, group: str, token: str, logit: str) -> DataFrame:
    """The token of the largest logit, of equal ones the lowest."""
    return df.groupBy(group).agg(F.max_by(token, F.struct(logit, -F.col(token))).alias("token"))


def penalised(logit: Column, seen: Column, penalty: float) -> Column:
    return F.when(seen, F.when(logit > 0, logit / F.lit(penalty)).otherwise(logit * F.lit(penalty))).otherwise(logit)


def sample(df: DataFrame, group: str, token: str, logit: str, seen: str, draw: str, penalty: float, temperature: float, top_k: int, top_p: float, min_p: float) -> DataFrame:
    """Repetition penalty, temperature, top-k, min-p, top-p (the crossing token stays), then the inverse distribution at
    ``draw``. A temperature of 0 or less is an error. Mass for top-p is what min-p has left."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    w = Window.partitionBy(group).orderBy(F.desc("__l"), token)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__l", penalised(F.col(logit), F.col(seen), penalty) / F.lit(temperature))
    rows = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= (top_k if top_k > 0 else 2**31 - 1))
    rows = rows.withColumn("__w", F.exp(F.col("__l") - F.first("__l").over(upto))).where(F.col("__w") >= min_p)
    whole = Window.partitionBy(group)
    rows = rows.withColumn("__c", F.sum("__w").over(upto)).withColumn("__t", F.sum("__w").over(whole))
    rows = rows.where((F.col("__c") - F.col("__w")) / F.col("__t") < top_p)
    rows = rows.withColumn("__m", F.max("__c").over(whole))
    return rows.where(F.col("__c") >= F.col(draw) * F.col("__m")).groupBy(group).agg(F.min_by(token, "__r").alias("token"))
