"""Bootstrap statistics and decision rules. Draws come from an explicit table, so results don't depend on an engine's RNG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draws(spark, rounds: int, picks: Column | int, population: Column | int, seed: int) -> DataFrame:
    """round, k, pick: ``picks`` draws with replacement from 0..population-1 per round.

    A draw is the leading 52 bits of the MD5 of seed, round and k, modulo the population: any engine gives the same ones."""
    grid = spark.range(rounds).select(F.col("id").alias("round")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.lit(picks) - 1).cast("bigint"))))
    text = F.concat_ws("-", F.lit(str(seed)), F.col("round").cast("string"), F.col("k").cast("string"))
    return grid.withColumn("pick", F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") % F.lit(population))


def cluster_bootstrap(samples: DataFrame, cluster: str, value: str, rounds: int, q: float, seed: int, clusters: int) -> DataFrame:
    """low, point, high: 95 percent interval of a quantile when whole clusters (processes, numbered 0..clusters-1) are
    drawn. Per round the multiplicity of a cluster weights its values, so the pooled multiset is never built."""
    spark = samples.sparkSession
    times = draws(spark, rounds, clusters, clusters, seed).groupBy("round", "pick").agg(F.count(F.lit(1)).alias("times"))
    counted = samples.groupBy(F.col(cluster).alias("c"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    per = times.join(counted, F.col("pick") == F.col("c")).groupBy("round").agg(F.expr(f"percentile(v, {q}, n * times)").alias("x"))
    point = samples.agg(F.percentile(value, q)).scalar()
    return per.agg(F.percentile("x", 0.025).alias("low"), F.max(point).alias("point"), F.percentile("x", 0.975).alias("high"))


def paired_bootstrap(effects: DataFrame, index: str, effect: str, rounds: int, seed: int, pairs: int) -> DataFrame:
    """low, high: 95 percent interval of the median effect over resampled pairs (numbered 0..pairs-1)."""
    times = draws(effects.sparkSession, rounds, pairs, pairs, seed).groupBy("round", "pick").agg(F.count(F.lit(1)).alias("times"))
    per = times.join(effects, F.col("pick") == F.col(index)).groupBy("round").agg(F.expr(f"percentile({effect}, 0.5, times)").alias("x"))
    return per.agg(F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


def ratio_bootstrap(samples: DataFrame, side: str, index: str, value: str, rounds: int, seed: int, sizes: dict[str, int]) -> DataFrame:
    """low, high: 95 percent interval of mean(side 'a') / mean(side 'b'), both sides resampled on their own."""
    spark = samples.sparkSession
    means = None
    for k, (name, n) in enumerate(sizes.items()):
        times = draws(spark, rounds, n, n, seed + 101 * k).groupBy("round", "pick").agg(F.count(F.lit(1)).alias("times"))
        own = samples.where(F.col(side) == name).select(F.col(index).alias("i"), F.col(value).alias("v"))
        m = times.join(own, F.col("pick") == F.col("i")).groupBy("round").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias(f"m{k}"))
        means = m if means is None else means.join(m, "round")
    return means.agg(F.percentile(F.col("m0") / F.col("m1"), 0.025).alias("low"), F.percentile(F.col("m0") / F.col("m1"), 0.975).alias("high"))


def latency_verdict(base: dict[str, Column], cand: dict[str, Column], base_low: Column, base_high: Column, cand_low: Column, cand_high: Column,
                    tail_low: Column, tail_high: Column) -> Column:
    """accepted: lower bounds of the p50 and p99.9 improvement reach 10 and 5 percent and p99.99 regresses by 1 at most;
    statistical_tie: the p50 interval straddles 10 percent; else rejected."""
    low50, high50 = (base_low / cand_high - 1) * 100, (base_high / cand_low - 1) * 100
    low999 = (tail_low / tail_high - 1) * 100
    regression = (cand["p99_99"] / base["p99_99"] - 1) * 100
    ok = (low50 >= 10) & (low999 >= 5) & (regression <= 1)
    return F.when(ok, "accepted").when((low50 < 10) & (high50 >= 10), "statistical_tie").otherwise("rejected")


def admission(known: Column, cited: Column, missing: Column, direction: Column, metric: Column, metric_cited: Column, share: Column, instrumented: Column, least: float = 0.05) -> Column:
    """rejected, exploratory or admitted, by the first rule that applies."""
    return (F.when(~known, "rejected").when(~cited | missing, "rejected").when(~direction.isin("decrease", "increase") | (metric == ""), "rejected")
            .when(~metric_cited, "rejected").when(share < least, "exploratory").when(instrumented, "exploratory").otherwise("admitted"))


def complement_product(percentages: Column) -> Column:
    """array of percentages -> 1 - product(1 - p) in percent, p clamped to 0..100."""
    return (F.lit(1.0) - F.aggregate(percentages, F.lit(1.0), lambda a, p: a * (F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(100.0), p)) / 100))) * 100


def affected_fraction(regional: Column, whole: Column) -> Column:
    """Amdahl inverted: the share of runtime that a regional speedup must have had, clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(1.0) - F.lit(1.0) / whole) / (F.lit(1.0) - F.lit(1.0) / regional)))


def minimise_failure(sequence: list, fails) -> list:
    """A shortest-by-removal sub-sequence that still fails: halves, quarters, .. are dropped while the failure stays."""
    n = 2
    while len(sequence) >= 2:
        size = max(1, len(sequence) // n)
        for at in range(0, len(sequence), size):
            rest = sequence[:at] + sequence[at + size:]
            if rest and fails(rest):
                sequence, n = rest, max(2, n - 1)
                break
        else:
            if size == 1:
                break
            n = min(len(sequence), n * 2)
    return sequence
