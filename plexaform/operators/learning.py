"""Linear scorers trained on preferences, and how well they order held-out groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preference_differences(df: DataFrame, group: str, key: str, features: list[str], utility: str, neighbours: int = 3) -> DataFrame:
    """label, d0..dn, weight: feature differences of preferred and other within a group.

    Each row is compared with the ``neighbours`` rows after it in the order of a hash, so a group of n rows gives at most
    n x neighbours differences and not all pairs; both directions are given, so labels are balanced. This is a bounded
    sample for fitting; held-out pairs are counted by ``ordered_pairs``."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    rows = df.select(group, key, utility, *features)
    for k in range(1, neighbours + 1):
        rows = rows.withColumn(f"__n{k}", F.lead(F.struct(utility, *features), k).over(w))
    pairs = rows.withColumn("__o", F.explode(F.array(*[F.col(f"__n{k}") for k in range(1, neighbours + 1)]))).where("__o is not null")
    from .datasets import preference_weight

    weight = preference_weight(F.col(utility), F.col(f"__o.{utility}"))
    pairs = pairs.withColumn("weight", weight).where("weight is not null")
    up = F.when(F.col(utility) > F.col(f"__o.{utility}"), 1.0).otherwise(-1.0)
    pairs = pairs.withColumn("flip", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    label = F.when(up * F.col("flip") > 0, 1.0).otherwise(0.0)
    return pairs.select(label.alias("label"), "weight", *[((F.col(f) - F.col(f"__o.{f}")) * F.col("flip")).alias(f"d{i}") for i, f in enumerate(features)])


def train_preferences(differences: DataFrame, n: int) -> list[float]:
    """Coefficients of a logistic model without intercept on feature differences."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[f"d{i}" for i in range(n)], outputCol="x").transform(differences)
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", fitIntercept=False, regParam=0.001, maxIter=50).fit(data)
    return [float(v) for v in model.coefficients]


def ordered_pairs(df: DataFrame, group: str, key: str, score: str, utility: str, tie: float = 1e-12) -> DataFrame:
    """group, pairs, ordered: all pairs of rows of a group that differ in utility, and those of them in which the row ranked
    first by (score descending, key) has the higher utility.

    Pairs are counted and not formed: utilities become levels, and two levels are told apart at the highest bit in which
    they differ. For each bit, rows that agree above it run in rank order past the counts of zeros and ones seen, so n rows
    give n x log2(levels). Distinct utilities less than ``tie`` above the next lower one share its level. Rows with a
    NULL score or utility are left out; a group without such pairs has 0 and 0."""
    from pyspark.sql import Window

    rows = df.select(F.col(group).alias("g"), F.col(key).alias("i"), F.col(score).alias("s"), F.col(utility).alias("u")).where("s is not null and u is not null")
    whole = Window.partitionBy("g")
    step = F.col("u") - F.lag("u").over(whole.orderBy("u"))
    rows = rows.withColumn("new", F.coalesce((step >= tie).cast("bigint"), F.lit(0)))
    rows = rows.select("g", F.row_number().over(whole.orderBy(F.desc("s"), "i")).alias("k"),
                       F.sum("new").over(whole.orderBy("u").rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("level"))
    rows = rows.withColumn("top", F.max("level").over(whole))
    bits = rows.select("g", "k", "level", F.explode(F.sequence(F.lit(0), F.length(F.bin("top")) - 1)).alias("b"))
    one = F.expr("shiftright(level, b) & 1")
    bits = bits.select("g", "k", "b", F.expr("shiftright(shiftright(level, b), 1)").alias("above"), one.alias("one"))
    before = Window.partitionBy("g", "b", "above").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    seen = bits.select("g", "one", F.coalesce(F.sum("one").over(before), F.lit(0)).alias("ones"), F.coalesce(F.sum(1 - F.col("one")).over(before), F.lit(0)).alias("zeros"))
    right, wrong = F.when(F.col("one") == 0, F.col("ones")).otherwise(0), F.when(F.col("one") == 1, F.col("zeros")).otherwise(0)
    return seen.groupBy("g").agg(F.sum(right + wrong).alias("pairs"), F.sum(right).alias("ordered")).withColumnRenamed("g", group)


def train_ensemble(differences: DataFrame, n: int, members: int = 5, seed: int = 4242) -> list[list[float]]:
    """Coefficients of ``members`` models, each fitted on differences drawn with replacement (Poisson weights by a hash)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[f"d{i}" for i in range(n)], outputCol="x").transform(differences)
    out = []
    for k in range(members):
        # how often a row is drawn: 0, 1, 2, .. with the chances of a Poisson variable of mean 1
        u = F.pmod(F.xxhash64(F.lit(seed + 7919 * k), "label", *[f"d{i}" for i in range(n)]), F.lit(1_000_003)) / 1_000_003.0
        times = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).when(u < 0.9810, 3).otherwise(4)
        drawn = data.withColumn("times", times).where("times > 0").withColumn("w", F.col("weight") * F.col("times"))
        model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", fitIntercept=False, regParam=0.001, maxIter=50).fit(drawn)
        out.append([float(v) for v in model.coefficients])
    return out


def ensemble(scores: list[Column]) -> tuple[Column, Column]:
    """Mean and population standard deviation of the members' scores."""
    n = float(len(scores))
    mean = sum(scores[1:], scores[0]) / n
    squares = [(s - mean) * (s - mean) for s in scores]
    return mean, F.sqrt(sum(squares[1:], squares[0]) / n)


def calibration(df: DataFrame, spread: str, residual: str, q: float = 0.95) -> DataFrame:
    """uncertainty, residual: nearest-rank quantiles on the calibration rows; 1 where there are none."""
    at = lambda c: F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})"), F.lit(1.0))
    return df.agg(at(spread).alias("uncertainty"), at(residual).alias("residual"))


def shadow_report(df: DataFrame, group: str, key: str, score: str, utility: str, baseline: str, share: float, least: int) -> DataFrame:
    """One row: what searching only the best ``share`` of each group's candidates (``least`` at least, and its baseline) would have
    found, against searching all.

    roots, recall_at_budget (the winner is searched), recall_at_1, recall_at_5, recall_at_tenth (its place in the ranking), reduction
    (all candidates over searched ones), largest_regret and median_regret (upper median of the utility lost). The winner has the
    highest utility, of equal ones the greatest key; ranks follow (score descending, key). Groups of one candidate or without
    a baseline are left out; without any group all but ``roots`` is NULL."""
    from pyspark.sql import Window

    rank = Window.partitionBy("g").orderBy(F.desc("s"), "i")
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("i"), F.col(score).alias("s"), F.col(utility).alias("u"), F.coalesce(F.col(baseline), F.lit(False)).alias("b"))
    sums = rows.groupBy(F.col("g").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max_by("i", F.struct("u", "i")).alias("winner"), F.count_if("b").alias("based"), F.min_by("i", F.when(F.col("b"), F.struct(-F.col("s"), F.col("i")))).alias("kept"))
    rows = rows.withColumn("k", F.row_number().over(rank)).join(sums.where("n >= 2 and based > 0"), F.col("g") == F.col("h"))
    budget = F.greatest(F.lit(least), 1 + F.ceil((F.col("n") - 1) * F.lit(share)))
    rows = rows.withColumn("taken", (F.col("k") <= budget) | (F.col("i") == F.col("kept")))
    per = rows.groupBy("g").agg(F.max("n").alias("n"), F.min(F.when(F.col("i") == F.col("winner"), F.col("k"))).alias("place"), F.count_if("taken").alias("taken"),
                                F.bool_or(F.col("taken") & (F.col("i") == F.col("winner"))).alias("hit"), (F.max("u") - F.max(F.when(F.col("taken"), F.col("u")))).alias("regret"))
    rate = lambda c, name: F.round(F.avg(c.cast("int")), 9).alias(name)
    return per.agg(F.count(F.lit(1)).alias("roots"), rate(F.col("hit"), "recall_at_budget"), rate(F.col("place") <= 1, "recall_at_1"), rate(F.col("place") <= 5, "recall_at_5"),
                   rate(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1)), "recall_at_tenth"), F.round(F.try_divide(F.sum("n"), F.sum("taken")), 9).alias("reduction"), F.round(F.max("regret"), 9).alias("largest_regret"),
                   F.round(F.try_element_at(F.array_sort(F.collect_list("regret")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")), 9).alias("median_regret"))
