"""Dataset engineering: immutable store, seeded group splits, labels, feature hashing, preferences, balancing, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sequences import global_index


def content_id(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical form: fields in name order, compact, NULL written as null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.concat(F.lit('"'), v.cast("string"), F.lit('"')), F.lit("null"))) for k, v in sorted(fields.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


class Store:
    """Append-only tables keyed by id under one folder: the same record again is skipped, the same id with other content is an error."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, kind: str) -> str:
        return f"{self.root}/{kind}"

    def load(self, kind: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(self._path(kind))
        except AnalysisException:
            return None

    def append(self, kind: str, records: DataFrame, key: str) -> int:
        """Number of records added. All checks are made before anything is written."""
        content = [c for c in records.columns if c != key]
        rows = records.dropDuplicates()
        clash = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if records.where(F.col(key).isNull()).limit(1).count():
            raise ValueError("record without id")
        if clash.limit(1).count():
            raise ValueError("one id with different content in one batch")
        old = self.load(kind)
        if old is not None:
            before = old.select(F.col(key).alias("__k"), F.struct(*content).alias("__o"))
            both = rows.join(before, F.col(key) == F.col("__k"))
            if both.where(~F.struct(*content).eqNullSafe(F.col("__o"))).limit(1).count():
                raise ValueError("stored id with different content")
            rows = rows.join(before, F.col(key) == F.col("__k"), "left_anti")
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(self._path(kind))
        return n


def materialize_references(rows: DataFrame, ref: str, table: DataFrame, symbol: str, ident: str, out: str) -> DataFrame:
    """Symbolic references replaced by content ids; an unknown symbol gives NULL."""
    t = table.select(F.col(symbol).alias("__s"), F.col(ident).alias(out))
    return rows.join(t, F.col(ref) == F.col("__s"), "left").drop("__s", ref)


def seeded_group_split(groups: DataFrame, key: str, seed: int, test: float, calibration: float, holdout: str | None = None) -> DataFrame:
    """key, part: whole groups to test, calibration and train, in the order of SHA-256(seed, key).

    Sizes are max(1, half-even rounding of the share); ``holdout`` sends every group whose key contains it to test. NULL
    keys are left out; with fewer than three groups one is tested, with a single remaining one none calibrates."""
    keys = groups.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    h = F.sha2(F.concat(F.lit(f"{seed}\x1f"), F.col("key")), 256)
    if holdout is not None:
        held = keys.where(F.contains(F.col("key"), F.lit(holdout))).select("key", F.lit("test").alias("part"))
        rest = keys.where(~F.contains(F.col("key"), F.lit(holdout)))
        n_test = F.lit(0).cast("bigint")
    else:
        held, rest = None, keys
        n = keys.agg(F.count(F.lit(1))).scalar()
        n_test = F.when(n >= 3, F.greatest(F.lit(1), F.bround(n * F.lit(test)))).otherwise(1).cast("bigint")
    placed = global_index(rest.withColumn("h", h), ["h", "key"], "i")
    left = rest.agg(F.count(F.lit(1))).scalar() - n_test
    n_cal = F.when(left >= 2, F.greatest(F.lit(1), F.bround(left * F.lit(calibration)))).otherwise(0).cast("bigint")
    out = placed.select("key", F.when(F.col("i") < n_test, "test").when(F.col("i") < n_test + n_cal, "calibration").otherwise("train").alias("part"))
    return out if held is None else out.unionByName(held)


def leaks(rows: DataFrame, key: str, part: str) -> DataFrame:
    """key, parts: keys that stand in more than one part."""
    return rows.groupBy(key).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def labels(observations: DataFrame, key: str, outcome: str, grade: str, value: str, passed: list[str], illegal: list[str], physical: list[str]) -> DataFrame:
    """key, proof_risk (0 passed, 1 tried, 0.5 unknown), applicable, utility (best physical value, grade D left out)."""
    o = F.col(outcome)
    semantic = o.isin(*passed, *illegal)
    per = observations.groupBy(key).agg(F.bool_or(o.isin(*passed)).alias("p"), F.bool_or(semantic).alias("s"), F.bool_or(o.isin(*illegal)).alias("i"),
                                        F.max(F.when(o.isin(*physical) & (F.col(grade) != "D"), F.col(value))).alias("u"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return per.select(key, F.when(no("p"), 0.0).when(no("s"), 1.0).otherwise(0.5).alias("proof_risk"), (~no("i")).alias("applicable"), F.coalesce("u", F.lit(0.0)).alias("utility"))


def hashed_feature(token: Column, dimension: int) -> tuple[Column, Column]:
    """(bucket, sign) of a token: SHA-256, first 8 bytes little endian modulo ``dimension``; sign by bit 0 of byte 8."""
    h = F.sha2(token, 256)
    little = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)])
    bucket = (F.conv(little, 16, 10).cast("decimal(20,0)") % F.lit(dimension)).cast("bigint")
    odd = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1
    return bucket, F.when(odd, 1.0).otherwise(-1.0)


def hashed_vectors(tokens: DataFrame, row: str, token: str, weight: str, dimension: int) -> DataFrame:
    """row, bucket, value: signed sums per bucket, scaled to length 1 per row; rows of length 0 stay 0."""
    bucket, sign = hashed_feature(F.col(token), dimension)
    v = tokens.select(row, bucket.alias("bucket"), (sign * F.col(weight)).alias("x")).groupBy(row, "bucket").agg(F.sum("x").alias("x"))
    norm = v.groupBy(F.col(row).alias("__r")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("__n"))
    return v.join(norm, F.col(row) == F.col("__r")).select(row, "bucket", F.when(F.col("__n") > 0, F.col("x") / F.col("__n")).otherwise(0.0).alias("value"))


def preference_weight(a: Column, b: Column) -> Column:
    """Confidence of preferring one utility over another: 10 |a - b| within 0.1..2; NULL for a difference below 1e-6."""
    d = F.abs(a - b)
    return F.when(d >= 1e-6, F.least(F.lit(2.0), F.greatest(F.lit(0.1), d * 10)))


def equal_mass_weights(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """``df`` with weight: every outer group, and within it every inner group, has the same total weight."""
    n = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("__n"))
    m = n.groupBy(F.col(outer).alias("__o")).agg(F.count(F.lit(1)).alias("__m"))
    k = n.join(m, F.col(outer).eqNullSafe(F.col("__o"))).select(F.col(outer).alias("__a"), F.col(inner).alias("__b"), (F.lit(1.0) / F.col("__n") / F.col("__m")).alias("weight"))
    return df.join(k, F.col(outer).eqNullSafe(F.col("__a")) & F.col(inner).eqNullSafe(F.col("__b"))).drop("__a", "__b")


def capped_negatives(df: DataFrame, signature: str, positive: Column, order: Column, tie: str, cap: int) -> DataFrame:
    """All positives, and of each signature the first ``cap`` negatives by (order, tie): a sampling operator.

    The planner turns the bound on the row number into a limit that every partition applies before the shuffle (for caps
    below its windowGroupLimitThreshold), so a group of any size sends at most ``cap`` rows a partition."""
    first = Window.partitionBy(signature).orderBy(order, F.col(tie))
    kept = df.where(~positive).withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= cap).drop("__rank")
    return df.where(positive).unionByName(kept)


def risk_threshold(df: DataFrame, score: str, positive: str, recall: float) -> DataFrame:
    """threshold: the highest score limit at which items at or above it hold ``recall`` of the positives."""
    counts = df.groupBy(score).agg(F.sum(F.col(positive).cast("bigint")).alias("p"))
    total = df.agg(F.sum(F.col(positive).cast("bigint"))).scalar()
    from .sequences import global_prefix_sum
    run = global_prefix_sum(counts.withColumn("__neg", -F.col(score)), ["__neg"], "p", "upto")
    return run.where(F.col("upto") >= F.lit(recall) * total).agg(F.max(score).alias("threshold"))


def pairwise_preferences(df: DataFrame, group: list[str], utility: str) -> DataFrame:
    """group, wins, losses, weight per row, without forming pairs: rows are compared with the distinct utilities of their
    group, each weighted by how many rows hold it."""
    levels = df.groupBy(*group, F.col(utility).alias("__u")).agg(F.count(F.lit(1)).alias("__n"))
    names = {g: f"__g{i}" for i, g in enumerate(group)}
    right = levels.select(*[F.col(g).alias(n) for g, n in names.items()], "__u", "__n")
    on = F.lit(True)
    for g, n in names.items():
        on = on & F.col(g).eqNullSafe(F.col(n))
    w = preference_weight(F.col(utility), F.col("__u"))
    j = levels.withColumnRenamed("__u", utility).withColumnRenamed("__n", "__m").join(right, on).where(w.isNotNull())
    return j.groupBy(*group, utility).agg(F.sum(F.when(F.col(utility) > F.col("__u"), F.col("__n"))).alias("wins"), F.sum(F.when(F.col(utility) < F.col("__u"), F.col("__n"))).alias("losses"), F.sum(w * F.col("__n")).alias("weight"))


def sibling_rank(df: DataFrame, group: list[str], order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def controlled_corpus(spark: SparkSession, roots: int, families: list[str], languages: list[str]) -> DataFrame:
    """root, project, language, family, variant, applicable, utility, outcome: every family in five variants per root, by fixed rules.

    A root favours one family; the next one gives the identical program, any other a loss. Of the favoured family's variants the second
    gains where the machine is wide, and later ones lose more and more."""
    # fixed values: gains, losses and the floor of a material win
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    root, variant = F.col("root"), F.col("variant")
    x = spark.range(roots).select(F.col("id").alias("root")).select("root", F.explode(F.array(*[F.lit(f) for f in families])).alias("family")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("variant"))
    x = x.withColumn("own", pick(families, root)).withColumn("next", pick(families, root + 1))
    bonus = F.when((variant == 1) & (root % 2 == 0), 0.05).when(variant == 1, -0.02).when(variant >= 2, -0.08 - 0.01 * variant).otherwise(0.0)
    utility = F.round(F.when(F.col("family") == F.col("own"), 0.10 + (root % 4) * 0.025 + bonus).when(F.col("family") == F.col("next"), 0.0).otherwise(-0.04 - 0.01 * variant), 9)
    outcome = F.when(F.col("family") == F.col("own"), F.when(F.col("utility") >= 0.03, "material_regional_win").otherwise("small_win_below_floor")).when(F.col("family") == F.col("next"), "compiler_identical").otherwise("measured_regression")
    return x.withColumn("utility", utility).select("root", F.concat(F.lit("synthetic-project-"), (root % 12).cast("string")).alias("project"), pick(languages, root).alias("language"), "family", "variant",
                                                   (F.col("family") == F.col("own")).alias("applicable"), "utility", outcome.alias("outcome"))
