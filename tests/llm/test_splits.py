import itertools
import random

from pyspark.sql import functions as F

from plexaform.llm import splits


def test_subset_is_the_closest():
    rnd = random.Random(2)
    for _ in range(40):
        sizes = {}
        for _ in range(rnd.randrange(1, 6)):
            sizes[rnd.randrange(1, 30)] = rnd.randrange(1, 4)
        groups = [s for s, m in sizes.items() for _ in range(m)]
        target = rnd.randrange(0, sum(groups) + 1)
        best = min(abs(sum(c) - target) for k in range(len(groups) + 1) for c in itertools.combinations(groups, k))
        got = splits.closest_subset(sizes, target)
        assert all(n <= sizes[s] for s, n in got.items())
        assert abs(sum(s * n for s, n in got.items()) - target) == best
    assert splits.closest_subset({}, 5) == {}


def test_totals_are_exact_beyond_the_pool():
    total = lambda chosen: sum(s * n for s, n in chosen.items())
    assert total(splits.closest_subset({1: 40_000_000, 2: 20_000_000}, 8_000_000)) == 8_000_000
    many = {s: 600_000 // s for s in range(1, 40)} | {1_000_003: 9}
    for target in (2_345_678, 18_000_001, sum(s * m for s, m in many.items())):
        got = splits.closest_subset(many, target)
        assert total(got) == target and all(n <= many[s] for s, n in got.items())
    assert total(splits.closest_subset({3: 5_000_000}, 7_000_000)) == 6_999_999


def test_small_pool_gives_the_same_totals(monkeypatch):
    monkeypatch.setattr(splits, "POOL", 50)
    for target in range(0, 400, 7):
        got = splits.closest_subset({1: 20, 2: 20, 7: 10, 50: 5}, target)
        assert sum(s * n for s, n in got.items()) == min(target, 380)


def test_groups_stay_together(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice([None, f"p{rnd.randrange(40)}"]), rnd.choice([None, f"r{rnd.randrange(60)}"]), f"s{rnd.randrange(150)}" if rnd.random() < 0.6 else None) for i in range(300)]
    rows += rows[:20] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, p string, r string, s string").withColumn("component", F.lit("c")).withColumn("split", F.lit("x")).withColumn("v", F.lit(1))
    got = splits.grouped_split(df, ["i"], {"p": F.col("p"), "r": F.col("r"), "s": F.col("s")}, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    side = {r["i"]: r["split"] for r in got}
    assert len(got) == len(side) == 301
    for k in (1, 2, 3):
        by = {}
        for row in rows:
            if row[k] is not None:
                by.setdefault(row[k], set()).add(side[row[0]])
        assert all(len(v) == 1 for v in by.values())


def test_free_records_hit_the_shares(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), F.lit(None).cast("string").alias("p"))
    got = splits.grouped_split(df, ["i"], {"p": F.col("p")}, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 800, "validation": 100, "test": 100}
    assert splits.grouped_split(df.limit(0), ["i"], {"p": F.col("p")}, {"train": 0.8, "test": 0.2}).count() == 0


def test_one_giant_component(spark):
    df = spark.createDataFrame([(i, "same" if i < 90 else None) for i in range(100)], "i int, p string")
    got = {r["split"]: r["count"] for r in splits.grouped_split(df, ["i"], {"p": F.col("p")}, {"train": 0.8, "validation": 0.1, "test": 0.1}).groupBy("split").count().collect()}
    assert got["train"] == 90 and sum(got.values()) == 100


def test_nearest_total_beyond_the_pool():
    """Large groups that fit, taken first, leave a gap here that only another choice of large groups closes."""
    total = lambda chosen: sum(s * n for s, n in chosen.items())
    assert splits.closest_subset({3_000_000: 1, 5_000_000: 1, 6_000_000: 1}, 8_000_000) == {3_000_000: 1, 5_000_000: 1}
    assert total(splits.closest_subset({10: 3_000_000, 4_000_007: 2, 6_000_001: 1, 7_000_004: 1, 9_000_010: 2}, 11_000_008)) == 11_000_008
    assert total(splits.closest_subset({1000 + 7 * i: 500 for i in range(1, 800)}, 100_000_003)) == 100_000_003


def test_the_same_groups_whatever_the_pool(monkeypatch):
    rnd = random.Random(4)
    for _ in range(60):
        sizes = {rnd.randrange(1, 60): rnd.choice([1, 2, 3, 9]) for _ in range(rnd.randrange(2, 7))}
        target = rnd.randrange(0, sum(s * m for s, m in sizes.items()) + 1)
        reach = {0}
        for s, m in sizes.items():
            reach = {r + s * n for r in reach for n in range(m + 1)}
        monkeypatch.setattr(splits, "POOL", 1 << 22)
        got = splits.closest_subset(sizes, target)
        assert sum(s * n for s, n in got.items()) == min(reach, key=lambda r: (abs(r - target), r))
        for pool in (1, 3, 50):
            monkeypatch.setattr(splits, "POOL", pool)
            assert splits.closest_subset(sizes, target) == got


def test_components_of_one_size_come_in_one_order(spark):
    """The order in which components fill the shares does not depend on how many there are."""
    df = spark.range(1000).select(F.col("id").alias("i"), F.lit(None).cast("string").alias("p"))
    got = splits.grouped_split(df, ["i"], {"p": F.col("p")}, {"train": 0.8, "validation": 0.1, "test": 0.1})
    got = got.orderBy(F.pmod(F.xxhash64("component"), F.lit(4096)), "component").collect()
    assert [r["split"] for r in got] == ["validation"] * 100 + ["test"] * 100 + ["train"] * 800
