import datetime as dt
import math
import random
import struct

from pyspark.sql import functions as F

from plexaform.llm import percentiles as pc


def rows(seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(900):
        g = rnd.choice(["a", "b", None])
        day = rnd.choice([dt.date(2026, 1, 1), dt.date(2026, 1, 2), None])
        v = rnd.choice([0.0, -0.0, rnd.lognormvariate(3, 4), float(rnd.randrange(5)), 5e-324, 1e300, None, float("nan"), -1.0, float("inf")])
        out.append((i, g, day, v))
    return out + out[:100]


def exact(data, q):
    n = len(data)
    return sorted(data)[max(1, -(-n * q // 1000)) - 1]


def test_exact_and_mergeable(spark):
    data = rows()
    df = spark.createDataFrame(data, "i int, g string, d date, v double").withColumn("digit", F.lit(1)).withColumn("bits", F.lit("x"))
    got = {(r["grp"], r["day"], r["q"]): (r["n"], r["value"]) for r in pc.radix_percentiles(df, F.col("g"), F.col("d"), F.col("v"), [F.col("i")], [500, 900, 999]).collect()}
    valid = {}
    for i, g, d, v in data[:900]:
        if v is not None and not math.isnan(v) and 0 <= v < math.inf:
            valid.setdefault((g, None), []).append(v)
            if d is not None:
                valid.setdefault((g, d), []).append(v)
    assert {(g, d) for g, d, _ in got} == set(valid)
    for (g, d, q), (n, value) in got.items():
        assert (n, value) == (len(valid[g, d]), exact(valid[g, d], q))
    values = pc.records_once(df, F.col("g"), F.col("d"), F.col("v"), [F.col("i")])
    for r in pc.state_percentiles(pc.merged_states(pc.daily_states(values)), [500, 900, 999]).collect():
        true = exact(valid[r["grp"], None], r["q"])
        assert abs(r["value"] - true) <= pc.STATE_ERROR * true + pc.STATE_FLOOR


def test_bits_keep_order(spark):
    rnd = random.Random(4)
    vs = [-1e300, -2.5, -5e-324, 0.0, 5e-324, 2.0 ** -1022, 1.0, 1.0000000000000002, 1e300, 1.7976931348623157e308]
    vs += [math.ldexp(1.0, e) for e in range(-1074, 1024)] + [math.nextafter(math.ldexp(1.0, e), 0.0) for e in range(-1070, 1024)] + [rnd.lognormvariate(0, 100) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v double")
    got = pc.with_order_bits(df, "v", "b").withColumn("back", pc.from_bits(F.col("b"))).collect()
    for r in got:
        raw = struct.unpack(">q", struct.pack(">d", abs(r["v"])))[0]
        assert r["b"] == (-1 - raw if r["v"] < 0 else raw)
        assert r["back"] == r["v"]
    assert pc.with_order_bits(spark.createDataFrame([(-0.0,), (None,)], "v double"), "v", "b").select("b").collect()[0]["b"] == 0


def test_zeros_and_unknown_records(spark):
    """States give zeros as zero; rows without an id all count."""
    rows = [(None, "a", None, 0.0)] * 3 + [(1, "a", None, 0.0)] * 2 + [(2, "b", None, 7.0), (None, "b", None, 7.0)]
    df = spark.createDataFrame(rows, "i int, g string, d date, v double")
    got = {(r["grp"], r["q"]): (r["n"], r["value"]) for r in pc.radix_percentiles(df, F.col("g"), F.col("d"), F.col("v"), [F.col("i")], [500, 999]).collect()}
    assert got == {("a", 500): (4, 0.0), ("a", 999): (4, 0.0), ("b", 500): (2, 7.0), ("b", 999): (2, 7.0)}
    states = pc.merged_states(pc.daily_states(pc.records_once(df, F.col("g"), F.col("d"), F.col("v"), [F.col("i")])))
    assert {r["grp"]: r["value"] for r in pc.state_percentiles(states, [500]).collect() if r["grp"] == "a"} == {"a": 0.0}


def test_many_digits_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(pc, "SENT_DIGITS", 0)
    test_exact_and_mergeable(spark)


def test_empty_and_invalid(spark):
    df = spark.createDataFrame([(1, "a", None, None)], "i int, g string, d date, v double")
    assert pc.radix_percentiles(df, F.col("g"), F.col("d"), F.col("v"), [F.col("i")], [500]).count() == 0
    assert pc.radix_percentiles(df.limit(0), F.col("g"), F.col("d"), F.col("v"), [F.col("i")], [500]).count() == 0
