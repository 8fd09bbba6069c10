import random

import pytest
from pyspark.sql import functions as F

from plexaform.functions import pointwise as pw
from plexaform.operators import sequences as sq
from plexaform.operators.components import connected_components
from plexaform.operators.market import Book, adversarial_trace, run_pipeline
from plexaform.operators.resampling import minimise_failure


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("y")).first()["y"]


def test_nan_takes_else(spark):
    x = F.lit(float("nan"))
    r = spark.range(1).select(pw.relu(x).alias("relu"), pw.threshold(x, 0.25).alias("t"), pw.sign(x).alias("s"), F.isnan(pw.clamp(x, -1.0, 1.0)).alias("c"), pw.reciprocal_shift(F.lit(-8.0), 8.0).alias("inf")).first()
    assert (r["relu"], r["t"], r["s"], r["c"], r["inf"]) == (0.0, 0.0, 0.0, True, float("inf"))


def test_expression_grammar(spark):
    df = spark.createDataFrame([(2.0,)], "v double")
    assert df.select(pw.expression("(x + 1) * 2", "v")).first()[0] == 6.0
    for bad in ("x; drop", "other + 1", "hash(x)", "x ? 1 : 2"):
        with pytest.raises(ValueError):
            pw.expression(bad, "v")


def snap(spark, n):
    base = spark.range(n).selectExpr("id AS i", "17 * id AS v")
    return base.selectExpr("i", "CASE WHEN i % 4 = 0 THEN v ELSE v + 3 END AS v"), base


@pytest.mark.parametrize("n", [0, 1, 5, 64])
def test_delta_is_all_or_nothing(spark, n):
    cur, base = snap(spark, n)
    want = {r["i"]: r["v"] for r in cur.collect()}
    changes = sum(1 for i in range(n) if i % 4)
    delta, state = sq.transduce(cur, base, "i", "v", changes)
    assert delta.count() == changes and {r["i"]: r["v"] for r in state.collect()} == want
    if changes:
        delta, state = sq.transduce(cur, base, "i", "v", changes - 1)
        assert delta.count() == 0 and {r["i"]: r["v"] for r in state.collect()} == {i: 17 * i for i in range(n)}


def test_capacity_modes(spark):
    sel = spark.range(10).selectExpr("id AS i")
    assert sq.with_capacity(sel, "i", 3, "truncate").count() == 3
    assert sq.with_capacity(sel, "i", 9, "fail-unchanged").count() == 0
    assert sq.with_capacity(sel, "i", 10, "fail-unchanged").count() == 10
    assert sq.with_capacity(sel, "i", 10, "fail-input-extent-unchanged", spark.range(11)).count() == 0
    with pytest.raises(ValueError):
        sq.with_capacity(sel, "i", 1, "other")


def test_codec_round_trip(spark):
    df = spark.createDataFrame([(65535, 1, 2**32 - 1), (0, 70000, 5)], "a bigint, b bigint, c bigint")
    for big in (False, True):
        w = sq.pack_fields([F.col("a"), F.col("b"), F.col("c")], [16, 16, 32], big)
        got = [tuple(r) for r in df.withColumn("w", w).select(*sq.unpack_fields(F.col("w"), [16, 16, 32], big)).collect()]
        assert got == [(65535, 1, 2**32 - 1), (0, 70000 % 65536, 5)]


def test_long_recurrence_matches_fold(spark):
    rows = [(i, float((i * 37) % 11)) for i in range(300)]
    got = {r["i"]: r["y"] for r in sq.long_recurrence(spark.createDataFrame(rows, "i bigint, x double"), ["i"], "x", 0.875, 0.125, "y").collect()}
    y = 0.0
    for i, x in rows:
        y = 0.875 * y + 0.125 * x
        assert abs(got[i] - y) < 1e-9


def test_goldens(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 4, 0])], "i int, v double").withColumn("s", F.lit(1))
    assert [r["y"] for r in df.select("i", sq.stencil3("v", ["s"], ["i"]).alias("y")).orderBy("i").collect()] == [0.0, 2.0, 0.0]
    mix = sq.strided_mix(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i bigint, v double"), "i", "v", 17, 0.75, 0.25, "y")
    assert [r["y"] for r in mix.orderBy("i").collect()] == [1.0, 2.75, 2.25]


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(f"v{rnd.randrange(80)}", f"v{rnd.randrange(80)}") for _ in range(60)] + [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("lone", None), ("x", "x")]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v
    for a, b in edges:
        find(a)
        if b is not None and find(a) != find(b):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r["v"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {v: find(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_pipeline_rejects_without_effect(spark):
    rows = [(1, 0, 1, 0, 100017, 44, 1), (1, 1, 1, 0, 100017, 44, 1), (1, 2, 9, 0, 100017, 1, 2), (1, 3, 1, 1, 100020, 5, 3), (1, 4, 1, 0, None, 5, 4)]
    df = spark.createDataFrame(rows, "key bigint, position bigint, kind int, side int, price_ticks int, quantity int, sequence bigint")
    got = sorted(run_pipeline(df, 1000, 100).collect(), key=lambda r: (r["sequence"], r["status"] != 0))
    assert [r["status"] for r in got] == [0, -2, -2, 0, -2]
    assert (got[0]["best_bid"], got[0]["bid_quantity"]) == (100017, 44) and int(got[0]["changed_mask"]) == 1 << 17
    assert run_pipeline(adversarial_trace(spark, 200), 500, 45).count() == 200


def test_risk_gates_agree():
    rnd = random.Random(1)
    a, b = Book(1000, 10), Book(1000, 10)
    a.position = b.position = 990
    assert [a.admit(0, 10), a.admit(0, 1)] == [0, 2]
    a.reserved = 0
    for _ in range(500):
        side, q = rnd.randrange(2), rnd.randrange(14)
        assert a.admit(side, q) == b.admit_by_mask(side, q) and a.reserved == b.reserved


def test_minimise_failure():
    assert minimise_failure(list(range(20)), lambda s: 3 in s and 11 in s) == [3, 11]


def test_as_of_across_partitions(spark):
    from plexaform.operators.relations import latest_at_or_before

    rnd = random.Random(12)
    left = [(i, rnd.choice(["a", "b", None]), rnd.randrange(60)) for i in range(400)]
    right = [(g, t, f"{g}{t}") for g in ("a", None) for t in rnd.sample(range(5, 60), 9)] + [("a", 3, None)]
    l, r = spark.createDataFrame(left, "i int, g string, t int"), spark.createDataFrame(right, "g string, rt int, v string")
    got = {x["i"]: x["v"] for x in latest_at_or_before(l, ["g"], "t", r, "rt", "v", "v").collect()}
    first = {x["i"]: x["v"] for x in latest_at_or_before(l, ["g"], "t", r, "rt", "v", "v", otherwise_first=True).collect()}
    for i, g, t in left:
        mine = sorted((rt, v) for rg, rt, v in right if rg == g and v is not None)
        below = [v for rt, v in mine if rt <= t]
        assert got[i] == (below[-1] if below else None)
        assert first[i] == (below[-1] if below else mine[0][1] if mine else None)


def test_held_out_pairs_are_all_counted(spark):
    import __spark_entry__ as entry
    from conftest import SF
    from plexaform.operators.learning import ordered_pairs

    rnd = random.Random(5)
    rows = [(g, i, float(rnd.randrange(6)), rnd.randrange(n) / 7) for g, n in (("a", 40), ("b", 3), ("c", 1), (None, 9)) for i in range(60)]
    rows += [("d", 0, 1.0, 0.5), ("d", 1, 2.0, 0.5 + 1e-15), ("d", 2, 3.0, None), ("d", 3, None, 0.1)]
    want = {}
    for g in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == g and None not in r[2:]), key=lambda r: (-r[2], r[1]))
        signs = [a[3] > b[3] for k, a in enumerate(ranked) for b in ranked[k + 1:] if abs(a[3] - b[3]) >= 1e-12]
        want[g] = (len(signs), sum(signs))
    df = spark.createDataFrame(rows, "g string, i int, s double, u double")
    assert {r["g"]: (r["pairs"], r["ordered"]) for r in ordered_pairs(df, "g", "i", "s", "u").collect()} == want

    held = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey % 5 = 0").selectExpr("p_brand", "p_size * 0.6D / 50 + p_retailprice * 0.4D / 2000 AS u").collect()
    by_brand = {}
    for r in held:
        by_brand.setdefault(r["p_brand"], []).append(r["u"])
    pairs = sum(abs(a - b) >= 1e-12 for us in by_brand.values() for k, a in enumerate(us) for b in us[k + 1:])
    got = entry.queries()["data08_preference_model"](spark, SF).first()
    assert got["pairs"] == pairs and got["ordered"]


def test_effects_travel_any_distance(spark):
    """A chain of 103 calls, and a NULL effect on a loop."""
    from plexaform.operators.graph import effect_closure

    calls = spark.range(103).selectExpr("id AS s", "id + 1 AS d").unionByName(spark.createDataFrame([(200, 201), (201, 200)], "s bigint, d bigint")).coalesce(1)
    own = spark.createDataFrame([(103, "io"), (200, None)], "n bigint, e string").coalesce(1)
    got = [(r["n"], r["e"]) for r in effect_closure(own, "n", "e", calls, "s", "d").collect()]
    assert len(got) == 106 and set(got) == {(k, "io") for k in range(104)} | {(200, None), (201, None)}


def test_capped_negatives_of_a_large_group(spark, tmp_path):
    """One nation with 120,000 customers: the registered SQL and the operator keep the same ones."""
    import __spark_entry__ as entry
    import duckdb

    rows = spark.range(150_000).selectExpr("id AS c_custkey", "CAST(IF(id % 5 = 0, id % 7, 7) AS INT) AS c_nationkey", "CAST(id * 7919 % 10000 AS DOUBLE) AS c_acctbal")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = {r[0] for r in con.sql(entry.oracle_sql()["data18_capped_negatives"]).fetchall()}
    df = entry.queries()["data18_capped_negatives"](spark, str(tmp_path))
    assert {r[0] for r in df.collect()} == want
    assert df._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_blocks_of_any_length(spark):
    """Blocks of a wrong length, empty ones and NULLs give NULLs; the others what their bytes say."""
    import struct

    from plexaform.functions import quantised as qz

    rnd = random.Random(2)
    q4 = [bytes(rnd.randrange(256) for _ in range(144)) for _ in range(5)]
    q8 = [struct.pack("<f", 0.5 * i) + bytes(rnd.randrange(256) for _ in range(288)) for i in range(5)]
    rows = [(0, None, None), (1, b"", b""), (2, q4[0][:-1], q8[0] + b"x"), *[(3 + i, a, b) for i, (a, b) in enumerate(zip(q4, q8))], (9, None, q8[1])]
    df = spark.createDataFrame([(i, a and bytearray(a) if a is not None else None, b and bytearray(b) if b is not None else None) for i, a, b in rows], "i int, a binary, b binary").repartition(2)
    got = {r["i"]: r for r in df.select("i", qz.parse_q4(F.col("a")).alias("w"), qz.parse_q8(F.col("b")).alias("x"), qz.blob_bytes(F.col("a"), 140, 6).alias("tail"), qz.unpacked(F.col("a"), 16).alias("u"), qz.nibbles(qz.blob_bytes(F.col("a"), 16, 128)).alias("n")).collect()}
    for i, a, b in rows:
        r = got[i]
        assert r["tail"] == (None if a is None else list(a[140:146]))
        if a is None or len(a) != 144:
            assert r["u"] is None and r["w"]["quants"] is None and r["w"]["d"] is None and r["w"]["scales"] is None
        else:
            assert r["w"]["quants"] == [v for g in range(4) for part in (0, 4) for v in ((x >> part) & 15 for x in a[16 + 32 * g:48 + 32 * g])]
            assert r["u"] == r["n"] == r["w"]["quants"]
            d = struct.unpack("<e", a[:2])[0]
            assert r["w"]["d"] == d or d != d
            s = a[4:16]
            assert r["w"]["scales"] == [s[k] & 63 for k in range(4)] + [(s[8 + k] & 15) | (s[k] >> 6) << 4 for k in range(4)]
            assert r["w"]["minima"] == [s[4 + k] & 63 for k in range(4)] + [(s[8 + k] >> 4) | (s[4 + k] >> 6) << 4 for k in range(4)]
        if b is None or len(b) != 292:
            assert r["x"]["quants"] is None
        else:
            assert r["x"]["d"] == struct.unpack("<f", b[:4])[0] and r["x"]["quants"] == list(struct.unpack("256b", b[4:260])) and r["x"]["sums"] == list(struct.unpack("<16h", b[260:]))


def test_recurrence_blocks(spark):
    """Block by block the recurrence gives what a plain loop gives; an undefined value stays undefined from there on."""
    rnd = random.Random(6)
    rows = [(k, i, rnd.gauss(0, 10)) for k in range(3) for i in range(200)]
    rows[450] = (2, 50, float("nan"))
    df = spark.createDataFrame(rows, "k int, i int, v double")
    got = {(r["k"], r["i"]): r["y"] for r in sq.long_recurrence(df, ["i"], "v", 0.875, 0.125, "y", ["k"]).collect()}
    for k in range(3):
        y = 0.0
        for kk, i, v in [r for r in rows if r[0] == k]:
            y = 0.875 * y + 0.125 * v
            assert got[k, i] == (None if y != y else pytest.approx(y, abs=1e-9))
