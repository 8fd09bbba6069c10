"""Queries of the pointwise family: corpus maps, vector functions and scalar derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derived, pointwise as pw
from ..session import load
from .registry import Registry

R = Registry()

X_SQL = "(c_acctbal / CAST(1000 AS DOUBLE))"


def _map(name: str, fn, sql: str) -> None:
    """One map over customers: x is the balance in thousands (negative and positive)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x: Column = F.col("c_acctbal") / F.lit(1000.0)
        return load(spark, sf_dir, "customer").select("c_custkey", fn(x).alias("y"))
    number = sql.replace("#", "::DOUBLE").replace("x", X_SQL)
    R.add(name, f"SELECT c_custkey, {number} AS y FROM customer")(run)


_map("map01_affine", lambda x: pw.affine(x, 1.125, 0.5), "x*1.125#+0.5#")
_map("map02_add", lambda x: pw.shift(x, 3.0), "x+3#")
_map("map03_half", lambda x: pw.divide(x, 2.0), "x/2#")
_map("map04_quarter", lambda x: pw.divide(x, 4.0), "x/4#")
_map("map05_clamp_unit", lambda x: pw.clamp(x, -1.0, 1.0), "CASE WHEN x < -1 THEN -1# WHEN x > 1 THEN 1# ELSE x END")
_map("map06_clamp_positive", lambda x: pw.clamp(x, 0.0, 6.0), "CASE WHEN x < 0 THEN 0# WHEN x > 6 THEN 6# ELSE x END")
_map("map07_abs", pw.branch_abs, "CASE WHEN x < 0 THEN -x ELSE x END")
_map("map08_relu", pw.relu, "CASE WHEN x > 0 THEN x ELSE 0# END")
_map("map09_leaky_relu", pw.leaky_relu, "CASE WHEN x > 0 THEN x ELSE x*0.125# END")
_map("map10_threshold", lambda x: pw.threshold(x, 0.25), "CASE WHEN x > 0.25# THEN 1# ELSE 0# END")
_map("map11_square", lambda x: pw.power(x, 2), "x*x")
_map("map12_cube", lambda x: pw.power(x, 3), "x*x*x")
_map("map13_horner", lambda x: pw.horner(x, [0.25, 0.5, -1.0, 2.0]), "((0.25#*x+0.5#)*x-1#)*x+2#")
_map("map14_reciprocal", lambda x: pw.reciprocal_shift(x, 8.0), "CASE WHEN x + 8# = 0 THEN 'inf'# ELSE 1#/(x+8#) END".replace("inf", "InFiNiTy"))
_map("map15_sign", pw.sign, "CASE WHEN x > 0 THEN 1# WHEN x < 0 THEN -1# ELSE 0# END")
_map("map16_softsign", pw.softsign, "x/(1#+abs(x))")
_map("map17_blend", lambda x: pw.blend(x, 0.25, 0.75), "CASE WHEN x > 0 THEN x*0.75# ELSE x*0.25# END")
_map("map18_dead_zone", lambda x: pw.dead_zone(x, 0.1), "CASE WHEN x > 0.1# THEN x-0.1# WHEN x < -0.1# THEN x+0.1# ELSE 0# END")
_map("map19_gain_gate", lambda x: pw.gain_gate(x, 0.5, 1.5), "CASE WHEN x > 0.5# THEN x*1.5# ELSE x END")
_map("map27_sigmoid", lambda x: F.round(pw.sigmoid(x), 12), "round(CASE WHEN x >= 0 THEN 1#/(1#+e~p(-abs(x))) ELSE e~p(-abs(x))/(1#+e~p(-abs(x))) END, 12)")
R.sql["map27_sigmoid"] = R.sql["map27_sigmoid"].replace("~", "x")
_map("map28_power_bucket", pw.power_bucket, "CASE WHEN x = 0 THEN 0# ELSE sign(x)*pow(2#, floor(log2(abs(x)))) END")
_map("kern14_affine_spellings", lambda x: pw.affine(x, 1.5, 0.125) + pw.affine(x, 0.5, -0.25) + pw.affine(x, 2.0, 1.0), "x*1.5#+0.125#+(x*0.5#-0.25#)+(x*2#+1#)")


@R.add("map20_expression", f"SELECT c_custkey, ({X_SQL}*{X_SQL} + CAST(0.25 AS DOUBLE)) / (abs({X_SQL}) + CAST(1 AS DOUBLE)) AS y FROM customer")
def map20_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "customer").withColumn("x", F.col("c_acctbal") / 1000.0)
    return df.select("c_custkey", pw.expression("(x * x + 0.25) / (abs(x) + 1)", "x").alias("y"))


@R.add("map22_bounded_pointwise", f"SELECT c_custkey AS i, {X_SQL} * CAST(2 AS DOUBLE) + CAST(1 AS DOUBLE) AS y FROM customer WHERE c_custkey < (SELECT count(*) FROM customer)")
def map22_bounded_pointwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointwise map under the bounded index guard i < n, n being the number of elements."""
    c = load(spark, sf_dir, "customer")
    return c.where(F.col("c_custkey") < c.agg(F.count(F.lit(1))).scalar()).select(F.col("c_custkey").alias("i"), pw.affine(F.col("c_acctbal") / 1000.0, 2.0, 1.0).alias("y"))


@R.add("map29_speed_bucket", """SELECT l_orderkey, l_linenumber, CASE WHEN s < -0.10::DOUBLE THEN 'regression_gt_10' WHEN s < -0.03::DOUBLE THEN 'regression_3_to_10' WHEN s <= 0.03::DOUBLE THEN 'tie_minus3_plus3' WHEN s <= 0.10::DOUBLE THEN 'win_3_to_10'
    WHEN s <= 0.50::DOUBLE THEN 'win_10_to_50' ELSE 'win_gt_50' END AS bucket FROM (SELECT *, l_discount * 8 - 0.2::DOUBLE AS s FROM lineitem)""")
def map29_speed_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", derived.speed_bucket(F.col("l_discount") * 8 - F.lit(0.2)).alias("bucket"))


_CATEGORIES = [("attention", "(?i)promo|attn"), ("norm", "(?i)economy"), ("matmul", "(?i)standard|steel"), ("copy", "(?i)small")]


@R.add("map30_category", "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_type, '{p}') THEN '{c}'" for c, p in _CATEGORIES) + " ELSE 'other' END AS category FROM part")
def map30_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", derived.first_match(F.col("p_type"), _CATEGORIES, F.lit("other")).alias("category"))


_COUNTER = "(['sm_l1_hit_pct', 'GPU_Time', 'registers_per_thread', 'lds_bank_stall', 'branch_div_rate', 'tcp_hit', 'flop_count', 'wave_id', 'dram_bytes_in'])[1 + sample_id % 9]"


@R.add("map31_counter_rules", f"SELECT sample_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(n, '{x}')" for x in parts) + f" THEN '{c}/{d}'" for parts, c, d in derived.COUNTER_RULES) + f" ELSE 'vendor_specific/context' END AS kind FROM (SELECT sample_id, lower({_COUNTER}) AS n FROM profile_samples)")
def map31_counter_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("sm_l1_hit_pct", "GPU_Time", "registers_per_thread", "lds_bank_stall", "branch_div_rate", "tcp_hit", "flop_count", "wave_id", "dram_bytes_in")])
    return load(spark, sf_dir, "profile_samples").select("sample_id", derived.counter_kind(names[(F.col("sample_id") % 9).cast("int")]).alias("kind"))


@R.add("map32_link_capacity", """SELECT g, w, round(g * CASE WHEN g >= 8 THEN 128.0::DOUBLE/130 ELSE 0.8::DOUBLE END * w / 8 * 1e9::DOUBLE, 3) AS bytes_per_second
    FROM (SELECT DISTINCT CAST(o_orderkey % 33 AS DOUBLE) AS g, CAST(o_custkey % 17 AS INTEGER) AS w FROM orders)""")
def map32_link_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey % 33 AS DOUBLE) AS g", "CAST(o_custkey % 17 AS INT) AS w").distinct()
    return o.select("g", "w", F.round(derived.link_capacity(F.concat(F.col("g").cast("string"), F.lit(" GT/s PCIe")), F.concat(F.lit("x"), F.col("w").cast("string"))), 3).alias("bytes_per_second"))


@R.add("map33_logical_bytes", """SELECT graph_hash, position, CASE element_type WHEN 'f32' THEN n*4 WHEN 'i32' THEN n*4 WHEN 'f16' THEN n*2 WHEN 'bf16' THEN n*2 WHEN 'i16' THEN n*2 WHEN 'i8' THEN n WHEN 'u8' THEN n END AS logical_bytes FROM (
    SELECT graph_hash, CAST(i-1 AS INTEGER) AS position, edges[i].element_type AS element_type, CAST(list_product(edges[i].shape) AS BIGINT) AS n
    FROM (SELECT DISTINCT graph_hash, edges FROM projection_graphs), unnest(generate_series(1, len(edges))) AS u(i) WHERE edges[i] IS NOT NULL)""")
def map33_logical_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prod(shape) x element size; an unknown type or shape gives NULL."""
    g = load(spark, sf_dir, "projection_graphs").select("graph_hash", "edges").distinct()
    e = g.select("graph_hash", F.posexplode("edges").alias("position", "e")).where("e is not null")
    return e.select("graph_hash", "position", derived.logical_bytes(F.col("e.element_type"), F.col("e.shape")).alias("logical_bytes"))


@R.add("map34_float_error", """SELECT count(*) AS n, max(abs(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) - l_extendedprice)) AS max_abs,
    max(abs(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) - l_extendedprice) / greatest(abs(l_extendedprice), 1e-30::DOUBLE)) AS max_rel, 0::BIGINT AS max_ulp FROM lineitem""")
def map34_float_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single against double precision: largest absolute and relative error, and distance in f32 steps (0: the nearest f32 was taken)."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("r"), F.col("l_extendedprice").cast("float").cast("double").alias("c"))
    err = F.abs(F.col("c") - F.col("r"))
    return li.agg(F.count(F.lit(1)).alias("n"), F.max(err).alias("max_abs"), F.max(err / F.greatest(F.abs("r"), F.lit(1e-30))).alias("max_rel"),
                  F.max(derived.ulp_distance(F.col("r").cast("float"), F.col("c").cast("float"))).alias("max_ulp"))


@R.add("map35_max_error", """SELECT max(abs(b - a)) AS max_abs, max(abs(b - a) / greatest(abs(a), 1e-30::DOUBLE)) AS max_rel FROM (
    SELECT l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem)""")
def map35_max_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    return li.agg(F.max(F.abs(F.col("b") - F.col("a"))).alias("max_abs"), F.max(F.abs(F.col("b") - F.col("a")) / F.greatest(F.abs("a"), F.lit(1e-30))).alias("max_rel"))


@R.add("map36_safe_token", r"""SELECT doc_id, CASE WHEN source IS NULL OR length(source) > 96 OR regexp_matches(source, '[/\\]|\.[a-z]{1,4}$|[0-9a-f]{16,}') OR NOT regexp_full_match(source, '[A-Za-z0-9_.:+-]+') THEN 'other' ELSE source END AS token FROM documents""")
def map36_safe_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", derived.safe_token(F.col("source"), "other").alias("token"))


_PAD = [bytes(k ^ mask for k in b"test-key".ljust(64, b"\0")).hex() for mask in (0x36, 0x5C)]


@R.add("map37_pseudonym", f"SELECT c_custkey, c_name, sha256(unhex('{_PAD[1]}') || unhex(sha256(unhex('{_PAD[0]}') || encode('customer') || unhex('00') || encode(c_name)))) AS pseudonym FROM customer")
def map37_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.pseudonyms(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "customer", b"test-key", "pseudonym")


@R.add("map38_bounded_name", """SELECT doc_id, left(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), 12) || '-' || left(sha256(source || chr(31) || CAST(doc_id AS VARCHAR)), 16) AS name FROM documents""")
def map38_bounded_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", derived.bounded_name(F.col("source"), F.col("doc_id").cast("string"), 12, 16).alias("name"))


@R.add("kern11_widening", "SELECT l_orderkey, l_linenumber, l_partkey AS v0, l_partkey + 1 AS v1, l_partkey + 2 AS v2, l_partkey + 3 AS v3 FROM lineitem")
def kern11_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[(F.col("l_partkey") + i).alias(f"v{i}") for i in range(4)])


@R.add("kern12_copy", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def kern12_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@R.add("kern13_selected_map", "SELECT p_partkey, p_size + 1 AS plus, p_size AS same FROM part")
def kern13_selected_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda v, on: v + 1 if on else v
    return load(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_size"), True).alias("plus"), pick(F.col("p_size"), False).alias("same"))
