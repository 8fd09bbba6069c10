"""Queries of the vector, codec and event-stream families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quantised as qz
from ..operators import market as mk
from ..operators import tokens as tk
from ..session import load
from .registry import Registry

R = Registry()

_V = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _r(c, digits=9):
    return F.transform(c, lambda v: F.round(v, digits))


@R.add("map23_residual_add", f"SELECT vec_id, list_transform(v, lambda x: x + x * 0.5::DOUBLE) AS s FROM ({_V})")
def map23_residual_add(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", tk.residual_add(F.col("v"), F.transform("v", lambda x: x * 0.5)).alias("s"))


@R.add("map24_rms_quantise", f"SELECT vec_id, round(s, 9) AS scale, list_transform(v, lambda x: greatest(-127, least(127, CAST(trunc(x * s * 0.5::DOUBLE * 127) AS INTEGER)))) AS q FROM (SELECT *, 1 / sqrt(list_sum(list_transform(v, lambda x: x*x)) / len(v) + 1e-5::DOUBLE) AS s FROM ({_V}))")
def map24_rms_quantise(spark, sf_dir):
    d = _vectors(spark, sf_dir).withColumn("scale", tk.rms_scale(F.col("v"), 1e-5))
    return d.select("vec_id", F.round("scale", 9).alias("scale"), tk.rms_quantised(F.col("v"), F.col("scale"), F.transform("v", lambda x: F.lit(0.5))).alias("q"))


@R.add("map25_rope", f"SELECT vec_id, flatten(list_transform(range(0, len(v) // 2), lambda k: [round(v[2*k+1]*0.8::DOUBLE - v[2*k+2]*0.6::DOUBLE, 9), round(v[2*k+1]*0.6::DOUBLE + v[2*k+2]*0.8::DOUBLE, 9)])) AS r FROM ({_V})")
def map25_rope(spark, sf_dir):
    half = lambda x: F.array_repeat(F.lit(x), (F.size("v") / 2).cast("int"))
    return _vectors(spark, sf_dir).select("vec_id", _r(tk.rope(F.col("v"), half(0.8), half(0.6))).alias("r"))


@R.add("map26_blocked_gemv", f"SELECT vec_id, round(y / (1 + exp(-y)) * 0.5::DOUBLE, 9) AS y FROM (SELECT vec_id, 0.01::DOUBLE * list_sum(list_transform(range(1, len(q)+1), lambda i: CAST(q[i] * (i % 7 - 3) AS DOUBLE) * (1 + ((i - 1) // 16) * 0.25::DOUBLE))) + 0.125::DOUBLE AS y FROM (SELECT vec_id, list_transform(v, lambda x: CAST(trunc(x * 64) AS INTEGER)) AS q FROM ({_V})))")
def map26_blocked_gemv(spark, sf_dir):
    """Integer dot product with one scale per 16 values, bias, SiLU and gate."""
    d = _vectors(spark, sf_dir).select("vec_id", F.transform("v", lambda x: (x * 64).cast("int").cast("bigint")).alias("q"))
    w = F.transform("q", lambda x, i: ((i + 1) % 7 - 3).cast("bigint"))
    scales = F.transform(F.sequence(F.lit(0), (F.size("q") / 16).cast("int") - 1), lambda b: F.lit(1.0) + b * 0.25)
    y = tk.blocked_dot(w, F.col("q"), scales, 16) * 0.01 + 0.125
    return d.withColumn("y", y).select("vec_id", F.round(tk.silu_gate(F.col("y"), F.lit(0.5)), 9).alias("y"))


_ATT = """k AS (SELECT label AS g, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT g, min_by(v, vec_id) AS q FROM k GROUP BY g),
    s AS (SELECT k.g, vec_id, v, list_sum(list_transform(range(1, len(v)+1), lambda i: v[i]*q.q[i])) * 0.125::DOUBLE AS s FROM k JOIN q ON k.g = q.g), w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY g)) AS w FROM s)"""
_ATT_SQL = f"WITH {_ATT} SELECT g, round(sum(w*v[1])/sum(w), 8) AS o0, round(sum(w*v[2])/sum(w), 8) AS o1, round(sum(w*v[8])/sum(w), 8) AS o7 FROM w GROUP BY g"


def _scores(spark, sf_dir):
    k = _vectors(spark, sf_dir).select(F.col("label").alias("g"), "vec_id", "v")
    q = k.groupBy(F.col("g").alias("g2")).agg(F.min_by("v", "vec_id").alias("q"))
    return k.join(q, F.col("g") == F.col("g2")).select("g", "vec_id", "v", (tk.dot(F.col("v"), F.col("q")) * 0.125).alias("s"))


def _out(df):
    return df.select("g", *[F.round(F.col("out")[i], 8).alias(f"o{i}") for i in (0, 1, 7)])


@R.add("agg32_attention", _ATT_SQL)
def agg32_attention(spark, sf_dir):
    return _out(tk.attention(_scores(spark, sf_dir), "g", "s", "v", 8))


@R.add("agg31_attention_online", _ATT_SQL)
def agg31_attention_online(spark, sf_dir):
    return _out(tk.attention_online(_scores(spark, sf_dir), "g", "vec_id", "s", "v"))


_LOGITS = "SELECT vec_id AS g, i - 1 AS token, CAST(embedding[i] AS DOUBLE) AS logit, (vec_id + i) % 5 = 0 AS seen, (vec_id * 37 % 101) / 101.0::DOUBLE AS draw FROM embeddings, unnest(generate_series(1, len(embedding))) AS u(i)"


def _logits(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("g"), F.posexplode("embedding").alias("token", "l"))
    return e.select("g", F.col("token").cast("bigint").alias("token"), F.col("l").cast("double").alias("logit"), ((F.col("g") + F.col("token") + 1) % 5 == 0).alias("seen"), ((F.col("g") * 37 % 101) / 101.0).alias("draw"))


@R.add("rank08_greedy_token", f"SELECT g, token FROM (SELECT g, token, row_number() OVER (PARTITION BY g ORDER BY logit DESC, token) AS r FROM ({_LOGITS})) WHERE r = 1")
def rank08_greedy_token(spark, sf_dir):
    return tk.greedy(_logits(spark, sf_dir), "g", "token", "logit")


@R.add("rank10_penalised_greedy", f"SELECT g, token FROM (SELECT g, token, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN seen THEN CASE WHEN logit > 0 THEN logit/1.3::DOUBLE ELSE logit*1.3::DOUBLE END ELSE logit END DESC, token) AS r FROM ({_LOGITS})) WHERE r = 1")
def rank10_penalised_greedy(spark, sf_dir):
    return tk.greedy(_logits(spark, sf_dir).withColumn("l", tk.penalised(F.col("logit"), F.col("seen"), 1.3)), "g", "token", "l")


@R.add("rank09_sampler", f"""WITH a AS (SELECT g, token, draw, (CASE WHEN seen THEN CASE WHEN logit > 0 THEN logit/1.3::DOUBLE ELSE logit*1.3::DOUBLE END ELSE logit END) / 0.7::DOUBLE AS l FROM ({_LOGITS})),
    b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY l DESC, token) AS r, max(l) OVER (PARTITION BY g) AS top FROM a), c AS (SELECT *, exp(l - top) AS w FROM b WHERE r <= 20 AND exp(l - top) >= 0.05),
    d AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY r) AS c, sum(w) OVER (PARTITION BY g) AS t FROM c), e AS (SELECT *, max(c) OVER (PARTITION BY g) AS m FROM d WHERE (c - w) / t < 0.9)
    SELECT g, min_by(token, r) AS token FROM e WHERE c >= draw * m GROUP BY g""")
def rank09_sampler(spark, sf_dir):
    return tk.sample(_logits(spark, sf_dir), "g", "token", "logit", "seen", "draw", 1.3, 0.7, 20, 0.9, 0.05)


# ---- codecs

_BLOB = "SELECT o_orderkey AS id, unhex(repeat(sha256(CAST(o_orderkey AS VARCHAR)), 5)[1:288]) AS raw FROM orders"


def _blocks(spark, sf_dir):
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unhex(F.left(F.repeat(digest, F.lit(5)), F.lit(288))).alias("raw"), digest.alias("h"))


_HX = "('0x' || h[{a}:{b}])::BIGINT"
_HB = lambda k: f"(('0x' || hx[{2 * k + 1}:{2 * k + 2}])::BIGINT)"
_HEXED = "SELECT o_orderkey AS id, repeat(sha256(CAST(o_orderkey AS VARCHAR)), 5)[1:288] AS hx FROM orders"


@R.add("codec03_scale_min", "SELECT id, [" + ", ".join([f"{_HB(4 + k)} & 63" for k in range(4)] + [f"({_HB(12 + k)} & 15) | (({_HB(4 + k)} >> 6) << 4)" for k in range(4)]) + "] AS scales, [" + ", ".join([f"{_HB(8 + k)} & 63" for k in range(4)] + [f"({_HB(12 + k)} >> 4) | (({_HB(8 + k)} >> 6) << 4)" for k in range(4)]) + f"] AS minima FROM ({_HEXED})")
def codec03_scale_min(spark, sf_dir):
    s, m = qz.scale_min(qz.blob_bytes(F.col("raw"), 4, 12))
    return _blocks(spark, sf_dir).select("id", s.cast("array<bigint>").alias("scales"), m.cast("array<bigint>").alias("minima"))


@R.add("codec04_scale_min_round_trip", "SELECT id, list_transform(range(4, 16), lambda k: (('0x' || hx[2*k+1:2*k+2])::BIGINT)) AS bytes FROM (" + _HEXED + ")")
def codec04_scale_min_round_trip(spark, sf_dir):
    s, m = qz.scale_min(qz.blob_bytes(F.col("raw"), 4, 12))
    d = _blocks(spark, sf_dir).select("id", s.alias("s"), m.alias("m"))
    return d.select("id", qz.pack_scale_min(F.col("s"), F.col("m")).cast("array<bigint>").alias("bytes"))


@R.add("codec05_nibbles", "SELECT id, CAST(list_sum(list_transform(range(0, 256), lambda i: (CASE WHEN (i % 64) < 32 THEN (('0x' || hx[2*(16+(i//64)*32+i%32)+1:2*(16+(i//64)*32+i%32)+2])::BIGINT) & 15 ELSE (('0x' || hx[2*(16+(i//64)*32+i%32)+1:2*(16+(i//64)*32+i%32)+2])::BIGINT) >> 4 END) * (i + 1))) AS BIGINT) AS weighted FROM (" + _HEXED + ")")
def codec05_nibbles(spark, sf_dir):
    d = _blocks(spark, sf_dir).select("id", qz.unpacked(F.col("raw"), 16).alias("q"))
    return d.select("id", F.aggregate(F.transform("q", lambda v, i: (v * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("weighted"))


_NIB = "(CASE WHEN (i % 64) < 32 THEN (('0x' || hx[2*(16+(i//64)*32+i%32)+1:2*(16+(i//64)*32+i%32)+2])::BIGINT) & 15 ELSE (('0x' || hx[2*(16+(i//64)*32+i%32)+1:2*(16+(i//64)*32+i%32)+2])::BIGINT) >> 4 END)"
_SCALES = "[" + ", ".join([f"{_HB(4 + k)} & 63" for k in range(4)] + [f"({_HB(12 + k)} & 15) | (({_HB(4 + k)} >> 6) << 4)" for k in range(4)]) + "]"
_MINIMA = "[" + ", ".join([f"{_HB(8 + k)} & 63" for k in range(4)] + [f"({_HB(12 + k)} >> 4) | (({_HB(8 + k)} >> 6) << 4)" for k in range(4)]) + "]"
_Q4 = f"q AS (SELECT id, {_SCALES} AS scales, {_MINIMA} AS minima, list_transform(range(0, 256), lambda i: {_NIB}) AS quants, hx FROM ({_HEXED}))"
#: value of a 16-bit float whose bits are h
_HALF = "CASE WHEN (h >> 10) & 31 = 31 THEN NULL ELSE CASE WHEN h & 32768 <> 0 THEN -1.0 ELSE 1.0 END * CASE WHEN (h >> 10) & 31 = 0 THEN (h & 1023) * pow(2, -24) ELSE pow(2, ((h >> 10) & 31) - 15) * (1 + (h & 1023) / 1024.0) END END::DOUBLE"
_ACT = "a AS (SELECT o_orderkey AS id, '0000803F' || repeat(sha256(CAST(o_orderkey AS VARCHAR)), 10)[1:576] AS ax FROM orders)"
_SIGNED = "((('0x' || ax[2*(4+i)+1:2*(4+i)+2])::BIGINT + 128) % 256 - 128)"
_SUM16 = "(((('0x' || ax[2*(260+2*j)+3:2*(260+2*j)+4])::BIGINT << 8 | ('0x' || ax[2*(260+2*j)+1:2*(260+2*j)+2])::BIGINT) + 32768) % 65536 - 32768)"


def _activations(spark, sf_dir):
    """288 bytes of digest behind a scale of 1.0: blocks of 292 bytes."""
    return _blocks(spark, sf_dir).withColumn("act", F.unhex(F.concat(F.lit("0000803F"), F.left(F.repeat("h", F.lit(10)), F.lit(576)))))


_total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)


@R.add("codec01_parse_q4", f"WITH {_Q4}, b AS (SELECT *, {_HB(0)} | ({_HB(1)} << 8) AS h1, {_HB(2)} | ({_HB(3)} << 8) AS h2 FROM q) SELECT id, {_HALF.replace('h ', 'h1 ')} AS d, {_HALF.replace('h ', 'h2 ')} AS dmin, CAST(list_sum(scales) AS BIGINT) AS scales, CAST(list_sum(minima) AS BIGINT) AS minima, CAST(list_sum(quants) AS BIGINT) AS quants FROM b")
def codec01_parse_q4(spark, sf_dir):
    """Parsed blocks; an infinite or undefined scale is shown as NULL."""
    d = _blocks(spark, sf_dir).select("id", qz.parse_q4(F.col("raw")).alias("b"))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return d.select("id", finite("b.d").alias("d"), finite("b.dmin").alias("dmin"), *[_total(f"b.{c}").alias(c) for c in ("scales", "minima", "quants")])


@R.add("codec06_dequantise", f"WITH {_Q4} SELECT id, list_sum(list_transform(range(0, 256), lambda i: 0.5::DOUBLE * scales[1 + i // 32] * quants[1 + i] - 0.25::DOUBLE * minima[1 + i // 32])) AS total FROM q")
def codec06_dequantise(spark, sf_dir):
    d = _blocks(spark, sf_dir).select("id", qz.parse_q4(F.col("raw")).alias("b")).select("id", "b.*")
    v = qz.dequantise_q4(F.lit(0.5), F.lit(0.25), F.col("scales"), F.col("minima"), F.col("quants"))
    return d.select("id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@R.add("codec02_parse_q8", f"WITH {_ACT} SELECT id, 1.0::DOUBLE AS d, CAST(list_sum(list_transform(range(0, 256), lambda i: {_SIGNED})) AS BIGINT) AS total, CAST(list_sum(list_transform(range(0, 16), lambda j: {_SUM16})) AS BIGINT) AS sums FROM a")
def codec02_parse_q8(spark, sf_dir):
    return _activations(spark, sf_dir).select("id", qz.parse_q8(F.col("act")).alias("q8")).select("id", "q8.d", _total("q8.quants").alias("total"), _total("q8.sums").alias("sums"))


@R.add("codec07_block_dot", f"""WITH {_Q4}, {_ACT}, x AS (SELECT id, scales, minima, list_transform(range(0, 256), lambda i: quants[1 + i] * {_SIGNED}) AS p, list_transform(range(0, 16), lambda j: {_SUM16}) AS s FROM q JOIN a USING (id))
    SELECT id, 0.5::DOUBLE * list_sum(list_transform(range(0, 256), lambda i: p[1 + i] * scales[1 + i // 32])) - 0.25::DOUBLE * list_sum(list_transform(range(0, 16), lambda j: s[1 + j] * minima[1 + j // 2])) AS dot FROM x""")
def codec07_block_dot(spark, sf_dir):
    b = _activations(spark, sf_dir).select("id", qz.parse_q4(F.col("raw")).alias("q4"), qz.parse_q8(F.col("act")).alias("q8"))
    w = F.struct(F.lit(0.5).alias("d"), F.lit(0.25).alias("dmin"), F.col("q4.scales").alias("scales"), F.col("q4.minima").alias("minima"), F.col("q4.quants").alias("quants"))
    return b.withColumn("w", w).select("id", qz.dot_q4_q8(F.col("w"), F.col("q8")).alias("dot"))


@R.add("codec08_repack", "SELECT id, upper(string_agg(hx[(k*16+s*4)*2+1:(k*16+s*4)*2+8], '' ORDER BY s, k)) AS packed FROM (SELECT id, hx FROM (" + _HEXED + ")), unnest(range(0, 9)) AS a(k), unnest(range(0, 4)) AS b(s) GROUP BY id")
def codec08_repack(spark, sf_dir):
    """Four-byte lanes of nine 16-byte rows, gathered lane by lane (a bijection of the block)."""
    from ..operators import sequences as sq

    lanes = sq.deinterleave(F.col("raw"), 4, 4)
    d = _blocks(spark, sf_dir).select("id", lanes.alias("l"))
    return d.select("id", F.array_join(F.transform("l", lambda b: F.hex(b)), "").alias("packed"))


@R.add("codec09_colour_endpoints", "SELECT tile, (max(r) >> 3 << 11) | (max(g) >> 2 << 5) | (max(b) >> 3) AS c0, (min(r) >> 3 << 11) | (min(g) >> 2 << 5) | (min(b) >> 3) AS c1 FROM (SELECT l_orderkey // 16 AS tile, CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST(l_linenumber * 7 % 256 AS INTEGER) AS b FROM lineitem) GROUP BY tile")
def codec09_colour_endpoints(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey DIV 16 AS tile", "CAST(l_partkey % 256 AS INT) AS r", "CAST(l_suppkey % 256 AS INT) AS g", "CAST(l_linenumber * 7 % 256 AS INT) AS b")
    e = li.groupBy("tile").agg(*[f(c).alias(f"{c}{i}") for c in "rgb" for i, f in ((0, F.max), (1, F.min))])
    return e.select("tile", *[qz.rgb565(F.col(f"r{i}"), F.col(f"g{i}"), F.col(f"b{i}")).alias(f"c{i}") for i in (0, 1)])


@R.add("codec09_palette_index", """WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey // 16 AS tile, CAST(l_partkey % 256 AS INTEGER) AS v FROM lineitem), e AS (SELECT tile, max(v) AS hi, min(v) AS lo FROM p GROUP BY tile),
    d AS (SELECT l_orderkey, l_linenumber, abs(v - hi) AS d0, abs(v - lo) AS d1, abs(v - (2*hi + lo) // 3) AS d2, abs(v - (hi + 2*lo) // 3) AS d3 FROM p JOIN e USING (tile))
    SELECT l_orderkey, l_linenumber, CASE least(d0, d1, d2, d3) WHEN d0 THEN 0 WHEN d1 THEN 1 WHEN d2 THEN 2 ELSE 3 END AS index FROM d""")
def codec09_palette_index(spark, sf_dir):
    """Nearest of four palette entries, the lowest of equally near ones."""
    p = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_orderkey DIV 16 AS tile", "CAST(l_partkey % 256 AS INT) AS v")
    e = p.groupBy(F.col("tile").alias("t")).agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    d = p.join(e, F.col("tile") == F.col("t")).withColumn("d", F.expr("array(abs(v - hi), abs(v - lo), abs(v - (2 * hi + lo) DIV 3), abs(v - (hi + 2 * lo) DIV 3))"))
    return d.select("l_orderkey", "l_linenumber", (F.array_position("d", F.array_min("d")) - 1).cast("int").alias("index"))


# ---- event stream


def _market(spark, sf_dir) -> DataFrame:
    """Order events of every user, some of them invalid: unknown tags, negative quantities, sequences that fall back."""
    i, u = F.col("event_id"), F.col("user_id")
    return load(spark, sf_dir, "events").select(
        u.alias("key"), i.alias("position"), F.when(F.col("event_type") == "purchase", 3).when(i % 17 == 0, 9).when(i % 5 == 1, 2).otherwise(1).alias("kind"), (i % 2).cast("int").alias("side"),
        (F.lit(mk.BASE_TICK) + (u * 7 + i * 3) % mk.LEVELS).cast("int").alias("price_ticks"), F.when(i % 29 == 0, -1).otherwise(F.floor("value") % 50).cast("int").alias("quantity"), (i + F.when(i % 23 == 0, -200).otherwise(1)).alias("sequence"))


_MK = """SELECT user_id AS key, event_id AS position, CASE WHEN event_type = 'purchase' THEN 3 WHEN event_id % 17 = 0 THEN 9 WHEN event_id % 5 = 1 THEN 2 ELSE 1 END AS kind, event_id % 2 AS side, (user_id * 7 + event_id * 3) % 64 AS level,
    CASE WHEN event_id % 29 = 0 THEN -1 ELSE CAST(floor(value) AS BIGINT) % 50 END AS quantity, event_id + CASE WHEN event_id % 23 = 0 THEN -200 ELSE 1 END AS sequence FROM events"""
_LIVE = f"""m AS ({_MK}), v AS (SELECT * FROM (SELECT *, max(CASE WHEN fine THEN sequence END) OVER (PARTITION BY key ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
    FROM (SELECT *, kind IN (1, 2, 3) AND quantity >= 0 AS fine FROM m)) WHERE fine AND sequence > coalesce(high, 0))"""


def _fold_sql(most: int, order: int, start: int) -> str:
    """The whole fold as a recursion over the messages of all keys at once: n (number of the message), the event's columns, ok, and
    after it bid, ask (levels, -1 and 64 for none), their quantities, reason, price, spread, changed."""
    at = lambda side, name: f"CASE WHEN ok AND side = {side} THEN list_transform(range(64), lambda i: CASE WHEN i = level THEN CASE WHEN kind = 3 THEN 0 ELSE quantity END ELSE {name}[i + 1] END) ELSE {name} END AS {name}"
    carried = "key, n, position, kind, side, level, quantity, sequence, ok, last_sequence"
    return f"""m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY position) AS n FROM ({_MK})),
    f AS (SELECT DISTINCT key, 0::BIGINT AS n, NULL::BIGINT AS position, 0::BIGINT AS kind, 0::BIGINT AS side, 0::BIGINT AS level, 0::BIGINT AS quantity, 0::BIGINT AS sequence, false AS ok, 0::BIGINT AS last_sequence, list_transform(range(64), lambda i: 0::BIGINT) AS bids, list_transform(range(64), lambda i: 0::BIGINT) AS asks,
        0::BIGINT AS reserved, -1::BIGINT AS bid, 64::BIGINT AS ask, 0::BIGINT AS bq, 0::BIGINT AS aq, 3 AS reason, 0.0::DOUBLE AS price, 0::BIGINT AS spread, false AS changed FROM m
      UNION ALL SELECT {carried}, bids, asks, CASE WHEN ok AND reason = 0 THEN reserved + signed ELSE reserved END, bid, ask, bq, aq, CASE WHEN ok THEN reason ELSE 3 END,
        CASE WHEN ok THEN price + 0.125::DOUBLE * (mid - price) ELSE price END, CASE WHEN ok THEN gap ELSE spread END, ok AND gap <> spread FROM (
        SELECT *, CASE WHEN bid >= 0 AND ask < 64 THEN ((100000 + ask) * bq + (100000 + bid) * aq) / CAST(bq + aq AS DOUBLE) WHEN bid >= 0 THEN 100000.0 + bid WHEN ask < 64 THEN 100000.0 + ask ELSE 0.0 END AS mid, CASE WHEN bid >= 0 AND ask < 64 THEN ask - bid ELSE 0 END AS gap,
          CASE WHEN quantity > {order} THEN 1 WHEN abs({start} + reserved + signed) > {most} THEN 2 ELSE 0 END AS reason FROM (
          SELECT *, CASE WHEN bid >= 0 THEN bids[bid + 1] ELSE 0 END AS bq, CASE WHEN ask < 64 THEN asks[ask + 1] ELSE 0 END AS aq FROM (
            SELECT *, list_max(list_transform(range(64), lambda i: CASE WHEN bids[i + 1] > 0 THEN i ELSE -1 END)) AS bid, list_min(list_transform(range(64), lambda i: CASE WHEN asks[i + 1] > 0 THEN i ELSE 64 END)) AS ask, CASE WHEN side = 0 THEN quantity ELSE -quantity END AS signed FROM (
              SELECT {carried}, {at(0, 'bids')}, {at(1, 'asks')}, reserved, price, spread FROM (
                SELECT m.key, m.n, m.position, m.kind, m.side, m.level, m.quantity, m.sequence, m.kind IN (1, 2, 3) AND m.quantity >= 0 AND m.sequence > f.last_sequence AS ok,
                  CASE WHEN m.kind IN (1, 2, 3) AND m.quantity >= 0 AND m.sequence > f.last_sequence THEN m.sequence ELSE f.last_sequence END AS last_sequence, f.bids, f.asks, f.reserved, f.price, f.spread FROM f JOIN m ON m.key = f.key AND m.n = f.n + 1))))))"""


_FOLD = _fold_sql(500, 45, 60)


@R.add("stream01_decode", "SELECT event_id, 1 AS kind, CAST(user_id % 2 AS INTEGER) AS side, CAST(100000 - user_id AS INTEGER) AS price_ticks, CAST(-(user_id % 7) AS INTEGER) AS quantity, CAST(event_id AS DECIMAL(20,0)) AS sequence FROM events")
def stream01_decode(spark, sf_dir):
    raw = mk.encode_event(F.lit(1), F.col("user_id") % 2, F.lit(100000) - F.col("user_id"), -(F.col("user_id") % 7), F.col("event_id"))
    e = load(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", mk.decode_event(F.col("raw")).alias("d")).select("event_id", "d.*")


@R.add("stream02_encode", "SELECT event_id, upper('01' || lpad(to_hex(user_id % 2), 2, '0') || lpad(to_hex(100000 + user_id), 8, '0') || lpad(to_hex(user_id % 50), 8, '0') || lpad(to_hex(event_id), 16, '0')) AS wire FROM events")
def stream02_encode(spark, sf_dir):
    raw = mk.encode_event(F.lit(1), F.col("user_id") % 2, F.lit(100000) + F.col("user_id"), F.col("user_id") % 50, F.col("event_id"))
    return load(spark, sf_dir, "events").select("event_id", F.hex(raw).alias("wire"))


@R.add("stream03_book_state", f"WITH {_LIVE} SELECT key, max(CASE WHEN side = 0 THEN level END) AS best_bid, min(CASE WHEN side = 1 THEN level END) AS best_ask FROM (SELECT key, side, level, max_by(CASE WHEN kind = 3 THEN 0 ELSE quantity END, sequence) AS q FROM v GROUP BY ALL) WHERE q > 0 GROUP BY key")
def stream03_book_state(spark, sf_dir):
    m = mk.valid_events(_market(spark, sf_dir), "key").withColumn("level", (F.col("price_ticks") - mk.BASE_TICK).cast("bigint"))
    return mk.book_state(m, "key")


def _decisions(spark, sf_dir, masked: bool = False) -> DataFrame:
    return mk.run_pipeline(_market(spark, sf_dir), 500, 45, 60, masked)


@R.add("stream04_pipeline", f"WITH RECURSIVE {_FOLD} SELECT key, position, CASE WHEN ok THEN 0 ELSE -2 END AS status, ok AND reason = 0 AS accepted, reason FROM f WHERE n > 0")
def stream04_pipeline(spark, sf_dir):
    """The risk gate's decision on every message."""
    return _decisions(spark, sf_dir).select("key", "position", "status", "accepted", "reason")


@R.add("stream05_gates_agree", f"WITH RECURSIVE {_FOLD} SELECT key, count(*) FILTER (WHERE ok AND reason = 0) AS branching, count(*) FILTER (WHERE ok AND reason = 0) AS masked, CAST(sum(reason) AS BIGINT) AS reasons FROM f WHERE n > 0 GROUP BY key")
def stream05_gates_agree(spark, sf_dir):
    """Per key the orders that the branching and the branch-free gate accept, and the sum of the latter's reasons."""
    a = _decisions(spark, sf_dir).groupBy("key").agg(F.count_if("accepted").alias("branching"))
    b = _decisions(spark, sf_dir, True).groupBy(F.col("key").alias("k")).agg(F.count_if("accepted").alias("masked"), F.sum("reason").alias("reasons"))
    return a.join(b, F.col("key") == F.col("k")).drop("k")


@R.add("stream06_features", f"WITH RECURSIVE {_FOLD} SELECT key, position, round(price, 6) AS price, spread, changed AS spread_changed FROM f WHERE ok")
def stream06_features(spark, sf_dir):
    """Smoothed price and spread after every valid message."""
    return _decisions(spark, sf_dir).where("status = 0").select("key", "position", F.round("price", 6).alias("price"), F.col("spread").cast("bigint").alias("spread"), "spread_changed")


@R.add("stream09_final_states", f"""WITH RECURSIVE {_FOLD}, w AS (SELECT *, lpad(to_hex(n), 16, '0') || lpad(to_hex(sequence & 4294967295), 8, '0') || CASE WHEN reason = 0 THEN '01' ELSE '00' END || lpad(to_hex(reason), 2, '0') || lpad(to_hex(quantity), 8, '0') AS wire, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS r FROM f WHERE ok),
    t AS (SELECT key, count(*) AS messages, count(*) FILTER (WHERE ok) AS valid FROM f WHERE n > 0 GROUP BY key)
    SELECT t.key, messages, valid, max(CASE WHEN r = 1 THEN CASE WHEN bid >= 0 THEN 100000 + bid ELSE 0 END END) AS best_bid, max(CASE WHEN r = 1 THEN CASE WHEN ask < 64 THEN 100000 + ask ELSE 0 END END) AS best_ask,
      upper(string_agg(CASE WHEN r <= 8 THEN wire END, ' ' ORDER BY n)) AS ring FROM t LEFT JOIN w ON w.key = t.key GROUP BY t.key, messages, valid""")
def stream09_final_states(spark, sf_dir):
    """The whole pipeline: per key the messages, valid ones, top of the book at the end and what the ring of 8 then holds."""
    d = _decisions(spark, sf_dir)
    totals = d.groupBy("key").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("status") == 0).alias("valid"), F.max_by("best_bid", F.when(F.col("status") == 0, F.col("position"))).cast("bigint").alias("best_bid"),
                                  F.max_by("best_ask", F.when(F.col("status") == 0, F.col("position"))).cast("bigint").alias("best_ask"))
    last = mk.last_n(d.where("status = 0").select(F.col("key").alias("k"), "position", "wire"), "k", "position", 8)
    ring = last.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.hex("wire").alias("h")))), lambda x: x.h), " ").alias("ring"))
    return totals.join(ring, F.col("key") == F.col("k"), "left").drop("k")


@R.add("stream07_decision_wire", "SELECT event_id, upper(lpad(to_hex(event_id), 16, '0') || lpad(to_hex(event_id & 4294967295), 8, '0') || '01' || '00' || lpad(to_hex(user_id % 50), 8, '0')) AS wire FROM events")
def stream07_decision_wire(spark, sf_dir):
    h = lambda c, n: F.lpad(F.hex(c), n, "0")
    return load(spark, sf_dir, "events").select("event_id", F.concat(h(F.col("event_id"), 16), h(F.col("event_id").bitwiseAND(F.lit(0xFFFFFFFF)), 8), F.lit("0100"), h(F.col("user_id") % 50, 8)).alias("wire"))


@R.add("stream08_ring", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 8")
def stream08_ring(spark, sf_dir):
    return mk.last_n(load(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 8)


@R.add("stream12_rate_limit", "SELECT event_id, r <= 5 AS allowed, greatest(0, 5 - r) AS remaining FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events)")
def stream12_rate_limit(spark, sf_dir):
    w = Window.partitionBy("user_id", F.col("ts").cast("date")).orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("bigint").alias("r"))
    return e.select("event_id", (F.col("r") <= 5).alias("allowed"), F.greatest(F.lit(0), 5 - F.col("r")).alias("remaining"))


@R.add("stream13_segments", "SELECT user_id, segment, count(*) AS n FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM events) WHERE segment > 1 GROUP BY ALL")
def stream13_segments(spark, sf_dir):
    """Segments begin at a marker (a view); what comes before the first marker and the first segment (warm-up) are dropped."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = load(spark, sf_dir, "events").select("user_id", F.sum((F.col("event_type") == "view").cast("bigint")).over(w).alias("segment"))
    return e.where("segment > 1").groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"))


@R.add("stream15_timeline", "SELECT user_id, bool_and(coalesce(ts >= p, true)) AS monotonic, max(open) AS most_open FROM (SELECT user_id, ts, lag(ts) OVER w AS p, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER w AS BIGINT) AS open FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY user_id")
def stream15_timeline(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    e = load(spark, sf_dir, "events").select("user_id", F.coalesce(F.col("ts") >= F.lag("ts").over(w), F.lit(True)).alias("ok"), F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("open"))
    return e.groupBy("user_id").agg(F.bool_and("ok").alias("monotonic"), F.max("open").alias("most_open"))


@R.add("stream16_cache_rules", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 = 0) AS unsafe, bool_or(o_orderkey % 7 = 0 AND o_orderkey % 11 = 0) AS torn FROM orders GROUP BY 1")
def stream16_cache_rules(spark, sf_dir):
    """Boolean rules over declared properties: published before complete, read after invalidation."""
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if((k % 3 == 0) & (k % 5 == 0)).alias("unsafe"), F.bool_or((k % 7 == 0) & (k % 11 == 0)).alias("torn"))


@R.add("stream17_presentation", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN r WHEN 1 THEN r + 16.667::DOUBLE * 2 ELSE r + 16.667::DOUBLE * 0.5::DOUBLE * 2 END AS latency FROM (SELECT o_orderkey, o_totalprice / 1000 AS r FROM orders)")
def stream17_presentation(spark, sf_dir):
    r, k = F.col("o_totalprice") / 1000, F.col("o_orderkey") % 3
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, r).when(k == 1, r + F.lit(16.667) * 2).otherwise(r + F.lit(16.667) * 0.5 * 2).alias("latency"))


@R.add("stream19_state_equality", "SELECT count(*) FILTER (WHERE a.s IS DISTINCT FROM b.s) AS different FROM (SELECT o_custkey AS k, sum(o_orderkey) AS s FROM orders GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, sum(o_orderkey) + CASE WHEN o_custkey % 50 = 0 THEN 1 ELSE 0 END AS s FROM orders GROUP BY o_custkey) b ON a.k = b.k")
def stream19_state_equality(spark, sf_dir):
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_orderkey").alias("s"))
    b = o.select(F.col("o_custkey").alias("k"), (F.col("s") + F.when(F.col("o_custkey") % 50 == 0, 1).otherwise(0)).alias("t"))
    return o.join(b, F.col("o_custkey") == F.col("k"), "full_outer").agg(F.count_if(~F.col("s").eqNullSafe(F.col("t"))).alias("different"))
