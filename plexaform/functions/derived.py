"""Derived scalars: buckets, categories, capacities, sizes, error measures, safe names."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Substrings of a counter's name, its category and its preferred direction; the first rule that matches counts.
COUNTER_RULES = [
    (("occupancy_limit_registers",), "register_occupancy_limit", "higher"),
    (("occupancy_limit_shared_mem",), "shared_memory_occupancy_limit", "higher"),
    (("occupancy_limit_warps",), "warp_occupancy_limit", "higher"),
    (("registers_per_thread_allocated",), "allocated_registers_per_thread", "lower"),
    (("registers_per_thread",), "registers_per_thread", "lower"),
    (("shared_mem_per_block",), "shared_bytes_per_block", "lower"),
    (("stack_size",), "stack_bytes", "lower"),
    (("waves_per_multiprocessor",), "waves_per_multiprocessor", "context"),
    (("occupancy", "active_warps", "waves_per"), "occupancy", "higher"),
    (("dram_bytes", "device_memory_bytes", "bytes_read", "bytes_write"), "dram_bytes", "lower"),
    (("global_load", "global_op_ld", "read_transactions", "tcc_ea_rdreq"), "global_load_transactions", "lower"),
    (("global_store", "global_op_st", "write_transactions", "tcc_ea_wrreq"), "global_store_transactions", "lower"),
    (("l2_hit", "lts__t_sector_hit", "tcp_hit"), "l2_hit_rate", "higher"),
    (("l1_hit", "l1tex__t_sector_hit"), "l1_hit_rate", "higher"),
    (("shared_bank", "lds_bank"), "shared_bank_conflicts", "lower"),
    (("barrier", "wait_inst_barrier"), "barrier_stalls", "lower"),
    (("memory_stall", "long_scoreboard", "alu_stalled"), "memory_stalls", "lower"),
    (("branch_div", "divergent_branch"), "branch_divergence", "lower"),
    (("instructions", "inst_executed", "sq_insts"), "instructions", "lower"),
    (("throughput", "flop", "ipc"), "compute_throughput", "higher"),
    (("gpu_time", "duration"), "instrumented_gpu_time", "lower"),
]
# Bytes of one element.
ELEMENT_BYTES = {"i8": 1, "u8": 1, "i16": 2, "u16": 2, "f16": 2, "bf16": 2, "i32": 4, "u32": 4, "f32": 4, "i64": 8, "u64": 8, "f64": 8}


# Names of the speed buckets, slowest first.
SPEED_BUCKETS = ("regression_gt_10", "regression_3_to_10", "tie_minus3_plus3", "win_3_to_10", "win_10_to_50", "win_gt_50")


def speed_bucket(s: Column) -> Column:
    """Bucket of a relative speedup (0.1 is ten percent): lower limits are open below zero, upper ones closed above."""
    a, b, c, d, e, f = (F.lit(x) for x in SPEED_BUCKETS)
    return F.when(s < -0.10, a).when(s < -0.03, b).when(s <= 0.03, c).when(s <= 0.10, d).when(s <= 0.50, e).otherwise(f)


def first_match(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The name of the first pattern found in the text."""
    out = default
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def counter_kind(name: Column) -> Column:
    """category/direction of a counter's name."""
    out = F.lit("vendor_specific/context")
    for parts, category, direction in reversed(COUNTER_RULES):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(F.lower(name), F.lit(part))
        out = F.when(hit, F.lit(f"{category}/{direction}")).otherwise(out)
    return out


def link_capacity(speed: Column, width: Column) -> Column:
    """Bytes per second of a link described as '8.0 GT/s' and 'x16': 128/130 encoding from 8 GT/s on, 8/10 below."""
    rate = F.regexp_extract(speed, r"([0-9.]+)\s*GT/s", 1).try_cast("double")
    lanes = F.regexp_extract(width, r"([0-9]+)", 1).try_cast("double")
    return rate * F.when(rate >= 8, F.lit(128.0 / 130)).otherwise(F.lit(0.8)) * lanes / 8 * 1e9


def element_bytes(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ELEMENT_BYTES.items() for x in kv])
    return F.try_element_at(table, F.lower(kind))


def logical_bytes(kind: Column, shape: Column) -> Column:
    """prod(shape) x element size; NULL for an unknown type, a NULL shape or extent."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, n: a * n.cast("bigint")) * element_bytes(kind)


def safe_token(value: Column, fallback: str, longest: int = 96) -> Column:
    """The value if it is short, of harmless characters and neither path, file name nor long hex string."""
    bad = value.isNull() | (F.length(value) > longest) | value.rlike(r"[/\\]|\.[a-z]{1,4}$|[0-9a-f]{16,}") | ~value.rlike(r"^[A-Za-z0-9_.:+-]+$")
    return F.when(bad, F.lit(fallback)).otherwise(value)


def bounded_name(value: Column, identity: Column, slug: int, digest: int) -> Column:
    """A readable start and a digest of the whole, of bounded length."""
    text = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    return F.concat(F.left(text, F.lit(slug)), F.lit("-"), F.left(F.sha2(F.concat(value, F.lit("\x1f"), identity), 256), F.lit(digest)))


def ulp_distance(a: Column, b: Column) -> Column:
    """Steps between two f32 values in their total order; two NaN are equal, a NaN and a number are 2^32 apart."""
    @F.pandas_udf("bigint")
    def steps(x: pd.Series, y: pd.Series) -> pd.Series:
        def ordered(v: pd.Series) -> np.ndarray:
            bits = v.to_numpy(np.float32).view(np.int32).astype(np.int64)
            return np.where(bits >= 0, bits, -(bits & 0x7FFFFFFF))
        p, q = x.to_numpy(np.float32), y.to_numpy(np.float32)
        out = np.abs(ordered(x) - ordered(y))
        out = np.where(np.isnan(p) ^ np.isnan(q), np.int64(1) << 32, out)
        return pd.Series(np.where(np.isnan(p) & np.isnan(q), 0, out))
    return steps(a, b)


def pseudonyms(df: DataFrame, value: str, namespace: str, key: bytes, out: str) -> DataFrame:
    """``df`` with ``out``: HMAC-SHA256 of namespace, 0 byte and value under a key that travels as a broadcast, not in the plan."""
    secret = df.sparkSession.sparkContext.broadcast(key)

    @F.pandas_udf("string")
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(secret.value, f"{namespace}\0{v}".encode(), hashlib.sha256).hexdigest())

    return df.withColumn(out, keyed(F.col(value).cast("string")))
