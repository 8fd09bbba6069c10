"""Pointwise and guarded maps. Guards are ordered IEEE comparisons: they are false for NaN, so NaN takes the else branch."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _above(x: Column, limit: float) -> Column:
    # Spark orders NaN above every number
    return (x > F.lit(limit)) & ~F.isnan(x)


def _below(x: Column, limit: float) -> Column:
    return x < F.lit(limit)


def affine(x: Column, scale: float, bias: float) -> Column:
    return x * F.lit(scale) + F.lit(bias)


def shift(x: Column, by: float) -> Column:
    return x + F.lit(by)


def divide(x: Column, by: float) -> Column:
    return x / F.lit(by)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(_below(x, low), F.lit(low)).when(_above(x, high), F.lit(high)).otherwise(x)


def branch_abs(x: Column) -> Column:
    """-x below zero, else x: -0.0 stays -0.0."""
    return F.when(_below(x, 0.0), -x).otherwise(x)


def relu(x: Column) -> Column:
    return F.when(_above(x, 0.0), x).otherwise(F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.125) -> Column:
    return F.when(_above(x, 0.0), x).otherwise(x * F.lit(slope))


def threshold(x: Column, at: float) -> Column:
    return F.when(_above(x, at), F.lit(1.0)).otherwise(F.lit(0.0))


def power(x: Column, n: int) -> Column:
    out = x
    for _ in range(n - 1):
        out = out * x
    return out


def horner(x: Column, coefficients: list[float]) -> Column:
    """Highest power first; the association of the operations is kept."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def reciprocal_shift(x: Column, by: float) -> Column:
    """1 / (x + by); infinity of the divisor's sign at zero, as IEEE division gives."""
    d = x + F.lit(by)
    return F.when(d == 0.0, F.lit(float("inf"))).otherwise(F.lit(1.0) / d)


def sign(x: Column) -> Column:
    return F.when(_above(x, 0.0), F.lit(1.0)).when(_below(x, 0.0), F.lit(-1.0)).otherwise(F.lit(0.0))


def softsign(x: Column) -> Column:
    return x / (F.lit(1.0) + branch_abs(x))


def blend(x: Column, low: float, high: float) -> Column:
    """x above zero keeps ``high`` of itself, else ``low``."""
    return F.when(_above(x, 0.0), x * F.lit(high)).otherwise(x * F.lit(low))


def dead_zone(x: Column, width: float) -> Column:
    return F.when(_above(x, width), x - F.lit(width)).when(_below(x, -width), x + F.lit(width)).otherwise(F.lit(0.0))


def gain_gate(x: Column, at: float, gain: float) -> Column:
    return F.when(_above(x, at), x * F.lit(gain)).otherwise(x)


def sigmoid(x: Column) -> Column:
    """Never overflows: the exponential is taken of a negative number only."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def power_bucket(v: Column) -> Column:
    """Sign-preserving power of two at or below |v|; 0 stays 0."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * F.pow(F.lit(2.0), F.floor(F.log2(F.abs(v)))))


_TOKENS = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(<=|>=|==|!=|&&|\|\||[-+*/()<>?:,]))")
ALLOWED_CALLS = ("abs", "sqrt", "exp", "least", "greatest")


def expression(text: str, x: str) -> Column:
    """A pointwise expression over ``x`` given as text: numbers, ``x``, + - * /, comparisons, parentheses and a few calls.

    Anything else is an error, so no other column or function can be reached."""
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {text[at:at + 10]!r}")
        number, name, op = m.groups()
        if number:
            out.append(f"CAST({number} AS DOUBLE)")
        elif name:
            if name != "x" and name not in ALLOWED_CALLS:
                raise ValueError(f"name not allowed: {name}")
            out.append(f"`{x}`" if name == "x" else name)
        elif op in ("?", ":", "&&", "||", "=="):
            raise ValueError(f"operator not allowed: {op}")
        else:
            out.append(op)
        at = m.end()
    return F.expr(" ".join(out))
