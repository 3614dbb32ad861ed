"""Vector mathematics as expressions over array<double> columns: no shuffle, no Python, whatever the table's size.

A null array gives null; where two arrays are combined, a difference in length is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same(a: Column, b: Column, out: Column) -> Column:
    unequal = F.raise_error(F.concat(F.lit("arrays of "), F.size(a), F.lit(" and "), F.size(b), F.lit(" elements")))
    return F.when(F.size(a) != F.size(b), unequal).otherwise(out)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for the row and not once for each element that a lambda visits."""
    return F.get(F.transform(F.array(value), use), 0)


def total(x: Column) -> Column:
    return F.when(x.isNotNull(), F.aggregate(x, F.lit(0.0), lambda a, v: a + v))


def dot(a: Column, b: Column) -> Column:
    return _same(a, b, total(F.zip_with(a, b, lambda x, y: x.cast("double") * y)))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x)))


def matvec(rows: Column, x: Column) -> Column:
    """array<array<double>> times array<double>."""
    return F.transform(rows, lambda r: dot(r, x))


def add(a: Column, b: Column) -> Column:
    """Residual addition."""
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y))


def rms_norm(x: Column, weight: Column | None = None, eps: float = 1e-6) -> Column:
    """x / sqrt(mean(x^2) + eps), times the weights."""
    scale = F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v)) / F.size(x) + eps)
    if weight is None:
        return let(scale, lambda s: F.transform(x, lambda v: v / s))
    return _same(x, weight, let(scale, lambda s: F.zip_with(x, weight, lambda v, w: v / s * w)))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (1 + F.exp(-v)))


def swiglu(gate: Column, up: Column) -> Column:
    """silu(gate) * up."""
    return _same(gate, up, F.zip_with(gate, up, lambda g, u: g / (1 + F.exp(-g)) * u))


def rope(x: Column, position: Column, width: int, base: float = 10_000.0) -> Column:
    """Rotary positions on adjacent even and odd elements of heads of ``width``; an odd width or length is an error."""
    if width % 2:
        raise ValueError("a head needs an even width")

    def turned(v: Column, i: Column) -> Column:
        even = i - i % 2
        angle = position * F.pow(F.lit(base), -(even % width).cast("double") / width)
        left, right = F.get(x, even), F.get(x, even + 1)
        return F.when(i % 2 == 0, left * F.cos(angle) - right * F.sin(angle)).otherwise(left * F.sin(angle) + right * F.cos(angle))

    return F.when(F.size(x) % width != 0, F.raise_error(F.lit("the vector is no whole number of heads"))).otherwise(F.transform(x, turned))


def softmax(x: Column) -> Column:
    """With the largest element subtracted."""
    weights = let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    return let(weights, lambda w: let(total(w), lambda t: F.transform(w, lambda v: v / t)))


def temperature(logits: Column, t: float) -> Column:
    if t <= 0:
        raise ValueError("the temperature has to be above 0")
    return F.transform(logits, lambda v: v / t)


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of the tokens in the array ``seen`` are divided (negative ones multiplied) by the penalty once an occurrence."""
    return F.transform(logits, lambda v, i: F.when(v < 0, v * F.pow(F.lit(penalty), F.size(F.filter(seen, lambda t: t == i)))).otherwise(
        v / F.pow(F.lit(penalty), F.size(F.filter(seen, lambda t: t == i)))))


def argmax_last(x: Column) -> Column:
    """The greedy choice: the last place of the largest element."""
    return F.size(x) - F.array_position(F.reverse(x), F.array_max(x)).cast("int")


def argmax_first(x: Column) -> Column:
    return F.array_position(x, F.array_max(x)).cast("int") - 1


def top_k(x: Column, k: int) -> Column:
    """Places and values of the k largest elements, largest first, the first place on ties."""
    pairs = F.transform(x, lambda v, i: F.struct((-v).alias("minus"), i.alias("id")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["id"].alias("id"), (-p["minus"]).alias("value")))


def nucleus(probabilities: Column, p: float) -> Column:
    """The shortest run of likeliest tokens whose mass reaches p, renormalised: array of (id, p), likeliest first."""
    ranked = top_k(probabilities, 1 << 30)
    step = F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<struct<id:int,value:double>>").alias("kept"))
    run = F.aggregate(ranked, step, lambda a, x: F.when(a["mass"] >= p, a).otherwise(
        F.struct((a["mass"] + x["value"]).alias("mass"), F.concat(a["kept"], F.array(F.struct(x["id"].alias("id"), x["value"].cast("double").alias("value")))).alias("kept"))))
    return let(run, lambda r: F.transform(r["kept"], lambda x: F.struct(x["id"].alias("id"), (x["value"] / r["mass"]).alias("p"))))


def draw(choices: Column, unit: Column) -> Column:
    """Inverse CDF over an array of (id, p): the first id whose running sum reaches ``unit``, else the last."""
    step = F.struct(F.lit(0.0).alias("mass"), F.lit(None).cast("int").alias("id"))
    found = F.aggregate(choices, step, lambda a, x: F.when(a["id"].isNotNull(), a).otherwise(
        F.struct((a["mass"] + x["p"]).alias("mass"), F.when(unit <= a["mass"] + x["p"], x["id"]).cast("int").alias("id"))))
    return F.coalesce(found["id"], F.get(choices, F.size(choices) - 1)["id"])


#: Fixed values of the generator.
SEED_MASK, MULTIPLIER = 0xA076_1D64_78BD_642F, 0x2545_F491_4F6C_DD1D


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def seed_state(seed: Column) -> Column:
    """The xorshift64* state of a seed."""
    return seed.bitwiseXOR(F.lit(_signed(SEED_MASK)))


def next_state(state: Column) -> Column:
    a = state.bitwiseXOR(F.shiftrightunsigned(state, 12))
    b = a.bitwiseXOR(F.shiftleft(a, 25))
    return b.bitwiseXOR(F.shiftrightunsigned(b, 27))


def unit_of(state: Column) -> Column:
    """A number in [0, 1) of 24 bits from a state: the upper bits of state * MULTIPLIER modulo 2**64."""
    low, high = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
    x0, x1 = state.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(state, 32)
    # products of 32 bits in decimals, so that none overflows
    wide = lambda c: c.cast("decimal(20,0)")
    below = wide(x0) * F.lit(low).cast("decimal(20,0)")
    carry = F.floor(below.cast("decimal(38,0)") / F.lit(1 << 32).cast("decimal(20,0)")).cast("decimal(20,0)")
    upper = (wide(x0) * F.lit(high).cast("decimal(20,0)") + wide(x1) * F.lit(low).cast("decimal(20,0)") + carry) % F.lit(1 << 32).cast("decimal(20,0)")
    return F.floor(upper / 256).cast("double") / float(1 << 24)


def draws(seed: Column, n: int) -> Column:
    """The first n numbers of a seed's sequence."""
    states = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(seed_state(seed)), lambda a, _: F.concat(a, F.array(next_state(F.get(a, F.size(a) - 1)))))
    return F.transform(F.slice(states, 2, n), unit_of)
