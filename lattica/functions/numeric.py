"""Column expressions with IEEE semantics, number lexers and random streams; all of them run in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def real(c: Column) -> Column:
    return c.cast("double")


def divide(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: infinities and NaN instead of errors, and the sign of zeros counts. Null if either is."""
    a, b = real(a), real(b)
    below = b.cast("string").startswith("-")  # only the text tells -0.0 from 0.0
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when((a > 0) != below, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.isnan(b), F.lit(NAN)).when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def remainder(a: Column, b: Column) -> Column:
    """a % b with the sign of a; NaN for b = 0. Null if either is."""
    a, b = real(a), real(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((b == 0) | F.isnan(b) | F.isnan(a), F.lit(NAN)).otherwise(F.try_mod(a, b))


COMPARISONS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(op: str, a: Column, b: float) -> Column:
    """NaN differs from everything and compares as false otherwise. The plain comparison comes first, so that it can be pushed
    into a scan."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    if b != b:
        return F.lit(op == "!=")
    plain = COMPARISONS[op](a, F.lit(b))
    return plain | F.isnan(a) if op == "!=" else plain & ~F.isnan(a)


def half_away(c: Column, digits: int) -> Column:
    """round(c * 10**digits) / 10**digits in doubles, halves away from zero, as SQL engines round doubles. F.round goes by the decimal
    digits of a double instead, so that the two part where a product falls on a half or just below one."""
    scaled = F.abs(c) * F.lit(10.0**digits)
    below = F.floor(scaled).cast("double")
    whole = F.when(scaled < 2.0**52, below + F.when(scaled - below >= 0.5, 1.0).otherwise(0.0)).otherwise(scaled)
    out = whole / F.lit(10.0**digits)
    return F.when(F.isnan(out) | (out == INF), c).otherwise(F.signum(c) * out)


NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def whole_number(text: Column) -> Column:
    """The number that the trimmed text is, else null. Words like NaN, 1d or 0x10 are none."""
    text = F.trim(text)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def prefix_number(text: Column) -> Column:
    """The longest number that the text begins with, else null: 12abc is 12."""
    return F.regexp_extract(text, PREFIX, 1).try_cast("double")


def _horner(x: Column, terms: list[float]) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + F.lit(t)
    return out


# fixed values: Acklam's rational approximation of the inverse normal distribution
PROBIT_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PROBIT_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
PROBIT_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PROBIT_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
PROBIT_LOW = 0.02425


def probit(p: Column) -> Column:
    """Inverse of the normal distribution function, to about 1e-9; null outside (0, 1)."""
    tail = F.sqrt(-2.0 * F.log(F.when(p < 0.5, p).otherwise(1 - p)))
    side = _horner(tail, PROBIT_C) / _horner(tail, PROBIT_D)
    q = p - 0.5
    middle = q * _horner(q * q, PROBIT_A) / _horner(q * q, PROBIT_B)
    inside = (p > 0) & (p < 1)
    return F.when(inside & (p < PROBIT_LOW), side).when(inside & (p > 1 - PROBIT_LOW), -side).when(inside, middle)


M32 = (1 << 32) - 1


def times32(a: Column, b: int | Column) -> Column:
    """a * b modulo 2**32, within signed 64-bit numbers; a and b are below 2**32."""
    if isinstance(b, int):
        high, low = F.lit(b >> 16), F.lit(b & 0xFFFF)
    else:
        high, low = F.shiftrightunsigned(b, 16), b.bitwiseAND(F.lit(0xFFFF))
    upper = (a * high).bitwiseAND(F.lit(0xFFFF))
    return (upper * F.lit(65536) + a * low).bitwiseAND(F.lit(M32))


# fixed values: multiplier and increment of the linear congruential stream
LCG_A, LCG_C = 1664525, 1013904223


def lcg(index: Column, seed: int, bits: int = 33) -> Column:
    """The number at `index` (from 0) of the stream s <- (A s + C) mod 2**32 from `seed`, divided by 2**32 - 1: any place of the
    stream on its own, by doubling steps, so the stream needs no order of evaluation."""
    a, c, jumps = LCG_A, LCG_C, []
    for k in range(bits):
        jumps.append(F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")))
        a, c = a * a & M32, (a * c + c) & M32
    steps = index.cast("long") + 1

    def jump(state: Column, j: Column) -> Column:
        taken = F.call_function("shiftrightunsigned", steps, j["k"])
        moved = (times32(state, j["a"]) + j["c"]).bitwiseAND(F.lit(M32))
        return F.when(taken.bitwiseAND(F.lit(1)) == 1, moved).otherwise(state)

    return F.aggregate(F.array(*jumps), F.lit(int(seed) & M32).cast("long"), jump) / F.lit(4294967295.0)


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


MULBERRY = 0x6D2B79F5  # fixed value: the increment of the mulberry32 stream


def mulberry32(index: Column, seed: int) -> Column:
    """The number at `index` (from 0) of the mulberry32 stream from `seed`, in [0, 1)."""
    t = (times32((index.cast("long") + 1).bitwiseAND(F.lit(M32)), MULBERRY) + F.lit(int(seed) & M32)).bitwiseAND(F.lit(M32))
    first = lambda t: times32(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1)))
    second = lambda t: t.bitwiseXOR((t + times32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(M32)))
    third = lambda t: t.bitwiseXOR(F.shiftrightunsigned(t, 14))
    return let(let(let(t, first), second), third) / F.lit(4294967296.0)


# fixed values: start and factor of the FNV-1a hash of 32 bits
FNV_START, FNV_FACTOR = 0x811C9DC5, 0x01000193


def fnv1a(text: Column) -> Column:
    """The FNV-1a hash of a text's 16-bit characters, as eight hexadecimal digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    value = F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda h, c: times32(h.bitwiseXOR(c), FNV_FACTOR))
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def piecewise(t: Column, stops: list[tuple[float, float]]) -> Column:
    """Linear between (place, value) stops, constant beyond the ends."""
    out = F.lit(float(stops[-1][1]))
    for (a, x), (b, y) in reversed([p for p in zip(stops, stops[1:]) if p[0][0] < p[1][0]]):
        out = F.when(t <= b, F.lit(float(x)) + (t - a) / (b - a) * (y - x)).otherwise(out)
    return F.when(t <= stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def number_text(c: Column) -> Column:
    """A number as plain text: no .0 after whole numbers, shortest digits that give the number back."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    word = F.when(F.isnan(c), "NaN").when(c == INF, "Infinity").when(c == -INF, "-Infinity")
    return F.when(word.isNotNull(), word).when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(F.lower(c.cast("string")))


def short_label(c: Column) -> Column:
    """1.2M, 3.4k, and fewer decimals for larger numbers."""
    size = F.abs(c)
    return (
        F.when(size >= 1e6, F.format_string("%.1fM", c / 1e6))
        .when(size >= 1e3, F.format_string("%.1fk", c / 1e3))
        .when(size >= 10, F.format_string("%.0f", c))
        .when(size >= 1, F.format_string("%.1f", c))
        .otherwise(F.format_string("%.2f", c))
    )


def shown_text(v: Column, kind) -> Column:
    """A value as a table shows it: numbers to four decimals without trailing zeros, NaN and infinities as signs."""
    if kind.typeName() not in ("double", "float"):
        return F.when(v.isNull(), F.lit("None")).otherwise(v.cast("string"))
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", v), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(v.isNull(), F.lit("None")).when(F.isnan(v), F.lit("NaN")).when(v == INF, F.lit("\u221e")).when(v == -INF, F.lit("-\u221e")).otherwise(digits)
