"""Decimals of 34 digits at any exponent, as a struct that Spark compares, sorts and groups as it stands.

rank is 0 for zero, else the place of the first digit, shifted to be positive
and with the number's sign; coefficient holds the 34 digits from there, with
the sign. A greater number has a greater rank, or the same and a greater
coefficient.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 34
#: Added to the first digit's place: above the least exponent of a 128-bit decimal.
BIAS = 6200
KIND = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("coefficient", T.DecimalType(DIGITS, 0))])
WIDE = T.DecimalType(38, 0)
#: Digits of a quotient that one step of the long division gives: a remainder below 10**19 times 10**18 fits 38 digits.
STEP = 18


def is_general(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == KIND.names and kind["coefficient"].dataType == KIND["coefficient"].dataType


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _quotient(a: Column, n: Column) -> Column:
    """a // n of nonnegative whole decimals, exact for quotients below 10**32."""
    return ((a - a % n) / n).cast(WIDE)


def divide(total: Column, scale: int, n: Column) -> Column:
    """total / n as a general decimal, half even; null for n = 0. total is DECIMAL(38, scale) with |total / n| * 10**scale below 10**32, n a long."""
    whole = (total * F.lit(Decimal(10) ** scale).cast(T.DecimalType(scale + 1, 0))).cast(WIDE) if scale else total.cast(WIDE)
    divisor = F.when(n > 0, n).cast(T.DecimalType(20, 0))
    state = F.struct(_quotient(F.abs(whole), divisor).alias("q"), (F.abs(whole) % divisor).cast(WIDE).alias("r"))
    state = _bind(state, lambda s: F.struct(s["q"].cast("string").alias("digits"), s["r"].alias("r")))

    def longer(s: Column) -> Column:
        ten = F.lit(Decimal(10**STEP)).cast(T.DecimalType(STEP + 1, 0))
        return _bind(
            (s["r"].cast(T.DecimalType(19, 0)) * ten).cast(WIDE),
            lambda x: F.struct(F.concat(s["digits"], F.lpad(_quotient(x, divisor).cast("string"), STEP, "0")).alias("digits"), (x % divisor).cast(WIDE).alias("r")),
        )

    steps = 3
    for _ in range(steps):
        state = _bind(state, longer)

    def rounded(s: Column) -> Column:
        digits = F.ltrim(s["digits"], F.lit("0"))
        # The first digit's place: digits before the point of the unscaled quotient, less the column's scale.
        place = F.length(digits) - F.lit(steps * STEP + 1 + scale)
        padded = F.rpad(digits, 2 * DIGITS + 40, "0")
        head, rest = F.substring(padded, 1, DIGITS), F.substring(padded, DIGITS + 1, DIGITS + 40)
        half = F.rpad(F.lit("5"), DIGITS + 40, "0")
        odd = F.substring(head, DIGITS, 1).cast("int") % 2 == 1
        up = (rest > half) | ((rest == half) & ((s["r"] > 0) | odd))
        coefficient = head.cast(WIDE) + up.cast("int")
        over = coefficient >= F.lit(Decimal(10**DIGITS)).cast(WIDE)
        return _bind(
            F.struct(F.when(over, F.lit(Decimal(10 ** (DIGITS - 1))).cast(WIDE)).otherwise(coefficient).alias("c"), (place + over.cast("int")).alias("p")),
            lambda x: F.struct((F.signum(whole).cast("int") * (x["p"] + BIAS)).cast("int").alias("rank"), (x["c"] * F.signum(whole).cast("int")).cast(KIND["coefficient"].dataType).alias("coefficient")),
        )

    zero = F.struct(F.lit(0).alias("rank"), F.lit(Decimal(0)).cast(KIND["coefficient"].dataType).alias("coefficient"))
    return F.when(n > 0, F.when(whole == 0, zero).otherwise(_bind(state, rounded)))


def text(c: Column) -> Column:
    """All digits in plain notation, without zeros at the end."""
    digits = F.lpad(F.abs(c["coefficient"]).cast("string"), DIGITS, "0")
    place = F.abs(c["rank"]) - BIAS
    before = F.when(place < 0, F.lit("0")).when(place < DIGITS, F.substring(digits, F.lit(1), place + 1)).otherwise(F.rpad(digits, place + 1, F.lit("0")))
    after = F.when(place < 0, F.concat(F.repeat(F.lit("0"), -place - 1), digits)).when(place < DIGITS, F.substring(digits, place + 2, F.lit(DIGITS))).otherwise(F.lit(""))
    plain = F.rtrim(F.rtrim(F.concat(before, F.lit("."), after), F.lit("0")), F.lit("."))
    return F.when(c["rank"] == 0, F.lit("0")).otherwise(F.concat(F.when(c["rank"] < 0, F.lit("-")).otherwise(F.lit("")), plain))


def parts(x: Fraction) -> tuple[int, int, bool]:
    """(rank, coefficient, exact) of the greatest general decimal at or below x."""
    if x == 0:
        return 0, 0, True
    size = abs(x)
    place = len(str(math.floor(size))) - 1 if size >= 1 else -len(str(math.floor(1 / size)))
    while Fraction(10) ** place > size:
        place -= 1
    while Fraction(10) ** (place + 1) <= size:
        place += 1
    scaled = x / Fraction(10) ** (place - DIGITS + 1)
    coefficient = math.floor(scaled)
    if abs(coefficient) >= 10**DIGITS:  # rounding down a negative number makes it longer
        coefficient, place = coefficient // 10, place + 1
    return (1 if x > 0 else -1) * (place + BIAS), coefficient, scaled == coefficient


def literal(rank: int, coefficient: int) -> Column:
    return F.struct(F.lit(rank).alias("rank"), F.lit(Decimal(coefficient)).cast(KIND["coefficient"].dataType).alias("coefficient"))


def to_34_digits(total: Column, scale: int) -> Column:
    """A DECIMAL(38, scale) rounded half even to 34 digits, in its own type."""
    out = total
    for over in range(1, 5):
        limit = F.lit(Decimal(10 ** (DIGITS + over - 1)).scaleb(-scale)).cast(T.DecimalType(38, scale))
        out = F.when(F.abs(total) >= limit, F.bround(total, scale - over).cast(T.DecimalType(38, scale))).otherwise(out)
    return out
