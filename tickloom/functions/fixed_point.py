"""Fixed-point numbers as BIGINT plus a scale. Exact decimals only, never binary floats."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import let

# Decimal text: optional sign, digits with at most one point, optional exponent, no blanks.
DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

PLAIN_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"

OUTPUT_PLACES = 8
# Scales up to here take a factor; larger ones are divided as whole numbers.
_LISTED_SCALE = 18
# A plain number this short fits DECIMAL(36 - places, 17) digit for digit.
_SHORT, _FRACTION = 18, 17


def _shifted(text: Column, places: int) -> Column:
    """``text`` times 10^places cut toward zero, by moving the point on the digits themselves."""
    power = F.regexp_extract(text, "[eE]([+-]?[0-9]+)$", 1)
    parts = F.struct(
        F.regexp_extract(text, "^[+-]?([0-9]*)", 1).alias("whole"), F.regexp_extract(text, r"\.([0-9]*)", 1).alias("rest"),
        F.when(power == "", F.lit(0)).otherwise(power.try_cast("int")).cast("bigint").alias("power"),
    )

    def placed(p: Column) -> Column:
        digits = F.concat(p["whole"], p["rest"])
        leading = F.regexp_replace(digits, "^0+", "")
        # digits before the point after the shift, not counting leading zeros
        point = F.length(p["whole"]) + p["power"] + places - (F.length(digits) - F.length(leading))
        return F.struct(leading.alias("digits"), F.when(leading == "", 0).otherwise(point).alias("point"), p["power"])

    def number(p: Column) -> Column:
        point = p["point"].cast("int")
        return F.when(p["power"].isNull() | (p["point"] > 19), F.lit(None).cast("string")).when(p["point"] <= 0, F.lit("0")) \
            .otherwise(F.rpad(F.substring(p["digits"], F.lit(1), point), point, F.lit("0")))

    unsigned = let(let(parts, placed), number)
    return F.when(F.substring(text, 1, 1) == "-", F.concat(F.lit("-"), unsigned)).otherwise(unsigned).try_cast("bigint")


def all_short(texts: list[Column]) -> Column:
    """Whether all texts are plain numbers of up to 18 signs, as nearly every price is: one look at all of them."""
    number = r"(?=[^|]{1,18}(?:\||$))[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
    pattern = f"^{number}(?:\\|{number}){{{len(texts) - 1}}}$"
    return F.concat_ws("|", *texts).rlike(pattern)


def scale_short(text: Column, places: int) -> Column:
    """``scale_text`` for texts that are short: one exact DECIMAL product."""
    value = text.try_cast(f"decimal({36 - places},{_FRACTION})")
    return (value * F.lit(10**places).cast(f"decimal({places + 1},0)")).try_cast("bigint")


def scale_text(text: Column, places: int) -> Column:
    """``text`` times 10^places as BIGINT, cut toward zero; NULL if it is no number or too big.

    A plain number of up to 18 signs takes one exact DECIMAL product. Longer
    texts and exponents move the point on the digit text, so no digit is lost before the cut. A cast would forgive blanks
    around the number; the patterns do not.
    """
    return F.when((F.length(text) <= _SHORT) & text.rlike(PLAIN_TEXT), scale_short(text, places)) \
        .when(text.rlike(DECIMAL_TEXT), _shifted(text, places))


def _times_power(value: Column, scale: Column, digit: int, shift: int) -> Column:
    """``value * digit * 10^-(scale + shift)``, rounded half up to eight places; NULL for a negative or missing scale.

    The two scales the feeds use get a short factor each, any other up to 18 comes from a constant list. More
    branches would push the generated method past the size the JVM still compiles. Beyond 18 the rounded result
    is a small whole number of 10^-8, found by whole division; from 10^20 on the divisor exceeds every value.
    """

    def factor(s: int) -> Decimal:
        return Decimal(digit).scaleb(-s - shift)

    def wide(s: Column) -> Column:
        powers = F.array(*(F.lit(Decimal(10) ** k).cast("decimal(21,0)") for k in range(21)))
        part = F.get(powers, s + shift - OUTPUT_PLACES)
        twice = F.abs(value).cast("decimal(20,0)") * F.lit(2 * digit).cast("decimal(2,0)")
        units = F.call_function("div", twice + part, part * F.lit(2).cast("decimal(1,0)"))
        signed = F.when(value < 0, -units).otherwise(units).cast("decimal(19,0)")
        return (F.coalesce(signed, F.lit(0)) * F.lit(Decimal(1).scaleb(-OUTPUT_PLACES)).cast("decimal(9,8)")).cast("decimal(28,8)")

    listed = F.array(*(F.lit(factor(s)).cast("decimal(20,19)") for s in range(_LISTED_SCALE + 1)))
    product = F.when(scale == 8, F.round(value * F.lit(factor(8)), OUTPUT_PLACES).cast("decimal(28,8)"))
    product = product.when(scale == 2, F.round(value * F.lit(factor(2)), OUTPUT_PLACES).cast("decimal(28,8)"))
    product = product.when((scale > _LISTED_SCALE) & value.isNotNull(), let(scale, wide))
    return product.otherwise(F.round(value * F.get(listed, scale), OUTPUT_PLACES).cast("decimal(28,8)"))


def descale(value: Column, scale: Column) -> Column:
    """``value / 10^scale`` as DECIMAL(28,8), half up."""
    return _times_power(value.cast("decimal(19,0)"), scale, 1, 0)


def mid_price(bid: Column, ask: Column, scale: Column) -> Column:
    """``(bid + ask) / 2 / 10^scale`` as DECIMAL(28,8), half up.

    Halving a whole number adds one decimal, so multiplying the sum by 5 * 10^-(scale+1) is
    exact and only the final rounding remains.
    """
    return _times_power(bid.cast("decimal(19,0)") + ask.cast("decimal(19,0)"), scale, 5, 1)
