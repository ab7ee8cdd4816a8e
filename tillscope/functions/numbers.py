"""Column functions that read numbers, and the guards on differences of money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: differences below this share of the figures compared are floating-point residue.
RESIDUE = 1e-9

# Digits and a decimal point: most cells, told by one short search.
_DIGITS = r"^[0-9]{1,15}(?:\.[0-9]{1,15})?\z"
_STRICT = r"(?U)^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def strict_number(col: Column) -> Column:
    """Text as a finite double, else null. The regex keeps out ``1.0d`` and ``inf``, which a cast accepts."""
    number = F.when(col.rlike(_STRICT), F.trim(F.regexp_replace(col, r"(?U)\s+", "")).try_cast("double"))
    return F.when(col.rlike(_DIGITS), col.try_cast("double")).otherwise(F.when(F.abs(number) < F.lit(float("inf")), number))


# --- numbers written for people ------------------------------------------------------------------

# One sign of a currency, digits, and a fraction that is too short for a group: only one reading fits.
_PLAIN_MONEY = r"^\p{Sc}?([0-9]{1,15}(?:[.,][0-9]{1,2})?)\z"
_PAD = r"[ \t\r\n\u00a0\u202f]*+"
_SIGN = r"(?:\s*+\p{Sc})*+"
_GROUPS = r" \u00a0\u202f'"
_DRESSED = (
    rf"^{_PAD}(?:\p{{Sc}}\s*+)*+{_PAD}([+-]?){_PAD}(?:\p{{Sc}}\s*+)*+{_PAD}"
    rf"([0-9.,'](?:[0-9.,{_GROUPS}]*[0-9.,'])?)"
    rf"{_PAD}{_SIGN}{_PAD}(-?){_PAD}{_SIGN}{_PAD}$"
)


def _reading(decimal: str, other: str) -> str:
    """Integer part plain or in groups of three (never a leading 0), then an optional fraction."""
    return rf"^(?=.)(?:[0-9]+|[1-9][0-9]{{0,2}}([{other}{_GROUPS}])[0-9]{{3}}(?:\1[0-9]{{3}})*)?(?:[{decimal}][0-9]+)?$"


def human_number(col: Column) -> Column:
    """Struct ``(shape, point_text, comma_text, currency)`` for a number as people write it; null if it is none.

    ``shape`` is plain, point (only a decimal point fits), comma (only a decimal comma fits) or
    ambiguous (both fit and give different numbers).
    """
    lead, body, trail = (F.regexp_extract(col, _DRESSED, i) for i in (1, 2, 3))
    readable = col.rlike(_DRESSED) & body.rlike("[0-9]") & ~((lead != "") & (trail != ""))
    sign = F.when((lead == "-") | (trail == "-"), F.lit("-")).otherwise(F.lit(""))

    def written(digits: Column) -> Column:
        return F.concat(sign, F.when(digits.startswith("."), F.concat(F.lit("0"), digits)).otherwise(digits))

    point = F.when(
        readable & body.rlike(_reading(".", ",")), written(F.regexp_replace(body, rf"[,{_GROUPS}]", ""))
    )
    comma = F.when(
        readable & body.rlike(_reading(",", ".")),
        written(F.replace(F.regexp_replace(body, rf"[.{_GROUPS}]", ""), F.lit(","), F.lit("."))),
    )
    shape = (
        F.when(point.isNotNull() & comma.isNotNull(),
               F.when(point.try_cast("double") == comma.try_cast("double"), "plain").otherwise("ambiguous"))
        .when(point.isNotNull(), "point").when(comma.isNotNull(), "comma")
    )
    return F.when(
        shape.isNotNull(),
        F.struct(shape.alias("shape"), point.alias("point_text"), comma.alias("comma_text"),
                 col.rlike(r"\p{Sc}").alias("currency")),
    )


def number_as_decided(col: Column, decision: Column) -> Column:
    """The cell rewritten as a plain number: by its own proof, an ambiguous one by the column's decision."""
    read = human_number(col)
    by_decision = (
        F.when(decision == "decimal_point", read.point_text).when(decision == "decimal_comma", read.comma_text)
    )
    text = (
        F.when(read.shape.isin("plain", "point"), read.point_text)
        .when(read.shape == "comma", read.comma_text)
        .otherwise(by_decision)
    )
    plain = F.translate(F.regexp_extract(col, _PLAIN_MONEY, 1), ",", ".")
    return F.when(col.rlike(_PLAIN_MONEY), plain).otherwise(F.coalesce(text, col))


# --- differences of money ------------------------------------------------------------------------


def is_negligible(delta: Column, *magnitudes: Column) -> Column:
    """Is ``delta`` nothing but residue next to these figures?"""
    sizes = [F.abs(F.coalesce(m, F.lit(0.0))) for m in magnitudes]
    scale = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return F.when(scale == 0, delta == 0).otherwise(F.abs(delta) <= RESIDUE * scale)


def pct_change_reason(current: Column, previous: Column, *magnitudes: Column) -> Column:
    """Why a percentage change cannot be given, else null."""
    return (
        F.when(previous.isNull() | current.isNull(), "no_value")
        .when(previous == 0, "no_previous_value")
        .when(is_negligible(previous, current, previous, *magnitudes), "previous_is_residue")
        .when(previous < 0, "previous_is_negative")
    )


def pct_change(current: Column, previous: Column, *magnitudes: Column) -> Column:
    return F.when(
        pct_change_reason(current, previous, *magnitudes).isNull(),
        F.try_divide(current - previous, previous) * 100,
    )


def shapley2(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """The change of ``a*b`` shared between its two factors, averaged over both orders."""
    return (a1 - a0) * (b0 + b1) / 2, (b1 - b0) * (a0 + a1) / 2


def shapley3(
    x0: Column, x1: Column, y0: Column, y1: Column, z0: Column, z1: Column
) -> tuple[Column, Column, Column]:
    """The change of ``x*y*z`` shared between its three factors, averaged over all six orders."""

    def term(d: Column, p0: Column, p1: Column, q0: Column, q1: Column) -> Column:
        return d * (2 * p0 * q0 + p0 * q1 + p1 * q0 + 2 * p1 * q1) / 6

    return term(x1 - x0, y0, y1, z0, z1), term(y1 - y0, x0, x1, z0, z1), term(z1 - z0, x0, x1, y0, y1)
