"""Revenue measures.

Amounts stay decimal until after the sum: decimal addition gives the same total
whatever order the partitions arrive in, and a rounding tie is a real tie.
Ratios are taken on doubles and rounded last.
"""
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


_GROSS = "cast(quantity AS decimal(10,0)) * unit_price"
_NET = f"{_GROSS} * (1 - discount)"


def gross_amount() -> Column:
    return F.expr(_GROSS)


def net_amount() -> Column:
    """Line amount after discount, whether or not the line came back."""
    return F.expr(_NET)


def kept_amount() -> Column:
    """Line amount that counts as net revenue: zero once the line is returned."""
    return F.expr(f"CASE WHEN returned = 0 THEN {_NET} ELSE 0 END")


def returned_amount() -> Column:
    return F.expr(f"CASE WHEN returned = 1 THEN {_NET} ELSE 0 END")


def total(amount: Column) -> Column:
    """Exact sum of an amount with up to four decimal places, as a decimal.

    A decimal sum of more than 18 digits is kept as a big number per group. Here a line is
    counted in ten-thousandths, a bigint, and summed as two bigint halves that cannot overflow
    before a total of 10^20: the same digits in half the time. A single line must stay below
    9 x 10^14; beyond that the cast fails loudly in ANSI mode.
    """
    units = (amount * 10000).cast("bigint")
    high, low = F.sum(F.shiftright(units, 20)), F.sum(units.bitwiseAND(2**20 - 1))
    return (high.cast("decimal(28,0)") * 2**20 + low) * F.lit(Decimal("0.0001"))


def as_double(amount: Column, digits: int | None = None) -> Column:
    """Decimal total to the double that a report shows, rounded first when asked."""
    return (amount if digits is None else F.round(amount, digits)).cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null for a zero denominator, in doubles."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column, digits: int = 2) -> Column:
    return F.round(ratio(F.lit(100.0) * top.cast("double"), bottom), digits)


def change_percent(now: Column, before: Column, digits: int = 2) -> Column:
    """Growth of ``now`` over ``before`` in percent; null without a base."""
    return F.round(ratio(F.lit(100.0) * (now - before), before), digits)


def magnitude(value: Column) -> Column:
    """Amount as short text: billions, millions, thousands or plain."""
    def scaled(unit: float, digits: int, suffix: str) -> Column:
        return F.concat(F.lit("PKR "), F.format_number(value / F.lit(unit), digits), F.lit(suffix))

    return (F.when(value >= 1e9, scaled(1e9, 2, "B"))
            .when(value >= 1e6, scaled(1e6, 1, "M"))
            .when(value >= 1e3, scaled(1e3, 0, "K"))
            .otherwise(scaled(1.0, 0, "")))
