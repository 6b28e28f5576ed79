"""Exact sums of amounts.

The tables keep amounts as doubles with two decimals. A sum of doubles depends
on the order in which tasks finish, so amounts are summed as whole hundredths,
in long arithmetic, which is also many times faster than decimals.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# A unit is summed in two parts, so that neither long sum can overflow: values up
# to 2^40 in 10^12 rows give less than 2^60 in each.
LOW_BITS = 20


def hundredths(amount: str | Column) -> Column:
    """An amount with two decimals as a whole number of hundredths."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.rint(amount * 100).cast("bigint")


def discounted() -> Column:
    """A line's price after its discount, in units of 10^-4."""
    return hundredths("l_extendedprice") * (100 - hundredths("l_discount"))


def charged() -> Column:
    """A line's price after discount and tax, in units of 10^-6."""
    return discounted() * (100 + hundredths("l_tax"))


def exact_sum(units: Column, decimals: int) -> Column:
    """Sum of whole units of 10^-decimals, as an exact decimal."""
    high = F.sum(F.shiftright(units, LOW_BITS)).cast("decimal(19,0)")
    low = F.sum(units.bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
    unit = F.lit(Decimal(1).scaleb(-decimals))
    return (high * F.lit(Decimal(1 << LOW_BITS)) + low.cast("decimal(19,0)")) * unit


def money(total: Column) -> Column:
    """An exact total as a double, for output."""
    return total.cast("double")
