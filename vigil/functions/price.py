"""Price and salary text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed2(v: Column | str) -> Column:
    """Two decimals, ties to even on the binary value."""
    return F.call_function("format_number", _c(v).cast("double"), F.lit("0.00"))


def price_value_ccy(value: Column | str, ccy: Column | str) -> Column:
    """``$<value> <currency>`` (value as given), NULL without a value."""
    value = _c(value)
    return F.when(value.isNotNull(), F.concat(F.lit("$"), value, F.lit(" "), _c(ccy)))


def price_ratio(amount: Column | str, divisor: Column | str, ccy: Column | str) -> Column:
    """``$`` + ``amount / divisor`` with two decimals + currency (``$12.50 USD``)."""
    v = _c(amount).cast("double") / _c(divisor).cast("double")
    return F.when(v.isNotNull(), F.concat(F.lit("$"), fixed2(v), F.lit(" "),
                                          _c(ccy)))


def price_dollars(v: Column | str) -> Column:
    """``$%.2f`` of a number."""
    v = _c(v).cast("double")
    return F.when(v.isNotNull(), F.concat(F.lit("$"), fixed2(v)))


def price_yen(v: Column | str) -> Column:
    """``¥`` + thousands-separated integer; non-numeric text kept as is."""
    n = _c(v).cast("string").try_cast("bigint")
    return F.when(n.isNotNull(), F.concat(F.lit("¥"), F.format_number(n, 0))).otherwise(
        _c(v).cast("string"))


# F07
def salary_suffix(lo: Column | str, hi: Column | str) -> Column:
    """`` · $min–$max`` / `` · $min+`` / empty; zero counts as missing."""
    lo = F.nullif(_c(lo).cast("double"), F.lit(0.0))
    hi = F.nullif(_c(hi).cast("double"), F.lit(0.0))
    return (F.when(lo.isNotNull() & hi.isNotNull(),
                   F.concat(F.lit(" · $"), F.format_number(lo, 0), F.lit("–$"),
                            F.format_number(hi, 0)))
            .when(lo.isNotNull(), F.concat(F.lit(" · $"), F.format_number(lo, 0), F.lit("+")))
            .otherwise(F.lit("")))
