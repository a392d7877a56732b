"""The store's loose value rules as column expressions: truthiness, number parsing, number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_spark.constants import FALLBACK_COP_PER_USD

MONEY = T.DecimalType(18, 2)

# Fixed patterns: the leading number of a text, and a text that is a number as a whole.
LEADING_FLOAT = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
LEADING_INT = r"^\s*([+-]?[0-9]+)"
WHOLE_NUMBER_TEXT = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)?\s*$"


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def has_text(value: str | Column) -> Column:
    """True for a text that is neither null nor empty."""
    return F.coalesce(_column(value) != "", F.lit(False))


def or_default(value: str | Column, default: str | Column) -> Column:
    """The text, or ``default`` when it is null or empty."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(_column(value), F.lit("")), fallback)


def null_if_empty(value: str | Column) -> Column:
    return F.nullif(_column(value), F.lit(""))


def comparable(value: str | Column, collation: str | None = None) -> Column:
    """The text as it is compared, joined and grouped under a collation such as UNICODE_CI or UNICODE_CI_AI; byte by byte without one."""
    return F.collate(_column(value), collation) if collation else _column(value)


def js_trim(value: str | Column) -> Column:
    """The text without white space of any kind, Unicode's included, at its ends."""
    return F.regexp_replace(_column(value), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def js_float(value: str | Column) -> Column:
    """The number a text starts with, as DOUBLE; null when there is none."""
    return F.regexp_extract(_column(value).cast("string"), LEADING_FLOAT, 1).try_cast("double")


def js_int(value: str | Column) -> Column:
    """The whole number a text starts with, as BIGINT; null when there is none."""
    return F.regexp_extract(_column(value).cast("string"), LEADING_INT, 1).try_cast("bigint")


def is_number_text(value: str | Column) -> Column:
    """True when the whole text reads as a number. The empty text counts as zero."""
    return F.coalesce(_column(value).cast("string").rlike(WHOLE_NUMBER_TEXT), F.lit(False))


def money(value: str | Column) -> Column:
    return _column(value).cast(MONEY)


def as_double(value: str | Column) -> Column:
    """Leave exact money arithmetic at the edge of a query."""
    return _column(value).cast("double")


def total_in_cents(total: str | Column) -> Column:
    return F.round(_column(total) * 100).cast("bigint")


def amount_2dp(amount: str | Column) -> Column:
    return F.round(_column(amount).cast("decimal(24,6)"), 2).cast(MONEY)


def es_number(value: str | Column) -> Column:
    """Number text as read in Colombia: 1.234.567,5 with at most two decimals."""
    text = F.regexp_replace(F.format_number(_column(value), 2), r"\.?0*$", "")
    return F.translate(text, ",.", ".,")


def format_cop(value: str | Column) -> Column:
    """Pesos without decimals, half away from zero. Null and blank text count as zero; what is not a number is ``$ 0``."""
    text = js_trim(_column(value).cast("string"))
    number = F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(
        F.when(is_number_text(text), text.try_cast("double"))
    )
    rounded = F.round(number, 0)
    digits = F.translate(F.format_number(F.abs(rounded), 0), ",", ".")
    sign = F.when(rounded < 0, F.lit("-")).otherwise(F.lit(""))
    bad = number.isNull() | F.isnan(number)
    return F.when(bad, F.lit("$ 0")).otherwise(F.concat(sign, F.lit("$ "), digits))


def normalize_phone(phone: str | Column) -> Column:
    return F.concat(F.lit("whatsapp:+57"), F.regexp_replace(_column(phone), "[^0-9]", ""))


def first_rate(rate: str | Column) -> Column:
    """A usable exchange rate, or the fixed fallback."""
    return F.coalesce(F.nullif(_column(rate).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")),
                      F.lit(FALLBACK_COP_PER_USD).cast("decimal(18,6)"))
