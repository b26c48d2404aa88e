"""Field predicates and conversions as Column expressions.

All of them are total: bad data yields ``false`` or NULL, never an error, so one bad row
cannot fail a job under ANSI mode.
"""

from __future__ import annotations

from string import ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns, limits and tolerances that decide the results ---------------
# `\z` ends each pattern because `$` would also match before a trailing newline.
IBAN_FORMAT = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]+\z"
IBAN_CHARACTERS = r"^[A-Za-z0-9]{5,34}\z"
IBAN_PLAIN = r"^[A-Z]{2}[0-9]{3,32}\z"
BIC_FORMAT = r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?\z"
CURRENCY_FORMAT = r"^[A-Z]{3}\z"
INTEGER_FORMAT = r"^[+-]?[0-9]+\z"
ISO_DATE_FORMAT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
OFFSET_DATE_TIME_FORMAT = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{0,9})?)?"
    r"([Zz]|[+-](0[0-9]|1[0-7]):[0-5][0-9](:[0-5][0-9])?|[+-]18:00(:00)?)\z"
)
DECIMAL_FORMAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
BLANK_FORMAT = r"^[\t-\r\x1c-\x1f[\p{Z}&&[^\u00a0\u2007\u202f]]]*\z"
PAYMENT_METHODS = ("TRF", "CHK")
MAX_MESSAGE_ID = 35
SUM_TOLERANCE = "0.001"
DOMAIN_SUM_TOLERANCE = "0.005"
# ------------------------------------------------------------------------------------------

# The only control characters XML 1.0 admits, plus the blank.
XML_SPACE = " \t\n\r"


def null_or_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def null_or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(BLANK_FORMAT)


def trim_text(c: Column) -> Column:
    """Element text without surrounding white space."""
    return F.btrim(c, F.lit(XML_SPACE))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; differs from ``length`` outside the basic plane."""
    return F.octet_length(F.encode(c, "UTF-16BE")) / 2


def iban_format_bad(c: Column) -> Column:
    """NULL is not flagged."""
    return ~c.rlike(IBAN_FORMAT)


def _mod_97(digits: Column) -> Column:
    """The remainder of up to 50 digits, reduced in pieces that fit a long."""
    rest = F.substring(digits, 1, 18).cast("bigint") % 97
    for at in (19, 35):
        rest = F.concat(rest.cast("string"), F.substring(digits, at, 16)).cast("bigint") % 97
    return rest


def iban_valid(c: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10..35, mod 97 is 1.

    Most account numbers have no letters but the country's, two of A-Z; only others go through the replacement of
    each letter. The tests are inside ``exists``, so that a value which is itself computed is computed once.
    """

    def letter(text: Column) -> Column:
        return (F.ascii(text) - 55).cast("string")

    def lettered(iban: Column) -> Column:
        # The number, of 68 digits at most, is reduced in pieces that fit a long.
        digits = F.upper(F.concat(F.substring(iban, 5, 30), F.substring(iban, 1, 4)))
        for i, capital in enumerate(ascii_uppercase):
            digits = F.replace(digits, F.lit(capital), F.lit(str(10 + i)))
        pieces = F.regexp_extract_all(digits, F.lit("[0-9]{1,16}"), F.lit(0))
        rest = F.aggregate(
            pieces,
            F.lit(0).cast("bigint"),
            lambda rest, piece: F.concat(rest.cast("string"), piece).try_cast("bigint") % 97,
        )
        return rest == 1

    def valid(iban: Column) -> Column:
        digits = F.concat(F.substring(iban, 5, 30), letter(iban), letter(F.substring(iban, 2, 1)), F.substring(iban, 3, 2))
        plain = F.exists(F.array(digits), lambda d: _mod_97(d) == 1)
        shaped = F.coalesce(iban.rlike(IBAN_CHARACTERS), F.lit(False))
        return F.when(iban.rlike(IBAN_PLAIN), plain).when(shaped, lettered(iban)).otherwise(F.lit(False))

    return F.exists(F.array(c), valid)


def bic_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(BIC_FORMAT), F.lit(False))


def currency_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(CURRENCY_FORMAT), F.lit(False))


def amount_valid(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def amount_not_positive(c: Column, strict: bool = False) -> Column:
    """``strict`` also flags a missing amount."""
    return (c.isNull() | (c <= 0)) if strict else (c <= 0)


def control_sum_valid(c: Column) -> Column:
    return F.coalesce(c >= 0, F.lit(False))


def control_sums_match(declared: Column, total: Column) -> Column:
    """Both sides rounded half up to cents, equal within half a cent."""
    difference = F.abs(F.round(declared, 2) - F.round(total, 2))
    return difference < F.lit(DOMAIN_SUM_TOLERANCE).cast("decimal(6,3)")


def sums_differ(declared: Column, actual: Column, exact: bool) -> Column:
    """Tolerance test in exact decimals, or in doubles as the SQL form of the check has it."""
    if exact:
        return F.abs(declared - actual) > F.lit(SUM_TOLERANCE).cast("decimal(4,3)")
    return F.abs(declared.cast("double") - actual.cast("double")) > F.lit(float(SUM_TOLERANCE))


def offset_date_time_valid(c: Column) -> Column:
    """ISO 8601 date-time with a mandatory offset, on an existing calendar day."""
    day = F.substring(c, 1, 10).try_cast("date")
    return F.coalesce(c.rlike(OFFSET_DATE_TIME_FORMAT) & day.isNotNull(), F.lit(False))


def payment_method_unknown(c: Column) -> Column:
    return ~F.coalesce(c.isin(*PAYMENT_METHODS), F.lit(False))


def count_exact(c: Column) -> Column:
    """A declared count, or NULL when it is not an integer."""
    return F.when(c.rlike(INTEGER_FORMAT), c.try_cast("bigint"))


def count_sql(c: Column) -> Column:
    """A declared count under SQL cast rules: blanks around it and fractions (rounded) pass."""
    return c.try_cast("decimal(38,0)").try_cast("bigint")


def count_sql_bad(c: Column) -> Column:
    """True for a value on which the SQL cast of a declared count would fail."""
    return c.isNotNull() & count_sql(c).isNull()


def decimal_text(c: Column, precision: int, scale: int) -> Column:
    """A decimal from text, rounded half up; NULL when the text is not a number."""
    return F.when(c.rlike(DECIMAL_FORMAT), c.try_cast(f"decimal({precision},{scale})"))


def iso_date_text(c: Column) -> Column:
    """A date from strict ``yyyy-MM-dd`` text; NULL otherwise."""
    return F.when(c.rlike(ISO_DATE_FORMAT), c.try_cast("date"))


def double_text(c: Column) -> Column:
    """A number the way a finding's text shows it."""
    return F.coalesce(c.cast("double").cast("string"), F.lit("null"))


def shown(c: Column) -> Column:
    """Any value as text, NULL as the word null."""
    return F.coalesce(c.cast("string"), F.lit("null"))
