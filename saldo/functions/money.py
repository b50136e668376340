"""Money columns: parsing of written amounts, formatting, tolerance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def parse_amount(text: Column | str) -> Column:
    """DECIMAL(18,2) of an amount written the Indonesian or the English way; null if there is none.

    The separator that comes last is the decimal point when both stand in the text; a lone separator is one only when one
    or two digits follow it.
    """
    c = F.col(text) if isinstance(text, str) else text
    d = F.regexp_extract(c, r"(-?\d[\d.,]*)", 1)
    d = F.regexp_replace(d, r"[.,]+$", "")
    dot, comma = F.length(d) - F.instr(F.reverse(d), "."), F.length(d) - F.instr(F.reverse(d), ",")
    has_dot, has_comma = d.contains("."), d.contains(",")
    comma_last = F.regexp_replace(F.regexp_replace(d, r"\.", ""), ",", ".")
    dot_last = F.regexp_replace(d, ",", "")
    plain = F.regexp_replace(d, "[.,]", "")
    out = (F.when(has_dot & has_comma & (comma > dot), comma_last).when(has_dot & has_comma, dot_last)
           .when(has_comma & d.rlike(r"^-?\d+,\d{1,2}$"), comma_last).when(has_dot & d.rlike(r"^-?\d+\.\d{1,2}$"), d).otherwise(plain))
    return out.try_cast(MONEY)


def idr(amount: Column) -> Column:
    """`Rp1.234,50`, without decimals where they are zero; a dash for null."""
    whole = F.abs(F.round(amount) - amount) < 0.005
    text = F.translate(F.when(whole, F.format_number(F.abs(amount), 0)).otherwise(F.format_number(F.abs(amount), 2)), ",.", ".,")
    return F.coalesce(F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("Rp"), text), F.lit("—"))


def same_money(a: Column, b: Column) -> Column:
    """Equal at two decimals."""
    return F.coalesce(a.cast(MONEY) == b.cast(MONEY), F.lit(False))
