"""Scalar functions: literals, names, dates, number formats. Columns stay in the JVM; ``decimal`` serves the driver's reports."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def cut_datatype(c: Column) -> Column:
    """``"12"^^xsd:integer`` to ``"12"``; language tags stay."""
    return F.regexp_replace(c, r'"\^\^.*$', '"')


def quote_literal(c: Column) -> Column:
    return F.when(c.startswith("<") | c.startswith('"'), c).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def wrap_entity(c: Column) -> Column:
    return F.when(c.startswith("<"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def url_unquote(c: Column) -> Column:
    """Percent codes decoded; a plus sign stays one."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def is_ascii(c: Column) -> Column:
    return c.rlike(r"\A[\x00-\x7F]*\z")


def html_escape(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def identifier(c: Column) -> Column:
    """All but letters, digits and underscores become underscores."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_")


def date_literal(c: Column) -> Column:
    """``3 May 1970`` or ``May 1970`` or ``1970`` as ``yyyy-mm-dd`` with ``##`` for what is missing; null for other text."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(c, r"([A-Z][a-z]+)\s+[0-9]{4}\s*$", 1))
    day = F.regexp_extract(c, r"^\s*([0-9]{1,2})\s+[A-Z]", 1)
    year = F.regexp_extract(c, r"([0-9]{4})\s*$", 1)
    return F.when(year != "", F.concat(year, F.lit("-"), F.when(month > 0, F.lpad(month.cast("string"), 2, "0")).otherwise("##"), F.lit("-"), F.when((day != "") & (month > 0), F.lpad(day, 2, "0")).otherwise("##")))


def ratio(a: Column, b: Column) -> Column:
    """Null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def decimal(value: float | None, places: int = 9) -> str:
    """At most so many places, rounded half to even, without trailing zeros."""
    if value is None:
        return "NaN"
    text = f"{Decimal(repr(float(value))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN):f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text
