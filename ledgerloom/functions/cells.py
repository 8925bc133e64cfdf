"""Further cell and narration expressions: signed amounts, times, numbers that identify, keys for grouping, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names that a narration's shape leaves out.
MONTHS = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|SEPT|OCT|NOV|DEC|JANUARY|FEBRUARY|MARCH|APRIL|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER"


def signed_paise(c: Column) -> Column:
    """Minor units of a books cell, halves to even: parentheses or a leading minus are negative, Dr, Cr and currency signs are dropped; null if unreadable."""
    s = F.trim(F.regexp_replace(F.upper(c), r"(CR|DR)\.?\s*$", ""))
    held = s.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(s, r"[^0-9.-]", "")
    digits = F.regexp_replace(bare, "^-", "")
    value = F.bround(F.when(digits.rlike(r"^(\d{1,14}\.?\d*|\.\d+)$"), digits.cast("decimal(24,6)")) * 100, 0).cast("long")
    return F.when(held | bare.startswith("-"), -value).otherwise(value)


def major(c: Column) -> Column:
    return (c.cast("decimal(20,2)") / 100).cast("decimal(20,2)")


def clock(c: Column) -> Column:
    """HH:MM:SS of the first time in a text, of 12 or 24 hours; null if there is none."""
    part = lambda i: F.regexp_extract(F.upper(c), r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AP]M)?", i)
    hour, half = F.try_to_number(part(1), F.lit("99")).cast("int"), part(4)
    hour = F.when(half == "PM", hour % 12 + 12).when(half == "AM", hour % 12).otherwise(hour)
    return F.when((part(1) != "") & (hour < 24) & (part(2) < "60"), F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), part(2), F.when(part(3) == "", "00").otherwise(part(3))))


def is_upi(*cs: Column) -> Column:
    return F.coalesce(F.upper(F.concat_ws(" ", *cs)).rlike(r"(^|[^A-Z])UPI([^A-Z]|$)"), F.lit(False))


def norm_id(c: Column) -> Column:
    """Upper-case letters and digits; of digits alone without leading zeros."""
    x = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    return F.when(x.rlike("^[0-9]+$"), F.regexp_replace(x, "^0+", "")).otherwise(x)


def strong_ids(c: Column, amount_paise: Column) -> Column:
    """Tokens that can identify a payment: six digits and more, or 10 to 22 letters and digits with six digits; not the row's own amount
    and not a day of 2000 to 2099 in eight digits (six are a cheque number more often than a day)."""
    is_day = lambda t: F.try_to_timestamp(t, F.lit("ddMMyyyy")).isNotNull() & F.substring(t, 5, 2).eqNullSafe("20") | F.try_to_timestamp(t, F.lit("yyyyMMdd")).isNotNull() & t.startswith("20")
    tokens = F.filter(F.split(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+"), lambda t: t.rlike("^[0-9]{6,}$") | (t.rlike("^[A-Z0-9]{10,22}$") & (F.length(F.regexp_replace(t, "[^0-9]", "")) >= 6)))
    tokens = F.filter(tokens, lambda t: ~(t.rlike("^[0-9]{8}$") & is_day(t)))
    ids = F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+", "")).otherwise(t))
    return F.sort_array(F.array_distinct(F.filter(ids, lambda t: (t != amount_paise.cast("string")) & (F.length(t) >= 6))))


def same_narration(a: Column, b: Column) -> Column:
    """Equal compact narrations, one a prefix of the other of eight characters and more, or a common run of nine digits."""
    x, y = (F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "") for c in (a, b))
    short = F.least(F.length(x), F.length(y))
    runs = [F.regexp_extract_all(z, F.lit("[0-9]{9,}"), 0) for z in (x, y)]
    return (x == y) | ((short >= 8) & (F.substring(x, F.lit(1), short) == F.substring(y, F.lit(1), short))) | F.arrays_overlap(*runs)


def shape_key(c: Column) -> Column:
    """Up to six words of a narration without digits and months."""
    words = F.filter(F.split(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+"), lambda w: (w != "") & ~w.rlike("[0-9]") & ~w.rlike(f"^({MONTHS})$"))
    return F.array_join(F.slice(words, 1, 6), " ")


def instalment(principal: Column, yearly_percent: float, months: int) -> Column:
    """Equal monthly instalment in the unit of principal, rounded; at rate zero the principal over the months."""
    r = yearly_percent / 1200
    factor = r * (1 + r) ** months / ((1 + r) ** months - 1) if r else 1 / months
    return F.round(principal * F.lit(factor)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def month_ordinal(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def fiscal_quarter(day: Column) -> Column:
    """Year in which the fiscal year (from April) begins, and its quarter, as '2001-Q2'."""
    shifted = F.add_months(day, -3)
    return F.concat(F.year(shifted).cast("string"), F.lit("-Q"), F.quarter(shifted).cast("string"))
