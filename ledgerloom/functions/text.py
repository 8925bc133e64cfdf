"""Parsing and text expressions of the ledger, all JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount(c: Column) -> Column:
    """Minor units of an amount cell: grouping, symbols and Cr/Dr stripped, sign dropped; null where unreadable or zero."""
    s = F.regexp_replace(F.regexp_replace(F.upper(c), r"(CR|DR|INR|RS\.?|₹)", ""), r"[,\s()+-]", "")
    good = s.rlike(r"^\d{1,14}(\.\d+)?$")
    return F.nullif(F.when(good, F.round(s.cast("decimal(24,6)") * 100).cast("long")), F.lit(0))


def amount_side(c: Column) -> Column:
    return F.when(F.upper(c).rlike(r"CR\.?\s*$"), "credit").when(F.upper(c).rlike(r"DR\.?\s*$") | c.rlike(r"^\s*\("), "debit")


#: Date formats in the order in which they are tried, day first; then those without a year.
DATE_FORMATS = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "d/M/yy", "d-M-yy", "d.M.yy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "d-MMM-yy", "dMMMyyyy", "dMMMyy", "MMM d, yyyy", "MMM d yyyy", "yyyyMMdd"]
YEARLESS = ["d MMM", "MMM d"]


def date(c: Column, first_year: int = 1990, last_year: int = 2100, this_year: int | None = None) -> Column:
    """The day by the first format that gives a year in range; two-digit years from 69 are of the last century.

    A day without a year is of `this_year`, and null if that is not given.
    """
    def parsed(s: Column, format: str, more: str = "") -> Column:
        # only cells of the format's shape are parsed, and once, as trying all formats on each takes most of the time
        cell, whole = (F.concat(s, F.lit(more)), f"{format} yyyy") if more else (s, format)
        days = F.array(F.try_to_timestamp(cell, F.lit(whole)).cast("date"))
        if "yy" in format and "yyyy" not in format:
            days = F.transform(days, lambda d: F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d))
        return F.when(s.rlike(_shape(format)), F.get(F.filter(days, lambda d: F.year(d).between(first_year, last_year)), 0))

    def found(s: Column) -> Column:
        yearless = [] if this_year is None else [parsed(s, f, f" {this_year}") for f in YEARLESS]
        return F.coalesce(*[parsed(s, f) for f in DATE_FORMATS], *yearless)

    # the cell's own expression is found once, not for each format
    return F.get(F.transform(F.array(F.trim(c)), found), 0)


def _shape(format: str) -> str:
    """A pattern that every cell of a date format fits."""
    kinds = {"yyyy": "[-+]?[0-9]{4,}", "yy": "[0-9]{2}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]+", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "M": "[-+]?[0-9]+", "d": "[-+]?[0-9]+"}
    return "^" + re.sub("yyyy|yy|MMMM|MMM|MM|M|dd|d|.", lambda m: kinds.get(m[0], re.escape(m[0])), format) + "$"


def mask(c: Column) -> Column:
    """All but the last four letters and digits starred; short ones wholly."""
    s = F.regexp_replace(c, "[^A-Za-z0-9]", "")
    n = F.length(s)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(s, F.lit(4))))


def reference(c: Column) -> Column:
    """The first run of 10 to 22 letters and digits that is neither all letters nor all digits."""
    runs = F.regexp_extract_all(F.upper(c), F.lit(r"[A-Z0-9]{10,22}"), 0)
    return F.get(F.filter(runs, lambda r: r.rlike("[A-Z]") & r.rlike("[0-9]")), 0)


def series_key(c: Column) -> Column:
    """Up to four words of a narration that are no numbers, without long digit runs, joined by spaces."""
    s = F.regexp_replace(F.regexp_replace(F.upper(c), r"[0-9]{6,}", " "), r"[^A-Z0-9]+", " ")
    words = F.filter(F.split(s, " "), lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.slice(words, 1, 4), " ")


def skeleton(c: Column) -> Column:
    """Consonants only, an H only where it is the first, repeats collapsed, at most 12."""
    s = F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z]|[AEIOU]", ""), "(?<!^)H", "")
    return F.substring(F.regexp_replace(s, r"(.)\1+", "$1"), 1, 12)


#: Digits that scans put for letters; letters and all that scans make of them.
READ_AS = {"0": "O", "1": "I", "5": "S", "8": "B"}
SCANNED = {"O": "O0", "I": "I1", "S": "S5", "B": "B8", "L": "L1"}


def repaired(c: Column) -> Column:
    """Upper-cased text whose words of two letters or more, with at most half as many digits, have letters for digits that scans confuse; numbers stay."""
    runs = F.regexp_extract_all(F.upper(c), F.lit(r"[A-Z0-9]+|[^A-Z0-9]+"), 0)
    letters, digits = lambda w: F.length(F.regexp_replace(w, "[^A-Z]", "")), lambda w: F.length(F.regexp_replace(w, "[^0-9]", ""))
    damaged = lambda w: (letters(w) >= 2) & (digits(w) > 0) & (digits(w) * 2 <= letters(w))
    return F.array_join(F.transform(runs, lambda w: F.when(damaged(w), F.translate(w, "".join(READ_AS), "".join(READ_AS.values()))).otherwise(w)), "")


def tolerant(word: str) -> str:
    """A pattern of a word as scans may have left it."""
    return "".join(f"[{SCANNED[x]}]" if x in SCANNED else re.escape(x) for x in word.upper())


def says(c: Column, *words: str) -> Column:
    """Whether a text has one of the words as a whole, in its own or a scan's spelling; null for null."""
    return F.upper(c).rlike(rf"(?<![A-Z0-9])({'|'.join(tolerant(w) for w in words)})(?![A-Z0-9])")


def row_hash(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def html_text(c: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, five entities decoded, blank space folded."""
    s = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet won't take for a formula."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)
