"""What a narration tells: cleaned scans, a foreign leg, the other party. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies other than the base and their decimals.
DECIMALS = {"USD": 2, "EUR": 2, "GBP": 2, "AED": 2, "SGD": 2, "JPY": 0, "AUD": 2, "CAD": 2, "CHF": 2, "HKD": 2, "SAR": 2, "SEK": 2}
#: Words before a currency that make its figure a fee, and how many characters before it count.
FEE_WORDS = "CHARGE|CHARGES|COMMISSION|FEE|FEES|GST|TCS|TDS|LEVY|WITHHOLDING"
FEE_REACH = 24
#: Narrations that begin so have no other party.
NO_PARTY = "BY CASH|TO CASH|CASH ?DEP(OSIT)?|ATM|CHQ|CHEQUE|CLG|CLEARING|INTEREST|PENAL|SERVICE ?CHARGE|[SCI]?GST|TDS|SETTLEMENT|CHARGES?|MIN ?BAL|SMS ?CHG"
#: Parts of a narration that name a rail, a side or a menu.
RAILS = "UPI|NEFT|RTGS|IMPS|INFT|IFT|MMT|ACH|NACH|BIL|ONL|BPAY|INF|VAT|EBANK|WIB|MB|POS|INB|CR|DR|P2A|P2M|(TO|BY) TRANSFER"
#: Words that end a name or belong to its legal form.
FORMS = "PVT|PRIVATE|PUBLIC|LTD|LIMITED|LLP|LLC|INC|CORP|COMPANY|CO|ENTERPRISES|ENTERPRISE|INDIA|IND"
TAILS = "NETBANK|NET ?BANKING|MOBILE|MOB|INB|ATM|BRANCH|BR|ONLINE|NEFT|RTGS|IMPS|UPI|PAYMENTS?|TRANSFER|TRF|COLLECT|COLL|NEW|OLD|ACCOUNT|ACC|CURRENT|SAVINGS"


def ocr_clean(c: Column) -> Column:
    """Scanned text without invisible characters, blanks folded, and O, I, l and S read as digits in runs that are
    numbers otherwise and have a digit. Letters are not recomposed (no built-in does it); null stays null."""
    s = F.regexp_replace(F.regexp_replace(c, r"[\p{Cf}\p{Cc}&&[^\n\t]]", ""), r"[ \t]+", " ")
    runs = F.regexp_extract_all(s, F.lit(r"[0-9A-Za-z.,]+|[^0-9A-Za-z.,]+"), 0)
    return F.trim(F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9OoIlS.,]+$") & r.rlike("[0-9]"), F.translate(r, "OoIlS", "00115")).otherwise(r)), ""))


def _figure(token: Column) -> Column:
    """The number that a run of digits, commas and points is, else null: one point with one to four decimals at most, groups
    of two or three digits after commas; a whole number without commas has three digits at most, as longer ones are codes."""
    whole, part = F.split_part(token, F.lit("."), F.lit(1)), F.split(token, "[.]")
    groups = F.split(whole, ",")
    grouped = F.forall(groups, lambda g: F.length(g).between(2, 3) | (g == F.get(groups, 0)) & F.length(g).between(1, 3))
    fits = F.when(F.size(part) == 1, grouped).when((F.size(part) == 2) & F.length(F.get(part, 1)).between(1, 4), grouped | (F.size(groups) == 1))
    return F.when(fits, F.replace(token, F.lit(",")).try_cast("decimal(20,4)"))


def fx_leg(c: Column, booked_paise: Column) -> Column:
    """struct(currency, amount_minor, rate decimal, quoted) of the foreign amount that a narration names, else null.

    Null too where a fee word stands shortly before, or where a quoted rate misses the booked amount by over 5 %.
    """
    s = F.upper(c)
    codes, run = "|".join(DECIMALS), "[0-9]+(?:[.,][0-9]+)*"
    after, before = rf"\b({codes})\s*({run})\b", rf"\b({run})\s*({codes})\b"
    leads = s.rlike(after)
    code = F.when(leads, F.regexp_extract(s, after, 1)).otherwise(F.regexp_extract(s, before, 2))
    value = _figure(F.when(leads, F.regexp_extract(s, after, 2)).otherwise(F.regexp_extract(s, before, 1)))
    place = F.when(leads, F.regexp_instr(s, F.lit(after))).otherwise(F.regexp_instr(s, F.lit(before)))
    lead = F.substring(s, F.greatest(place - FEE_REACH, F.lit(1)), F.least(place - 1, F.lit(FEE_REACH)))
    scale = F.when(code == "JPY", 1).otherwise(100)
    minor = F.round(value * scale).cast("long")
    rate = F.nullif(F.regexp_extract(s, r"(?:@|\bRATE\b)\s*:?\s*(\d+(?:\.\d{1,6})?)", 1), F.lit("")).cast("decimal(16,6)")
    rate = F.when(rate.between(F.lit("0.001").cast("decimal(16,6)"), F.lit(100000)), rate)
    drift = F.abs(value * rate * 100 - booked_paise)
    good = (minor > 0) & ~lead.rlike(rf"\b({FEE_WORDS})\b") & ~F.coalesce((booked_paise > 0) & (drift * 20 > booked_paise), F.lit(False))
    return F.when(good, F.struct(code.alias("currency"), minor.alias("amount_minor"), rate.alias("rate"), rate.isNotNull().alias("quoted")))


def effective_rate(leg: Column, booked_paise: Column) -> Column:
    """Base units for one foreign unit: as quoted, else by the two amounts, to eight places."""
    scale = F.when(leg["currency"] == "JPY", 100).otherwise(1)
    implied = booked_paise.cast("decimal(18,0)") / (leg["amount_minor"] * scale).cast("decimal(18,0)")
    return F.coalesce(leg["rate"].cast("decimal(24,8)"), F.when((booked_paise > 0) & (leg["amount_minor"] > 0), F.round(implied, 8).cast("decimal(24,8)")))


def party(c: Column) -> Column:
    """Key of the other party: the first part of a narration that is a name, without legal form, long numbers and endings.

    One word with three digits and more, or with any right after NEFT or RTGS, is a code, not a name. Null for cash, charges and the like, and where no part
    has three letters in a row.
    """
    s = F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"\s+", " "), r"^RTN: ?", ""))
    parts = F.transform(F.split(s, r"[-/:*]+"), lambda p: F.trim(p))
    number = lambda p, i: p.rlike("^[A-Z]*[0-9]+[A-Z0-9]*$") & F.coalesce(F.get(parts, i - 1).isin("NEFT", "RTGS"), F.lit(False))
    names = F.filter(parts, lambda p, i: ~number(p, i) & p.rlike("[A-Z]{3,}") & ~p.rlike(f"^({RAILS})( (DR|CR))?$") & ~p.rlike("^(?=(.*[0-9]){3})[A-Z0-9]+$") & ~p.contains("@"))
    key = F.regexp_replace(F.get(names, 0), "[^A-Z0-9& ]", " ")
    key = F.regexp_replace(F.regexp_replace(key, rf"\b({FORMS})\b", " "), r"\b\d{5,}\b", " ")
    key = F.regexp_replace(F.trim(F.regexp_replace(key, " +", " ")), rf"( ({TAILS}))+$", "")
    return F.when(~s.rlike(rf"^({NO_PARTY})\b") & key.rlike("[A-Z]{3,}"), key)
