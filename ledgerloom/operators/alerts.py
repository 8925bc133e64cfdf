"""Bank alerts by mail: which messages tell of a payment, what they say, and a fingerprint that statements share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of senders' domains and the bank of each.
BANKS = {
    "hdfcbank.net": "HDFC Bank", "hdfcbank.com": "HDFC Bank", "icicibank.com": "ICICI Bank", "icicibank.co.in": "ICICI Bank", "sbi.co.in": "State Bank of India", "sbi.com": "State Bank of India",
    "axisbank.com": "Axis Bank", "axisbank.co.in": "Axis Bank", "kotak.com": "Kotak Mahindra Bank", "indusind.com": "IndusInd Bank", "pnb.co.in": "Punjab National Bank", "canarabank.com": "Canara Bank",
    "canarabank.in": "Canara Bank", "bankofbaroda.com": "Bank of Baroda", "bankofbaroda.co.in": "Bank of Baroda", "federalbank.co.in": "Federal Bank", "idfcfirstbank.com": "IDFC FIRST Bank", "yesbank.in": "Yes Bank",
}
#: Words of a payment, of codes, of statements and of offers; payment modes in the order tried.
VERBS = "debited|credited|spent|withdrawn|transferred|deposited|received|paid|sent|payment|txn|transaction|purchase|charge|auto-debited"
CODES, STATEMENTS = "otp|one time password|verification code|security code", "e-statement|account statement|monthly statement"
OFFERS = "special offer|loan offer|credit card offer|pre-approved|apply now"
IN_WORDS, OUT_WORDS = "credited|deposited|received|paid in|inflow", "debited|spent|withdrawn|paid to|transferred|outflow|purchase"
MODES = ["UPI", "IMPS", "NEFT", "RTGS", "POS", "ATM", "NetBanking", "Credit Card", "Debit Card"]

#: Signs of money, words before an account's digits, before a balance, before a reference and before a party.
MONEY, ACCOUNT_WORDS, BALANCE_WORDS = ("RS", "INR", "₹"), ("A/C", "AC", "ACCOUNT", "CARD", "ENDING"), ("BAL", "BALANCE")
REFERENCE_WORDS, PARTY_WORDS, NOT_PARTY = ("REF", "REFERENCE", "TXN", "UTR"), ("TO", "AT", "TOWARDS", "INFO"), ("A/C", "ACCOUNT", "RS", "INR", "CARD")
#: Words that may stand between such a word and its value, and words that end a party's name.
FILLERS, PARTY_ENDS = ("NO", "NUM", "ID", "IS", "NUMBER"), ("ON", "REF", "AVAIL", "BAL")
_MASKED = "^[Xx*]{2,12}[0-9]{4}$"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def _tokens(said: Column) -> Column:
    """A message as words: blanks split it, a sign of money is a word of its own, and closing punctuation is one too."""
    spaced = F.regexp_replace(said, r"(?i)(₹|\b(?:rs\.?|inr)(?=\s*\d))", " $1 ")
    return F.filter(F.split(F.regexp_replace(spaced, r"([.,;:!?])(?=\s|$)", " $1 "), r"\s+"), lambda t: t != "")


def _bound(value: Column, f) -> Column:
    """f of a value that is found once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _first(at: Column) -> Column:
    """The first value of an array of candidates that is not null."""
    return F.get(F.array_compact(at), 0)


def _is(token: Column, words: tuple[str, ...]) -> Column:
    return F.rtrim(F.upper(token), F.lit(".:")).isin(*words)


def _after(tokens: Column, i: Column, n: int) -> Column:
    """The n-th token after place i that is neither a filler nor punctuation, as far as six tokens on."""
    rest = F.filter(F.slice(tokens, i + 2, 6), lambda t: ~_is(t, FILLERS) & ~t.rlike(r"^[.,;:!?]+$"))
    return F.get(rest, n)


def _amount(token: Column) -> Column:
    """Minor units of a token that is a number with at most two decimals, else null."""
    return F.when(token.rlike(r"^[0-9][0-9,]*([.][0-9]{1,2})?$"), F.round(F.replace(token, F.lit(",")).try_cast("decimal(20,2)") * 100).cast("long"))


def bank_of(sender: Column) -> Column:
    """The bank by the end of the sender's domain; null if it is none of BANKS."""
    domain = F.lower(F.regexp_extract(sender, r"@([A-Za-z0-9.\-]+)", 1))
    return _bound(domain, lambda d: F.coalesce(*[F.when(d.endswith(end), name) for end, name in BANKS.items()]))


def verdict(bank: Column, said: Column) -> Column:
    """alert, or why a message is none: sender, code, statement, offer, no_verb. Of codes, statements and offers the first named counts."""
    verb = said.rlike(rf"(?i)\b({VERBS})\b")
    first = F.lower(F.regexp_extract(said, rf"(?i)\b({CODES}|{STATEMENTS}|{OFFERS}|congratulations)\b", 1))
    told = lambda f: F.when(f.rlike(f"^({CODES})$"), "code").when(f.rlike(f"^({STATEMENTS})$") & ~verb, "statement").when(f.rlike(f"^({OFFERS})$"), "offer").when(~F.coalesce(verb, F.lit(False)), "no_verb").otherwise("alert")
    return F.when(bank.isNull(), "sender").otherwise(_bound(first, told))


def direction(said: Column) -> Column:
    """The kind of word that stands first; debit if both start at one place or none is there."""
    into, out = (F.regexp_instr(said, F.lit(rf"(?i)\b({w})\b")) for w in (IN_WORDS, OUT_WORDS))
    return F.when((into > 0) & ((out == 0) | (into < out)), "credit").otherwise("debit")


def fields(said: Column) -> dict[str, Column]:
    """amount_paise, last4, party, balance_paise, reference_no and day_text of a message, read from neighbouring words.

    The amount is the first number after a sign of money; the balance the first number within reach of a word for it; the
    account's digits the last four after an account word, else of a masked number anywhere; the reference a code of 6 to 22
    letters and digits, one a digit, after a word for it; the party an address or the words up to an end word after
    `to`, `at`, `towards` or `info`; the day a token of day, month and year (also as three words).
    """
    got = _read(said)
    return {k: got[k] for k in ("amount_paise", "last4", "party", "balance_paise", "reference_no", "day_text")}


def _read(said: Column) -> Column:
    """The fields of a message as a struct; its tokens are found once, and looked at once for where fields can start."""
    return _bound(_tokens(said), lambda ts: _bound(_marks(ts), lambda marks: F.struct(*[v.alias(k) for k, v in _fields_of(ts, marks).items()])))


def _marks(ts: Column) -> Column:
    """t, i and u (upper-cased) of the tokens at which a field can start: words before a value, digits, masked numbers."""
    each = F.transform(ts, lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.rtrim(F.upper(t), F.lit(".:")).alias("u")))
    words = {*MONEY, *ACCOUNT_WORDS, *BALANCE_WORDS, *REFERENCE_WORDS, *PARTY_WORDS}
    return F.filter(each, lambda m: m["u"].isin(*sorted(words)) | m["t"].rlike(rf"^[0-9]|{_MASKED}"))


def _fields_of(ts: Column, marks: Column) -> dict[str, Column]:
    """The fields of a message's tokens and marks, for fields."""
    each = lambda f: _first(F.transform(marks, f))
    is_ = lambda m, words: m["u"].isin(*words)
    at = lambda i, n: _after(ts, i, n)
    digits = lambda t: F.when(t.rlike(r"^[Xx*]*[0-9]{4}$"), F.right(t, F.lit(4)))
    amount = each(lambda m: F.when(is_(m, MONEY), _amount(at(m["i"], 0))))
    account = each(lambda m: F.when(is_(m, ACCOUNT_WORDS), _bound(at(m["i"], 0), digits)))
    masked = each(lambda m: F.when(m["t"].rlike(_MASKED), F.right(m["t"], F.lit(4))))
    balance = each(lambda m: F.when(is_(m, BALANCE_WORDS), F.coalesce(_amount(at(m["i"], 0)), F.when(_is(at(m["i"], 0), MONEY), _amount(at(m["i"], 1))))))
    code = lambda t: F.when(t.rlike(r"^[A-Za-z0-9]{6,22}$") & t.rlike("[0-9]"), t)
    reference = each(lambda m: F.when(is_(m, REFERENCE_WORDS), _bound(at(m["i"], 0), code)))
    address = each(lambda m: F.when(is_(m, PARTY_WORDS), _bound(at(m["i"], 0), lambda t: F.when(t.rlike(r"^[\w.-]+@[A-Za-z]+$"), t))))

    def name(m: Column) -> Column:
        def told(rest: Column) -> Column:
            stop = _first(F.transform(rest, lambda w, k: F.when(_is(w, PARTY_ENDS) | w.rlike(r"^[.,;:!?]+$") & (k > 0), k)))
            return F.array_join(F.filter(F.slice(rest, F.lit(1), F.coalesce(stop, F.size(rest))), lambda w: w != ":"), " ")

        def party(words: Column) -> Column:
            barred = F.arrays_overlap(F.transform(F.split(words, " "), lambda w: F.rtrim(F.upper(w), F.lit("."))), F.array(*map(F.lit, NOT_PARTY)))
            return F.when(F.length(words).between(2, 30) & words.rlike(r"^[A-Za-z0-9 .&]+$") & ~barred, words)

        return F.when(is_(m, PARTY_WORDS), _bound(_bound(F.slice(ts, m["i"] + 2, 8), told), party))

    is_month = lambda m: m.rlike("^[0-9]{1,2}$") | F.upper(m).isin(*MONTHS)

    def day(m: Column) -> Column:
        t = m["t"]
        dated = lambda p: (F.size(p) == 3) & F.get(p, 0).rlike("^[0-9]{1,2}$") & is_month(F.get(p, 1)) & F.get(p, 2).rlike("^[0-9]{2,4}$")
        spelt = _bound(F.slice(ts, m["i"] + 1, 3), lambda near: F.when(dated(near) & ~F.get(near, 1).rlike("^[0-9]"), F.array_join(near, " ")))
        return F.when(t.rlike("^[0-9]"), F.coalesce(F.when(_bound(F.split(t, "[-/]"), dated), t), spelt))

    return {"amount_paise": amount, "last4": F.coalesce(account, masked), "party": F.coalesce(address, each(name)), "balance_paise": balance, "reference_no": reference, "day_text": each(day)}


def fingerprint(bank: Column, last4: Column, amount_paise: Column, side: Column, ref: Column, day: Column) -> Column:
    """One text for a payment whichever channel tells of it: bank, last four digits, amount, side, reference and day."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.lower(x.cast("string")), F.lit("none")) for x in (bank, last4, amount_paise, side, ref, day)]), 256)


def parse(messages: DataFrame) -> DataFrame:
    """messages(sender, subject, body, ...) with bank, verdict and, for alerts, amount_paise, direction, last4, mode, party,
    balance_paise, reference_no, day_text and fingerprint (null for other messages, as is the fingerprint without an amount).

    Null subjects and bodies are empty; no message is dropped.
    """
    said = F.concat_ws(" ", "subject", "body")
    x = messages.withColumn("bank", bank_of(F.col("sender")))
    x = x.withColumn("verdict", verdict(F.col("bank"), said))
    read = F.col("read_")
    mode = F.coalesce(*[F.when(said.rlike(rf"(?i)\b{m}\b"), m) for m in MODES])
    named = {"amount_paise": read["amount_paise"], "direction": direction(said), "last4": read["last4"], "mode": mode, **{k: read[k] for k in ("party", "balance_paise", "reference_no", "day_text")}}
    x = x.select("*", F.inline(F.array(F.struct(F.when(F.col("verdict") == "alert", _read(said)).alias("read_")))))
    told = F.when(F.col("verdict") == "alert", F.struct(*[v.alias(k) for k, v in named.items()]))
    # a generator of one row: fields are found once and conditions on them are not unfolded into all their expressions
    x = x.drop(*named).select("*", F.inline(F.array(told))).drop("read_")
    return x.withColumn("fingerprint", F.when(F.col("amount_paise").isNotNull(), fingerprint(*[F.col(c) for c in ("bank", "last4", "amount_paise", "direction", "reference_no", "day_text")])))
