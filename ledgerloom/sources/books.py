"""Books (ledgers of bank accounts) in delimited files: the role of each column by its name and its cells, the sides of
each file by its own rows, then entries and one batch a file.

Every file of a path is read by itself, all in one scan; what is kept of a file is a row of its header and roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells, text
from ..plans.scratch import stored
from . import statements

#: Words of column names by field, in the order in which they are looked for.
KEYWORDS = {
    "entry_date": ["date", "entry date", "txndate", "txn date", "voucher date"],
    "voucher_no": ["voucher no", "vch no", "voucher_no", "voucher number", "ref no"],
    "voucher_type": ["voucher type", "vch type", "type"],
    "narration": ["narration", "particulars", "description", "remarks"],
    "party_name": ["party", "party name", "ledger", "account name"],
    "instrument_no": ["instrument no", "chq no", "cheque no", "ref", "instrument_no", "cheque/ref no"],
    "instrument_date": ["instrument date", "chq date", "cheque date"],
    "money_in": ["debit", "dr", "deposit", "receipt", "money in", "inflow"],
    "money_out": ["credit", "cr", "withdrawal", "payment", "money out", "outflow"],
}
#: Name words that speak for a bank statement, and for books.
STATEMENT_WORDS = ["withdrawal", "deposit", "closing balance", "value date", "balance_dr_cr", "nature_of_transaction", "cheque no."]
BOOKS_WORDS = ["particulars", "vch type", "vch no", "voucher", "ledger"]
#: The least score of a role, the share of cells that must be numbers or days, the share of numbers that must differ.
LEAST_SCORE, LEAST_SHAPE, LEAST_DISTINCT = 0.8, 0.9, 0.5

CONVENTIONS = ("debit_in", "debit_out")
_FIELDS = [*KEYWORDS, "balance"]
_TEXTS = ["voucher_no", "voucher_type", "narration", "party_name", "instrument_no"]


def _within(name: Column, word: str) -> Column:
    """word in name; words of two letters only as whole words, as "dr" is in "withdrawal" too."""
    return name.rlike(rf"(^|[^a-z]){word}([^a-z]|$)") if len(word) <= 2 else F.contains(name, F.lit(word))


def _named(name: Column, field: str) -> Column:
    """1 if the first word of the field that is in the name is the whole name, 0.8 if it is a part of it, else 0."""
    return F.coalesce(*[F.when(_within(name, w), F.when(name == w, 1.0).otherwise(0.8)) for w in KEYWORDS[field]], F.lit(0.0))


def lines(spark: SparkSession, path: str | DataFrame, sep: str | None = None, most_columns: int = 2000) -> DataFrame:
    """file, block, line (from 1, gapless, blank lines not counted) and cells of all files of a path, or of a table of file and content, stored.

    ValueError if there is no line at all, or where a line has more than most_columns, rather than leave its file out.
    """
    raw = statements.lines_in(path) if isinstance(path, DataFrame) else statements.lines_of(spark, path)
    known = stored(statements.layouts(raw, sep, most_columns=most_columns), "books-layouts")
    if wide := known.where(F.col("width") > most_columns).first():
        raise ValueError(f"{wide.file} has a line of {wide.width} columns")
    rows = statements.cells_of(raw, known.select("file", "encoding", "sep", "width"))
    if rows is None:
        raise ValueError(f"no books in {path}")
    return stored(rows.select("file", "block", (F.col("before") + F.col("k")).alias("line"), "cells"), "books-lines")


def roles(rows: DataFrame, head_lines: int = 30) -> DataFrame:
    """file, header_at, names, is_statement, literal (columns are just debit and credit) and the place of each field, null where no column fits.

    A file's header is the first of its first head_lines lines that names a day and a side and has no digit; else its first
    line. A column's score for a field is its name's, halved with the share of its cells that are numbers (sides) or days
    (days), or that differ (instrument numbers); columns below a share are none. The best of at least 0.8 takes the field,
    the first of equals. Where names are debit and credit (or dr and cr), these are the sides.
    """
    lower = F.transform("cells", lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^\ufeff", ""))
    side = lambda c: (_named(c, "money_in") > 0) | (_named(c, "money_out") > 0)
    head = F.exists(lower, lambda c: F.contains(c, F.lit("date"))) & F.exists(lower, side) & ~F.exists(lower, lambda c: c.rlike("[0-9]"))
    rank = F.when(head, F.col("line")).otherwise(F.col("line") + head_lines)
    heads = rows.where(F.col("line") <= head_lines).groupBy("file").agg(F.min(rank).alias("rank"), F.min_by(lower, rank).alias("names"))
    among = lambda w: F.exists("names", lambda c: F.contains(c, F.lit(w))).cast("int")
    told = lambda words: sum(among(w) for w in words)
    has = lambda w: F.array_contains("names", w)
    heads = heads.select(
        "file", F.when(F.col("rank") > head_lines, F.col("rank") - head_lines).otherwise(F.col("rank")).alias("header_at"), "names",
        ((told(STATEMENT_WORDS) > told(BOOKS_WORDS)) & (told(STATEMENT_WORDS) >= 2)).alias("is_statement"), ((has("debit") & has("credit")) | (has("dr") & has("cr"))).alias("literal"))
    heads = stored(heads, "books-heads")

    cell = rows.join(heads, "file").where("line > header_at").select("file", "names", F.posexplode("cells").alias("col", "raw"))
    cell = cell.select("file", "col", F.get("names", F.col("col")).alias("name"), F.trim("raw").alias("v")).where("v != ''")
    number = F.regexp_replace("v", "[^0-9.-]", "").rlike(r"^-?(\d+\.?\d*|\.\d+)$")
    day = F.col("v").rlike("[-/.]") & F.col("v").rlike("[0-9]")
    shape = cell.groupBy("file", "col", "name").agg(
        F.count("*").alias("filled"), F.count_if(number).alias("numbers"), F.count_if(day).alias("days"), F.count_distinct(F.when(_named(F.col("name"), "instrument_no") > 0, F.col("v"))).alias("values"))
    shape = shape.join(heads.select("file", "literal"), "file")

    def score(field):
        named = _named(F.col("name"), field)
        of = lambda c, least: F.when(F.col(c) / F.col("filled") >= least, named / 2 + F.col(c) / F.col("filled") / 2).otherwise(0.0)
        if field in ("money_in", "money_out"):
            exact = ("debit", "dr") if field == "money_in" else ("credit", "cr")
            return F.when(F.col("literal") & F.col("name").isin(*exact), 1.0).otherwise(of("numbers", LEAST_SHAPE))
        return of("days", LEAST_SHAPE) if field == "entry_date" else of("values", LEAST_DISTINCT) if field == "instrument_no" else named

    balance = F.when(F.contains("name", F.lit("balance")) & (F.col("numbers") / F.col("filled") >= LEAST_SHAPE), 1.0).otherwise(0.0)
    scores = F.array(*[F.struct(F.lit(f).alias("field"), score(f).alias("score")) for f in KEYWORDS], F.struct(F.lit("balance").alias("field"), balance.alias("score")))
    long = shape.select("file", "col", F.explode(scores).alias("x")).select("file", "col", "x.*").where(F.col("score") >= LEAST_SCORE)
    best = long.groupBy("file").pivot("field", _FIELDS).agg(F.max_by("col", F.struct("score", -F.col("col"))))
    return stored(heads.join(best, "file", "left"), "books-roles")


def typed_lines(rows: DataFrame, by: DataFrame) -> DataFrame:
    """Lines below their header with the cells of the roles: amounts of the two sides (blank and unreadable ones 0) and of the balance, texts, day."""
    cell = lambda f: F.nullif(F.trim(F.get("cells", F.col(f))), F.lit(""))
    amount = lambda f: F.coalesce(cells.signed_paise(cell(f)), F.lit(0))
    out = rows.join(by, "file").where("line > header_at")
    return out.select(
        "file", "block", "line", "header_at", "literal", "cells", amount("money_in").alias("first"), amount("money_out").alias("second"), cells.signed_paise(cell("balance")).alias("held"),
        text.date(F.regexp_replace(cell("entry_date"), r"\s+\d{2}:\d{2}:\d{2}$", "")).alias("entry_date"), *[cell(f).alias(f) for f in _TEXTS])


def sides(typed: DataFrame, default: str = "debit_in") -> DataFrame:
    """file and debit_out: whether the debit column of a file is money that leaves the account.

    Only files whose columns are just debit and credit are in question; other names say it. Votes: rows of one side whose
    voucher type (else narration) speaks of receipts or of payments, and dated rows whose balance moves by just their
    amount. The more frequent kind wins, default where there is no more frequent one.
    """
    if default not in CONVENTIONS:
        raise ValueError(f"no convention {default}")
    net = F.col("first") - F.col("second")
    speaks = lambda c: F.when(c.rlike("receipt|received") & ~c.rlike("payment|paid"), 1).when(c.rlike("payment|paid") & ~c.rlike("receipt|received"), -1)
    word = F.coalesce(speaks(F.lower("voucher_type")), speaks(F.lower("narration")), F.lit(0)) * F.signum(net)
    step = F.col("held") - F.lag("held").over(Window.partitionBy("file", "block").orderBy("line"))
    moved = F.when((net == 0) | F.col("entry_date").isNull(), 0).when(step == net, 1).when(step == -net, -1).otherwise(0)
    voting = F.when(F.col("literal"), word + F.coalesce(moved, F.lit(0))).otherwise(0)
    votes = typed.withColumn("vote", voting).groupBy("file").agg(F.sum("vote").alias("votes"), F.max("literal").alias("literal"))
    return votes.select("file", (F.col("literal") & ((F.col("votes") < 0) | ((F.col("votes") == 0) & F.lit(default == "debit_out")))).alias("debit_out"))


def read_books(spark: SparkSession, path: str | DataFrame, sep: str | None = None, convention: str | None = None, default: str = "debit_in", head_lines: int = 30) -> DataFrame:
    """Every line of the books of a path (or table, see lines) below its header, with its fate; nothing is left out.

    file, row_index (lines after the header, from 1), fate, negative, debit_out, entry_date, voucher_no, voucher_type,
    narration, party_name, instrument_no, money_in_paise, money_out_paise, row_hash. Fates, the first that fits: opening and
    closing (undated, a cell says opening or closing balance), empty (no amount), undated, both_sides, entry. A negative
    receipt is a payment and the reverse (negative). convention sets the sides of all files with debit and credit columns;
    without it each file's own rows tell them (sides).
    """
    rows = lines(spark, path, sep)
    typed = typed_lines(rows, roles(rows, head_lines))
    if convention is None:
        typed = typed.join(sides(typed, default), "file")
    elif convention in CONVENTIONS:
        typed = typed.withColumn("debit_out", F.col("literal") & F.lit(convention == "debit_out"))
    else:
        raise ValueError(f"no convention {convention}")
    i, o = F.when(F.col("debit_out"), F.col("second")).otherwise(F.col("first")), F.when(F.col("debit_out"), F.col("first")).otherwise(F.col("second"))
    up, down = lambda c: F.greatest(c, F.lit(0)), lambda c: F.greatest(-c, F.lit(0))
    label = F.lower(F.array_join("cells", " "))
    undated = F.col("entry_date").isNull()
    fate = (
        F.when(undated & label.rlike(r"opening\s*bal"), "opening").when(undated & label.rlike(r"closing\s*bal"), "closing").when((F.col("first") == 0) & (F.col("second") == 0), "empty")
        .when(undated, "undated").when((F.col("money_in_paise") > 0) & (F.col("money_out_paise") > 0), "both_sides").otherwise("entry"))
    typed = typed.withColumns({"money_in_paise": up(i) + down(o), "money_out_paise": up(o) + down(i)})
    return typed.select(
        "file", (F.col("line") - F.col("header_at")).alias("row_index"), fate.alias("fate"), ((F.col("first") < 0) | (F.col("second") < 0)).alias("negative"), "debit_out", "entry_date", *_TEXTS,
        "money_in_paise", "money_out_paise", text.row_hash(F.col("line"), F.array_join("cells", "|", "")).alias("row_hash"))


def batches(rows: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """One row a file of read_books' rows: refused, row_count, skipped, negative, both_sides, period_from, period_to, opening_paise, opening_source, closing_paise.

    A file with a row on both sides is refused: its direction is in doubt, so none of its entries count. Of several labelled
    openings or closings the last holds; openings (file, opening_paise) of a user come first. Without a labelled closing it
    is receipts less payments.
    """
    net = F.col("money_in_paise") - F.col("money_out_paise")
    entry = F.col("fate") == "entry"
    last = lambda kind: F.max_by(net, F.when(F.col("fate") == kind, F.col("row_index")))
    out = rows.groupBy("file").agg(
        F.count_if(F.col("fate") == "both_sides").alias("both_sides"), F.count_if(entry).alias("row_count"), F.count_if(F.col("fate") == "undated").alias("skipped"), F.count_if(entry & F.col("negative")).alias("negative"),
        F.min(F.when(entry, F.col("entry_date"))).alias("period_from"), F.max(F.when(entry, F.col("entry_date"))).alias("period_to"), last("opening").alias("labelled"), last("closing").alias("stated"), F.sum(F.when(entry, net)).alias("net"))
    manual = F.lit(None).cast("long")
    if openings is not None:
        out, manual = out.join(openings.select("file", F.col("opening_paise").alias("typed")), "file", "left"), F.col("typed")
    ok = F.col("both_sides") == 0
    return out.select(
        "file", (~ok).alias("refused"), F.when(ok, F.col("row_count")).otherwise(0).alias("row_count"), "skipped", "negative", "both_sides", F.when(ok, F.col("period_from")).alias("period_from"),
        F.when(ok, F.col("period_to")).alias("period_to"), F.coalesce(manual, "labelled").alias("opening_paise"),
        F.when(manual.isNotNull(), "manual").when(F.col("labelled").isNotNull(), "ledger_file").alias("opening_source"),
        F.when(ok, F.coalesce("stated", "net", F.lit(0))).alias("closing_paise"))


def entries(rows: DataFrame) -> DataFrame:
    """The entries of read_books' rows, without those of refused files."""
    refused = rows.where("fate = 'both_sides'").select("file").distinct()
    return rows.where("fate = 'entry'").join(refused, "file", "left_anti").drop("fate")
