"""Statement files to rows of strings (file, n, date, narration, debit, credit, balance), then to typed rows.

Every reader takes a path that Spark opens; nothing is inferred from data but the header's place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.scratch import ship_package, stored
from . import detect

#: Header names by field.
HEADERS = {
    "date": ["date", "txn date", "transaction date", "value date", "posting date"],
    "narration": ["narration", "description", "particulars", "details", "remarks"],
    "debit": ["debit", "withdrawal", "withdrawals", "dr", "paid out"],
    "credit": ["credit", "deposit", "deposits", "cr", "paid in"],
    "balance": ["balance", "closing balance", "running balance"],
    "amount": ["amount", "txn amount"],
}


def map_headers(names: list[str]) -> dict[str, int]:
    """Field to column: an exact name beats the longest contained one; every column serves once."""
    scored = []
    for i, raw in enumerate(names):
        name = " ".join((raw or "").lower().split())
        for field, known in HEADERS.items():
            for k in known:
                if k == name:
                    scored.append((1000 + len(k), -i, field, i))
                elif k in name:
                    scored.append((len(k), -i, field, i))
    out: dict[str, int] = {}
    for _, _, field, i in sorted(scored, reverse=True):
        if field not in out and i not in out.values():
            out[field] = i
    return out


def sniff(sample: list[str]) -> str:
    """The separator with the steadiest count (at least two a line) over sample lines."""
    best = (",", -1.0)
    for sep in ",\t;|":
        counts = [line.count(sep) for line in sample if line.strip()]
        if counts and min(counts) >= 2 and max(counts) - min(counts) <= 1 and min(counts) > best[1]:
            best = (sep, min(counts))
    return best[0]


#: What bytes 80 to 9F are in Windows text that is read as ISO-8859-1.
_WINDOWS = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_PLACES = [f"{f}_at" for f in HEADERS]
_LAYOUT = "file string, encoding string, sep string, width int, problem string, header_at int, " + ", ".join(f"{p} int" for p in _PLACES)


#: Fixed value: files whose first lines a task holds as Python texts at once.
FILES_AT_ONCE = 50


def _places_of(batches: Iterator[pa.RecordBatch], seps: list[str], sep: str | None, most_columns: int) -> Iterator[pa.RecordBatch]:
    """Layouts of files by (file, line: their first lines, zeros, odd, windows, w0...: most separators of a line); a batch has many files, so only some are unpacked at once."""
    names = [x.split(" ")[0] for x in _LAYOUT.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("file", "encoding", "sep", "problem") else pa.int32()) for n in names])
    for b in batches:
        for at in range(0, b.num_rows, FILES_AT_ONCE):
            out = []
            for r in b.slice(at, FILES_AT_ONCE).to_pylist():
                by = sep or sniff(r["line"])
                found = next(((k, m) for k, row in enumerate(r["line"], 1) if "date" in (m := map_headers([x.strip(' "\ufeff') for x in row.split(by)])) and {"debit", "credit", "amount"} & set(m)), None)
                width = 1 + r[f"w{seps.index(by)}"]
                problem = "no_header" if found is None else "too_wide" if width > most_columns else None
                encoding = "UTF-16" if r["zeros"] else "UTF-8" if not r["odd"] else "windows-1252" if r["windows"] else "ISO-8859-1"
                out.append([r["file"], encoding, by, width, problem, None if problem else found[0], *[None if problem else found[1].get(f) for f in HEADERS]])
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)


#: Fixed value: a line, as ISO-8859-1, that has more than blanks and a byte order mark.
_SAYS = "^(?:\u00ff\u00fe|\u00fe\u00ff|\u00ef\u00bb\u00bf)?+[\\x00-\\x20]*+[^\\x00-\\x20]"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at (which orders a block's lines, without gaps) and value (as bytes) of every line of a path that is not blank, stored: the files are listed and read once."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    lines = lines.where(F.decode("value", "ISO-8859-1").rlike(_SAYS))
    # a task reads block by block; numbers come after the filter, so that they have no gaps
    return stored(lines.select("file", "block", F.monotonically_increasing_id().alias("at"), "value"), "lines")


def lines_in(files: DataFrame) -> DataFrame:
    """As lines_of, of files that are kept as rows of a table: file (any name) and content (all its bytes). UTF-16 becomes UTF-8.

    For very many small files: each one on a file system takes far longer to make, list and open than to read.
    """
    zeros = F.decode("content", "ISO-8859-1").contains("\x00")

    def utf8(content: bytes) -> bytes:
        return content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-16-be", "replace").encode()

    plain = files.where(~zeros).select("file", "content").unionByName(files.where(zeros).select("file", F.udf(utf8, "binary", useArrow=False)("content").alias("content")))
    line = F.explode(F.split(F.regexp_replace(F.decode("content", "ISO-8859-1"), "^\u00ef\u00bb\u00bf", ""), "\r\n|\r|\n"))
    lines = plain.select("file", line.alias("latin")).where(F.col("latin").rlike(_SAYS))
    return stored(lines.select("file", F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("at"), F.encode("latin", "ISO-8859-1").alias("value")), "lines")


def layouts(lines: DataFrame, sep: str | None = None, head_lines: int = 100, most_columns: int = 2000) -> DataFrame:
    """file, encoding, sep, width, problem, the header's place among its lines, and the places of the fields of every delimited file of lines_of.

    By all lines, as bytes: UTF-16 where there are zero bytes, UTF-8 where all lines are, else Windows text if
    it has bytes that ISO-8859-1 leaves to control characters. A file's header is the first of its first head_lines
    lines that names a date and an amount. Files without one, or wider than most_columns, have a problem and no places.
    """
    seps = [sep] if sep else list(",\t;|")
    latin = F.decode("value", "ISO-8859-1")
    told = lines.groupBy("file").agg(
        F.max(latin.contains("\x00")).alias("zeros"), F.max(~F.is_valid_utf8(F.col("value").cast("string"))).alias("odd"), F.max(latin.rlike("[\x80-\x9f]")).alias("windows"),
        *[F.max(F.length(latin) - F.length(F.replace(latin, F.lit(s), F.lit("")))).alias(f"w{i}") for i, s in enumerate(seps)])
    first = Window.partitionBy("file").orderBy("at")
    plain = F.regexp_replace(latin, "\x00|^\u00ff\u00fe|^\u00fe\u00ff|^\u00ef\u00bb\u00bf|\r", "")
    heads = lines.where("block = 0").withColumn("k", F.row_number().over(first)).where(F.col("k") <= head_lines).select("file", "k", plain.alias("line"))
    heads = heads.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("head"))

    ship_package(lines.sparkSession)
    found = heads.join(told, "file").select("file", "head.line", "zeros", "odd", "windows", *[f"w{i}" for i in range(len(seps))])
    return found.mapInArrow(partial(_places_of, seps=seps, sep=sep, most_columns=most_columns), _LAYOUT)


def cells_of(lines: DataFrame, known: DataFrame) -> DataFrame | None:
    """known's columns (see layouts), block, k (a line's place in its block, from 1), before (lines of the blocks before) and cells of every line of the files in known.

    Lines are parsed where they are, each as its file's layout says; only UTF-16 files, whose lines are not those of their bytes, are
    read again, one scan for each separator. Arrays are as wide as the widest file of a separator and encoding. None if known is empty.
    """
    spark = lines.sparkSession
    kinds = known.groupBy("sep", "encoding").agg(F.max("width").alias("width")).collect()
    names = lambda s: [f"c{i}" for i in range(s.width)]
    schema = lambda s: ", ".join(f"{c} string" for c in names(s))

    def numbered(rows: DataFrame, cells: Column) -> DataFrame:
        sizes = rows.groupBy("file", "block").agg(F.min("at").alias("start"), F.count("*").alias("size"))
        ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0))).drop("size")
        blocks = stored(known.join(sizes, "file"), "blocks")
        return rows.join(blocks, ["file", "block"]).select(*known.columns, "block", (F.col("at") - F.col("start") + 1).alias("k"), "before", cells.alias("cells"))

    out, cells = [], F.lit(None).cast("array<string>")
    latin = F.decode("value", "ISO-8859-1")
    texts = {"UTF-8": F.col("value").cast("string"), "ISO-8859-1": latin, "windows-1252": F.translate(latin, "".join(_WINDOWS), "".join(_WINDOWS.values()))}
    for s in kinds:
        if s.encoding == "UTF-16":
            files = [r.file for r in known.where((F.col("encoding") == s.encoding) & (F.col("sep") == s.sep)).select("file").collect()]
            raw = spark.read.csv(files, sep=s.sep, header=False, schema=schema(s), mode="PERMISSIVE", encoding=s.encoding, multiLine=True)
            raw = raw.select(F.col("_metadata.file_path").alias("file"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("at"), F.array(*raw.columns).alias("cells"))
            out.append(numbered(stored(raw, "lines"), F.col("cells")))
        else:
            # the parsed line is found once, not for each of its columns
            parsed = F.get(F.transform(F.array(F.from_csv(texts[s.encoding], schema(s), {"sep": s.sep, "mode": "PERMISSIVE"})), lambda x: F.array(*[x[c] for c in names(s)])), 0)  # noqa: B023
            cells = F.when((F.col("sep") == s.sep) & (F.col("encoding") == s.encoding), parsed).otherwise(cells)
    if len(out) < len(kinds):
        known = known.where("encoding <> 'UTF-16'") if out else known
        out.append(numbered(lines, cells))
    return reduce(DataFrame.unionByName, out) if out else None


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, head_lines: int = 100, most_columns: int = 2000) -> DataFrame:
    """Rows of the delimited files of a path, each read by its own header, separator, width and encoding (see layouts).

    The files are read once (see lines_of). Narrower lines end in nulls. A line with neither date nor amount continues the
    narration of the row before it in its file; other undated lines and repeated headers are left out. n orders a file's rows.
    In a file with a negative lone amount, those without a sign are credits.
    A file with a problem is one row with its name alone; ValueError if every file has one.
    """
    lines = lines_of(spark, path)
    known = stored(layouts(lines, sep, head_lines, most_columns), "layouts")
    rows = cells_of(lines, known.where("problem is null"))
    if rows is None:
        bad = known.select("problem", "width").first()
        raise ValueError(f"no header row in the first {head_lines} lines" if bad is None or bad.problem == "no_header" else f"a line of {bad.width} columns")
    cell = lambda f: F.nullif(F.trim(F.get("cells", F.col(f"{f}_at"))), F.lit(""))
    rows = rows.select("file", "block", (F.col("block") + F.col("k")).alias("n"), "header_at", *[cell(f).alias(f) for f in HEADERS]).where("block > 0 or n > header_at")
    named = F.lower("date").isin(HEADERS["date"])
    dated = F.col("date").isNotNull() & ~F.coalesce(named, F.lit(False))
    more = F.expr("date is null and narration is not null and debit is null and credit is null and amount is null and balance is null")
    rows = rows.withColumns({"dated": dated, "continues": more}).where("dated or continues")
    # the row that a line continues: the last dated one of its block, else of the blocks before
    in_block = Window.partitionBy("file", "block")
    rows = rows.withColumn("of", F.last(F.when(F.col("dated"), F.col("n")), ignorenulls=True).over(in_block.orderBy("n")))
    said = F.collect_list(F.when(F.col("continues") & F.col("of").isNotNull(), F.col("narration")))
    whole = Window.partitionBy("file", "block", "of").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("more", said.over(whole)).where("dated or of is null")
    rows = rows.withColumn("narration", F.when(F.col("dated"), F.concat_ws(" ", "narration", "more")).otherwise(F.col("narration")))
    rows = stored(rows.select("file", "block", "n", "dated", *HEADERS), "rows")

    ends = rows.where("dated").groupBy("file", "block").agg(F.max("n").alias("end"))
    early = rows.where("not dated and block > 0").groupBy("file", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "narration"))), lambda x: x["narration"]), " ").alias("said"))
    early = early.join(ends, ["file", "block"], "full")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    early = early.select("file", "block", "said", F.last("end", ignorenulls=True).over(before).alias("n")).where("said is not null and n is not null")
    early = early.groupBy("file", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "said"))), lambda x: x["said"]), " ").alias("early"))
    # stored, so that Spark sees that they are few
    out = rows.where("dated").join(stored(early, "early"), ["file", "n"], "left").withColumn("narration", F.nullif(F.concat_ws(" ", F.nullif("narration", F.lit("")), "early"), F.lit("")))
    bad = known.where("problem is not null").select("file", F.lit(0).cast("long").alias("n"), *[F.lit(None).cast("string").alias(f) for f in HEADERS], "problem")
    signed = stored(rows.where("dated").where(_minus()).select("file").distinct().withColumn("signed", F.lit(True)), "signed")
    out = _signed(out.join(signed, "file", "left"))
    return out.select("file", "n", *HEADERS, F.lit(None).cast("string").alias("problem")).unionByName(bad)


def read_json(spark: SparkSession, path: str, list_keys: tuple[str, ...] = ("transactions", "data", "records", "items", "entries")) -> DataFrame:
    """Records of a JSON document: an array, or the first known list key; nested objects become dotted names.

    Where any lone amount of a document is negative, its amounts without a sign are credits.
    """
    df = spark.read.json(path, multiLine=True, primitivesAsString=True)
    if key := next((k for k in list_keys if k in df.columns), None):
        df = df.select(F.explode(key).alias("r")).select("r.*")
    flat, queue = [], [(f.name, f.dataType) for f in df.schema.fields]
    while queue:
        name, kind = queue.pop(0)
        if kind.typeName() == "struct":
            queue += [(f"{name}.{f.name}", f.dataType) for f in kind.fields]
        elif kind.typeName() != "array":
            flat.append(name)
    m = map_headers([x.split(".")[-1] for x in flat])
    rows = df.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), *[(F.col(flat[m[f]]) if f in m else F.lit(None).cast("string")).alias(f) for f in HEADERS])
    return _signed_files(rows)


def _minus() -> Column:
    return F.col("amount").rlike(r"^\s*-")


def _signed(rows: DataFrame) -> DataFrame:
    """rows with credits from lone amounts without a sign, where their file is signed."""
    lone = F.col("debit").isNull() & F.col("credit").isNull() & F.col("signed") & ~_minus()
    return rows.withColumn("credit", F.when(lone, F.col("amount")).otherwise(F.col("credit"))).drop("signed")


def _signed_files(rows: DataFrame) -> DataFrame:
    """rows with credits from lone amounts without a sign, in files that have a negative one."""
    return _signed(rows.join(rows.groupBy("file").agg(F.max(_minus()).alias("signed")), "file"))


def read_ofx(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of OFX or QFX files, SGML or XML: signed amounts, day of DTPOSTED as written, no running balance."""
    doc = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<STMTTRN>(.*?)(?=<STMTTRN>|</STMTTRN>|</BANKTRANLIST>)"), 1)).alias("n", "b"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("b", rf"<{t}>([^<\r\n]*)", 1)), F.lit(""))
    amount, day = tag("TRNAMT"), tag("DTPOSTED")
    return doc.select(
        "file", F.col("n").cast("long").alias("n"), F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)).alias("date"), F.coalesce(tag("NAME"), tag("MEMO")).alias("narration"),
        F.when(amount.startswith("-"), F.substring(amount, 2, 40)).alias("debit"), F.when(~amount.startswith("-"), amount).alias("credit"), F.lit(None).cast("string").alias("balance"), amount.alias("amount"))


def ofx_accounts(spark: SparkSession, path: str) -> DataFrame:
    """file, bank, account and currency of every statement of OFX files, its ledger balance in minor units with sign, and its day."""
    block = F.regexp_extract_all("value", F.lit(r"(?s)<((?:CC)?STMTRS)>(.*?)(?=<(?:CC)?STMTRS>|</(?:CC)?STMTRS>|$)"), 2)
    b = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(block).alias("b"))
    tag = lambda t, c="b": F.nullif(F.trim(F.regexp_extract(c, rf"<{t}>([^<\r\n]*)", 1)), F.lit(""))
    b = b.withColumn("held", F.regexp_extract("b", r"(?s)<LEDGERBAL>(.*?)(?=</LEDGERBAL>|<AVAILBAL>|$)", 1))
    value, day = F.expr("try_cast(regexp_extract(held, '<BALAMT>([^<\\r\\n]*)', 1) AS decimal(24,6))"), tag("DTASOF", "held")
    return b.select("file", tag("BANKID").alias("bank"), tag("ACCTID").alias("account"), tag("CURDEF").alias("currency"), F.round(value * 100).cast("long").alias("balance_paise"),
                    F.try_to_timestamp(F.substring(day, 1, 8), F.lit("yyyyMMdd")).cast("date").alias("balance_date"))


#: Balance codes of CAMT statements.
OPENING_CODES, CLOSING_CODES = ("OPBD", "PRCD"), ("CLBD",)


def camt_statements(spark: SparkSession, path: str) -> DataFrame:
    """file, masked account, currency, declared period and reported balances (minor units, overdrawn ones negative) of CAMT statements."""
    schema = ("Acct struct<Id:struct<IBAN:string,Othr:struct<Id:string>>,Ccy:string>, FrToDt struct<FrDtTm:string,ToDtTm:string,FrDt:string,ToDt:string>, "
              "Bal array<struct<Tp:struct<CdOrPrtry:struct<Cd:string>>,Amt:struct<_VALUE:string,_Ccy:string>,CdtDbtInd:string>>")  # fmt: skip
    s = spark.read.format("xml").option("rowTag", "Stmt").schema(schema).load(path)
    paise = lambda b: F.round(b["Amt"]["_VALUE"].try_cast("decimal(24,6)") * 100).cast("long") * F.when(b["CdtDbtInd"] == "DBIT", -1).otherwise(1)
    first = lambda codes: F.get(F.transform(F.filter("Bal", lambda b: F.upper(b["Tp"]["CdOrPrtry"]["Cd"]).isin(*codes) & paise(b).isNotNull()), paise), 0)
    begin, end = (F.substring(F.coalesce(f"FrToDt.{x}DtTm", f"FrToDt.{x}Dt"), 1, 10).try_cast("date") for x in ("Fr", "To"))
    both = begin.isNotNull() & end.isNotNull()
    return s.select(F.input_file_name().alias("file"), text.mask(F.coalesce("Acct.Id.IBAN", "Acct.Id.Othr.Id")).alias("account"), F.upper("Acct.Ccy").alias("currency"),
                    F.when(both, begin).alias("period_start"), F.when(both, end).alias("period_end"), first(OPENING_CODES).alias("opening_paise"), first(CLOSING_CODES).alias("closing_paise"))


def read_camt(spark: SparkSession, path: str) -> DataFrame:
    """Entries of CAMT.053 files; an entry is split to its details only if more than one of them has an amount."""
    schema = ("Amt struct<_VALUE:string,_Ccy:string>, CdtDbtInd string, BookgDt struct<Dt:string>, AddtlNtryInf string, "
              "NtryDtls array<struct<TxDtls:array<struct<Amt:struct<_VALUE:string,_Ccy:string>,CdtDbtInd:string,RmtInf:struct<Ustrd:string>>>>>")  # fmt: skip
    e = spark.read.format("xml").option("rowTag", "Ntry").schema(schema).load(path).withColumn("n", F.monotonically_increasing_id())
    details = F.filter(F.flatten(F.transform("NtryDtls", lambda d: F.coalesce(d["TxDtls"], F.array()))), lambda t: t["Amt"]["_VALUE"].isNotNull())
    e = e.withColumn("parts", F.when(F.size(details) > 1, details)).select("*", F.explode_outer("parts").alias("t"))
    amount, side = F.coalesce("t.Amt._VALUE", "Amt._VALUE"), F.coalesce("t.CdtDbtInd", "CdtDbtInd")
    return e.select(
        F.input_file_name().alias("file"), "n", F.col("BookgDt.Dt").alias("date"), F.coalesce("t.RmtInf.Ustrd", "AddtlNtryInf").alias("narration"),
        F.when(side == "DBIT", amount).alias("debit"), F.when(side == "CRDT", amount).alias("credit"), F.lit(None).cast("string").alias("balance"), amount.alias("amount"))


READERS = {"csv": read_delimited, "tsv": read_delimited, "txt": read_delimited, "json": read_json, "ofx": read_ofx, "qfx": read_ofx, "camt": read_camt}


def read_statement(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Typed rows of statement files of one kind; without kind their bytes tell it, whatever their names say.

    ValueError if no reader fits, kinds are mixed or a file is too long to be looked at whole: then kind must be given.
    """
    if kind is None:
        kinds = [r[0] for r in detect.detect(spark, path).select("format").distinct().collect()]
        if len(kinds) != 1:
            raise ValueError(f"kinds of {path}: {sorted(kinds)}")
        kind = kinds[0]
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}")
    return typed(READERS[kind](spark, path))


def typed(rows: DataFrame) -> DataFrame:
    """Canonical columns with the warnings of what could not be read; a lone signed amount gives the side."""
    problem = F.col("problem") if "problem" in rows.columns else F.lit(None).cast("string")
    # first what is used more than once, so that it is found once
    rows = rows.select("file", "n", "narration", "amount", problem.alias("problem"), text.date(F.col("date")).alias("day"), *[text.amount(F.col(c)).alias(k) for c, k in (("debit", "out"), ("credit", "in"), ("amount", "lone"), ("balance", "held"))])
    side = F.coalesce(F.when(F.col("out").isNotNull(), "debit"), F.when(F.col("in").isNotNull(), "credit"), F.when(_minus(), "debit"), text.amount_side(F.col("amount")))
    paise = F.coalesce("out", "in", "lone")
    return rows.select(
        "file", "n", F.col("day").alias("txn_date"), "narration", side.alias("direction"), paise.alias("amount_paise"), F.col("held").alias("balance_paise"),
        F.array_compact(F.array("problem", F.when(F.col("day").isNull(), "date_unreadable"), F.when(paise.isNull(), "no_amount"), F.when(side.isNull(), "no_direction"))).alias("warnings"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose string cells no spreadsheet takes for formulas."""
    safe = [text.csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").csv(path, header=True)


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("status",)) -> DataFrame:
    """new over old by key; the columns in keep stay as old has them."""
    kept = old.select(key, *[F.col(c).alias(f"_{c}") for c in keep])
    merged = new.join(kept, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(merged)
