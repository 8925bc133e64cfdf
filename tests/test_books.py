"""Books files: roles of columns, sides by file, labelled balances, refused files."""

import os

import pytest

from ledgerloom.sources import books


def _write(folder, **files):
    for name, body in files.items():
        with open(os.path.join(folder, f"{name}.csv"), "w") as f:
            f.write(body)
    return str(folder)


def _by_file(df):
    out = {}
    for r in df.collect():
        out.setdefault(os.path.basename(r.file).removesuffix(".csv"), []).append(r)
    return out


def test_four_conventions_give_one_ledger(spark, tmp_path):
    path = _write(
        tmp_path,
        debit_in="Date,Particulars,Vch Type,Vch No.,Cheque/Ref No.,Debit,Credit\n03-01-2025,Alpha,Receipt,R1,A1,\"1,200.50\",\n04-01-2025,Beta,Payment,P1,A2,,300\n",
        debit_out="date,description,debit,credit\n2025-01-03,Alpha received,,1200.50\n2025-01-04,Beta payment,300,\n",
        names="Voucher Date;Narration;Receipts;Payments\n03/01/2025;Alpha;1200.50;\n04/01/2025;Beta;;300\n",
        signed="Books of account\nEntry Date,Remarks,Deposit\n03-Jan-2025,Alpha,₹ 1200.50\n04-Jan-2025,Beta,(300.00)\n",
        by_balance="Date,Ledger,Dr,Cr,Balance\n02-01-2025,Old,,10,90\n03-01-2025,Alpha,,1200.50,1290.50\n04-01-2025,Beta,300,,990.50\n",
    )
    got = _by_file(books.entries(books.read_books(spark, path)))
    want = {("2025-01-03", 120050, 0), ("2025-01-04", 0, 30000)}
    for name in ("debit_in", "debit_out", "names", "signed"):
        assert {(str(r.entry_date), r.money_in_paise, r.money_out_paise) for r in got[name]} == want, name
    # the balance rises by what stands in Cr; its first row has no step before it
    assert {(str(r.entry_date), r.money_in_paise, r.money_out_paise) for r in got["by_balance"]} == want | {("2025-01-02", 1000, 0)}
    assert {(r.voucher_no, r.instrument_no) for r in got["debit_in"]} == {("R1", "A1"), ("P1", "A2")}
    assert {r.negative for r in got["signed"] if r.money_out_paise} == {True}


def test_labels_skipped_rows_and_refusal(spark, tmp_path):
    path = _write(
        tmp_path,
        good="Date,Particulars,Debit,Credit\n,Opening Balance,500.00,\n05-02-2025,Loan closing balance charges,,20\n,no day,7,\n06-02-2025,nothing,,\n07-02-2025,turned,,-30\n,Closing Balance,510.00,\n",
        bad="Date,Particulars,Debit,Credit\n05-02-2025,x,1,\n06-02-2025,y,2,3\n",
        bare="Date,Particulars,Debit,Credit\n05-02-2025,x,1.005,\n06-02-2025,y,1.015,\n",
        empty="Date,Particulars,Debit,Credit\n",
        nothing="",
    )
    rows = books.read_books(spark, path)
    fates = {k: [r.fate for r in sorted(v, key=lambda r: r.row_index)] for k, v in _by_file(rows).items()}
    assert fates == {"good": ["opening", "entry", "undated", "empty", "entry", "closing"], "bad": ["entry", "both_sides"], "bare": ["entry", "entry"]}
    b = {k: v[0] for k, v in _by_file(books.batches(rows)).items()}
    good = b["good"]
    assert (good.refused, good.row_count, good.skipped, good.negative, good.opening_paise, good.opening_source, good.closing_paise) == (False, 2, 1, 1, 50000, "ledger_file", 51000)
    assert (str(good.period_from), str(good.period_to)) == ("2025-02-05", "2025-02-07")
    assert (b["bad"].refused, b["bad"].row_count, b["bad"].both_sides, b["bad"].closing_paise) == (True, 0, 1, None)
    # halves go to even: 1.005 is 100, 1.015 is 102
    assert (b["bare"].closing_paise, b["bare"].opening_paise, b["bare"].opening_source) == (202, None, None)
    assert set(_by_file(books.entries(rows))) == {"good", "bare"}
    mine = spark.createDataFrame([(good.file, 7)], "file string, opening_paise long")
    assert _by_file(books.batches(rows, mine))["good"][0].opening_source == "manual"


def test_given_and_default_conventions(spark, tmp_path):
    path = _write(tmp_path, a="Date,Particulars,Debit,Credit\n05-02-2025,x,1,\n", b="Date,Particulars,Deposit,Withdrawal\n05-02-2025,x,1,\n")
    side = lambda **how: {k: v[0].money_in_paise for k, v in _by_file(books.read_books(spark, path, **how)).items()}
    assert side() == {"a": 100, "b": 100}
    assert side(default="debit_out") == side(convention="debit_out") == {"a": 0, "b": 100}
    for how in ({"convention": "x"}, {"default": "x"}):
        with pytest.raises(ValueError, match="no convention"):
            books.read_books(spark, path, **how)
    with pytest.raises(ValueError, match="line of 4 columns"):
        books.lines(spark, path, most_columns=3)
    with pytest.raises(ValueError, match="no books"):
        books.read_books(spark, _write(tmp_path / ".." / tmp_path.name, c="") + "/c.csv")


def test_roles_and_statements(spark, tmp_path):
    path = _write(
        tmp_path,
        bank="Value Date,Narration,Withdrawal Amt,Deposit Amt,Closing Balance\n01/02/2025,UPI,,5,5\n02/02/2025,UPI,1,,4\n",
        modes="Date,Particulars,Ref,Withdrawal\n01/02/2025,a,UPI,5\n02/02/2025,b,UPI,5\n03/02/2025,c,UPI,6\n04/02/2025,d,UPI,6\n05/02/2025,e,NEFT,6\n",
    )
    got = {k: v[0] for k, v in _by_file(books.roles(books.lines(spark, path))).items()}
    assert (got["bank"].is_statement, got["modes"].is_statement) == (True, False)
    assert (got["bank"].money_in, got["bank"].money_out, got["bank"].balance, got["bank"].entry_date) == (3, 2, 4, 0)
    # a payment mode that repeats is no instrument number; "dr" inside of "withdrawal" is no receipt
    assert (got["modes"].instrument_no, got["modes"].money_in, got["modes"].money_out) == (None, None, 3)


def test_lines_of_split_files_are_numbered_without_gaps(spark, tmp_path):
    n = 3000
    path = _write(tmp_path, long="Date,Particulars,Debit,Credit\n" + "".join(f"05-02-2025,row {i},{i},\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = books.read_books(spark, path).select("row_index", "money_in_paise").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.row_index, r.money_in_paise) for r in got) == [(i, i * 100) for i in range(1, n + 1)]


def test_first_lines_of_many_files_are_not_unpacked_at_once():
    """A batch of 3,000 files of 100 lines takes few MB of Python objects, and each file has its layout."""
    import tracemalloc

    import pyarrow as pa

    from ledgerloom.sources import statements

    n, lines = 3000, ["Date,Narration,Debit,Credit", *(f"01/02/2003,ROW {i:060d},1.00," for i in range(99))]
    b = pa.RecordBatch.from_pydict({"file": [f"f{i}" for i in range(n)], "line": [lines] * n, "zeros": [False] * n, "odd": [False] * n, "windows": [False] * n, "w0": [3] * n, "w1": [0] * n, "w2": [0] * n, "w3": [0] * n})
    tracemalloc.start()
    got = [r for x in statements._places_of(iter([b]), list(",\t;|"), None, 2000) for r in x.select(["file", "sep", "width", "header_at", "date_at"]).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n and got[7] == {"file": "f7", "sep": ",", "width": 4, "header_at": 1, "date_at": 0} and peak < 20e6


def test_books_of_a_table_are_those_of_files(spark, tmp_path):
    """Files kept as rows give the entries that they give on a file system, in every encoding and with every line end."""
    body = "Date,Particulars,Debit,Credit\n\n05-02-2025,\"CAFÉ, €\",7,\n \t\n06-02-2025,y,,3\n"
    files = {"utf8.csv": body.encode(), "bom.csv": b"\xef\xbb\xbf" + body.encode(), "windows.csv": body.encode("cp1252"), "crlf.csv": body.replace("\n", "\r\n").encode(), "wide.csv": body.replace(" \t\n", "").encode("utf-16"), "nothing.csv": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    by = lambda rows: sorted((os.path.basename(r.file), r.row_index, str(r.entry_date), r.narration, r.money_in_paise, r.money_out_paise) for r in rows.collect())
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "file string, content binary")
    got = by(books.entries(books.read_books(spark, table)))
    assert got == sorted(x for k in files if k != "nothing.csv" for x in ((k, 1, "2025-02-05", "CAFÉ, €", 700, 0), (k, 2, "2025-02-06", "y", 0, 300)))
    assert got == by(books.entries(books.read_books(spark, str(tmp_path))))


def test_books_queries_make_no_file_for_each_account(spark):
    from ledgerloom import catalog_books
    from ledgerloom.plans.ledger import ledger

    files = catalog_books._books_files(ledger(spark, "/root/testdata/sf0.001"))
    assert files.columns == ["file", "content"] and files.count() == ledger(spark, "/root/testdata/sf0.001").select("account_id").distinct().count()
    first = bytes(files.where("file = 'account_id=3.csv'").first().content).decode().splitlines()
    assert first[0] == "Entry Date,Remarks,Deposit" and first[1] == ",Opening Balance,3.07" and first[-1] == ",Closing  Balance,30.03"
