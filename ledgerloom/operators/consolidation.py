"""Statements of one account brought together: copies merged, breaks of the balance flagged, summaries."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..plans.scratch import discard, stored


KEY = ["account_id", "txn_date", "direction", "amount_paise", "balance_paise"]
_ROW = "array<struct<file_id:bigint,row_index:bigint>>"


def merge_statements(rows: DataFrame, most_rounds: int = 100) -> DataFrame:
    """rows(file_id, account_id, txn_date, row_index, direction, amount_paise, balance_paise, narration) with copies of
    other files made one: file_id and row_index of the first, its columns, `lineage` (every file and row) and sources (their number).

    Copies agree in day, side, amount, balance (nulls are equal) and their narrations match as cells.same_narration has it.
    Rows of one file are never made one: of equal narrations the k-th of a file meets the k-th of others, other
    narrations meet one to one, earlier files first, in rounds until no two rows that match are left.
    """
    said = F.regexp_replace(F.upper(F.coalesce("narration", F.lit(""))), "[^A-Z0-9]", "")
    group = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in KEY])
    # dealt by the columns of a group once: all that follows up to the forms is within a group
    x = rows.select("file_id", "row_index", *KEY, "narration", said.alias("said")).repartition(*KEY)
    x = x.withColumn("k", F.row_number().over(Window.partitionBy(*KEY, "said", "file_id").orderBy("row_index")))
    lineage = F.sort_array(F.collect_list(F.struct(F.col("file_id").cast("long").alias("file_id"), F.col("row_index").cast("long").alias("row_index"))))
    x = x.groupBy(*KEY, "said", "k").agg(F.min(F.struct("file_id", "row_index", "narration")).alias("f"), lineage.alias("lineage"))
    # a form goes by its first row within its group: numbers of files may come again in other accounts
    x = x.withColumns({"id": F.struct("f.file_id", "f.row_index", "said", "k"), "many": F.count(F.lit(1)).over(Window.partitionBy(*KEY)) > 1})
    forms = stored(x.select(*KEY, group.alias("g"), "id", "said", "f.file_id", "f.row_index", "f.narration", "lineage", "many"), "forms")
    # only forms that are not alone in their group take part in rounds
    alone, x = forms.where("not many").drop("many"), forms.where("many").drop("many")
    # narrations can only match where they begin alike or have a long number in common: an equi-join on that
    begins = F.when(F.length("said") >= 8, F.concat(F.lit("b"), F.substring("said", 1, 8)))
    keys = F.array_distinct(F.array_compact(F.concat(F.array(begins), F.transform(F.regexp_extract_all("said", F.lit("[0-9]{9,}"), 0), lambda n: F.concat(F.lit("n"), n)))))
    side = lambda p: x.select("g", F.explode(keys).alias("key"), F.col("id").alias(p), F.col("narration").alias(f"{p}_said"), F.col("lineage.file_id").alias(f"{p}_files"))
    pairs = side("a").join(side("b"), ["g", "key"]).where((F.col("a") < F.col("b")) & ~F.arrays_overlap("a_files", "b_files") & cells.same_narration(F.col("a_said"), F.col("b_said")))
    pairs = stored(pairs.select("g", "a", "b").distinct(), "alike")
    # a round makes no new pairs, as rows joined keep their narration and only gain files
    live = x
    for _ in range(most_rounds):
        if pairs.isEmpty():
            discard(pairs)
            return alone.unionByName(live.select(*alone.columns)).select(*KEY, "file_id", "row_index", "narration", F.col("lineage").cast(_ROW).alias("lineage"), F.size("lineage").cast("long").alias("sources"))
        won = pairs.groupBy("g", "b").agg(F.min("a").alias("a")).join(pairs.groupBy("g", "a").agg(F.min("b").alias("b")), ["g", "a", "b"])
        won = stored(won.join(won.select("g", F.col("b").alias("a")), ["g", "a"], "left_anti").select("g", "a", F.col("b").alias("id")), "joined")
        given = live.join(won, ["g", "id"]).select("g", F.col("a").alias("id"), F.col("lineage").alias("more"))
        y = live.join(won.select("g", "id"), ["g", "id"], "left_anti").join(given, ["g", "id"], "left")
        y = stored(y.withColumn("lineage", F.sort_array(F.concat("lineage", F.coalesce("more", F.array().cast(_ROW))))).drop("more"), "paired-forms")
        # a row that was joined is not in y, so that its pairs go
        files = lambda p: y.select("g", F.col("id").alias(p), F.col("lineage.file_id").alias(f"{p}_files"))
        left = pairs.join(files("a"), ["g", "a"]).join(files("b"), ["g", "b"]).where(~F.arrays_overlap("a_files", "b_files"))
        left = stored(left.select("g", "a", "b"), "alike")
        discard(pairs, won, *([] if live is x else [live]))
        live, pairs = y, left
    raise RuntimeError("copies did not settle")


def in_file_order(merged: DataFrame) -> DataFrame:
    """merged (of merge_statements) with `place`: the row's number in its account, by day, and within a day so that every
    file's own order is kept; what the files leave open goes by first appearance (earlier, then longer files first).

    A row that only a later file has goes in front of the row that follows it there. A file's rows bind each other where their days do not fall,
    so days can be ordered each on its own: those in which first appearance already keeps all orders need no
    more; the others, each a row of an account's day, are sorted topologically. Orders that conflict go by first appearance.
    """
    lines = merged.select("account_id", "txn_date", F.struct("file_id", "row_index").alias("uid"), F.explode("lineage").alias("at")).select("account_id", "txn_date", "uid", F.col("at.file_id").alias("file"), F.col("at.row_index").alias("row"))
    files = lines.groupBy("account_id", "file").agg(F.min_by("txn_date", "row").alias("since"), F.count(F.lit(1)).alias("n"))
    files = files.withColumn("f", F.row_number().over(Window.partitionBy("account_id").orderBy("since", F.desc("n"), "file")))
    lines = lines.join(files.select("account_id", "file", "f"), ["account_id", "file"])
    lines = stored(lines.withColumn("seen", F.min(F.struct("f", "row")).over(Window.partitionBy("account_id", "txn_date", "uid"))), "lines")
    # a row's first line stands for it
    seen = lines.where("f = seen.f and row = seen.row").select("account_id", "txn_date", "uid", "seen")
    before = F.lag(F.struct("uid", "txn_date", "seen")).over(Window.partitionBy("account_id", "file").orderBy("row"))
    edges = lines.withColumn("before", before).where("before.txn_date = txn_date and before.uid <> uid")
    edges = stored(edges.select("account_id", "txn_date", F.col("before.uid").alias("a"), F.col("uid").alias("b"), (F.col("before.seen") > F.col("seen")).alias("back")), "edges")
    day = ["account_id", "txn_date"]
    mixed = stored(edges.where("back").select(*day).distinct(), "mixed-days")
    plain = seen.join(mixed, day, "left_anti").withColumn("at", F.row_number().over(Window.partitionBy(*day).orderBy("seen")))

    def sort(rows, links):
        order = {tuple(u): tuple(seen) for u, seen in rows}
        after, waits = {u: [] for u in order}, dict.fromkeys(order, 0)
        for a, b in links:
            after[tuple(a)].append(tuple(b))
            waits[tuple(b)] += 1
        ready, out = [(s, u) for u, s in order.items() if not waits[u]], []
        heapq.heapify(ready)
        while ready:
            _, u = heapq.heappop(ready)
            out.append(u)
            for v in after[u]:
                waits[v] -= 1
                if not waits[v]:
                    heapq.heappush(ready, (order[v], v))
        return out + sorted(order.keys() - set(out), key=order.get)

    # a day is a row of arrays: most days are few rows, and a pandas group of its own for each takes far longer than its sorting
    kinds = dict(merged.dtypes)
    in_order = F.udf(sort, f"array<struct<file_id:{kinds['file_id']},row_index:{kinds['row_index']}>>")
    rows = seen.join(mixed, day, "left_semi").groupBy(*day).agg(F.collect_list(F.struct("uid", "seen")).alias("rows"))
    links = edges.join(mixed, day, "left_semi").groupBy(*day).agg(F.collect_set(F.struct("a", "b")).alias("links"))
    sorted_days = rows.join(links, day).select(*day, F.posexplode(in_order("rows", "links")).alias("at", "u"))
    sorted_days = sorted_days.select(*day, "u.file_id", "u.row_index", (F.col("at") + 1).alias("at"))
    places = plain.select(*day, "uid.file_id", "uid.row_index", "at").unionByName(sorted_days)
    out = merged.join(places, [*day, "file_id", "row_index"]).select(*merged.columns, "at")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("account_id").orderBy("txn_date", "at")).cast("long")).drop("at")


def balance_flags(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows whose balance doesn't follow from the row before: between statements if no file has both (by `lineage`; without
    it by file_id), else within one. Rows without a balance or side say nothing."""
    w = Window.partitionBy("account_id").orderBy(*order)
    files = F.col("lineage.file_id") if "lineage" in rows.columns else F.array("file_id")
    signed = F.when(F.col("direction") == "credit", F.col("amount_paise")).when(F.col("direction") == "debit", -F.col("amount_paise"))
    x = rows.withColumn("files_", files)
    x = x.withColumns({"prev": F.lag("balance_paise").over(w), "prev_files": F.lag("files_").over(w)}).withColumn("diff_paise", F.col("balance_paise") - F.col("prev") - signed)
    kind = F.when(F.arrays_overlap("prev_files", "files_"), "within_statement").otherwise("between_statements")
    return x.where("diff_paise <> 0").select("account_id", "file_id", "row_index", kind.alias("kind"), "diff_paise")


def opening_flags(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id, opening_paise, expected_paise, balance_paise, diff_paise of statements(file_id, opening_paise) whose printed
    opening doesn't lead to the balance of their first row; statements without either say nothing."""
    signed = F.when(F.col("direction") == "credit", F.col("amount_paise")).when(F.col("direction") == "debit", -F.col("amount_paise"))
    first = rows.groupBy("file_id").agg(F.min_by(F.struct(signed.alias("moved"), "balance_paise"), "row_index").alias("x")).select("file_id", "x.*")
    x = statements.join(first, "file_id").withColumn("expected_paise", F.col("opening_paise") + F.col("moved"))
    return x.where("expected_paise <> balance_paise").select("file_id", "opening_paise", "expected_paise", "balance_paise", (F.col("balance_paise") - F.col("expected_paise")).alias("diff_paise"))


def account_summaries(rows: DataFrame, order: Column) -> DataFrame:
    """For each account: rows, span, sums in and out, first and last balance."""
    amount = lambda side: F.coalesce(F.sum(F.when(F.col("direction") == side, F.col("amount_paise"))), F.lit(0)).cast("long")
    return rows.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"), amount("credit").alias("in_paise"), amount("debit").alias("out_paise"),
        F.min_by("balance_paise", order).alias("first_balance"), F.max_by("balance_paise", order).alias("last_balance"))


def fill_bank(statements: DataFrame) -> DataFrame:
    """statements(file_id, account_id, bank) with missing banks taken from the account's first file that has one."""
    known = statements.where("bank is not null").groupBy("account_id").agg(F.min_by("bank", "file_id").alias("known"))
    return statements.join(known, "account_id", "left").select("file_id", "account_id", F.coalesce("bank", "known").alias("bank"))


def oldest_first(rows: DataFrame) -> DataFrame:
    """statement_id, txn_id, row_index: statements given newest first are turned round and numbered anew."""
    w = Window.partitionBy("statement_id")
    ends = F.struct("row_index", "txn_date")
    x = rows.withColumns({"head": F.min(ends).over(w)["txn_date"], "tail": F.max(ends).over(w)["txn_date"]})
    turned = F.when(F.col("head") > F.col("tail"), -F.col("row_index")).otherwise(F.col("row_index"))
    return x.withColumn("at", turned).select("statement_id", "txn_id", F.row_number().over(w.orderBy("at", "txn_id")).cast("long").alias("row_index"))


def sides_by_place(rows: DataFrame, least_gap: float = 8.0) -> DataFrame:
    """rows (file, n gapless, at, amount_paise, balance_paise, direction) with missing directions told by where amounts stand, and `by_place` true there.

    The widest gap between the places of a file's amounts (the rightmost of equals, wider than least_gap) parts two columns;
    without it all are the left one. Rows whose balance moves by just their amount from row n - 1 vote whether the left
    column is debits, which it is on a tie. A file with fewer than two places to look at, and rows without a place, stay as they are.
    """
    spots = rows.where("at is not null").groupBy("file", "at").agg(F.count("*").alias("amounts"))
    spots = spots.withColumn("next", F.lead("at").over(Window.partitionBy("file").orderBy("at")))
    widest = F.max(F.when(F.col("next").isNotNull(), F.struct((F.col("next") - F.col("at")).alias("gap"), "at", "next")))
    cuts = spots.groupBy("file").agg(F.sum("amounts").alias("amounts"), widest.alias("w")).where("amounts > 1")
    cuts = cuts.select("file", F.when(F.col("w.gap") > least_gap, (F.col("w.at") + F.col("w.next")) / 2).alias("cut"))
    before = rows.select("file", (F.col("n") + 1).alias("n"), F.col("balance_paise").alias("held"))
    step = F.col("balance_paise") - F.col("held")
    left = F.col("cut").isNull() | (F.col("at") < F.col("cut"))
    # 1: the row's column holds debits, -1: credits
    kind = F.when(F.col("amount_paise") == 0, 0).when(step == -F.col("amount_paise"), 1).when(step == F.col("amount_paise"), -1).otherwise(0)
    seen = rows.where("at is not null").select("file", "n", "at", "amount_paise", "balance_paise").join(before, ["file", "n"]).join(cuts, "file")
    votes = seen.groupBy("file").agg(F.sum(F.when(left, kind).otherwise(-kind)).alias("votes"))
    told = cuts.join(votes, "file", "left").select("file", "cut", (F.coalesce("votes", F.lit(0)) >= 0).alias("left_debit"), F.lit(True).alias("known"))
    out = rows.join(told, "file", "left")
    fill = F.col("direction").isNull() & F.col("at").isNotNull() & F.coalesce("known", F.lit(False))
    side = F.when(left == F.col("left_debit"), "debit").otherwise("credit")
    return out.withColumns({"by_place": fill, "direction": F.when(fill, side).otherwise(F.col("direction"))}).drop("cut", "left_debit", "known")


def openings(accounts: DataFrame) -> DataFrame:
    """account_id, opening_paise, basis: what was typed, else the batch's, else the previous run's closing if it ends the day before, else the file's."""
    follows = F.datediff("period_from", "previous_to") == 1
    found = [("manual", F.col("typed_paise")), ("batch", F.col("batch_paise")), ("previous_run", F.when(follows, F.col("previous_paise"))), ("file", F.col("file_paise"))]
    basis = F.coalesce(*[F.when(v.isNotNull(), n) for n, v in found])
    return accounts.select("account_id", F.coalesce(*[v for _, v in found]).alias("opening_paise"), F.coalesce(basis, F.lit("missing")).alias("basis"))


def salary_payers(txn: DataFrame, payer: Column, labelled: Column, percent: int = 2, least: int = 2) -> DataFrame:
    """account_id, payer, n: payers of `least` credits and more, each within `percent` of some labelled salary of the account.

    Amounts and salaries meet by buckets of a logarithm, of which only the least and largest salary matter: those of an
    amount's own bucket are all near enough, those beside it at their nearer end.
    """
    width = F.log(F.lit(1 + percent / 100))
    c = txn.where("direction = 'credit' and amount_paise > 0").select("account_id", payer.alias("payer"), labelled.alias("labelled"), "amount_paise", F.floor(F.log("amount_paise") / width).alias("bucket"))
    ends = c.where("labelled").groupBy("account_id", "bucket").agg(F.min("amount_paise").alias("low"), F.max("amount_paise").alias("high"))
    ends = ends.select("account_id", "low", "high", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda i: F.col("bucket") + i)).alias("bucket"))
    near = lambda s: F.abs(F.col("amount_paise") - s) * 100 <= s * percent
    amounts = c.where("payer is not null").groupBy("account_id", "payer", "bucket", "amount_paise").agg(F.count(F.lit(1)).alias("n"))
    hit = amounts.join(ends, ["account_id", "bucket"], "left").groupBy("account_id", "payer", "bucket", "amount_paise").agg(F.first("n").alias("n"), F.max(F.coalesce(near(F.col("low")) | near(F.col("high")), F.lit(False))).alias("near"))
    return hit.groupBy("account_id", "payer").agg(F.sum("n").alias("n"), F.min("near").alias("all_near")).where(F.col("all_near") & (F.col("n") >= least)).drop("all_near")
