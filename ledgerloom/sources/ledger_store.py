"""The ledger as a table of files: rows of a statement are written once, replaced when it is parsed again, and traced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import narration, text
from ..operators import classify
from ..plans.scratch import discard, stored


def canonical(rows: DataFrame, run: str) -> DataFrame:
    """Ledger rows (txn_id, statement_id, account_id, txn_date, direction, amount_paise, reference_no, narration, ...) as they
    are stored: with rail, cash kind and flow, the foreign leg of the narration, a content hash and the run that wrote them."""
    x = classify.described(rows).withColumn("leg_", narration.fx_leg(F.col("narration"), F.col("amount_paise")))
    x = x.withColumns({"fx_currency": F.col("leg_.currency"), "fx_minor": F.col("leg_.amount_minor")}).drop("leg_")
    return x.withColumns({"content_hash": text.row_hash(*map(F.col, ("account_id", "txn_date", "direction", "amount_paise", "reference_no"))), "written_by": F.lit(run)})


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("statement_id"), F.lit(buckets)).cast("int")


def replace_statements(new: DataFrame, path: str, replaced: DataFrame | None = None, buckets: int = 64) -> None:
    """Write `new` over what the table at `path` has of its statements, and of those in replaced(statement_id); other statements stay.

    The table is partitioned by a hash of the statement into `buckets` (a property of the table: always the same number),
    so that a replacement rewrites only the buckets of its statements, and their number does not grow with the
    statements. Kept rows are stored before their bucket is overwritten dynamically, so that a failed write can be
    repeated; writing the same again gives the same table. A statement parsed to no rows is named in `replaced`.
    """
    spark = new.sparkSession
    gone = new.select("statement_id").distinct() if replaced is None else new.select("statement_id").unionByName(replaced.select("statement_id")).distinct()
    gone = stored(gone.withColumn("bucket", _bucket(buckets)), "replaced")
    new = new.withColumn("bucket", _bucket(buckets))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at):
        touched = [r[0] for r in gone.select("bucket").distinct().collect()]  # at most `buckets`
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        new = new.unionByName(old.join(gone.select("statement_id"), "statement_id", "left_anti").select(*new.columns))
        new = stored(new, "bucket-rows")
        left = {r[0] for r in new.select("bucket").distinct().collect()}
        new.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(path)
        for b in set(touched) - left:  # a dynamic overwrite leaves partitions alone that get no rows
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"bucket={b}"), True)
        discard(new)
    else:
        new.repartition("bucket").write.partitionBy("bucket").parquet(path)
    discard(gone)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def match_lines(matches: DataFrame, run: str) -> DataFrame:
    """group_id, run, method, side, row_id of matches(book_id, txn_id, method): a line for each row of a match, once.

    A group's number is its one row on the side that has one: the bank row's for a bank row matched by several
    entries, else the entry's."""
    group = F.when(F.col("method") == "one_bank_row", F.concat(F.lit("t"), F.col("txn_id").cast("string"))).otherwise(F.concat(F.lit("b"), F.col("book_id").cast("string")))
    sides = F.explode(F.array(F.struct(F.lit("book").alias("side"), F.col("book_id").alias("row_id")), F.struct(F.lit("bank").alias("side"), F.col("txn_id").alias("row_id"))))
    return matches.select(group.alias("group_id"), F.lit(run).alias("run"), "method", sides.alias("x")).select("group_id", "run", "method", "x.*").distinct()
