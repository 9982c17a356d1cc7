"""Registered queries of dates and of statement streams, over files and cells that Spark derives from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_date, parse_partial_date
from ledgerline.plans.document_queries import statement_files
from ledgerline.plans.queries import query
from ledgerline.plans.session import checkpointed, shared_path
from ledgerline.streaming import ingest

#: Ways to write a day, by the order's number.
SPELLINGS = ("dd-MM-yyyy", "d/M/yyyy", "d MMM yyyy", "dd-MMM-yy", "yyyy-MM-dd", "MMM d, yyyy", "d.M.yyyy", "EEEE, d MMMM yyyy", "dd MMM yyyy hh:mm:ss a", "yyyy-MM-dd'T'HH:mm:ss", "MMMM d yyyy")


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, cell, as_of``: the day of each order in one of thirteen spellings, the last two an ordinal one and one without its year."""
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 13
    cell = F.when(kind == 11, F.concat(F.dayofmonth(day), F.when(F.dayofmonth(day).isin(1, 21, 31), "st").otherwise("th"), F.date_format(day, " MMM yyyy"))).when(kind == 12, F.date_format(day, "d MMMM"))
    for k, form in enumerate(SPELLINGS):
        cell = F.when(kind == k, F.date_format(day, form)).otherwise(cell)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), cell.alias("cell"), F.lit("1996-06-15").cast("date").alias("as_of"))


@query("date_spellings", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 12 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 13 <> 12 AS complete,
CASE WHEN o_orderkey % 13 <> 12 THEN CAST(o_orderdate AS DATE) WHEN strftime(o_orderdate, '%d-%m') <> '29-02' OR year(o_orderdate) % 4 = 0 THEN make_date(1996, month(o_orderdate), day(o_orderdate)) END AS guessed FROM orders""", views=False)
def date_spellings(spark, sf_dir):
    """Each distinct cell is read once."""
    cells = written_dates(spark, sf_dir)
    read = cells.select("cell", "as_of").distinct().withColumn("day", parse_date(F.col("cell"))).withColumn("partial", parse_partial_date(F.col("cell"), F.col("as_of")))
    return cells.join(read, ["cell", "as_of"]).select("id", "day", F.col("partial.complete").alias("complete"), F.col("partial.date").alias("guessed"))


def upload_waves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three waves of uploads: all statements; repeats, files that failed, and new versions of some; old content once more and further versions."""
    files = checkpointed(statement_files(spark, sf_dir)).select((F.col("file_id") % 5).alias("user_id"), "file_id", "name", "content", "size")
    version = lambda k: files.withColumn("content", F.concat(F.lit(f"Version {k}\n").cast("binary"), "content")).withColumn("size", F.length("content").cast("long"))
    sent = lambda df, k: df.withColumn("file_id", F.col("file_id") * 10 + k)
    s = F.col("file_id")
    second = sent(files.filter((s % 3 == 0) | (s % 17 == 0)), 1).union(sent(version(2).filter(s % 5 == 0), 2))
    third = sent(files.filter(s % 7 == 0), 3).union(sent(version(2).filter(s % 10 == 0), 4)).union(sent(version(3).filter(s % 15 == 0), 5))
    return [sent(files, 0), second, third]


@query("statement_stream", """, latest AS (SELECT statement_id, count(*) AS n_rows, sum(debit_amount) AS debit, sum(credit_amount) AS credit FROM txn WHERE statement_id % 17 <> 0 GROUP BY 1)
SELECT statement_id % 5 AS user_id, statement_id, statement_id * 10 + CASE WHEN statement_id % 15 = 0 THEN 5 WHEN statement_id % 5 = 0 THEN 2 ELSE 0 END AS file_id, n_rows,
  CAST(debit AS DECIMAL(24,2)) AS debit, CAST(credit AS DECIMAL(24,2)) AS credit FROM latest""")
def statement_stream(spark, sf_dir):
    """All waves through the stateful stream, each as it arrives; each statement's rows are those of its latest new content."""
    sent, table, state = shared_path(spark, "uploads"), shared_path(spark, "statements"), shared_path(spark, "stream-state")
    for wave in upload_waves(spark, sf_dir):
        wave.write.mode("append").parquet(sent)
        stream = spark.readStream.schema(ingest.UPLOADS).parquet(sent)
        ingest.ingest_once(stream, table, state, F.floor(F.col("file_id") / 10)).awaitTermination()  # the wave is a micro-batch
    rows = ingest.statement_rows(spark, table)
    sums = rows.groupBy("user_id", "statement_id", "file_id").agg(F.count("*").alias("n_rows"), F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    return sums.select(*(F.col(c).cast("long").alias(c) for c in ("user_id", "statement_id", "file_id")), "n_rows", *(F.col(c).cast("decimal(24,2)").alias(c) for c in ("debit", "credit")))
