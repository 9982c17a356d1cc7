"""Plain cells of statements, which are most of them, are read without the general forms, with the same result."""

import datetime
import time

from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_date
from ledgerline.functions.money import parse_amount
from ledgerline.operators import layout


def _seconds(df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_plain_cells_cost_less_than_spelled_ones(spark):
    """Fails where every cell goes through the grammar."""
    day = F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") % 3000).cast("int"))
    cells = spark.range(200_000).select(F.date_format(day, "dd-MM-yyyy").alias("plain"), F.concat_ws(" ", F.date_format(day, "dd"), F.date_format(day, "MMMM"), F.date_format(day, "yyyy")).alias("spelled"), F.concat(F.lit("payee "), F.col("id")).alias("other")).localCheckpoint()
    assert cells.filter(~F.coalesce(parse_date(F.col("plain")) == parse_date(F.col("spelled")), F.lit(False)) | parse_date(F.col("other")).isNotNull()).isEmpty()
    taken = {c: min(_seconds(cells.select(parse_date(F.col(c)))) for _ in range(3)) for c in cells.columns}
    assert taken["plain"] < 0.6 * taken["spelled"] and taken["other"] < 0.6 * taken["spelled"], taken


def test_edges_of_plain_cells(spark):
    dates = {"13-02-2024": "2024-02-13", "02/13/2024": "2024-02-13", "30.02.2024": None, "29-02-2023": None, "2024-02-29": "2024-02-29", "2023-02-29": None, "45000": "2023-03-15", "45000.00": "2023-03-15", "45000.50": None, "payee 1 2 2024": None, "1 Jan 2024 12:30:15.123456": "2024-01-01", "Mon, 1st of Sept 2024": "2024-09-01", "01-02-2024\n": "2024-02-01", "REF12345": None}
    got = {r.v: r.d for r in spark.createDataFrame([(k,) for k in dates], "v string").select("v", parse_date(F.col("v")).alias("d")).collect()}
    assert got == {k: v and datetime.date.fromisoformat(v) for k, v in dates.items()}
    amounts = {"5": "5.00", "-5.5": "-5.50", "999999999999.99": "999999999999.99", "1000000000000": None, "1.005": "1.00", "1e2": "100.00", "Rs 5 Cr": "5.00", "(5)": "-5.00", "5-": "-5.00", "1-2": None, "12/03": None, "payee 5": None, "": None, "5\n": "5.00"}
    got = {r.v: r.d and str(r.d) for r in spark.createDataFrame([(k,) for k in amounts], "v string").select("v", parse_amount(F.col("v")).cast("string").alias("d")).collect()}
    assert got == amounts


def test_header_keys_with_digits_in_parentheses(spark):
    rows = spark.createDataFrame([(1, 0, ["Date", "Debit (in 2024)", "Credit 1"]), (1, 1, ["01-02-2024", "5", ""])], "file_id long, row_no int, cells array<string>")
    found = layout.header_layout(rows).collect()
    assert [(r.date_idx, r.debit_idx, r.credit_idx, r.first_row) for r in found] == [(0, 1, None, 1)]
