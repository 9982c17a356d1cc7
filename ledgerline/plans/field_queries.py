"""Registered queries of narration fields, money cells and redaction over cells that Spark derives from ``orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import money, narration, text
from ledgerline.plans.queries import query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _letters(number: Column) -> Column:
    return F.concat(F.lit("ZED"), F.translate(number.cast("string"), "0123456789", "BDFGHKLMNP"))


def written_narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, narration``: six ways in which banks write a payment to a payee, with names of letters only."""
    first, last, account = _letters(F.col("o_custkey")), F.concat(F.lit("QUOR"), F.substring(_letters(F.col("o_custkey") % 97), 4, 9)), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    handle = F.concat(F.lower(first), F.lit("@okaxis"))
    ways = [
        F.concat(F.lit("UPI/"), first, F.lit("/"), handle, F.lit("/"), F.col("o_orderkey") + 10_000_000),
        F.concat(first, F.lit(" "), last, F.lit(" / UPI / "), handle),
        F.concat(F.lit("NEFT-"), first, F.lit(" "), last, F.lit("-XXXX"), account),
        F.concat(F.lit("Transfer to "), F.initcap(first), F.lit(" "), F.initcap(last), F.lit(" A/C XXXX"), account),
        F.concat(F.lit("PHONEPE-"), first, F.lit("@OKAXIS")),
        F.concat(F.lit("PAYTM-"), first, F.lit("-XXXX"), account),
    ]
    cell = F.element_at(F.array(*ways), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), cell.alias("narration"))


@query("narrations_of_orders", """WITH n AS (SELECT o_orderkey AS id, o_orderkey % 6 AS way, 'Zed' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'bdfghklmnp') AS first,
  'Quor' || translate(CAST(o_custkey % 97 AS VARCHAR), '0123456789', 'bdfghklmnp') AS last, 'XXXX' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS account FROM orders)
SELECT id, CASE way WHEN 2 THEN 'NEFT' WHEN 3 THEN 'BANK_TRANSFER' WHEN 4 THEN 'PHONEPE' WHEN 5 THEN 'PAYTM' ELSE 'UPI' END AS payment_method, CASE WHEN way IN (1, 2, 3) THEN first || ' ' || last ELSE first END AS name,
  lower(CASE WHEN way IN (1, 2, 3) THEN first || ' ' || last ELSE first END) AS normalized_name, CASE WHEN way IN (0, 1, 4) THEN lower(first) || '@okaxis' END AS normalized_upi_id,
  CASE WHEN way IN (2, 3, 5) THEN account END AS account_identifier, CASE WHEN way = 0 THEN CAST(id + 10000000 AS VARCHAR) END AS reference, true AS strong FROM n""", views=False)
def narrations_of_orders(spark, sf_dir):
    found = narration.extract(written_narrations(spark, sf_dir), "narration")
    return found.select("id", "payment_method", "name", "normalized_name", "normalized_upi_id", "account_identifier", "reference", narration.has_strong_identifier().alias("strong"))


@query("amounts_of_orders", """SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 7 IN (2, 3, 5) THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(14,2)) AS DECIMAL(14,2)) AS amount,
CASE o_orderkey % 7 WHEN 0 THEN 'DEBIT' WHEN 1 THEN 'CREDIT' WHEN 6 THEN 'DEBIT' END AS side FROM orders""", views=False)
def amounts_of_orders(spark, sf_dir):
    """Each order's price in one of seven spellings: sides, signs, parentheses, currency marks, thousands commas."""
    price = F.col("o_totalprice").cast("decimal(14,2)")
    plain, grouped = price.cast("string"), F.format_number(price, 2)
    ways = [
        F.concat(grouped, F.lit(" Dr")), F.concat(plain, F.lit(" CR")), F.concat(F.lit("("), grouped, F.lit(")")), F.concat(F.lit("-"), plain), F.concat(F.lit("₹ "), grouped),
        F.concat(plain, F.lit("-")), F.concat(F.lit("Rs. "), grouped, F.lit(" Debit")),
    ]
    cell = F.element_at(F.array(*ways), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), money.parse_amount(cell).alias("amount"), money.amount_side(cell).alias("side"))


@query("redaction_of_orders", """SELECT o_orderkey AS id, 'XXXX' || right(CAST(o_orderkey + 100000000 AS VARCHAR), 4) AS account, 'pa***@ok' || CAST(o_custkey AS VARCHAR) AS handle,
CASE o_orderkey % 4 WHEN 0 THEN 'login password=[REDACTED] end' WHEN 1 THEN 'PWD: [REDACTED] end' WHEN 2 THEN 'my Api-Key = [REDACTED] end' ELSE 'Authorization: Bearer [REDACTED] end' END AS clean FROM orders""", views=False)
def redaction_of_orders(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    said = F.element_at(F.array(F.lit("login password="), F.lit("PWD: "), F.lit("my Api-Key = "), F.lit("Authorization: Bearer ")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return _orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), text.mask_account((F.col("o_orderkey") + 100_000_000).cast("string")).alias("account"),
        text.redact_upi(F.concat(F.lit("payee"), key, F.lit("@ok"), F.col("o_custkey"))).alias("handle"), text.redact_secrets(F.concat(said, F.lit("s3cret"), key, F.lit(" end"))).alias("clean"),
    )
