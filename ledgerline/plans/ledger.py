"""The ledger as DataFrames: transactions, statements, people and their identifiers.

``from_tables`` maps the star schema of the test tables onto it, so that every operator runs at any scale without bank files.
Visibility is per user: a transaction belongs to its statement's user.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"


@dataclass(frozen=True)
class Ledger:
    transactions: DataFrame
    statements: DataFrame
    people: DataFrame
    identifiers: DataFrame

    def owned(self, user_id: int) -> DataFrame:
        """The user's transactions with their statement's bank."""
        mine = self.statements.filter(F.col("user_id") == user_id).select(F.col("id").alias("statement_id"), "bank_name", "status")
        return self.transactions.join(mine, "statement_id")


def from_tables(spark: SparkSession, sf_dir: str) -> Ledger:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    debit = F.col("o_orderstatus") != "F"
    amount = F.col("o_totalprice").cast(MONEY)
    first = F.substring("o_orderpriority", 1, 1)
    name = F.concat(F.lit("Payee "), (F.col("o_custkey") % 50).cast("string"))
    transactions = table("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("statement_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.when(debit, amount).alias("debit_amount"),
        F.when(~debit, amount).alias("credit_amount"),
        (F.col("o_orderkey") % 1000).cast(MONEY).alias("balance"),
        F.when(debit, "DEBIT").otherwise("CREDIT").alias("transaction_type"),
        F.when(first == "1", "UPI").when(first == "2", "PAYTM").when(first == "3", "NEFT").when(first == "4", "ATM").alias("payment_method"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 100).alias("counterparty_id"),
        name.alias("counterparty_name"),
        F.lower(name).alias("normalized_counterparty_name"),
        F.concat(F.lit("supplier"), (F.col("o_orderkey") % 100).cast("string"), F.lit("@ok"), (F.col("o_orderkey") % 25).cast("string")).alias("normalized_upi_id"),
        F.concat(F.lit("REF"), F.col("o_orderkey").cast("string")).alias("reference_number"),
        F.concat_ws("/", "o_orderpriority", F.col("o_custkey").cast("string")).alias("description"),
        F.when(F.col("o_orderkey") % 7 != 0, "MATCH").when(F.col("o_orderkey") % 2 == 0, "AMBIGUOUS").otherwise("UNKNOWN").alias("matching_status"),
    )
    statements = table("customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").cast("long").alias("user_id"),
        F.col("c_mktsegment").alias("bank_name"),
        F.when(F.col("c_custkey") % 5 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
    )
    people = table("supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("P"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("code"),
        F.col("s_name").alias("canonical_name"),
        F.lower("s_name").alias("normalized_name"),
    )
    upi = F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"), F.lit("@ok"), F.col("s_nationkey").cast("string"))
    account = F.concat(F.lit("XXXX"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"))
    pairs = F.explode(F.array(F.struct(F.lit("UPI").alias("id_type"), upi.alias("value")), F.struct(F.lit("ACCOUNT").alias("id_type"), account.alias("value"))))
    identifiers = table("supplier").select(F.col("s_suppkey").alias("person_id"), pairs.alias("i")).select("person_id", "i.id_type", "i.value", F.when(F.col("i.id_type") == "UPI", F.lower("i.value")).otherwise(F.col("i.value")).alias("normalized_value"))
    return Ledger(transactions, statements, people, identifiers)


#: The same views for the SQL oracle, as the head of a statement.
VIEWS_SQL = """WITH txn AS (SELECT o_orderkey AS id, o_custkey AS statement_id, CAST(o_orderdate AS DATE) AS transaction_date,
  CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(14,2)) END AS debit_amount,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(14,2)) END AS credit_amount,
  CAST(o_orderkey % 1000 AS DECIMAL(14,2)) AS balance,
  CASE WHEN o_orderstatus <> 'F' THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'UPI' WHEN '2' THEN 'PAYTM' WHEN '3' THEN 'NEFT' WHEN '4' THEN 'ATM' END AS payment_method,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 100 END AS counterparty_id,
  'Payee ' || CAST(o_custkey % 50 AS VARCHAR) AS counterparty_name, 'payee ' || CAST(o_custkey % 50 AS VARCHAR) AS normalized_counterparty_name,
  'supplier' || CAST(o_orderkey % 100 AS VARCHAR) || '@ok' || CAST(o_orderkey % 25 AS VARCHAR) AS normalized_upi_id,
  'REF' || CAST(o_orderkey AS VARCHAR) AS reference_number, o_orderpriority || '/' || CAST(o_custkey AS VARCHAR) AS description,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'MATCH' WHEN o_orderkey % 2 = 0 THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS matching_status FROM orders),
statement AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS user_id, c_mktsegment AS bank_name, CASE WHEN c_custkey % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM customer),
person AS (SELECT s_suppkey AS id, 'P' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS canonical_name, lower(s_name) AS normalized_name FROM supplier),
identifier AS (SELECT s_suppkey AS person_id, 'UPI' AS id_type, 'supplier' || CAST(s_suppkey AS VARCHAR) || '@ok' || CAST(s_nationkey AS VARCHAR) AS value FROM supplier
  UNION ALL SELECT s_suppkey, 'ACCOUNT', 'XXXX' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') FROM supplier),
owned AS (SELECT t.*, s.user_id, s.bank_name, s.status FROM txn t JOIN statement s ON s.id = t.statement_id)
"""
