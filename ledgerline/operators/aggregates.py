"""Totals, rankings, balances and the dashboard."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.ledger import Ledger

SUM = "decimal(24,2)"


def _total(column: str):
    return F.coalesce(F.sum(column), F.lit(0)).cast(SUM)


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n"),
        _total("debit_amount").alias("total_debit"),
        _total("credit_amount").alias("total_credit"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
        F.max("debit_amount").alias("largest_debit"),
    )


def counterparties(ledger: Ledger, rows: DataFrame, limit: int = 10, rank_by: str = "debit") -> DataFrame:
    """The top counterparties: matched ones by person, the others by normalized name."""
    sums = [F.count("*").alias("n"), _total("debit_amount").alias("total_debit"), _total("credit_amount").alias("total_credit")]
    matched = rows.filter("counterparty_id is not null").groupBy("counterparty_id").agg(*sums)
    people = ledger.people.select(F.col("id").alias("counterparty_id"), "code", F.col("canonical_name").alias("name"))
    matched = matched.join(people, "counterparty_id", "left").select("counterparty_id", "code", "name", "n", "total_debit", "total_credit")
    others = rows.filter("counterparty_id is null and normalized_counterparty_name is not null").groupBy("normalized_counterparty_name").agg(*sums)
    others = others.select(F.lit(None).cast("long").alias("counterparty_id"), F.lit(None).cast("string").alias("code"), F.col("normalized_counterparty_name").alias("name"), "n", "total_debit", "total_credit")
    key = {"debit": "total_debit", "credit": "total_credit", "count": "n"}[rank_by]
    return matched.unionByName(others).orderBy(F.desc(key), F.asc_nulls_last("counterparty_id"), F.asc_nulls_last("name")).limit(limit)


def closing_balance(rows: DataFrame) -> DataFrame:
    """The balance of the latest row, undated rows last."""
    newest = F.struct(F.coalesce("transaction_date", F.lit("0001-01-01").cast("date")), "id")
    return rows.agg(F.max_by("balance", newest).alias("closing_balance"), F.max_by("transaction_date", newest).alias("balance_date"))


def dashboard_totals(ledger: Ledger, user_id: int) -> DataFrame:
    owned = ledger.owned(user_id)
    count_if = lambda s: F.count_if(F.col("matching_status") == s).alias(s.lower())
    sums = owned.agg(
        F.count("*").alias("transactions"), _total("debit_amount").alias("total_debit"), _total("credit_amount").alias("total_credit"),
        *map(count_if, ("MATCH", "AMBIGUOUS", "UNKNOWN")), F.countDistinct("counterparty_id").alias("people"),
        F.count_if(F.col("matching_status").isin("AMBIGUOUS", "UNKNOWN")).alias("pending_reviews"),
    )
    statements = ledger.statements.filter(F.col("user_id") == user_id).agg(F.count("*").alias("statements"))
    return sums.crossJoin(F.broadcast(statements))  # one row each


def monthly(rows: DataFrame) -> DataFrame:
    month = F.coalesce(F.date_format("transaction_date", "yyyy-MM"), F.lit("unknown")).alias("month")
    return rows.groupBy(month).agg(_total("debit_amount").alias("debit"), _total("credit_amount").alias("credit"), F.count("*").alias("n"))


def by_method(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("payment_method", F.lit("OTHER")).alias("method")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "method")


def daily_activity(rows: DataFrame, as_of: datetime.date, days: int = 30) -> DataFrame:
    """A row per day up to ``as_of``, days without rows included."""
    spark = rows.sparkSession
    start = as_of - datetime.timedelta(days=days - 1)
    calendar = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(as_of))).alias("day"))
    counted = rows.filter(F.col("transaction_date").between(F.lit(start), F.lit(as_of))).groupBy(F.col("transaction_date").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def banks(ledger: Ledger, user_id: int) -> DataFrame:
    statements = ledger.statements.filter(F.col("user_id") == user_id)
    own = ledger.transactions.select(F.col("statement_id").alias("id")).join(statements.select("id"), "id", "left_semi")
    mine = statements.join(own.groupBy("id").agg(F.count("*").alias("n")), "id", "left")
    sums = mine.groupBy("bank_name").agg(F.count("*").alias("statements"), F.coalesce(F.sum("n"), F.lit(0)).alias("transactions"))
    return sums.orderBy(F.desc("statements"), "bank_name")


def person_card(ledger: Ledger, rows: DataFrame) -> DataFrame:
    """People with their identifiers by type and their number of rows."""
    held = ledger.identifiers.groupBy("person_id").pivot("id_type", ["UPI", "ACCOUNT"]).agg(F.array_join(F.sort_array(F.collect_set("value")), ","))
    held = held.select(F.col("person_id").alias("id"), F.col("UPI").alias("upi_ids"), F.col("ACCOUNT").alias("accounts"))
    counts = rows.groupBy(F.col("counterparty_id").alias("id")).agg(F.count("*").alias("n"))
    return ledger.people.join(held, "id", "left").join(counts, "id", "left").select("id", "code", "canonical_name", "upi_ids", "accounts", F.coalesce("n", F.lit(0)).alias("n"))


def person_methods(rows: DataFrame) -> DataFrame:
    known = rows.filter("counterparty_id is not null and payment_method is not null and payment_method <> 'OTHER'")
    return known.groupBy("counterparty_id").agg(F.array_join(F.sort_array(F.collect_set("payment_method")), ",").alias("methods"))


def month_ranges(rows: DataFrame, month: int) -> DataFrame:
    """First and last day of the month in each year that has it."""
    years = rows.filter(F.month("transaction_date") == month).select(F.year("transaction_date").alias("year")).distinct()
    first = F.make_date("year", F.lit(month), F.lit(1))
    return years.select("year", first.alias("first_day"), F.last_day(first).alias("last_day"))
