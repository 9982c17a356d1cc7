"""What surrounds the ledger: statements and their jobs, audit rows, match records, search documents, pages with their counts.

``jobs``: ``id, statement_id, status, error``. ``audit``: ``id, user_id, action, at``. Visibility is per user throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_date
from ledgerline.operators.filters import latest_first
from ledgerline.operators.vectors import document_content
from ledgerline.plans.ledger import Ledger

#: Ids that a request may name, rows of an audit page, rows that support an answer.
MOST_IDS, MOST_AUDIT, SUPPORTING = 20, 500, 25


def id_list(raw: str | None) -> list[int]:
    """The different positive numbers of a comma-separated parameter, in order, up to ``MOST_IDS``."""
    found = [int(p) for p in re.split(r"\s*,\s*", (raw or "").strip()) if p.isascii() and p.isdigit()]
    return [i for i in dict.fromkeys(found) if i > 0][:MOST_IDS]


def dated_between(day: Column, first: str | None, last: str | None) -> Column:
    """Days within bounds written in any of the statements' formats; a bound that is no date is ignored."""
    low, high = parse_date(F.lit(first)), parse_date(F.lit(last))
    return (low.isNull() | (day >= low)) & (high.isNull() | (day <= high))


def page_with_total(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, latest first, and on each of its rows the count of all pages' rows."""
    total = rows.agg(F.count("*").alias("total"))
    return latest_first(rows).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def listing(ledger: Ledger, user_id: int, predicate: Column | None = None, statement_ids: list[int] | None = None, bank: str | None = None) -> DataFrame:
    """The user's rows, by filter, statements and bank (case ignored)."""
    rows = ledger.owned(user_id)
    if statement_ids:
        rows = rows.filter(F.col("statement_id").isin(statement_ids))
    if bank:
        rows = rows.filter(F.lower("bank_name") == bank.lower())
    return rows if predicate is None else rows.filter(predicate)


def statements(ledger: Ledger, user_id: int, status: str | None = None, limit: int = 20) -> DataFrame:
    """The user's newest statements, of one status or all."""
    mine = ledger.statements.filter(F.col("user_id") == user_id)
    return (mine if status is None else mine.filter(F.col("status") == status)).orderBy(F.desc("id")).limit(limit)


def owned_jobs(ledger: Ledger, jobs: DataFrame, user_id: int) -> DataFrame:
    mine = ledger.statements.filter(F.col("user_id") == user_id).select(F.col("id").alias("statement_id"))
    return jobs.join(mine, "statement_id", "left_semi")


def statement_details(ledger: Ledger, jobs: DataFrame, user_id: int) -> DataFrame:
    """The user's statements with their latest job and the parts of its note."""
    newest = owned_jobs(ledger, jobs, user_id).groupBy("statement_id").agg(F.max_by(F.struct("id", "status", "error"), "id").alias("job"))
    mine = ledger.statements.filter(F.col("user_id") == user_id)
    notes = F.filter(F.transform(F.split("job.error", ";"), lambda w: F.trim(w)), lambda w: w != "")
    joined = mine.join(newest, mine["id"] == newest["statement_id"], "left")
    return joined.select(mine["id"], "bank_name", F.col("job.id").alias("job_id"), F.col("job.status").alias("job_status"), notes.alias("warnings"))


def job_states(report: DataFrame) -> DataFrame:
    """``file_id, status, error``: the end of each file's job, from the report of ``files.parsed``."""
    note = F.coalesce("error", F.nullif(F.array_join("warnings", ";"), F.lit("")))
    return report.select("file_id", F.when(F.col("error").isNull(), "COMPLETED").otherwise("FAILED").alias("status"), note.alias("error"))


def audit_rows(entities: DataFrame, action: str, entity: str, user: Column, key: Column) -> DataFrame:
    """A row to append for each entity: who did what to which."""
    return entities.select(user.alias("user_id"), F.lit(action).alias("action"), F.lit(entity).alias("entity"), key.cast("string").alias("entity_id"), F.current_timestamp().alias("at"))


def audit_page(audit: DataFrame, user_id: int, limit: int = 100) -> DataFrame:
    """The user's newest audit rows."""
    return audit.filter(F.col("user_id") == user_id).orderBy(F.desc("at"), F.desc("id")).limit(min(limit, MOST_AUDIT))


def transactions(rows: DataFrame) -> DataFrame:
    """Ledger rows as transactions: the side that is set, a method always, the column's reference before the narration's.

    ``rows``: ``debit, credit, payment_method, reference, found_reference`` and more.
    """
    side = F.when(F.col("debit").isNotNull(), "DEBIT").when(F.col("credit").isNotNull(), "CREDIT")
    method, reference = F.coalesce("payment_method", F.lit("OTHER")), F.coalesce(F.nullif("reference", F.lit("")), "found_reference")
    return rows.withColumns({"transaction_type": side, "payment_method": method, "reference_number": reference}).drop("reference", "found_reference")


# --- match records ------------------------------------------------------------------------------------------------


def matched(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Transactions with the outcome of their match record, one each, in place of what they had; rows without a record stay."""
    fields = {"counterparty_id": "person_id", "matching_status": "status"}
    joined = rows.join(decisions.select("id", *[F.col(c).alias(f"_{c}") for c in fields.values()], F.lit(True).alias("_has")), "id", "left")
    kept = [F.when(F.col("_has"), F.col(f"_{fields[c]}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns]
    return joined.select(*kept)


def match_output(decisions: DataFrame, people: DataFrame) -> DataFrame:
    """Match records as they are shown: the person's and the suggestion's codes beside status and evidence."""
    code = lambda c: people.select(F.col("id").alias(c), F.col("code").alias(c.replace("_id", "_code")))
    return decisions.join(code("person_id"), "person_id", "left").join(code("suggested_person_id"), "suggested_person_id", "left")


def person_details(rows: DataFrame) -> DataFrame:
    """``counterparty_id, n, total_debit, total_credit, methods``: each person's sums and methods."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(18,2)").alias(f"total_{c.split('_')[0]}")
    methods = F.array_join(F.sort_array(F.collect_set("payment_method")), ",").alias("methods")
    return rows.filter("counterparty_id is not null").groupBy("counterparty_id").agg(F.count("*").alias("n"), total("debit_amount"), total("credit_amount"), methods)


def latest_per_person(rows: DataFrame, n: int = 100) -> DataFrame:
    """Each person's latest rows with their place."""
    order = Window.partitionBy("counterparty_id").orderBy(F.desc_nulls_last("transaction_date"), F.desc("id"))
    return rows.filter("counterparty_id is not null").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def latest_matches(rows: DataFrame, decisions: DataFrame, n: int = 20) -> DataFrame:
    """Each person's latest match records."""
    met = decisions.filter("person_id is not null").select("id", F.col("person_id").alias("counterparty_id"), "confidence")
    return latest_per_person(rows.drop("counterparty_id").join(met, "id"), n)


# --- search documents and answers ---------------------------------------------------------------------------------


def document_records(rows: DataFrame) -> DataFrame:
    """``id, statement_id, transaction_date, counterparty_id, content, content_hash``: a search document for each transaction."""
    texts = document_content(rows).select("id", "content", F.sha2("content", 256).alias("content_hash"))
    return rows.select("id", "statement_id", "transaction_date", "counterparty_id").join(texts, "id")


def reindexed(ledger: Ledger, user_id: int) -> DataFrame:
    """The documents of all the user's completed statements, made anew."""
    return document_records(ledger.owned(user_id).filter("status = 'COMPLETED'"))


def hull(ranges: DataFrame) -> DataFrame:
    """First and last day of several ranges (``first_day, last_day``)."""
    return ranges.agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def merged_hits(structured: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """``id, place``: semantic hits (``id, score``) that the structured rows hold, by score, then the rest of these, latest first."""
    both = structured.join(semantic.select("id", "score"), "id", "left")
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("transaction_date"), F.desc("id")]
    top = both.orderBy(*order).limit(limit)
    return top.select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))  # at most ``limit`` rows


def fitting(hits: DataFrame, direction: str | None = None, method: str | None = None) -> DataFrame:
    """Semantic hits of the direction and method that were asked for."""
    wanted = F.lit(True)
    if direction:
        wanted = wanted & (F.col("transaction_type") == direction.upper())
    if method:
        wanted = wanted & (F.col("payment_method") == method.upper())
    return hits.filter(wanted)


def supporting(ledger: Ledger, rows: DataFrame) -> DataFrame:
    """The latest rows an answer rests on, with a label of whom they concern and amounts as text."""
    top = latest_first(rows).limit(SUPPORTING)
    people = ledger.people.select(F.col("id").alias("counterparty_id"), "code", "canonical_name")
    label = F.coalesce(F.concat("canonical_name", F.lit(" ("), "code", F.lit(")")), "counterparty_name", F.lit("Unknown counterparty"))
    amount = F.coalesce("debit_amount", "credit_amount").cast("string")
    return top.join(people, "counterparty_id", "left").select("id", "transaction_date", label.alias("label"), "transaction_type", amount.alias("amount"))
