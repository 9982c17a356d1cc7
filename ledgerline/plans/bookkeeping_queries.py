"""Registered queries over statements, jobs, audit rows, match records and search documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import aggregates, bookkeeping
from ledgerline.plans import questions
from ledgerline.plans.ledger import from_tables
from ledgerline.plans.queries import AS_OF, USER, query
from ledgerline.sources import files


def jobs(spark, sf_dir):
    """Orders as jobs of their customer's statement."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("first; second "), F.col("o_orderkey").cast("string"), F.lit(";")))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("statement_id"), F.col("o_orderstatus").alias("status"), note.alias("error"))


def decisions(spark, sf_dir):
    rows = from_tables(spark, sf_dir).transactions.filter("id % 3 <> 0")
    status = F.when(F.col("id") % 5 == 0, "AMBIGUOUS").otherwise("MATCH")
    return rows.select("id", status.alias("status"), F.when(status == "MATCH", F.col("id") % 80).alias("person_id"), (F.col("id") % 90).alias("suggested_person_id"), F.lit(0.9).alias("confidence"))


_JOB = "SELECT o_orderkey AS id, o_custkey AS statement_id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'first; second ' || o_orderkey || ';' END AS error FROM orders"
_DECISION = "SELECT id, CASE WHEN id % 5 = 0 THEN 'AMBIGUOUS' ELSE 'MATCH' END AS status, CASE WHEN id % 5 <> 0 THEN id % 80 END AS person_id, id % 90 AS suggested_person_id FROM txn WHERE id % 3 <> 0"


@query("statement_details", f""", job AS ({_JOB}), latest AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY id DESC) AS r FROM job)
SELECT s.id, s.bank_name, l.id AS job_id, l.status AS job_status, CASE WHEN l.error IS NOT NULL THEN 'first|second ' || l.id END AS warnings FROM statement s LEFT JOIN latest l ON l.statement_id = s.id AND r = 1 WHERE user_id = {USER}""")
def statement_details(spark, sf_dir):
    found = bookkeeping.statement_details(from_tables(spark, sf_dir), jobs(spark, sf_dir), USER)
    return found.select("id", "bank_name", "job_id", "job_status", F.array_join("warnings", "|").alias("warnings"))


@query("owned_jobs", f", job AS ({_JOB}) SELECT j.id, j.status FROM job j JOIN statement s ON s.id = j.statement_id WHERE user_id = {USER}")
def owned_jobs(spark, sf_dir):
    return bookkeeping.owned_jobs(from_tables(spark, sf_dir), jobs(spark, sf_dir), USER).select("id", "status")


@query("audit_page", f"SELECT event_id AS id, event_type AS action FROM events WHERE user_id = {USER} ORDER BY ts DESC, event_id DESC LIMIT 100", views=False)
def audit_page(spark, sf_dir):
    audit = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.col("ts").alias("at"))
    return bookkeeping.audit_page(audit, USER).select("id", "action")


@query("listing_page", f"""SELECT id, transaction_date, (SELECT count(*) FROM owned WHERE user_id = {USER} AND lower(bank_name) = 'building' AND transaction_date >= DATE '1996-02-01') AS total FROM owned
WHERE user_id = {USER} AND lower(bank_name) = 'building' AND transaction_date >= DATE '1996-02-01' ORDER BY transaction_date DESC NULLS LAST, id DESC LIMIT 20 OFFSET 20""")
def listing_page(spark, sf_dir):
    """Second page of a bank's rows from a date on, in whatever format it is written; the other bound is no date."""
    days = bookkeeping.dated_between(F.col("transaction_date"), "1 Feb 1996", "no date")
    return bookkeeping.page_with_total(bookkeeping.listing(from_tables(spark, sf_dir), USER, days, bank="Building"), 20, 20).select("id", "transaction_date", "total")


@query("scoped_listing", f"SELECT id, statement_id FROM owned WHERE user_id = {USER} AND statement_id IN (SELECT id FROM statement WHERE user_id = {USER} ORDER BY id LIMIT 2)")
def scoped_listing(spark, sf_dir):
    ledger = from_tables(spark, sf_dir)
    two = [r.id for r in ledger.statements.filter(F.col("user_id") == USER).orderBy("id").limit(2).collect()]
    return bookkeeping.listing(ledger, USER, statement_ids=bookkeeping.id_list(f"{two[0]}, x,{two[1]},-4,{two[0]}")).select("id", "statement_id")


@query("match_records", f""", d AS ({_DECISION}) SELECT t.id, CASE WHEN d.id IS NULL THEN t.counterparty_id ELSE d.person_id END AS counterparty_id, coalesce(d.status, t.matching_status) AS matching_status FROM txn t LEFT JOIN d ON d.id = t.id""")
def match_records(spark, sf_dir):
    return bookkeeping.matched(from_tables(spark, sf_dir).transactions, decisions(spark, sf_dir)).select("id", "counterparty_id", "matching_status")


@query("match_output", f", d AS ({_DECISION}) SELECT d.id, d.status, p.code AS person_code, s.code AS suggested_person_code FROM d LEFT JOIN person p ON p.id = d.person_id LEFT JOIN person s ON s.id = d.suggested_person_id")
def match_output(spark, sf_dir):
    return bookkeeping.match_output(decisions(spark, sf_dir), from_tables(spark, sf_dir).people).select("id", "status", "person_code", "suggested_person_code")


@query("person_details", f"""SELECT counterparty_id, count(*) AS n, CAST(coalesce(sum(debit_amount), 0) AS DECIMAL(18,2)) AS total_debit, CAST(coalesce(sum(credit_amount), 0) AS DECIMAL(18,2)) AS total_credit,
coalesce(string_agg(DISTINCT payment_method, ',' ORDER BY payment_method), '') AS methods FROM owned WHERE user_id = {USER} AND counterparty_id IS NOT NULL GROUP BY 1""")
def person_details(spark, sf_dir):
    return bookkeeping.person_details(from_tables(spark, sf_dir).owned(USER))


@query("person_latest_matches", f""", d AS ({_DECISION}), m AS (SELECT d.person_id AS counterparty_id, t.id, row_number() OVER (PARTITION BY d.person_id ORDER BY t.transaction_date DESC NULLS LAST, t.id DESC) AS place FROM txn t JOIN d ON d.id = t.id WHERE d.person_id IS NOT NULL)
SELECT counterparty_id, id, place FROM m WHERE place <= 20""")
def person_latest_matches(spark, sf_dir):
    return bookkeeping.latest_matches(from_tables(spark, sf_dir).transactions, decisions(spark, sf_dir)).select("counterparty_id", "id", "place")


@query("document_records", f"""SELECT id, sha256(concat_ws(' | ', coalesce(CAST(transaction_date AS VARCHAR), 'unknown date'), coalesce(counterparty_name, 'Unknown counterparty'), transaction_type,
CASE WHEN debit_amount IS NOT NULL THEN 'Rs ' || debit_amount WHEN credit_amount IS NOT NULL THEN 'Rs ' || credit_amount ELSE 'amount unknown' END, coalesce(payment_method, 'OTHER'), coalesce(description, ''))) AS content_hash
FROM owned WHERE user_id = {USER} AND status = 'COMPLETED'""")
def document_records(spark, sf_dir):
    return bookkeeping.reindexed(from_tables(spark, sf_dir), USER).select("id", "content_hash")


@query("period_hull", f"SELECT min(make_date(y, 2, 1)) AS first_day, max(last_day(make_date(y, 2, 1))) AS last_day FROM (SELECT DISTINCT CAST(year(transaction_date) AS INTEGER) AS y FROM owned WHERE user_id = {USER} AND month(transaction_date) = 2)")
def period_hull(spark, sf_dir):
    return bookkeeping.hull(aggregates.month_ranges(from_tables(spark, sf_dir).owned(USER), 2))


@query("merged_hits", f""", h AS (SELECT id, (id * 7919 % 1000) / 1000.0 AS score FROM owned WHERE user_id = {USER} AND id % 10 = 0 AND transaction_type = 'DEBIT' AND payment_method = 'UPI'),
s AS (SELECT o.id, row_number() OVER (ORDER BY h.score DESC NULLS LAST, transaction_date DESC NULLS LAST, o.id DESC) AS place FROM owned o LEFT JOIN h ON h.id = o.id WHERE user_id = {USER} AND statement_id % 2 = 0)
SELECT id, CAST(place AS INTEGER) AS place FROM s WHERE place <= 40""")
def merged_hits(spark, sf_dir):
    """Semantic hits of one direction and method first, as far as the structured rows hold them."""
    rows = from_tables(spark, sf_dir).owned(USER)
    hits = bookkeeping.fitting(rows.filter("id % 10 = 0"), "debit", "upi").select("id", ((F.col("id") * 7919 % 1000) / 1000.0).alias("score"))
    return bookkeeping.merged_hits(rows.filter("statement_id % 2 = 0"), hits, 40)


@query("supporting_rows", f"""SELECT o.id, transaction_date, coalesce(canonical_name || ' (' || code || ')', counterparty_name) AS label, transaction_type, CAST(coalesce(debit_amount, credit_amount) AS VARCHAR) AS amount
FROM owned o LEFT JOIN person p ON p.id = o.counterparty_id WHERE user_id = {USER} ORDER BY transaction_date DESC NULLS LAST, o.id DESC LIMIT 25""")
def supporting_rows(spark, sf_dir):
    ledger = from_tables(spark, sf_dir)
    return bookkeeping.supporting(ledger, ledger.owned(USER))


@query("ingest_jobs", """, f AS (SELECT statement_id AS file_id FROM txn GROUP BY 1) SELECT file_id, CASE WHEN file_id % 17 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status FROM f""")
def ingest_jobs(spark, sf_dir):
    from ledgerline.plans.document_queries import statement_files

    return bookkeeping.job_states(files.parsed(statement_files(spark, sf_dir))[1]).select("file_id", "status")


@query("typed_transactions", """SELECT id, transaction_type, coalesce(payment_method, 'OTHER') AS payment_method, CASE WHEN id % 4 = 0 THEN 'R' || id ELSE reference_number END AS reference_number FROM txn""")
def typed_transactions(spark, sf_dir):
    rows = from_tables(spark, sf_dir).transactions.select("id", F.col("debit_amount").alias("debit"), F.col("credit_amount").alias("credit"), "payment_method", F.when(F.col("id") % 4 == 0, F.concat(F.lit("R"), F.col("id").cast("string"))).otherwise("").alias("reference"), F.col("reference_number").alias("found_reference"))
    return bookkeeping.transactions(rows).select("id", "transaction_type", "payment_method", "reference_number")


#: A question for each way of answering.
QUESTIONS = [
    "How much did I receive in total?", "Show my biggest transactions", "What is my balance?", "What is my total credit and debit?", "Who did I transfer the most money to?", "Who did I transact with in 1997?", "Show all transactions in March 1998", "How much did I send to Nobody Known?",
]


def _rupees(sql: str) -> str:
    return f"'Rs ' || format('{{:,.2f}}', CAST({sql} AS DOUBLE))"


_MINE = f"(SELECT * FROM owned WHERE user_id = {USER})"

@query("answers_by_intent", f""", mine AS (SELECT *, year(transaction_date) AS y FROM {_MINE}), debits AS (SELECT * FROM mine WHERE transaction_type = 'DEBIT'),
by_person AS (SELECT coalesce(canonical_name || ' (' || code || ')', name) AS who, d, n, c FROM (SELECT counterparty_id AS c, NULL AS name, sum(debit_amount) AS d, count(*) AS n FROM debits WHERE counterparty_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT NULL, normalized_counterparty_name, sum(debit_amount), count(*) FROM debits WHERE counterparty_id IS NULL GROUP BY ALL) o LEFT JOIN person p ON p.id = o.c),
in_1997 AS (SELECT coalesce(canonical_name || ' (' || code || ')', name) AS who, n, c, coalesce(canonical_name, name) AS plain FROM (SELECT counterparty_id AS c, NULL AS name, count(*) AS n FROM mine WHERE y = 1997 AND counterparty_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT NULL, normalized_counterparty_name, count(*) FROM mine WHERE y = 1997 AND counterparty_id IS NULL GROUP BY ALL) o LEFT JOIN person p ON p.id = o.c)
SELECT 0 AS n, 'counterparties — Total received: ' || {_rupees("sum(credit_amount)")} || '. (Verified from ' || count(*) || ' transactions.)' AS answer FROM mine WHERE transaction_type = 'CREDIT'
UNION ALL SELECT 1, 'Largest debit on ' || max(transaction_date) || ': ' || {_rupees("max(debit_amount)")} || '.' FROM debits WHERE debit_amount = (SELECT max(debit_amount) FROM debits)
UNION ALL SELECT 2, 'Closing balance on ' || transaction_date || ': ' || {_rupees("balance")} || '.' FROM (SELECT * FROM mine ORDER BY transaction_date DESC NULLS LAST, id DESC LIMIT 1)
UNION ALL SELECT 3, 'Total debits: ' || {_rupees("sum(debit_amount)")} || ' · Total credits: ' || {_rupees("sum(credit_amount)")} || ' (verified from ' || count(*) || ' transactions).' FROM mine
UNION ALL SELECT 4, 'Most money sent to ' || who || ': ' || {_rupees("d")} || ' across ' || n || ' transaction' || CASE WHEN n = 1 THEN '' ELSE 's' END || '.' FROM (SELECT * FROM by_person ORDER BY d DESC, c NULLS LAST, who LIMIT 1)
UNION ALL SELECT 5, 'You transacted with ' || (SELECT count(*) FROM in_1997) || ' counterparties in 1997. Top: ' || string_agg(who || ' — ' || n || ' transaction' || CASE WHEN n = 1 THEN '' ELSE 's' END, '; ' ORDER BY n DESC, c NULLS LAST, plain) || '.' FROM (SELECT * FROM in_1997 ORDER BY n DESC, c NULLS LAST, plain LIMIT 5)
UNION ALL SELECT 6, 'Found ' || count(*) || ' transaction' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' in March 1998.' FROM mine WHERE transaction_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'
UNION ALL SELECT 7, 'I couldn''t determine this confidently from the available statement data.'""")
def answers_by_intent(spark, sf_dir):
    """The answers to a user's questions, one of each kind."""
    ledger = from_tables(spark, sf_dir)
    found = [(i, questions.ask(ledger, USER, q, AS_OF).text) for i, q in enumerate(QUESTIONS)]
    return spark.createDataFrame(found, "n int, answer string")
