"""Registered queries of a table of questions: each customer of the test tables asks one about its user's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans import question_table, questions
from ledgerline.plans.ledger import from_tables
from ledgerline.plans.queries import AS_OF, query
from ledgerline.plans.questions import AMBIGUOUS, INSUFFICIENT, MONTHS

#: Ways of asking: ``{m}`` a month, ``{y}`` a year, ``{s}`` a supplier's number, ``{d}`` a digit.
WAYS = [
    "How many transactions in {m} {y}?", "How much did I send via NEFT in {y}?", "How much did I receive in {m}?", "What was my largest transaction in {y}?", 'How much did I send "supplier#{s}"?',
    "What is my total credit and debit in {y}?", "What was my closing balance in {m} {y}?", "Who did I pay the most in {y}?", "Who did I transact with in {m} {y}?", "Show transactions last month",
    "How many IMPS transactions in {m} {y}?", "How many transactions this week?", 'How much did I send "supplier"?', 'How many transactions with "ok1{d}" in {y}?', 'How many transactions with "payee" via paytm?', "Show all UPI transactions",
]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    ways = F.array(*map(F.lit, WAYS))
    months = F.array(*[F.lit(m.title()) for m in MONTHS])
    text = F.try_element_at(ways, (key % len(WAYS) + 1).cast("int"))
    parts = {"{m}": F.try_element_at(months, (key % 12 + 1).cast("int")), "{y}": (key % 7 + 1995).cast("string"), "{s}": F.lpad((key % 100 + 1).cast("string"), 9, "0"), "{d}": (key % 10).cast("string")}
    for mark, value in parts.items():
        text = F.replace(text, F.lit(mark), value)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("question_id"), F.col("c_nationkey").cast("long").alias("user_id"), text.alias("question"))


def _rupees(sql: str) -> str:
    return f"'Rs ' || format('{{:,.2f}}', CAST(coalesce({sql}, 0) AS DOUBLE))"


_S = "CASE WHEN n = 1 THEN '' ELSE 's' END"
_MONTH = "[" + ", ".join(f"'{m.title()}'" for m in MONTHS) + "]"

#: Nothing is parsed here: what each way of asking means is written out by its number ``w``.
_SQL = f""", q AS (SELECT c_custkey AS qid, CAST(c_nationkey AS BIGINT) AS uid, c_custkey % {len(WAYS)} AS w, c_custkey % 12 + 1 AS m, c_custkey % 7 + 1995 AS y, c_custkey % 100 + 1 AS s, CAST(c_custkey % 10 AS VARCHAR) AS d FROM customer),
p AS (SELECT *, {_MONTH}[m] || ' ' || y AS my, w IN (0, 6, 8, 10) AS dated, CASE w WHEN 4 THEN 'supplier#' || lpad(CAST(s AS VARCHAR), 9, '0') WHEN 12 THEN 'supplier' WHEN 13 THEN 'ok1' || d WHEN 14 THEN 'payee' END AS txt,
  CASE WHEN w IN (1, 3, 4, 7, 12) THEN 'DEBIT' WHEN w = 2 THEN 'CREDIT' END AS dir, CASE w WHEN 1 THEN 'NEFT' WHEN 10 THEN 'IMPS' WHEN 14 THEN 'PAYTM' WHEN 15 THEN 'UPI' END AS method FROM q),
mine AS (SELECT DISTINCT user_id, counterparty_id FROM owned WHERE counterparty_id IS NOT NULL),
meant AS (SELECT DISTINCT qid, person.id AS pid, code, canonical_name FROM p JOIN mine ON user_id = uid JOIN person ON person.id = counterparty_id LEFT JOIN identifier i ON i.person_id = person.id
  WHERE txt IS NOT NULL AND (normalized_name = txt OR (w <> 4 AND lower(value) LIKE '%' || txt || '%'))),
who AS (SELECT qid, count(*) AS people, list(canonical_name || ' (' || code || ')' ORDER BY pid)[1:21] AS labels FROM meant GROUP BY qid),
a AS (SELECT p.*, coalesce(people, 0) AS people, labels, CASE WHEN people > 0 THEN labels[1] ELSE txt END AS label FROM p LEFT JOIN who USING (qid)),
met AS (SELECT a.qid, coalesce(payment_method = method, method IS NULL) AS exact, o.* FROM a JOIN owned o ON o.user_id = a.uid LEFT JOIN meant ON meant.qid = a.qid AND meant.pid = o.counterparty_id
  WHERE people <= 1 AND (txt IS NULL OR (CASE WHEN people = 1 THEN meant.pid IS NOT NULL WHEN w = 4 THEN normalized_upi_id LIKE '%supplier%' OR normalized_upi_id LIKE '%' || right(txt, 9) || '%'
    ELSE normalized_counterparty_name LIKE '%' || txt || '%' OR normalized_upi_id LIKE '%' || txt || '%' END))
  AND (dir IS NULL OR transaction_type = dir)
  AND (method IS NULL OR payment_method = method OR (method IN ('NEFT', 'IMPS') AND payment_method IN ('NEFT', 'IMPS', 'RTGS', 'BANK_TRANSFER')) OR (method = 'UPI' AND payment_method IN ('UPI', 'PAYTM', 'GOOGLE_PAY', 'PHONEPE')))
  AND (NOT (dated OR w = 2) OR month(transaction_date) = m) AND (NOT (dated OR w IN (1, 3, 5, 7, 13)) OR year(transaction_date) = y)
  AND (w <> 9 OR transaction_date BETWEEN DATE '2001-07-01' AND DATE '2001-07-31') AND (w <> 11 OR transaction_date BETWEEN DATE '2001-07-26' AND DATE '2001-08-01')),
hit AS (SELECT * FROM met WHERE exact OR qid NOT IN (SELECT qid FROM met WHERE exact)),
t AS (SELECT qid, count(*) AS n, sum(debit_amount) AS sent, sum(credit_amount) AS got, max(debit_amount) AS large, arg_max(balance, (transaction_date, id)) AS closing, max(transaction_date) AS last_day, bool_and(NOT exact) AS wide,
  count(counterparty_id) AS known, count(DISTINCT normalized_counterparty_name) AS names, count(DISTINCT coalesce(CAST(counterparty_id AS VARCHAR), '=' || normalized_counterparty_name)) AS parties FROM hit GROUP BY qid),
big AS (SELECT hit.qid, max(transaction_date) AS day FROM hit JOIN t ON t.qid = hit.qid AND hit.debit_amount = t.large GROUP BY hit.qid),
party AS (SELECT qid, counterparty_id AS c, CASE WHEN counterparty_id IS NULL THEN normalized_counterparty_name END AS name, count(*) AS n, coalesce(sum(debit_amount), 0) AS sent FROM hit WHERE qid % {len(WAYS)} IN (7, 8) GROUP BY ALL),
ranked AS (SELECT party.*, coalesce(canonical_name || ' (' || code || ')', name) AS label, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN qid % {len(WAYS)} = 7 THEN sent ELSE party.n END DESC, c NULLS LAST, name) AS r FROM party LEFT JOIN person ON person.id = c),
top AS (SELECT qid, string_agg(label || ' — ' || n || ' transaction' || {_S}, '; ' ORDER BY r) AS listed, max(label) FILTER (r = 1) AS lead, max(sent) FILTER (r = 1) AS most, max(n) FILTER (r = 1) AS times FROM ranked WHERE r <= 5 GROUP BY qid),
f AS (SELECT a.*, coalesce(t.n, 0) AS n, sent, got, large, closing, last_day, coalesce(wide, false) AS wide, coalesce(txt IS NOT NULL AND people = 0 AND known = 0 AND names > 1, false) AS unsure, parties, day, listed, lead, most, times
  FROM a LEFT JOIN t USING (qid) LEFT JOIN big USING (qid) LEFT JOIN top USING (qid))
SELECT qid AS question_id, uid AS user_id, CAST(n AS BIGINT) AS n, CASE WHEN people > 1 OR unsure THEN 'ambiguous' WHEN people = 1 THEN 'resolved' ELSE 'none' END AS resolution,
  CASE WHEN people > 1 THEN 'MULTIPLE_PERSON_MATCHES' WHEN n = 0 THEN '' ELSE concat_ws(',', CASE WHEN wide THEN 'METHOD_FILTER_WIDENED' END, CASE WHEN unsure THEN 'MULTIPLE_POSSIBLE_MATCHES' WHEN txt IS NOT NULL AND people = 0 THEN 'MATCHED_BY_DESCRIPTION_TEXT' END) END AS notes,
  CASE WHEN people > 1 THEN '{AMBIGUOUS} Candidates: ' || array_to_string(labels, ', ') || '.' WHEN unsure THEN '{AMBIGUOUS} Candidates: ' || label || '.' WHEN n = 0 THEN '{INSUFFICIENT.replace("'", "''")}'
    WHEN w IN (1, 4, 12) THEN coalesce(label, 'counterparties') || ' — Total sent: ' || {_rupees("sent")} || '. (Verified from ' || n || ' transaction' || {_S} || '.)'
    WHEN w = 2 THEN 'counterparties — Total received: ' || {_rupees("got")} || '. (Verified from ' || n || ' transaction' || {_S} || '.)'
    WHEN w = 3 THEN 'Largest debit on ' || day || ': ' || {_rupees("large")} || '.'
    WHEN w = 5 THEN 'Total debits: ' || {_rupees("sent")} || ' · Total credits: ' || {_rupees("got")} || ' (verified from ' || n || ' transaction' || {_S} || ' in ' || y || ').'
    WHEN w = 6 THEN 'Closing balance on ' || last_day || ': ' || {_rupees("closing")} || '.'
    WHEN w = 7 THEN 'Most money sent to ' || lead || ': ' || {_rupees("most")} || ' across ' || times || ' transaction' || CASE WHEN times = 1 THEN '' ELSE 's' END || '.'
    WHEN w = 8 THEN 'You transacted with ' || parties || CASE WHEN parties = 1 THEN ' counterparty in ' ELSE ' counterparties in ' END || my || '. Top: ' || listed || '.'
    WHEN w IN (9, 15) THEN 'Found ' || n || ' transaction' || {_S} || CASE WHEN w = 9 THEN ' in July 2001.' ELSE '.' END
    ELSE n || CASE w WHEN 10 THEN ' Imps' WHEN 14 THEN ' Paytm' ELSE '' END || ' transaction' || {_S} || coalesce(' with ' || label, '') || '.' END AS answer FROM f"""


@query("question_table_answers", _SQL)
def question_table_answers(spark, sf_dir):
    """A question of each customer, of sixteen kinds, answered together."""
    found = question_table.answer(from_tables(spark, sf_dir), asked(spark, sf_dir), AS_OF).answers
    return found.select("question_id", "user_id", "n", "resolution", F.array_join("notes", ",").alias("notes"), "answer")


@query("question_profiles", f"""WITH q AS (SELECT c_custkey AS k, c_custkey % {len(WAYS)} AS w FROM customer)
SELECT k AS question_id, ['count', 'total_sent', 'total_received', 'largest', 'total_sent', 'overall_totals', 'balance', 'top_counterparty', 'counterparties', 'list', 'count', 'count', 'total_sent', 'count', 'count', 'list'][w + 1] AS intent,
  CASE WHEN w IN (1, 3, 4, 7, 12) THEN 'DEBIT' WHEN w = 2 THEN 'CREDIT' END AS direction, CASE w WHEN 1 THEN 'NEFT' WHEN 10 THEN 'IMPS' WHEN 14 THEN 'PAYTM' WHEN 15 THEN 'UPI' END AS payment_method,
  CAST(CASE WHEN w IN (0, 2, 6, 8, 10) THEN k % 12 + 1 WHEN w = 9 THEN 7 END AS INTEGER) AS month, CAST(CASE WHEN w IN (0, 1, 3, 5, 6, 7, 8, 10, 13) THEN k % 7 + 1995 WHEN w = 9 THEN 2001 END AS INTEGER) AS year,
  CASE WHEN w = 11 THEN DATE '2001-07-26' END AS date_from, CASE WHEN w = 11 THEN DATE '2001-08-01' END AS date_to,
  CASE w WHEN 4 THEN 'supplier#' || lpad(CAST(k % 100 + 1 AS VARCHAR), 9, '0') WHEN 12 THEN 'supplier' WHEN 13 THEN 'ok1' || k % 10 WHEN 14 THEN 'payee' END AS person_text FROM q""", views=False)
def question_profiles(spark, sf_dir):
    """What each of these questions asks for."""
    return questions.profiles(asked(spark, sf_dir), AS_OF).select("question_id", "intent", "direction", "payment_method", "month", "year", "date_from", "date_to", "person_text")
