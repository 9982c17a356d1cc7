"""Registered ledger queries and the SQL that each must agree with."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import dates, money, text
from ledgerline.operators import aggregates, bookkeeping, filters, matching, reconcile, vectors
from ledgerline.operators.filters import TransactionFilter
from ledgerline.plans.ledger import VIEWS_SQL, from_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

USER = 3
AS_OF = datetime.date(2001, 8, 1)


def query(name: str, sql: str | None = None, views: bool = True) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (VIEWS_SQL if views else "") + sql
        return f

    return register


def strings(values: list) -> str:
    """SQL rows of one string column, null included."""
    return ", ".join("(NULL)" if v is None else "('" + v.replace("'", "''") + "')" for v in values)


def column(spark: SparkSession, values: list) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "v string")


# --- filters and listings -----------------------------------------------------------------------------------------


@query("ledger_filter_search", f"""SELECT id, statement_id, transaction_date, debit_amount, payment_method, bank_name FROM owned
WHERE user_id = {USER} AND payment_method = 'UPI' AND transaction_type = 'DEBIT' AND transaction_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
ORDER BY transaction_date DESC NULLS LAST, id DESC LIMIT 50""")
def ledger_filter_search(spark, sf_dir):
    ledger = from_tables(spark, sf_dir)
    wanted = TransactionFilter(date_from=datetime.date(1996, 1, 1), date_to=datetime.date(1998, 12, 31), payment_method="upi", direction="debit")
    return filters.page(filters.apply(ledger.owned(USER), wanted)).select("id", "statement_id", "transaction_date", "debit_amount", "payment_method", "bank_name")


@query("month_range_filter", f"""SELECT id, transaction_date FROM owned WHERE user_id = {USER} AND counterparty_id IN (1, 2, 3, 5, 8)
AND (transaction_date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' OR transaction_date BETWEEN DATE '1998-01-01' AND DATE '1999-02-28')""")
def month_range_filter(spark, sf_dir):
    spans = [(datetime.date(1996, 1, 1), datetime.date(1996, 3, 31)), (datetime.date(1998, 1, 1), datetime.date(1999, 2, 28))]
    return filters.apply(from_tables(spark, sf_dir).owned(USER), TransactionFilter(person_ids=[1, 2, 3, 5, 8], month_ranges=spans)).select("id", "transaction_date")


@query("free_text_search", f"""SELECT id, counterparty_id, description FROM owned WHERE user_id = {USER} AND (
counterparty_id IN (SELECT id FROM person WHERE lower(canonical_name) LIKE '%0007%' OR lower(code) LIKE '%0007%')
OR counterparty_id IN (SELECT person_id FROM identifier WHERE lower(value) LIKE '%0007%')
OR lower(counterparty_name) LIKE '%0007%' OR lower(normalized_counterparty_name) LIKE '%0007%' OR lower(normalized_upi_id) LIKE '%0007%' OR lower(reference_number) LIKE '%0007%' OR lower(description) LIKE '%0007%')""")
def free_text_search(spark, sf_dir):
    ledger = from_tables(spark, sf_dir)
    return filters.free_text(ledger, ledger.owned(USER), "0007").select("id", "counterparty_id", "description")


@query("person_filter", f"""SELECT t.id, p.code, p.canonical_name FROM owned t LEFT JOIN person p ON p.id = t.counterparty_id WHERE t.user_id = {USER} AND (p.code = 'P000042' OR p.id = 42)""")
def person_filter(spark, sf_dir):
    ledger = from_tables(spark, sf_dir)
    by_code = filters.by_person(ledger, ledger.owned(USER), "p000042").select("id", "code", "canonical_name")
    return by_code.union(filters.by_person(ledger, ledger.owned(USER), "42").select("id", "code", "canonical_name")).distinct()


@query("scope_resolution", f"SELECT id FROM statement WHERE user_id = {USER} AND (id IN (3, 28, 4) OR lower(bank_name) IN ('building', 'machinery'))")
def scope_resolution(spark, sf_dir):
    return filters.statement_scope(from_tables(spark, sf_dir), USER, [3, 28, 4], ["Building", "MACHINERY"])


@query("statement_listing", f"SELECT id, bank_name, status FROM statement WHERE user_id = {USER} AND status = 'COMPLETED' ORDER BY id DESC LIMIT 20")
def statement_listing(spark, sf_dir):
    return bookkeeping.statements(from_tables(spark, sf_dir), USER, "COMPLETED").select("id", "bank_name", "status")


@query("owned_people", f"SELECT id, code FROM person p WHERE EXISTS (SELECT 1 FROM owned o WHERE o.counterparty_id = p.id AND o.user_id = {USER})")
def owned_people(spark, sf_dir):
    return filters.owned_people(from_tables(spark, sf_dir), USER).select("id", "code")


@query("people_search", f"""SELECT id, code FROM person p WHERE EXISTS (SELECT 1 FROM owned o WHERE o.counterparty_id = p.id AND o.user_id = {USER})
AND (lower(canonical_name) LIKE '%1%' AND lower(canonical_name) LIKE '%01%' OR lower(code) LIKE '%01%' OR id IN (SELECT person_id FROM identifier WHERE lower(value) LIKE '%01%'))""")
def people_search(spark, sf_dir):
    return filters.search_people(from_tables(spark, sf_dir), USER, "01").select("id", "code")


@query("method_widening", f"""SELECT id, payment_method FROM owned WHERE user_id = {USER} AND payment_method IN ('IMPS', 'NEFT', 'RTGS', 'BANK_TRANSFER')
AND (payment_method = 'IMPS') = (SELECT max(payment_method = 'IMPS') FROM owned WHERE user_id = {USER} AND payment_method IN ('IMPS', 'NEFT', 'RTGS', 'BANK_TRANSFER'))""")
def method_widening(spark, sf_dir):
    return filters.widened(from_tables(spark, sf_dir).owned(USER), "IMPS").select("id", "payment_method")


# --- aggregates ---------------------------------------------------------------------------------------------------


@query("aggregate_totals", f"""SELECT count(*) AS n, CAST(coalesce(sum(debit_amount), 0) AS DECIMAL(24,2)) AS total_debit, CAST(coalesce(sum(credit_amount), 0) AS DECIMAL(24,2)) AS total_credit,
min(transaction_date) AS first_date, max(transaction_date) AS last_date, max(debit_amount) AS largest_debit FROM owned WHERE user_id = {USER}""")
def aggregate_totals(spark, sf_dir):
    return aggregates.totals(from_tables(spark, sf_dir).owned(USER))


_RANKING = f"""SELECT * FROM (
SELECT t.counterparty_id, p.code, p.canonical_name AS name, count(*) AS n, CAST(coalesce(sum(debit_amount), 0) AS DECIMAL(24,2)) AS total_debit, CAST(coalesce(sum(credit_amount), 0) AS DECIMAL(24,2)) AS total_credit
FROM owned t LEFT JOIN person p ON p.id = t.counterparty_id WHERE user_id = {USER} AND t.counterparty_id IS NOT NULL GROUP BY 1, 2, 3
UNION ALL SELECT NULL, NULL, normalized_counterparty_name, count(*), CAST(coalesce(sum(debit_amount), 0) AS DECIMAL(24,2)), CAST(coalesce(sum(credit_amount), 0) AS DECIMAL(24,2))
FROM owned WHERE user_id = {USER} AND counterparty_id IS NULL GROUP BY normalized_counterparty_name) ORDER BY %s DESC, counterparty_id ASC NULLS LAST, name LIMIT 10"""


def _ranking(name: str, key: str, rank_by: str) -> None:
    @query(name, _RANKING % key)
    def ranked(spark, sf_dir):
        ledger = from_tables(spark, sf_dir)
        return aggregates.counterparties(ledger, ledger.owned(USER), rank_by=rank_by)


_ranking("top_counterparties_amount", "total_debit", "debit")
_ranking("top_counterparties_received", "total_credit", "credit")
_ranking("top_counterparties_count", "n", "count")


@query("closing_balance", f"SELECT balance AS closing_balance, transaction_date AS balance_date FROM owned WHERE user_id = {USER} ORDER BY transaction_date DESC NULLS LAST, id DESC LIMIT 1")
def closing_balance(spark, sf_dir):
    return aggregates.closing_balance(from_tables(spark, sf_dir).owned(USER))


@query("dashboard_totals", f"""SELECT count(*) AS transactions, CAST(coalesce(sum(debit_amount), 0) AS DECIMAL(24,2)) AS total_debit, CAST(coalesce(sum(credit_amount), 0) AS DECIMAL(24,2)) AS total_credit,
count(*) FILTER (matching_status = 'MATCH') AS match, count(*) FILTER (matching_status = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (matching_status = 'UNKNOWN') AS unknown,
count(DISTINCT counterparty_id) AS people, count(*) FILTER (matching_status IN ('AMBIGUOUS', 'UNKNOWN')) AS pending_reviews,
(SELECT count(*) FROM statement WHERE user_id = {USER}) AS statements FROM owned WHERE user_id = {USER}""")
def dashboard_totals(spark, sf_dir):
    return aggregates.dashboard_totals(from_tables(spark, sf_dir), USER)


@query("dashboard_monthly", f"""SELECT coalesce(strftime(transaction_date, '%Y-%m'), 'unknown') AS month, CAST(coalesce(sum(debit_amount), 0) AS DECIMAL(24,2)) AS debit,
CAST(coalesce(sum(credit_amount), 0) AS DECIMAL(24,2)) AS credit, count(*) AS n FROM owned WHERE user_id = {USER} GROUP BY 1""")
def dashboard_monthly(spark, sf_dir):
    return aggregates.monthly(from_tables(spark, sf_dir).owned(USER))


@query("dashboard_methods", f"SELECT coalesce(payment_method, 'OTHER') AS method, count(*) AS n FROM owned WHERE user_id = {USER} GROUP BY 1")
def dashboard_methods(spark, sf_dir):
    return aggregates.by_method(from_tables(spark, sf_dir).owned(USER))


@query("dashboard_activity_30d", f"""SELECT CAST(d AS DATE) AS day, count(o.id) AS n FROM generate_series(TIMESTAMP '2001-07-03', TIMESTAMP '2001-08-01', INTERVAL 1 DAY) g(d)
LEFT JOIN (SELECT * FROM owned WHERE user_id = {USER}) o ON o.transaction_date = CAST(d AS DATE) GROUP BY 1""")
def dashboard_activity_30d(spark, sf_dir):
    return aggregates.daily_activity(from_tables(spark, sf_dir).owned(USER), AS_OF)


@query("bank_summary", f"""SELECT bank_name, count(*) AS statements, CAST(coalesce(sum(n), 0) AS BIGINT) AS transactions FROM statement s
LEFT JOIN (SELECT statement_id, count(*) AS n FROM txn GROUP BY 1) c ON c.statement_id = s.id WHERE user_id = {USER} GROUP BY 1""")
def bank_summary(spark, sf_dir):
    return aggregates.banks(from_tables(spark, sf_dir), USER)


@query("person_card", """SELECT p.id, p.code, p.canonical_name, string_agg(value, ',' ORDER BY value) FILTER (id_type = 'UPI') AS upi_ids, string_agg(value, ',' ORDER BY value) FILTER (id_type = 'ACCOUNT') AS accounts,
(SELECT count(*) FROM txn WHERE counterparty_id = p.id) AS n FROM person p LEFT JOIN identifier i ON i.person_id = p.id GROUP BY 1, 2, 3""")
def person_card(spark, sf_dir):
    ledger = from_tables(spark, sf_dir)
    return aggregates.person_card(ledger, ledger.transactions)


@query("person_methods", "SELECT counterparty_id, string_agg(DISTINCT payment_method, ',' ORDER BY payment_method) AS methods FROM txn WHERE counterparty_id IS NOT NULL AND payment_method IS NOT NULL GROUP BY 1")
def person_methods(spark, sf_dir):
    return aggregates.person_methods(from_tables(spark, sf_dir).transactions)


@query("person_latest_transactions", """SELECT counterparty_id, id, transaction_date FROM (SELECT *, row_number() OVER (PARTITION BY counterparty_id ORDER BY transaction_date DESC NULLS LAST, id DESC) AS r
FROM txn WHERE counterparty_id IS NOT NULL) WHERE r <= 5""")
def person_latest_transactions(spark, sf_dir):
    return bookkeeping.latest_per_person(from_tables(spark, sf_dir).transactions, 5).select("counterparty_id", "id", "transaction_date")


@query("month_ranges", f"""SELECT CAST(y AS INTEGER) AS year, make_date(y, 2, 1) AS first_day, last_day(make_date(y, 2, 1)) AS last_day FROM (SELECT DISTINCT year(transaction_date) AS y FROM owned WHERE user_id = {USER} AND month(transaction_date) = 2)""")
def month_ranges(spark, sf_dir):
    return aggregates.month_ranges(from_tables(spark, sf_dir).owned(USER), 2)


@query("dedup_by_hash", "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1", views=False)
def dedup_by_hash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query("review_overlay", """SELECT t.id, CASE WHEN o.o_orderkey IS NULL THEN t.matching_status WHEN o.o_orderkey % 3 = 0 THEN 'UNKNOWN' ELSE 'MATCH' END AS status,
CASE WHEN o.o_orderkey IS NULL THEN t.counterparty_id WHEN o.o_orderkey % 3 <> 0 THEN o.o_orderkey % 90 END AS person_id, CASE WHEN o.o_orderkey IS NULL THEN 'LOCAL_MATCHING' ELSE 'MANUAL' END AS method
FROM txn t LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0) o ON o.o_orderkey = t.id""")
def review_overlay(spark, sf_dir):
    rows = from_tables(spark, sf_dir).transactions
    decisions = rows.select("id", F.col("matching_status").alias("status"), F.col("counterparty_id").alias("person_id"), F.lit(0.9).alias("confidence"))
    reviews = rows.filter("id % 11 = 0").select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 90).alias("confirmed_person_id"))
    return matching.overlay(decisions, reviews).select("id", "status", "person_id", "method")


@query("ambiguous_review_list", """SELECT t.id, t.matching_status AS status, p.code AS suggested_code FROM txn t LEFT JOIN person p ON p.id = t.id % 100 WHERE t.matching_status <> 'MATCH'""")
def ambiguous_review_list(spark, sf_dir):
    ledger = from_tables(spark, sf_dir)
    decisions = ledger.transactions.select("id", F.col("matching_status").alias("status"), (F.col("id") % 100).alias("suggested_person_id"), F.lit(0.3).alias("confidence"))
    return matching.review_list(ledger.transactions.select("id"), decisions, ledger.people).select("id", "status", "suggested_code")


# --- scalar functions ---------------------------------------------------------------------------------------------

AMOUNTS = ["1,234.50", "(500.00)", "₹ 2,500.00 Dr", "Rs. 99.995", "INR 10 CR", "1000.00-", "-42", "+7.005", "2.345", "1.005", "--", "", None, "N/A", "abc", "12.3.4", "1e3", "  15 debit. "]


@query("parse_amount", f"""WITH t AS (SELECT v, trim(v) AS s FROM (VALUES {strings(AMOUNTS)}) x(v)),
u AS (SELECT v, s, s LIKE '(%)' AS enclosed, replace(replace(regexp_replace(regexp_replace(trim(CASE WHEN s LIKE '(%)' THEN substr(s, 2, length(s) - 2) ELSE s END), '(?i)\\s*\\b(dr|cr|debit|credit)\\b\\.?\\s*$', ''), '(?i)(₹|rs\\.?|inr)\\s*', '', 'g'), ',', ''), ' ', '') AS b FROM t),
w AS (SELECT *, regexp_replace(regexp_replace(b, '-$', ''), '^\\+?-?', '') AS d FROM u)
SELECT v, CAST(CASE WHEN s IN ('', '-', '--', 'N/A', 'n/a') THEN NULL WHEN enclosed OR b LIKE '%-' OR b LIKE '-%' OR b LIKE '+-%' THEN -1 ELSE 1 END * round_even(TRY_CAST(TRY_CAST(d AS DOUBLE) AS DECIMAL(30,10)), 2) AS DECIMAL(14,2)) AS amount FROM w""".replace("round_even(TRY_CAST(TRY_CAST(d AS DOUBLE) AS DECIMAL(30,10)), 2)", "round_even(CASE WHEN d LIKE '%e%' THEN TRY_CAST(TRY_CAST(d AS DOUBLE) AS DECIMAL(28,6)) ELSE TRY_CAST(d AS DECIMAL(28,6)) END, 2)"), views=False)
def parse_amount(spark, sf_dir):
    return column(spark, AMOUNTS).select("v", money.parse_amount(F.col("v")).alias("amount"))


@query("parse_amount_side", f"""SELECT v, CASE lower(substr(nullif(regexp_extract(trim(v), '(?i)\\s*\\b(dr|cr|debit|credit)\\b\\.?\\s*$', 1), ''), 1, 1)) WHEN 'd' THEN 'DEBIT' WHEN 'c' THEN 'CREDIT' END AS side FROM (VALUES {strings(AMOUNTS)}) x(v)""", views=False)
def parse_amount_side(spark, sf_dir):
    return column(spark, AMOUNTS).select("v", money.amount_side(F.col("v")).alias("side"))


DATES = {
    "01-05-2024": "2024-05-01", "1/5/2024": "2024-05-01", "03-Feb-2024": "2024-02-03", "3 Feb 2024": "2024-02-03", "3 February 2024": "2024-02-03", "2024-05-09": "2024-05-09",
    "2024/5/9": "2024-05-09", "09-05-24": "2024-05-09", "09/05/70": "1970-05-09", "9.5.2024": "2024-05-09", "Feb 3, 2024": "2024-02-03", "February 3, 2024": "2024-02-03", "05/31/2024": "2024-05-31",
    "31-02-2024": None, "45000": "2023-03-15", "45,000": "2023-03-15", "19999": None, "2024-05-01T10:11:12": "2024-05-01", "hello": None, "": None,
}


@query("parse_date_formats", "SELECT v, CAST(d AS DATE) AS parsed FROM (VALUES " + ", ".join(f"('{k}', {repr(v) if v else 'NULL'})" for k, v in DATES.items()) + ") x(v, d)", views=False)
def parse_date_formats(spark, sf_dir):
    return column(spark, list(DATES)).select("v", dates.parse_date(F.col("v")).alias("parsed"))


@query("excel_serial", "SELECT o_orderkey AS id, CASE WHEN 19000 + o_orderkey BETWEEN 20000 AND 80000 THEN DATE '1899-12-30' + CAST(19000 + o_orderkey AS INTEGER) END AS parsed FROM orders", views=False)
def excel_serial(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("id"), dates.parse_date((F.col("o_orderkey") + 19000).cast("string")).alias("parsed"))


NARRATIONS = [
    "UPI/KALYAN/kalyan@okaxis/12345", "NEFT-KALYAN KUMAR-XXXX1234", "PAYTM-KALYAN-XXXX1234", "GPAY-KALYAN", "IMPS transfer", "RTGS-KALYAN", "ATM WDL xyz", "random narration", "Fund Transfer to X",
    "POS 4411 SHOP", "CASH deposit", "Phone Pe ravi", "upi://pay?pa=ravi@ybl&pn=x", "PAYMENT TO ravi@ybl", "plain TRANSFER to A/C", "google   pay x", None, "",
]


def _method_case() -> str:
    cases = " ".join(f"WHEN regexp_matches(v, '(?i){p}') THEN '{n}'" for n, p in text.METHODS)
    return f"CASE {cases} WHEN regexp_matches(v, '{text.UPI_URL}') OR regexp_matches(v, '{text.UPI}') THEN 'UPI' WHEN regexp_matches(v, '(?i)\\bTRANSFER\\b') THEN 'BANK_TRANSFER' END"


@query("payment_method_detect", f"SELECT v, {_method_case()} AS method FROM (VALUES {strings(NARRATIONS)}) x(v)", views=False)
def payment_method_detect(spark, sf_dir):
    return column(spark, NARRATIONS).select("v", text.payment_method(F.col("v")).alias("method"))


HANDLES = [" KALYAN@OKAXIS. ", ".ravi-@ybl", "nohandle", "@x", "a@", None, "ravi.kumar@ok-axis", "--x_@__y--"]


@query("upi_normalize", f"""WITH a AS (SELECT v, ltrim(trim(lower(trim(v)), '.;,'), '.') AS s FROM (VALUES {strings(HANDLES)}) x(v)),
b AS (SELECT v, s, trim(split_part(s, '@', 1), '.-_') AS h, trim(regexp_replace(s, '^[^@]*@', ''), '.-_') AS d FROM a)
SELECT v, CASE WHEN contains(s, '@') AND h <> '' AND d <> '' THEN h || '@' || d END AS upi FROM b""", views=False)
def upi_normalize(spark, sf_dir):
    return column(spark, HANDLES).select("v", text.normalize_upi(F.col("v")).alias("upi"))


ACCOUNTS = ["987654321012", "XXXX1234", "XXXX 1234", " 12 345 ", "", None, "abc"]


@query("mask_account", f"SELECT v, CASE WHEN length(regexp_replace(v, '\\D', '', 'g')) >= 5 THEN 'XXXX' || right(regexp_replace(v, '\\D', '', 'g'), 4) ELSE trim(v) END AS masked FROM (VALUES {strings(ACCOUNTS)}) x(v)", views=False)
def mask_account(spark, sf_dir):
    return column(spark, ACCOUNTS).select("v", text.mask_account(F.col("v")).alias("masked"))


SECRETS = ["password=abc def", "PWD : x1 and api_key=zz", "Authorization: Bearer tok123 end", "nothing", None]


@query("redact_secrets", """SELECT v, regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(?i)(password\\s*[=:]\\s*)\\S+', '\\1[REDACTED]', 'g'), '(?i)(pwd\\s*[=:]\\s*)\\S+', '\\1[REDACTED]', 'g'),
'(?i)(api[_-]?key\\s*[=:]\\s*)\\S+', '\\1[REDACTED]', 'g'), '(?i)(authorization:\\s*bearer\\s+)\\S+', '\\1[REDACTED]', 'g') AS clean FROM (VALUES """ + strings(SECRETS) + ") x(v)", views=False)
def redact_secrets(spark, sf_dir):
    return column(spark, SECRETS).select("v", text.redact_secrets(F.col("v")).alias("clean"))


@query("redact_handles", f"SELECT v, CASE WHEN contains(v, '@') THEN left(split_part(v, '@', 1), 2) || '***@' || split_part(v, '@', -1) ELSE v END AS hidden FROM (VALUES {strings(HANDLES)}) x(v)", views=False)
def redact_handles(spark, sf_dir):
    return column(spark, HANDLES).select("v", text.redact_upi(F.col("v")).alias("hidden"))


@query("extract_email", f"SELECT doc_id, lower(regexp_extract(text, '{text.EMAIL}', 1)) AS email FROM documents WHERE regexp_matches(text, '{text.EMAIL}')", views=False)
def extract_email(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.lower(text.first_match(F.col("text"), text.EMAIL)).alias("email")).filter("email is not null")


@query("normalize_names", r"SELECT conv_id, turn, nullif(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s@./-]', ' ', 'g'), '\s+', ' ', 'g')), '') AS name FROM conversations", views=False)
def normalize_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.normalize_name(F.col("text")).alias("name"))


@query("search_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS BIGINT) AS n, list_aggregate(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), 'string_agg', ' ') AS tokens FROM documents", views=False)
def search_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = text.search_tokens(F.col("text"))
    return docs.select("doc_id", F.size(tokens).cast("long").alias("n"), F.nullif(F.array_join(tokens, " "), F.lit("")).alias("tokens"))


@query("format_amounts", f"SELECT id, format('{{:,.2f}}', CAST(coalesce(debit_amount, 0) AS DOUBLE)) AS shown FROM owned WHERE user_id = {USER}")
def format_amounts(spark, sf_dir):
    return from_tables(spark, sf_dir).owned(USER).select("id", money.format_amount(F.col("debit_amount")).alias("shown"))


# --- vectors ------------------------------------------------------------------------------------------------------


@query("document_content", """SELECT id, coalesce(CAST(transaction_date AS VARCHAR), 'unknown date') || ' | ' || coalesce(counterparty_name, 'Unknown counterparty') || ' | ' || transaction_type || ' | ' ||
coalesce('Rs ' || CAST(debit_amount AS VARCHAR), 'Rs ' || CAST(credit_amount AS VARCHAR), 'amount unknown') || ' | ' || coalesce(payment_method, 'OTHER') || ' | ' || coalesce(description, '') AS content FROM txn""")
def document_content(spark, sf_dir):
    return vectors.document_content(from_tables(spark, sf_dir).transactions)


_EMBEDDED = """tok AS (SELECT item_id AS id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS w FROM benchmark),
f AS (SELECT id, unnest(w) AS f FROM tok UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM tok
UNION ALL SELECT id, unnest(list_transform(range(1, len(p) - 1), lambda i: substr(p, i, 3))) FROM (SELECT id, '^' || unnest(w) || '$' AS p FROM tok)),
s AS (SELECT id, CAST(CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) % 384 AS INTEGER) AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(f), 10, 1) AS INTEGER) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM f GROUP BY 1, 2),
e AS (SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM s WHERE v <> 0)"""


@query("hash_embedding_sparse", "WITH " + _EMBEDDED + " SELECT id, bucket, round(value, 6) AS value FROM e", views=False)
def hash_embedding_sparse(spark, sf_dir):
    found = vectors.sparse_embedding(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return found.select("id", "bucket", F.round("value", 6).alias("value"))


@query("hash_embedding_search", "WITH " + _EMBEDDED + " SELECT a.id, round(sum(a.value * q.value), 6) AS score FROM e a JOIN e q ON q.bucket = a.bucket AND q.id = 5 GROUP BY 1 HAVING sum(a.value * q.value) > 0 ORDER BY round(sum(a.value * q.value), 9) DESC, a.id LIMIT 10", views=False)
def hash_embedding_search(spark, sf_dir):
    found = vectors.sparse_embedding(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return vectors.sparse_search(found, found.filter("id = 5")).select("id", F.round("score", 6).alias("score"))


_COSINE = """SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (CASE WHEN i % 2 = 0 THEN 0.5 ELSE -0.25 END)))
/ (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(32 * 0.25 + 32 * 0.0625)) AS score FROM embeddings WHERE $FILTER) WHERE score > 0 ORDER BY round(score, 9) DESC, vec_id LIMIT 10"""
QUERY_VECTOR = [0.5 if i % 2 == 0 else -0.25 for i in range(1, 65)]


@query("cosine_topk", _COSINE.replace("$FILTER", "TRUE"), views=False)
def cosine_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.top_k(rows, QUERY_VECTOR, id_column="vec_id", vector_column="embedding").select("vec_id", F.round("score", 6).alias("score"))


@query("cosine_filtered_topk", _COSINE.replace("$FILTER", "label % 2 = 1"), views=False)
def cosine_filtered_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.top_k(rows, QUERY_VECTOR, id_column="vec_id", vector_column="embedding", predicate=F.col("label") % 2 == 1).select("vec_id", F.round("score", 6).alias("score"))


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 100 ELSE label END AS label FROM embeddings", views=False)
def vector_upsert(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    return vectors.upsert(rows, rows.filter("vec_id % 3 = 0").withColumn("label", F.lit(100)), ["vec_id"])


# --- reconciliation -----------------------------------------------------------------------------------------------


@query("reconcile_running_balance", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no, CAST(l_quantity AS DECIMAL(14,2)) AS amount, l_suppkey FROM lineitem),
b AS (SELECT l_orderkey AS file_id, row_no, amount, CAST(1000 + sum(CASE WHEN row_no % 2 = 0 THEN amount ELSE -amount END) OVER (PARTITION BY l_orderkey ORDER BY row_no) AS DECIMAL(14,2)) AS balance FROM l)
SELECT file_id, CAST(row_no AS INTEGER) AS row_no, CASE WHEN row_no % 2 = 1 THEN amount END AS debit, CASE WHEN row_no % 2 = 0 THEN amount END AS credit FROM b""", views=False)
def reconcile_running_balance(spark, sf_dir):
    """Every third row on the wrong side, every fifth amount lost: the balance gives both back."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    amount = F.col("l_quantity").cast("decimal(14,2)")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("file_id"), F.row_number().over(w).alias("row_no"), amount.alias("amount"))
    out_ = F.col("row_no") % 2 == 1
    running = F.sum(F.when(out_, -F.col("amount")).otherwise(F.col("amount"))).over(Window.partitionBy("file_id").orderBy("row_no"))
    rows = rows.withColumn("balance", (F.lit(1000) + running).cast("decimal(14,2)"))
    wrong, lost = F.col("row_no") % 3 == 0, F.col("row_no") % 5 == 0
    shown_debit = (out_ & ~wrong) | (~out_ & wrong)
    dirty = rows.select(
        "file_id", "row_no", F.lit("payment").alias("description"), F.when(~lost & shown_debit, F.col("amount")).alias("debit"),
        F.when(~lost & ~shown_debit, F.col("amount")).alias("credit"), "balance", F.lit(1000).cast("decimal(14,2)").alias("opening_balance"),
    )
    return reconcile.reconcile(dirty).select("file_id", "row_no", "debit", "credit")
