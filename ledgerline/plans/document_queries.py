"""Registered queries over files, narrations, matching and questions, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import narration
from ledgerline.operators import layout, matching, reconcile
from ledgerline.plans import questions
from ledgerline.plans.ledger import from_tables
from ledgerline.plans.queries import AS_OF, USER, column, query, strings
from ledgerline.plans.session import spread
from ledgerline.sources import files
from ledgerline.streaming import ingest

HEADERED = """Date,Narration,Ref No.,Withdrawal (INR),Deposit (INR),Closing Balance
01-09-2025,UPI/KALYAN/kalyan@okaxis/12345,12345,5000.00,,15000.00
05-09-2025,"KALYAN KUMAR / UPI, ""x"" ",UPIREF001,3000.00,,12000.00
10-09-2025,NEFT-KALYAN KUMAR-XXXX1234,NEFT0905,1500.00,,10500.00
"""
SWAPPED = "01-09-2025;first thing;;5000.00;15000.00\n05-09-2025;second;30000.00;;45000.00\n06-09-2025;third;;2000.00;43000.00\n"
LOST = "Date,Narration,Withdrawal (INR),Deposit (INR),Closing Balance\n01-09-2025,a,5000.00,0.00,15000.00\n02-09-2025,b,,,45000.00\n"
NO_LAYOUT = "not,a,statement\n"
FILES = [HEADERED, SWAPPED, LOST, NO_LAYOUT]


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t.encode()) for i, t in enumerate(FILES)], "file_id long, content binary")


def _values(rows: list[tuple], names: str) -> str:
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") x({names})"


@query("csv_cells", "SELECT CAST(f AS BIGINT) AS file_id, CAST(r AS INTEGER) AS row_no, CAST(n AS INTEGER) AS n_cells, second FROM " + _values([(0, 0, 6, "Narration"), (0, 1, 6, "UPI/KALYAN/kalyan@okaxis/12345"), (0, 2, 6, 'KALYAN KUMAR / UPI, "x" '), (0, 3, 6, "NEFT-KALYAN KUMAR-XXXX1234"), (1, 0, 5, "first thing"), (1, 1, 5, "second"), (1, 2, 5, "third"), (2, 0, 5, "Narration"), (2, 1, 5, "a"), (2, 2, 5, "b"), (3, 0, 3, "a")], "f, r, n, second"), views=False)
def csv_cells(spark, sf_dir):
    return files.csv_cells(_files(spark)).select("file_id", "row_no", F.size("cells").alias("n_cells"), F.get("cells", F.lit(1)).alias("second"))


@query("column_layouts", "SELECT CAST(f AS BIGINT) AS file_id, CAST(d AS INTEGER) AS date_idx, CAST(t AS INTEGER) AS description_idx, CAST(r AS INTEGER) AS reference_idx, CAST(db AS INTEGER) AS debit_idx, CAST(cr AS INTEGER) AS credit_idx, CAST(b AS INTEGER) AS balance_idx, source FROM " + _values([(0, 0, 1, 2, 3, 4, 5, "header"), (1, 0, 1, None, 2, 3, 4, "positional"), (2, 0, 1, None, 2, 3, 4, "header")], "f, d, t, r, db, cr, b, source"), views=False)
def column_layouts(spark, sf_dir):
    found = layout.layouts(files.csv_cells(_files(spark)))
    return found.select("file_id", "date_idx", "description_idx", "reference_idx", "debit_idx", "credit_idx", "balance_idx", "source")


_LEDGER_ROWS = [
    (0, "2025-09-01", "5000.00", None, "15000.00"), (0, "2025-09-05", "3000.00", None, "12000.00"), (0, "2025-09-10", "1500.00", None, "10500.00"), (1, "2025-09-01", "5000.00", None, "15000.00"),
    (1, "2025-09-05", None, "30000.00", "45000.00"), (1, "2025-09-06", "2000.00", None, "43000.00"), (2, "2025-09-01", "5000.00", None, "15000.00"), (2, "2025-09-02", None, "30000.00", "45000.00"),
]


@query("statement_ingest", "SELECT CAST(f AS BIGINT) AS file_id, CAST(d AS DATE) AS transaction_date, CAST(db AS DECIMAL(14,2)) AS debit, CAST(cr AS DECIMAL(14,2)) AS credit, CAST(b AS DECIMAL(14,2)) AS balance FROM " + _values(_LEDGER_ROWS, "f, d, db, cr, b"), views=False)
def statement_ingest(spark, sf_dir):
    return files.ledger_rows(files.csv_cells(_files(spark))).select("file_id", "transaction_date", "debit", "credit", "balance")


@query("reconcile_warnings", "SELECT CAST(f AS BIGINT) AS file_id, w AS said FROM " + _values([(0, None), (1, "Running balance corrected the direction of 3 transaction(s)."), (2, "Recovered 1 missing amount(s) from the running balance.;Ignored 1 zero-amount placeholder cell(s).")], "f, w"), views=False)
def reconcile_warnings(spark, sf_dir):
    said = reconcile.warnings(files.ledger_rows(files.csv_cells(_files(spark))))
    return said.select("file_id", F.nullif(F.array_join("warnings", ";"), F.lit("")).alias("said"))


# --- files of real size: one for each customer --------------------------------------------------------------------


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement file of each customer's orders with a running balance: with a header, with swapped columns and quoted cells over two
    lines, or without a header, by customer; some amounts are missing, and some files are no statements."""
    rows = spread(from_tables(spark, sf_dir).transactions, "statement_id")
    # Without a header, dates must be seen in half of the first rows, those before the dated ones included.
    many = F.count("*").over(Window.partitionBy("statement_id")) >= 4
    rows = rows.withColumn("style", F.when((F.col("statement_id") % 3 != 2) | many, F.col("statement_id") % 3).otherwise(0))
    order = Window.partitionBy("statement_id").orderBy("transaction_date", "id")
    zero = F.lit(0).cast("decimal(14,2)")
    moved = F.coalesce("credit_amount", zero) - F.coalesce("debit_amount", zero)
    rows = rows.withColumns({"n": F.row_number().over(order), "balance": (F.lit(5_000_000).cast("decimal(14,2)") + F.sum(moved).over(order)).cast("decimal(14,2)")})
    shown = lambda c: F.when(F.col("id") % 13 == 0, "").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    day, out, into, left = F.date_format("transaction_date", "dd-MM-yyyy"), shown("debit_amount"), shown("credit_amount"), F.col("balance").cast("string")
    line = (
        F.when(F.col("style") == 0, F.concat_ws(",", day, F.concat(F.lit("payee "), F.col("id")), F.col("reference_number"), out, into, left))
        .when(F.col("style") == 1, F.concat_ws(";", day, F.concat(F.lit('"payee ""'), F.col("id"), F.lit('""; \nagain"')), F.col("reference_number"), into, out, left))
        .otherwise(F.concat_ws(",", day, F.concat(F.lit("payee "), F.col("id")), out, into, left))
    )
    lines = rows.groupBy("statement_id", "style").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\r\n").alias("body"))
    head = F.concat(F.lit("HDFC BANK statement\nA/C No: 00001234"), F.lpad(F.col("statement_id").cast("string"), 6, "0"), F.lit("\nOpening Balance: 5,000,000.00\n"))
    titles = F.when(F.col("style") == 0, "Date,Narration,Ref No.,Withdrawal (INR),Deposit (INR),Closing Balance\n").when(F.col("style") == 1, "Txn Date;Particulars;Chq No;Deposit Amt;Withdrawal Amt;Balance\n").otherwise("")
    text = F.when(F.col("statement_id") % 17 == 0, "not,a,statement\njust,some,text\n").otherwise(F.concat(head, titles, "body"))
    content = F.when(F.col("statement_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary"))).otherwise(text.cast("binary"))
    files_ = lines.select(F.col("statement_id").alias("file_id"), F.concat(F.lit("statement-"), "statement_id", F.lit(".csv")).alias("name"), content.alias("content"))
    return files_.withColumn("size", F.length("content").cast("long"))


_STATED = """, stated AS (SELECT id, statement_id, transaction_date, debit_amount, credit_amount, CAST(5000000 + sum(coalesce(credit_amount, 0) - coalesce(debit_amount, 0)) OVER (PARTITION BY statement_id ORDER BY transaction_date, id) AS DECIMAL(14,2)) AS left_over FROM txn WHERE statement_id % 17 <> 0)"""


@query("statement_files_rows", _STATED + " SELECT statement_id AS file_id, transaction_date, debit_amount AS debit, credit_amount AS credit, left_over AS balance, CASE WHEN statement_id % 3 = 1 THEN 'payee \"' || id || '\"; ' || chr(10) || 'again' ELSE 'payee ' || id END AS description FROM stated")
def statement_files_rows(spark, sf_dir):
    rows, _ = files.parsed(statement_files(spark, sf_dir))
    return rows.select("file_id", "transaction_date", "debit", "credit", "balance", "description")


@query("statement_files_report", """, f AS (SELECT statement_id AS file_id, count(*) AS n, count(*) FILTER (id % 13 = 0) AS lost FROM txn GROUP BY 1)
SELECT file_id, 'statement-' || file_id || '.csv' AS name, CASE WHEN file_id % 17 <> 0 THEN 'HDFC Bank' END AS bank_name, CASE WHEN file_id % 17 <> 0 THEN 'XXXX' || right(lpad(CAST(file_id AS VARCHAR), 6, '0'), 4) END AS account,
  CASE WHEN file_id % 17 <> 0 THEN CAST(5000000 AS DECIMAL(14,2)) END AS opening_balance, CASE WHEN file_id % 17 = 0 THEN 0 ELSE n END AS n_rows,
  file_id % 17 <> 0 AND file_id % 3 = 2 AND n >= 4 AS positional, file_id % 17 <> 0 AND lost > 0 AS recovered, CASE WHEN file_id % 17 = 0 THEN 'columns could not be found' END AS error FROM f""")
def statement_files_report(spark, sf_dir):
    _, report = files.parsed(statement_files(spark, sf_dir))
    told = lambda start: F.exists("warnings", lambda w: w.startswith(start))
    return report.select("file_id", "name", "bank_name", "account", "opening_balance", "n_rows", told(files.POSITIONAL).alias("positional"), told("Recovered").alias("recovered"), "error")


UPLOADS = [("a.csv", "61"), ("a.CSV", "3C61"), ("b.csv", "255044462D"), ("c.exe", "4D5A"), ("d.csv", ""), ("e.xls", "20200A3C48544D4C3E"), ("e.xls", "3C62"), ("f.xls", "D0CF11E0A1B11AE1"), ("g.xlsx", "504B0304"), ("g.pdf", "504B0304"), ("h.pdf", "25504446"), ("noext", "61")]


@query("upload_validation", "SELECT n AS name, h AS head, kind, error FROM " + _values([(n, h, k, e) for (n, h), (k, e) in zip(UPLOADS, [("csv", None), ("csv", None), (None, "content does not match the file type"), (None, "file type not allowed"), ("csv", "file is empty"), ("html", None), (None, "content does not match the file type"), ("xls", None), ("xlsx", None), (None, "content does not match the file type"), ("pdf", None), (None, "file type not allowed")], strict=True)], "n, h, kind, error"), views=False)
def upload_validation(spark, sf_dir):
    sent = spark.createDataFrame(UPLOADS, "name string, head string").withColumn("content", F.unhex("head")).withColumn("size", F.length("content").cast("long"))
    return files.validated(sent).select("name", "head", "kind", "error")


HEADERS = ["Txn Date", "Value Dt", "Narration", "Chq./Ref.No.", "Withdrawal Amt (INR)", "Deposit Amount", "Closing Balance", "Dr/Cr", "Amount in Rs", "Branch", "", None, "WITHDRAWAL (INR)", "Balance(INR)"]


@query("header_fields", "SELECT v, f AS field FROM " + _values(list(zip(HEADERS, ["date", "value_date", "description", "reference", "debit", "credit", "balance", "side", None, None, None, None, "debit", "balance"], strict=True)), "v, f"), views=False)
def header_fields(spark, sf_dir):
    return column(spark, HEADERS).select("v", layout.header_field(layout.header_key(F.col("v"))).alias("field"))


@query("html_table_cells", "SELECT CAST(r AS INTEGER) AS row_no, c AS cells FROM " + _values([(0, "Date|Debit"), (1, "01-09-2025|5 & 6"), (2, "a<b|")], "r, c"), views=False)
def html_table_cells(spark, sf_dir):
    page = b"<table><TR class=x><th>Date</th><th>Debit</th></tr><tr><td>01-09-2025</td><td><b>5 &amp; 6</b></td></tr><tr><td>a&lt;b</td><td></td></tr></table>"
    return files.html_cells(spark.createDataFrame([(1, page)], "file_id long, content binary")).select("row_no", F.array_join("cells", "|").alias("cells"))


LINES = ["ACCOUNT STATEMENT", "01-09-2025 UPI/KALYAN pay 5,000.00 Dr 15,000.00", "continued text", "02-09-2025 02-09-2025 NEFT in 300.00 15,300.00", "03-09-2025 x 1.00 2.00 3.00", "04/09/2025 lone -7.50"]


@query("text_line_rows", "SELECT CAST(n AS BIGINT) AS row_no, CAST(d AS DATE) AS transaction_date, t AS description, CAST(db AS DECIMAL(14,2)) AS debit, CAST(cr AS DECIMAL(14,2)) AS credit, CAST(b AS DECIMAL(14,2)) AS balance FROM " + _values([(1, "2025-09-01", "UPI/KALYAN pay continued text", "5000.00", None, "15000.00"), (2, "2025-09-02", "NEFT in", None, "300.00", "15300.00"), (3, "2025-09-03", "x", "1.00", "2.00", "3.00"), (4, "2025-09-04", "lone", "7.50", None, None)], "n, d, t, db, cr, b"), views=False)
def text_line_rows(spark, sf_dir):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(LINES)], "file_id long, line_no int, line string")
    return files.line_rows(lines).select("row_no", "transaction_date", "description", "debit", "credit", "balance")


HEADS = ["Statement of HDFC Bank\nA/C No: 123456789012\nName: RAVI KUMAR.\nOpening Balance INR 1,250.50", "state bank of india and HDFC", "Previous balance\n 99.00", "Balance B/F 10.25", "Acct holder nobody", None]


@query("statement_heads", "SELECT v, b AS bank, h AS holder, a AS account, CAST(o AS DECIMAL(14,2)) AS opening FROM " + _values(list(zip(HEADS, ["HDFC Bank", "State Bank of India", None, None, None, None], ["RAVI KUMAR", None, None, None, None, None], ["XXXX9012", None, None, None, None, None], ["1250.50", None, "99.00", "10.25", None, None], strict=True)), "v, b, h, a, o"), views=False)
def statement_heads(spark, sf_dir):
    holder, account = files.account_details(F.col("v"))
    return column(spark, HEADS).select("v", files.bank_name(F.col("v")).alias("bank"), holder.alias("holder"), account.alias("account"), files.opening_balance(F.col("v")).alias("opening"))


@query("upload_dedup", "SELECT CAST(doc_id % 5 AS BIGINT) AS user_id, sha256(text) AS sha256, min(doc_id) AS file_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 3 = 0 AND k.doc_id % 2 = 0 AND k.doc_id % 5 = d.doc_id % 5 AND k.text = d.text) GROUP BY 1, 2", views=False)
def upload_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    uploads = docs.select((F.col("doc_id") % 5).alias("user_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").alias("file_id"))
    known = uploads.filter("file_id % 3 = 0").withColumn("status", F.when(F.col("file_id") % 2 == 0, "COMPLETED").otherwise("FAILED"))
    return files.new_uploads(uploads, known)


#: Narrations with what they say: method, name, handle, account, reference, phone, email.
EXTRACTED = [
    ("UPI/KALYAN/kalyan@okaxis/12345", "UPI", "Kalyan", "kalyan@okaxis", None, "12345", None, None),
    ("KALYAN KUMAR / UPI / kalyan@okaxis", "UPI", "Kalyan Kumar", "kalyan@okaxis", None, None, None, None),
    ("UPI-KALYAN-KALYAN@OKAXIS", "UPI", "Kalyan", "kalyan@okaxis", None, None, None, None),
    ("Transfer to Kalyan Kumar A/C XXXX1234", "BANK_TRANSFER", "Kalyan Kumar", None, "XXXX1234", None, None, None),
    ("NEFT-KALYAN KUMAR-XXXX1234", "NEFT", "Kalyan Kumar", None, "XXXX1234", None, None, None),
    ("PAYTM-KALYAN-XXXX1234", "PAYTM", "Kalyan", None, "XXXX1234", None, None, None),
    ("PHONEPE-KALYAN@OKAXIS", "PHONEPE", "Kalyan", "kalyan@okaxis", None, None, None, None),
    ("UPI/ravi-kumar/ravi-kumar@okaxis/99887766", "UPI", "Ravi Kumar", "ravi-kumar@okaxis", None, "99887766", None, None),
    ("UPI/DR/509571559259/KIRSHNA/YESB/paytmqr6b6/UPI", "PAYTM", "Kirshna", "paytmqr6b6@yesb", None, "509571559259", None, None),
    ("NEFT REF NO AXIS12345678 mail ravi@mail.example.com Mob 9876543210", "NEFT", "Axis12345678 Mail", None, None, "AXIS12345678", "9876543210", "ravi@mail.example.com"),
    ("", None, None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None),
]


@query("narration_fields", "SELECT v, m AS payment_method, n AS name, u AS normalized_upi_id, a AS account_identifier, r AS reference, p AS phone, e AS email FROM " + _values(EXTRACTED, "v, m, n, u, a, r, p, e"), views=False)
def narration_fields(spark, sf_dir):
    found = narration.extract(column(spark, [r[0] for r in EXTRACTED]), "v")
    return found.select("v", "payment_method", "name", "normalized_upi_id", "account_identifier", "reference", "phone", "email")


# --- matching -----------------------------------------------------------------------------------------------------


def narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows as narrations: a handle each, a name for a third of them, an account for a fifth."""
    rows = from_tables(spark, sf_dir).transactions
    none = F.lit(None).cast("string")
    name = F.when(F.col("id") % 3 == 0, F.concat(F.lit("supplier#"), F.lpad((F.col("id") % 100).cast("string"), 9, "0")))
    return rows.select(
        "id", "statement_id", F.lit(0).alias("row_no"), "transaction_date", "payment_method", name.alias("name"), name.alias("normalized_name"), F.when(name.isNull(), F.array().cast("array<string>")).otherwise(F.array(name)).alias("name_tokens"),
        "normalized_upi_id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("XXXX"), F.lpad((F.col("id") % 60).cast("string"), 4, "0"))).alias("account_identifier"), none.alias("reference"), none.alias("phone"), none.alias("email"),
    )


_PAIRS = """, n AS (SELECT id, normalized_upi_id AS u, split_part(normalized_upi_id, '@', 1) AS h, split_part(normalized_upi_id, '@', 2) AS dom,
  CASE WHEN id % 3 = 0 THEN 'supplier#' || lpad(CAST(id % 100 AS VARCHAR), 9, '0') END AS name, CASE WHEN id % 5 = 0 THEN 'XXXX' || lpad(CAST(id % 60 AS VARCHAR), 4, '0') END AS acct FROM txn),
pu AS (SELECT person_id, lower(value) AS v, split_part(lower(value), '@', 1) AS ph, split_part(lower(value), '@', 2) AS pd FROM identifier WHERE id_type = 'UPI'),
pa AS (SELECT person_id, value AS pv FROM identifier WHERE id_type = 'ACCOUNT'),
c AS (SELECT n.id, p.id AS person_id, n.*  EXCLUDE (id), pu.v, pu.ph, pu.pd, pa.pv, p.normalized_name AS pname FROM n, person p JOIN pu ON pu.person_id = p.id JOIN pa ON pa.person_id = p.id
  WHERE n.dom = pu.pd OR (contains(pu.v, n.h) AND (starts_with(n.h, pu.ph) OR starts_with(pu.ph, n.h))) OR right(n.acct, 4) = right(pa.pv, 4) OR n.name = p.normalized_name),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY person_id) AS k FROM c)"""


@query("candidate_blocks", _PAIRS + " SELECT id, person_id FROM r WHERE k <= 8")
def candidate_blocks(spark, sf_dir):
    ledger = from_tables(spark, sf_dir)
    return matching.candidates(narrations(spark, sf_dir), ledger.people, ledger.identifiers)


_EVIDENCE = _PAIRS + """, e AS (SELECT id, person_id, u = v AS exact, acct = pv AS account, name = pname AS same_name, dom = pd AS domain,
  u <> v AND least(length(h), length(ph)) >= 5 AND least(length(h), length(ph)) / greatest(length(h), length(ph)) >= 0.5 AND (contains(h, ph) OR contains(ph, h)) AS partly FROM $PAIRS),
w AS (SELECT id, person_id, list_filter([CASE WHEN exact THEN 0.95::DOUBLE END, CASE WHEN account THEN 0.9::DOUBLE END, CASE WHEN partly THEN 0.55::DOUBLE END, CASE WHEN domain AND NOT exact AND NOT partly THEN 0.15::DOUBLE END, CASE WHEN same_name THEN 0.75::DOUBLE END], lambda x: x IS NOT NULL) AS ws FROM e),
s AS (SELECT id, person_id, round(least(0.99::DOUBLE, list_max(ws) + least(0.04::DOUBLE, 0.02::DOUBLE * greatest(len(list_filter(ws, lambda x: x >= 0.5)) - 1, 0))), 4) AS score FROM w WHERE len(ws) > 0)"""


def _snapshot(spark, sf_dir):
    """Narrations, people, their identifiers and, of methods, none."""
    ledger = from_tables(spark, sf_dir)
    return narrations(spark, sf_dir), ledger.people, ledger.identifiers, spark.createDataFrame([], "person_id long, methods array<string>")


@query("evidence_scores", _EVIDENCE.replace("$PAIRS", "r WHERE k <= 8") + " SELECT id, person_id, score FROM s")
def evidence_scores(spark, sf_dir):
    return matching.score_snapshot(*_snapshot(spark, sf_dir)).select("id", "person_id", "score")


@query("match_decision", _EVIDENCE.replace("$PAIRS", "c") + """, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, person_id) AS pos FROM s),
b AS (SELECT id, max(person_id) FILTER (pos = 1) AS p1, max(score) FILTER (pos = 1) AS s1, max(score) FILTER (pos = 2) AS s2 FROM k GROUP BY 1)
SELECT t.id, CASE WHEN s1 IS NULL THEN 'UNKNOWN' WHEN s1 >= 0.8::DOUBLE AND s2 >= 0.8::DOUBLE AND s1 - s2 <= 0.05::DOUBLE THEN 'AMBIGUOUS' WHEN s1 >= 0.8::DOUBLE THEN 'MATCH' WHEN s1 >= 0.55::DOUBLE AND s1 - s2 < 0.1::DOUBLE THEN 'AMBIGUOUS' WHEN s1 >= 0.55::DOUBLE THEN 'MATCH' ELSE 'AMBIGUOUS' END AS status,
p1 AS suggested_person_id, s1 AS confidence FROM txn t LEFT JOIN b ON b.id = t.id""")
def match_decision(spark, sf_dir):
    return matching.match_snapshot(*_snapshot(spark, sf_dir)).select("id", "status", "suggested_person_id", "confidence")


@query("mint_people", _PAIRS.split("pu AS (")[0].rstrip().rstrip(",") + """, f AS (SELECT n.*, t.statement_id, row_number() OVER (PARTITION BY u ORDER BY t.statement_id, n.id) AS k FROM n JOIN txn t ON t.id = n.id)
SELECT row_number() OVER (ORDER BY statement_id, id) AS id, format('P{:03d}', row_number() OVER (ORDER BY statement_id, id)) AS code, coalesce(name, 'A/C ' || acct, 'Unknown counterparty') AS canonical_name FROM f WHERE k = 1""")
def mint_people(spark, sf_dir):
    """People of the whole table's handles, from none at all."""
    rows = narrations(spark, sf_dir)
    nobody = spark.createDataFrame([], "id long, code string, canonical_name string, normalized_name string")
    nothing = spark.createDataFrame([], "person_id long, id_type string, normalized_value string")
    scored = spark.createDataFrame([], "id long, person_id long, codes array<string>, score double")
    people, _ = matching.mint(rows, matching.decide(rows, scored), scored, nobody, nothing)
    return people.select("id", "code", "canonical_name")


FIXTURE = [
    ("2025-09-01", "UPI/KALYAN/kalyan@okaxis/12345"), ("2025-09-05", "KALYAN KUMAR / UPI / kalyan@okaxis"), ("2025-09-10", "NEFT-KALYAN KUMAR-XXXX1234"), ("2025-09-15", "PAYTM-KALYAN-XXXX1234"), ("2025-09-20", "UPI/KALYAN/kalyan@okaxis/12347"),
    ("2025-09-10", "RAVI KUMAR / ravi@okaxis"), ("2025-09-15", "RAVI PAVAN / ravipavan@ybl"), ("2025-09-25", "RAVI"),
]


def fixture(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, 1, i, datetime.date.fromisoformat(d), t) for i, (d, t) in enumerate(FIXTURE, 1)], "id long, statement_id long, row_no int, transaction_date date, raw string")
    return narration.extract(rows)


@query("match_rounds", "SELECT CAST(i AS BIGINT) AS id, status, code, CAST(c AS DOUBLE) AS confidence FROM " + _values([(1, "MATCH", "P001", 0.99), (2, "MATCH", "P001", 0.97), (3, "MATCH", "P002", 0.92), (4, "MATCH", "P002", 0.92), (5, "MATCH", "P001", 0.99), (6, "MATCH", "P003", 0.97), (7, "MATCH", "P004", 0.97), (8, "AMBIGUOUS", None, 0.3)], "i, status, code, c"), views=False)
def match_rounds(spark, sf_dir):
    """Rounds of matching and minting from no people at all."""
    people = spark.createDataFrame([], "id long, code string, canonical_name string, normalized_name string")
    identifiers = spark.createDataFrame([], "person_id long, id_type string, normalized_value string")
    decisions, people, _ = matching.resolve(fixture(spark), people, identifiers)
    return decisions.join(people.select(F.col("id").alias("person_id"), "code"), "person_id", "left").select("id", "status", "code", "confidence")


# --- questions ----------------------------------------------------------------------------------------------------

@query("answer_total_sent", f"SELECT 'Supplier#000000042 (P000042) — Total sent: Rs ' || format('{{:,.2f}}', CAST(sum(debit_amount) AS DOUBLE)) || '. (Verified from ' || count(*) || ' transaction' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || '.)' AS answer, 'resolved' AS resolution FROM owned WHERE user_id = {USER} AND counterparty_id = 42 AND transaction_type = 'DEBIT'")
def answer_total_sent(spark, sf_dir):
    found = questions.ask(from_tables(spark, sf_dir), USER, 'How much did I send "supplier#000000042"?', AS_OF)
    return spark.createDataFrame([(found.text, found.resolution)], "answer string, resolution string")


@query("answer_count_month", f"SELECT count(*) || ' transactions.' AS answer FROM owned WHERE user_id = {USER} AND transaction_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'")
def answer_count_month(spark, sf_dir):
    return spark.createDataFrame([(questions.ask(from_tables(spark, sf_dir), USER, "How many transactions in March 1998?", AS_OF).text,)], "answer string")


@query("event_activity", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", views=False)
def event_activity(spark, sf_dir):
    return ingest.activity(spark.read.parquet(f"{sf_dir}/events.parquet"))
