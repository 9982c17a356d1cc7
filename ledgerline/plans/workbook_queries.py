"""Registered queries over workbooks that Spark writes from ``orders``, one for each customer."""

from __future__ import annotations

import datetime
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.plans.ledger import from_tables
from ledgerline.plans.queries import query
from ledgerline.plans.session import checkpointed, spread
from ledgerline.sources import files, workbooks

_SPACE = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_LINKS = "http://schemas.openxmlformats.org/package/2006/relationships"
TITLES = ("Txn Date", "Narration", "Ref No.", "Withdrawal (INR)", "Deposit (INR)", "Closing Balance")


def container(sheets: list[list[list]], shared: bool = True, from_1904: bool = False) -> bytes:
    """A workbook of these cells: texts (shared or in place), numbers, days (serial numbers with a style) and None for cells left out."""
    strings: dict[str, int] = {}
    epoch = datetime.date(1904, 1, 1) if from_1904 else datetime.date(1899, 12, 30)

    def cell(place: str, value) -> str:
        if isinstance(value, datetime.date):
            return f'<c r="{place}" s="1"><v>{(value - epoch).days}</v></c>'
        if not isinstance(value, str):
            return f'<c r="{place}"><v>{value}</v></c>'
        if shared:
            return f'<c r="{place}" t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
        return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    def sheet(rows: list[list]) -> str:
        lines = ("".join(cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row) if v is not None) for r, row in enumerate(rows, 1))
        return f"<worksheet {_SPACE}><sheetData>" + "".join(f'<row r="{r}">{line}</row>' for r, line in enumerate(lines, 1)) + "</sheetData></worksheet>"

    link = lambda k, kind, target: f'<Relationship Id="rId{k}" Type="{_KIND}/{kind}" Target="{target}"/>'
    links = lambda inner: f'<Relationships xmlns="{_LINKS}">{inner}</Relationships>'
    n = len(sheets)
    parts = {f"xl/worksheets/sheet{k}.xml": sheet(rows) for k, rows in enumerate(sheets, 1)}
    names = "".join(f'<sheet name="Sheet {k}" sheetId="{k}" r:id="rId{k}"/>' for k in range(1, n + 1))
    parts["xl/workbook.xml"] = f'<workbook {_SPACE} xmlns:r="{_KIND}"><workbookPr date1904="{int(from_1904)}"/><sheets>{names}</sheets></workbook>'
    parts["xl/styles.xml"] = f'<styleSheet {_SPACE}><numFmts><numFmt numFmtId="164" formatCode="dd\\-mmm\\-yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    parts["xl/sharedStrings.xml"] = f"<sst {_SPACE}>" + "".join(f'<si><r><t xml:space="preserve">{escape(s)}</t></r><rPh><t>read so</t></rPh></si>' for s in strings) + "</sst>"
    parts["_rels/.rels"] = links(link(1, "officeDocument", "xl/workbook.xml"))
    parts["xl/_rels/workbook.xml.rels"] = links("".join(link(k, "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, n + 1)) + link(n + 1, "styles", "styles.xml") + link(n + 2, "sharedStrings", "/xl/sharedStrings.xml"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for name, text in parts.items():
            packed.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def _written(s: int, rows: list[dict]) -> bytes:
    """The workbook of one statement: by its number with notes before or after it, texts shared or in place, days counted from 1900 or 1904; some are cut off."""
    body = [[r["transaction_date"], f"payee <{r['id']}> & co", f" R{r['id']} ", r["debit_amount"], r["credit_amount"], r["balance"]] for r in rows]
    statement = [["HDFC BANK statement"], ["A/C No:", f"00001234{s:06d}"], [], list(TITLES), *body]
    notes = [["HDFC BANK", "notes of the branch"], [None, None, "nothing here"]]
    sheets = [[notes, statement], [statement, [list(TITLES), *body[:1]]], [[], statement, notes]][s % 3]
    content = container(sheets, shared=s % 2 == 0, from_1904=s % 5 == 0)
    return content[: len(content) // 2] if s % 17 == 0 else content


def _workbooks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A workbook of each row ``file_id, rows``, some hundreds at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            content = [_written(s, rows) for s, rows in zip(part.column("file_id").to_pylist(), part.column("rows").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("file_id"), pa.array(content, pa.binary())], ["file_id", "content"])


def statement_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, name, content, size``: a workbook of each customer's orders with a running balance."""
    order = Window.partitionBy("statement_id").orderBy("transaction_date", "id")
    zero = F.lit(0).cast("decimal(14,2)")
    moved = F.coalesce("credit_amount", zero) - F.coalesce("debit_amount", zero)
    rows = spread(from_tables(spark, sf_dir).transactions, "statement_id").select(
        "statement_id", "id", "transaction_date", "debit_amount", "credit_amount", F.row_number().over(order).alias("n"), (F.lit(5_000_000).cast("decimal(14,2)") + F.sum(moved).over(order)).cast("decimal(14,2)").alias("balance")
    )
    ordered = F.sort_array(F.collect_list(F.struct("n", "transaction_date", "id", "debit_amount", "credit_amount", "balance")))
    written = rows.groupBy(F.col("statement_id").alias("file_id")).agg(ordered.alias("rows")).mapInArrow(_workbooks, "file_id long, content binary")
    return written.select("file_id", F.concat(F.lit("statement-"), "file_id", F.lit(".xlsx")).alias("name"), "content", F.length("content").cast("long").alias("size"))


_STATED = """, stated AS (SELECT id, statement_id, transaction_date, debit_amount, credit_amount, CAST(5000000 + sum(coalesce(credit_amount, 0) - coalesce(debit_amount, 0)) OVER (PARTITION BY statement_id ORDER BY transaction_date, id) AS DECIMAL(14,2)) AS left_over FROM txn WHERE statement_id % 17 <> 0)"""


@query("workbook_rows", _STATED + " SELECT statement_id AS file_id, transaction_date, debit_amount AS debit, credit_amount AS credit, left_over AS balance, 'payee <' || id || '> & co' AS description, 'R' || id AS reference FROM stated")
def workbook_rows(spark, sf_dir):
    rows, _ = files.parsed(statement_workbooks(spark, sf_dir))
    return rows.select("file_id", "transaction_date", "debit", "credit", "balance", "description", "reference")


@query("workbook_report", f"""SELECT statement_id AS file_id, 'statement-' || statement_id || '.xlsx' AS name, CASE WHEN statement_id % 17 <> 0 THEN 'HDFC Bank' END AS bank_name,
CASE WHEN statement_id % 17 <> 0 AND statement_id % 3 <> 0 THEN 'XXXX' || right(lpad(CAST(statement_id AS VARCHAR), 6, '0'), 4) END AS account, CASE WHEN statement_id % 17 = 0 THEN 0 ELSE count(*) END AS n_rows,
CASE WHEN statement_id % 17 = 0 THEN '{workbooks.BROKEN}' END AS error FROM txn GROUP BY statement_id""")
def workbook_report(spark, sf_dir):
    """The head is that of the first sheet that is not empty."""
    _, report = files.parsed(statement_workbooks(spark, sf_dir))
    return report.select("file_id", "name", "bank_name", "account", "n_rows", "error")


@query("workbook_cells", "SELECT statement_id AS file_id, CAST(CASE WHEN statement_id % 3 = 1 THEN 1 ELSE 2 END AS INTEGER) AS part, strftime(min(transaction_date), '%Y-%m-%d') AS first_day, strftime(max(transaction_date), '%Y-%m-%d') AS last_day, count(*) AS n FROM txn WHERE statement_id % 17 <> 0 GROUP BY statement_id")
def workbook_cells(spark, sf_dir):
    """The days of each statement's sheet as its cells show them."""
    cells = workbooks.readable(checkpointed(workbooks.sheet_cells(statement_workbooks(spark, sf_dir))))
    days = cells.filter((F.get("cells", F.lit(0)).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")) & ((F.col("file_id") % 3 != 1) | (F.col("part") == 1)))
    day = F.get("cells", F.lit(0))
    return days.groupBy("file_id", "part").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_id, name, content, size``: a page of each customer's orders under a spreadsheet's name. The rows are dealt to a table with a header, one without,
    and one whose header names other columns; every description holds a table of its own, and some cells are never closed."""
    order = Window.partitionBy("statement_id").orderBy("transaction_date", "id")
    zero = F.lit(0).cast("decimal(14,2)")
    moved = F.coalesce("credit_amount", zero) - F.coalesce("debit_amount", zero)
    rows = spread(from_tables(spark, sf_dir).transactions, "statement_id").withColumns({"n": F.row_number().over(order), "balance": (F.lit(5_000_000).cast("decimal(14,2)") + F.sum(moved).over(order)).cast("decimal(14,2)")})
    day, left = F.date_format("transaction_date", "dd-MM-yyyy"), F.col("balance").cast("string")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(F.lit("payee <table><tr><td>inner</td><td>5.00</td></tr></table>&lt;"), F.col("id").cast("string"), F.lit("&gt;"))
    cells = lambda *columns: F.concat(F.lit("<TR class=r>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in columns[:-1]], F.lit("<td><b>"), columns[-1], F.lit("</b></tr>"))
    # Tables by the thirds of the rows, in their order.
    rows = rows.withColumn("third", F.ntile(3).over(order))
    line = F.when(F.col("third") == 3, cells(day, left, shown("credit_amount"), shown("debit_amount"), said)).otherwise(cells(day, said, shown("debit_amount"), shown("credit_amount"), left))
    held = rows.groupBy("statement_id").agg(F.sort_array(F.collect_list(F.struct("n", "third", line.alias("line")))).alias("l"))
    body = lambda k: F.array_join(F.transform(F.filter("l", lambda x: x["third"] == k), lambda x: x["line"]), "\n")
    titles = lambda *names: F.lit("<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>")
    text = F.concat(
        F.lit("<html><body><p>HDFC BANK</p><table border=1>"), titles("Date", "Narration", "Withdrawal (INR)", "Deposit (INR)", "Closing Balance"), body(1), F.lit("</table><p>next page</p><table>"), body(2),
        F.lit("</table><table>"), titles("Txn Date", "Balance", "Deposit Amt", "Withdrawal Amt", "Particulars"), body(3), F.lit("</table></body></html>"),
    )
    return held.select(F.col("statement_id").alias("file_id"), F.concat(F.lit("page-"), "statement_id", F.lit(".xls")).alias("name"), text.cast("binary").alias("content")).withColumn("size", F.length("content").cast("long"))


@query("statement_pages_rows", _STATED.replace(" WHERE statement_id % 17 <> 0", "") + " SELECT statement_id AS file_id, transaction_date, debit_amount AS debit, credit_amount AS credit, left_over AS balance, 'payee <' || id || '>' AS description FROM stated")
def statement_pages_rows(spark, sf_dir):
    rows, _ = files.parsed(statement_pages(spark, sf_dir))
    return rows.select("file_id", "transaction_date", "debit", "credit", "balance", "description")
