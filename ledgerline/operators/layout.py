"""Columns of a statement file: by header names, else by what the cells look like; then typed rows.

Input: ``file_id, row_no, cells`` (array of strings). All detection is joins and conditional aggregates over single cells, files at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_date
from ledgerline.functions.money import amount_side, parse_amount
from ledgerline.functions.steps import computed
from ledgerline.plans.session import checkpointed

SCAN = 30
FIELDS = ("date", "value_date", "description", "reference", "debit", "credit", "balance", "amount", "side")
#: Header keys of each field, in order of precedence.
ALIASES = {
    "date": "date txndate trandate transactiondate postingdate postdate dt dated txndt",
    "value_date": "valuedate valdate datedt valuedt",
    "description": "narration description particulars particular details transactiondetails transactionremarks remarks info narrative "
    "transactionparticulars particularsinformation transactiondescription transactionnarration tranparticulars",
    "reference": "reference ref refno referenceno utr utrno rrn chqno chequeno chqrefno chequerefno instrumentno instrumentnumber instno "
    "tranid transactionid txnid checkno chequeref refnochequeno refnocheque",
    "debit": "debit debits withdrawal withdrawals withdrawalamt withdrawalamount debitamount paidout dr amountdr debitsamount",
    "credit": "credit credits deposit deposits depositamt depositamount creditamount paidin cr amountcr creditsamount",
    "balance": "balance bal closingbalance runningbalance availablebalance closingbal",
    "amount": "amount amt txnamount transactionamount",
    "side": "drcr drcrtype indicator debitcredit sign",
}
#: Endings that a header key may lose, in the order they are tried.
ENDINGS = ("inr", "rs", "amount", "amt", "value", "ind")
BLANK = ("", "-", "--", "---", "n/a", "na", "0.00", "0")


def header_key(cell: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(cell, F.lit("")))), r"\(.*?\)", ""), "[^a-z0-9]+", "")


def _header_names() -> dict[str, str]:
    """The field of each key: an alias, else one with an ending, of earlier endings first."""
    names = {alias: field for field, line in ALIASES.items() for alias in line.split()}
    ended = {alias + e: field for e in reversed(ENDINGS) for alias, field in names.items()}
    return ended | names


def header_field(key: Column) -> Column:
    """The field that a key names, as it is or without one of the endings. Most cells are ruled out by their letters and length."""
    names = _header_names()
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(F.length(key).between(min(map(len, names)), max(map(len, names))) & key.rlike("^[a-z]+$"), F.try_element_at(table, key))


def looks_numeric(cell: Column) -> Column:
    return parse_amount(cell).isNotNull()


def _layout(columns: dict[str, Column], source: str, first_row: Column) -> list[Column]:
    return ["file_id", *[columns.get(f, F.lit(None)).cast("int").alias(f"{f}_idx") for f in FIELDS], F.lit(source).alias("source"), first_row.cast("int").alias("first_row")]


def header_layout(rows: DataFrame) -> DataFrame:
    """Per file the first of its leading rows that names a date and money: column of each field, and the row after it."""
    order = Window.partitionBy("file_id").orderBy("row_no")
    top = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SCAN)
    # No key holds a digit, except in parentheses, which go.
    worded = top.select("file_id", "row_no", F.posexplode("cells").alias("col", "cell")).filter((F.col("cell") != "") & (~F.col("cell").rlike(r"\d") | F.col("cell").contains("(")))
    cells = computed(worded, {"field": header_field(header_key(F.col("cell")))})
    wide = cells.filter("field is not null").groupBy("file_id", "row_no").pivot("field", list(FIELDS)).agg(F.min("col"))
    good = wide.filter("date is not null and (debit is not null or credit is not null or amount is not null)")
    best = good.groupBy("file_id").agg(F.min_by(F.struct("row_no", *FIELDS), "row_no").alias("h"))
    return best.select(*_layout({f: F.col(f"h.{f}") for f in FIELDS}, "header", F.col("h.row_no") + 1))


def positional_layout(rows: DataFrame) -> DataFrame:
    """Per file without a header: dates in the first columns, money in the last ones, the longest text between."""
    file = Window.partitionBy("file_id")
    filled = rows.filter(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    sample = filled.withColumn("_n", F.row_number().over(file.orderBy("row_no"))).filter(F.col("_n") <= SCAN)
    sample = sample.withColumns({"n": F.count("*").over(file), "width": F.max(F.size("cells")).over(file)})
    cells = sample.select("file_id", "n", "width", F.posexplode("cells").alias("col", "cell"))
    # Each cell is parsed once: the expressions are long.
    cells = computed(cells, {"blank": F.lower(F.trim(F.coalesce("cell", F.lit("")))).isin(*BLANK), "numeric": looks_numeric(F.col("cell")), "day": parse_date(F.col("cell"))})
    blank, numeric = F.col("blank"), F.col("numeric")
    dated = F.col("day").isNotNull() & ~numeric
    count = lambda c: F.sum(c.cast("int"))
    kinds = cells.groupBy("file_id", "n", "width", "col").agg(
        count(dated).alias("dates"), count(~blank).alias("filled"), count(~blank & numeric).alias("numbers"), count(~blank & dated).alias("filled_dates"),
        F.coalesce(F.avg(F.when(~blank, F.length("cell"))), F.lit(0.0)).alias("length"),
    )
    enough = F.col("dates") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    # Over the file's columns, not joined: a join would parse the cells again for its other side.
    kinds = kinds.withColumn("date_cols", F.collect_set(F.when(enough & (F.col("col") <= 2), F.col("col"))).over(file))
    date = F.when(F.array_contains("date_cols", 0), 0).when(F.array_contains("date_cols", 1), 1)
    kinds = kinds.withColumn("date", date).filter("date is not null")
    kinds = kinds.withColumn("value_date", F.when(F.array_contains("date_cols", F.col("date") + 1), F.col("date") + 1))
    placed = kinds.filter(F.col("col") > F.coalesce("value_date", "date"))
    is_money = (F.col("filled") > 0) & (F.col("filled_dates") < 0.5 * F.col("filled")) & (F.col("numbers") >= 0.75 * F.col("filled"))
    gathered = placed.groupBy("file_id", "width", "date", "value_date").agg(
        F.sort_array(F.collect_list(F.when(is_money, F.col("col")))).alias("money"),
        F.collect_list(F.when(~is_money, F.struct((-F.col("length")).alias("less"), "col"))).alias("texts"),
    )
    money, width, size = F.col("money"), F.col("width"), F.size("money")
    # Only texts before the first number; the longest one describes, the next one refers.
    texts = F.sort_array(F.filter("texts", lambda t: (size == 0) | (t["col"] < F.get(money, F.lit(0)))))
    at = lambda k: F.get(money, size - k)
    three = size >= 3
    wide = (width >= 6) & (size == 2) & F.array_contains(money, width - 1) & (F.array_contains(money, width - 3) | F.array_contains(money, width - 2))
    pick = lambda a, b: F.when(three, a).when(wide, b)
    plain = ~three & ~wide
    columns = {
        "date": F.col("date"),
        "value_date": F.col("value_date"),
        "description": F.get(texts, F.lit(0))["col"],
        "reference": F.get(texts, F.lit(1))["col"],
        "debit": pick(at(3), width - 3),
        "credit": pick(at(2), width - 2),
        "balance": F.when(three, at(1)).when(wide, width - 1).when(plain & (size == 2), F.get(money, F.lit(1))),
        "amount": F.when(plain, F.get(money, F.lit(0))),
    }
    return gathered.filter(size > 0).select(*_layout(columns, "positional", F.lit(0)))


def layouts(rows: DataFrame) -> DataFrame:
    """Header layouts, and positional ones for the files that have none."""
    named = checkpointed(header_layout(rows))
    return named.unionByName(positional_layout(rows.join(named, "file_id", "left_anti")))


def typed_rows(rows: DataFrame, found: DataFrame, *told: str) -> DataFrame:
    """Candidate ledger rows: dated, with money or a balance. ``told``: further columns of ``found`` that they carry."""
    df = rows.join(found, "file_id").filter(F.col("row_no") >= F.col("first_row"))
    # Each cell is picked once: the parsers name it many times.
    df = computed(df, {f"_{f}_cell": F.nullif(F.trim(F.get("cells", F.col(f"{f}_idx"))), F.lit("")) for f in FIELDS})
    cell = lambda f: F.col(f"_{f}_cell")
    has = lambda f: F.col(f"{f}_idx").isNotNull()
    described, referred = cell("description"), cell("reference")
    df = computed(
        df,
        {
            "transaction_date": parse_date(cell("date")),
            "_value": parse_date(cell("value_date")),
            "_text": F.when(has("description"), described).otherwise(referred),
            "_ref": F.when(has("description"), referred),
        },
    )
    # A description that is a date gives way to a reference that is none.
    df = computed(df, {"_text_date": parse_date(F.col("_text")), "_ref_date": parse_date(F.col("_ref"))})
    swap = F.coalesce(F.col("_text_date").isNotNull() & F.col("_ref_date").isNull() & (F.length("_ref") > 3), F.lit(False))
    df = computed(df, {"value_date": F.when(swap, F.coalesce("_value", "_text_date")).otherwise(F.col("_value")), "description": F.when(swap, F.col("_ref")).otherwise(F.col("_text")), "reference": F.when(~swap, F.col("_ref"))})
    df = computed(df, {f"_{f}": parse_amount(cell(f)) for f in ("amount", "debit", "credit", "balance")})
    amount = F.col("_amount")
    mark, upper = F.lower(cell("side")), F.upper(F.coalesce("description", F.lit("")))
    marked = F.when(mark.rlike("^[dw]"), "DEBIT").when(mark.rlike("^[cr]"), "CREDIT")
    narrated = F.when(upper.rlike("WDL|WITHDRAWAL|DR/|DEBIT|PAID TO|TRANSFER TO"), "DEBIT").when(upper.rlike("DEP|CR/|CREDIT|RECEIVED FROM"), "CREDIT")
    side = F.coalesce(marked, amount_side(cell("amount")), narrated, F.when(amount < 0, "SIGNED").otherwise("CREDIT"))
    df = computed(df, {"_side": F.when(amount.isNotNull(), side)})
    side = F.col("_side")
    df = computed(
        df,
        {
            "debit": F.when(amount.isNotNull() & (side == "DEBIT"), amount).when(amount.isNotNull() & (side == "SIGNED"), -amount).otherwise(F.col("_debit")),
            "credit": F.when(amount.isNotNull() & (side == "CREDIT"), amount).otherwise(F.col("_credit")),
            "balance": F.col("_balance"),
            "raw_text": F.array_join(F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != ""), " | "),
        },
    )
    kept = df.filter("transaction_date is not null and (debit is not null or credit is not null or balance is not null)")
    return kept.select("file_id", "row_no", "transaction_date", "value_date", "description", "reference", "debit", "credit", "balance", "raw_text", "source", *told)
