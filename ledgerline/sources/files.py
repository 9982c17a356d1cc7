"""Statement files as cells: CSV, HTML tables saved as spreadsheets, workbooks, and text lines; validation, hashing and duplicates of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_date
from ledgerline.functions.money import amount_side, parse_amount
from ledgerline.functions.steps import computed
from ledgerline.operators import layout, reconcile
from ledgerline.plans.session import checkpointed, spread
from ledgerline.sources import workbooks

MAX_BYTES = 20 << 20
#: The extensions that uploads may have.
EXTENSIONS = ("csv", "xlsx", "xls", "pdf")
#: Banks by their names in a statement, in order of precedence.
BANKS = [
    (r"STATE BANK OF INDIA|\bSBI\b", "State Bank of India"), (r"HDFC BANK|\bHDFC\b", "HDFC Bank"), (r"ICICI BANK|\bICICI\b", "ICICI Bank"), (r"AXIS BANK|\bAXIS\b", "Axis Bank"),
    (r"KOTAK(?: MAHINDRA)? BANK|\bKOTAK\b", "Kotak Mahindra Bank"), (r"PUNJAB NATIONAL BANK|\bPNB\b", "Punjab National Bank"), (r"BANK OF BARODA|\bBOB\b", "Bank of Baroda"), (r"CANARA BANK", "Canara Bank"),
    (r"YES BANK", "Yes Bank"), (r"IDFC(?: FIRST)? BANK|\bIDFC\b", "IDFC Bank"), (r"INDUSIND BANK|\bINDUSIND\b", "IndusInd Bank"), (r"AU SMALL FINANCE", "AU Small Finance Bank"), (r"FEDERAL BANK", "Federal Bank"),
    (r"BANDHAN BANK", "Bandhan Bank"), (r"UNION BANK OF INDIA", "Union Bank of India"), (r"CENTRAL BANK OF INDIA", "Central Bank of India"), (r"INDIAN BANK", "Indian Bank"), (r"UNITED BANK", "United Bank of India"),
]
#: How statements name the balance that they open with.
OPENING = (r"opening\s*balance", r"previous\s*balance", r"balance\s*(?:b/?f|brought\s*forward)")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, name, content, size`` of every file below the path, in whatever store Spark can list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("length").alias("size"))


def validated(files: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``error`` (null: acceptable): extension, size and leading bytes must agree. A spreadsheet name may hold an HTML table."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    head = F.hex(F.substring("content", 1, 8))
    magic = F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "xlsx").when(head.startswith("D0CF11E0A1B11AE1"), "xls")
    markup = F.decode(F.substring("content", 1, 512), "ISO-8859-1").rlike(r"(?i)^\s*<(html|\?xml|table)")
    kind = F.when(ext.isin("pdf", "xlsx", "xls") & (magic == ext), ext).when((ext == "xls") & magic.isNull() & markup, "html").when((ext == "csv") & magic.isNull(), "csv")
    error = (
        F.when(~ext.isin(*EXTENSIONS), "file type not allowed")
        .when(F.col("size") == 0, "file is empty")
        .when(F.col("size") > MAX_BYTES, "file is too large")
        .when(kind.isNull(), "content does not match the file type")
    )
    return files.withColumns({"kind": kind, "error": error})


def fingerprinted(files: DataFrame) -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace("name", r"[^A-Za-z0-9._ -]", "_"), r"^\.+", "")
    return files.withColumns({"sha256": F.sha2("content", 256), "safe_name": clean})


def new_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Uploads (``user_id, sha256, file_id``) whose content the user has not stored yet, the first of each; failed ones may come again."""
    taken = known.filter("status <> 'FAILED'").select("user_id", "sha256")
    first = uploads.groupBy("user_id", "sha256").agg(F.min("file_id").alias("file_id"))
    return first.join(taken, ["user_id", "sha256"], "left_anti")


_UPPER = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]


def decode(content: Column) -> Column:
    """UTF-8 where valid, else the common Western code page, else Latin-1; without a byte order mark."""
    latin = F.decode(content, "ISO-8859-1")
    western = F.translate(latin, "".join(c for c, w in _UPPER if w), "".join(w for _, w in _UPPER if w))
    unassigned = latin.rlike("[" + "".join(c for c, w in _UPPER if not w) + "]")
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.when(unassigned, latin).otherwise(western))
    return F.regexp_replace(text, "^\ufeff", "")


def delimiter(text: Column) -> Column:
    """The candidate that the first 8192 characters have most of; a comma on ties."""
    head = F.left(text, F.lit(8192))
    counted = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("rank"), F.lit(d).alias("d")) for i, d in enumerate([",", ";", "\t", "|"])]
    return F.array_max(F.array(*counted))["d"]


#: A quoted field with whatever follows its closing quote, or a plain one; D stands for the delimiter.
FIELD = r'[ ]*+(?:"[^"]*+(?:""[^"]*+)*+(?:"[^D\r\n]*+)?|[^"D\r\n][^D\r\n]*+)?'


def csv_cells(files: DataFrame) -> DataFrame:
    """``file_id, row_no, cells``: quoted cells may hold delimiters, line ends and doubled quotes; rows without a filled cell are dropped."""
    text = files.select("file_id", decode(F.col("content")).alias("text"))
    text = computed(text, {"d": delimiter(F.col("text"))})
    one = F.when(F.col("d") == "|", r"\|").when(F.col("d") == "\t", r"\t").otherwise(F.col("d"))
    field = F.replace(F.lit(FIELD), F.lit("D"), one)
    text = computed(text, {"_record": F.concat(F.lit("("), field, F.lit("(?:"), one, field, F.lit(")*+)")), "_cell": F.concat(F.lit("(?:^|"), one, F.lit(")("), field, F.lit(")"))})
    records = F.filter(F.regexp_extract_all("text", F.col("_record"), F.lit(1)), lambda r: r.rlike(r"[^\s]"))
    rows = text.select("file_id", "_cell", F.posexplode(records).alias("row_no", "record"))

    def plain(cell: Column) -> Column:
        inner = F.replace(F.regexp_extract(cell, r'(?s)^"([^"]*+(?:""[^"]*+)*+)', 1), F.lit('""'), F.lit('"'))
        after = F.regexp_extract(cell, r'(?s)^"[^"]*+(?:""[^"]*+)*+"(.*)$', 1)
        return F.when(cell.startswith('"'), F.concat(inner, after)).otherwise(cell)

    cells = F.transform(F.regexp_extract_all("record", F.col("_cell"), F.lit(1)), lambda c: plain(F.trim(c)))
    return rows.select("file_id", "row_no", cells.alias("cells")).filter(F.exists("cells", lambda c: c.rlike(r"[^\s]")))


def unescaped(text: Column) -> Column:
    """Entities of HTML text resolved: the common names and all numbers."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))

    def resolved(so_far: Column, entity: Column) -> Column:
        digits = F.regexp_extract(entity, "([0-9A-Fa-f]+);", 1)
        code = F.when(entity.rlike("^&#[xX]"), F.upper(digits)).otherwise(F.hex(digits.try_cast("long")))
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.replace(so_far, entity, F.coalesce(char, entity))

    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(0)))
    return F.replace(F.aggregate(numbers, text, resolved), F.lit("&amp;"), F.lit("&"))


#: The tags that make up tables, with what tells an opening from a closing one.
TABLE_TAG = r"(?i)<(/?(?:table|tr|t[dh]))(?=[\s/>])[^>]*>"


def html_cells(files: DataFrame) -> DataFrame:
    """``file_id, table_no, row_no, cells`` of table rows, tags and entities resolved; rows are numbered over the whole file.

    Tags are events in their order: a running sum gives the depth, and a cell belongs to the innermost table that is open there. A table inside a
    cell is a table of its own, and the cell goes on after it. Cells and rows that are never closed end where the next one begins.
    """
    text = files.select("file_id", F.translate(decode(F.col("content")), "\x01\x02", "").alias("text"))
    events = text.select("file_id", F.posexplode(F.split(F.regexp_replace("text", TABLE_TAG, "\x01$1\x02"), "\x01")).alias("pos", "event"))
    events = events.filter("pos > 0").select("file_id", "pos", F.lower(F.substring_index("event", "\x02", 1)).alias("tag"), F.substring_index("event", "\x02", -1).alias("said"))
    tag, file = F.col("tag"), Window.partitionBy("file_id").orderBy("pos")
    events = events.withColumn("depth", F.sum(F.when(tag == "table", 1).when(tag == "/table", -1).otherwise(0)).over(file))
    events = events.withColumn("table", F.coalesce(F.last(F.when(tag == "table", F.col("pos")), ignorenulls=True).over(Window.partitionBy("file_id", "depth").orderBy("pos")), F.lit(-1)))
    inside = Window.partitionBy("file_id", "table").orderBy("pos")
    latest = lambda *tags: F.last(F.when(tag.isin(*tags), F.col("pos")), ignorenulls=True).over(inside)
    events = events.withColumns({"row": latest("tr"), "cell": latest("td", "th"), "end": F.coalesce(latest("/td", "/th", "tr", "/tr"), F.lit(-1))})
    held = events.filter("row is not null and cell > row and cell > end").groupBy("file_id", "table", "row", "cell").agg(F.sort_array(F.collect_list(F.struct("pos", "said"))).alias("l"))
    plain = F.trim(unescaped(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["said"]), ""), r"(?s)<[^>]+>", "")))
    rows = held.select("file_id", "table", "row", "cell", plain.alias("text")).groupBy("file_id", "table", "row").agg(F.sort_array(F.collect_list(F.struct("cell", "text"))).alias("l"))
    number = lambda order, of: (of().over(Window.partitionBy("file_id").orderBy(order)) - 1).cast("int")
    return rows.select("file_id", number("table", F.dense_rank).alias("table_no"), number("row", F.row_number).alias("row_no"), F.transform("l", lambda x: x["text"]).alias("cells"))


#: How text lines of statements write dates and money.
DATE = r"\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}"
DATE_LINE = rf"^\s*({DATE})(?:\s+({DATE}))?\s+(\S.*)$"
MONEY = r"(?:₹|Rs\.?\s*)?-?[\d,]+\.\d{2}-?(?:\s*(?:Dr|Cr)\b)?"


def classified(amounts: Column) -> tuple[Column, Column, Column]:
    """Debit, credit and balance of a row's money: amount, or amount and balance, or withdrawal, deposit and balance; marks win."""
    token = lambda k: F.get(amounts, F.lit(k))
    first, second, third = (parse_amount(token(k)) for k in range(3))
    side_1, side_2 = amount_side(token(0)), amount_side(token(1))
    n, marked = F.size(amounts), side_1.isNotNull() | side_2.isNotNull()
    of = lambda side: F.when(side_1 == side, first).when(side_2 == side, second)
    lone_debit = F.when(side_1 == "DEBIT", first).when(side_1.isNull() & (first < 0), -first)
    lone_credit = F.when(side_1 == "CREDIT", first).when(side_1.isNull() & (first >= 0), first)
    debit = F.when(n >= 3, F.when(marked, of("DEBIT")).otherwise(first)).otherwise(lone_debit)
    credit = F.when(n >= 3, F.when(marked, of("CREDIT")).otherwise(second)).otherwise(lone_credit)
    return debit, credit, F.when(n >= 3, third).when(n == 2, second)


def line_rows(lines: DataFrame) -> DataFrame:
    """Ledger rows of text lines (``file_id, line_no, line``): a line that begins with a date opens a row, others continue it.

    Each line gives its trailing money to the row and its other words to the description; lines before the first date are ignored.
    """
    rows = lines.filter(F.trim("line") != "").withColumn("line", F.trim("line"))
    part = lambda k: F.nullif(F.regexp_extract("line", DATE_LINE, k), F.lit(""))
    rows = rows.withColumns({"_date": part(1), "_value": part(2), "_rest": F.coalesce(part(3), F.col("line"))})
    order = Window.partitionBy("file_id").orderBy("line_no")
    rows = rows.withColumn("row_no", F.sum(F.col("_date").isNotNull().cast("int")).over(order)).filter("row_no > 0")
    tail = F.regexp_extract("_rest", rf"(?i)((?:(?:^|\s+){MONEY})+)\s*$", 1)
    rows = rows.withColumn("_tail", tail).withColumns(
        {"_money": F.regexp_extract_all("_tail", F.lit(rf"(?i)({MONEY})"), F.lit(1)), "_words": F.btrim(F.left(F.col("_rest"), F.length("_rest") - F.length("_tail")), F.lit(" -|:"))}
    )
    held = F.sort_array(F.collect_list(F.struct("line_no", "line", "_words", "_money")))
    joined = rows.groupBy("file_id", "row_no").agg(F.min("_date").alias("_date"), F.min("_value").alias("_value"), held.alias("_l"))
    joined = joined.withColumn("_m", F.flatten(F.transform("_l", lambda x: x["_money"])))
    debit, credit, balance = classified(F.col("_m"))
    words = F.array_join(F.filter(F.transform("_l", lambda x: x["_words"]), lambda w: w != ""), " ")
    return joined.select(
        "file_id", "row_no", parse_date(F.col("_date")).alias("transaction_date"), parse_date(F.col("_value")).alias("value_date"), F.nullif(words, F.lit("")).alias("description"),
        debit.alias("debit"), credit.alias("credit"), balance.alias("balance"), F.array_join(F.transform("_l", lambda x: x["line"]), " | ").alias("raw_text"),
    )


def bank_name(text: Column) -> Column:
    chain = None
    for pattern, name in BANKS:
        hit = text.rlike("(?i)" + pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def opening_balance(text: Column) -> Column:
    found = [F.nullif(F.regexp_extract(text, rf"(?is){p}.{{0,40}}?([\d,]+\.\d{{2}})", 1), F.lit("")) for p in OPENING]
    return parse_amount(F.coalesce(*found))


#: How a statement's head names the holder and the account.
HOLDER = r"(?i)(?:A/?C\s*(?:Holder|Name)|Name\s*of\s*(?:A/?C|Account\s*Holder)|Account\s*Holder(?:'s)?\s*Name|Name)\s*[:.\-]\s*([A-Za-z][A-Za-z .'\-]{2,60})"
ACCOUNT = r"(?i)(?:A/?C|Account)(?:\s*(?:No|Number|Num|#))?\s*[:.\-]?\s*([Xx*]{2,}\s*\d{3,4}|\d{6,18})"


def account_details(text: Column) -> tuple[Column, Column]:
    """Holder and masked account named in a statement's head."""
    named = F.lower(text)  # the search goes over every place of a head, so it is left to heads with the word
    named = named.contains("name") | named.contains("holder")
    holder = F.when(named, F.nullif(F.btrim(F.regexp_extract(text, HOLDER, 1), F.lit(" .,-")), F.lit("")))
    digits = F.regexp_replace(F.regexp_extract(text, ACCOUNT, 1), r"\D", "")
    return holder, F.when(F.length(digits) >= 5, F.concat(F.lit("XXXX"), F.right(digits, F.lit(4))))


def _details(text: DataFrame, before: Column) -> DataFrame:
    """What a head (``file_id, _head``) names, and the opening balance in the column ``before``."""
    text = computed(text.select("file_id", "_head", before.alias("_before")), {"bank_name": bank_name(F.col("_head")), "opening_balance": opening_balance(F.col("_before"))})
    holder, account = account_details(F.col("_head"))
    return text.select("file_id", "bank_name", holder.alias("account_holder"), account.alias("account"), "opening_balance")


def heads(files: DataFrame) -> DataFrame:
    """``file_id, bank_name, account_holder, account, opening_balance`` from what stands before a text file's first dated line."""
    text = files.select("file_id", decode(F.col("content")).alias("text"))
    return _details(text.withColumn("_head", F.left("text", F.lit(4000))), F.regexp_extract("text", rf"(?ms)\A(.*?)^[ \t]*{DATE}\b", 1))


def table_heads(cells: DataFrame) -> DataFrame:
    """The same from the first 20 rows of a file's first table (``file_id, part, row_no, cells``)."""
    order = Window.partitionBy("file_id").orderBy("_order", "row_no")
    top = cells.withColumn("_order", F.abs("part")).withColumn("_n", F.row_number().over(order)).filter("_n <= 20")
    held = top.groupBy("file_id").agg(F.min("_order").alias("_order"), F.sort_array(F.collect_list(F.struct("_order", "row_no", F.array_join("cells", " ").alias("line")))).alias("_l"))
    lines = F.transform(F.filter("_l", lambda x: x["_order"] == F.col("_order")), lambda x: x["line"])
    return _details(held.select("file_id", F.array_join(lines, "\n").alias("_head")), F.col("_head"))


def ledger_rows(cells: DataFrame, openings: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Reconciled ledger rows with money, of many files at once. ``openings``: ``file_id, opening_balance``; ``found``: their layouts, if known."""
    typed = layout.typed_rows(cells, layout.layouts(cells) if found is None else found)
    if openings is None:
        typed = typed.withColumn("opening_balance", F.lit(None).cast("decimal(14,2)"))
    else:
        typed = typed.join(openings.select("file_id", "opening_balance"), "file_id", "left")
    return reconcile.with_money(reconcile.reconcile(typed))


def carried(found: DataFrame, tables: DataFrame) -> DataFrame:
    """Layouts of the tables of pages (``file_id``: file and a part below 0, -1 the first table): one without a header takes that of the last table before it that has one."""
    order = Window.partitionBy("file_id.file_id").orderBy(F.desc("file_id.part"))
    own = tables.select("file_id").distinct().join(found, "file_id", "left")
    columns = [c for c in found.columns if c != "file_id"]
    named = F.last(F.when(F.col("source") == "header", F.struct(*[F.lit(0).alias(c) if c == "first_row" else F.col(c) for c in columns])), ignorenulls=True).over(order)
    own = own.withColumn("_l", F.when(F.col("source") == "header", F.struct(*columns)).otherwise(F.coalesce(named, F.struct(*columns))))
    return own.select("file_id", "_l.*").filter("source is not null")


POSITIONAL = "No header row was found; columns were taken from what the cells look like."
NO_READER, NO_COLUMNS, NO_ROWS = "no reader for this kind of file", "columns could not be found", "no transactions found"


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger rows of all files that can be read, and a report on every file.

    ``files``: ``file_id, name, content, size``. Report: ``file_id, name, kind, bank_name, account_holder, account, opening_balance,
    n_rows, warnings, error`` (null: read). One bad file leaves the others as they are. Of a workbook, the first sheet with ledger rows counts;
    the tables of a page are one statement, each with its own columns or those of the last header before it.
    """
    checked = checkpointed(validated(spread(files, "file_id")))  # files may be costly to make, and each step below starts from them
    good = checked.filter("error is null")
    kinds = {r.kind for r in good.select("kind").distinct().collect()}  # a few names; what no file needs costs no plan
    texts, tables = good.filter("kind = 'csv'"), good.filter("kind = 'html'")
    # Parts: 0 for texts, from 1 on for sheets, from -1 downwards for the tables of a page.
    cells = csv_cells(texts).select("file_id", F.lit(0).alias("part"), "row_no", "cells")
    if "html" in kinds:
        cells = cells.unionByName(html_cells(tables).select("file_id", (-1 - F.col("table_no")).alias("part"), "row_no", "cells"))
    broken = None
    if "xlsx" in kinds:
        sheets = checkpointed(workbooks.sheet_cells(good.filter("kind = 'xlsx'")))
        broken = sheets.filter("error is not null").select("file_id", F.col("error").alias("_broken"))
        cells = cells.unionByName(workbooks.readable(sheets))
    # Layouts and running balances are those of a table: its key stands for the file's until its rows are known.
    keyed = checkpointed(spread(cells.select(F.struct("file_id", "part").alias("file_id"), "row_no", "cells"), "file_id"))
    details = heads(texts)
    if kinds & {"html", "xlsx"}:
        others = keyed.filter("file_id.part <> 0").select("file_id.*", "row_no", "cells")
        details = details.unionByName(table_heads(spread(others, "file_id")))
    details = checkpointed(details)
    part = F.col("file_id.part")
    found = checkpointed(layout.layouts(keyed))
    if "html" in kinds:
        found = found.filter(part >= 0).unionByName(carried(found.filter(part < 0), keyed.filter(part < 0)))
    # A file's opening balance goes with its layout, so that the rows themselves meet no second table.
    opening = details.select(F.col("file_id").alias("_file"), "opening_balance")
    found = checkpointed(found.withColumn("_file", F.col("file_id.file_id")).join(opening, "_file", "left").drop("_file"))
    one = F.struct(F.col("file_id.file_id").alias("file_id"), F.greatest(part, F.lit(0)).alias("part"))  # the tables of a page
    typed = layout.typed_rows(keyed, found, "opening_balance").withColumn("file_id", one)
    rows = checkpointed(reconcile.with_money(reconcile.reconcile(typed)))
    if "xlsx" in kinds:
        first = rows.filter(part > 0).groupBy(F.col("file_id.file_id").alias("f")).agg(F.min(part).alias("part")).select(F.struct(F.col("f").alias("file_id"), "part").alias("file_id"))
        rows = rows.filter(part == 0).unionByName(rows.filter(part > 0).join(first, "file_id", "left_semi"))
    said = rows.groupBy("file_id").agg(F.count("*").alias("n_rows")).join(reconcile.warnings(rows).withColumnRenamed("warnings", "_balance"), "file_id", "left")
    plain = lambda df: df.withColumn("file_id", F.col("file_id.file_id"))
    # The layout of the table that counts, else that of the first table that has one.
    named = found.withColumn("file_id", one).join(said.select("file_id", "n_rows"), "file_id", "left").groupBy(F.col("file_id.file_id").alias("file_id")).agg(F.min_by("source", F.struct(F.col("n_rows").isNull(), part)).alias("source"))
    report = checked.drop("content", "size").join(details, "file_id", "left").join(named, "file_id", "left").join(plain(said), "file_id", "left")
    report = report.join(broken, "file_id", "left") if broken is not None else report.withColumn("_broken", F.lit(None).cast("string"))
    notes = F.concat(F.array_compact(F.array(F.when(F.col("source") == "positional", POSITIONAL))), F.coalesce("_balance", F.array().cast("array<string>")))
    read = F.col("kind").isin("csv", "html", "xlsx")
    error = F.coalesce("error", "_broken", F.when(~read, NO_READER).when(F.col("source").isNull(), NO_COLUMNS).when(F.col("n_rows").isNull(), NO_ROWS))
    return plain(rows), report.select("file_id", "name", "kind", "bank_name", "account_holder", "account", "opening_balance", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), notes.alias("warnings"), error.alias("error"))
