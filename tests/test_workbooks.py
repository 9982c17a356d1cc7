import datetime
import io
import zipfile
from decimal import Decimal

import pyarrow as pa
import pytest
from ledgerline.operators import layout
from ledgerline.plans.session import spread
from ledgerline.plans.workbook_queries import TITLES, container
from ledgerline.sources import files, workbooks


def changed(content: bytes, part: str, old: str, new: str) -> bytes:
    """The workbook with a text of one part replaced."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(out, "w") as b:
        for name in a.namelist():
            text = a.read(name).decode()
            assert name != part or old in text
            b.writestr(name, text.replace(old, new) if name == part else text)
    return out.getvalue()


def table(spark, contents: dict[str, bytes]):
    return spark.createDataFrame([(i, n, bytearray(c), len(c)) for i, (n, c) in enumerate(contents.items())], "file_id long, name string, content binary, size long")


@pytest.mark.parametrize(("raw", "text"), [("5", "5"), ("5.0", "5"), ("-0.50", "-0.5"), ("1E3", "1000"), ("1.5E-7", "0.00000015"), ("12345678901234567890", "12345678901234567890")])
def test_numbers(raw, text):
    assert workbooks.number_text(raw) == text


@pytest.mark.parametrize(("serial", "text"), [(45901, "2025-09-01"), (45901.5, "2025-09-01T12:00:00"), (0.25, "06:00:00"), (1, "1900-01-01"), (59, "1900-02-28"), (61, "1900-03-01"), (45900.9999999, "2025-09-01")])
def test_serial_days(serial, text):
    assert workbooks.serial_text(serial) == text


def test_days_since_1904():
    assert workbooks.serial_text(0.5, True) == "12:00:00" and workbooks.serial_text(44439, True) == "2025-09-01"


@pytest.mark.parametrize(("code", "is_date"), [("dd\\-mmm\\-yyyy", True), ("[h]:mm", True), ("General", False), ('0.00" days"', False), ("[Red]#,##0.00", False), ("[$-409]d/m/yy;@", True), ('"Rs" #,##0;\\d0', False)])
def test_formats_that_show_days(code, is_date):
    assert workbooks._is_date_format(code) is is_date


def test_cells(spark):
    day = datetime.date(2025, 9, 1)
    rows = [["a <b> & c", None, day, 7.50, 5.0], [], [None, None, "  kept "]]
    plain = container([rows])
    kinds = changed(container([[["x"]]], shared=False), "xl/worksheets/sheet1.xml", '<c r="A1" t="inlineStr"><is><t xml:space="preserve">x</t></is></c>', '<c r="A1" t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c r="D1" t="str"><f>1+1</f><v>two</v></c><c r="AA1"/><c><f>2</f><v>2</v></c>')
    sent = {"a": plain, "b": container([rows], shared=False, from_1904=True), "c": kinds, "d": container([[], []])}
    got = {(r.file_id, r.part, r.row_no): r.cells for r in workbooks.readable(workbooks.sheet_cells(table(spark, sent))).collect()}
    first = ["a <b> & c", None, "2025-09-01", "7.5", "5"]
    assert got == {(0, 1, 0): first, (0, 1, 2): [None, None, "  kept "], (1, 1, 0): first, (1, 1, 2): [None, None, "  kept "], (2, 1, 0): ["True", "#N/A", None, "two", *[None] * 23, "2"]}


def test_broken_workbooks(spark, monkeypatch):
    good = container([[["x"]]] * 2)
    late = changed(good, "xl/worksheets/sheet2.xml", "</sheetData>", "")  # the first sheet is whole
    sent = {
        "no part": changed(good, "xl/_rels/workbook.xml.rels", "worksheets/sheet1.xml", "worksheets/sheet9.xml"), "late": late, "cut": good[:-30], "empty": b"", "string": changed(good, "xl/worksheets/sheet1.xml", "<v>0</v>", "<v>9</v>"),
        "column": changed(good, "xl/worksheets/sheet1.xml", 'r="A1"', 'r="ZZZZ1"'), "fine": good,
    }
    sheets = workbooks.sheet_cells(table(spark, sent)).collect()
    assert {r.file_id: r.error for r in sheets if r.error} == dict.fromkeys(range(6), workbooks.BROKEN)
    assert {(r.file_id, r.part) for r in workbooks.readable(workbooks.sheet_cells(table(spark, sent))).collect()} == {(6, 1), (6, 2)}
    monkeypatch.setattr(workbooks, "MAX_UNPACKED", 100)
    with pytest.raises(workbooks._TooLarge):
        workbooks.Workbook(good)


def test_first_sheet_with_rows(spark):
    day = datetime.date(2025, 9, 1)
    row = lambda d, left: [[d, "x", None, 10, None, left]]
    notes, head = [["HDFC BANK", "notes"]], [list(TITLES)]
    sent = {
        "second.xlsx": container([notes, head + row(day, 90), head + row(day, 80)]), "headless.xlsx": container([row(day, 90) + row(day, 80)]), "none.xlsx": container([notes]),
        "cut.xlsx": container([head + row(day, 90)])[:200], "plain.csv": b"Date,Narration,Withdrawal (INR),Deposit (INR),Closing Balance\n01-09-2025,x,5.00,,1.00\n",
    }
    rows, report = files.parsed(table(spark, sent))
    assert sorted((r.file_id, r.debit, r.balance) for r in rows.collect()) == [(0, Decimal(10), Decimal(90)), (1, Decimal(10), Decimal(80)), (1, Decimal(10), Decimal(90)), (4, Decimal(5), Decimal(1))]
    said = {r.name: (r.bank_name, r.n_rows, r.error) for r in report.collect()}
    assert said == {"second.xlsx": ("HDFC Bank", 1, None), "headless.xlsx": (None, 2, None), "none.xlsx": ("HDFC Bank", 0, files.NO_COLUMNS), "cut.xlsx": (None, 0, workbooks.BROKEN), "plain.csv": (None, 1, None)}


def test_tables_inside_tables(spark):
    page = b"<table><tr><td>a<table><TR><th>in</th><td>ner</td></tr></table>b</td><td>&lt;5</td></tr><tr><td>open<td>cells<tr><td></td></table><tr><td>outside</td></tr><table><tr><tdx>no cell</tr><tr><td/>late</table>"
    got = {(r.table_no, r.row_no): r.cells for r in files.html_cells(table(spark, {"a.xls": page, "b.xls": b"no table"})).collect()}
    assert sorted(got.values()) == sorted([["ab", "<5"], ["in", "ner"], ["open", "cells"], [""], ["outside"], ["late"]])
    assert len({t for t, _ in got}) == 4 and len(got) == 6


def test_many_files_in_a_batch(spark):
    """Broken files between whole ones, and cells handed on in the middle of a file, leave the others as they are."""
    good = container([[["x"], ["y"]]])
    wide = container([[["z"] * 9] * 3])
    late = changed(container([[["x"]]] * 2), "xl/worksheets/sheet2.xml", "</sheetData>", "")
    contents = [good, late, wide, b"", good, wide]
    batch = pa.RecordBatch.from_pydict({"file_id": list(range(6)), "content": contents})
    for held in (1, 10, workbooks.HELD_CELLS):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(workbooks, "HELD_CELLS", held)
            handed = list(workbooks._cells(iter([batch])))
        rows = [r for b in handed for r in b.to_pylist()]
        bad = {r["file_id"] for r in rows if r["error"]}
        assert bad == {1, 3}
        assert [(r["file_id"], r["row_no"], len(r["cells"])) for r in rows if r["file_id"] not in bad] == [(0, 0, 1), (0, 1, 1), (2, 0, 9), (2, 1, 9), (2, 2, 9), (4, 0, 1), (4, 1, 1), (5, 0, 9), (5, 1, 9), (5, 2, 9)]
    assert len(handed) == 1


def test_large_parts_are_read_element_by_element(monkeypatch):
    content = container([[["x", 1.5], [], [None, "y"]]])
    whole = workbooks.Workbook(content)
    monkeypatch.setattr(workbooks, "MAX_TREE", 0)
    parted = workbooks.Workbook(content)
    assert list(whole.rows(whole.sheets[0])) == list(parted.rows(parted.sheets[0])) == [(0, ["x", "1.5"]), (1, []), (2, [None, "y"])]


def test_work_is_dealt_to_all_cores(spark):
    """Workbooks that take little room are not read by one task."""
    sent = table(spark, {f"{i}.xlsx": container([[[str(i)]]]) for i in range(64)})
    assert spread(sent, "file_id").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_header_names_by_precedence():
    """Each key against the rule spelled out: an alias, else an alias with an ending, earlier endings first."""
    aliases = {alias: field for field, line in layout.ALIASES.items() for alias in line.split()}
    told = lambda key: next((aliases[k] for k in [key] + [key[: -len(e)] for e in layout.ENDINGS if key.endswith(e)] if k in aliases), None)
    names = layout._header_names()
    assert all(told(k) == f for k, f in names.items()) and len(names) > len(aliases) * len(layout.ENDINGS) / 2
