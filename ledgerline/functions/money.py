"""Money as exact decimals: statement cells to ``decimal(14,2)``, half-even like a ledger."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = r"(?i)\s*\b(dr|cr|debit|credit)\b\.?\s*$"
CURRENCY = r"(?i)(?:₹|rs\.?|inr)\s*"
BLANK = ("", "-", "--", "N/A", "n/a")
#: How most amounts are written; and what none holds: letters of no mark or currency, a sign between digits, or no digit at all.
PLAIN = r"^-?\d{1,12}(?:\.\d{1,2})?\z"
NO_AMOUNT = r"^\D*\z|[A-Za-z&&[^BCDEINRSTbcdeinrst]]|\d[-/:]\d"


def _marked(text: Column) -> Column:
    """The amount of a trimmed text in any of the forms."""
    enclosed = text.startswith("(") & text.endswith(")")
    body = F.when(enclosed, F.regexp_replace(text, r"^\(|\)$", "")).otherwise(text)
    body = F.regexp_replace(F.regexp_replace(F.trim(body), SIDE, ""), CURRENCY, "")
    body = F.regexp_replace(body, r"[, ]", "")
    negative = enclosed | body.rlike(r"^\+?-|-$")
    digits = F.regexp_extract(body, r"^\+?-?((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)-?$", 1)
    # Rounded before the cast, which would round half up.
    number = F.bround(digits.try_cast("decimal(30,10)"), 2).try_cast("decimal(14,2)")
    return F.when(~text.isin(*BLANK) & ~text.rlike(NO_AMOUNT), number * F.when(negative, -1).otherwise(1)).cast("decimal(14,2)")


def parse_amount(cell: Column) -> Column:
    """``decimal(14,2)`` or null. Accepts currency marks, thousands commas, Dr/Cr, parentheses and leading or trailing signs."""
    text = F.trim(cell.cast("string"))
    return F.when(text.rlike(PLAIN), text.try_cast("decimal(14,2)")).otherwise(_marked(text))


def amount_side(cell: Column) -> Column:
    """``DEBIT`` or ``CREDIT`` where the cell says so."""
    mark = F.lower(F.regexp_extract(F.trim(cell.cast("string")), SIDE, 1))
    return F.when(mark.startswith("d"), "DEBIT").when(mark.startswith("c"), "CREDIT")


def format_amount(amount: Column) -> Column:
    return F.format_number(F.coalesce(amount, F.lit(0)), 2)
