"""Dates of statement cells, day first, by a small grammar.

A cell is cut to words, what carries no date (weekday, time of day, ordinal endings) dropped, and the classes of what is left (day or month number, month name, year)
pick one reading; one conversion then checks the calendar. No list of formats is tried one after another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIAL_FROM, SERIAL_TO = 20000, 80000
#: Month names; any beginning of three letters or more will do.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
TIME = r"(^|[ t,])\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?\s*([ap]\.?m\.?)?\s*(z|utc|gmt|ist)?([+-]\d{2}:?\d{2})?$"
WEEKDAY = r"^(mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(day)?[.,]*\s+"
#: How most dates are written; these need no words.
PLAIN, ISO = r"^\d{2}[-/.]\d{2}[-/.][1-9]\d{3}\z", r"^[1-9]\d{3}-\d{2}-\d{2}\z"
#: No serial: a part of a day in one or two digits, as in amounts.
BROKEN = r"\.(?:[1-9]\d?|0[1-9])\z"
#: What no date without a time of day holds: more digits than a year has, or letters that begin neither a month nor a weekday.
NO_DATE = rf"(?i)\d{{5}}|(?<![a-z])(?!{'|'.join(name[:3] for name in MONTHS)}|mon|tue|wed|thu|fri|sat|sun)[a-z]{{3}}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _month(word: Column) -> Column:
    names = [name[:n] for name in MONTHS for n in range(3, len(name) + 1)]
    numbers = {n: 1 + next(i for i, name in enumerate(MONTHS) if name.startswith(n)) for n in names}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), word)


def _words(text: Column) -> Column:
    """The words that may make a date; none where digits are grouped by commas, as in amounts."""
    plain = F.regexp_replace(F.lower(text), r"\s+", " ")
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(plain, TIME, ""), WEEKDAY, "")), r"(\d)(st|nd|rd|th)\b", "$1")
    return F.when(~plain.rlike(r"\d,\d"), F.filter(F.split(F.regexp_replace(plain, r"\bof\b", " "), r"[-/., ']+"), lambda w: w != ""))


def _calendar(year: Column, month: Column, day: Column) -> Column:
    """The date, null where the calendar has none; two digits from 69 on belong to the last century."""
    number = year.try_cast("int")
    full = F.when(F.length(year) == 4, number).when(number > 68, 1900 + number).otherwise(2000 + number)
    return F.try_to_date(F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), month.cast("string"), day), "yyyy-M-d")


def _read(words: Column) -> Column:
    """A date of three words."""
    a, b, c = (F.get(words, F.lit(i)) for i in range(3))
    short = lambda w: w.rlike(r"^\d{1,2}$")
    year = lambda w: w.rlike(r"^(\d{2}|\d{4})$")
    whole = lambda w: w.rlike(r"^\d{4}$")
    swapped = (b.try_cast("int") > 12) & (a.try_cast("int") <= 12)
    named_b = lambda use: _let(_month(b), use)
    return (
        F.when(short(a) & short(b) & year(c), _calendar(c, F.when(swapped, a).otherwise(b), F.when(swapped, b).otherwise(a)))
        .when(whole(a) & short(b) & short(c), _calendar(a, b, c))
        .when(short(a) & year(c), named_b(lambda m: F.when(m.isNotNull(), _calendar(c, m, a))))
        .when(short(b) & whole(c), _let(_month(a), lambda m: F.when(m.isNotNull(), _calendar(c, m, b))))
        .when(whole(a) & short(c), named_b(lambda m: F.when(m.isNotNull(), _calendar(a, m, c))))
    )


def _serial(text: Column) -> Column:
    number = F.regexp_replace(text, ",", "").try_cast("double")
    return _let(number, lambda n: F.when(n.between(SERIAL_FROM, SERIAL_TO) & (n == F.floor(n)), F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int"))))


def _spelled(text: Column) -> Column:
    """The date of a trimmed text in any of the forms."""
    likely = text.rlike(r"\d")
    worded = likely & (F.length(text) <= 64) & (text.contains(":") | ~text.rlike(NO_DATE))
    return F.when(likely & text.rlike(r"^[\d.,]+$") & ~text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{2,4}$"), F.when(~text.rlike(BROKEN), _serial(text))).when(worded, _let(_words(text), lambda w: F.when(F.size(w) == 3, _read(w))))


def parse_date(cell: Column) -> Column:
    """Date or null: spreadsheet serials, and days with month and year in any usual order and spelling; never a guess."""
    text = F.trim(cell.cast("string"))
    a, b, year = F.substring(text, 1, 2), F.substring(text, 4, 2), F.substring(text, 7, 4)
    swapped = (b > "12") & (a <= "12")
    plain = F.concat_ws("-", year, F.when(swapped, a).otherwise(b), F.when(swapped, b).otherwise(a)).try_cast("date")
    return F.when(text.rlike(PLAIN), plain).when(text.rlike(ISO), text.try_cast("date")).otherwise(_spelled(text))


def parse_partial_date(cell: Column, as_of: Column) -> Column:
    """``date, complete``: as ``parse_date``; where the year or the day is missing it is that of ``as_of``, and ``complete`` is false."""

    def two(words: Column) -> Column:
        a, b = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        day = F.coalesce(F.when(a.rlike(r"^\d{1,2}$"), a), F.when(b.rlike(r"^\d{1,2}$"), b))
        month = F.coalesce(_month(a), _month(b))
        this_year = F.year(as_of).cast("string")
        year = F.when(b.rlike(r"^\d{4}$"), b)
        first = _calendar(year, month, F.lit("1"))
        of_month = F.least(F.date_add(first, F.dayofmonth(as_of) - 1), F.last_day(first))
        return F.when(month.isNotNull(), F.when(year.isNotNull(), of_month).otherwise(_calendar(this_year, month, day)))

    partial = _let(_words(F.trim(cell.cast("string"))), lambda w: F.when(F.size(w) == 2, two(w)))
    return _let(parse_date(cell), lambda d: F.struct(F.coalesce(d, partial).alias("date"), d.isNotNull().alias("complete")))
