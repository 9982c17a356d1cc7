"""Filters, search, scope and listings over the ledger. Filters combine as columns, so Catalyst pushes them into the scans."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.ledger import Ledger

#: Fixed values. "UPI" in a question means the rail: the apps that use it count, likewise among bank transfers.
METHOD_FAMILY = {
    "UPI": ("UPI", "PAYTM", "GOOGLE_PAY", "PHONEPE"),
    "NEFT": ("NEFT", "IMPS", "RTGS", "BANK_TRANSFER"),
    "IMPS": ("IMPS", "NEFT", "RTGS", "BANK_TRANSFER"),
    "RTGS": ("RTGS", "NEFT", "IMPS", "BANK_TRANSFER"),
    "BANK_TRANSFER": ("BANK_TRANSFER", "NEFT", "IMPS", "RTGS"),
}


@dataclass(frozen=True)
class TransactionFilter:
    """None: no filter. ``person_ids=[]``: rows without a counterparty; ``statement_ids=[]``: no rows."""

    statement_ids: list[int] | None = None
    person_ids: list[int] | None = None
    date_from: datetime.date | None = None
    date_to: datetime.date | None = None
    month_ranges: list[tuple[datetime.date, datetime.date]] | None = None
    payment_method: str | None = None
    payment_methods: tuple[str, ...] | None = None
    direction: str | None = None
    status: str | None = None

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.statement_ids is not None:
            out = out & (F.col("statement_id").isin(self.statement_ids) if self.statement_ids else F.lit(False))
        if self.person_ids is not None:
            out = out & (F.col("counterparty_id").isin(self.person_ids) if self.person_ids else F.col("counterparty_id").isNull())
        if self.date_from:
            out = out & (F.col("transaction_date") >= F.lit(self.date_from))
        if self.date_to:
            out = out & (F.col("transaction_date") <= F.lit(self.date_to))
        if self.month_ranges:
            spans = F.lit(False)
            for start, end in self.month_ranges:
                spans = spans | F.col("transaction_date").between(F.lit(start), F.lit(end))
            out = out & spans
        if self.payment_methods:
            out = out & F.col("payment_method").isin(*self.payment_methods)
        elif self.payment_method:
            out = out & (F.col("payment_method") == self.payment_method.upper())
        for name, value in (("transaction_type", self.direction), ("matching_status", self.status)):
            if value:
                out = out & (F.col(name) == value.upper())
        return out


def apply(rows: DataFrame, wanted: TransactionFilter) -> DataFrame:
    return rows.filter(wanted.predicate())


def latest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("transaction_date"), F.desc("id"))


def page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return latest_first(rows).offset(offset).limit(limit)


#: The columns of a row that free text is looked for in.
SEARCHED = ("counterparty_name", "normalized_counterparty_name", "upi_id", "normalized_upi_id", "reference_number", "description", "raw_text")


def free_text(ledger: Ledger, rows: DataFrame, text: str) -> DataFrame:
    """Rows whose own texts, or whose counterparty's name, code or identifiers, contain the text (case ignored)."""
    needle = F.lit(text.lower())
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle)
    named = ledger.people.filter(has("canonical_name") | has("code")).select(F.col("id").alias("counterparty_id"))
    known = ledger.identifiers.filter(has("value")).select(F.col("person_id").alias("counterparty_id"))
    people = named.union(known).distinct().withColumn("_hit", F.lit(True))
    own = F.lit(False)
    for c in SEARCHED:
        own = own | has(c) if c in rows.columns else own  # a ledger may lack the raw columns
    return rows.join(people, "counterparty_id", "left").filter(own | F.coalesce("_hit", F.lit(False))).drop("_hit")


def by_person(ledger: Ledger, rows: DataFrame, person: str) -> DataFrame:
    """Rows of the person with this code, or this number as id."""
    wanted = F.col("code") == person.upper()
    if person.isdigit():
        wanted = wanted | (F.col("id") == int(person))
    return rows.join(ledger.people.filter(wanted).select(F.col("id").alias("counterparty_id"), "code", "canonical_name"), "counterparty_id")


def statement_scope(ledger: Ledger, user_id: int, ids: list[int] | None = None, banks: list[str] | None = None) -> DataFrame:
    """``id`` of the user's statements among the ids or of the banks."""
    wanted = F.lit(False)
    if ids:
        wanted = wanted | F.col("id").isin(ids)
    if banks:
        wanted = wanted | F.lower("bank_name").isin([b.lower() for b in banks])
    return ledger.statements.filter((F.col("user_id") == user_id) & wanted).select("id")


def owned_people(ledger: Ledger, user_id: int) -> DataFrame:
    mine = ledger.owned(user_id).select(F.col("counterparty_id").alias("id"))
    return ledger.people.join(mine, "id", "left_semi")


def search_people(ledger: Ledger, user_id: int, text: str) -> DataFrame:
    needle = F.lit(text.lower())
    held = ledger.identifiers.filter(F.lower("value").contains(needle)).select(F.col("person_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    people = owned_people(ledger, user_id).join(held, "id", "left")
    return people.filter(F.lower("canonical_name").contains(needle) | F.lower("code").contains(needle) | F.coalesce("_hit", F.lit(False))).drop("_hit")


def widened(rows: DataFrame, method: str) -> DataFrame:
    """Rows of the method; only if there are none, rows of its family. One pass: the exact rows win by rank."""
    family = METHOD_FAMILY.get(method, (method,))
    held = rows.filter(F.col("payment_method").isin(*family)).withColumn("_exact", (F.col("payment_method") == method).cast("int"))
    best = held.agg(F.max("_exact").alias("_best"))
    return held.join(F.broadcast(best), F.col("_exact") == F.col("_best")).drop("_exact", "_best")  # one row
