"""Running-balance reconciliation with window functions.

Only ``balance`` feeds the next row's comparison and no rule changes it, so the pass over a file is a window: the last balance
before the row, or the file's opening balance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Narration marks of either side.
DEBIT_MARKS = ("WDL", "WITHDRAWAL", "DRAWN", "DR/", "/DR/", " DEBIT", "PAID TO", "TRANSFER TO", "CASH WDL")
CREDIT_MARKS = ("DEP", "DEPOSIT", "CR/", "/CR/", " CREDIT", "RECEIVED FROM", "CREDITED", "REFUND")


def narration_side(description: Column) -> Column:
    text = F.upper(F.coalesce(description, F.lit("")))
    any_of = lambda marks: text.rlike("|".join(marks))
    return F.when(any_of(DEBIT_MARKS) & ~any_of(CREDIT_MARKS), "DEBIT").when(any_of(CREDIT_MARKS) & ~any_of(DEBIT_MARKS), "CREDIT")


def reconcile(rows: DataFrame) -> DataFrame:
    """Corrected ``debit`` and ``credit`` of ``file_id, row_no, description, debit, credit, balance, opening_balance``.

    Adds ``corrected`` (count for the row), ``recovered`` and ``cleared``.
    """
    in_file = Window.partitionBy("file_id")
    before = in_file.orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    money = "decimal(14,2)"
    prior = F.coalesce(F.last("balance", ignorenulls=True).over(before), F.col("opening_balance"))
    df = rows.withColumns({"_prior": prior, "cleared": F.coalesce((F.col("debit") == 0).cast("int"), F.lit(0)) + F.coalesce((F.col("credit") == 0).cast("int"), F.lit(0))})
    df = df.withColumns({"_d0": F.when(F.col("debit") != 0, F.col("debit")), "_c0": F.when(F.col("credit") != 0, F.col("credit")), "_delta": F.col("balance") - F.col("_prior")})
    # A negative amount alone on its side belongs to the other one; the second test sees what the first has done.
    turn = F.coalesce((F.col("_d0") < 0) & F.col("_c0").isNull(), F.lit(False))
    df = df.withColumns({"_d1": F.when(~turn, F.col("_d0")), "_c1": F.when(turn, -F.col("_d0")).otherwise(F.col("_c0")), "_t1": turn.cast("int")})
    turn = F.coalesce((F.col("_c1") < 0) & F.col("_d1").isNull(), F.lit(False))
    df = df.withColumns({"_d": F.when(turn, -F.col("_c1")).otherwise(F.col("_d1")), "_c": F.when(~turn, F.col("_c1")), "_t2": turn.cast("int")})
    d, c, delta = F.col("_d"), F.col("_c"), F.col("_delta")
    near = lambda a: F.coalesce(F.abs(a - delta) <= F.lit("0.01").cast(money), F.lit(False))
    moved = delta.isNotNull() & (delta != 0)
    debit_ok, credit_ok = near(-d), near(c)
    both, only_d, only_c = d.isNotNull() & c.isNotNull(), d.isNotNull() & c.isNull(), d.isNull() & c.isNotNull()
    side = narration_side(F.col("description"))
    leading = F.col("_prior").isNull() & (d.isNotNull() | c.isNotNull())
    told = ((side == "DEBIT") & d.isNull()) | ((side == "CREDIT") & c.isNull())
    action = (
        F.when(moved & both & credit_ok & ~debit_ok, "keep_credit")
        .when(moved & both & debit_ok & ~credit_ok, "keep_debit")
        .when(moved & only_d & ~debit_ok & near(d), "flip")
        .when(moved & only_c & ~credit_ok & near(-c), "flip")
        .when(moved & d.isNull() & c.isNull(), "recover")
        .when(moved, "none")
        .when(leading & F.coalesce(told, F.lit(False)), "told")
        .when(leading, "open")
        .otherwise("none")
    )
    df = df.withColumn("_action", action)
    proven = F.col("_action").isin("keep_credit", "keep_debit", "flip")
    flips = F.sum(proven.cast("int")).over(in_file)
    verifiable = F.sum(moved.cast("int")).over(in_file)
    swapped = (F.col("_action") == "open") & (flips >= 2) & (flips * 2 >= verifiable)
    df = df.withColumn("_flip", F.col("_action").isin("flip", "told") | swapped)
    # A flip moves the debit over; only without one does the credit move back.
    new_debit = F.when(F.col("_flip"), F.when(d.isNull(), c)).when(F.col("_action") == "keep_credit", None).when((F.col("_action") == "recover") & (delta < 0), -delta).otherwise(d)
    new_credit = F.when(F.col("_flip"), d).when(F.col("_action") == "keep_debit", None).when((F.col("_action") == "recover") & (delta > 0), delta).otherwise(c)
    out = df.withColumns(
        {
            "debit": new_debit.cast(money),
            "credit": new_credit.cast(money),
            "corrected": F.col("_t1") + F.col("_t2") + (proven | F.col("_flip")).cast("int"),
            "recovered": (F.col("_action") == "recover").cast("int"),
        }
    )
    return out.select(*rows.columns, "corrected", "recovered", "cleared")


def warnings(reconciled: DataFrame) -> DataFrame:
    """``file_id, warnings``: what the pass has changed, per file."""
    sums = reconciled.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in ("corrected", "recovered", "cleared")])
    said = [
        ("corrected", "Running balance corrected the direction of %d transaction(s)."),
        ("recovered", "Recovered %d missing amount(s) from the running balance."),
        ("cleared", "Ignored %d zero-amount placeholder cell(s)."),
    ]
    return sums.select("file_id", F.array_compact(F.array(*[F.when(F.col(c) > 0, F.format_string(m, c)) for c, m in said])).alias("warnings"))


def with_money(rows: DataFrame) -> DataFrame:
    return rows.filter("debit is not null or credit is not null")
