"""Questions about the ledger: what they ask (as columns over a table of questions), whom they mean, and exact answers.

Nothing is guessed: totals come from aggregates over the filtered rows, several possible people are named as such, and a
question without rows gets the refusal.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.steps import computed
from ledgerline.functions.text import search_tokens
from ledgerline.operators import filters
from ledgerline.plans.ledger import Ledger

#: Phrases that name a payment method, in order of precedence.
METHOD_PHRASES = [
    ("google pay", "GOOGLE_PAY"), ("googlepay", "GOOGLE_PAY"), ("gpay", "GOOGLE_PAY"), ("phone pe", "PHONEPE"), ("phonepe", "PHONEPE"), ("paytm", "PAYTM"), ("bank transfer", "BANK_TRANSFER"), ("net banking", "BANK_TRANSFER"),
    ("netbanking", "BANK_TRANSFER"), ("upi", "UPI"), ("imps", "IMPS"), ("neft", "NEFT"), ("rtgs", "RTGS"), ("atm", "ATM"), ("card", "CARD"), ("cash", "CASH"),
]
#: Month names; three letters do, and September also shortens to four.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Words of a question that name its intent.
SENT = r"\b(send|sent|pay|paid|payout|gave|spent|spend|debit(?:ed)?)\b"
RECEIVED = r"\b(receive|received|got|refund|credit(?:ed)?)\b"
COUNT = r"\b(how many|count)\b"
LARGEST = r"\b(biggest|largest|highest|maximum|max)\b"
LIST = r"\b(show|list|find|display|give|which|what)\b"
BALANCE = r"\b(balance|closing|ending)\b"
TOP = r"(?s)(?:\b(?:who|whom)\b|\bwhich\s+(?:merchant|person|vendor|payee|recipient|account)\b).*\b(most|biggest|largest|highest|top)\b"
RELATIVE = r"\b(last|this|past|previous)\s+(month|year|week)\b"
YEAR = r"\b((?:19|20)\d{2})\b"
#: Words of a question that never name anybody.
STOPWORDS = (
    "show list find display all the my me i we with to from in on for during of and or please transaction transactions txn entry entries how much many did do does was were have has had what which who when where "
    "total totals amount amounts rs rupees inr sent send sent? pay paid payment payments receive received receives give gave get got spent spend spending between this that these those a an at by per into towards "
    "about overall recent recently last first only every each till until up down out off before after over under again showed possible make made made? there their them they been being will would should can could "
    "us via using use through transact transacted interact interacted involving related happened appeared is are am it its mine whom whether why then than because across let most more less least biggest largest "
    "highest lowest maximum max minimum min top money cash rupee credit credits debit debits balance closing ending merchant merchants vendor vendors shop shops store stores payee payees recipient recipients person "
    "people transfer transferred transfers purchase purchases buy bought order orders subscription subscriptions bill bills expense expenses cost costs shopping month months year years week weeks day days today "
    "yesterday tonight current previous past"
).split()
#: The answers without a figure.
INSUFFICIENT = "I couldn't determine this confidently from the available statement data."
AMBIGUOUS = "Multiple possible matches were found. Please review."
SEMANTIC_FLOOR = 0.35


def _month_names() -> dict[str, int]:
    names = {name: i for i, name in enumerate(MONTHS, 1)} | {name[:3]: i for i, name in enumerate(MONTHS, 1)}
    return names | {"sept": 9}


def profiles(questions: DataFrame, as_of: datetime.date, column: str = "question") -> DataFrame:
    """Adds ``payment_method, month, year, date_from, date_to, intent, direction, person_text, tokens``."""
    text = F.coalesce(F.col(column), F.lit(""))
    has_phrase = lambda p: F.lower(text).rlike(rf"\b{p}\b")
    phrase = F.coalesce(*[F.when(has_phrase(p), F.lit(p)) for p, _ in METHOD_PHRASES])
    df = computed(questions, {"_p": phrase})
    methods = F.create_map(*[F.lit(x) for pair in METHOD_PHRASES for x in pair])
    df = computed(
        df,
        {
            "payment_method": F.try_element_at(methods, "_p"),
            "_low": F.when(F.col("_p").isNull(), F.lower(text)).otherwise(F.replace(F.lower(text), F.col("_p"), F.lit(" "))),
            "_text": F.when(F.col("_p").isNull(), text).otherwise(F.regexp_replace(text, F.concat(F.lit(r"(?i)\b"), F.col("_p"), F.lit(r"\b")), F.lit(" "))),
        },
    )
    back = F.regexp_extract("_low", RELATIVE, 1) != "this"
    span = F.regexp_extract("_low", RELATIVE, 2)
    day = F.lit(as_of)
    at = F.when(back, F.add_months(day, -1)).otherwise(day)
    df = computed(
        df,
        {
            "_year": F.when(span == "month", F.year(at)).when(span == "year", F.year(day) - back.cast("int")),
            "_month": F.when(span == "month", F.month(at)),
            "date_from": F.when(span == "week", F.date_sub(day, 6)),
            "date_to": F.when(span == "week", day),
            "_low": F.regexp_replace("_low", RELATIVE, " "),
            "_text": F.regexp_replace("_text", "(?i)" + RELATIVE, " "),
        },
    )
    names = _month_names()
    pattern = r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")(?:\s+(\d{4}))?\b"
    numbers = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    named = F.try_element_at(numbers, F.regexp_extract("_low", pattern, 1))
    stated = F.nullif(F.regexp_extract("_low", pattern, 2), F.lit("")).try_cast("int")
    bare = F.when(F.col("_year").isNull(), F.nullif(F.regexp_extract("_low", YEAR, 1), F.lit("")).try_cast("int"))
    df = computed(df, {"_named": named, "_stated": stated, "_bare": F.when(named.isNull(), bare)})
    strip = lambda c, case: F.when(F.col("_named").isNotNull(), F.regexp_replace(c, case + pattern, " ")).when(F.col("_bare").isNotNull(), F.regexp_replace(c, YEAR, " ")).otherwise(F.col(c))
    df = computed(
        df,
        {"month": F.coalesce("_named", "_month"), "year": F.coalesce(F.when(F.col("_named").isNotNull(), F.coalesce("_stated", "_year")), "_year", "_bare"), "_low": strip("_low", ""), "_text": strip("_text", "(?i)")}
    )
    said = lambda p: F.col("_low").rlike(p)
    intent = (
        F.when(said(COUNT), "count").when(said(TOP), "top_counterparty").when(said(BALANCE), "balance").when(said(SENT) & said(RECEIVED), "overall_totals").when(said(LARGEST), "largest")
        .when(said(SENT), "total_sent").when(said(RECEIVED), "total_received").when(said(r"\b(who|whom)\b"), "counterparties").otherwise("list")
    )
    df = computed(df, {"intent": intent})
    direction = F.when(F.col("intent").isin("largest", "total_sent"), "DEBIT").when(F.col("intent") == "total_received", "CREDIT")
    direction = direction.when(F.col("intent") == "top_counterparty", F.when(said(RECEIVED), "CREDIT").otherwise("DEBIT"))
    quoted = F.trim(F.regexp_extract("_text", "[\"']([^\"']+)[\"']", 1))
    words = F.transform(F.regexp_extract_all("_text", F.lit(r"([A-Za-z][A-Za-z'.-]*)"), F.lit(1)), lambda w: F.btrim(w, F.lit("'.-")))
    never = F.array(*map(F.lit, [*STOPWORDS, *names, *[p for p, _ in METHOD_PHRASES]]))
    kept = F.array_join(F.filter(words, lambda w: (w != "") & ~F.array_contains(never, F.lower(w))), " ")
    person = F.nullif(F.lower(F.when(quoted != "", quoted).otherwise(kept)), F.lit(""))
    df = computed(df, {"direction": direction, "person_text": person})
    df = computed(df, {"tokens": search_tokens(F.coalesce("person_text", F.lit("")))})
    return df.select(*questions.columns, "payment_method", "month", "year", "date_from", "date_to", "intent", "direction", "person_text", "tokens")


@dataclass
class Answer:
    text: str
    intent: str
    notes: list[str] = field(default_factory=list)
    resolution: str = "none"
    people: list[str] = field(default_factory=list)
    totals: dict = field(default_factory=dict)
    rows: DataFrame | None = None


def ask(ledger: Ledger, user_id: int, question: str, as_of: datetime.date, statement_ids: list[int] | None = None) -> Answer:
    """The answer to one question, with the rows it rests on (lazily) and the notes that say how they were found: a table of one question."""
    from ledgerline.plans import question_table  # stands on the profiles of this module

    asked = ledger.transactions.sparkSession.createDataFrame([(0, user_id, question, statement_ids)], "question_id long, user_id long, question string, statement_ids array<long>")
    found = question_table.answer(ledger, asked, as_of)
    got = found.answers.first()
    out = Answer(got.answer, got.intent, got.notes, got.resolution, got.people)
    if got.resolution == "ambiguous" or "SCOPE_EMPTY" in got.notes:
        return out
    if got.n:
        out.rows = filters.latest_first(found.rows.drop("question_id"))
        out.totals = {c: got[c] for c in ("n", "total_debit", "total_credit", "first_date", "last_date", "largest_debit")}
        return out
    out.rows = found.related().drop("question_id")
    if not out.rows.isEmpty():
        out.notes.append("SEMANTIC_RETRIEVAL")
    return out
