"""A table of questions: what each is answered when asked with the others."""

import datetime

from ledgerline.plans import question_table, questions
from ledgerline.plans.ledger import Ledger
from test_ledger import small_ledger

AS_OF = datetime.date(2025, 10, 1)
NONE = questions.INSUFFICIENT
ASKED = [
    (1, 7, "How much did I send Kalyan?", None, "Kalyan (P001) — Total sent: Rs 8,000.00. (Verified from 2 transactions.)", []),
    (2, 7, "How many transactions in 2024?", None, NONE, []),
    (3, 7, "What is my balance?", [1], "Closing balance on 2025-09-25: Rs 42,150.50.", ["SCOPE_SELECTED"]),
    (4, 7, "What is my balance?", [2], NONE, ["SCOPE_SELECTED"]),
    (5, 7, "What is my balance?", [], NONE, ["SCOPE_EMPTY"]),
    (6, 8, "How many transactions?", None, NONE, []),
    (7, None, "How many transactions?", None, NONE, []),
    (8, 7, None, None, "Found 5 transactions.", []),
    (9, 7, "How many transactions did I make this week?", None, "1 transaction.", []),
    (10, 7, "Who did I transfer the most money to?", None, "Most money sent to Kalyan (P001): Rs 8,000.00 across 2 transactions.", []),
    (11, 7, "How many RTGS transactions in September 2025?", None, "1 Rtgs transaction.", ["METHOD_FILTER_WIDENED"]),
    (12, 7, 'How many transactions with "kalyan@ok"', None, "2 transactions with Kalyan (P001).", []),
    (13, 7, "How many transactions with okaxis", None, "Multiple possible matches were found. Please review. Candidates: Kalyan (P001), Ravi Kumar (P002).", ["MULTIPLE_PERSON_MATCHES"]),
    (14, 7, "How many transactions with zed", None, "5 transactions with zed.", ["MATCHED_BY_DESCRIPTION_TEXT"]),
    (15, 7, "Show all transactions in September", None, "Found 4 transactions in September.", []),
]


def ledger_with_undated(spark):
    ledger = small_ledger(spark)
    undated = ledger.transactions.filter("id = 4").selectExpr(*["id + 1 AS id" if c == "id" else "CAST(NULL AS DATE) AS transaction_date" if c == "transaction_date" else c for c in ledger.transactions.columns])
    return Ledger(ledger.transactions.union(undated), ledger.statements, ledger.people, ledger.identifiers)


def table(spark, rows):
    return spark.createDataFrame([r[:4] for r in rows], "question_id long, user_id long, question string, statement_ids array<long>")


def test_questions_together(spark):
    found = question_table.answer(ledger_with_undated(spark), table(spark, ASKED), AS_OF)
    got = {r.question_id: r for r in found.answers.collect()}
    assert {i: (r.answer, r.notes) for i, r in got.items()} == {i: (a, n) for i, *_, a, n in ASKED}
    held = {}
    for r in found.rows.select("question_id", "id").collect():
        held.setdefault(r.question_id, set()).add(r.id)
    assert held[1] == {1, 2} and held[8] == {1, 2, 3, 4, 5} and held[15] == {1, 2, 3, 4}
    assert {i: len(x) for i, x in held.items()} == {i: r.n for i, r in got.items() if r.n}


def test_no_questions(spark):
    found = question_table.answer(small_ledger(spark), table(spark, []), AS_OF)
    assert found.answers.count() == 0 and found.rows.count() == 0 and found.related().count() == 0


#: Questions with intent, direction, method, month, year and person.
PROFILED = [
    ("How much did I send Kalyan Kumar?", "total_sent", "DEBIT", None, None, None, "kalyan kumar"),
    ("Show all UPI transactions with Kalyan Kumar.", "list", None, "UPI", None, None, "kalyan kumar"),
    ("Show all transactions in September 2025", "list", None, None, 9, 2025, None),
    ("How many transactions in 2024?", "count", None, None, None, 2024, None),
    ("Who did I transfer the most money to?", "top_counterparty", "DEBIT", None, None, None, None),
    ("What is my total credit and debit?", "overall_totals", None, None, None, None, None),
    ("What is my balance?", "balance", None, None, None, None, None),
    ("Show my biggest transactions", "largest", "DEBIT", None, None, None, None),
    ("How much did I receive in total last month?", "total_received", "CREDIT", None, 7, 2001, None),
    ("Who did I meet via google pay?", "counterparties", None, "GOOGLE_PAY", None, None, "meet"),
    ('What did I give "Asha Rao" this year', "list", None, None, None, 2001, "asha rao"),
    (None, "list", None, None, None, None, None),
]


def test_profiles(spark):
    found = questions.profiles(spark.createDataFrame([(p[0],) for p in PROFILED], "question string"), datetime.date(2001, 8, 1))
    assert {tuple(r) for r in found.select("question", "intent", "direction", "payment_method", "month", "year", "person_text").collect()} == set(PROFILED)


def test_equal_questions_are_answered_once(spark):
    again = [(i + 100 * k, *rest) for k in (1, 2) for i, *rest in ASKED]
    asked = table(spark, ASKED + again)
    once = {r.question_id: r.first for r in question_table._once(asked).collect()}
    assert once == {i + 100 * k: i for i, *_ in ASKED for k in range(3)}
    found = question_table.answer(ledger_with_undated(spark), asked, AS_OF)
    assert {r.question_id: r.answer for r in found.answers.collect()} == {i + 100 * k: a for i, _, _, _, a, _ in ASKED for k in range(3)}
    held = [r.question_id for r in found.rows.collect()]
    assert held.count(8) == held.count(108) == held.count(208) == 5
    near = [r.question_id for r in found.related().collect()]
    assert near.count(6) == near.count(106) and sorted(near) == sorted(i % 100 + 100 * k for i in near if i < 100 for k in range(3))
