"""A table of questions answered at once: many users, many questions, and as many steps as for a single one.

Whom a text may mean is found by equi-joins: by exact name, by the words of names, and, for identifiers that contain the text, by the text's first four
characters among the identifiers' runs of four. Rows meet questions by user and month: a question names the months of its user that its period touches (an
interval join, exact at the edges), and where it means certain people, these too; so a user with many rows is spread over months and people. Direction and
method are conditions on the meeting. A method without rows gives way to its family: both are summed side by side and the exact one wins where it has rows.
Sums are kept by question and counterparty first, from which totals, rankings and balances follow, and answers are composed by column expressions.

A question that several ask of the same rows (the same user, text and statements) is answered once, and its answer goes to each of them.

Four tables are written on the way (questions and whose answer they get, profiles, whom they mean, sums by counterparty); nothing comes to the driver.

Questions have ``question_id`` (each once), ``user_id``, ``question`` and, if wanted, ``statement_ids`` (null: all statements; empty: none). A null question
asks for a list of all rows; a user without rows, or a null user, gets the refusal. Undated rows belong to questions without a period only.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import vectors
from ledgerline.operators.aggregates import SUM
from ledgerline.operators.filters import METHOD_FAMILY
from ledgerline.plans import questions as Q
from ledgerline.plans.ledger import Ledger
from ledgerline.plans.session import checkpointed

#: Identifiers are searched for texts of this length or more.
GRAM = 4
#: People named in an answer, and counterparties listed in one.
PEOPLE_SHOWN, LISTED = 20, 5
UNDATED = "0001-01-01"


@dataclass
class Answers:
    """``answers``: a row per question; ``rows``: ``question_id`` and the ledger rows an answer rests on."""

    answers: DataFrame
    rows: DataFrame
    _without: Callable[[], DataFrame]

    def related(self) -> DataFrame:
        """``question_id`` and, of each question that has no rows, those within its filters that are nearest to it."""
        return self._without()


# --- whom a question means ----------------------------------------------------------------------------------------


def _meant(ledger: Ledger, asked: DataFrame, owned: DataFrame) -> DataFrame:
    """``question_id, person_id, code, canonical_name, normalized_name``: exact names, else identifiers and words, else words alone (the first word's people first)."""
    named = asked.filter("person_text is not null").select("question_id", "user_id", "person_text", "tokens")
    known = owned.select("user_id", F.col("counterparty_id").alias("person_id")).join(named.select("user_id").distinct(), "user_id", "left_semi").distinct()
    people = ledger.people.select(F.col("id").alias("person_id"), "code", "canonical_name", "normalized_name")
    mine = known.join(people.select("person_id", F.coalesce("normalized_name", F.lit("")).alias("name")), "person_id")
    no = F.lit(False)
    exact = named.join(mine, (mine.name == named.person_text) & (mine.user_id == named.user_id)).select("question_id", "person_id", F.lit(True).alias("exact"), no.alias("known"), no.alias("named"), no.alias("first"))

    words = mine.select("user_id", "person_id", "name", F.explode(F.array_distinct(F.split("name", " "))).alias("word")).filter("word <> ''")
    tokens = named.select("question_id", "user_id", "person_text", "tokens", F.explode(F.array_distinct("tokens")).alias("word"))
    long = F.exists("tokens", lambda t: (F.length(t) >= 3) & F.col("name").contains(t))
    near = long | ((F.length("person_text") >= 3) & F.col("person_text").contains(F.col("name")))
    worded = tokens.join(words, ["user_id", "word"]).filter(near)
    worded = worded.select("question_id", "person_id", no.alias("exact"), no.alias("known"), F.lit(True).alias("named"), (F.col("word") == F.col("tokens")[0]).alias("first"))

    low = ledger.identifiers.filter(F.col("id_type").isin("UPI", "ACCOUNT")).join(known.select("person_id").distinct(), "person_id", "left_semi").select("person_id", F.lower("value").alias("value")).filter(F.length("value") >= GRAM)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("value") - (GRAM - 1)), lambda i: F.substr("value", i, F.lit(GRAM))))
    shown = low.select("person_id", "value", F.explode(grams).alias("gram"))
    texts = named.filter(F.length("person_text") >= GRAM).select("question_id", "user_id", "person_text", F.left("person_text", F.lit(GRAM)).alias("gram"))
    held = texts.join(shown, "gram").filter(F.col("value").contains(F.col("person_text"))).select("question_id", "user_id", "person_id").distinct()
    held = held.join(known, ["user_id", "person_id"], "left_semi").select("question_id", "person_id", no.alias("exact"), F.lit(True).alias("known"), no.alias("named"), no.alias("first"))

    flags = ("exact", "known", "named", "first")
    hits = exact.union(worded).union(held).groupBy("question_id", "person_id").agg(*[F.max(c).alias(c) for c in flags])
    best = hits.groupBy("question_id").agg(*[F.max(c).alias(f"any_{c}") for c in ("exact", "known", "first")])
    chosen = F.when(F.col("any_exact"), F.col("exact")).when(F.col("any_known"), F.col("known") | F.col("named")).when(F.col("any_first"), F.col("first")).otherwise(F.col("named"))
    return hits.join(best, "question_id").filter(chosen).select("question_id", "person_id").join(people, "person_id")


def _with_people(ledger: Ledger, asked: DataFrame, meant: DataFrame) -> DataFrame:
    """Questions with ``people`` (the names shown), ``kind`` (all, people, text, ambiguous or none) and the first ``notes``."""
    name = F.coalesce(F.nullif("normalized_name", F.lit("")), "canonical_name", F.lit(""))
    counted = meant.groupBy("question_id").agg(F.count("*").alias("n_people"), F.countDistinct(F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))).alias("n_names"))
    ranked = meant.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("person_id"))).filter(F.col("place") <= PEOPLE_SHOWN + 1)
    label = F.concat("canonical_name", F.lit(" ("), "code", F.lit(")"))
    shown = ranked.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("place", label.alias("label")))).getField("label").alias("people"))
    texts = asked.select("question_id", "person_text")
    handles = meant.select("question_id", "person_id").join(ledger.identifiers.filter("id_type = 'UPI'").select("person_id", F.lower("value").alias("value")), "person_id").join(texts, "question_id")
    local = F.trim(F.substring_index("value", "@", 1))
    shared = handles.filter(F.col("value").contains(F.col("person_text"))).groupBy("question_id").agg((F.countDistinct(local) == 1).alias("one_handle"))
    df = asked.join(counted, "question_id", "left").join(shown, "question_id", "left").join(shared, "question_id", "left")
    scoped, many = F.col("statement_ids").isNotNull(), F.col("n_names") > 1
    empty = scoped & (F.size("statement_ids") == 0)
    kind = F.when(empty, "none").when(F.col("person_text").isNull(), "all").when(F.col("n_people").isNull(), "text").when(many & ~F.coalesce("one_handle", F.lit(False)), "ambiguous").otherwise("people")
    df = df.withColumns({"kind": kind, "people": F.when(~empty, F.col("people"))})
    scope = F.when(empty, "SCOPE_EMPTY").when(scoped, "SCOPE_SELECTED")
    merged = F.when(F.col("kind") == "ambiguous", "MULTIPLE_PERSON_MATCHES").when((F.col("kind") == "people") & many, "SAME_UPI_RECORDS_MERGED").when((F.col("kind") == "people") & (F.col("n_people") > 1), "SAME_NAME_RECORDS_MERGED")
    family = F.create_map(*[x for k, v in METHOD_FAMILY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return df.withColumns({"notes": F.array_compact(F.array(scope, merged)), "family": F.coalesce(F.try_element_at(family, "payment_method"), F.array("payment_method"))}).drop("n_people", "n_names", "one_handle")


# --- the rows a question is about ---------------------------------------------------------------------------------


def _in_period(first: Column, last: Column) -> Column:
    """Whether the days from ``first`` to ``last``, of one month, may be in the question's period."""
    month, year, start, end = (F.col(f"asked_{c}") for c in ("month", "year", "from", "to"))
    loose = month.isNull() & year.isNull()
    return (
        (month.isNull() | F.coalesce(F.month(first) == month, F.lit(False)))
        & (year.isNull() | F.coalesce(F.year(first) == year, F.lit(False)))
        & (~loose | start.isNull() | F.coalesce(last >= start, F.lit(False)))
        & (~loose | end.isNull() | F.coalesce(first <= end, F.lit(False)))
    )


def _meeting(asked: DataFrame, meant: DataFrame, owned: DataFrame, kinds: tuple[str, ...], by_text: bool = True) -> DataFrame:
    """``question_id, exact`` and the row: what questions of these kinds meet. ``exact`` tells rows of the method itself from those of its family."""
    columns = owned.columns
    wanted = asked.filter(F.col("kind").isin(*kinds)).select(
        "question_id", F.col("user_id").alias("asked_user"), F.col("kind"), F.col("month").alias("asked_month"), F.col("year").alias("asked_year"), F.col("date_from").alias("asked_from"), F.col("date_to").alias("asked_to"),
        F.col("direction").alias("asked_direction"), F.col("payment_method").alias("asked_method"), "family", "tokens", F.col("statement_ids").alias("asked_statements"),
    )
    bucket = F.coalesce(F.trunc("transaction_date", "month"), F.lit(UNDATED).cast("date"))
    rows = owned.join(wanted.select(F.col("asked_user").alias("user_id")).distinct(), "user_id", "left_semi").withColumn("bucket", bucket)
    held = rows.select(F.col("user_id").alias("asked_user"), F.col("counterparty_id").alias("asked_person"), F.col("bucket").alias("asked_bucket")).distinct()
    dated = F.nullif("asked_bucket", F.lit(UNDATED).cast("date"))
    touched = _in_period(dated, F.last_day(dated))
    same = (F.col("asked_user") == F.col("user_id")) & (F.col("asked_bucket") == F.col("bucket"))

    people = wanted.filter("kind = 'people'").join(meant.select("question_id", F.col("person_id").alias("asked_person")), "question_id")
    people = people.join(held, ["asked_user", "asked_person"]).filter(touched)
    of_people = people.join(rows, same & (F.col("asked_person") == F.col("counterparty_id"))).drop("asked_person")
    months = wanted.filter("kind <> 'people'").join(held.select("asked_user", "asked_bucket").distinct(), "asked_user").filter(touched)
    of_all = months.join(rows, same)
    if by_text:
        inside = lambda c: F.exists("tokens", lambda t: (F.length(t) >= 3) & F.coalesce(F.col(c).contains(t), F.lit(False)))
        of_all = of_all.filter((F.col("kind") != "text") | inside("normalized_counterparty_name") | inside("normalized_upi_id"))
    day, method = F.col("transaction_date"), F.col("asked_method")
    fits = (
        _in_period(day, day)
        & (F.col("asked_direction").isNull() | (F.col("transaction_type") == F.col("asked_direction")))
        & (method.isNull() | F.array_contains("family", F.col("payment_method")))
        & (F.col("asked_statements").isNull() | F.array_contains("asked_statements", F.col("statement_id")))
    )
    met = of_people.unionByName(of_all).filter(fits)
    return met.select("question_id", F.coalesce(F.col("payment_method") == method, method.isNull()).alias("exact"), *[F.col(c) for c in columns])


# --- answers ------------------------------------------------------------------------------------------------------


def _sums(met: DataFrame) -> DataFrame:
    """Sums by question, exactness and counterparty (a person, else a name)."""
    name = F.when(F.col("counterparty_id").isNull(), F.col("normalized_counterparty_name")).alias("name")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(SUM)
    return met.groupBy("question_id", "exact", "counterparty_id", name).agg(
        F.count("*").alias("n"), total("debit_amount").alias("total_debit"), total("credit_amount").alias("total_credit"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"),
        F.max(F.struct("debit_amount", "transaction_date")).alias("largest"),
        F.max(F.struct(F.coalesce("transaction_date", F.lit(UNDATED).cast("date")).alias("day"), "id", "balance", "transaction_date")).alias("newest"),
    )


def _totals(sums: DataFrame) -> DataFrame:
    """A row per question: that of the method itself where it has rows, else that of its family."""
    total = lambda c: F.sum(c).cast(SUM).alias(c)
    each = sums.groupBy("question_id", "exact").agg(
        F.sum("n").alias("n"), total("total_debit"), total("total_credit"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.max("largest").alias("largest"), F.max("newest").alias("newest"),
        F.count("*").alias("n_parties"), F.count("counterparty_id").alias("n_matched"), F.count("name").alias("n_named"),
    )
    best = each.groupBy("question_id").agg(F.max_by(F.struct(*each.columns), "exact").alias("t"))
    return best.select("t.*")


def _tops(ledger: Ledger, sums: DataFrame, asked: DataFrame) -> DataFrame:
    """``question_id, exact, tops``: the first few counterparties of the questions that want them, in order."""
    ranked = sums.join(asked.filter("intent in ('top_counterparty', 'counterparties')").select("question_id", "intent", "direction"), "question_id")
    ranked = ranked.filter("counterparty_id is not null or name is not null")
    key = F.when(F.col("intent") == "counterparties", F.col("n").cast(SUM)).when(F.col("direction") == "CREDIT", F.col("total_credit")).otherwise(F.col("total_debit"))
    order = Window.partitionBy("question_id", "exact").orderBy(F.desc(key), F.asc_nulls_last("counterparty_id"), F.asc_nulls_last("name"))
    ranked = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LISTED)
    people = ledger.people.select(F.col("id").alias("counterparty_id"), "code", "canonical_name")
    named = ranked.join(people, "counterparty_id", "left")
    who = F.when(F.col("code").isNotNull() & (F.col("code") != ""), F.concat("canonical_name", F.lit(" ("), "code", F.lit(")"))).otherwise(F.coalesce("canonical_name", "name"))
    return named.groupBy("question_id", "exact").agg(F.sort_array(F.collect_list(F.struct("place", who.alias("who"), "n", "total_debit", "total_credit"))).alias("tops"))


def _composed() -> Column:
    """The answer of a question with rows. The sentences."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    plural = lambda n: F.when(n == 1, "").otherwise("s")
    rupees = lambda c: text("Rs ", F.format_number(F.coalesce(c.cast(SUM), F.lit(0).cast(SUM)), 2))
    n, month, year = F.col("n"), F.col("month"), F.col("year").cast("string")
    months = F.array(*[F.lit(m.title()) for m in Q.MONTHS])
    when = F.when(month.isNotNull(), text(" in ", F.try_element_at(months, month.cast("int")), F.coalesce(text(" ", year), F.lit("")))).when(year.isNotNull(), text(" in ", year)).otherwise("")
    having = F.when(F.col("person_text").isNotNull(), text(" with ", F.col("label"))).otherwise("")
    rows = text(n.cast("string"), " transaction", plural(n))
    sent = lambda word, c: text(F.coalesce("label", F.lit("counterparties")), f" — Total {word}: ", rupees(F.col(c)), ". (Verified from ", rows, ".)")
    method = F.coalesce(text(" ", F.initcap(F.lower(F.replace("payment_method", F.lit("_"), F.lit(" "))))), F.lit(""))
    largest, newest = F.col("largest"), F.col("newest")
    lead, incoming = F.try_element_at("tops", F.lit(1)), F.col("direction").eqNullSafe("CREDIT")
    led = text("Most money ", F.when(incoming, "received").otherwise("sent"), " to ", lead["who"], ": ", rupees(F.when(incoming, lead["total_credit"]).otherwise(lead["total_debit"])), " across ", lead["n"].cast("string"), " transaction", plural(lead["n"]), ".")
    listed = F.array_join(F.transform("tops", lambda p: text(p["who"], " — ", p["n"].cast("string"), " transaction", plural(p["n"]))), "; ")
    parties = F.col("n_parties")
    intent = F.col("intent")
    found = (
        F.when(intent == "total_sent", sent("sent", "total_debit")).when(intent == "total_received", sent("received", "total_credit"))
        .when(intent == "count", text(n.cast("string"), method, " transaction", plural(n), having, "."))
        .when(intent == "largest", F.when(largest["debit_amount"].isNotNull(), text("Largest debit", F.coalesce(text(" on ", largest["transaction_date"].cast("string")), F.lit("")), ": ", rupees(largest["debit_amount"]), ".")))
        .when(intent == "overall_totals", text("Total debits: ", rupees(F.col("total_debit")), " · Total credits: ", rupees(F.col("total_credit")), " (verified from ", rows, when, ")."))
        .when(intent == "top_counterparty", led)
        .when(intent == "counterparties", text("You transacted with ", parties.cast("string"), " counterpart", F.when(parties == 1, "y").otherwise("ies"), when, ". Top: ", listed, "."))
        .when(intent == "balance", F.when(newest["balance"].isNotNull(), text("Closing balance on ", F.coalesce(newest["transaction_date"].cast("string"), F.lit("None")), ": ", rupees(newest["balance"]), ".")))
        .otherwise(text("Found ", rows, having, when, "."))
    )
    return F.coalesce(found, F.lit(Q.INSUFFICIENT))


def _related(asked: DataFrame, met: DataFrame) -> DataFrame:
    """The rows within a question's filters whose search documents are nearest to it."""
    rows = met.drop("question_id", "exact").dropDuplicates(["id"])
    documents = vectors.sparse_embedding(vectors.document_content(rows), "id", "content")
    sought = vectors.sparse_embedding(asked.select("question_id", "question"), "question_id", "question").select(F.col("id").alias("question_id"), "bucket", F.col("value").alias("sought"))
    near = met.filter("exact").select("question_id", "id").join(documents, "id").join(sought, ["question_id", "bucket"]).groupBy("question_id", "id").agg(F.sum(F.col("value") * F.col("sought")).alias("score"))
    near = near.join(asked.select("question_id", F.col("person_text").isNotNull().alias("named")), "question_id")
    near = near.filter(F.col("score") > F.when(F.col("named"), Q.SEMANTIC_FLOOR).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "id"))
    near = near.withColumn("place", place).filter(F.col("place") <= F.when(F.col("named"), 5).otherwise(8)).select("question_id", "id")
    return met.drop("exact").join(near, ["question_id", "id"], "left_semi")


def _once(asked: DataFrame) -> DataFrame:
    """``asked`` with ``first``: the smallest id of those that ask the same; nulls are the same."""
    key = ["user_id", "question", "statement_ids"]
    firsts = asked.groupBy(*key).agg(F.min("question_id").alias("first")).select("first", *[F.col(c).alias(f"its_{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in key]
    return asked.join(firsts, same).select(*asked.columns, "first")


def answer(ledger: Ledger, asked: DataFrame, as_of: datetime.date) -> Answers:
    """All questions' answers: ``question_id, intent, resolution, notes, people, n`` and the totals, and ``answer``."""
    asked = asked if "statement_ids" in asked.columns else asked.withColumn("statement_ids", F.lit(None).cast("array<long>"))
    named = checkpointed(_once(asked.select("question_id", "user_id", "question", "statement_ids")))
    everyone = named.select(F.col("question_id").alias("each"), F.col("first").alias("question_id"))
    to_all = lambda df: everyone.join(df, "question_id").drop("question_id").withColumnRenamed("each", "question_id")
    asked = checkpointed(Q.profiles(named.filter("question_id = first").drop("first"), as_of))
    users = ledger.statements.select(F.col("id").alias("statement_id"), "user_id", "bank_name", "status")
    owned = ledger.transactions.join(users, "statement_id")
    meant = checkpointed(_meant(ledger, asked, owned))
    asked = _with_people(ledger, asked, meant)
    met = _meeting(asked, meant, owned, ("all", "people", "text"))
    sums = checkpointed(_sums(met))
    totals = _totals(sums)
    df = asked.join(totals, "question_id", "left").join(_tops(ledger, sums, asked), ["question_id", "exact"], "left")
    held, text = F.coalesce(F.col("n") > 0, F.lit(False)), F.col("kind") == "text"
    unsure = text & held & (F.col("n_matched") == 0) & (F.col("n_named") > 1)
    label = F.when(F.col("kind") == "people", F.try_element_at("people", F.lit(1))).otherwise(F.col("person_text"))
    df = df.withColumns({"label": label, "held": held, "unsure": unsure})
    wider = F.when(F.col("held") & ~F.col("exact"), "METHOD_FILTER_WIDENED")
    by_text = F.when(F.col("unsure"), "MULTIPLE_POSSIBLE_MATCHES").when(text & F.col("held"), "MATCHED_BY_DESCRIPTION_TEXT")
    doubtful = F.col("unsure") | (F.col("kind") == "ambiguous")
    names = F.when(F.col("kind") == "ambiguous", F.array_join("people", ", ")).otherwise(F.col("label"))
    found = df.select(
        "question_id", "user_id", "intent", F.when(doubtful, "ambiguous").when(F.col("kind") == "people", "resolved").otherwise("none").alias("resolution"),
        F.concat("notes", F.array_compact(F.array(wider, by_text))).alias("notes"), F.coalesce("people", F.array().cast("array<string>")).alias("people"),
        F.coalesce("n", F.lit(0)).alias("n"), "total_debit", "total_credit", "first_date", "last_date", F.col("largest.debit_amount").alias("largest_debit"),
        F.when(doubtful, F.concat(F.lit(f"{Q.AMBIGUOUS} Candidates: "), names, F.lit("."))).when(F.col("held"), _composed()).otherwise(Q.INSUFFICIENT).alias("answer"),
    )
    rows = met.join(totals.filter(F.col("n") > 0).select("question_id", "exact"), ["question_id", "exact"], "left_semi").drop("exact")
    without = asked.join(totals.select("question_id"), "question_id", "left_anti").filter(F.col("kind").isin("all", "people", "text"))
    without = without.withColumn("kind", F.lit("all"))
    return Answers(to_all(found), to_all(rows), lambda: to_all(_related(without, _meeting(without, meant, owned, ("all",), by_text=False))))
