"""Matching in the exact order of the rows, as a fixed point of facts that carry their time.

Each narration is to see the people, identifiers and payment methods that earlier narrations have brought, and nothing later. Rather than one row after another
(shared words and domains tie most rows of a ledger together, so no split by keys would leave small pieces), every fact carries the number of the row that brought
it, and a round decides all rows at once by joins on keys, each with the facts before it only. The decisions give the next round's facts. A row depends
on earlier rows alone, so after k rounds the first k rows are settled, and a round that changes nothing has the only answer there is: that of the strict
order. In practice a row settles as soon as what it depends on has, so rounds follow the longest chain of dependencies, not the number of rows.

Equal narrations see different facts only where a fact that concerns them appears between them. So a round cuts each different narration's time at these moments
into epochs, decides the first row of each epoch, and hands the decision to the epoch's other rows; of these only rows that mint bring facts that the first one
has not brought. The joins of a round meet different narrations and their epochs, and the rows themselves are only passed over, as two numbers each.

A block shows a row the first ``limit`` people by id. Under hot keys (a domain that everybody has) only facts that ever were among a key's first ``limit`` are
kept, found by one pass over the key's facts in the order of time with ``limit`` ids of state; so rows meet a few facts each, whatever the key.

Nulls: fields that are null bring and meet nothing. Narrations are ordered by ``statement_id, row_no, id``; ids must differ. No narrations: no decisions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.narration import has_strong_identifier
from ledgerline.functions.text import normalize_name
from ledgerline.operators.matching import CANDIDATES, EXACT, KINDS, MEDIUM, SAYS, _domain, _first, _local, _numbered, canonical_name, decide, evidence, moments
from ledgerline.plans.session import stored


def _running_first(facts: DataFrame, limit: int | None) -> DataFrame:
    """``key, person_id, at``: the facts whose person is, when the fact appears, among the key's people with the ``limit`` smallest ids."""
    firsts = facts.groupBy("key", "person_id").agg(F.min("at").alias("at"))
    if limit is None:
        return firsts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least = None, []  # the negated ids
        for batch in batches:
            keep = []
            for key, person in zip(batch.column("key").to_pylist(), batch.column("person_id").to_pylist(), strict=True):
                if key != now:
                    now, least = key, []
                keep.append(len(least) < limit or -person > least[0])
                if keep[-1]:
                    (heapq.heappush if len(least) < limit else heapq.heapreplace)(least, -person)
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = firsts.repartition("key").sortWithinPartitions("key", "at", "person_id")
    return dealt.mapInArrow(work, "key string, person_id long, at long")


def _prefixed(kind: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(value) if isinstance(value, str) else value)


def _keys_of_facts(people: DataFrame, identifiers: DataFrame) -> DataFrame:
    """``key, person_id, at``: under which keys people can be found, and since when."""
    v = F.col("normalized_value")
    local = _local(v)
    handle = F.concat(F.transform(F.sequence(F.lit(1), F.greatest(F.length(local), F.lit(1))), lambda n: F.concat(F.lit("P:"), F.substring(local, F.lit(1), n))), F.array(_prefixed("D", _domain(v))))
    keys = F.when(F.col("id_type") == "UPI", handle).when(F.col("id_type") == "ACCOUNT", F.array(_prefixed("A", F.right(v, F.lit(4))))).otherwise(F.array().cast("array<string>"))
    of_values = identifiers.filter(v.isNotNull()).select("person_id", "at", F.explode(F.concat(keys, F.array(_prefixed("C", v)))).alias("key"))
    words = F.filter(F.array_distinct(F.split("normalized_name", " ")), lambda w: F.length(w) >= 3)
    of_names = people.select(F.col("id").alias("person_id"), "at", F.explode(F.transform(words, lambda w: _prefixed("W", w))).alias("key"))
    return of_values.unionByName(of_names)


def _keys_of_rows(narrations: DataFrame) -> DataFrame:
    u = F.col("normalized_upi_id")
    words = F.filter(F.array_distinct(F.transform(F.coalesce("name_tokens", F.array().cast("array<string>")), F.lower)), lambda w: F.length(w) >= 3)
    one = F.array_compact(F.array(_prefixed("D", _domain(u)), _prefixed("P", _local(u)), _prefixed("A", F.right("account_identifier", F.lit(4))), _prefixed("C", "phone"), _prefixed("C", "email")))
    return narrations.select("id", F.explode(F.concat(one, F.transform(words, lambda w: _prefixed("W", w)))).alias("key"))


def _found(narrations: DataFrame, people: DataFrame, identifiers: DataFrame, limit: int | None) -> DataFrame:
    """``id, person_id, since``: the people of the narration's blocks, whenever they become known, and since when they can be found."""
    known = _running_first(_keys_of_facts(people, identifiers), limit)
    found = _keys_of_rows(narrations).join(known.withColumnRenamed("at", "since"), "key").select("id", "person_id", "since")
    # Names of short words only: the whole name lies in the narration's.
    short = lambda c: F.filter(F.array_distinct(c), lambda w: (F.length(w) < 3) & (w != ""))
    named = people.select(F.col("id").alias("person_id"), F.col("at").alias("since"), F.col("normalized_name").alias("theirs"), F.explode(short(F.split("normalized_name", " "))).alias("w"))
    asked = narrations.filter(F.length("normalized_name") >= 3).select("id", "normalized_name", F.explode(short(F.transform("name_tokens", F.lower))).alias("w"))
    inside = asked.join(named, "w").filter(F.col("normalized_name").contains(F.col("theirs"))).select("id", "person_id", "since")
    return found.union(inside).groupBy("id", "person_id").agg(F.min("since").alias("since"))


def _facts(decided: DataFrame, people: DataFrame, identifiers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """People, identifiers and methods that these decisions bring, each with the number of its row."""
    minted = decided.filter("minted")
    name = canonical_name()
    born = minted.select(F.col("person_id").alias("id"), "at", name.alias("canonical_name"), F.coalesce(normalize_name(name), F.lower(name)).alias("normalized_name"))
    pairs = lambda kinds: F.explode(F.array(*[F.struct(F.lit(k).alias("id_type"), F.col(KINDS[k]).alias("normalized_value")) for k in kinds])).alias("i")
    columns = ["person_id", "id_type", "normalized_value", "at"]
    flat = lambda df: df.select("person_id", "i.*", "at").filter("normalized_value is not null").select(*columns)
    own = flat(minted.select("person_id", "at", pairs([k for k in KINDS if k != "REFERENCE"])))
    owned = identifiers.select(*columns).union(own)
    # A matched row's values become its person's unless somebody has them already.
    value = ["id_type", "normalized_value"]
    seen = flat(decided.filter("person_id is not null").select("person_id", "at", pairs(KINDS))).groupBy(*value).agg(F.min_by("person_id", "at").alias("person_id"), F.min("at").alias("at"))
    before = owned.groupBy(*value).agg(F.min("at").alias("since"))
    taken = seen.join(before, value, "left").filter("since is null or at < since").select(*columns)
    used = decided.filter("person_id is not null and payment_method is not null and payment_method <> 'OTHER'").groupBy("person_id", "payment_method").agg(F.min("at").alias("at"))
    methods = used.groupBy("person_id").agg(F.collect_list(F.struct(F.col("payment_method").alias("v"), "at")).alias("methods"))
    return people.select("id", "at", "canonical_name", "normalized_name").union(born), owned.union(taken), methods


def _epochs(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows (``pid, at`` and more) with their ``epoch``: how many of their narration's cuts (``pid, cuts``) lie before them."""
    return rows.join(cuts, "pid", "left").withColumn("epoch", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("at"))), F.lit(0))).drop("cuts")


def _stamp(*tables: DataFrame) -> list[tuple]:
    """Count and hash of the rows of each table."""
    return [tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64(*t.columns)), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)"))).first()) for t in tables]


#: What tells narrations apart, for matching and for what they bring.
TOLD = ("name", *SAYS)


def _profiles(narrations: DataFrame, identifiers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``pid, id, statement_id, row_no`` of each narration, the different narrations (``pid`` and the columns of ``TOLD``), and ``id, reference`` of references left out.

    A reference says nothing if one narration alone has it, no person has it, and it is nobody's phone or email.
    """
    held = identifiers.filter("id_type = 'REFERENCE'").select(F.col("normalized_value").alias("reference"), F.lit(2).cast("long").alias("n"))
    contacts = narrations.select(F.explode(F.array_compact(F.array("phone", "email"))).alias("reference")).distinct().withColumn("n", F.lit(2).cast("long"))
    shown = narrations.filter("reference is not null").groupBy("reference").agg(F.count("*").alias("n"))
    shared = shown.union(held).union(contacts).groupBy("reference").agg(F.sum("n").alias("n")).filter("n > 1").select("reference", F.lit(True).alias("_shared"))
    shared = stored(shared.join(shown.select("reference"), "reference", "left_semi"))
    told = narrations.select("id", "statement_id", "row_no", *TOLD).join(shared, "reference", "left")
    lone = told.filter("reference is not null and _shared is null").select("id", "reference")
    told = told.withColumn("reference", F.when(F.col("_shared"), F.col("reference"))).select("id", "statement_id", "row_no", F.struct(*TOLD).alias("told"))
    profiles = stored(told.groupBy("told").agg(F.min("id").alias("pid")))
    return told.join(profiles, "told").select("pid", "id", "statement_id", "row_no"), profiles.select("pid", "told.*"), lone


def replay(narrations: DataFrame, people: DataFrame, identifiers: DataFrame, *, limit: int | None = CANDIDATES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions, people and identifiers as if each narration had been matched after all before it.

    Decisions: ``id, status, person_id, suggested_person_id, confidence, reason_codes, n_candidates, minted``. New people are numbered in the order of the
    rows that mint them, after the largest id there is.
    """
    rows, profiles, lone = _profiles(narrations, identifiers)
    rows = rows.select("pid", "id", F.struct("statement_id", "row_no", "id").alias("_at"))
    rows = stored(_numbered(rows, "_at").select("pid", "id", F.col("_n").cast("long").alias("at")))
    base = people.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    old_people = stored(people.select("id", F.lit(-1).cast("long").alias("at"), "canonical_name", "normalized_name"))
    old_identifiers = stored(identifiers.select("person_id", "id_type", "normalized_value", F.lit(-1).cast("long").alias("at")))
    # First guess: a strong identifier's first row mints. Any guess ends at the same decisions.
    key = F.coalesce("normalized_upi_id", "account_identifier")
    firsts = rows.groupBy("pid").agg(F.min("at").alias("at")).join(profiles, "pid").filter(has_strong_identifier())
    heads = firsts.groupBy(key.alias("_k")).agg(F.min("at").alias("at")).select("at")
    bringing = firsts.join(heads, "at").withColumns({"person_id": F.lit(base) + F.col("at"), "minted": F.lit(True)})
    before = None
    while True:
        known, owned, methods = (stored(f) for f in _facts(bringing, old_people, old_identifiers))
        now = _stamp(known, owned, methods.select("person_id", F.array_sort("methods")))
        if now == before:  # these facts have been decided by
            break
        before = now
        found = stored(_found(profiles.withColumnRenamed("pid", "id"), known, owned, limit))
        seen = moments(profiles.withColumnRenamed("pid", "id"), found, owned, methods).select(F.col("id").alias("pid"), F.explode("moments").alias("cut"))
        cuts = stored(seen.groupBy("pid").agg(F.sort_array(F.collect_set("cut")).alias("cuts")))
        first = stored(_epochs(rows, cuts).groupBy("pid", "epoch").agg(F.min("at").alias("at"), F.count("*").alias("n")))
        asked = stored(first.join(profiles, "pid").withColumn("id", F.col("at")))
        pairs = asked.select("id", "pid", "at").join(found.withColumnRenamed("id", "pid"), "pid").filter("since < at").select("id", "person_id")
        scored = stored(evidence(asked, _first(pairs, ["id"], limit), known, owned, methods, as_of=True))
        exact = scored.filter(F.exists("codes", lambda c: c.isin(*EXACT))).select("id", F.lit(True).alias("exact")).distinct()
        plain = asked.join(decide(asked, scored), "id").join(exact, "id", "left")
        mints = has_strong_identifier() & F.col("exact").isNull() & (F.coalesce("confidence", F.lit(0.0)) < MEDIUM)
        decided = stored(plain.withColumn("minted", mints).drop("exact", "id"))
        bringing = decided.withColumn("person_id", F.when(F.col("minted"), F.lit(base) + F.col("at")).otherwise(F.col("person_id")))
        if decided.filter("minted and n > 1").limit(1).count():  # each row of the epoch mints
            every = _epochs(rows, cuts).join(decided.filter("minted and n > 1").drop("at"), ["pid", "epoch"]).withColumn("person_id", F.lit(base) + F.col("at"))
            bringing = stored(bringing.filter("not minted or n = 1").unionByName(every.drop("id")))
    new = {
        "status": F.lit("MATCH"), "person_id": F.lit(base) + F.col("at"), "suggested_person_id": F.lit(base) + F.col("at"), "confidence": F.lit(0.9),
        "reason_codes": F.array(F.lit("NEW_PERSON_STRONG_IDENTIFIER")), "n_candidates": F.col("n_candidates") + 1,
    }
    # Ids follow the order of the minting rows without gaps.
    numbers = _numbered(bringing.filter("minted").select("at"), "at").select((F.lit(base) + F.col("at")).alias("_old"), (F.lit(base) + F.col("_n")).cast("long").alias("_new"))
    numbers = stored(numbers)

    def renamed(df: DataFrame, c: str) -> DataFrame:
        return df.join(numbers.withColumnRenamed("_old", c), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")

    # Decisions are named before they meet their rows, but for the rows of an epoch that each mint.
    columns = ["status", "person_id", "suggested_person_id", "confidence", "reason_codes", "n_candidates", "minted"]
    born = lambda df, which: df.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in new.items()})
    each = F.col("minted") & (F.col("n") > 1)
    of_epochs = stored(renamed(renamed(born(decided, F.col("minted") & ~each), "person_id"), "suggested_person_id").select("pid", "epoch", each.alias("_each"), *columns))
    told = _epochs(rows, cuts).join(of_epochs, ["pid", "epoch"])
    own = renamed(renamed(born(told.filter("_each"), F.lit(True)), "person_id"), "suggested_person_id")
    decisions = told.filter("not _each").select("id", *columns).unionByName(own.select("id", *columns))
    aliases = bringing.filter("person_id is not null and normalized_name is not null").select("person_id", F.lit("NAME").alias("id_type"), F.col("normalized_name").alias("normalized_value"))
    everyone = renamed(known, "id").select("id", F.format_string("P%03d", F.col("id")).alias("code"), "canonical_name", "normalized_name")
    codes = everyone.join(people.select("id", F.col("code").alias("_code")), "id", "left").withColumn("code", F.coalesce("_code", "code")).drop("_code")
    values = renamed(owned.select("person_id", "id_type", "normalized_value").union(aliases).distinct(), "person_id").select("person_id", "id_type", "normalized_value")
    silent = decisions.filter("person_id is not null").join(lone, "id").select("person_id", F.lit("REFERENCE").alias("id_type"), F.col("reference").alias("normalized_value"))
    return decisions, codes, values.union(silent).distinct()
