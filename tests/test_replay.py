"""Matching in order against the same rules applied one row after another."""

import random

import pytest

from ledgerline.operators import replay
from ledgerline.operators.matching import WEIGHTS

SCHEMA = "id long, statement_id long, row_no int, transaction_date date, name string, normalized_name string, name_tokens array<string>, normalized_upi_id string, account_identifier string, phone string, email string, reference string, payment_method string"
EXACT = {"UPI_EXACT_MATCH", "ACCOUNT_EXACT_MATCH", "PHONE_EXACT_MATCH", "EMAIL_EXACT_MATCH", "REFERENCE_MATCH"}


def row(i, statement, no, name=None, upi=None, account=None, phone=None, email=None, reference=None, method=None):
    return (i, statement, no, None, name, name.lower() if name else None, name.split() if name else [], upi, account, phone, email, reference, method)


class Ledger:
    """The rules in plain Python, one row after another."""

    def __init__(self, people, identifiers, limit=8):
        self.people = {i: n for i, _, _, n in people}  # id: normalized name
        self.values = [tuple(x) for x in identifiers]
        self.methods, self.limit = {}, limit

    def candidates(self, r):
        _, _, _, _, name, normal, tokens, upi, account, phone, email, _, _ = r
        found = set()
        for p, kind, v in self.values:
            if upi and kind == "UPI":
                handle, domain = upi.split("@")
                if v == upi or v.split("@")[0].startswith(handle) or v.endswith("@" + domain):
                    found.add(p)
            if account and kind == "ACCOUNT" and v[-4:] == account[-4:]:
                found.add(p)
            if v in (phone, email) and kind != "NAME":
                found.add(p)
        words = {t.lower() for t in tokens}
        for p, theirs in self.people.items():
            if any(len(w) >= 3 and w in theirs for w in words) or (normal and len(normal) >= 3 and theirs in normal):
                if words & set(theirs.split()):
                    found.add(p)
        return sorted(found)[: self.limit]

    def evidence(self, r, p):
        _, _, _, _, name, normal, tokens, upi, account, phone, email, reference, method = r
        own = lambda k: {v for q, kind, v in self.values if q == p and kind == k}
        codes = [c for c, k, v in (("UPI_EXACT_MATCH", "UPI", upi), ("ACCOUNT_EXACT_MATCH", "ACCOUNT", account), ("PHONE_EXACT_MATCH", "PHONE", phone), ("EMAIL_EXACT_MATCH", "EMAIL", email), ("REFERENCE_MATCH", "REFERENCE", reference)) if v and v in own(k)]
        if upi and "UPI_EXACT_MATCH" not in codes:
            handle, domain = upi.split("@")
            pairs = [sorted((handle, v.split("@")[0]), key=len) for v in own("UPI")]
            if any(len(a) >= 5 and len(a) / len(b) >= 0.5 and a in b for a, b in pairs):
                codes.append("UPI_PARTIAL_MATCH")
            elif any(v.split("@")[1] == domain for v in own("UPI")):
                codes.append("UPI_DOMAIN_MATCH")
        theirs, words = set(self.people[p].split()), {t.lower() for t in tokens}
        shared = theirs & words
        if normal and normal == self.people[p]:
            codes.append("NAME_EXACT_MATCH")
        elif shared:
            part = len(shared) >= 2 and len(shared) / min(len(theirs), len(words)) >= 0.5
            codes.append("NAME_PARTIAL_MATCH" if part else "NAME_SINGLE_TOKEN_MATCH")
            if method and method != "OTHER" and method in self.methods.get(p, ()):
                codes.append("NAME_PLUS_PAYMENT_METHOD")
        weights = [WEIGHTS[c] for c in codes]
        return codes, round(min(0.99, max(weights) + min(0.04, 0.02 * max(0, sum(w >= 0.5 for w in weights) - 1))), 4) if codes else 0

    def take(self, r):
        i, _, _, _, name, normal, tokens, upi, account, phone, email, reference, method = r
        found = [(p, *self.evidence(r, p)) for p in self.candidates(r)]
        found = sorted(((-s, p, c) for p, c, s in found if c), key=lambda x: x[:2])
        best = -found[0][0] if found else 0.0
        second = -found[1][0] if len(found) > 1 else None
        minted = bool(upi or account) and best < 0.55 and not any(EXACT & set(c) for _, _, c in found)
        if minted:
            person = max(self.people, default=0) + 1
            words = [w.title() for w in (upi or "").split("@")[0].replace(".", "-").replace("_", "-").split("-") if w.isalpha()]
            canonical = name or " ".join(words) or (f"A/C {account}" if account else "Unknown counterparty")
            self.people[person] = normal or canonical.lower()
            self.values += [(person, k, v) for k, v in (("UPI", upi), ("ACCOUNT", account), ("PHONE", phone), ("EMAIL", email)) if v]
            status, confidence = "MATCH", 0.9
        else:
            person, confidence = (found[0][1], best) if found else (None, None)
            if not found:
                status = "UNKNOWN"
            elif best >= 0.8:
                status = "AMBIGUOUS" if second is not None and second >= 0.8 and best - second <= 0.05 else "MATCH"
            elif best >= 0.55:
                status = "AMBIGUOUS" if second is not None and best - second < 0.1 else "MATCH"
            else:
                status = "AMBIGUOUS"
        if status == "MATCH":
            owned = {(k, v) for _, k, v in self.values}
            self.values += [(person, k, v) for k, v in (("UPI", upi), ("ACCOUNT", account), ("PHONE", phone), ("EMAIL", email), ("REFERENCE", reference)) if v and (k, v) not in owned]
            self.methods.setdefault(person, set()).add(method)
        return i, status, person if status == "MATCH" else None, person, confidence, len(found) + minted, minted


def draws(seed, n):
    rng = random.Random(seed)
    first, last = ["Asha", "Ravi", "Kalyan", "Meera", "Om", "Zoya"], ["Kumar", "Rao", "Iyer", "Khan", "Li"]
    rows = []
    for i in range(n):
        name = rng.choice([None, rng.choice(first), f"{rng.choice(first)} {rng.choice(last)}", f"{rng.choice(first)} {rng.choice(first)} {rng.choice(last)}"])
        handle = rng.choice([None, None, rng.choice(first).lower() + rng.choice(["", "12", ".x", "pavan", "12345"])])
        rows.append(row(
            i, rng.randrange(4), rng.randrange(n), name, f"{handle}@{rng.choice(['okaxis', 'ybl', 'oksbi'])}" if handle else None, rng.choice([None, None, None, f"XXXX{rng.randrange(1, 9)}234"]),
            rng.choice([None] * 6 + ["9000000001", "9000000002"]), rng.choice([None] * 6 + ["a@b.org", "c@d.org"]), rng.choice([None, f"REF{rng.randrange(n // 3)}"]), rng.choice([None, "UPI", "NEFT", "OTHER"]),
        ))
    return rows


PEOPLE = [(3, "P003", "Asha Rao", "asha rao"), (5, "P005", "Om", "om")]
OWNED = [(3, "UPI", "asha.x@ybl"), (5, "PHONE", "9000000001"), (5, "ACCOUNT", "XXXX7234")]


@pytest.mark.parametrize(("seed", "n", "people", "limit"), [(1, 60, [], None), (2, 150, PEOPLE, 8), (3, 120, PEOPLE, 2)])
def test_equals_one_row_after_another(spark, seed, n, people, limit):
    rows = draws(seed, n)
    rng = random.Random(seed)
    owned = OWNED if people else []
    plain = Ledger(people, owned, limit)
    wanted = sorted(plain.take(r) for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])))
    rng.shuffle(rows)
    persons = spark.createDataFrame(people, "id long, code string, canonical_name string, normalized_name string")
    values = spark.createDataFrame(owned, "person_id long, id_type string, normalized_value string")
    decisions, everyone, identifiers = replay.replay(spark.createDataFrame(rows, SCHEMA), persons, values, limit=limit)
    got = sorted((r.id, r.status, r.person_id, r.suggested_person_id, r.confidence, r.n_candidates, r.minted) for r in decisions.collect())
    assert got == wanted
    assert {r.id: r.normalized_name for r in everyone.collect()} == plain.people
    assert {tuple(r) for r in identifiers.filter("id_type <> 'NAME'").collect()} == {v for v in plain.values if v[1] != "NAME"}


def test_no_rows(spark):
    persons = spark.createDataFrame(PEOPLE, "id long, code string, canonical_name string, normalized_name string")
    values = spark.createDataFrame(OWNED, "person_id long, id_type string, normalized_value string")
    decisions, everyone, _ = replay.replay(spark.createDataFrame([], SCHEMA), persons, values)
    assert decisions.count() == 0 and everyone.count() == 2


def test_equal_narrations_are_decided_once(spark, monkeypatch):
    """Many rows of few kinds: a round looks at the kinds' epochs only. Rows whose own person never is among the candidates each mint; references of single rows reach their person."""
    people, owned = [(3, "P003", "Zed", "zed")], [(3, "UPI", "zed@ybl")]
    kinds = [dict(name="Asha Rao", account="XXXX1234"), dict(name="Asha Rao", phone="9000000001"), dict(name="Om")]
    rows = [row(i, 1, i, **kinds[i % 3], method="NEFT", reference=f"R{i}") for i in range(120)] + [row(120 + i, 2, i, "Ravi Li", "ravi@ybl") for i in range(5)]
    asked = []
    plain_evidence = replay.evidence

    def counted(narrations, *args, **kw):
        asked.append(narrations.count())
        return plain_evidence(narrations, *args, **kw)

    monkeypatch.setattr(replay, "evidence", counted)
    plain = Ledger(people, owned, 1)
    wanted = sorted(plain.take(r) for r in rows)
    persons = spark.createDataFrame(people, "id long, code string, canonical_name string, normalized_name string")
    values = spark.createDataFrame(owned, "person_id long, id_type string, normalized_value string")
    decisions, everyone, identifiers = replay.replay(spark.createDataFrame(rows, SCHEMA), persons, values, limit=1)
    assert sorted((r.id, r.status, r.person_id, r.suggested_person_id, r.confidence, r.n_candidates, r.minted) for r in decisions.collect()) == wanted
    assert sum(w[-1] for w in wanted) == 6
    assert {tuple(r) for r in identifiers.filter("id_type <> 'NAME'").collect()} == {v for v in plain.values if v[1] != "NAME"}
    assert max(asked) < 25
