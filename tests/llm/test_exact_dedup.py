"""Operators 1 and 3 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from ledgerline.llm import substring_index, suffix_dedup
from ledgerline.llm.suffix_sort import Suffixes, repeated_windows

SCHEMA = "doc_id long, text string, id string, place int, gram long"  # with names that clash with the operators' own


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def pieces(seed):
    rng = random.Random(seed)
    base = [rng.choice("abcd") + str(rng.randint(0, 9)) for _ in range(600)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 550)
            text += base[a : a + rng.randint(5, 120)] + ["x"] * rng.choice([0, 1, 3, 70])
        rows.append((i * 3, rng.choice([" ", "\t", "  \n"]).join(text)))
    return rows + [(500, None), (501, ""), (502, "a " * 900), (503, "a " * 901), (504, "é" * 400), (505, rows[5][1]), (506, rows[5][1])]


def brute_words(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        own, gone = set(), set()
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            if key in seen:
                gone |= set(range(p, p + 50))
            own.add(key)
        seen |= own
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def brute_bytes(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("options", [{"batches": 1}, {"batches": 4, "group": 5}])
def test_words_match_brute_force(spark, options):
    rows = pieces(1)
    got = {r[0]: tuple(r)[1:4] for r in substring_index.remove_repeats(table(spark, rows), **options).collect()}
    assert got == brute_words(rows)


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 3])
def test_bytes_match_brute_force(spark, group):
    rows = pieces(2)
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(table(spark, rows), group=group).collect()}
    assert got == brute_bytes(rows)


def test_empty_tables_and_null_ids(spark):
    empty = table(spark, [])
    assert substring_index.remove_repeats(empty).count() == suffix_dedup.remove_repeats(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    rows = table(spark, [(None, text), (7, text), (None, "other")])
    got = {(r.doc_id, r.n_removed) for r in substring_index.remove_repeats(rows).collect()}
    assert got == {(7, 0), (None, 80), (None, 0)}
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(rows).collect()}
    assert got == {(7, 0), (None, len(text)), (None, 0)}


def test_index_over_two_sessions(spark):
    """Opened, appended to, compacted and opened again by a later session; a batch that fails leaves the state as it was."""
    rows = pieces(7)
    ids = sorted(i for i, _ in rows)
    parts = [[r for r in rows if a <= r[0] < b] for a, b in zip([0, ids[20], ids[40], ids[55]], [ids[20], ids[40], ids[55], 10**9])]
    batch = lambda part, session: session.createDataFrame(part, "id long, text string")
    first = substring_index.FingerprintIndex(spark, buckets=3)
    spans = [first.add(batch(parts[0], spark)), first.add(batch(parts[1], spark))]
    root, state = first.root, first.state
    first.close()
    later = spark.newSession()
    second = substring_index.FingerprintIndex(later, root, buckets=99)
    assert second.buckets == 3 and second.state == state and len(second._runs()) == 1
    broken = batch(parts[2], later).selectExpr("id", "if(id >= 0, cast(raise_error('lost') as string), text) as text")
    with pytest.raises(Exception, match="lost"):
        second.add(broken)
    again = substring_index.FingerprintIndex(later, root)
    assert again.state == state and again.levels == second.levels
    spans += [again.add(batch(p, later)) for p in parts[2:]]
    assert again.state == state + 2
    found = [tuple(r) for part in spans for r in part.collect()]
    texts = {i: re.split(r"[\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i, want in brute_words(rows).items():
        gone = {p for j, a, b in found if j == i for p in range(max(0, a), min(b, len([w for w in texts[i] if w])))}
        assert len(gone) == want[1], i
    again.drop()
    assert not spark.catalog.listTables("default", "fingerprint_run_*")


def test_large_ids_stay(spark):
    rows = table(spark, [((3 << 61) + 5, "a b"), ((1 << 63) - 1, "c")])
    for out in (substring_index.remove_repeats(rows), suffix_dedup.remove_repeats(rows)):
        assert {r.doc_id for r in out.collect()} == {(3 << 61) + 5, (1 << 63) - 1}


def test_kept_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = table(spark, [(1, text), (2, "head " + text + " tail")])
    assert substring_index.remove_repeats(rows, keep_text=True).filter("doc_id = 2").first().kept == "head tail"
    assert bytes(suffix_dedup.remove_repeats(rows, keep_text=True).filter("doc_id = 2").first().kept) == b"head  tail"


def test_suffix_order_is_the_lexicographic_one():
    rng = random.Random(3)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(300)]
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    sizes = np.array([1, 7, 92, 200])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    order = Suffixes(buffer, ends - [len(p) for p in parts], ends).order(starts, sizes)
    for a, n in zip(starts, sizes):
        want = sorted(range(a, a + n), key=lambda i: (parts[i], i))
        assert list(order[a : a + n]) == want


def test_repeated_windows_by_hand():
    rng = random.Random(4)
    gram, window = 4, 9
    parts = [bytes(rng.choice(b"ab") for _ in range(5)) + b"GRAM" + bytes(rng.choice(b"ab") for _ in range(5)) for _ in range(60)]
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    begins = np.arange(60) * 14
    found = repeated_windows(buffer, begins + 5, begins, begins + 14, np.arange(60) // 20, window, gram)
    for i in range(60):
        for o in range(window - gram + 1):
            own = parts[i][5 - o : 5 - o + window]
            assert found[i, o] == any(parts[j][5 - o : 5 - o + window] == own for j in range(i // 20 * 20, i))


def test_windows_that_agree_in_part_of_their_digest_differ(spark):
    # Windows that differ in their last word only: of two million, some agree in 40 bits of the digest.
    n, fixed = 2_000_000, [f"w{i}" for i in range(49)]
    ends = [f"x{i}" for i in range(n)]
    data = np.frombuffer(" ".join(fixed + ends).encode(), np.uint8)
    starts, stops, _ = substring_index.word_spans(data, np.array([0, len(data)]))
    hashes = substring_index.word_digests(data, starts, stops)[:, 1]
    power = lambda k: pow(substring_index.POLY_B.base, k, 1 << 64)
    head = sum(int(h) * power(k) for k, h in enumerate(hashes[:49])) % (1 << 64)
    digests = substring_index.mix(np.uint64(head) + hashes[49:] * np.uint64(power(49))) & np.uint64((1 << 40) - 1)
    order = np.argsort(digests)
    same = np.flatnonzero(digests[order][1:] == digests[order][:-1])
    assert len(same)
    rows = []
    for k in same.tolist():
        rows += [(len(rows) + j, " ".join([*fixed, ends[order[k + j]]])) for j in (0, 1)]
    got = {r[0]: tuple(r)[1:4] for r in substring_index.remove_repeats(table(spark, rows), batches=1).collect()}
    assert got == brute_words(rows)


def test_short_repeats_bring_no_contexts(spark):
    """Strings of 60 bytes that many texts share, and no window: nothing is compared by bytes. A window that leans to either side of its gram is."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = [noise(60) for _ in range(20)]
    texts = [noise(150) + common[i % 20] + noise(150) for i in range(80)]
    judged = lambda rows: suffix_dedup._judge_contexts(suffix_dedup._anchor_rows(spark.createDataFrame(rows, "id long, text string"), 100), suffix_dedup.GROUP)
    assert judged(list(enumerate(texts))).count() == 0
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(20):
        a = rng.randint(0, 250)
        rows.append((100 + i, noise(rng.randint(0, 80)) + texts[i][a : a + 100 + i % 3] + noise(rng.randint(0, 80))))
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got == brute_bytes(rows) and sum(v[1] for v in got.values()) > 2000
