"""Operators 8, 9 and 10, and the pipeline."""

import collections
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import pii, simhash, tiling
from ledgerline.llm.common import shared_path

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    luhn = lambda s: sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=400)
@given(st.text(alphabet="a1.@+-_ 0(25)", max_size=60))
def test_base_spans_match_plain_search(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_very_long_runs_are_linear():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+1 " * 100_000, "a@" * 100_000, "4" * 16 + "-" * 100_000):
        pii.base_spans(text)
        pii.identifiers(text, [])


def test_patterns_discover_what_the_base_misses(spark):
    rng = random.Random(1)
    seeds = [(i, f"words {rng.random()} here mail to: user{i}@host{i}.example.org now") for i in range(20)]
    rows = seeds + [(100, "please mail to: user7[at]example now"), (101, "nothing personal 4711 here"), (102, None), (103, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    assert found[100].n_email == 0 and found[100].spans == "email:16:32"
    assert found[101].spans == found[102].spans == found[103].spans == ""
    assert all(found[i].n_email == 1 for i in range(20))
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[100] == "please mail to: [EMAIL] now" and masked[102] is None and "@" not in masked[3]
    assert pii.mask(docs).columns == docs.columns and pii.find(docs.limit(0)).count() == 0


def test_candidates():
    def found(text):
        return [text[a:b] for a, b in pii.identifiers(text, pii.base_spans(text))]

    assert found("call 020 7946 0123, or (020) 7946-0999. In 2024") == ["020 7946 0123", "020) 7946-0999", "2024"]
    assert found("key=" + "a1" * 300 + " (plain) user: someone b") == ["a1" * 300, "plain", "someone"]
    assert pii.patterns("x " * 60 + "w" * 500 + " says: 1234", 120 + 500 + 7)[1] == "w" * 500 + " says: "
    assert found("one two three") == [] and found("") == []


def brute_learn(texts, confidence=0.8):
    """Patterns accepted by the graph of all texts, with plain dictionaries."""
    graph = {}
    for text in texts:
        base = pii.base_spans(text or "")
        for kind, a, b in [*base, *((None, a, b) for a, b in pii.identifiers(text or "", base))]:
            kind = kind or ("secret" if pii._SECRET.fullmatch(text[a:b]) else None)
            for p in pii.patterns(text, a):
                graph[p, text[a:b]] = max(graph.get((p, text[a:b])) or "", kind or "") or None
    known = {}
    for (_, v), kind in graph.items():
        if kind:
            known[v] = max(known.get(v, ""), kind)
    while True:
        accepted = {}
        for p in {p for p, _ in graph}:
            values = [v for q, v in graph if q == p]
            count = {k: sum(known.get(v) == k for v in values) for k in pii.LEARNED}
            if max(count.values()) / (len(values) + 2) >= confidence:
                accepted[p] = (next(k for k in pii.LEARNED if count[k] == max(count.values())), max(count.values()) / (len(values) + 2))
        beliefs = {}
        for p, v in graph:
            if p in accepted and v not in known:
                kind, score = accepted[p]
                beliefs[v, kind] = beliefs.get((v, kind), 1.0) * (1 - min(score, 0.999))
        new = {}
        for (v, kind), doubt in beliefs.items():
            if 1 - doubt >= confidence:
                new[v] = max(new.get(v, (0, "")), (1 - doubt, kind))
        if not new:
            return {p: kind for p, (kind, _) in accepted.items()}
        known |= {v: kind for v, (_, kind) in new.items()}


def test_spans_match_brute_force(spark, monkeypatch):
    """Chains of contexts that need many rounds, repeated rows, ties of kinds, and patterns in several blocks."""
    rng = random.Random(6)
    texts = [f"write to: u{i}@h{i}.example.org or fax: code{i % 11}x now" for i in range(16)]
    texts += [f"level0 id: 10.0.{i // 250}.{i % 250} end" for i in range(2400)]
    for k, n in enumerate((560, 128, 29, 5)):  # each context vouches for instances of the next one
        texts += [f"level{k} id: serial-{k}-{i} end level{k + 1} id: serial-{k}-{i} end" for i in range(n)]
    texts += [f"tie: a{i}@b.example.org" for i in range(9)] + [f"tie: 10.9.9.{i}" for i in range(9)] + ["tie: 12345678"] * 3
    texts += [" ".join(rng.choice(["fax:", "to:", "id:", "call", "44 20 7946 0958", "x12345", '"quoted"', "plain"]) for _ in range(30)) for _ in range(40)]
    texts += texts[:20] + [None, ""]
    accepted = brute_learn(texts)
    assert "level3 id: " in accepted
    want = []
    for text in texts:
        base = pii.base_spans(text or "")
        added = []
        for a, b in pii.identifiers(text or "", base):
            kinds = [accepted[p] for p in reversed(pii.patterns(text, a)) if p in accepted]
            added += [(kinds[0], a, b)] if kinds else []
        want.append(pii._listed(sorted(base + added, key=lambda s: (pii._ORDER[s[0]], s[1]))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (pii.PATTERN_BLOCK, 5):
        monkeypatch.setattr(pii, "PATTERN_BLOCK", block)
        got = {r.doc_id: r.spans for r in pii.find(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def brute_tiles(item, text, least):
    used_i, used_t, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and i + n not in used_i and j + n not in used_t:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        used_i |= set(range(i, i + n))
        used_t |= set(range(j, j + n))
        covered += n


def test_tiling_matches_brute_force(spark):
    rng = random.Random(2)
    for turn in range(120):
        words = [f"w{i}" for i in range(25)] if turn % 2 else [rng.choice("ab") + "x" for _ in range(25)]
        parts = [words[a : a + rng.randint(2, 9)] for a in (rng.randint(0, 20) for _ in range(4))]
        text = [w for p in parts for w in [*p, "zz"]]
        want = brute_tiles(words, text, 3)
        for coverage in (0.01, 0.6):
            block = tiling.Block([1], [" ".join(words)], 3, coverage)
            got = {(r, i): c for r, i, c, _ in block.pairs(tiling.Texts(pa.array([" ".join(text)]), 3))}
            assert got.get((0, 0), 0) == want or want < coverage * 25 and not got


def test_repeated_words_and_shared_phrases_stay_cheap():
    """An item of equal words against a text of equal words, and a phrase that all items share: neither makes pairs of all places."""
    began = time.time()
    block = tiling.Block([1], ["same " * 1000], 5, 0.6)
    texts = tiling.Texts(pa.array(["same " * 10_000]), 5)
    assert len(tiling.matches(block, 0, texts, 0)[0]) == 9996 + 996 - 1
    assert list(block.pairs(texts)) == [(0, 0, 1000, 1)]
    phrase = " ".join(f"p{i}" for i in range(12))
    own = [" ".join(f"o{i}.{k}" for k in range(20)) for i in range(2000)]
    block = tiling.Block(list(range(2000)), [f"{phrase} {x}" for x in own], 5, 0.6)
    texts = tiling.Texts(pa.array([f"{phrase} and something else entirely " * 20, f"x {own[7]} y {phrase} z"]), 5)
    assert list(block.pairs(texts)) == [(1, 7, 52, 2)]
    assert time.time() - began < 20


def test_blocks_of_the_benchmark(spark, monkeypatch):
    """Several blocks, one pass each: the same leaks; repeated rows are each reported."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.union(docs.limit(30))
    whole = sorted(map(tuple, tiling.leaks(docs, bench).collect()))
    left = sorted(r.doc_id for r in tiling.clean(docs, bench).collect())
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 1 + bench.selectExpr("sum(length(text))").first()[0] // 3)
    assert sorted(map(tuple, tiling.leaks(docs, bench).collect())) == whole and len(whole) > 10
    assert sorted(r.doc_id for r in tiling.clean(docs, bench).collect()) == left


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "intro Eta, theta iota kappa lambda MU. then alpha beta gamma delta epsilon zeta end"
    docs = spark.createDataFrame([(1, item, "a"), (2, moved, "a"), (3, "alpha beta gamma delta epsilon only", "a"), (4, None, "a"), (5, "", "a"), (None, item, "a")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(9, item), (10, "too short"), (11, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_tiles) for r in tiling.leaks(docs, bench).collect()} == {(1, 9, 1), (2, 9, 2), (None, 9, 1)}
    assert {r.doc_id for r in tiling.clean(docs, bench).collect()} == {3, 4, 5}
    assert tiling.clean(docs, bench.limit(0)).count() == 6 and tiling.leaks(docs.limit(0), bench).count() == 0


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    sums = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            sums[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * sums[b] > len(shingles))


def components(values, radius):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def test_bk_tree_finds_all():
    rng = random.Random(3)
    values = [rng.getrandbits(12) for _ in range(200)]
    tree = simhash.BKTree()
    for v in dict.fromkeys(values):
        tree.add(v)
    for q in (rng.getrandbits(12) for _ in range(50)):
        assert {tree.values[i] for i in tree.within(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


def test_links_survive_small_trees(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = list(dict.fromkeys(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 2))) & (1 << 64) - 1 for b in base for _ in range(12)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    from ledgerline.llm.components import connected_components

    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, tree_size=3)
    roots = {r.node: r.root for r in connected_components(links, "a", "b").collect()}
    want = components(values, 3)
    by_root = {}
    for v, w in zip(signed, want):
        by_root.setdefault(w, []).append(v)
    for group in by_root.values():
        assert len({roots.get(v, v) for v in group}) == 1
    assert len({roots.get(v, v) for v in signed}) == len(by_root)


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("fp"), F.lit(2).alias("component_id"))
    docs = docs.union(spark.createDataFrame([(9001, None, 1, 2), (9002, "", 1, 2), (9003, "One two", 1, 2), (9004, "one TWO", 1, 2)], docs.schema))
    rows = docs.collect()
    values = [plain_simhash(r.text) for r in rows]
    want = components(values, 3)
    least = {}
    for r, w in zip(rows, want):
        least[w] = min(least.get(w, r.doc_id), r.doc_id)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    for r, v, w in zip(rows, values, want):
        assert got[r.doc_id].fp & (1 << 64) - 1 == v and got[r.doc_id].component_id == least[w]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_pairs(sets, similarity=0.8):
    """All pairs of rows with the similarity, over lists of the rows that have a shingle."""
    found, lists = collections.Counter(), collections.defaultdict(list)
    for i, own in enumerate(sets):
        for x in own:
            for j in lists[x]:
                found[j, i] += 1
            lists[x].append(i)
    return [(a, b) for (a, b), n in found.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n)]


def edited(rng, words, share):
    return [f"new{rng.random()}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("shard_size", [simhash.TREE_SIZE, 7])
def test_near_copies_are_found_and_only_these_go(spark, shard_size):
    """Recall of the pairs with a similarity of 0.8, measured by brute force, and every document that goes is linked to one that was."""
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    for k in range(40):
        words = [f"w{k}.{i}" for i in range(rng.choice([30, 120, 400]))]
        rows += [(100_000 + k * 100 + i, " ".join(edited(rng, words, rng.choice([0.01, 0.02, 0.03])))) for i in range(rng.choice([2, 5, 12]))]
    rows += [(200_000, None), (200_001, ""), (200_002, "one two"), (200_003, "One TWO"), (200_004, "one two three")]
    docs = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, `row` string, fp int")
    pairs = similar_pairs([shingles(t) for _, t in rows])
    pairs += [(i, j) for j, i in [(next(k for k, r in enumerate(rows) if not shingles(r[1])), m) for m, r in enumerate(rows) if not shingles(r[1])] if i != j]
    kept = simhash.keep_one(docs, shard_size=shard_size)
    assert kept.columns == docs.columns and kept.filter("row = 'mine' and fp = 1").count() == kept.count()
    stay = {r.doc_id for r in kept.collect()}
    left = [(a, b) for a, b in pairs if rows[a][0] in stay and rows[b][0] in stay]
    edits = [(a, b) for a, b in pairs if shingles(rows[a][1]) != shingles(rows[b][1])]
    assert len(edits) > 150 and len(left) <= 0.02 * len(edits)
    assert {r[0] for r in rows} - stay <= {rows[i][0] for p in pairs for i in p}
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_no_near_copy_is_missed(spark):
    """Pairs of a similarity of exactly 0.8 (40 of 50 shingles shared) and chains whose ends are linked over other texts only."""
    rows = []
    for k in range(300):
        words = [f"w{k}.{i}" for i in range(49)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:-5] + [f"v{k}.{i}" for i in range(5)]))]
    rows += [(5000 + n, " ".join([f"c{i}" for i in range(n, n + 60)])) for n in range(0, 40, 5)]
    stay = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert stay == {10 * k for k in range(300)} | {5000}


def test_rows_without_ids(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(None, text), (3, text), (3, text), (None, "quite another text of some words"), (None, "quite another text of some words")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text[:5]) for r in simhash.keep_one(docs).collect()) == [(0, "quite"), (3, "a b c")]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, "test")
        stage(spark, states[-1], sf).write.parquet(path)
        states.append(spark.read.parquet(path))
    judged, unique, clean, masked, packed = states[1:]
    assert all(s.columns == docs.columns for s in states[:-1])
    before, ids = judged.collect(), {r.doc_id for r in unique.collect()}
    pairs = similar_pairs([shingles(r.text) for r in before])
    assert sum(before[a].doc_id in ids and before[b].doc_id in ids for a, b in pairs) <= 0.02 * len(pairs)
    assert {r.doc_id for r in before} - ids <= {before[i].doc_id for p in pairs for i in p} and before and pairs
    assert not any(i in r.text.lower() for r in clean.collect() for i in items)
    assert clean.count() >= unique.count() * 0.9 and masked.count() == clean.count()
    assert not any(plain_spans(r.text) for r in masked.collect())
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in masked.collect()}
