import random
import re
from itertools import combinations

import numpy as np
import pytest

from ledgerline.llm import set_join, set_relations


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {" ".join(words)} if words else set()


def expected(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        a, b = sets[x][1], sets[y][1]
        if a and 100 * len(a & b) >= 90 * len(a | b):
            parent[max(root(x), root(y))] = min(root(x), root(y))
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return [(i, len(s), least.get(root(x)) if s else i) for x, (i, s) in enumerate(sets)]


def found(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, class string, row int").repartition(5)
    return sorted(map(tuple, set_join.similar_documents(docs, **settings).collect()), key=str)


def group(rng, words, n, changes):
    """Copies of one text with some words changed, chains of small changes among them."""
    out = [list(words)]
    for _ in range(n - 1):
        base = list(rng.choice(out))
        for _ in range(rng.randint(1, changes)):
            base[rng.randrange(len(base))] = f"new{rng.randrange(10**6)}"
        out.append(base)
    return [" ".join(x) for x in out]


def corpus(seed=5):
    rng = random.Random(seed)
    text = lambda n: [f"w{int(rng.random() ** 2 * 400)}" for _ in range(n)]
    passage = text(60)
    texts = [" ".join(text(rng.randint(5, 150))) for _ in range(60)]
    texts += group(rng, text(150), 90, 6) + group(rng, text(40), 25, 1) + group(rng, text(300), 30, 9)
    texts += group(rng, text(1400), 14, 30) + group(rng, text(990), 10, 25)  # about and beyond the size that needs the wide signature
    texts += [" ".join(passage + text(rng.randint(3, 60))) for _ in range(40)] + [" ".join(text(2000))] * 2
    texts += [texts[3].upper(), texts[3] + " ", "\n".join(texts[4].split()), "one", "One", "one two", "one  two", "a b c", "x y z a b c d e f g h i", "x y z a b c d e f g h j", "é É ü", "é é ü"]
    rng.shuffle(texts)
    return list(enumerate(texts, 7)) + [(500, None), (501, ""), (502, " \t"), (None, texts[0]), (None, "nobody else says this"), (None, None), (7, texts[0])]


@pytest.mark.parametrize("settings", [{}, {"list_size": 8, "shard_tokens": 2000}])
def test_equals_all_pairs(spark, settings):
    rows = corpus()
    assert found(spark, rows, **settings) == sorted(expected(rows), key=str)


def test_empty_table_and_single_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(3, None)]) == [(3, 0, 3)] and found(spark, [(4, "a b c d")]) == [(4, 2, 4)]


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_local_join_connects_what_all_pairs_connect(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for size in (4, 12, 60, 200):
        base = rng.integers(0, 1 << 20, size).astype(np.uint64)
        for _ in range(25):
            own = base.copy()
            change = rng.random(size) < rng.choice([0.02, 0.06, 0.2])
            own[change] = rng.integers(0, 1 << 20, int(change.sum()))
            sets.append(np.unique(own))
    sets.append(np.empty(0, np.uint64))
    pairs = set_relations.links(sets, percent)
    good = lambda a, b: 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
    assert all(good(sets[a], sets[b]) for a, b in pairs) and len(pairs) < len(sets)

    def parts(edges):
        label = list(range(len(sets)))
        for a, b in edges:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        return label

    assert parts(pairs) == parts([(a, b) for a, b in combinations(range(len(sets) - 1), 2) if good(sets[a], sets[b])])


def test_position_blocks_lose_no_candidate_and_derived_answers_are_exact():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 30, 120).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(120) < rng.choice([0.03, 0.3]), rng.integers(0, 1 << 30, 120), base).astype(np.uint64)) for _ in range(150)]
    index = set_relations.SetIndex(sets, 90)
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for i in range(0, 150, 7):
        near = np.flatnonzero(exact[i] >= set_relations.needed(len(sets[i]), index.sizes, 90))
        assert set(near) <= set(index.candidates(i)) | {i}
        assert len(index.candidates(i)) < 150
        assert (index.answers(i) == exact[i]).all() and (index.derived((i + 1) % 150, i, exact[i]) == exact[(i + 1) % 150]).all()
        assert (index.overlap(i, near) == exact[i][near]).all()


def test_unlike_texts_of_middle_size_are_told_apart_before_the_exact_join(spark):
    """Texts that share a passage only: as candidates they would tie their groups together, and the larger the table, the more of them."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(900)] + passage) for _ in range(28)]
    texts += [" ".join(t.split()[5:]) for t in texts[:2]]
    docs = spark.createDataFrame([(i, i, t.encode()) for i, t in enumerate(texts)], "doc_id long, row long, text binary")
    both = set_join.cut(set_join.classes(docs, 5, 80))
    kept = both.filter("segment is null").drop("segment", "counts")
    name = {r["class"]: r["doc_id"] for r in kept.collect()}
    got = set_join.candidate_links(set_join.prefixes(docs, 5, 80, set_join.sketch(both)), kept, 80, 8192).collect()
    assert {tuple(sorted((name[r.a], name[r.b]))) for r in got} == {(0, 28), (1, 29)}


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_wide_signatures_never_exceed_the_difference(percent):
    rng = np.random.default_rng(percent)
    base = np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2))
    sets = [np.unique(np.r_[base[: int(n * f)], rng.integers(0, 1 << 63, n - int(n * f)).astype(np.uint64)]) for n in (300, 500, 1200, 2100, 5900) for f in (0.5, 0.9, 1)]
    apart = set_join._wide_apart([set_join._signature(s, set_join._width(len(s), percent)) for s in sets])
    for i, own in enumerate(sets):
        assert (apart(i, np.arange(len(sets))) <= [len(np.setxor1d(own, s)) for s in sets]).all()


def test_a_chain_with_side_sets_keeps_few_answers():
    """Each set of the chain finds another one and a side set; as many answers as sets would be kept at once."""
    import tracemalloc

    chain = [np.arange(2 * i, 2 * i + 20, dtype=np.uint64) for i in range(1500)]
    sets = [s for i, c in enumerate(chain) for s in (c, np.r_[c, np.uint64(10**6 + i)])]
    tracemalloc.start()
    got = set_relations.links(sets, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(sets) - 1 and peak < 12e6
