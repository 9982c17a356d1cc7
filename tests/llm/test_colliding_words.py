"""Two words of 1,024 letters that agree in every polynomial hash modulo 2**64: no operator may take one for the other."""

import numpy as np

from ledgerline.llm import common, logfreq, simhash, substring_index, tiling

PARITY = ["ab"[bin(i).count("1") & 1] for i in range(1024)]
ONE, OTHER = "".join(PARITY), "".join("ba"[x == "b"] for x in PARITY)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_they_collide_in_polynomials_and_not_in_digests():
    data = np.frombuffer(f"{ONE} {OTHER}".encode(), np.uint8)
    starts, ends = np.array([0, 1025]), np.array([1024, 2049])
    for base, seed in ((0x9E3779B97F4A7C15, 1), (0xD6E8FEB86659FD93, 2)):
        a, b = common.word_hashes(data, starts, ends, common.Polynomial(base), common.byte_table(seed))
        assert a == b
    a, b = common.word_digests(data, starts, ends)
    assert (a != b).all()


def test_substring_dedup(spark):
    same = " ".join(f"w{i}" for i in range(49))
    found = substring_index.remove_repeats(docs(spark, [(1, f"{same} {ONE}"), (2, f"{same} {OTHER}"), (3, f"{same} {ONE}")])).collect()
    assert {(r.doc_id, r.n_words, r.n_removed) for r in found} == {(1, 50, 0), (2, 50, 0), (3, 50, 50)}


def test_lm_scoring(spark):
    import zlib

    held, learnt = ([i for i in range(40) if (zlib.crc32(str(i).encode()) % 5 == 1) == h] for h in (True, False))
    rows = [(i, f"{ONE} word") for i in learnt[:5]] + [(held[0], OTHER), (held[1], ONE)]
    found = {r.doc_id: r for r in logfreq.score_documents(docs(spark, rows)).collect()}
    assert (found[held[0]].n_known, found[held[1]].n_known) == (1, 2)


def test_tiling(spark):
    bench = spark.createDataFrame([(7, f"one two three four five {ONE}")], "item_id long, text string")
    found = tiling.leaks(docs(spark, [(1, f"one two three four five {OTHER}"), (2, f"one two three four five {ONE}")]), bench).collect()
    assert {(r.doc_id, r.covered_words) for r in found} == {(1, 5), (2, 6)}


def test_running_hashes_of_many_words(spark):
    # Sequences of 1,024 words of two kinds agree in the running hash too; the words decide.
    one, other = (" ".join({"a": "left", "b": "right"}[c] for c in x) for x in (ONE, OTHER))
    head = "one two three four five six seven"
    bench = spark.createDataFrame([(7, f"{head} {one}")], "item_id long, text string")
    found = tiling.leaks(docs(spark, [(1, f"{head} {other}"), (2, f"{head} {one}")]), bench, coverage=0.0).collect()
    by_id = {r.doc_id: r for r in found}
    assert (by_id[2].n_tiles, by_id[2].covered_words) == (1, 1031)
    assert by_id[1].n_tiles > 1  # its parts stand elsewhere in the item, but it is no single match


def test_near_duplicates(spark):
    assert simhash.keep_one(docs(spark, [(1, ONE), (2, OTHER), (3, ONE)])).count() == 2
