"""One very long text among short, null and repeated ones, for every operator over documents."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import licenses, logfreq, packing, pii, quality, simhash, substring_index, suffix_dedup, tiling


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 30_000)}" for _ in range(300_000)]
    passage = " ".join(words[1000:1060])
    long = " ".join(words)
    rows = [(1, long), (2, f"head {passage} tail"), (3, None), (4, "short text"), (4, "short text"), (5, long + " and an end mail to: someone@example.org")]
    table = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").checkpoint()
    return table, long, passage


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_exact_dedup(docs):
    table, long, passage = docs
    words = by_id(substring_index.remove_repeats(table).collect())
    assert (words[1].n_words, words[1].n_removed, words[2].n_removed, words[5].n_removed) == (300_000, 0, 60, 300_000)
    octets = by_id(suffix_dedup.remove_repeats(table).collect())
    assert (octets[1].n_bytes, octets[1].n_removed, octets[5].n_removed) == (len(long), 0, len(long))
    assert len(passage) <= octets[2].n_removed <= len(passage) + 2 and octets[2].n_spans == 1


def test_counts_and_scores(spark, docs):
    table, long, _ = docs
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    judged = quality.judge(table, labels).collect()
    assert len(judged) == 6 and by_id(judged)[1].n_words == 300_000 and by_id(judged)[1].word_chars == len(long) - 299_999 and quality.keep(table, labels).count() >= 3
    scored = by_id(logfreq.score_documents(table).collect())
    assert scored[1].n_tokens == 300_001 and scored[3].n_tokens == 1 and scored[1].score > scored[5].score


def test_packing_and_spans(docs):
    table, long, _ = docs
    pieces = packing.pack_documents(table, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("each")).collect()
    assert by_id(pieces)[1].n == by_id(pieces)[1].each > 300_000 and by_id(pieces)[4].n == 2 * by_id(pieces)[4].each
    spans = by_id(pii.find(table).collect())
    assert spans[5].n_email == 1 and spans[5].spans.startswith(f"email:{len(long) + 21}:") and spans[1].n_email == 0


def test_copies_and_leaks(spark, docs):
    table, _, passage = docs
    assert {r.doc_id for r in simhash.keep_one(table).collect()} == {1, 2, 3, 4}
    groups = by_id(simhash.near_duplicates(table).collect())
    assert groups[5].component_id == 1 and groups[4].component_id == 4
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert {(r.doc_id, r.covered_words) for r in tiling.leaks(table, bench).collect()} == {(1, 60), (2, 60), (5, 60)}


def test_licenses_of_long_texts_and_ties(spark, docs):
    table, long, _ = docs
    files = table.select("doc_id", F.lit("a/x").alias("path"), "text")
    mit, apache = (next(t for name, t in licenses.TEMPLATES if name == n) for n in ("MIT", "Apache-2.0"))
    own = spark.createDataFrame([(10, "b/LICENSE", mit), (11, "b/COPYING", apache), (12, "b/y", "nothing"), (13, "a/z", long + "\n" + mit)], files.schema)
    got = by_id(licenses.scan(files.union(own), F.col("path").rlike("LICENSE|COPYING")).collect())
    assert (got[10].license, got[11].license, got[12].license, got[12].origin) == ("MIT", "Apache-2.0", "Apache-2.0", "inherited")  # of equal scores the smaller name
    assert got[13].license == "MIT" and got[1].license is None
