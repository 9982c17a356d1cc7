"""Slices of nothing but empty texts, for the operators that look at bytes."""

import public_tokenizers
import pyarrow as pa
import pytest

from ledgerline.llm import logfreq, packing, pii, quality, simhash, substring_index, suffix_dedup, tiling
from ledgerline.llm.common import text_bytes


@pytest.mark.parametrize("texts", [[None], [""], ["", None, "\n"], [" \t\n"], ["\n\n"]])
def test_nothing_to_see(spark, texts):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    n = len(texts)
    assert substring_index.remove_repeats(docs).count() == suffix_dedup.remove_repeats(docs).count() == n
    assert quality.judge(docs, labels).filter("not kept").count() == n and quality.keep(docs, labels).count() == 0
    assert logfreq.score_documents(docs).filter("n_tokens = 1").count() == n
    assert packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).filter("length = 1").count() == n
    assert pii.find(docs).filter("spans = ''").count() == n
    assert tiling.leaks(docs, bench).count() == 0 and tiling.clean(docs, bench).count() == n
    assert simhash.near_duplicates(docs).filter("fp = 0 and component_id = 0").count() == n
    assert logfreq.token_hashes(*text_bytes(pa.array(texts, pa.string())))[1][-1] == n
