import hashlib
import re

import numpy as np
import pytest

from ledgerline.llm import infilling

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def expected(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ROWS = [
    (1, "Plain words, with stops. And 12 numbers!"), (2, None), (3, ""), (4, "é中文 mixed ß text 😀 end"), (5, "holds <P> already"), (6, "almost <S and M> <"), (7, "<"),
    (8, "wörd " * 5000), (9, "x" * 40000), (10, "\n\t \x00\r"), (11, "中" * 3000), (4, "é中文 mixed ß text 😀 end"), (None, "no id at all"), (-3, "a<S" * 700), (12, "a1" * 4000),
]


@pytest.mark.parametrize("step", [1, 7, 512])
def test_forms_cuts_and_round_trip(spark, step):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "doc_id long, text string, form string, n long").repartition(3)
    found = infilling.transform(docs, step=step).withColumn("back", infilling.restored()).collect()
    key = lambda r: (r[0] is None, r[0], r[-1])
    wanted = [(i, *expected(i, t), t or "") for i, t in ROWS]
    assert sorted((tuple(r) for r in found), key=key) == sorted(wanted, key=key)


def test_many_ids_meet_every_form(spark):
    rows = [(i, f"Text {i} of <some> wörds " * (i % 9)) for i in range(600)]
    found = infilling.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == {i: expected(i, t) for i, t in rows}
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_checkpoints_are_sparse_and_blocks_do_not_matter():
    text = ("wörd, 中文 and more " * 900).encode()
    data = np.frombuffer(text, np.uint8)
    starts = [m.start() for m in UNITS.finditer(text.decode())]
    for step, block in ((16, 33), (16, 1 << 20), (100, 4096)):
        index = infilling.Checkpoints(data, step, block)
        assert index.units == len(starts) and len(index.places) == -(-len(starts) // step)
        for unit in (0, 1, step - 1, step, len(starts) // 2, len(starts) - 1):
            byte, char = index.locate(unit)
            assert char == starts[unit] and text[:byte].decode() == text.decode()[:char]
        assert index.locate(len(starts)) == (len(text), len(text.decode()))


def test_empty_table(spark):
    assert infilling.digests(infilling.transform(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
