"""Operators 2 and 7."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import packing, reply_trees
from ledgerline.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
NODES = "conv_id long, node long, parent long, role string, text string, score double, leaf string, tree int"


@given(st.lists(st.tuples(st.text(alphabet="<|\\>turnend a", max_size=12), st.text(alphabet="<|\\>turnextd a", max_size=20)), max_size=5))
def test_format_round_trip(turns):
    formatted, mask = reply_trees.format_turns(turns)
    assert reply_trees.read_turns(formatted) == turns
    assert [reply_trees.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r == reply_trees.LEARNED_ROLE]


def test_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 0.5), (1, 3, 1, "assistant", "b", 0.9), (1, 4, 3, "user", "c", 0.1), (1, 5, 4, "assistant", "</s>", 0.9),
        (2, 1, 9, "user", "lost parent", 1.0), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, "user", "nobody's", 1.0), (4, 1, 1, "user", "own parent", 1.0),
    ]
    nodes = spark.createDataFrame([(*r, "x", 0) for r in rows], NODES)
    made = {(r.conv_id, r.rank): reply_trees.read_turns(r.formatted) for r in reply_trees.format_trees(nodes, None).collect()}
    assert made == {
        (1, 1): [("user", "q"), ("assistant", "a")],  # mean 0.75
        (1, 2): [("user", "q"), ("assistant", "b"), ("user", "c"), ("assistant", "</s>")],  # mean 0.725
        (2, 1): [("user", "lost parent")], (None, 1): [("user", "nobody's")], (4, 1): [("user", "own parent")],
    }
    assert reply_trees.format_trees(nodes).count() == 4
    assert reply_trees.format_trees(nodes.limit(0)).count() == 0


def test_what_hangs_on_a_cycle_is_left_out(spark):
    """A leaf under a cycle beside a long chain: rows stay bounded by the nodes kept."""
    chain = [(1, i, i - 1 if i else None, "user", f"t{i}", 1.0) for i in range(990)]
    odd = [(2, 1, 2, "user", "a", 1.0), (2, 2, 1, "user", "b", 1.0), (2, 3, 2, "user", "leaf on a cycle", 1.0), (2, 4, None, "user", "fine", None), (2, None, 4, "user", "no node", 1.0)]
    nodes = spark.createDataFrame([(*r, "x", 0) for r in chain + odd], NODES)
    paths = reply_trees.root_paths(nodes, None)
    assert paths.count() == 991
    made = {r.conv_id: reply_trees.read_turns(r.formatted) for r in reply_trees.format_trees(nodes, None).collect()}
    assert made == {1: [("user", f"t{i}") for i in range(990)], 2: [("user", "fine")]}


def test_branches_match_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for tree in range(30):
        n = rng.randint(1, 40)
        rows += [(tree, i, rng.choice([None, rng.randrange(n), max(0, i - 1)]), rng.choice(["user", "assistant"]), f"{tree}.{i}", rng.choice([0.0, 0.5, 1.0])) for i in range(n)]
    want = []
    for tree in range(30):
        own = {r[1]: r for r in rows if r[0] == tree}
        parent = {i: None if r[2] == i or r[2] not in own else r[2] for i, r in own.items()}
        found = []
        for leaf in own.keys() - set(parent.values()):
            path = [leaf]
            while (up := parent[path[-1]]) is not None and len(path) <= len(own):
                path.append(up)
            if len(path) <= len(own):
                found.append((-sum(own[i][5] for i in path) / len(path), leaf, path[::-1]))
        want += [(tree, k + 1, leaf, [own[i][3:5] for i in path]) for k, (_, leaf, path) in enumerate(sorted(found)[:3])]
    nodes = spark.createDataFrame([(*r, "x", 0) for r in rows + rows[:50]], NODES)  # some nodes given twice
    got = sorted((r.conv_id, r["rank"], r.leaf, reply_trees.read_turns(r.formatted)) for r in reply_trees.format_trees(nodes, 3).collect())
    assert got == want


def test_long_chain_and_repeated_turns(spark):
    turns = spark.createDataFrame([(1, i // 2, "user", f"t{i}") for i in range(301)] + [(2, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: reply_trees.read_turns(r.formatted) for r in reply_trees.format_trees(reply_trees.chains(turns)).collect()}
    assert got[1] == [("user", t) for _, t in sorted((i // 2, f"t{i}") for i in range(301))]
    assert got[2] == [("", "")]


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    groups = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        groups.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    groups[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in QUERIES["op2_reply_trees"](spark, sf).collect():
        turns = sorted(groups.pop(r.conv_id))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{t}\n" for _, a, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert not groups


def test_encoder_agrees_with_the_tokenizer(spark):
    tokenizer, ours = Tokenizer.from_file(PATH), packing.encoder(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", "  \t", "Don't we'LL 3.14,15!?", "ÀÉ öÖß ÷×÷ é, É. İx", "a<|endoftext|>b", "日本語。 тест…!", "x\x1cy\x85z w v", "'s's 's,", "ŒUVRE ΣΑΣ. é!! É??"]
    for text in texts:
        assert ours.ids(text.encode()) == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["<|ENDOFTEXT|>", "<|startOfText|>", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "|", "End", "é", "Ab", " ", "\n", ".", "9", "'S", "<"]), max_size=9))
def test_special_tokens_of_any_case(parts):
    text = "".join(parts)
    assert packing.encoder(PATH).ids(text.encode()) == np.asarray(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_cover_every_id_once(spark):
    sf, tokenizer = "/root/testdata/sf0.001", Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000)], docs.schema))
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    seen, sequences = {}, {}
    for p in packing.pack_documents(docs, PATH).collect():
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert len(own) == p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.asarray(own, "<u4").tobytes())
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places, whole in [(sorted(v), len(ids[k])) for k, v in seen.items()] + [(sorted(v), None) for v in sequences.values()]:
        at = 0
        for start, length in places:
            assert start == at
            at += length
        assert whole is None or at == whole
    assert seen.keys() == ids.keys()
    lengths = [sum(n for _, n in v) for v in sequences.values()]
    assert max(lengths) <= 4096
    padding = sum(4096 - n for n in lengths if n & (n - 1))
    assert padding <= 0.01 * sum(lengths)


def test_cuts_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(60):
        positions = [0, *itertools.accumulate(rng.randint(1, 5) for _ in range(9))]
        penalties = [0, *(rng.randint(0, 4) for _ in range(9))]

        def cost(cuts):
            at = [0, *cuts]
            if any(positions[b] - positions[a] > 8 for a, b in zip(at, at[1:])) or positions[-1] - positions[at[-1]] >= 8:
                return None
            return sum(8 - positions[b] + positions[a] + penalties[b] for a, b in zip(at, at[1:]))

        best = min(c for n in range(10) for cuts in itertools.combinations(range(1, 10), n) if (c := cost(cuts)) is not None)
        assert cost(packing.best_cuts(positions, penalties, 8)) == best


def test_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string, start int"), PATH).count() == 0
