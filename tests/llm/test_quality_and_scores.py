"""Operators 4, 5 and 6."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerline.llm import licenses, logfreq, quality
from ledgerline.llm.common import text_bytes
from ledgerline.llm.text_features import features

SF = "/root/testdata/sf0.001"


def brute_features(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        repeats += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {i for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for i in range(k, k + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(inside)


def test_features_match_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [None, "", "\n\n", "a\n a\na\n\na", "a b c d e f g h a b c d e f g h", "é ü\x0bß", "x" * 5000, "\na\na"]
    got, _, _ = features(*text_bytes(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_features(text), text


def test_collisions_are_noticed(monkeypatch):
    """With hashes that know lengths only, lines, words and windows are still told apart."""
    from ledgerline.llm import text_features

    monkeypatch.setattr(text_features, "TABLE", np.zeros(256, np.uint64))
    monkeypatch.setattr(text_features, "WINDOW_POLY", text_features.Polynomial(1))
    texts = ["ab cd\nef gh\nab cd\n", "a b c d e f g h b a c d e f g h x y", " ".join("abcdefgh" * 3), None, "ab\ncd\nab"]
    got, _, _ = features(*text_bytes(pa.array(texts, pa.string())))
    for i, text in enumerate(texts):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_features(text)


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.3), (40, 0.1), (500, 0.01)):
        for k in range(0, n + 1, max(1, n // 13)):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(quality.binomial_tail(k, n, p), exact, rel_tol=1e-9)
    assert quality.binomial_tail(0, 10**7, 1e-6) > 0


def cutoff_rows(spark, n, spoilt=0):
    """Clean rows score 0 (``spoilt`` of them high), bad rows score high on one rule."""
    zero = [F.lit(0.0).alias(r) for r in quality.RULES if r != "symbols"]
    rows = spark.range(n + 200).withColumn("bad", F.col("id") >= n)
    high = F.when(F.col("bad") | (F.col("id") < spoilt), 0.5).otherwise(0.001)
    return rows.select(F.lit("s").alias("stratum"), "bad", high.alias("symbols"), *zero)


def test_cutoffs_need_enough_evidence(spark):
    options = {"alpha": 0.01, "delta": 0.05, "cost": 2.0}
    few = quality.certified_cutoffs(cutoff_rows(spark, 1000), cutoff_rows(spark, 100), **options).collect()
    assert few == []
    enough = quality.certified_cutoffs(cutoff_rows(spark, 1000), cutoff_rows(spark, 1000), **options).collect()
    assert [(r.stratum, r.rule) for r in enough] == [("s", "symbols")] and 0.001 < enough[0].cutoff < 0.5
    assert quality.certified_cutoffs(cutoff_rows(spark, 1000), cutoff_rows(spark, 1000, spoilt=30), **options).collect() == []


def greedy(rows, cost):
    """The path over all rows (``bad``, scores by rule), one move after another."""
    moves, grid = [], np.array(quality.GRID)
    bad, scores = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    while len(bad):
        worths = []
        for r in range(len(quality.RULES)):
            caught, clean = ((scores[x, r][:, None] > grid).sum(0) for x in (bad, ~bad))
            worths.append(np.where(caught > cost * clean, caught / (clean + 0.5), 0.0))
        r, at = divmod(int(np.argmax(worths)), len(grid))
        if worths[r][at] <= 0:
            break
        moves.append((quality.RULES[r], quality.GRID[at]))
        left = scores[:, r] <= grid[at]
        bad, scores = bad[left], scores[left]
    return moves


def test_the_path_is_laid_on_all_texts(spark):
    """A stratum of many texts and one of few: every text counts for the moves."""
    rng = np.random.default_rng(3)
    rows = []
    for stratum, n in (("many", 24_000), ("few", 300)):
        bad = rng.random(n) < 0.3
        scores = rng.random((n, len(quality.RULES))) ** np.where(bad, 0.3, 5)[:, None] * (rng.random((n, len(quality.RULES))) < 0.5)
        rows += [(stratum, bool(b), *map(float, s)) for b, s in zip(bad, scores, strict=True)]
    table = spark.createDataFrame(rows, "stratum string, bad boolean, " + ", ".join(f"{r} double" for r in quality.RULES)).repartition(5)
    got = {r.stratum: [(m["rule"], m["cutoff"]) for m in r.path] for r in quality._paths(table, 2.0).collect()}
    assert got == {s: greedy([r[1:] for r in rows if r[0] == s], 2.0) for s in ("many", "few")} and len(got["many"]) > 3


def test_the_promise_holds_for_all_rules_together(spark):
    """Many strata, each a draw of its own, with known rates: the joint false rejection of two rules stays within alpha."""
    strata, alpha = 12, 0.05

    def draw(seed):
        rows = spark.range(strata * 4500).select((F.col("id") % strata).cast("string").alias("stratum"), (F.rand(seed) < 0.3).alias("bad"), F.rand(seed + 1).alias("u"), F.rand(seed + 2).alias("v"), F.rand(seed + 3).alias("w"))
        score = lambda c, junk: F.when(F.col("bad") & junk, 0.95).otherwise(F.pow(c, F.lit(3)))
        zero = [F.lit(0.0).alias(r) for r in quality.RULES if r not in ("symbols", "capitals")]
        return rows.select("stratum", "bad", score("u", F.col("w") < 0.6).alias("symbols"), score("v", F.col("w") >= 0.6).alias("capitals"), *zero)

    found = quality.certified_cutoffs(draw(10), draw(20), alpha=alpha, delta=0.1, cost=2.0).collect()
    lost = {}
    for r in found:
        lost[r.stratum] = lost.get(r.stratum, 1.0) * r.cutoff ** (1 / 3)
    assert len(lost) > strata / 2 and all(1 - kept <= alpha for kept in lost.values())


def test_equal_texts_count_once(spark):
    docs = spark.createDataFrame([(i, "=en", "same" if i < 40 else f"text {i}") for i in range(50)] + [(50, "=de", "same"), (51, "=de", None)], "doc_id long, stratum string, text string")
    labels = spark.createDataFrame([(i, 0 if i == 7 else 1, 1 if i == 9 else 0) for i in range(52)], "label_id long, quality int, toxic int")
    got = {(r.stratum, r.label_id): (r.quality, r.toxic) for r in quality._distinct_texts(docs, labels).collect()}
    assert len(got) == 13 and got["=en", 0] == (0, 1) and got["=de", 50] == got["=de", 51] == (1, 0)


def test_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("n_words"), F.lit("y").alias("stratum"))
    docs = docs.union(spark.createDataFrame([(-1, None, None, 1, "y"), (-2, "", "en", 1, "y"), (None, "word " * 30, "xx", 1, "y")], docs.schema))
    labels = spark.read.parquet(f"{SF}/labels.parquet").union(spark.createDataFrame([(None, 1, 0), (5, None, None), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int"))
    judged = quality.judge(docs, labels).collect()
    assert len(judged) == docs.count()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in judged)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in judged)
    odd = docs.withColumns({"__quality": F.lit(1), "cutoffs": F.lit("mine"), "Stratum_": F.col("lang")})
    kept = quality.keep(odd, labels)
    assert kept.columns == odd.columns and kept.filter("cutoffs = 'mine' and stratum = 'y' and Stratum_ <=> lang").count() == sum(r.kept for r in judged)
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.keep(docs, labels.limit(0)).count() == sum(not r.base_failed for r in judged)


def test_verdicts_match_brute_force(spark):
    """Cutoffs and verdicts anew from the counts and labels: binomial sums in whole numbers, one loop after another."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs, (alpha, delta, cost) = docs.withColumn("all", F.when(F.col("doc_id") % 9 > 0, F.col("doc_id") % 2)), (0.05, 0.2, 2.0)
    rows = [r.asDict() for r in quality.judge(docs, labels, stratum="all", alpha=alpha, delta=delta, cost=cost).collect()]
    texts = {r.doc_id: (r.text_key, r.fit) for r in docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key")).withColumn("fit", quality._is_fit("text_key")).collect()}
    known = {r.doc_id: (r.quality == 0, r.toxic == 1) for r in labels.collect() if r.quality is not None and r.toxic is not None}
    share = lambda a, b: a / b if b else 0.0
    for r in rows:
        r["scores"] = {
            "symbols": share(r["n_symbols"], r["word_chars"]), "capitals": share(r["n_upper"], r["word_chars"]), "exclamations": share(r["n_bangs"], r["n_words"]), "repeated_lines": share(r["n_dup_lines"], r["n_lines"]),
            "repeated_words": share(r["n_repeat_words"], r["n_words"]), "stutter": share(r["n_stutter"], r["n_words"]), "toxic": 4 * r["n_toxic"] / (r["n_words"] + 50),
        }
        r["stratum"] = r["doc_id"] % 2 if r["doc_id"] % 9 else None
    once = {}  # equal texts of a stratum: one row, as bad as the worst
    for r in rows:
        if r["doc_id"] in known and not r["base_failed"]:
            low, toxic = known[r["doc_id"]]
            key = r["stratum"], texts[r["doc_id"]]
            once[key] = (r["scores"], low or toxic or (key in once and once[key][1]))
    held = {s for (s, (_, fit)) in once if not fit}
    cutoffs = {}
    for s in held:
        left, test = ([x for (t, (_, fit)), x in once.items() if t == s and fit == side] for side in (True, False))
        path = []
        while True:
            best = (0.0,)
            for rule in quality.RULES:
                for c in quality.GRID:
                    clean, caught = (sum(x[rule] > c for x, bad in left if bad == is_bad) for is_bad in (False, True))
                    if caught > cost * clean and caught / (clean + 0.5) > best[0]:
                        best = caught / (clean + 0.5), rule, c
            if not best[0]:
                break
            path.append(best[1:])
            left = [(x, bad) for x, bad in left if x[best[1]] <= best[2]]
        n, best = sum(not bad for _, bad in test), 0.0
        for k in range(1, len(path) + 1):
            false, caught = (sum(any(x[rule] > c for rule, c in path[:k]) for x, bad in test if bad == is_bad) for is_bad in (False, True))
            if sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(false + 1)) > delta / len(held):
                break
            if caught - cost * false > best:
                best = caught - cost * false
                cutoffs |= {(s, rule): c for rule, c in path[:k]}
    assert cutoffs
    for r in rows:
        want = not r["base_failed"] and all(r["scores"][rule] <= cutoffs.get((r["stratum"], rule), math.inf) for rule in quality.RULES)
        assert r["kept"] == want


def test_false_rejection_on_unseen_labels(spark):
    """Held-out accuracy: cutoffs certified on one half hold on a fresh half, and catch most junk that the base misses."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 3 <> 0")
    judged = quality.judge(docs.withColumn("all", F.lit("x")), seen, stratum="all").join(labels.filter("doc_id % 3 = 0"), "doc_id").filter("not base_failed")
    counts = {(r.clean, r.kept): r["count"] for r in judged.groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"), "kept").count().collect()}
    clean = counts.get((True, True), 0) + counts.get((True, False), 0)
    assert counts.get((True, False), 0) <= 0.02 * clean
    assert counts.get((False, False), 0) >= 0.3 * (counts.get((False, True), 0) + counts.get((False, False), 0))


def test_scores_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120)
    docs = docs.union(spark.createDataFrame([(100_001, None), (100_002, ""), (None, "unseen words here"), (100_003, "The THE the"), (100_006, "the new words")], docs.schema)).checkpoint()
    words, pairs, rows = collections.Counter(), collections.Counter(), docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    for r in rows:
        if not held(r.doc_id):
            own = tokens(r.text)
            words.update(own)
            pairs.update(zip(["begin", *own], own))
    total, distinct = sum(words.values()), len(words)
    least = [1, 2, 3, 4, 5, 6, 7, 8, *(math.ceil(8 * 1.25**k) for k in range(1, 60))]
    q = lambda n: max((x for x in least if x <= n), default=0)
    whole, starts = total + 0.5 * (distinct + 1), sum(not held(r.doc_id) for r in rows)
    count = lambda v: starts if v == "begin" else words[v]
    one = lambda w: (q(words[w]) + 0.5) / whole
    two = lambda v, w: 0.3 * q(pairs[v, w]) / count(v) + 0.7 * one(w) if count(v) else one(w)
    for v in ("begin", b"the", "never seen"):
        assert 0.9 < sum(two(v, w) for w in [*words, "never seen"]) <= 1 + 1e-12
    # With this many bits, no probe hits by chance.
    for options in ({"bits": 200}, {"bits": 200, "bucket_bytes": 20_000}):
        got = {r.doc_id: r for r in logfreq.score_documents(docs, **options).collect()}
        for r in rows:
            found, own = got[r.doc_id], tokens(r.text)
            base = sum(math.log10((words[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
            assert (found.held_out, found.n_tokens, found.n_known, found.train_tokens) == (held(r.doc_id), len(own), sum(words[t] > 0 for t in own), total)
            assert math.isclose(found.base_score, base, rel_tol=1e-9)
            assert math.isclose(found.score, sum(math.log10(two(v, w)) for v, w in zip(["begin", *own], own)), rel_tol=1e-9)
    usual = {r.doc_id: r.score for r in logfreq.score_documents(docs).collect()}
    assert all(usual[r.doc_id] >= got[r.doc_id].score - 1e-9 for r in rows)  # the filter only ever errs upwards
    assert sum(usual.values()) - sum(r.score for r in got.values()) < 0.01 * -sum(usual.values())
    assert logfreq.score_documents(docs.limit(0)).count() == 0


def test_a_model_scores_other_texts(spark):
    """Trained on one table, asked about another one."""
    texts = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(40))) for i in range(50)]
    model = logfreq.train(logfreq.slices_of(spark.createDataFrame(texts, "doc_id long, text string")), bucket_bytes=5000)
    others = spark.createDataFrame([(1, texts[3][1]), (2, " ".join(sorted(texts[3][1].split()))), (3, "none of these")], "doc_id long, text string")
    got = {r.doc_id: r for r in logfreq.score(logfreq.slices_of(others), model).collect()}
    assert got[1].score > got[2].score and got[3].n_known == 1 and model.count() > 1


def test_filter_never_misses_and_seldom_invents():
    keys = logfreq.mix(np.arange(1, 20_001, dtype=np.uint64))
    levels = (np.arange(20_000) % 7 + 1).astype(np.uint8)
    flags, n_bits = logfreq.filled(keys, levels, logfreq.BITS)
    found = logfreq.probed(keys, flags, n_bits)
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    assert (logfreq.probed(logfreq.mix(np.arange(50_000, 70_000, dtype=np.uint64)), flags, n_bits) > 0).mean() < 0.02


def test_model_beats_the_base_on_held_out_texts(spark):
    scored = logfreq.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out")
    r = scored.agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).first()
    assert r.model > r.base


def test_bigrams_seen_once_count(spark):
    by_part = sorted(range(100), key=lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    training, held = by_part[0], by_part[-2:]
    words = [f"word{k}" for k in range(40)]
    rows = [(training, " ".join(words)), (held[0], " ".join(words)), (held[1], " ".join(words[::2] + words[1::2]))]
    got = {r.doc_id: r.score for r in logfreq.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 5


def test_licenses(spark):
    rows = [
        (1, "a/b/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", "some words"), (3, "a/y.txt", "text\nLicensed under the Apache License, Version 2.0.\nmore"),
        (4, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (5, "d/z.txt", "the license of things"), (6, None, "x"), (7, "top.txt", None), (8, "a/b/q/r/w.txt", ""), (1, "a/b/LICENSE", "Released under the MIT License."),
    ]
    files = spark.createDataFrame([(*r, "own", 0.5) for r in rows], "doc_id long, path string, text string, license string, key double")
    found = licenses.scan(files.select("doc_id", "path", "text"), F.col("path").rlike("(LICENSE|COPYING)$")).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.license, r.origin, r.directory) for r in found if r.doc_id < 100}
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b/c"), 3: ("Apache-2.0", "own", None), 4: ("GPL-3.0", "own", None), 5: (None, None, None), 6: (None, None, None),
        7: (None, None, None), 8: ("MIT", "inherited", "a/b"),
    }
    assert licenses.scan(files.limit(0), F.lit(True)).count() == 0


def test_common_notices_and_small_tables_have_licenses(spark):
    notice = "Released under the MIT License."
    for n in (3, 60):
        rows = [(i, f"p/d{i}/f", f"alpha{i} the words of beta\n" + (notice if i % 3 == 0 else "gamma")) for i in range(n)]
        got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.lit(False)).collect()}
        assert got == {i: ("MIT", "own") if i % 3 == 0 else (None, None) for i in range(n)}


def test_whole_licence_texts_and_shares_of_them(spark, monkeypatch):
    """Notices over many lines with comment marks; found in 40 of 100 files and in 1 of 10; many directories, one of them hot."""
    full = next(t for name, t in licenses.TEMPLATES if name == "MIT" and len(t) > 300)
    bsd = next(t for name, t in licenses.TEMPLATES if name == "BSD-3-Clause" and len(t) > 300)
    wrapped = lambda text, mark: "\n".join(f"{mark} " + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    header = "#!/usr/bin/x\n\n" + wrapped("Copyright 2024 Somebody. " + bsd, "#") + "\n\nimport this\n" + "code words all over " * 30
    plain = "def f(x): return the value of x and of y under load\n" * 5
    for n, licensed in ((100, 40), (10, 1)):
        rows = [(i, f"hot/f{i}", f"MIT License\n\n{wrapped(full, ' *')}\n" if i < licensed else plain) for i in range(n)]
        got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.lit(False)).collect()}
        assert got == {i: "MIT" if i < licensed else None for i in range(n)}
    rows = [(0, "hot/LICENSE", full), (1, "hot/sub/a.py", header)] + [(i, f"hot/d{i % 3}/f{i}", plain + str(i)) for i in range(2, 60)] + [(i, f"cold/d{i}/f", plain) for i in range(60, 70)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    want = {i: ("MIT", "inherited") if 1 < i < 60 else (None, None) for i in range(2, 70)} | {0: ("MIT", "own"), 1: ("BSD-3-Clause", "own")}
    for bound in (licenses.BROADCAST_DIRECTORIES, 2):
        monkeypatch.setattr(licenses, "BROADCAST_DIRECTORIES", bound)
        assert {r.doc_id: (r.license, r.origin) for r in licenses.scan(files, F.col("path").endswith("LICENSE")).collect()} == want


def test_license_scores_match_brute_force(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    own = {0: notice + " alpha beta gamma", 1: "beta " + notice, 2: notice + " alpha\nReleased under the MIT License. delta", 3: notice + "".join(f" solitary{k}" for k in range(12)), 4: notice + " " + notice}
    rows = [(i, "x", own.get(i, "alpha beta gamma delta the under " + f"other{i % 50}")) for i in range(3000)] + [(0, "x", own[0])]
    words = lambda text: set(re.split("[^a-z0-9]+", text.lower())) - {""}
    n = collections.Counter(w for r in rows for w in words(r[2]))
    notices = lambda text: {*text.split("\n"), *re.split(r"\n[\s/#*;-]*\n", text), text}
    square = lambda ws: sum(math.log((1 + len(rows)) / (n[w] or 1)) ** 2 for w in ws)
    want = {}
    for i, text in own.items():
        found = [(-round(square(words(x) & words(t)) / math.sqrt(square(words(x)) * square(words(t))), 9), name) for x in notices(text) if words(x) for name, t in licenses.TEMPLATES]
        want[i] = min(f for f in found if -f[0] >= licenses.THRESHOLD) if min(found)[0] <= -licenses.THRESHOLD else None
    assert want[0] and want[1] and want[2] and not want[3]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.lit(False)).filter("license is not null").collect()
    assert len(got) == 1 + sum(w is not None for w in want.values())
    for r in got:
        assert r.license == want[r.doc_id][1] and math.isclose(r.score, -want[r.doc_id][0], abs_tol=1e-8)


def test_header_tags_and_notices(spark, monkeypatch):
    """Tags name their own license only; notices of one family are told apart; common words beyond the broadcast bound come by shuffle."""
    tagged = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-or-later": "GPL-3.0-or-later", "GPL-2.0+": "GPL-2.0", "EPL-2.0": "EPL-2.0", "Unlicense": "Unlicense", "Private-7.5": None}
    long = {name: text for name, text in licenses.TEMPLATES if len(text) > 250}
    said = [(f"// SPDX-License-Identifier: {tag}\nint main();", name) for tag, name in tagged.items()]
    said += [(f"Copyright 2024 Somebody\n\n{long[name]}\n\nand the rest of a file", name) for name in ("AGPL-3.0", "GPL-3.0", "LGPL-2.1", "Unlicense", "Zlib")]
    said += [(next(t for n, t in licenses.TEMPLATES if n == name), name) for name in ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Artistic-2.0", "BSL-1.0", "EPL-2.0")]
    rows = [(i, "x", text) for i, (text, _) in enumerate(said)] + [(i, "x", f"the words of this file are for you {i}") for i in range(100, 160)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    for bound in (licenses.BROADCAST_WORDS, 0):
        monkeypatch.setattr(licenses, "BROADCAST_WORDS", bound)
        got = {r.doc_id: r.license for r in licenses.scan(files, F.lit(False)).collect()}
        assert got == {i: name for i, (_, name) in enumerate(said)} | dict.fromkeys(range(100, 160))
