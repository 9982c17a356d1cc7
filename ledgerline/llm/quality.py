"""Operator 4, quality rules: cutoffs whose false rejection is controlled per stratum.

Each rule rejects a document whose score lies above the rule's cutoff in the document's stratum; what is promised is the
false rejection of all rules together. Labelled texts are split in two by their hash, equal texts of a stratum counting once, so
that no text stands on both sides and rows are independent. On the one half the vocabulary is fitted (one rule scores words and word
prefixes over-represented in documents labelled toxic) and, per stratum, a path is laid: a
sequence of tighter and tighter cutoffs, each move tightening the rule that catches the most bad documents for the clean ones it costs. All texts of the half
count: a round finds the next move of every stratum from the histograms of its rules over the texts not yet rejected. On the other half the joint false rejections (clean documents above any cutoff so far) are counted along the
path. A place of it is certified if an exact binomial tail says that a joint false rejection rate above ``alpha`` would give so few with
probability at most ``delta / strata``. The path is tested from its mild end on and testing stops at the first failure (a fixed
sequence, laid without a look at the half that tests it); the division is Bonferroni's correction over strata. So with probability
1 - delta every stratum loses at most ``alpha`` of its clean documents to all rules at once. Of the certified places, the one that
rejects the most bad documents (less ``cost`` times the clean ones) is used; a stratum without one rejects nothing beyond the base rule.

Nulls: a null text has no words (it fails the base rule); a null stratum is a stratum of its own; a null label
counts as unlabelled. A label given twice, or to two copies of a text, counts as the worse one. Repeated document rows are each judged alike. An
empty table gives no rows. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import cut, text_bytes, text_slices, tidy_shuffles, unused
from ledgerline.llm.text_features import features, lexical_units, lexicon_hits, stutters

#: Ids of labelled texts, a few bytes each: broadcast up to so many, joined by shuffle beyond.
BROADCAST_LABELS = 200_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_lines", "n_stutter", "n_toxic")
Q = "__quality"
#: Strata (a short name and at most a number per rule each) that are broadcast; more of them are joined by shuffle.
BROADCAST_STRATA = 10_000
#: From mild to strict.
GRID = [round(0.9**k, 6) for k in range(1, 66)]


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def scores(q: Column) -> dict[str, Column]:
    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return {
        "symbols": share(q["n_symbols"], q["word_chars"]),
        "capitals": share(q["n_upper"], q["word_chars"]),
        "exclamations": share(q["n_bangs"], q["n_words"]),
        "repeated_lines": share(q["n_dup_lines"], q["n_lines"]),
        "repeated_words": share(q["n_repeat_words"], q["n_words"]),
        "stutter": share(q["n_stutter"], q["n_words"]),
        "toxic": share(q["n_toxic"] * 4, q["n_words"] + 50),
    }


RULES = ("symbols", "capitals", "exclamations", "repeated_lines", "repeated_words", "stutter", "toxic")


def with_features(docs: DataFrame, lexicon: np.ndarray, text_column: str = "text", into: str = Q) -> DataFrame:
    """All columns and a struct of counts, ``into``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_column):
            data, offsets = text_bytes(batch.column(text_column))
            counts, hashes, rows = features(data, offsets)
            counts["n_stutter"] = stutters(hashes, rows, batch.num_rows)
            counts["n_toxic"] = lexicon_hits(data, offsets, lexicon)
            struct = pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*names, into])

    return docs.mapInArrow(work, schema)


# --- the vocabulary rule ------------------------------------------------------------------------------------------


def _labels(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    known = labels.select(F.col(id_column).alias("label_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).na.drop()
    return known.groupBy("label_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def _is_fit(column: str) -> Column:
    """Whether a text, named by its digest, is one to fit on rather than to test on."""
    return F.pmod(F.xxhash64(F.col(column), F.lit("fit")), F.lit(2)) == 0


def _digest(column: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def _distinct_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum, text_key, label_id, quality, toxic``: a row per labelled text of a stratum (``docs``: ``doc_id, stratum, text``)."""
    keyed = docs.select(F.col("doc_id").alias("label_id"), "stratum", _digest("text").alias("text_key"))
    return keyed.join(labels, "label_id").groupBy("stratum", "text_key").agg(F.min("label_id").alias("label_id"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def toxic_lexicon(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """Sorted hashes of the units that documents labelled toxic have and others do not."""
    chosen = labels.filter("toxic = 1 or quality = 1").select("label_id", "toxic")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_LABELS else chosen
    texts = docs.select(F.col(id_column).alias("label_id"), F.col(text_column).alias("text")).join(chosen, "label_id").select("text", "toxic")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
            pairs = np.concatenate([np.stack([rows[at].astype(np.uint64), units], 1) for rows, at, units in lexical_units(data, offsets)])
            pairs = np.unique(pairs, axis=0)  # each unit once a document
            units, inverse = np.unique(pairs[:, 1], return_inverse=True)
            bad = toxic[pairs[:, 0].astype(np.int64)]
            counts = [np.bincount(inverse[x], minlength=len(units)) for x in (bad, ~bad)]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (units, *counts)], ["unit", "bad", "good"])

    counted = texts.mapInArrow(work, "unit long, bad long, good long").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = counted.filter("bad >= 5 and bad > 4 * good").select("unit").toArrow()
    return np.sort(found.column("unit").to_numpy().view(np.uint64))


# --- certified cutoffs --------------------------------------------------------------------------------------------


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly: the regularised incomplete beta function by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return out * math.exp(front) / a


def _paths(fit: DataFrame, cost: float) -> DataFrame:
    """``stratum, path``: an array of rules and cutoffs, from mild to strict, in the order in which the cutoffs tighten."""
    above = lambda score: F.aggregate(F.array(*map(F.lit, GRID)), F.lit(0), lambda n, c: n + (score > c).cast("int"))
    # A text with n grid cutoffs below its score is rejected from the (len - n)th of them on, counted from mild.
    steps = F.array(*[F.lit(len(GRID)) - above(F.col(r)) for r in RULES])
    rows = cut(fit.select("stratum", "bad", steps.alias("steps")).groupBy("stratum", "bad", "steps").agg(F.count("*").alias("n")))
    none = F.array(*[F.lit(0)] * len(RULES))
    now = cut(rows.select("stratum").distinct().select("stratum", none.alias("levels"), F.array().cast("array<struct<rule: string, cutoff: double>>").alias("path"), F.lit(True).alias("moved")))
    few = now.count() <= BROADCAST_STRATA
    so_far = Window.partitionBy("stratum", "rule").orderBy("step")  # at most a row per grid cutoff
    while not now.filter("moved").isEmpty():
        # Of the texts that no cutoff so far rejects, those that each cutoff of each rule would.
        open_ = now.filter("moved").select("stratum", "levels")
        left = rows.join(F.broadcast(open_) if few else open_, "stratum").filter(F.forall(F.zip_with("steps", "levels", lambda s, n: s >= n), lambda x: x))
        met = left.select("stratum", "bad", "n", F.posexplode("steps").alias("rule", "step")).filter(F.col("step") < len(GRID))
        counts = met.groupBy("stratum", "rule", "step").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("caught"), F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("clean"))
        counts = counts.withColumns({c: F.sum(c).over(so_far).cast("double") for c in ("caught", "clean")}).filter(F.col("caught") > cost * F.col("clean"))
        worth = F.col("caught") / (F.col("clean") + 0.5)
        # The first rule and the mildest cutoff of equals.
        best = counts.groupBy("stratum").agg(F.max_by(F.struct("rule", "step"), F.struct(worth, -F.col("rule"), -F.col("step"))).alias("m"))
        tightened = F.transform("levels", lambda n, r: F.when(r == F.col("m.rule"), F.col("m.step") + 1).otherwise(n))
        move = F.struct(F.element_at(F.array(*map(F.lit, RULES)), F.col("m.rule") + 1).alias("rule"), F.element_at(F.array(*map(F.lit, GRID)), F.col("m.step") + 1).alias("cutoff"))
        met, moved = now.join(best, "stratum", "left"), F.col("m").isNotNull()
        now = cut(met.select("stratum", F.when(moved, tightened).otherwise(F.col("levels")).alias("levels"), F.when(moved, F.concat("path", F.array(move))).otherwise(F.col("path")).alias("path"), moved.alias("moved")))
    return now.filter(F.size("path") > 0).select("stratum", "path")


def certified_cutoffs(fit: DataFrame, held_out: DataFrame, *, alpha: float, delta: float, cost: float) -> DataFrame:
    """``stratum, rule, cutoff`` from labelled rows ``stratum, bad, <a score per rule>``: the path is laid on the one table and tested on the other."""
    paths = cut(_paths(fit, cost))
    m = held_out.select("stratum").distinct().count()
    scores_of = F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(r))])
    met = _with_cutoffs(held_out.select("stratum", "bad", scores_of.alias("scores")), paths, "stratum").filter("path is not null")
    # The first place of the path that rejects the row; 0 if none does.
    place = F.array_position(F.transform("path", lambda s: F.try_element_at("scores", s["rule"]) > s["cutoff"]), F.lit(True)).cast("int")
    counts = met.groupBy("stratum", place.alias("place")).agg(F.count_if(~F.col("bad")).alias("clean"), F.count_if("bad").alias("caught"))
    counts = counts.groupBy("stratum").agg(F.sum("clean").alias("n"), F.collect_list(F.struct("place", "clean", "caught")).alias("places"))  # at most a row per place of the path

    @F.pandas_udf("int")
    def choose(n: pd.Series, places: pd.Series) -> pd.Series:
        chosen = []
        for total, found in zip(n, places, strict=True):
            best, upto, clean, caught = 0.0, 0, 0, 0
            for s in sorted((x for x in found if x["place"] > 0), key=lambda x: x["place"]):
                clean, caught = clean + s["clean"], caught + s["caught"]
                if binomial_tail(int(clean), int(total), alpha) > delta / m:
                    break
                if (gain := caught - cost * clean) > best:
                    best, upto = gain, s["place"]
            chosen.append(upto)
        return pd.Series(chosen, dtype="int32")

    used = counts.select("stratum", choose("n", "places").alias("upto")).join(paths, "stratum").filter("upto > 0")
    steps = used.select("stratum", F.explode(F.slice("path", F.lit(1), F.col("upto"))).alias("s"))
    return steps.groupBy("stratum", F.col("s.rule").alias("rule")).agg(F.min("s.cutoff").alias("cutoff"))


def _stratum(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def learn(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, cost: float = 2.0, id_column: str = "doc_id", text_column: str = "text"):
    """The vocabulary, the features of each document and the certified cutoffs (``stratum`` and a map from rule to cutoff)."""
    plain = docs.select(F.col(id_column).alias("doc_id"), _stratum(stratum).alias("stratum"), F.col(text_column).alias("text"))
    known = cut(_distinct_texts(plain, _labels(labels)))
    lexicon = toxic_lexicon(docs, known.filter(_is_fit("text_key")), id_column, text_column)
    found = cut(with_features(plain.withColumn("text_key", _digest("text")), lexicon).drop("text"))
    met = found.join(known.withColumnRenamed("label_id", "doc_id"), ["stratum", "text_key", "doc_id"]).dropDuplicates(["stratum", "text_key"])
    q = F.col(Q)
    scored = met.filter(~base_failed(q)).select("stratum", "text_key", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"), *[c.alias(r) for r, c in scores(q).items()])
    scored = cut(scored)
    cutoffs = certified_cutoffs(scored.filter(_is_fit("text_key")), scored.filter(~_is_fit("text_key")), alpha=alpha, delta=delta, cost=cost)
    cutoffs = cut(cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")))
    return lexicon, found, cutoffs


def _with_cutoffs(rows: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Rows with the cutoffs of their stratum. Texts are not dealt out by stratum as long as the strata are few."""
    few = cutoffs.count() <= BROADCAST_STRATA
    return rows.join(F.broadcast(cutoffs) if few else cutoffs, stratum, "left")


def passes(q: Column, cutoffs: Column) -> Column:
    """Neither the base nor a certified rule rejects."""
    kept = ~base_failed(q)
    for rule, score in scores(q).items():
        kept = kept & F.coalesce(score <= F.try_element_at(cutoffs, F.lit(rule)), F.lit(True))
    return kept


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for each document."""
    with tidy_shuffles(docs.sparkSession):
        _, found, cutoffs = learn(docs, labels, **options)
    q = F.col(Q)
    joined = _with_cutoffs(found, cutoffs, "stratum")
    return joined.select("doc_id", *[q[c].alias(c) for c in COUNTS], base_failed(q).alias("base_failed"), passes(q, F.col("cutoffs")).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", text_column: str = "text", **options) -> DataFrame:
    """The documents that pass, with all their columns."""
    with tidy_shuffles(docs.sparkSession):
        lexicon, _, cutoffs = learn(docs, labels, stratum=stratum, text_column=text_column, **options)
    names = docs.columns
    q, own, learned = (unused(c, names) for c in (Q, "stratum", "cutoffs"))
    rows = with_features(docs, lexicon, text_column, q).withColumn(own, _stratum(stratum))
    joined = _with_cutoffs(rows, cutoffs.withColumnsRenamed({"stratum": own, "cutoffs": learned}), own)
    return joined.filter(passes(F.col(q), F.col(learned))).select(*names)
