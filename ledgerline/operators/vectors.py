"""Search documents, hashed embeddings and cosine search, all in native higher-order functions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384


def document_content(rows: DataFrame) -> DataFrame:
    """``id, content``: date, counterparty, direction, amount, method and description of each transaction."""
    amount = F.when(F.col("debit_amount").isNotNull(), F.concat(F.lit("Rs "), F.col("debit_amount").cast("string")))
    amount = amount.when(F.col("credit_amount").isNotNull(), F.concat(F.lit("Rs "), F.col("credit_amount").cast("string"))).otherwise("amount unknown")
    direction = F.when(F.col("transaction_type").isin("DEBIT", "CREDIT"), F.col("transaction_type")).otherwise("UNKNOWN")
    parts = [
        F.coalesce(F.col("transaction_date").cast("string"), F.lit("unknown date")),
        F.coalesce("counterparty_name", F.lit("Unknown counterparty")),
        direction,
        amount,
        F.coalesce("payment_method", F.lit("OTHER")),
        F.coalesce("description", F.lit("")),
    ]
    return rows.select("id", F.concat_ws(" | ", *parts).alias("content"))


def features(text: Column) -> Column:
    """Words, neighbouring pairs of words, and the letter triples of each word between ``^`` and ``$``."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit("_"), b))
    pairs = F.filter(pairs, lambda p: p.isNotNull())

    def triples(word: Column) -> Column:
        padded = F.concat(F.lit("^"), word, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3))

    return F.concat(words, pairs, F.flatten(F.transform(words, triples)))


def sparse_embedding(docs: DataFrame, id_column: str, text_column: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``id, bucket, value``: MD5-hashed signed feature counts, L2-normalised over each document."""
    each = docs.select(F.col(id_column).alias("id"), F.explode(features(F.col(text_column))).alias("f"))
    digest = F.md5(F.col("f").cast("binary"))
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    odd = F.conv(F.substring(digest, 10, 1), 16, 10).cast("int") % 2
    sums = each.groupBy("id", bucket.alias("bucket")).agg(F.sum(F.when(odd == 0, 1.0).otherwise(-1.0)).alias("v")).filter("v <> 0")
    norms = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norms, "id").select("id", "bucket", (F.col("v") / F.col("norm")).alias("value"))


def sparse_search(embedded: DataFrame, query: DataFrame, top_k: int = 10, floor: float = 0.0) -> DataFrame:
    """Best documents for a one-document query (both ``id, bucket, value``): a join on buckets, summed, above the floor."""
    asked = query.select("bucket", F.col("value").alias("asked"))
    scores = embedded.join(F.broadcast(asked), "bucket").groupBy("id").agg(F.sum(F.col("value") * F.col("asked")).alias("score"))  # at most DIMENSIONS rows
    return scores.filter(F.col("score") > floor).orderBy(F.desc(F.round("score", 9)), "id").limit(top_k)


def cosine(a: Column, b: Column) -> Column:
    """0.0 for missing or empty vectors, different lengths or zero norms."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot / length).otherwise(0.0)


def top_k(docs: DataFrame, query: list[float], *, id_column: str, vector_column: str, k: int = 10, floor: float = 0.0, predicate: Column | None = None) -> DataFrame:
    """Filtered exact search: the predicate is applied below the scores, the best k are kept per task before they meet."""
    rows = docs.filter(F.col(vector_column).isNotNull())
    rows = rows if predicate is None else rows.filter(predicate)
    score = cosine(F.col(vector_column), F.array(*map(F.lit, query)))
    return rows.withColumn("score", score).filter(F.col("score") > floor).orderBy(F.desc(F.round("score", 9)), id_column).limit(k)


def in_period(date_column: str, date_from: datetime.date | None, date_to: datetime.date | None) -> Column:
    out = F.lit(True)
    if date_from:
        out = out & (F.col(date_column) >= F.lit(date_from))
    if date_to:
        out = out & (F.col(date_column) <= F.lit(date_to))
    return out


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The fresh documents, and those existing ones that none of them replaces."""
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
