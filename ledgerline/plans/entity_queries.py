"""Registered queries of entity resolution over narrations that Spark derives from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import replay
from ledgerline.plans.queries import query

#: So many payees share the orders; each has its own words, handle, domain, account and phone.
PAYEES = 499


def ordered_narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A narration for each order, of six kinds: name with handle, name with account, name, first name, name with phone, phone."""
    g = F.lpad((F.col("o_orderkey") * 13 % PAYEES).cast("string"), 4, "0")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("statement_id"), F.col("o_orderkey").cast("int").alias("row_no"), F.col("o_orderdate").cast("date").alias("transaction_date"),
        (F.col("o_orderkey") % 6).alias("kind"), g.alias("g"),
    )
    kind = lambda *k: F.col("kind").isin(*k)
    first = F.concat(F.lit("Alpha"), "g")
    name = F.when(kind(0, 1, 2, 4), F.concat(first, F.lit(" Beta"), "g")).when(kind(3), first)
    return rows.withColumn("name", name).select(
        "id", "statement_id", "row_no", "transaction_date", "name", F.lower("name").alias("normalized_name"), F.coalesce(F.split("name", " "), F.array().cast("array<string>")).alias("name_tokens"),
        F.when(kind(0), F.concat(F.lit("alpha"), "g", F.lit("@bank"), "g")).alias("normalized_upi_id"), F.when(kind(1), F.concat(F.lit("XXXX"), "g")).alias("account_identifier"),
        F.when(kind(4, 5), F.concat(F.lit("900000"), "g")).alias("phone"), F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("reference"),
        F.when(kind(0), "UPI").when(kind(1, 3), "NEFT").alias("payment_method"),
    )


@query("match_in_order", f"""WITH n AS (SELECT o_orderkey AS id, o_orderkey % 6 AS kind, o_orderkey * 13 % {PAYEES} AS g, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos FROM orders),
born AS (SELECT g, min(pos) AS m FROM n WHERE kind IN (0, 1) GROUP BY g),
people AS (SELECT g, m, row_number() OVER (ORDER BY m) AS person FROM born),
timed AS (SELECT n.*, m, person, pos > m AS later,
  coalesce(max(CASE WHEN kind = 0 THEN pos END) OVER w >= m, false) AS handle, coalesce(max(CASE WHEN kind = 1 THEN pos END) OVER w >= m, false) AS account,
  coalesce(max(CASE WHEN kind = 4 THEN pos END) OVER w > m, false) AS phone
  FROM n LEFT JOIN people USING (g) WINDOW w AS (PARTITION BY g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scored AS (SELECT id, kind, person, coalesce(pos = m, false) AS minted, CASE WHEN pos = m THEN 0.9 WHEN kind = 5 AND phone THEN 0.85 WHEN kind = 5 OR m IS NULL OR NOT later THEN NULL
  WHEN kind = 0 THEN CASE WHEN handle THEN 0.97 ELSE 0.75 END WHEN kind = 1 THEN CASE WHEN account THEN 0.92 ELSE 0.75 END WHEN kind = 4 THEN CASE WHEN phone THEN 0.87 ELSE 0.75 END
  WHEN kind = 3 THEN CASE WHEN account THEN 0.5 ELSE 0.3 END ELSE 0.75 END AS score FROM timed)
SELECT id, CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score < 0.55 THEN 'AMBIGUOUS' ELSE 'MATCH' END AS status, CASE WHEN score >= 0.55 THEN person END AS person_id, CAST(score AS DOUBLE) AS confidence, minted FROM scored""", views=False)
def match_in_order(spark, sf_dir):
    """Every order's narration matched as if one after another, from no people at all."""
    people = spark.createDataFrame([], "id long, code string, canonical_name string, normalized_name string")
    identifiers = spark.createDataFrame([], "person_id long, id_type string, normalized_value string")
    decisions, _, _ = replay.replay(ordered_narrations(spark, sf_dir), people, identifiers)
    return decisions.select("id", "status", "person_id", "confidence", "minted")
