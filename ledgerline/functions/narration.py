"""Identifiers of a statement narration, as native column expressions.

Each extractor takes its match out of a working text that the next one sees, so an email's domain is no handle and an
account's digits are no name. Structured ``UPI/DR/<reference>/<name>/<bank>/<handle>`` narrations are read by position instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.functions.steps import computed

FIELDS = ("payment_method", "name", "normalized_name", "name_tokens", "upi_id", "normalized_upi_id", "account_identifier", "reference", "phone", "email")


def _reference(raw: Column, after_handle: Column) -> Column:
    labelled = F.trim(T.first_match(raw, T.REFERENCE))
    parts = F.reverse(F.transform(F.split(after_handle, "[-/]"), lambda s: F.trim(s)))
    numeric = F.get(F.filter(parts, lambda s: s.rlike(r"^\d{5,20}$")), F.lit(0))

    def long_code(t: Column) -> Column:
        return (F.length(t) >= 10) & t.rlike("[0-9]") & t.rlike("[A-Za-z]") & ~t.rlike(r"[Xx*]{2,}\d{3,4}")

    code = F.get(F.filter(F.split(raw, "[^A-Za-z0-9]+"), long_code), F.lit(0))
    return F.coalesce(labelled, numeric, code)


def extract(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``FIELDS`` for the narration in column ``raw`` (null or blank: all null)."""
    text = F.trim(F.coalesce(F.col(raw), F.lit("")))
    df = computed(rows, {"_raw": F.when(text != "", text)})
    # By position.
    joined = F.regexp_replace(F.regexp_replace(F.col("_raw"), r"\s*/\s*", "/"), r"\s+", " ")
    df = computed(df, {f"_s{k}": T.first_match(joined, T.STRUCTURED_UPI, i) for i, k in enumerate(("ref", "name", "bank", "handle"), 1)})
    structured = F.col("_shandle").isNotNull()
    handle = F.col("_shandle")
    full_handle = F.when(handle.contains("@"), handle).otherwise(F.concat(handle, F.lit("@"), F.lower("_sbank")))
    low = F.lower(handle)
    by_handle = F.when(low.contains("gpay"), "GOOGLE_PAY").when(low.contains("paytm"), "PAYTM").when(low.contains("phonepe"), "PHONEPE")
    found = T.payment_method(F.col("_raw"))
    df = computed(df, {"payment_method": F.when(structured, F.coalesce(by_handle, found, F.lit("UPI"))).otherwise(found)})
    # By progressive removal.
    df = computed(df, {"_email": T.first_match(F.col("_raw"), T.EMAIL)})
    df = computed(df, {"_w": F.when(F.col("_email").isNotNull(), F.replace("_raw", F.col("_email"), F.lit(" "))).otherwise(F.col("_raw"))})
    df = computed(df, {"_url": T.first_match(F.col("_w"), T.UPI_URL, 0)})
    df = computed(df, {"_match": F.coalesce("_url", T.first_match(F.col("_w"), T.UPI, 0))})
    df = computed(df, {"_upi": F.when(F.col("_url").isNotNull(), T.first_match(F.col("_w"), T.UPI_URL)).otherwise(F.col("_match"))})
    df = computed(df, {"_clean": T.clean_handle(F.col("_upi"))})
    cut = F.length("_upi") - F.length("_clean")
    dropped = F.when(cut > 0, F.regexp_replace(F.left(F.col("_upi"), cut), "-+", " ")).otherwise(F.lit(" "))
    df = computed(df, {"_after": F.when(F.col("_match").isNotNull(), F.substr("_w", F.instr("_w", F.col("_match")) + F.length("_match"))).otherwise("")})
    df = computed(df, {"_w": F.when(F.col("_match").isNotNull(), F.replace("_w", F.col("_match"), dropped)).otherwise(F.col("_w"))})
    for pattern in (T.ACCOUNT, T.MASKED_ACCOUNT):
        known = F.col("_account").isNotNull() if "_account" in df.columns else F.lit(False)
        whole = F.when(~known, T.first_match(F.col("_w"), pattern, 0))
        df = computed(df, {"_whole": whole, "_account": F.when(known, F.col("_account") if "_account" in df.columns else F.lit(None)).otherwise(T.first_match(F.col("_w"), pattern))})
        df = computed(df, {"_w": F.when(F.col("_whole").isNotNull(), F.replace("_w", F.col("_whole"), F.lit(" "))).otherwise(F.col("_w"))})
    local = F.col("_raw").contains("+91")
    pick = lambda group: F.coalesce(T.first_match(F.col("_raw"), T.LABELLED_PHONE, group), F.when(local, T.first_match(F.col("_raw"), T.PHONE, group)))
    df = computed(df, {"_phone": pick(1), "_whole": pick(0)})
    df = computed(df, {"_w": F.when(F.col("_whole").isNotNull(), F.replace("_w", F.col("_whole"), F.lit(" "))).otherwise(F.col("_w"))})
    upi = T.normalize_upi(F.col("_clean"))
    tokens = T.name_tokens(F.regexp_replace("_w", T.DATE_IN_TEXT, " "))
    handle_words = F.transform(F.filter(F.split(F.substring_index(upi, "@", 1), "[-._]"), lambda w: w.rlike(r"^\p{L}{2,}$")), T.title)
    df = computed(df, {"_tokens": F.when(structured, T.name_tokens(F.trim("_sname"))).when(F.size(tokens) > 0, tokens).otherwise(F.coalesce(handle_words, F.array().cast("array<string>")))})
    name = F.when(F.size("_tokens") > 0, T.title(F.array_join(F.slice("_tokens", 1, F.when(structured, 4).otherwise(6)), " ")))
    plain = lambda c: F.when(~structured, c)
    df = computed(
        df,
        {
            "name": name,
            "name_tokens": F.when(F.col("_raw").isNotNull(), F.col("_tokens")),
            "upi_id": F.when(structured, full_handle).otherwise(F.col("_clean")),
            "normalized_upi_id": F.when(structured, T.normalize_upi(full_handle)).otherwise(upi),
            "account_identifier": plain(T.mask_account(F.col("_account"))),
            "reference": F.when(structured, F.col("_sref")).otherwise(_reference(F.col("_raw"), F.col("_after"))),
            "phone": plain(F.col("_phone")),
            "email": plain(F.lower("_email")),
        },
    )
    df = computed(df, {"normalized_name": T.normalize_name(F.col("name"))})
    return df.select(*rows.columns, *FIELDS)


def has_strong_identifier() -> Column:
    return F.col("normalized_upi_id").isNotNull() | F.col("account_identifier").isNotNull()
