"""Scalar text functions: names, handles, accounts, references, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of identifiers in narrations.
EMAIL = r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
UPI = r"([A-Za-z0-9._-]{2,}@[A-Za-z]{2,})"
UPI_URL = r"(?i)upi://pay\?[^#\s]*?\bpa=([^&\s]+)"
ACCOUNT = r"(?i)(?:A/?C|A\.?C\.?|ACC(?:OUNT)?|ACCT)(?:\s*(?:NO|NUM|NUMBER|#))?\s*[:.\-#]?\s*([Xx*]{2,}\s*\d{3,4}|\d{6,18})"
MASKED_ACCOUNT = r"\b([Xx*]{4,}\s*\d{4})\b"
REFERENCE = (
    r"(?i)\b(?:UTR|REF(?:ERENCE)?(?:\s*(?:NO|NUM|NUMBER|#))?|RRN|TXN(?:\s*(?:ID|NO))?|CHEQUE(?:\s*(?:NO|NUM))?|CHQ(?:\s*(?:NO|NUM))?"
    r"|NEFT\s*NO|IMPS\s*NO|RTGS\s*NO)\s*[:.#-]?\s*([A-Za-z0-9]{6,30})"
)
STRUCTURED_UPI = r"(?i)\bUPI/(?:DR|CR)/(\d{8,18})/([^/]+)/([A-Za-z0-9]+)/([^/\s]+)"
PHONE = r"(?:\+91[\s-]*)?\b([6-9]\d{9})\b"
LABELLED_PHONE = r"(?i)\b(?:MOB(?:ILE)?|PHONE|PH|TEL|CONTACT)\s*(?:NO\.?|NUMBER)?\s*[:.\-#]?\s*(?:\+91[\s-]*)?([6-9]\d{9})"
DATE_IN_TEXT = r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b|\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b"

#: Payment methods by narration, in the order of precedence.
METHODS = [
    ("GOOGLE_PAY", r"\bGOOGLE\s*PAY\b|\bGPAY\b|\bG\s*PAY\b|\bTEZ\b"),
    ("PHONEPE", r"\bPHONE\s*PE\b|\bPHONEPE\b"),
    ("PAYTM", r"\bPAY\s*TM\b|\bPAYTM\b"),
    ("IMPS", r"\bIMPS\b"),
    ("NEFT", r"\bNEFT\b"),
    ("RTGS", r"\bRTGS\b"),
    ("ATM", r"\bATM\b"),
    ("UPI", r"\bUPI\b"),
    ("BANK_TRANSFER", r"\b(?:BANK\s*TRANSFER|FUND\s*TRANSFER|INB\b|NEFT/IMPS|IMPS/NEFT)"),
    ("CARD", r"\b(?:VISA|MASTERCARD|RUPAY|E\s*COMMERCE|POS\b)"),
    ("CASH", r"\bCASH\b"),
]
#: Words of a narration that never name the counterparty.
STOPWORDS = (
    "upi gpay googlepay google pay phonepe paytm tm imps neft rtgs atm pos dr cr inr rs rs. to from for the a an of and or "
    "transfer transferred trf ft payment paid pmt cheque chq check ref reference utr rrn no nos num number via wdr wdl dep deposit "
    "withdrawal withdrawals credited debited credit debit balance a/c ac acc acct account ifsc upiref refno transaction txn ben "
    "beneficiary mob mobile ph phone tel self bill recharge purchase merchant service charges fee tax gst towards fwd revert reversed "
    "refund ltd pvt limited india ms m/s mr mrs dr. id kind att obl ser kindly instapay bhim collect push pull mandate emandate salary "
    "wlan inb mb neft- impa"
).split()
#: Routing words before the name in a handle.
ROUTING = "upi paytm phonepe gpay googlepay bhim neft imps rtgs to from tm".split()


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def payment_method(raw: Column) -> Column:
    chain = None
    for name, pattern in METHODS:
        hit = raw.rlike("(?i)" + pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.when(raw.rlike(UPI_URL) | raw.rlike(UPI), "UPI").when(raw.rlike(r"(?i)\bTRANSFER\b"), "BANK_TRANSFER")


def normalize_upi(raw: Column) -> Column:
    value = F.ltrim(F.btrim(F.lower(F.trim(raw)), F.lit(".;,")), F.lit("."))
    handle = F.btrim(F.substring_index(value, "@", 1), F.lit(".-_"))
    domain = F.btrim(F.regexp_replace(value, r"^[^@]*@", ""), F.lit(".-_"))
    good = value.contains("@") & (handle != "") & (domain != "")
    return F.when(good, F.concat(handle, F.lit("@"), domain))


def clean_handle(raw: Column) -> Column:
    """The handle without routing words and repeats before its name: ``UPI-KALYAN-KALYAN@X`` gives ``KALYAN@X``."""
    local, domain = F.substring_index(raw, "@", 1), F.regexp_replace(raw, r"^[^@]*@", "")
    local = F.regexp_replace(F.regexp_replace(F.ltrim(local, F.lit(". ")), "-+", "-"), "^-|-$", "")
    local = F.regexp_replace(local, rf"(?i)^(?:(?:{'|'.join(ROUTING)})-)+(?=.)", "")
    local = F.regexp_replace(local, r"(?i)^(?:([^-]+)-(?=\1(?:-|$)))+", "")
    return F.when(local == "", raw).otherwise(F.concat(local, F.lit("@"), domain))


def normalize_name(raw: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(raw), r"(?U)[^\w\s@./-]", " ")
    return F.nullif(F.trim(F.regexp_replace(cleaned, r"(?U)\s+", " ")), F.lit(""))


def title(text: Column) -> Column:
    """Each run of letters capitalised, also after digits and punctuation."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def name_tokens(text: Column) -> Column:
    """Words that may name a counterparty."""
    spread = F.regexp_replace(F.regexp_replace(text, r"[/|:;,_\-–—]+", " "), r"(?U)[^\w\s@./-]", " ")
    words = F.transform(F.split(spread, r"(?U)\s+"), lambda w: F.btrim(w, F.lit(".-_")))
    stop = F.array(*map(F.lit, STOPWORDS))

    def names(w: Column) -> Column:
        low = F.lower(w)
        lone = (F.length(w) == 1) & (low.isin("a", "c", "m", "s") | ~w.rlike(r"^\p{L}$"))
        return (w != "") & ~F.array_contains(stop, low) & ~w.rlike(r"^\p{Nd}+$") & ~lone

    return F.filter(words, names)


def mask_account(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(digits) >= 5, F.concat(F.lit("XXXX"), F.right(digits, F.lit(4)))).otherwise(F.trim(value))


def redact_upi(value: Column) -> Column:
    handle, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return F.when(value.contains("@"), F.concat(F.left(handle, F.lit(2)), F.lit("***@"), domain)).otherwise(value)


def search_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


#: What announces a secret.
SECRET_MARKS = (r"password\s*[=:]\s*", r"pwd\s*[=:]\s*", r"api[_-]?key\s*[=:]\s*", r"authorization:\s*bearer\s+")


def redact_secrets(text: Column) -> Column:
    for mark in SECRET_MARKS:
        text = F.regexp_replace(text, rf"(?i)({mark})\S+", "$1[REDACTED]")
    return text
