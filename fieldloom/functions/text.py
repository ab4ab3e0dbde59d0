"""Cleaning and checks of text columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fieldloom import catalog
from fieldloom.functions.rows import first_of

# what Python's strip() takes away
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC. Spark has no function for it; ASCII text is its own normal form and skips Python's work."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, text).otherwise(_nfkc(F.when(~ascii_only, text)))


def clean_text(text: Column, max_length: int = 10_000, normalize: bool = True) -> Column:
    """Cut, normalise, drop control characters, escape HTML, strip."""
    out = F.substring(text, 1, max_length)
    if normalize:
        out = nfkc(out)
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for mark, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return F.regexp_replace(out, rf"^{SPACE}+|{SPACE}+$", "")


def clean_identifier(text: Column, max_length: int = 255) -> Column:
    """Keep ``A-Za-z0-9._-``; NULL where nothing is left."""
    kept = F.substring(F.regexp_replace(text, r"[^a-zA-Z0-9._\-]", ""), 1, max_length)
    return F.nullif(F.ltrim(kept, F.lit("._-")), F.lit(""))


def clean_topic(text: Column, max_length: int = 1000) -> Column:
    kept = F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9/+#._\-]", ""), "/+", "/")
    return F.substring(F.trim(kept, F.lit("/")), 1, max_length)


def is_valid_topic(text: Column) -> Column:
    plain = text.rlike(r"^[a-zA-Z0-9/+#._\-]+\z")
    return F.coalesce(plain & ~text.contains(".."), F.lit(False))


def threat_of(text: Column) -> Column:
    """First threat pattern in the lowercased text, as ``<family> pattern detected: <pattern>``.

    The flags make letters, digits and spaces those of Unicode, and a dot stop at a line feed only.
    """
    low = F.lower(text)
    return first_of(
        [(low.rlike(f"(?dU){p}"), F.lit(f"{family} pattern detected: {p}")) for family, p in catalog.THREAT_PATTERNS],
        F.lit(None).cast("string"),
    )
