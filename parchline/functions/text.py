"""Text repair, digits, slugs and search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC_LETTER = r"[\u0600-\u06FF]"
BEYOND_LATIN = r"[^\u0000-\u00FF]"

# The upper half of Latin-1 beside the same bytes read as Windows-1256.
_HIGH_BYTES = bytes(range(0x80, 0x100))
LATIN_HIGH = _HIGH_BYTES.decode("latin-1")
ARABIC_HIGH = _HIGH_BYTES.decode("cp1256")
# Signs of such text: letters and control characters of that half, but not its punctuation.
HIGH_LATIN = "[" + "".join(c for c in LATIN_HIGH if not 0xA0 <= ord(c) < 0xC0) + "]"

# Arabic letters replaced by their Persian forms, and digit rows.
PERSIAN_FROM, PERSIAN_TO = "يك", "یک"
LATIN_DIGITS = "0123456789"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"


def persian_letters(text: Column) -> Column:
    return F.translate(text, PERSIAN_FROM, PERSIAN_TO)


def repair_text(text: Column) -> Column:
    """Undo Windows-1256 text that was decoded as Latin-1, and use Persian letters."""
    swapped = F.translate(text, LATIN_HIGH, ARABIC_HIGH)
    plain = text.rlike(ARABIC_LETTER) | ~text.rlike(HIGH_LATIN)
    return (
        F.when(plain, persian_letters(text))
        .when(text.rlike(BEYOND_LATIN), text)
        .when(swapped.rlike(ARABIC_LETTER), persian_letters(swapped))
        .otherwise(persian_letters(text))
    )


def latin_digits(text: Column) -> Column:
    return F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS + "٫٬", LATIN_DIGITS * 2 + ".,")


def persian_digits(text: Column) -> Column:
    return F.translate(text, LATIN_DIGITS, PERSIAN_DIGITS)


def localized_number(text: Column) -> Column:
    return F.translate(text, LATIN_DIGITS + ".,", PERSIAN_DIGITS + "/٬")


def slug(text: Column) -> Column:
    """Lower-case key made of letters, digits and single underscores."""
    cleaned = F.lower(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(cleaned == "", F.lit("dataset")).otherwise(cleaned)


def slug_text(text: str) -> str:
    return re.sub(r"[^a-zA-Z0-9]+", "_", text).strip("_").lower() or "dataset"


def contains_query(query: str, *fields: Column) -> Column:
    """Whether any field contains the query, ignoring case; a blank query matches all."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for field in fields:
        hit = hit | F.lower(F.coalesce(field, F.lit(""))).contains(wanted)
    return hit
