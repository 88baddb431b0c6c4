"""Text and date clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the words read as "no value" and the accepted date layouts
NULL_WORDS = ("null", "nil", "none", "n/a")
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy")


def collapse(c: Column) -> Column:
    """Trim and reduce every run of white space to one blank."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_token(c: Column) -> Column:
    """Collapsed text without NUL characters; NULL becomes empty."""
    return F.coalesce(collapse(F.regexp_replace(c, "\x00", "")), F.lit(""))


def clean_text(c: Column, drop_empty: bool = True) -> Column:
    """Collapsed text; words that mean "no value" become NULL, and so does empty text if asked."""
    text = collapse(c)
    out = F.when(F.lower(text).isin(*NULL_WORDS), F.lit(None)).otherwise(text)
    return F.nullif(out, F.lit("")) if drop_empty else out


def email(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.rlike(r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"), low)


def phone_us(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    digits = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits))


def date_iso(c: Column) -> Column:
    """First layout that parses, as ``yyyy-MM-dd``."""
    text = F.trim(c)
    tries = [F.try_to_date(text, layout) for layout in DATE_LAYOUTS]
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def money(c: Column) -> Column:
    """Two-decimal amount; currency marks and thousands separators go, the minus sign stays."""
    text = F.trim(c)
    kept = F.regexp_replace(text, r"[^0-9.]", "")
    # only the first point counts
    whole = F.regexp_replace(kept, r"^([0-9]*\.)(.*)$", "$1")
    frac = F.regexp_replace(F.regexp_replace(kept, r"^[0-9]*\.?", ""), r"\.", "")
    number = F.concat(whole, frac).try_cast("decimal(38,10)").try_cast("decimal(18,2)")
    negative = text.rlike(r"^\(?\s*[^0-9.]*-") | text.rlike(r"-\s*$") | text.rlike(r"^\(.*\)$")
    return F.when(negative, -number).otherwise(number).cast("string")


def label_of(path: Column) -> Column:
    """Readable label of the last step of a path; all-capital words stay."""
    last = F.regexp_replace(F.substring_index(path, ".", -1), r"\[0\]", "")
    words = F.split(F.trim(F.regexp_replace(last, r"[_\-\s]+", " ")), " ")
    return F.array_join(
        F.transform(words, lambda w: F.when(w == F.upper(w), w).otherwise(F.initcap(F.lower(w)))), " "
    )


def safe_token(c: Column) -> Column:
    """Lower-case letters, digits and underscores; blanks and dashes become underscores."""
    low = F.regexp_replace(F.lower(c), r"[\- ]", "_")
    return F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9_]", ""), r"^_+|_+$", "")


# fixed values: markers in front of a secret in an error text
SECRET_MARKS = r"(?i)(bearer\s+|token=|api_key=|apikey=|password=|secret=)\S+"


def redact_secrets(c: Column) -> Column:
    """Mask the value after a secret marker."""
    return F.regexp_replace(c, SECRET_MARKS, "$1[REDACTED]")


def to_number(c: Column) -> Column:
    """Number in a text with thousands commas; NULL if it is none, or not finite."""
    n = F.trim(F.regexp_replace(c.cast("string"), ",", "")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), n)
