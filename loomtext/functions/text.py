"""Scalar text functions as Column expressions: normalisation, tokens, cleaned values, quality signals, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\x0B\x85\p{Z}]+"
WORD = r"[A-Za-z0-9][A-Za-z0-9_.@:/#-]*"
TOKEN_EDGE = ".,;:!?()[]{}\"'`"
# Words that never count as content.
STOP_WORDS = "a an and are as by can could did does for from had has have how in is it of on or should that the to was were what when where which who with would".split()
BLOB = r"(?:^|[^A-Za-z0-9_])(?:[0-9a-fA-F]{24,}|[A-Za-z0-9+/]{32,}=*)(?:[^A-Za-z0-9_]|$)"
SAYS_NOTHING = "no actionable fact is asserted"  # Fixed value
SEP = "\u001f"


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once: as the variable of a lambda it is not copied to each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column) -> Column:
    """Small letters, runs of blanks as one, no outer blanks; null gives ''."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACES, " "))


def tokens(text: Column) -> Column:
    """ASCII words with inner marks, outer marks stripped, in small letters."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.lower(F.btrim(t, F.lit(TOKEN_EDGE)))), lambda t: t != "")


def content(found: Column) -> Column:
    """The tokens longer than two characters that are no stop words."""
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def compact(text: Column) -> Column:
    return F.btrim(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")), F.lit(" .;:"))


def clean_value(text: Column) -> Column:
    """A value without the marks around it."""
    v = F.btrim(compact(text), F.lit(" \t\r\n\"'`{}[](),"))
    return compact(F.btrim(F.regexp_replace(v, r"\s*[}\]),]+$", ""), F.lit(" \"'`")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and 24 hex digits of the SHA-256 of the parts; a null part counts as 'None'."""
    joined = F.concat_ws(SEP, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 24))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(tokens(text)))


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


QUALITY_COUNTS = ("char_count", "printable", "alnum", "symbols", "token_count", "unique_tokens", "long_tokens", "non_ascii", "mixed_tokens")


def quality_counts(text: Column, found: Column) -> dict[str, Column]:
    """What the quality classes are decided by, as counts; ``found`` holds the tokens of ``text``."""
    t = F.coalesce(text, F.lit(""))
    return {
        "char_count": F.length(t),
        "printable": F.length(t) - _without(t, r"[\p{C}\p{Z}&&[^ \t\n\x0B\f\r]]+"),
        "alnum": _without(t, r"[\p{L}\p{N}]+"),
        "symbols": F.length(t) - _without(t, r"[\p{L}\p{N}\s\x0B\x1c-\x1f\x85\p{Z}]+"),
        "token_count": F.size(found),
        "unique_tokens": F.size(F.array_distinct(found)),
        "long_tokens": F.size(F.filter(found, lambda k: F.length(k) >= 24)),
        "non_ascii": _without(t, r"[^\x00-\x7f]+"),
        "mixed_tokens": F.size(F.filter(found, lambda k: k.rlike("[0-9]") & k.rlike("[a-z]"))),
        "has_blob": t.rlike(BLOB),
        "says_nothing": normalize(t).contains(SAYS_NOTHING),
    }


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def quality_class() -> Column:
    """First class that applies, over the columns of ``quality_counts``; the thresholds are fixed values."""
    symbol, printable, long_, mixed, wide, unique = _share("symbols", "char_count"), _share("printable", "char_count"), _share("long_tokens", "token_count"), _share("mixed_tokens", "token_count"), _share("non_ascii", "char_count"), _share("unique_tokens", "token_count")
    return (F.when(F.col("char_count") == 0, "empty").when((symbol > 0.35) | (printable < 0.75), "random_character_noise").when((long_ > 0.25) | F.col("has_blob"), "base64_or_hex_blob")
            .when(mixed > 0.20, "ocr_corruption").when((wide > 0.05) & (unique > 0.80), "multilingual_word_salad").when((F.col("token_count") >= 12) & (unique > 0.90), "word_salad").when(F.col("says_nothing"), "plausible_babble").otherwise("meaningful_discourse"))


def low_semantic_noise() -> Column:
    """Whether a text says too little to be ranked like others, over the columns of ``quality_counts``."""
    symbol, printable, alnum, long_, unique = _share("symbols", "char_count"), _share("printable", "char_count"), _share("alnum", "char_count"), _share("long_tokens", "token_count"), _share("unique_tokens", "token_count")
    n = F.col("token_count")
    return (F.col("char_count") == 0) | (printable < 0.75) | (alnum < 0.25) | (symbol > 0.35) | ((F.col("char_count") > 80) & (n < 4)) | ((n >= 20) & (unique > 0.95) & (long_ > 0.20))
