"""Terms of questions and their variants: on the question's side in Python, on the data's side as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import STOP_WORDS, TOKEN_EDGE, WORD, clean_value, normalize

# Words that ask, nouns that name no relation, and openings that anchor nothing.
QUESTION_WORDS = "what which who where when why how many did does do is are was were can could should has have find provide show return give the a an for of to in on at about according".split()
GENERIC_NOUNS = "answer content document entity fact field folder item name note object record records row rows entry entries source text thing value count number".split()
ANCHOR_SKIP = "Who What Which Where When How Can Could Did Does Do Is Are Was Were Find Return Show Give ID IDs URL URLs JSON".split()
SUFFIXES = ("ing", "ied", "ed", "ies", "s")
SCOPES = {"latest": "current currently latest most_recent recent final last".split() + ["most recent"], "earliest": "earliest oldest first initial".split()}
CONFIDENCES = {"very high": 0.95, "high": 0.85, "medium": 0.65, "moderate": 0.65, "low": 0.35, "very low": 0.15}
ANSWER_TYPES = "person actor organization identifier url file_path count state date_time boolean content_phrase metadata_value unknown".split()
TYPE_ALIASES = dict.fromkeys("contact contact_info definition email entity location name object phone phone_number phrase place string text word".split(), "content_phrase") | dict.fromkeys("amount integer number quantity".split(), "count") | {"date": "date_time", "datetime": "date_time", "link": "url", "uri": "url", "yes_no": "boolean"}


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def words(text: str | None) -> list[str]:
    return [w for w in (t.strip(TOKEN_EDGE).lower() for t in re.findall(WORD, text or "")) if w]


def content_words(text: str | None) -> list[str]:
    return [w for w in words(text) if len(w) > 2 and w not in STOP_WORDS]


def variants(term: str) -> set[str]:
    """A term without its endings, beside the term itself; terms of other than small letters have no variants."""
    t = plain(term)
    if not re.fullmatch("[a-z]+", t):
        return {t} - {""}
    cut = lambda end: t[: len(t) - len(end)] + ("y" if end == "ies" else "")
    fits = lambda end: t.endswith(end) and len(t) > len(end) + 2 and not (end == "s" and t[-2:] in ("ss", "us", "is"))
    return {v for v in {t, *map(cut, filter(fits, SUFFIXES))} if len(v) > 1}


def compound_variants(term: str) -> set[str]:
    """The variants of the parts of a compound of letters joined by ``_`` or ``-``."""
    parts = re.split("[_-]", plain(term))
    return {v for p in parts for v in variants(p)} if len(parts) > 1 and all(p.isalpha() for p in parts) else set()


def temporal_scope(said: str) -> str:
    s = plain(said)
    return next((scope for scope, names in SCOPES.items() if s in names), s)


def answer_type(said: str) -> str:
    t = (said or "").strip().lower()
    t = TYPE_ALIASES.get(t, t)
    return t if t in ANSWER_TYPES else "unknown"


def stems(token: Column) -> Column:
    """``variants`` of a column of normalised tokens, sorted."""
    def cut(end: str) -> Column:
        keep = F.length(token) > len(end) + 2
        ok = token.endswith(end) & keep & (~token.rlike("(?:ss|us|is)$") if end == "s" else F.lit(True))
        return F.when(ok, F.concat(token.substr(F.lit(1), F.length(token) - len(end)), F.lit("y" if end == "ies" else "")))

    every = F.array_compact(F.array(token, *map(cut, SUFFIXES)))
    return F.when(token.rlike("^[a-z]+$"), F.array_sort(F.filter(F.array_distinct(every), lambda v: F.length(v) > 1))).otherwise(F.array(token))


def predicate_norm(value: Column) -> Column:
    """The shortest variant of a predicate's first token, the lesser of equals."""
    first = F.get(F.split(normalize(value), " "), F.lit(0))
    return F.coalesce(F.get(F.array_sort(F.transform(stems(first), lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))), F.lit(0))["v"], first)


def scope_of(said: Column) -> Column:
    s = normalize(said)
    return F.when(s.isin(*SCOPES["latest"]), "latest").when(s.isin(*SCOPES["earliest"]), "earliest").otherwise(s)


def confidence_of(said: Column, default: float = 0.65) -> Column:
    """A number between 0 and 1 from a number or a word for it; what is neither counts as ``default``."""
    s = normalize(said)
    out = F.lit(None).cast("double")
    for word, value in CONFIDENCES.items():
        out = F.when(s == word, F.lit(value)).otherwise(out)
    number = s.try_cast("double")  # greatest and least pass over nulls, so these are asked for first
    return F.coalesce(out, F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))), F.lit(default))


def answer_parts(value: Column) -> Column:
    """The cleaned parts of a value between semicolons."""
    return F.filter(F.transform(F.split(clean_value(value), ";"), lambda p: clean_value(p)), lambda p: p != "")


def token_set(value: Column) -> Column:
    """The distinct letters-and-digits parts of a normalised value, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalize(value), "[^a-z0-9]+"), lambda p: p != "")))


def literal_list(value: Column) -> Column:
    """A list written out as quoted strings as prose: 'a', 'a and b', 'a, b, and c'; null for anything else."""
    v = F.btrim(value)
    item = r"(?:'[^'\\]*'|\"[^\"\\]*\")"
    listed = v.rlike(rf"^\[\s*{item}(?:\s*,\s*{item})*\s*,?\s*\]$")
    found = F.transform(F.regexp_extract_all(v, F.lit(f"({item})"), F.lit(1)), lambda x: F.btrim(x.substr(F.lit(2), F.length(x) - 2)))
    items = F.filter(found, lambda x: x != "")
    n = F.size(items)
    text = F.when(n == 1, items[0]).when(n == 2, F.array_join(items, " and ")).when(n > 2, F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))
    return F.when(listed, text)


def char_tokens(text: Column) -> Column:
    """About the tokens of a text: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def iso_utc(seconds: Column) -> Column:
    """Seconds since 1970 as a timestamp text in UTC; null stays null."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def matches(material: Column, term: Column) -> Column:
    """Whether a term stands in normalised material as written, or all its content tokens stand in it as tokens."""
    inside = F.filter(token_set(term), lambda t: F.length(t) > 2)
    return material.contains(term) | ((F.size(inside) > 0) & (F.size(F.array_except(inside, token_set(material))) == 0))
