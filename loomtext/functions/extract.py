"""Surface extraction as Column expressions: addresses, identifiers, phrases, labels, pairs, cells, timestamps.

Word boundaries are ASCII ones, written out, so that every engine finds the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import bound, clean_value, normalize

_W = "[A-Za-z0-9_]"
EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
# The patterns of what counts as an address, identifier, phrase, timestamp, label or pair.
URL = r"(https?://[^\s)\],\"']+)"
PREFIX_ID = EDGE + r"([A-Z][A-Z0-9]{1,9}(?:-[A-Z0-9]{2,12})*-[0-9]+[A-Z0-9-]*)" + EDGE
LOWER_ID = EDGE + r"([a-z][a-z0-9]{1,12}_[a-z0-9]{6,})" + EDGE
HEX_ID = EDGE + r"([0-9a-fA-F]{8,16})" + EDGE
EMAIL = EDGE + r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})" + EDGE
FILE_LIKE = EDGE + r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]{1,8})" + EDGE
PHRASE = EDGE + r"((?:(?:Dr|Ms|Mr|Mrs|Prof)\.[ \t\n]+)?[A-Z][A-Za-z0-9_-]+(?:[ \t\n]+[A-Z][A-Za-z0-9_-]+){0,3})" + EDGE
TIMESTAMP = EDGE + r"([0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2})?)" + EDGE
LEADING_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{2}:[0-9]{2})?[ \t]+"
LABEL = r'^[ \t]*"?([A-Za-z][A-Za-z0-9 _/-]{1,80})"?[ \t]*[:=][ \t]*"?([^"{}\[\]\n;,|]+)'
OBJECT = r"(\{[^{}\n]*(?:\{[^{}\n]*\}[^{}\n]*)*\})"
PAIR = r'"?([A-Za-z][A-Za-z0-9 _/-]{0,80})"?[ \t]*:[ \t]*(?:"([^"\n{}\[\]]*)"|([^,"{}\[\]\n]+))'
QUOTED_PAIR = r'(?i)"([^"\n]{1,80})"[ \t\n]*:[ \t\n]*(?:"([^"\n]*)"|(-?[0-9]+(?:\.[0-9]+)?|true|false|null))'


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def only(text: Column, needed: Column) -> Column:
    """``text`` where it has what a pattern cannot do without, else ''; so most texts are never searched."""
    return F.when(needed, text).otherwise("")


def urls(text: Column) -> Column:
    return F.transform(all_of(only(text, text.contains("://")), URL), lambda u: F.rtrim(u, F.lit(".")))


def identifiers(text: Column) -> Column:
    """Identifiers family by family: PREFIX-1, lower_under, hexadecimal, e-mail, file-like."""
    needs = (text.contains("-"), text.contains("_"), text.rlike("[0-9a-fA-F]{8}"), text.contains("@"), text.rlike("[.][A-Za-z0-9]"))
    return F.concat(*[all_of(only(text, n), p) for n, p in zip(needs, (PREFIX_ID, LOWER_ID, HEX_ID, EMAIL, FILE_LIKE))])


def phrases(text: Column) -> Column:
    """Capitalised phrases in order of appearance, each once."""
    return F.array_distinct(all_of(text, PHRASE))


def timestamps(text: Column) -> Column:
    return all_of(only(text, text.contains("-")), TIMESTAMP)


def label_pairs(text: Column) -> Column:
    """(label, value) of the pieces between bars, semicolons, commas and line ends, read once more without a leading time
    where none is found; pieces with braces, brackets or an address have none."""
    pieces = F.filter(F.split(only(text, text.rlike("[:=]")), r"[|;,\n]"), lambda p: ~p.rlike(r"[{}\[\]]|://"))
    pieces = F.transform(pieces, lambda p: F.when(p.rlike(LABEL), p).otherwise(F.regexp_replace(F.ltrim(p), LEADING_TIME, "")))
    found = F.transform(pieces, lambda p: F.struct(clean_value(F.regexp_extract(p, LABEL, 1)).alias("label"), clean_value(F.regexp_extract(p, LABEL, 2)).alias("value")))
    return F.filter(found, lambda x: (x.label != "") & (x.value != ""))


def object_spans(text: Column) -> Column:
    return F.filter(all_of(only(text, text.contains("{")), OBJECT), lambda o: o.contains(":"))


def object_pairs(span: Column) -> Column:
    """(key, value) of the scalar pairs of an object-like span."""
    keys = F.regexp_extract_all(span, F.lit(PAIR), F.lit(1))
    quoted = F.regexp_extract_all(span, F.lit(PAIR), F.lit(2))
    bare = F.regexp_extract_all(span, F.lit(PAIR), F.lit(3))
    zipped = F.transform(F.arrays_zip(keys.alias("k"), quoted.alias("q"), bare.alias("b")), lambda x: F.struct(clean_value(x["k"]).alias("key"), clean_value(F.when(x["b"] != "", x["b"]).otherwise(x["q"])).alias("value")))
    return F.filter(zipped, lambda x: (x.key != "") & (x.value != ""))


def outside_pairs(text: Column) -> Column:
    """(key, value) of the pairs with a quoted key that stand outside object-like spans."""
    rest = F.regexp_replace(only(text, text.contains('"') & text.contains(":")), OBJECT, "\n")
    keys, quoted, bare = (F.regexp_extract_all(rest, F.lit(QUOTED_PAIR), F.lit(k)) for k in (1, 2, 3))
    zipped = F.transform(F.arrays_zip(keys.alias("k"), quoted.alias("q"), bare.alias("b")), lambda x: F.struct(clean_value(x["k"]).alias("key"), clean_value(F.when(x["b"] != "", x["b"]).otherwise(x["q"])).alias("value")))
    return F.filter(zipped, lambda x: (x.key != "") & (x.value != ""))


def entity_type(surface: Column) -> Column:
    """What a mention is by its shape; the first that applies."""
    return (F.when(surface.rlike(r"^https?://[^\s]+$"), "url").when(surface.rlike(r"^[A-Z][A-Z0-9]{1,9}-[0-9]+[A-Z0-9-]*$") | surface.rlike(r"^[a-z][a-z0-9]{1,12}_[a-z0-9]{6,}$"), "identifier")
            .when(surface.rlike(r"^[0-9a-fA-F]{8,16}$"), "commit").when(surface.contains("@") & surface.contains("."), "email").when(surface.rlike(r"[^\s][ \t\n]+[^\s]"), "name").otherwise("entity"))


def cells(line: Column) -> Column:
    """Cleaned non-empty cells between bars or tabs."""
    return F.filter(F.transform(F.split(line, r"[|\t]"), lambda c: clean_value(c)), lambda c: c != "")


def header_like(row: Column) -> Column:
    """Whether a row of cells may name columns: two or more, all with a letter, none with an address or identifier."""
    return (F.size(row) >= 2) & F.forall(row, lambda c: c.rlike("[A-Za-z]") & ~c.rlike(URL) & (F.size(identifiers(c)) == 0))


def carry_header(rows: Column) -> Column:
    """For rows (struct of ``line`` and ``cells``) in order: each with the header in force.

    A row as wide as the header is data even if it could name columns; one of another width that could replaces it."""
    empty = F.expr("named_struct('header', CAST(array() AS array<string>), 'out', CAST(array() AS array<struct<line: int, header: array<string>, cells: array<string>>>))")

    def step(acc, row):
        new = header_like(row["cells"]) & (F.size(acc["header"]) != F.size(row["cells"]))
        head = F.when(new, row["cells"]).otherwise(acc["header"])
        keep = ~new & (F.size(acc["header"]) == F.size(row["cells"]))
        item = F.array(F.struct(row["line"].alias("line"), head.alias("header"), row["cells"].alias("cells")))
        return F.struct(head.alias("header"), F.when(keep, F.concat(acc["out"], item)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, empty, step, lambda acc: acc["out"])


def _type_of(v: Column, low: Column) -> Column:
    url = F.regexp_extract(v, URL, 1)
    rest = F.btrim(F.replace(low, F.lower(url), F.lit(" ")))
    lone_url = (url != "") & (F.size(all_of(v, URL)) == 1) & rest.rlike(r"^(?:(?:at|in|on|from|to)(?: +|$))*$")
    return (F.when((v == "") | (low == "unknown"), "unknown").when(low.rlike(r"^(yes|no)($|[;,:.!?] )"), "boolean").when(v.rlike(r"^https?://[^\s)\],\"']+$") | lone_url, "url")
            .when(v.rlike(r"^[0-9]+$"), "count").when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$|^[0-9]{1,2}:[0-9]{2}$|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$") | low.rlike(r"^[0-9]+(\.[0-9]+)? ?(second|minute|hour|day|week|month|year)s?$"), "date_time")
            .when(v.rlike(r"^[A-Z][A-Z0-9]{1,9}(-[A-Z0-9]{2,12})*-[0-9]+[A-Z0-9-]*$"), "identifier").when(v.rlike(r"^[A-Za-z0-9_./-]+\.[A-Za-z][A-Za-z0-9]{0,7}$"), "file_path").otherwise("content_phrase"))


def value_type(value: Column) -> Column:
    """The surface type of a value: unknown, boolean, url, file_path, count, date_time, identifier or content_phrase."""
    return bound(clean_value(value), lambda v: bound(normalize(v), lambda low: _type_of(v, low)))
