"""Per-document text statistics and the kind that follows from them (problem 6).

The statistics of a whole Arrow batch are counted by numpy at once (as regular expressions of the JVM they took some
twenty times the CPU time).  The kind comes from an ordered rule list that incremental
reduced-error pruning induces on a bounded sample of labelled documents; the learned thresholds become one CASE
expression that Spark evaluates natively.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import codepoints as cp
from loomtext.runtime import table

# Frequent function words of the languages of the corpus.
COMMON_WORDS = (
    "the of and to in is was that for it on as by with not but at are be or from who has had when "
    "der die das und ist war nicht ein zu mit auf für von dem den im hat "
    "le la les et est une que qui pas pour dans sur a été par du des au "
    "el los las y es un en no por con se del al lo "
    "o os as e um uma que não para com em do da foi está mas "
    "il di che è non per con del della ha una si "
    "de het een en van is niet dat op voor met aan te zijn "
    "i w na nie że jest się do z po za o jak "
    "и в на не что с по за как это но из был "
    "في من إلى على أن هذا لا كان قبل "
    "है में की के को से का और नहीं ने "
).split()


DAMAGE = "�âÃ‚√ÔΓ├"  # first characters of a bullet, dash or times sign that was decoded wrongly


@lru_cache(maxsize=1)
def _common_hashes() -> np.ndarray:
    return np.sort(np.array([cp.word_hash(w) for w in set(COMMON_WORDS)], np.uint64))


COUNTS = (
    "char_count", "line_count", "word_count", "letter_count", "blank_count", "digit_count", "symbol_count", "sentence_ends", "punctuated_lines",
    "common_words", "common_particles", "blob_chars", "broken_words", "scripts", "list_chars", "table_chars", "nav_chars", "hex_chars", "chat_chars", "entry_chars", "listing_chars", "wide_count",
)


def line_shapes(points: np.ndarray, f: np.ndarray) -> dict[str, np.ndarray]:
    """Start and end of every line and whether it is full, ended by a mark, or shaped like a table's, a list's, an
    entry's, a navigation's, a dump's or a chat's line."""
    has = lambda flag: (f & flag) != 0
    is_ = lambda ch: points == ord(ch)
    letter, blank, digit, newline = has(cp.LETTER), has(cp.BLANK), has(cp.DIGIT), has(cp.NEWLINE)
    end, close = has(cp.END), has(cp.CLOSE)
    ls = np.concatenate(([0], np.flatnonzero(newline) + 1))[:-1]
    le = np.flatnonzero(newline)
    bounds = np.append(ls, len(points))
    line = lambda v: cp.sums(v, bounds)
    ink = line(~blank)
    # first and last place with ink of each line
    idx = np.arange(len(points))
    first = np.minimum.reduceat(np.where(blank, len(points) - 1, idx), ls)
    last = np.maximum.reduceat(np.where(blank, 0, idx), ls)
    c0, c1, c2, c3 = (points[np.minimum(first + k, len(points) - 1)] for k in range(4))
    full = ink > 0
    ended = full & (end[last] | (close[last] & (cp.shifted(end, -1, False) | (cp.shifted(close, -1, False) & cp.shifted(end, -2, False)) | cp.shifted(blank, -1, False))[last]))
    space = is_(" ")
    next_ink = ~cp.shifted(blank, 1, True)
    in_number = cp.shifted(digit, -1, False) & cp.shifted(digit, 1, False)
    tight = lambda ch: line(is_(ch) & next_ink & ~in_number)
    gap = space & cp.shifted(space, 1, False) & cp.shifted(space, 2, False) & ~cp.shifted(space, -1, False) & ~cp.shifted(newline, -1, True)
    tabs, semis, commas, bars, equals = (line(is_(c)) for c in "\t;,|=")
    table = (
        ((c0 == ord("|")) & (bars >= 2)) | (tabs >= 2) | ((semis >= 2) & (tight(";") * 2 > semis) & (equals < 2)) | ((tight(",") >= 2) & (tight(",") * 4 >= 3 * line(is_(",") & ~in_number)))
        | (line(gap) >= 2) | ((c0 == ord("{")) & (line(is_(":")) >= 1)) | ((equals >= 2) & (semis >= 1))
    )
    hexes = np.isin(points, [ord(c) for c in "0123456789abcdefABCDEF"])
    n_hex = line(hexes)
    hexed = full & (n_hex >= 0.9 * ink) & (ink >= 14) & (line(space) >= 5)
    time = (c0 == ord("[")) & (c1 >= 48) & (c1 < 58) & (line(is_(":")) >= 1)
    nav = full & ~table & ~time & ~ended & (line(is_("|") | is_("»") | is_("›")) >= 1) & (line(digit) == 0) & (line(is_("«")) == 0) & (line(letter | blank) + line(is_("|") | is_("»") | is_("›")) >= le - ls)
    bullet = np.isin(c0, [ord(c) for c in "-*•‣◦"]) & ((c1 == 32) | (c1 == 9))
    box = (c0 == ord("[")) & ((c1 == 32) | (c1 == ord("x")) | (c1 == ord("X"))) & (c2 == ord("]"))
    is_d = lambda c: (c >= 48) & (c < 58)
    dot = lambda c: (c == ord(".")) | (c == ord(")"))
    numbered = is_d(c0) & ((dot(c1) & (c2 == 32)) | (is_d(c1) & dot(c2) & (c3 == 32)) | (is_d(c1) & is_d(c2) & dot(c3)))
    # parts of entries, wherever they stand: "12 × thing", "thing – state", "ABC-123 thing, place"; a damaged sign counts as one
    damaged = np.isin(points, [ord(c) for c in DAMAGE])
    spaced = cp.shifted(space, -1, False) & (cp.shifted(space, 1, False) | cp.shifted(space, 2, False) | cp.shifted(space, 3, False))
    times = (is_("×") | damaged) & spaced & cp.shifted(digit, -2, False)
    dash = (is_("–") | is_("—") | damaged) & spaced & ~cp.shifted(digit, -2, False)
    upper3 = has(cp.UPPER) & cp.shifted(has(cp.UPPER), 1, False) & cp.shifted(has(cp.UPPER), 2, False) & cp.shifted(is_("-"), 3, False) & cp.shifted(digit, 4, False) & ~cp.shifted(letter, -1, False)
    coded = (points[first] < 128) & upper3[first] & (commas >= 1)
    parts = line(times) + line(dash) + line(upper3)
    size_ok = (le - ls) <= 70 * np.maximum(parts, 1)
    entry = full & ~ended & ~time & ~table & (parts >= 1) & size_ok & (coded | (line(times | dash) >= 1)) & (line(is_(":")) == 0)
    marked = full & ~time & ~table & (bullet | box | numbered | (damaged[first] & (parts + line(damaged) >= 2) & ~ended))
    return {"start": ls, "end": le, "full": full, "ended": ended, "table": table, "marked": marked, "entry": entry, "nav": nav, "hex": hexed, "chat": time}


def count_batch(texts: list[str]) -> dict[str, np.ndarray]:
    """Every count of ``COUNTS`` for each text; texts must not be empty."""
    points, starts = cp.flatten(texts)
    f = cp.flags_of(points)
    has = lambda flag: (f & flag) != 0
    is_ = lambda ch: points == ord(ch)
    letter, blank, digit, newline = has(cp.LETTER), has(cp.BLANK), has(cp.DIGIT), has(cp.NEWLINE)
    n = {"char_count": np.diff(starts) - 1}
    per_text = lambda v: cp.sums(v, starts)
    n["letter_count"], n["digit_count"], n["symbol_count"], n["common_particles"] = per_text(letter), per_text(digit), per_text(has(cp.SYMBOL)), per_text(has(cp.PARTICLE))
    n["blank_count"], n["wide_count"] = per_text(blank) - 1, per_text(points >= 0x80)

    # words
    ws, we = cp.word_spans(letter | digit)
    text_of_word = np.searchsorted(starts, ws, "right") - 1
    per_word = lambda v: np.bincount(text_of_word, weights=v, minlength=len(texts)).astype(np.int64)
    size = we - ws
    n["word_count"] = per_word(np.ones(len(ws)))
    short = size <= 6
    common = np.zeros(len(ws), bool)
    common[short] = np.isin(cp.span_hashes(cp.lowered(points), ws[short], we[short]), _common_hashes())
    n["common_words"] = per_word(common)
    ink_s, ink_e = cp.word_spans(~blank)  # words with all that is attached to them
    text_of_ink = np.searchsorted(starts, ink_s, "right") - 1
    ink_size = ink_e - ink_s
    inside = lambda v: cp.sums(v, np.append(ink_s, len(points))) if len(ink_s) else np.zeros(0, np.int64)
    small = letter & ~has(cp.UPPER)
    odd = (digit | is_("|") | is_("^") | is_("~") | is_("'") | is_(".")) & cp.shifted(small, 1, False) & cp.shifted(small | digit | is_("|"), -1, False)
    broken = (inside(odd) >= 1) & (inside(is_("/")) == 0) & (inside(is_("_")) == 0)
    blob = (ink_size >= 30) & (inside((letter | digit) & (points < 128) | is_("+") | is_("/") | is_("=")) == ink_size) & (inside(digit) > 0)
    per_ink = lambda v: np.bincount(text_of_ink, weights=v, minlength=len(texts)).astype(np.int64)
    n["broken_words"], n["blob_chars"] = per_ink(broken), per_ink(np.where(blob, ink_size, 0))

    # scripts that have at least two adjacent letters
    script = (f >> cp.SCRIPT_SHIFT) & 15
    pair = np.where((script == cp.shifted(script, 1)) & (script > 0), script, 0)
    n["scripts"] = sum((per_text(pair == k + 1) > 0).astype(np.int64) for k in range(len(cp.SCRIPTS)) if cp.SCRIPTS[k] != "kana")

    # ends of sentences: a mark, closers, then a blank or the start of a caseless or capital letter
    end, close = has(cp.END), has(cp.CLOSE)
    after = cp.shifted(blank, 1, True) | cp.shifted(close, 1, False)
    wide = np.isin(points, [ord(c) for c in "。！？।"])
    n["sentence_ends"] = per_text(end & (after | wide) & ~cp.shifted(end, 1, False))

    # lines
    shape = line_shapes(points, f)
    ls, le = shape["start"], shape["end"]
    text_of_line = np.searchsorted(starts, ls, "right") - 1
    per_line = lambda v: np.bincount(text_of_line, weights=v, minlength=len(texts)).astype(np.int64)
    n["line_count"], n["punctuated_lines"] = per_line(shape["full"]), per_line(shape["ended"])
    chars = lambda v: per_line(np.where(v, le - ls + 1, 0))
    marked, entry, table, hexed, nav, time = (shape[k] for k in ("marked", "entry", "table", "hex", "nav", "chat"))
    n["list_chars"], n["entry_chars"], n["listing_chars"] = chars(marked), chars(entry), chars(marked | entry)
    n["table_chars"], n["hex_chars"], n["nav_chars"], n["chat_chars"] = chars(table), chars(hexed), chars(nav), chars(time)
    return n


def _stats(texts: pd.Series) -> pd.DataFrame:
    parts = [count_batch(part) for part in cp.slices(texts.tolist())]
    return pd.DataFrame({k: np.concatenate([n[k] for n in parts]).astype(np.int32) if parts else np.zeros(0, np.int32) for k in COUNTS})


RATIOS = {
    "mean_word_length": ("letter_count", "word_count"),
    "mean_line_length": ("char_count", "line_count"),
    "letter_ratio": ("letter_count", "ink"),
    "digit_ratio": ("digit_count", "ink"),
    "symbol_ratio": ("symbol_count", "ink"),
    "ends_per_word": ("sentence_ends", "word_count"),
    "punctuated_line_ratio": ("punctuated_lines", "line_count"),
    "common_word_ratio": ("common_words", "word_count"),
    "particle_ratio": ("common_particles", "letter_count"),
    "blob_ratio": ("blob_chars", "char_count"),
    "broken_word_ratio": ("broken_words", "word_count"),
    "list_ratio": ("list_chars", "char_count"),
    "entry_ratio": ("entry_chars", "char_count"),
    "listing_ratio": ("listing_chars", "char_count"),
    "table_ratio": ("table_chars", "char_count"),
    "nav_ratio": ("nav_chars", "char_count"),
    "hex_ratio": ("hex_chars", "char_count"),
    "chat_ratio": ("chat_chars", "char_count"),
    "wide_ratio": ("wide_count", "ink"),
}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_stats(documents: DataFrame, *also: str) -> DataFrame:
    """``doc_id``, the columns of ``also`` and every statistic of the documents that have a text (not null, not '')."""
    out = documents.where("text IS NOT NULL AND text <> ''").select("doc_id", *also, "text")
    counted = F.pandas_udf(_stats, ", ".join(f"{k} int" for k in COUNTS))
    out = out.select("doc_id", *also, counted("text").alias("__n")).select("doc_id", *also, "__n.*")
    ink = F.col("char_count") - F.col("blank_count")
    return out.withColumns({k: _ratio(F.col(a), ink if b == "ink" else F.col(b)) for k, (a, b) in RATIOS.items()})


# ---- rule induction

FEATURES = [*(r for r in RATIOS if r not in ("list_ratio", "entry_ratio", "chat_ratio", "mean_line_length")), "scripts", "word_count"]
SAMPLE = 6_000  # most documents that the rules are learned from; chosen by a hash of doc_id
# Classes in the order of their rules, and the kind each stands for; what no rule takes is prose.
CLASSES = {"hex": "junk", "blob": "junk", "symbols": "junk", "scripts": "junk", "navigation": "junk", "scan": "junk", "salad": "junk", "table": "table", "list": "list"}


def label_sample(s: pd.DataFrame) -> np.ndarray:
    """Classes of the sampled documents that are plain from one statistic or from the larger part of their lines;
    '' for the others, which then teach nothing."""
    loose = (s.table_ratio < 0.1) & (s.listing_ratio < 0.1) & (s.nav_ratio < 0.1)
    salad = loose & (s.wide_ratio < 0.05) & (s.common_word_ratio < 0.03) & (s.ends_per_word < 0.04) & (s.letter_ratio > 0.9) & (s.digit_ratio == 0) & (s.word_count > 12)
    names = ["hex", "blob", "symbols", "scripts", "navigation", "scan", "salad", "table", "list", "prose"]
    plain = [s.hex_ratio > 0.6, s.blob_ratio > 0.6, s.symbol_ratio > 0.25, (s.scripts >= 4) & (s.ends_per_word < 0.04), s.nav_ratio > 0.7, (s.broken_word_ratio > 0.15) & (s.wide_ratio < 0.1)]
    table = (s.table_ratio > 0.5) & (s.listing_ratio < 0.3)
    listing = (s.listing_ratio > 0.5) & (s.table_ratio < 0.3)
    spoken = (s.common_word_ratio + s.particle_ratio > 0.08) & (s.ends_per_word > 0.02) & (s.broken_word_ratio < 0.1)
    prose = (spoken | ((s.wide_ratio > 0.3) & (s.scripts <= 3))) & (s.table_ratio < 0.5) & (s.listing_ratio < 0.5)
    return np.select([*plain, salad, table, listing, prose], names, "").astype(object)


def _covered(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for k, op, t in rule:
        hit &= (x[:, k] > t) if op == ">" else (x[:, k] <= t)
    return hit


def _grow(x: np.ndarray, y: np.ndarray, most: int = 5) -> list[tuple[int, str, float]]:
    """Conditions added one by one, each with the greatest information gain, until only positives are covered."""
    rule: list[tuple[int, str, float]] = []
    here = np.ones(len(x), bool)
    while len(rule) < most and (~y[here]).any():
        p0, n0 = y[here].sum(), (~y[here]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for k in range(x.shape[1]):
            order = np.argsort(x[here, k], kind="stable")
            v, pos = x[here, k][order], y[here][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p_low = np.cumsum(pos)[cut]
            low = cut + 1
            for op, p, size in (("<=", p_low, low), (">", p0 - p_low, p0 + n0 - low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / size) - base), -1)
                j = int(np.argmax(gain))
                if gain[j] > best[0]:
                    best = (gain[j], (k, op, float((v[cut[j]] + v[cut[j] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        here &= _covered(x, [best[1]])
    return rule


def _prune(x: np.ndarray, y: np.ndarray, rule: list) -> list:
    """The prefix of the rule with the best (p - n) / (p + n) on held-out rows."""

    def worth(r):
        hit = _covered(x, r)
        p, n = y[hit].sum(), (~y[hit]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def induce(x: np.ndarray, labels: np.ndarray, seed: int = 7) -> list[tuple[str, list[tuple[int, str, float]]]]:
    """An ordered rule list by incremental reduced-error pruning: for each class in turn rules are grown on two
    thirds of the rows left, pruned on the rest, and kept while they are right for most of the held-out rows they cover."""
    rng = np.random.default_rng(seed)
    left, rules = np.ones(len(x), bool), []
    for kind in CLASSES:
        while (labels[left] == kind).sum() >= 3:
            at = rng.permutation(np.flatnonzero(left))
            y = labels[at] == kind
            part = np.zeros(len(at), bool)
            for value in (True, False):  # both parts hold both classes
                own = np.flatnonzero(y == value)
                part[own[: -(-2 * len(own) // 3)]] = True
            grow, hold = at[part], at[~part]
            rule = _grow(x[grow], labels[grow] == kind)
            if not rule:
                break
            rule = _prune(x[hold], labels[hold] == kind, rule)
            hit, good = _covered(x[hold], rule), labels[hold] == kind
            if (good & hit).sum() <= (~good & hit).sum():
                break
            rules.append((kind, rule))
            left &= ~_covered(x, rule)
    return rules


def case_of(rules: list) -> str:
    """The rule list as one SQL expression over the statistics."""
    arms = [f"WHEN {' AND '.join(f'{FEATURES[k]} {op} {t!r}D' for k, op, t in rule)} THEN '{CLASSES[kind]}'" for kind, rule in rules]
    return f"CASE {' '.join(arms)} ELSE 'prose' END" if arms else "'prose'"


def learn_rules(documents: DataFrame, sample: int = SAMPLE) -> list:
    """Rules from at most about ``sample`` documents, the same ones in every run; fewer where the table is smaller."""
    share = max(1, round(documents.count() / sample))
    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    rows = with_stats(some).select(*FEATURES).toPandas()
    labels = label_sample(rows)
    known = labels != ""
    return induce(rows[FEATURES].to_numpy(np.float64)[known], labels[known])


def with_kind(documents: DataFrame, *also: str) -> DataFrame:
    """Every statistic of each document with text and its ``kind``: prose, list, table or junk.

    Documents with null or empty text have no row; a text of blanks only has zero ratios and is prose; equal texts have
    equal rows; columns of the input beyond ``doc_id``, ``text`` and those named are not read.
    """
    blank = F.col("char_count") <= F.col("blank_count")
    return with_stats(documents, *also).withColumn("kind", F.when(blank, "prose").otherwise(F.expr(case_of(learn_rules(documents)))))


QUERIES = {
    "p6_found": lambda spark, d: with_kind(table(spark, d, "documents")).where("kind <> 'prose'").select("doc_id", "kind"),
    "p6_statistics": lambda spark, d: with_kind(table(spark, d, "documents")),
}
SQL: dict[str, str] = {}
