"""Text cut off by field limits (problem 9).

Spark counts, by exact 64-bit keys, the trie of the corpus: every word and every proper prefix of a word, alone and after
the word before it, and longer stretches of words; each node holds how often it was seen whole, how often as the start of
a longer word, and how often an end followed.  Only the nodes at the ends of texts are joined to their counts.  A text is
cut off where its last token is an unknown proper prefix of known words or its last words are hardly ever followed by an
end; lengths at which a source's texts pile up raise the suspicion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm import codepoints as cp
from loomtext.llm import mojibake, textstats
from loomtext.runtime import durable, table

LEVELS = 4  # stretches of one to four words (of one, two, three and six characters of scripts without spaces)
FORM = LEVELS  # kind of the forms of first lines of paragraphs; kinds below are levels
WEIGHT = 2.0  # pseudo-counts by which a shorter stretch speaks for a longer one
PRIOR = 0.15  # chance of an end after a stretch of which nothing is known
PILE = 6.0  # times the mean of a source's neighbouring lengths that make a length a limit
FORM_TOKENS = 8  # a first line of more tokens has no form of its own
OMITTED = re.compile(r"\s*(?:\[(?:…|\.\.\.)\]|\((?:…|\.\.\.)\)|…|\.\.\.)$")
SAID = re.compile(r"[\[(](?:…|\.\.\.)[\])]$")
COLUMNS = ("whole", "longer", "ended", "dotted", "closed")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (b + _MIX[0])) * _MIX[1]
        return h ^ (h >> np.uint64(31))


def analyse(texts: list[str]) -> dict[str, np.ndarray]:
    """Tokens of all texts: words, or single characters of scripts without spaces; numbers count as one token.  For each
    its text, span, keys of four levels (short to long), what stands left of it, whether an end follows, whether a period
    follows at once and closes its line, and the form of its line up to it."""
    points, starts = cp.flatten(texts)
    f = cp.flags_of(points)
    shape = textstats.line_shapes(points, f)
    low = cp.lowered(points)
    script = (f >> cp.SCRIPT_SHIFT) & 15
    dense = np.isin(script, [3, 4, 7])  # han, kana, thai
    digit = (f & cp.DIGIT) != 0
    word = ((f & cp.LETTER) != 0) | digit
    kind = np.where(word, np.where(digit, 2, 1), 0) + np.where(dense & word, np.arange(len(points)) + 10, 0)
    change = np.flatnonzero(np.diff(np.concatenate(([-1], kind))) != 0)
    ws = change[kind[change] > 0]
    stop = np.append(change[1:], len(points))
    we = stop[kind[change] > 0]
    one = dense[ws]
    h = cp.span_hashes(low, ws, we)
    h[digit[ws]] = np.uint64(7)
    owner = np.searchsorted(starts, ws, "right") - 1
    # what stands between a token and the next one of its text
    end = (f & cp.END) != 0
    blank = (f & cp.BLANK) != 0
    wide = np.isin(points, [ord(c) for c in "。！？।"])
    closes = cp.shifted(blank | ((f & cp.CLOSE) != 0), 1, True)
    breaks = (end & (closes | wide)).astype(np.int64)
    newline = (f & cp.NEWLINE) != 0
    line_of = np.searchsorted(shape["start"], np.arange(len(points)), "right") - 1
    structured = (shape["table"] | shape["marked"] | shape["entry"] | shape["chat"])[line_of]
    empty = ~shape["full"]
    next_empty = np.append(empty[1:], True)[line_of]
    breaks += newline & (structured | next_empty)
    breaks += blank & (cp.shifted(script, -1) == 7)  # a blank after Thai parts sentences or clauses
    breaks[starts[1:] - 1] += 1  # a text's end; a text that is cut off is taken out again where it is judged
    marks = ~blank & ~word
    total = np.concatenate(([0], np.cumsum(breaks)))
    nxt = np.append(ws[1:], len(points))
    last = np.append(owner[1:] != owner[:-1], True)
    until = np.where(last, starts[owner + 1], nxt)
    ended = total[until] - total[we] > 0
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(ws) else np.zeros(0, bool)
    # what stands before a token: the last mark since the token before it, all end marks alike, and whether an end came
    ink = np.maximum.accumulate(np.where(blank, 0, np.arange(len(points))))[np.maximum(ws - 1, 0)]
    floor = np.where(first, starts[owner], np.concatenate(([0], we[:-1]))) if len(ws) else ws
    mark_before = np.where((ink >= floor) & (ink < ws) & ~blank[ink], np.where(end[ink], ord("."), points[ink]), 0).astype(np.uint64)
    broke = np.where(first, True, np.concatenate(([True], ended[:-1]))) if len(ws) else first
    before = mark_before * np.uint64(2) + broke.astype(np.uint64)
    levels, left, c = [], [], h.copy()
    back = np.arange(len(ws))
    alive = np.ones(len(ws), bool)
    ahead = np.zeros(len(ws), np.uint64)  # all that stands left of the token within the stretch
    for _ in range(6):
        levels.append(_mix(ahead, c) if len(left) else c)
        more = alive & ~broke[back]
        prev = np.where(more, h[np.maximum(back - 1, 0)], np.uint64(1))
        ahead = np.where(alive, _mix(_mix(ahead, prev), before[back]), ahead)
        left.append(ahead.copy())
        alive = more
        back = np.where(alive, back - 1, back)
    keys = [np.where(one, levels[b], levels[a]) for a, b in ((0, 0), (1, 1), (2, 2), (3, 5))]
    after = np.minimum(we, len(points) - 1)
    dotted = points[after] == ord(".")
    closed = dotted & newline[np.minimum(we + 1, len(points) - 1)]
    # the form of a paragraph's first line up to each of its tokens: marks, capitals, numbers
    line = line_of[ws]
    opens = (np.concatenate(([True], empty[:-1])) | np.isin(shape["start"], starts[:-1]))[line]
    nth = np.arange(len(ws)) - np.searchsorted(line, line, "left")
    mark = np.where(marks, (points + np.uint32(1)).astype(np.uint64), np.uint64(0))
    run = np.concatenate(([np.uint64(0)], np.cumsum(mark * np.uint64(0x2545F491), dtype=np.uint64)))
    upper = (f & cp.UPPER) != 0
    piece = np.where(digit[ws], 3, np.where(upper[ws], np.where(upper[np.minimum(ws + 1, len(points) - 1)], 2, 1), np.where(one, 4, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        upto = run[ws] - run[shape["start"][line]]  # sums of marks are exact, whatever their order
        own = (piece + np.uint64(1)) * cp._powers()[np.minimum(nth, 63)]
        total_own = np.concatenate(([np.uint64(0)], np.cumsum(own, dtype=np.uint64)))
        form = _mix(total_own[np.arange(len(ws)) + 1] - total_own[np.arange(len(ws)) - nth], upto)
    has_form = opens & (nth < FORM_TOKENS)
    next_newline = newline[after] & (np.append(empty[1:], True) | np.isin(shape["end"] + 1, starts))[line]
    return {"points": low, "owner": owner, "start": ws, "end": we, "hash": h, "left": left[0] if left else c, "keys": keys, "ended": ended, "last": last, "dense": one, "offset": starts, "digit": digit[ws],
            "dotted": dotted, "closed": closed, "form": form, "has_form": has_form, "alone": next_newline}


def prefixes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the proper prefixes of each stretch, as ``span_hashes`` gives them, and the stretch of each."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    owner = np.repeat(np.arange(len(starts)), lengths)
    inner = np.arange(len(owner)) - firsts[owner]
    with np.errstate(over="ignore"):
        terms = (points[starts[owner] + inner].astype(np.uint64) + np.uint64(1)) * cp._powers()[inner & 63]
        run = np.cumsum(terms, dtype=np.uint64)
        h = run - (run[firsts] - terms[firsts])[owner]
    proper = inner + 1 < lengths[owner]
    return h[proper], owner[proper]


def _summed(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Each distinct key and the sums of its values."""
    code, own = pd.factorize(keys)
    return [own, *(np.bincount(code, v, len(own)).astype(np.int64) for v in values)]


def _prefix_rows(a: dict, own: np.ndarray, left: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the proper prefixes of the words at the places ``own``, after what stands left of them, and how often each is one."""
    pair = a["hash"][own] if left is None else _mix(left[own], a["hash"][own])
    code, words = pd.factorize(pair.view(np.int64))
    n = np.bincount(code, minlength=len(words))
    first = np.zeros(len(words), np.int64)
    first[code[::-1]] = own[::-1]
    h, owner = prefixes(a["points"], a["start"][first], a["end"][first])
    return (h if left is None else _mix(left[first][owner], h)).view(np.int64), n[owner]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts: dict[int, list] = {}
        for texts in cp.slices([t for t in b["text"] if t]):
            a = analyse(texts)
            ones, none = np.ones(len(a["start"]), np.int64), np.zeros(len(a["start"]), np.int64)
            inner = np.flatnonzero(~a["dense"] & ~a["digit"] & ~a["last"])  # the last word of a text may be cut and starts nothing
            for level, key in enumerate(a["keys"]):
                keys, values = [key.view(np.int64)], [[ones, none, a["ended"], a["dotted"], a["closed"]]]
                if level < 2:
                    h, n = _prefix_rows(a, inner, a["left"] if level else None)
                    keys.append(h)
                    values.append([z := np.zeros(len(h), np.int64), n, z, z, z])
                parts.setdefault(level, []).append(_summed(np.concatenate(keys), [np.concatenate(v) for v in zip(*values)]))
            at = np.flatnonzero(a["has_form"])
            parts.setdefault(FORM, []).append(_summed(a["form"][at].view(np.int64), [ones[at], none[at], a["alone"][at], none[at], none[at]]))
        for kind, each in parts.items():
            keys, *values = (np.concatenate(x) for x in zip(*each))
            keys, *values = _summed(keys, values)
            yield pd.DataFrame({"kind": np.full(len(keys), kind, np.int8), "key": keys, **dict(zip(COLUMNS, values))})


def learn(documents: DataFrame) -> DataFrame:
    """(kind, key, whole, longer, ended, dotted, closed): how often each node of the trie was seen whole, how many longer
    words start with it, how often an end followed, and how often a period followed at once and closed its line.  Counts
    are exact by 64-bit key; they are summed in each batch and then by Spark."""
    counted = documents.where("text IS NOT NULL AND text <> ''").select("text").mapInPandas(_count, "kind tinyint, key bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS))
    return counted.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in COLUMNS])


def _piled(sized: DataFrame) -> DataFrame:
    """(source, size) of the sizes at which five texts of a source or more, and at least one in two hundred of them, have
    their end, ``PILE`` times as many as at the sizes around."""
    at = sized.groupBy("source", "size").count()
    around = Window.partitionBy("source").orderBy("size").rangeBetween(-10, 10)  # distinct sizes only, not texts
    near = at.withColumn("near", (F.sum("count").over(around) - F.col("count")) / 20).withColumn("total", F.sum("count").over(Window.partitionBy("source")))
    return near.where((F.col("count") >= 5) & (F.col("count") * 200 >= F.col("total")) & (F.col("count") > PILE * F.col("near"))).select("source", "size")


def limits(documents: DataFrame) -> set[tuple[str, str, int]]:
    """(source, unit, length) at which the lengths of a source's texts pile up, in characters, or in bytes where it is
    not the characters that pile up.  A limit stops at least one text in two hundred of its source, so there are at most
    four hundred of a source."""
    texts = documents.where("text IS NOT NULL AND text <> ''").select(F.coalesce("source", F.lit("")).alias("source"), F.length("text").alias("size"), F.octet_length("text").alias("bytes"))
    chars = _piled(texts.select("source", "size"))
    rest = texts.join(F.broadcast(chars), ["source", "size"], "left_anti").select("source", F.col("bytes").alias("size"))
    return {(r["source"], r["unit"], r["size"]) for r in chars.withColumn("unit", F.lit("chars")).unionByName(_piled(rest).withColumn("unit", F.lit("bytes"))).collect()}


PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "（": "）", "(": ")"}
ENDMARK = re.compile(r"[.!?…。！？।؟][\"”»“’」』）)\]]*$|[\"”»“’」』][.!?।。]$")


NEAR = 160  # an opening mark farther from the end than this was left open by something else


def _open(text: str) -> bool:
    """Whether the end of the last paragraph leaves a quotation or bracket open."""
    block = re.split(r"\n\s*\n", text)[-1]
    if re.search(r"^\[\d\d?:\d\d\]", block):
        block = block.split("\n")[-1]
    open_at = []
    for k, ch in enumerate(block):
        if open_at and ch in PAIRS[block[open_at[-1]]]:
            open_at.pop()
        elif ch in PAIRS and block[k + 1:k + 2].strip() and (k == 0 or block[k - 1] in " \n\t([¿¡—–-:" or block[k - 1] > "\u2e80"):
            open_at.append(k)
    if block.count('"') % 2 == 1:
        k = block.rindex('"')
        if block[k + 1:k + 2].strip() and not block[k - 1:k].strip(" \n("):
            open_at.append(k)
    return bool(open_at) and len(block) - open_at[-1] < NEAR


def _row_cut(text: str) -> bool | None:
    """For a text whose last lines are rows: whether the last has fewer cells than the row before, or no closing mark as it
    has; None for other texts."""
    lines = re.split(r"\n[ \t]*\n", text)[-1].split("\n")
    if len(lines) < 2:
        return None
    last, rows = lines[-1], lines[:-1]
    if last.startswith("|") and rows[-1].startswith("|"):
        return not last.rstrip().endswith("|") or last.count("|") < rows[-1].count("|")
    if last.lstrip().startswith("{") and rows[-1].lstrip().startswith("{"):
        return not last.rstrip().endswith("}")
    for mark in ("\t", ";", ",", r" {3,}"):
        n = [len(re.findall(mark, x.strip())) for x in (*rows, last)]
        if mark == "," and " " in re.sub(r"[^,]*,(.)[^,]*", r"\1", last):
            continue
        if max(n[:-1]) >= 2 and n[-2] >= 2:
            return n[-1] < n[-2]
    return None


def _end_of(text: str, words: int = 8) -> str:
    """The end of a text with at least so many of its last tokens and its whole last paragraph, from the start of a line."""
    at = max(text.rfind("\n\n") + 1, 0)
    while at > 0 and len(re.findall(r"\w+", text[at:])) < words:
        at = max(text.rfind("\n", 0, at - 1) + 1, 0)
    return text[at:] if at else text


def _last_tokens(tail: str, size: int = 200) -> str:
    """As much of a text's end as its last token's keys and form depend on: nine tokens or more, lines whole where there
    are several."""
    end = tail[-size:]
    if len(end) == len(tail) or len(re.findall(r"\w+", end)) < 9:
        return tail
    return tail[tail.rfind("\n", 0, len(tail) - size) + 1:] if "\n" in end else end


CUT, PERIOD, OPEN, ROW = 0, 1, 2, 3  # what a text's end calls for: nothing more, its period's counts, its last words', its last word's alone
CLOSING = re.compile(r"[|}\])]$")


def questions(texts: list[str], sources: list[str | None], piled: set) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, rule, least, kind, key): what must be known of each text that may be cut off; a text is cut where the
    chance of an end is below ``least``.  Texts that are plainly whole have no rows."""
    tails, omitted = [], []
    in_bytes = {source for source, unit, _ in piled if unit == "bytes"}
    for t in texts:
        t = mojibake.easily_undone(_end_of(t.rstrip())).rstrip()
        cut = OMITTED.sub("", t)
        lost = cut.rstrip("\ufffd")  # a character cut in half, or a sign that was lost
        omitted.append(2 if SAID.search(t) else 1 if len(lost) < len(t) else 0)
        tails.append(lost or t)
    a = analyse([_last_tokens(t) for t in tails])
    keys = [c.view(np.int64) for c in a["keys"]]
    form = a["form"].view(np.int64)
    at_last = np.flatnonzero(a["last"])
    for k, j in zip(a["owner"][at_last].tolist(), at_last.tolist()):
        t, tail = texts[k], tails[k]
        after = tail[len(tail) - (int(a["offset"][k + 1]) - 1 - int(a["end"][j])):] if a["offset"][k + 1] - 1 > a["end"][j] else ""  # what follows the last token
        source = sources[k] or ""
        pile = (source, "chars", len(t)) in piled
        if not pile and source in in_bytes:  # a limit in bytes drops a character that it would cut
            size, widest = len(t.encode("utf-8", "replace")), max(len(c.encode("utf-8", "replace")) for c in t[-40:])
            pile = any((source, "bytes", size + d) in piled for d in range(widest))
        if omitted[k] == 2:
            yield k, CUT, 0.0, FORM, 0
        elif ENDMARK.search(tail) is not None and not omitted[k]:
            if _open(tail):
                yield k, CUT, 0.0, FORM, 0
            elif after == ".":
                for level in (0, 1):
                    yield k, PERIOD, 0.0, level, int(keys[level][j])
        elif (row := _row_cut(tail)) is not None:
            if row or pile and a["digit"][j] and after == "":
                yield k, CUT, 0.0, FORM, 0
            else:  # as wide as the row before: only its last word can tell
                for level in (0, 1):
                    yield k, ROW, 0.0, level, int(keys[level][j])
        elif _open(tail) or re.search(r"[,;:–—=(\[«“„&×-]\s*$", tail) is not None:
            yield k, CUT, 0.0, FORM, 0
        elif not (pile and CLOSING.search(tail)):
            least = 0.9 if pile else 0.5 if omitted[k] else 0.12
            if pile and a["digit"][j] and after == "":
                least = 1.0
            for level, c in enumerate(keys):
                yield k, OPEN, least, level, int(c[j])
            if a["has_form"][j] and not pile and not omitted[k]:
                yield k, OPEN, least, FORM, int(form[j])


def _ask(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 500):
                part = b.iloc[s:s + 500]
                rows = list(questions(part["text"].tolist(), part["source"].tolist(), shared.value))
                if rows:
                    at, rule, least, kind, key = zip(*rows)
                    yield pd.DataFrame({"id": part["id"].to_numpy()[list(at)], "rule": np.array(rule, np.int8), "least": least, "kind": np.array(kind, np.int8), "key": np.array(key, np.int64)})

    return run


def judged(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(id) of the texts that the counts of their nodes show to be cut off.  Each text, and every copy of it, is taken out
    of the counts first."""
    of = asked.groupBy("id", "rule", "least", "kind", "key").agg(F.count("*").alias("own")).join(counts, ["kind", "key"], "left")
    less = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) - F.col("own"), F.lit(0))
    node = F.struct(less("whole").alias("whole"), F.coalesce("longer", F.lit(0)).alias("longer"), less("ended").alias("ended"), less("dotted").alias("dotted"), less("closed").alias("closed"))
    of = of.groupBy("id", "rule", "least").agg(*[F.max(F.when(F.col("kind") == k, node)).alias(f"k{k}") for k in range(LEVELS + 1)])
    got = lambda k, c: F.coalesce(F.col(f"k{k}")[c], F.lit(0))
    chance = F.lit(PRIOR)
    for k in range(LEVELS):  # a longer stretch counts as far as it was seen
        chance = (got(k, "ended") + WEIGHT * chance) / (got(k, "whole") + got(k, "longer") + WEIGHT)
    lone = (got(FORM, "whole") >= 3) & (got(FORM, "ended") * 2 >= got(FORM, "whole"))  # such a line of its own ends without a mark
    unknown = (got(0, "whole") < 2) & (got(0, "longer") >= 2)  # an unknown proper prefix of known words
    after = (got(1, "whole") * 50 < got(1, "longer")) & (got(1, "longer") >= 5)  # the same after the word before it
    dot = lambda k: (got(k, "dotted") >= 20) & (got(k, "closed") * 50 < got(k, "dotted"))
    period = F.when(got(1, "dotted") >= 20, dot(1)).otherwise(dot(0))
    cut = (F.when(F.col("rule") == CUT, True).when(F.col("rule") == PERIOD, period)
           .otherwise(unknown | after | ((F.col("rule") == OPEN) & ~lone & (chance < F.col("least")))))
    return of.where(cut).select("id").distinct()


def cut_off(documents: DataFrame) -> DataFrame:
    """(doc_id, source) of the documents whose text breaks off.

    Null, empty and blank texts and junk are no cases; equal texts of one source have equal results; the rows keep no
    other column; an empty table gives an empty table.
    """
    shared = documents.sparkSession.sparkContext.broadcast(limits(documents))
    source = F.coalesce("source", F.lit(""))
    own = F.unhex(F.md5(F.concat(F.length(source).cast("string"), F.lit(":"), source, F.col("text"))))
    texts = documents.where(r"text IS NOT NULL AND text RLIKE '\\S'").select("doc_id", "text", "source", own.alias("id"))
    asked = durable(texts.select("id", "text", "source").mapInPandas(_ask(shared), "id binary, rule tinyint, least double, kind tinyint, key bigint"))
    # the counts that are asked for are written first, so that Spark sees the sizes of both sides and splits frequent keys
    counts = durable(learn(documents).join(asked.select("kind", "key").distinct(), ["kind", "key"], "left_semi"))
    # written first, because the filter of junk would else be moved below the join and count statistics of every text
    found = durable(texts.join(judged(asked, counts), "id", "left_semi").select("doc_id", "source", "text"))
    rules = textstats.learn_rules(documents)
    return textstats.with_stats(found, "source").where(F.expr(textstats.case_of(rules)) != "junk").select("doc_id", "source")


def rates(documents: DataFrame) -> DataFrame:
    """For each source its texts, those cut off, and the rate; sources without any come out with a rate of 0."""
    cases = cut_off(documents).groupBy("source").agg(F.count("*").alias("cut"))
    texts = documents.where("text IS NOT NULL AND text <> ''").groupBy("source").agg(F.count("*").alias("texts"))
    both = texts.join(cases.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return both.select("source", "texts", F.coalesce("cut", F.lit(0)).cast("bigint").alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("rate"))


QUERIES = {
    "p9_found": lambda spark, d: cut_off(table(spark, d, "documents")).select("doc_id"),
    "p9_source_rates": lambda spark, d: rates(table(spark, d, "documents")),
}
SQL: dict[str, str] = {}
