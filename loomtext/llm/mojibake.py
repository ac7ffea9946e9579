"""Garbled text from wrong character encodings (problem 2).

A smoothed trigram model of characters is trained on clean records; every chain of encodings that may explain a
suspicious run is undone and scored, and the likeliest is accepted where it beats the text as it stands by more than a
margin validated on the runs of all clean records, as they stand and garbled on purpose.
"""

from __future__ import annotations

import codecs
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import codepoints as cp
from loomtext.runtime import durable, table

FLOOR = 4_000_000  # a trigram rarer than one in so many is taken as not seen, so the model holds at most so many
EACH, UNSEEN = 0.02, 21_000.0  # pseudo-counts of a trigram, and of all that were not seen
STEPS = 1_000  # gains are counted in steps of one in so many
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8-r", "iso8859-2", "iso8859-15", "cp1256", "cp874")
READ_WIDE = ("gb18030", "shift_jis", "euc_jp", "big5")
# (read as, really): what was decoded by the first but had been encoded by the second
CHAINS = (
    [(w, "utf-8") for w in READ_AS] + [(w, "utf-8") for w in READ_WIDE]
    + [("latin-1", r) for r in ("gb18030", "euc_jp", "shift_jis", "big5", "euc_kr", "cp1251", "koi8-r", "cp1250", "iso8859-2", "cp1256", "cp874", "iso8859-5", "iso8859-6")]
    + [("cp1252", r) for r in ("gb18030", "euc_jp", "shift_jis", "big5", "cp1251", "koi8-r", "cp1250", "iso8859-2", "cp1256", "cp874", "mac_roman", "cp437", "cp850")]
    + [("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("gb18030", "shift_jis"), ("shift_jis", "gb18030"), ("gb18030", "big5"), ("shift_jis", "euc_jp")]
)
LOST = "�"


@lru_cache(maxsize=None)
def _bytes_of(codec: str) -> dict[int, int]:
    """Character to byte of a single-byte codec; bytes it leaves undefined stand for the control characters of Latin-1."""
    return {ord(bytes([b]).decode(codec, "ignore") or chr(b)): b for b in range(0x80, 0x100)} | {b: b for b in range(0x80)}


def _encode(text: str, codec: str) -> bytes | None:
    if codec in READ_WIDE:
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    try:
        return codecs.charmap_encode(text, "strict", _bytes_of(codec))[0]
    except UnicodeEncodeError:
        return None


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def undo(text: str, chain: tuple[str, str]) -> str | None:
    """``text`` as it was before the wrong decoding; bytes that cannot be told come out as U+FFFD.  None where the chain
    cannot have made the text or most of it would be lost."""
    raw = _encode(text, chain[0])
    if raw is None:
        return None
    out = raw.decode(chain[1], "replace")
    return None if out == text or out.count(LOST) * 3 > len(out) or _CONTROL.search(out) else out


def _pairs(codec: str, *more: int) -> str:
    at = lambda b: re.escape(bytes([b]).decode(codec, "ignore") or chr(b))
    return f"[{''.join(at(b) for b in (*more, 0xC3, 0xC4, 0xC5, 0xD0, 0xD1, 0xD8, 0xD9, 0xE0, *range(0xE2, 0xEA)))}][{''.join(at(b) for b in range(0x80, 0xC0))}]"


# Records with any of these are not used for training; many clean ones are left out with them.  Each pattern is told from its
# first character beyond ASCII on (what stands before and at it, what follows), so that the search can leap from one to the next.
_DOUBTS = [*((x[:k], x[k:]) for x in (_pairs(c) for c in ("cp1252", "latin-1", "cp1250", "cp437", "cp850", "cp1251")) for k in [x.index("][") + 1]), ("Â", "[\x80-\xbf]"), ("[\x80-\x9f�√]", ""), ("‚", "Ä"), ("[¬≈∞∂]", "[\x80-ÿ√π∫ªº]"), ("[¡-ÿ]", "[¡-ÿ]{3}"), ("[a-zà-ÿ][¹³¿¼¾œ]", "[a-zà-ÿ]"), ("[a-z][±¶¦¯¬£¥§©®°µ¸»«¢¤¨²´¡]", "[a-z]")]
DOUBTFUL = re.compile("[" + "".join(x[x.rindex("[") + 1:-1] if x[-1] == "]" else x for x, _ in _DOUBTS) + "](?:" + "|".join(f"(?<={x}){y}" for x, y in _DOUBTS) + ")")
PLUS = re.compile(r"\+[A-Za-z0-9/]{3,}-")


def doubtful(text: str) -> bool:
    return DOUBTFUL.search(text) is not None or ("+" in text and PLUS.search(text) is not None)


RUN = re.compile(r"[^\x00-\x7f]+(?:[\x40-\x7e]?[^\x00-\x7f]+)*[\x40-\x7e]?")
SHORT_RUN = re.compile(r"[^\x00-\x7f]+")
UTF7 = re.compile(r"\+([A-Za-z0-9/+]{3,})-")


# What UTF-8 looks like that was read in one of the usual single-byte encodings: a lead byte's character and its followers'.
READ_UTF8 = {w: re.compile(f"(?:{_pairs(w, 0xC2)}[{''.join(re.escape(bytes([b]).decode(w, 'ignore') or chr(b)) for b in range(0x80, 0xC0))}]*)+") for w in ("cp1252", "latin-1", "cp1250", "cp437", "cp850", "mac_roman", "cp1251", "cp1254", "iso8859-2")}
_LEADS = {bytes([b]).decode(w, "ignore") or chr(b) for w in READ_UTF8 for b in (0xC2, 0xC3, 0xC4, 0xC5, 0xD0, 0xD1, 0xD8, 0xD9, 0xE0, *range(0xE2, 0xEA))}
_FOLLOW = {bytes([b]).decode(w, "ignore") or chr(b) for w in READ_UTF8 for b in range(0x80, 0xC0)}
ANY_READ = re.compile(f"[{''.join(map(re.escape, sorted(_LEADS)))}][{''.join(map(re.escape, sorted(_FOLLOW)))}]")


_HIGH = re.compile("[\x80-\xff]{2}[\x80-\xff\x40-\x7e]{2}")
_UTF7_ANY = re.compile(r"\+[A-Za-z0-9/+]{3,}-?")


def _wide_undone(line: str) -> str:
    """A line of bytes of a two-byte encoding, if one of them explains it: the one that gives the most particles."""
    raw = _encode(line, "latin-1") or _encode(line, "cp1252")
    best, most = line, 1
    for codec in READ_WIDE if raw else ():
        try:
            out = raw.decode(codec)
        except UnicodeDecodeError:
            continue
        n = sum(map(out.count, cp.PARTICLES))
        if n > most:
            best, most = out, n
    return best


def _utf7(m: re.Match) -> str:
    try:
        out = m.group().encode().decode("utf-7")
    except UnicodeDecodeError:
        return m.group()
    return m.group() if out.isascii() else out


def easily_undone(text: str) -> str:
    """``text`` with what can be put right without a model: runs that are valid UTF-8 once the bytes of one single-byte
    encoding are told, up to three times over; UTF-7; lines of a two-byte encoding.  The rest is for the model to judge."""
    if "+" in text and UTF7.search(text):
        text = _UTF7_ANY.sub(_utf7, text)
    if text.isascii():
        return text
    for _ in range(3):
        if not ANY_READ.search(text):
            break
        best, most = text, 0
        for w, pattern in READ_UTF8.items():
            gained = 0

            def good(m):
                nonlocal gained
                raw = _encode(m.group(), w)
                try:
                    out = raw.decode("utf-8") if raw else m.group()
                except UnicodeDecodeError:
                    return m.group()
                gained += len(m.group()) - len(out)
                return out

            got = pattern.sub(good, text)
            if gained > most:
                best, most = got, gained
        if not most:
            break
        text = best
    if _HIGH.search(text):
        text = "\n".join(_wide_undone(x) if _HIGH.search(x) else x for x in text.split("\n"))
    return text


def trigrams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams with a character beyond ASCII, as one exact number each, and the places where they start."""
    a, b, c = (points[k:len(points) - 2 + k] for k in range(3))
    at = np.flatnonzero((a > 127) | (b > 127) | (c > 127))
    return (a[at].astype(np.int64) << 42) | (b[at].astype(np.int64) << 21) | c[at].astype(np.int64), at


class Model:
    """Log-probabilities of trigrams in a table by hash; each slot keeps its trigram, and those that find their slot taken
    stand in a sorted list of their own, so that no two trigrams ever share a count."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(-n, kind="stable")
        keys, n = keys[order], n[order].astype(np.float64)
        total = n.sum() + UNSEEN
        value = np.log((n + EACH) / total).astype(np.float32)
        self.unseen = float(np.log(EACH / total))
        self.bits = np.uint64(64 - max(10, int(2 * max(len(keys), 1)).bit_length()))
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        size = 1 << int(64 - self.bits)
        self.key, self.value = np.full(size, -1, np.int64), np.full(size, self.unseen, np.float32)
        self.key[slot[first]], self.value[slot[first]] = keys[first], value[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more, self.more_value = keys[rest], value[rest]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out, same = self.value[slot], self.key[slot] == keys
        if not same.all():
            other = np.flatnonzero(~same)
            out[other] = self.unseen
            if len(self.more):
                at = np.minimum(np.searchsorted(self.more, keys[other]), len(self.more) - 1)
                hit = self.more[at] == keys[other]
                out[other[hit]] = self.more_value[at[hit]]
        return out


def _points(text: str) -> np.ndarray:
    return cp.lowered(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))


def _values(raw: str | None) -> list[str]:
    """The string values of a JSON object; a text that is no JSON object is one value as it stands."""
    if not raw:
        return []
    try:
        got = json.loads(raw)
    except ValueError:
        return [raw]
    return [v for v in got.values() if isinstance(v, str)] if isinstance(got, dict) else [raw]


def fields_of(text: str | None, raw: str | None) -> list[tuple[str, str]]:
    return ([("text", text)] if text else []) + ([("metadata_json", "\n".join(v))] if (v := _values(raw)) else [])


Run = tuple[str, str, str]  # up to two characters before a run, the run, up to two after it


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The trigrams of clean records, and their runs in context (where ``run`` is not null), with how often they occur."""
    for b in batches:
        texts = [s for t, m in zip(b["text"], b["metadata_json"]) for _, s in fields_of(t, m) if not s.isascii() and not doubtful(s)]
        keys = [trigrams(_points("\n\n".join(texts[k:k + 500]) + "\n\n"))[0] for k in range(0, len(texts), 500)]
        own, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pd.DataFrame({"trigram": own, "before": None, "run": None, "after": None, "n": n})
        runs: Counter[Run] = Counter()
        for t in texts:
            runs.update([(t[max(0, (s := m.start()) - 2):s], m.group(), t[(e := m.end()):e + 2]) for m in SHORT_RUN.finditer(t)])
        if runs:
            before, run, after = zip(*runs)
            yield pd.DataFrame({"trigram": 0, "before": before, "run": run, "after": after, "n": list(runs.values())})


def learn(documents: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all clean records, and their runs: exact counts, summed in each batch and then by Spark, of trigrams
    those above the floor."""
    key = ["trigram", "before", "run", "after"]
    counted = documents.select("text", "metadata_json").mapInPandas(_train, "trigram bigint, before string, run string, after string, n bigint").groupBy(*key).agg(F.sum("n").alias("n"))
    counted = durable(counted)
    known = counted.where("run IS NULL").select("trigram", "n")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = known.where(F.col("n") * FLOOR >= total).toArrow()
    return Model(got["trigram"].to_numpy(), got["n"].to_numpy()), counted.where("run IS NOT NULL").select("before", "run", "after", "n")


def explanations(run: str) -> list[tuple[float, str, str]]:
    """(cost, chain, restored) of all that may be undone in a run; of equal texts the cheapest and first.  Those of short
    runs, which come again in other contexts, are kept."""
    return _short_explained(run) if len(run) <= 12 else _explained(run)


def _explained(run: str) -> list[tuple[float, str, str]]:
    found: dict[str, tuple[float, str, str]] = {}
    for chain in CHAINS:
        text, name = run, f"{chain[1]}>{chain[0]}"
        for depth in range(3 if chain[1] == "utf-8" else 1):
            out = undo(text, chain)
            if out is None:
                break
            cost = 0.3 * depth + (2.0 if len(run) < 3 and chain[1] != "utf-8" else 0.0)  # little evidence: any byte stands for some letter in these
            if out not in found or cost < found[out][0]:
                found.pop(out, None)
                found[out] = (cost, " ".join([name] * (depth + 1)), out)
            text = out
    return list(found.values())


_short_explained = lru_cache(maxsize=50_000)(_explained)


class Restorer:
    """Scores runs in their context; ``margin`` is what a restored run must be likelier by, per trigram."""

    def __init__(self, model: Model, margin: float = 2.0):
        self.model, self.margin = model, margin
        self.unseen = model.unseen
        self.rare = -13.2  # a trigram of one in half a million or rarer calls for a look at its run
        self.common = self.rare + 2.7  # runs whose trigrams are likelier on average are left alone
        self.known: dict[Run, tuple[float, str, str]] = {}

    def means(self, texts: list[str]) -> np.ndarray:
        """The mean over the trigrams of each text, of many texts looked up at once."""
        return np.concatenate([self._means(part) for part in cp.slices(texts)] or [np.zeros(0)])

    def _means(self, texts: list[str]) -> np.ndarray:
        points, starts = cp.flatten(texts)
        keys, at = trigrams(np.append(cp.lowered(points), np.array([10, 10], np.uint32)))
        owner = np.searchsorted(starts, at, "right") - 1
        inside = at + 3 < starts[owner + 1]
        keys, owner = keys[inside], owner[inside]
        n = np.bincount(owner, minlength=len(texts))
        total = np.bincount(owner, weights=self.model(keys), minlength=len(texts))
        return np.where(np.diff(starts) < 4, self.unseen, np.where(n > 0, total / np.maximum(n, 1), -9.0))

    def mean(self, text: str) -> float:
        return float(self.means([text])[0])

    def best_of(self, runs: list[Run]) -> list[tuple[float, str, str]]:
        """(gain, chain, restored) of the likeliest explanation of each run."""
        stands = self.means(["".join(r) for r in runs])
        out = [(-99.0, "", r[1]) for r in runs]
        asked = [(k, explanations(runs[k][1])) for k in np.flatnonzero(stands <= self.common).tolist()]
        asked = [(k, found) for k, found in asked if found]
        if not asked:
            return out
        size = np.array([len(found) for _, found in asked])
        first = np.cumsum(size) - size
        gains = self.means([runs[k][0] + text + runs[k][2] for k, found in asked for _, _, text in found])
        gains -= np.repeat(stands[[k for k, _ in asked]], size) + np.array([cost for _, found in asked for cost, _, _ in found])
        for (k, found), a, n in zip(asked, first.tolist(), size.tolist()):
            at = int(gains[a:a + n].argmax())
            out[k] = (float(gains[a + at]), *found[at][1:])
        return out

    def best(self, *run: str) -> tuple[float, str, str]:
        if run not in self.known:
            self.look_ahead([run])
        return self.known[run]

    def look_ahead(self, runs: list[Run]) -> None:
        """Keeps the explanations of the runs, so that they are found together."""
        new = [r for r in dict.fromkeys(runs) if r not in self.known]
        if len(self.known) + len(new) > 50_000:
            self.known = {r: self.known[r] for r in runs if r in self.known}
        for k in range(0, len(new), 500):
            self.known.update(zip(new[k:k + 500], self.best_of(new[k:k + 500])))

    def suspicious(self, texts: list[str]) -> list[list[int] | None]:
        """For each text the places of trigrams that are rare in clean records; None where there are none and no lost
        character or UTF-7 sequence either."""
        out: list[list[int] | None] = [[] if LOST in t or ("+" in t and UTF7.search(t)) else None for t in texts]
        points, starts = cp.flatten(texts)
        keys, at = trigrams(cp.lowered(np.append(points, [10, 10]).astype(np.uint32)))
        odd = at[self.model(keys) < self.rare]
        owner = np.searchsorted(starts, odd, "right") - 1
        for k, place in zip(owner.tolist(), (odd - starts[owner]).tolist()):
            if out[k] is None:
                out[k] = []
            out[k].append(place)
        return out

    def places(self, text: str, odd: list[int], pattern: re.Pattern) -> Iterator[tuple[int, int]]:
        """Where the runs of a text with rare trigrams at the places ``odd`` stand."""
        for m in pattern.finditer(text):
            s, e = m.span()
            k = bisect_left(odd, s - 2)
            if not (k == len(odd) or odd[k] >= e or (pattern is RUN and (e - s < 3 or SHORT_RUN.fullmatch(m.group())))):
                yield s, e

    def likelier(self, text: str, places: list[tuple[int, int]]) -> Iterator[tuple[int, int, float, str, str]]:
        for s, e in places:
            gain, chain, out = self.best(text[max(0, s - 2):s], text[s:e], text[e:e + 2])
            if gain > self.margin:
                yield s, e, gain, chain, out

    def utf7(self, text: str) -> Iterator[tuple[int, int, float, str, str]]:
        for m in UTF7.finditer(text) if "+" in text else ():
            try:
                out = m.group().encode().decode("utf-7")
            except UnicodeDecodeError:
                continue
            gain = self.mean(text[max(0, m.start() - 2):m.start()] + out + text[m.end():m.end() + 2]) - self.rare - 1.0
            if not out.isascii() and gain > 0:
                yield m.start(), m.end(), gain, "utf-7", out

    def runs(self, text: str, odd: list[int]) -> Iterator[tuple[int, int, float, str, str]]:
        """(start, end, gain, chain, restored) of all runs of a text with rare trigrams at the places ``odd``
        that are likelier undone: of characters beyond ASCII alone, and with single ASCII characters between; they may overlap."""
        yield from self.utf7(text)
        for pattern in (SHORT_RUN, RUN):
            places = list(self.places(text, odd, pattern))
            self.look_ahead([(text[max(0, s - 2):s], text[s:e], text[e:e + 2]) for s, e in places])
            yield from self.likelier(text, places)

    def garbled(self, texts: list[str], odds: list[list[int] | None]) -> list[bool]:
        """Whether each text has lost characters or a run that is likelier undone; of all texts together the first runs are
        looked at, then more of those that are still open, until each is settled."""
        out = [odd is not None and ((LOST in t and sum(map(t.count, "~^%&#@*<>\\|")) < 0.1 * len(t)) or next(self.utf7(t), None) is not None) for t, odd in zip(texts, odds)]
        for pattern in (SHORT_RUN, RUN):
            still = {k: places for k, (t, odd) in enumerate(zip(texts, odds)) if odd and not out[k] and (places := list(self.places(t, odd, pattern)))}
            at, to = 0, 2
            while still:
                self.look_ahead([(texts[k][max(0, s - 2):s], texts[k][s:e], texts[k][e:e + 2]) for k, places in still.items() for s, e in places[at:to]])
                for k, places in still.items():
                    out[k] = next(self.likelier(texts[k], places[at:to]), None) is not None
                still = {k: places for k, places in still.items() if not out[k] and len(places) > to}
                at, to = to, 4 * to
        return out

    def restored(self, text: str, odd: list[int]) -> tuple[str, str]:
        """The text with its garbled runs undone, and the chains that explain them; of overlapping runs the one with the
        greatest gain counts, of equal ones the longest."""
        kept: list[tuple] = []  # in the order of their places, none overlapping
        for run in sorted(self.runs(text, odd), key=lambda r: (-r[2], r[0] - r[1])):
            k = bisect_left(kept, run)
            if (k == 0 or kept[k - 1][1] <= run[0]) and (k == len(kept) or run[1] <= kept[k][0]):
                kept.insert(k, run)
        out, at, chains = [], 0, []
        for s, e, _, chain, good in kept:
            out += [text[at:s], good]
            at = e
            chains.append(chain)
        return "".join(out) + text[at:], ",".join(sorted(set(chains)))


    def restored_json(self, raw: str) -> tuple[str, str]:
        """A JSON object with its garbled string values undone, keys and other values as they are; what is no JSON object
        is undone as one text."""
        try:
            got = json.loads(raw)
        except ValueError:
            got = None
        if not isinstance(got, dict):
            return self.restored(raw, self.suspicious([raw])[0] or [])
        chains: set[str] = set()
        for key, value in got.items():
            if isinstance(value, str) and (odd := self.suspicious([value])[0]) is not None:
                got[key], own = self.restored(value, odd)
                chains |= set(filter(None, own.split(",")))
        return json.dumps(got, ensure_ascii=False), ",".join(sorted(chains))


def garble(run: Run) -> Run | None:
    """A run as a chain of encodings that its hash chooses would garble it; None where that chain has no such characters."""
    wrong, right = CHAINS[xxhash.xxh3_64_intdigest("\0".join(run)) % len(CHAINS)]
    try:
        raw = run[1].encode(right)
        return run[0], raw.decode(wrong) if wrong in READ_WIDE else "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw), run[2]
    except (UnicodeError, ValueError):
        return None


def _gains(shared):
    """(garbled, gain, n): gains in steps, of runs as they stand and of the same runs garbled on purpose."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(shared.value)
        r.common = np.inf
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.iloc[k:k + 500]
                stand, n = list(zip(part["before"], part["run"], part["after"])), part["n"].to_numpy()
                bad = [garble(x) for x in stand]
                did = np.array([x is not None for x in bad], bool)
                gains = np.array([g for g, _, _ in r.best_of(stand + [x for x in bad if x is not None])])
                steps = np.rint(gains * STEPS).astype(np.int64)
                yield pd.DataFrame({"garbled": np.repeat([False, True], [len(stand), int(did.sum())]), "gain": steps, "n": np.concatenate((n, n[did]))})

    return run


def quantile(values: np.ndarray, n: np.ndarray, q: float) -> float:
    """The quantile of sorted values that occur ``n`` times each, between neighbours in proportion."""
    upto = np.cumsum(n)
    at = q * (int(upto[-1]) - 1)
    low, high = values[np.searchsorted(upto, [int(at), min(int(at) + 1, int(upto[-1]) - 1)], "right")]
    return float(low + (high - low) * (at - int(at)))


def validate(shared, runs: DataFrame) -> float:
    """A margin between the gains that the runs of all clean records reach by chance and those of the same runs garbled on
    purpose.  Equal runs in equal contexts are judged once and count as often as they occur; gains are exact to one in ``STEPS``."""
    spread = runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.mapInPandas(_gains(shared), "garbled boolean, gain bigint, n bigint").groupBy("garbled", "gain").agg(F.sum("n").alias("n")).toPandas().sort_values("gain")
    by_chance, by_rights = (rows[rows["garbled"] == g] for g in (False, True))
    if by_chance.empty or by_rights.empty:
        return Restorer(shared.value).margin
    low, high = (quantile(x["gain"].to_numpy() / STEPS, x["n"].to_numpy(), q) for x, q in ((by_chance, 0.9995), (by_rights, 0.03)))
    return float(np.clip(low + 0.25 * max(high - low, 0), 1.5, 4.0))


def _restorer(documents: DataFrame):
    model, runs = learn(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return shared, validate(shared, runs)


def _run(shared, margin: float, restore: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(shared.value, margin)
        for b in batches:
            rows = []
            for k in range(0, len(b), 500):
                part = b.iloc[k:k + 500]
                items = [(d, f, s) for d, t, m in zip(part["doc_id"], part["text"], part["metadata_json"]) for f, s in fields_of(t, m) if not s.isascii() or "+" in s]
                if not items:
                    continue
                whole = {d: m for d, m in zip(part["doc_id"], part["metadata_json"])} if restore else {}
                texts = [s for _, _, s in items]
                odds = r.suspicious(texts)
                for (d, f, s), odd, is_garbled in zip(items, odds, r.garbled(texts, odds)):
                    if is_garbled:
                        rows.append((d, f, *(r.restored(s, odd) if f == "text" else r.restored_json(whole[d]))) if restore else (d, f, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "field", "restored", "chains"])

    return run


def garbled_fields(documents: DataFrame, restore: bool = False) -> DataFrame:
    """(doc_id, field, restored, chains) of every field that holds a garbled sequence.

    With ``restore`` the original text comes along (of metadata the JSON object with its values put right), U+FFFD where it is lost
    for good.  Null and empty fields, and fields of ASCII only, have no rows; with no clean record nothing can be
    judged but lost characters; equal fields have equal results.
    """
    return documents.select("doc_id", "text", "metadata_json").mapInPandas(_run(*_restorer(documents), restore), "doc_id bigint, field string, restored string, chains string")


QUERIES = {
    "p2_found": lambda spark, d: garbled_fields(table(spark, d, "documents")).select("doc_id", "field"),
    "p2_restored": lambda spark, d: garbled_fields(table(spark, d, "documents"), True),
}
SQL: dict[str, str] = {}
