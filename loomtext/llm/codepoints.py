"""Texts of an Arrow batch as one array of code points, and what numpy can say about all of them at once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, BLANK, DIGIT, SYMBOL, END, CLOSE, NEWLINE, UPPER, PARTICLE, OPEN = (1 << k for k in range(10))
SCRIPT_SHIFT = 12
SCRIPTS = ("latin", "cyrillic", "han", "kana", "devanagari", "arabic", "thai")
ENDS, CLOSERS, OPENERS = ".!?…。！？।؟", "\"”»“’'」』）)]", "\"“„«‘「『（(["
# Frequent particles of the languages written without spaces.
PARTICLES = "のはをがにと的了是在有这为记ที่การไม่และเป็นได้ให้ว่า"


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Flags of each code point of the basic plane; later planes count as the letter at index 0x4E00."""
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        f = 0
        if kind[0] in "LM":
            f |= LETTER
            name = unicodedata.name(ch, "").split(" ")[0].lower()
            k = {"latin": 0, "cyrillic": 1, "cjk": 2, "hiragana": 3, "katakana": 3, "devanagari": 4, "arabic": 5, "thai": 6}.get(name, 7)
            f |= (k + 1) << SCRIPT_SHIFT
        if kind in ("Lu", "Lt"):
            f |= UPPER
        if ch.isspace():
            f |= BLANK
        if ch in "0123456789":
            f |= DIGIT
        if ch in "#$%&*+<>@\\^~░▒▓│┤":
            f |= SYMBOL
        for chars, flag in ((ENDS, END), (CLOSERS, CLOSE), (OPENERS, OPEN), (PARTICLES, PARTICLE), ("\n", NEWLINE)):
            if ch in chars:
                f |= flag
        out[c] = f
    return out


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, a newline after each text, and the start of each text (one more entry for the end)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return points, starts


def slices(texts: list[str], most: int = 1_000_000):
    """The texts in order, in lists of about ``most`` code points, so that what numpy holds at once stays small."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def flags_of(points: np.ndarray) -> np.ndarray:
    return classes()[np.where(points < 0x10000, points, 0x4E00)]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each stretch [starts[k], starts[k+1]); all stretches hold at least one element."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def shifted(values: np.ndarray, by: int, fill=0) -> np.ndarray:
    """``values`` seen ``by`` places ahead (behind where negative)."""
    out = np.full_like(values, fill)
    if by > 0:
        out[:-by] = values[by:]
    elif by < 0:
        out[-by:] = values[:by]
    else:
        out[:] = values
    return out


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    p = np.ones(64, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, 64):
            p[k] = p[k - 1] * _MULTIPLIER
    return p


def word_spans(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate(([0], is_word.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of code points (positions beyond 64 wrap around)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inner = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    at = np.repeat(starts, lengths) + inner
    with np.errstate(over="ignore"):
        return np.add.reduceat((points[at].astype(np.uint64) + np.uint64(1)) * _powers()[inner & 63], firsts)


def word_hash(word: str) -> int:
    points = np.array([ord(c) for c in word], np.uint32)
    return int(span_hashes(points, np.array([0]), np.array([len(points)]))[0])


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """The lower-case form of each code point of the basic plane, where that is one code point."""
    return np.array([ord(l) if len(l := chr(c).lower()) == 1 else c for c in range(0x10000)], np.uint32)


def lowered(points: np.ndarray) -> np.ndarray:
    low = np.where(points < 0x10000, points, 0)
    return np.where(points < 0x10000, lower_table()[low], points)
