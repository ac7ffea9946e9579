"""Missing or wrong document language labels and mixed-language texts (problem 4).

A byte convolutional network (filters of several widths over one-hot bytes, max pooling, softmax) is trained in numpy
on a bounded sample of labelled documents and applied to batched windows of fixed length.  Texts whose pieces disagree
are cut into sentence units, and the likeliest sequence of languages with few switches gives the segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import codepoints as cp
from loomtext.llm import sentences, textstats
from loomtext.llm.labels import code_of
from loomtext.runtime import durable, table

WINDOW, WIDTHS, FILTERS = 64, (2, 3, 4), 20
PLACES = WINDOW - max(WIDTHS) + 1  # where every filter is tried
PER_LANGUAGE = 250  # most documents of a language that are collected for training (all whose label names it, chosen by hash)
LEAST_DOCUMENTS = 0.0008  # a label on a smaller share of the documents is taken for an error, not a language of the corpus
STEPS, BATCH, RATE = 1_400, 128, 0.004
LONGEST = 6_000  # characters of a training document; longer ones are not chosen for training
ADDRESS = re.compile(r"https?://\S+")
FIELD = re.compile(r"[a-z_]+\s*=|[a-z_]+:\s(?=\")")  # names of fields before their values
GARBLED = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("gb18030", "latin-1"), ("euc_jp", "latin-1"), ("cp1251", "latin-1"), ("shift_jis", "cp1252")]
ROUGH = re.compile(r"[.!?।؟。！？\n](?:(?<=[.!?।؟])[\"”»“’)\]]*\s+|(?<=[。！？])[」”』）]*|(?<=\n)\n*)")


def rough(text: str) -> list[str]:
    """The pieces of a text between ends of sentences and lines, with their marks, without blank ones."""
    out, at = [], 0
    for m in ROUGH.finditer(text):
        s = m.start()
        out.append(text[at:s if text[s] == "\n" else s + 1])
        at = m.end()
    out.append(text[at:])
    return [p for p in out if p and not p.isspace()]


def plain(text: str) -> str:
    """What a text says in words: without addresses and names of fields, in small letters."""
    if "http" in text:
        text = ADDRESS.sub(" ", text)
    if "=" in text or "{" in text:
        text = FIELD.sub(" ", text)
    return text.lower()


def windows_of(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``WINDOW`` bytes that cover each piece evenly, padded with zeros, and the piece of each window."""
    rows, owner = [], []
    for k, p in enumerate(pieces):
        b = " ".join(p.split()).encode("utf-8", "replace")
        n = -(-len(b) // WINDOW)
        for j in range(n):
            at = 0 if n == 1 else j * (len(b) - WINDOW) // (n - 1)
            rows.append(b[at:at + WINDOW].ljust(WINDOW, b"\0"))
            owner.append(k)
    if not rows:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), np.array(owner)


class Net:
    def __init__(self, names: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.names = names
        self.conv = [rng.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names))).astype(np.float32)
        self.shift = np.zeros(len(names), np.float32)
        self.tables: list[tuple[int, np.ndarray]] = []  # made of the filters when first used
        self.known: dict[str, np.ndarray] = {}  # what it has said of short pieces, which often come again

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        out, where = [], []
        for w, c, b in zip(WIDTHS, self.conv, self.bias):
            a = np.take(c[0], x[:, :PLACES], axis=0)
            for k in range(1, w):
                a += np.take(c[k], x[:, k:k + PLACES], axis=0)
            best = a.argmax(axis=1)
            where.append(best)
            out.append(np.maximum(np.take_along_axis(a, best[:, None, :], 1)[:, 0] + b, 0))
        return np.concatenate(out, axis=1), where

    def pair_tables(self) -> list[tuple[int, np.ndarray]]:
        """For the bytes at the offsets 0 and 1, 2 and 3, ... of a filter: where the filters that reach so far begin, and
        what each pair of bytes adds to them."""
        out = []
        for k in range(0, max(WIDTHS), 2):
            reach = [c for w, c in zip(WIDTHS, self.conv) if w > k]
            both = [c[k][None] + (c[k + 1] if len(c) > k + 1 else np.zeros_like(c[k]))[:, None] for c in reach]
            out.append(((len(WIDTHS) - len(reach)) * FILTERS, np.concatenate(both, axis=2).reshape(1 << 16, -1)))
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """One gather for each two offsets serves the filters of all widths that reach that far."""
        self.tables = self.tables or self.pair_tables()
        bias, out = np.concatenate(self.bias), np.zeros((len(x), len(self.names)), np.float32)
        for s in range(0, len(x), 32):
            pair = x[s:s + 32].ravel().astype(np.intp)
            pair[:-1] |= pair[1:] << 8
            a = np.take(self.tables[0][1], pair, axis=0, mode="clip")
            for k, (first, t) in enumerate(self.tables[1:], 1):
                a[:-2 * k, first:] += np.take(t, pair[2 * k:], axis=0, mode="clip")
            best = a.reshape(-1, WINDOW, a.shape[1])[:, :PLACES].max(axis=1)
            z = np.maximum(best + bias, 0) @ self.dense + self.shift
            z -= z.max(axis=1, keepdims=True)
            out[s:s + 32] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, seed: int = 5) -> None:
        """Adam on cross-entropy; the gradient of a max-pooled filter reaches only the bytes at its best place."""
        self.tables, self.known = [], {}
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.names))]
        by = [b for b in by if len(b)]
        params = [*self.conv, *self.bias, self.dense, self.shift]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            at = np.array([rng.choice(by[k]) for k in rng.integers(len(by), size=BATCH)])
            xb, yb = x[at], y[at]
            h, where = self.pooled(xb)
            z = h @ self.dense + self.shift
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(BATCH), yb] -= 1
            p /= BATCH
            gh = (p @ self.dense.T) * (h > 0)
            grads_c, grads_b = [], []
            for i, w in enumerate(WIDTHS):
                g = gh[:, i * FILTERS:(i + 1) * FILTERS]
                gc = np.zeros((w, 256 * FILTERS), np.float32)
                for k in range(w):
                    code = xb[np.arange(BATCH)[:, None], where[i] + k].astype(np.int64) * FILTERS + np.arange(FILTERS)
                    gc[k] = np.bincount(code.ravel(), weights=g.ravel(), minlength=256 * FILTERS)
                grads_c.append(gc.reshape(w, 256, FILTERS))
                grads_b.append(g.sum(0))
            grads = [*grads_c, *grads_b, h.T @ p + 1e-4 * self.dense, p.sum(0)]
            rate = RATE * min(1, 3 * (1 - step / (steps + 1)))
            for q, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def training_sample(documents: DataFrame) -> pd.DataFrame:
    """At most about ``PER_LANGUAGE`` documents of each language that labels name often enough, chosen by a hash of
    doc_id.  A spelling of a label rarer than a tenth of ``LEAST_DOCUMENTS`` is passed over, so that at most some ten
    thousand spellings are looked at."""
    long_enough = documents.where(f"text IS NOT NULL AND lang IS NOT NULL AND length(text) BETWEEN 60 AND {LONGEST}")
    counted = durable(long_enough.groupBy("lang").count())
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    spellings = {r["lang"]: r["count"] for r in counted.where(F.col("count") >= LEAST_DOCUMENTS / 10 * total).collect()}
    sizes: dict[str, int] = {}
    for label, n in spellings.items():
        if code := code_of(label):
            sizes[code] = sizes.get(code, 0) + n
    kept = {c: min(1.0, PER_LANGUAGE / n) for c, n in sizes.items() if n >= max(4, LEAST_DOCUMENTS * total)}
    shares = [x for label in spellings if (c := code_of(label)) in kept for x in (F.lit(label), F.lit(kept[c]))]
    if not shares:
        return pd.DataFrame({"text": [], "code": []})
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    some = long_enough.where(at < F.coalesce(F.try_element_at(F.create_map(*shares), F.col("lang")), F.lit(0.0))).select("text", "lang").toPandas()
    return pd.DataFrame({"text": some["text"], "code": some["lang"].map(code_of)})


def train(sample: pd.DataFrame, steps: int = STEPS) -> Net | None:
    """A network for the languages of the sample, trained twice: rows that the first network sees clearly as another
    language have wrong labels and are left out of the second."""
    names = sorted(set(sample["code"]))
    if not names:
        return None
    rng = np.random.default_rng(11)
    order = rng.permutation(len(sample))
    pieces, labels, document = [], [], []
    for d, (text, code) in enumerate(zip(sample["text"].to_numpy()[order], sample["code"].to_numpy()[order])):
        for p in rough(text):
            p = plain(p)
            if _letters(p) >= 8:
                if rng.random() < 0.06:
                    enc, dec = GARBLED[rng.integers(len(GARBLED))]
                    p = p.encode(enc, "ignore").decode(dec, "ignore").lower()
                pieces.append(p)
                labels.append(names.index(code))
                document.append(d)
    x, owner = windows_of(pieces)
    y = np.array(labels)[owner]
    first = Net(names)
    first.train(x, y, steps // 3)
    said = first.log_probabilities(x)
    of = np.array(document)[owner]
    total = np.zeros((len(sample), len(names)))
    np.add.at(total, of, np.maximum(said, np.log(1e-4)))
    keep = (total.argmax(1)[of] == y) & (said[np.arange(len(y)), y] > np.log(0.02))
    net = Net(names)
    net.train(x[keep], y[keep], steps)
    return net


HEADING = re.compile(r"[^\n]{1,90}")
SWITCH = 5.0  # what a change of language costs, in logarithms of probability
KEPT, SHORT = 200_000, 300  # about how many judged pieces a task keeps, and the characters of the longest; no result depends on it
CLEAR = 3.0  # how much likelier a piece must be in another language to call for a closer look


def _letters(p: str) -> int:
    """About the letters of a piece: its length without blanks and digits."""
    return len(p) - sum(map(p.count, " 0123456789"))


def letters_of(said: list[str]) -> np.ndarray:
    """``_letters`` of each piece."""
    out = [np.zeros(0, np.int64)]
    for part in cp.slices(said):
        points, starts = cp.flatten(part)
        out.append(np.diff(starts) - 1 - cp.sums((points == 32) | ((points >= 48) & (points < 58)), starts))
    return np.concatenate(out)


def mean_logs(net: Net, said: list[str]) -> np.ndarray:
    """The mean log-probabilities of the windows of each piece; of an empty one zeros."""
    x, owner = windows_of(said)
    out = np.zeros((len(said), len(net.names)), np.float32)
    np.add.at(out, owner, net.log_probabilities(x))
    return out / np.maximum(np.bincount(owner, minlength=len(said)), 1)[:, None]


def score_pieces(net: Net, said: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each piece of plain text the mean log-probabilities of its windows, and a weight that grows with its length; pieces with
    hardly any letters weigh nothing.  Equal pieces are judged once."""
    count = letters_of(said)
    place = {p: k for k, p in enumerate(dict.fromkeys([p if n >= 4 else "" for p, n in zip(said, count.tolist())]))}
    logs = np.zeros((len(place), len(net.names)))
    new = []
    for p, k in place.items():
        if p in net.known:
            logs[k] = net.known[p]
        else:
            new.append(p)
    if new:
        own = mean_logs(net, new)
        logs[[place[p] for p in new]] = own
        if len(net.known) > KEPT:
            net.known.clear()
        net.known.update((p, row) for p, row in zip(new, own) if len(p) <= SHORT)
    return logs[[place[p if n >= 4 else ""] for p, n in zip(said, count.tolist())]] if said else logs, np.where(count >= 4, np.minimum(count / 20, 3.0), 0)


def _table_line(line: str) -> bool:
    return line.count("\t") >= 2 or line.count(";") >= 2 or line.count("|") >= 2 or line.count("   ") >= 2 or len(re.findall(r",\S", line)) >= 2


def segments(text: str, net: Net, judge: sentences.Judge) -> list[tuple[int, str, float]]:
    """(char_start, lang, confidence) of the segments of a text whose rough pieces disagree."""
    units = sentences.split_text(text, judge)
    said, role = [], []
    for k, (s, e) in enumerate(units):
        m = sentences.SPEAKER.match(text, s, e) if text[s] == "[" else None
        t = text[m.end() if m else s:e]
        lines = t.split("\n")
        if len(lines) > 2 and _table_line(lines[0]) and _table_line(lines[1]) and not any(c.isdigit() for c in lines[0]):
            t = "\n".join(lines[1:])  # the names of the columns are not the entries' language
        alone = (k == 0 or "\n" in text[units[k - 1][1]:s]) and (k + 1 == len(units) or text[e:units[k + 1][0]].count("\n") > 1)
        header = bool(re.match(r"(?:From|To|Subject|Date|Cc): ", t))
        weak = header or not t or (alone and len(lines) == 1 and len(t) < 90 and t[-1] not in ".!?…。！？।؟\"”»）)」%" and not m)
        said.append("" if header else t)
        role.append("weak" if weak else "sign" if t[:1] in "—–" else "text")
    logs, weight = score_pieces(net, [plain(t) for t in said])
    weight = np.where([r == "text" for r in role], weight, 0.0)
    gains = logs * weight[:, None]
    n, states = gains.shape
    best, back = gains[0].copy(), np.zeros((n, states), np.int64)
    for u in range(1, n):
        jump = best.max() - SWITCH
        stay = best >= jump
        back[u] = np.where(stay, np.arange(states), int(best.argmax()))
        best = np.where(stay, best, jump) + gains[u]
    path = [int(best.argmax())]
    for u in range(n - 1, 0, -1):
        path.append(int(back[u][path[-1]]))
    path = path[::-1]
    for u in range(n - 1, -1, -1):  # a heading opens what follows; other weightless units stay where they stand
        if role[u] == "weak" and u + 1 < n:
            path[u] = path[u + 1]
        elif weight[u] == 0 and u > 0 and role[u] != "weak":
            path[u] = -1
    for u in range(n):
        if path[u] < 0:
            path[u] = path[u - 1] if u else next((p for p in path if p >= 0), 0)
    out, start = [], 0
    for u in range(1, n + 1):
        if u == n or path[u] != path[start]:
            w = weight[start:u]
            conf = float(np.exp((logs[start:u, path[start]] * w).sum() / w.sum())) if w.sum() else 0.0
            out.append((units[start][0], net.names[path[start]], conf))
            start = u
    return out


def identify(texts: list[str], net: Net, judge: sentences.Judge) -> list[list[tuple[int, str, float]]]:
    """The segments of each text; texts whose pieces agree are one segment."""
    pieces, owner = [], []
    for k, t in enumerate(texts):
        lines = t.split("\n", 2)
        if len(lines) > 2 and _table_line(lines[0]) and _table_line(lines[1]):
            t = t[len(lines[0]):]  # the names of the columns
        own = rough(plain(t))
        pieces += own
        owner += [k] * len(own)
    logs, weight = score_pieces(net, pieces)
    owner = np.array(owner, np.int64)
    total = np.zeros((len(texts), len(net.names)))
    np.add.at(total, owner, logs * weight[:, None])
    main = total.argmax(1)
    weights = np.bincount(owner, weights=weight, minlength=len(texts))
    against = (logs.max(1) - logs[np.arange(len(logs)), main[owner]]) * np.minimum(weight, 1)
    mixed = np.zeros(len(texts), bool)
    np.logical_or.at(mixed, owner, against > CLEAR)
    out = []
    for k, t in enumerate(texts):
        if mixed[k]:
            out.append(segments(t, net, judge))
        else:
            first = len(t) - len(t.lstrip())
            out.append([(first, net.names[main[k]], float(np.exp(total[k, main[k]] / weights[k])) if weights[k] else 0.0)])
    return out


def _identify(shared, cases_only: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, counts = shared.value
        judge = sentences.Judge(counts.value)
        for b in batches:
            for s in range(0, len(b), 500):
                part = b.iloc[s:s + 500]
                texts, labels = part["text"].tolist(), [code_of(x) for x in part["lang"]]
                found = identify(texts, net, judge)
                rows = [(d, t, f) for d, t, f, lab in zip(part["doc_id"], texts, found, labels) if not cases_only or len(f) > 1 or f[0][1] != lab]
                if not rows:
                    continue
                yield pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "found": [[{"char_start": a, "lang": l, "confidence": c} for a, l, c in r[2]] for r in rows]})

    return run


def with_segments(documents: DataFrame, cases_only: bool) -> DataFrame:
    """(doc_id, char_start, lang, confidence): one row per language segment.

    With ``cases_only`` only documents whose label is missing, names no language or another one than the text's, and
    mixed ones.  Null, empty and blank texts and junk have no rows; with no usable label in the whole table nothing can
    be learned and the result is empty; equal texts with equal labels have equal rows; other columns are not read.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, char_start int, lang string, confidence double"
    net = train(training_sample(documents))
    if net is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((net, sentences.learn(documents)))
    texts = documents.where(r"text IS NOT NULL AND text RLIKE '\\S'").select("doc_id", "text", "lang")
    found = texts.mapInPandas(_identify(shared, cases_only), "doc_id bigint, text string, found array<struct<char_start: int, lang: string, confidence: double>>")
    rules = textstats.learn_rules(documents)
    kept = textstats.with_stats(found, "found").where(F.expr(textstats.case_of(rules)) != "junk")
    return kept.select("doc_id", F.inline("found"))


QUERIES = {
    "p4_found": lambda spark, d: with_segments(table(spark, d, "documents"), True).select("doc_id", "char_start", "lang"),
    "p4_segments": lambda spark, d: with_segments(table(spark, d, "documents"), False),
}
SQL: dict[str, str] = {}
