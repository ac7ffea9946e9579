import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import chunking, mixing, packing


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n。", max_size=400), st.integers(1, 12), st.integers(0, 6))
def test_pieces_cover_fit_and_overlap(text, most, overlap):
    pieces = chunking.split_text(text, most, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(chunking.tokens_of(e - s) <= most for s, e, _ in pieces)
    for (s, e, _), (s2, e2, _) in zip(pieces, pieces[1:]):
        assert s < s2 <= e and e < e2
        if overlap < most:
            assert chunking.tokens_of(e - s2) == overlap


def test_cuts_at_the_highest_boundary():
    text = "One two three four.\n\nFive six seven. Eight nine ten eleven"
    assert [b for _, _, b in chunking.split_text(text, 8, 0)][0] == "paragraph"
    assert chunking.split_text("x" * 100, 5, 0)[0] == (0, 20, "character")


def test_oversized_chunks(spark):
    long = "word " * 40
    chunks = spark.createDataFrame([("c1", "d1", 0, long), ("c1", "d1", 0, long), ("c2", "d1", None, long + "tail"), ("c3", "d1", 0, "short"), ("c4", "d9", 0, long), ("c5", "d1", 0, None), ("c6", "d2", 0, long)],
                                   "chunk_id string, document_id string, char_start int, text string")
    docs = spark.createDataFrame([("d1", "s", long + "tail and " + long), ("d2", None, long)], "document_id string, source string, text string")
    limits = spark.createDataFrame([("s", 16, 4)], "source string, max_tokens int, overlap_tokens int")
    assert sorted(r.chunk_id for r in chunking.found(chunks, docs, limits).collect()) == ["c1", "c2"]
    rows = chunking.pieces(chunks, docs, limits).where("chunk_id = 'c2'").collect()
    assert min(r.char_start for r in rows) == 0  # its text stands once in its document
    assert chunking.found(chunks.limit(0), docs, limits).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_packing_takes_every_item_once(sizes):
    fixed, left = packing.reduce_by_dominance(sizes, 30)
    bins = fixed + packing.best_fit(sizes, left, 30)
    assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in b) <= 30 for b in bins)
    assert len(bins) <= 2 * -(-sum(sizes) // 30) + 1


def brute(sizes, capacity):
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                go(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1:])
        go(k + 1, bins + [sizes[k]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=7))
def test_fixed_sets_lose_nothing(sizes):
    fixed, left = packing.reduce_by_dominance(sizes, 10)
    assert len(fixed) + brute([sizes[k] for k in left], 10) == brute(sizes, 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 50)), min_size=1, max_size=40), st.integers(0, 99))
def test_pivotal_leaves_one_fraction_and_keeps_the_sum(items, seed):
    p, w = np.array([a for a, _ in items]), np.array([float(b) for _, b in items])
    out = mixing.pivotal(p, w, np.random.default_rng(seed))
    assert ((out > 0) & (out < 1)).sum() <= 1
    assert abs((out * w).sum() - (p * w).sum()) < 1e-5


def test_pivotal_keeps_expectations():
    p, w = np.array([0.2, 0.5, 0.9, 0.4]), np.array([1.0, 7.0, 3.0, 2.0])
    mean = np.mean([mixing.settle(p, w, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_draw_and_pack(spark):
    rows = [(k, "a" if k % 3 else "b", f"word {k} and more text here {'again ' * (k % 7)}", "clash") for k in range(120)] + [(500, "a", None, ""), (501, None, "no source", ""), (502, "b", "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    drawn = mixing.draw(docs, targets)
    got = {r.source: r for r in mixing.shares(drawn, targets).collect()}
    assert abs(got["a"].actual_share - 0.5) < 0.02 and got["b"].most_repeats <= 3 and got["gone"].texts == 0
    assert drawn.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixing.draw(docs.limit(0), targets).count() == 0
    limits = spark.createDataFrame([("p", 16), ("none", 0)], "pool string, capacity_tokens int")
    packed = packing.pack(docs, limits).toPandas()
    assert set(packed.pool) == {"p"} and (packed.fill <= 16).all() and set(packed.doc_id) == {*range(120), 501}
    whole = packed.groupby("doc_id").tokens.sum()
    assert (packed[packed.part == 0].set_index("doc_id").tokens.le(16)).all() and whole.min() > 0
    assert packing.pack(docs.limit(0), limits).count() == 0
    many = spark.createDataFrame([(f"p{k}", 16 + k) for k in range(5)] + [("p0", 16), ("p0", 7), (None, 9), ("none", 0)], "pool string, capacity_tokens int")
    rows = lambda block: sorted(map(tuple, packing.pack(docs, many, block=block).collect()), key=str)
    assert rows(2) == rows(1_000) and {r[0] for r in rows(2)} == {f"p{k}" for k in range(5)}
