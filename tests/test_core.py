import re
import string

import pytest
from pyspark.sql import functions as F

from loomtext.functions import extract as X
from loomtext.functions import text as T
from loomtext.operators import binding, graph, ranking
from loomtext.operators import relations as R
from loomtext.operators.units import units
from loomtext.sources.folder import read_folder
from loomtext.streaming.ingest import stream_units

DOCS = "doc_id bigint, text string, rel_path string, line int"


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, f"p/{k}", 7) for k, t in enumerate(texts)], DOCS)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


@pytest.mark.parametrize("text", ["", None, "  A b \n C ", "É ß"])
def test_normalize_is_python_s(spark, text):
    assert one(spark, T.normalize(F.col("text")), text) == re.sub(r"\s+", " ", (text or "").strip().lower())


def test_tokens_and_values(spark):
    text = "See (http://a.b/c), x-1: 'Tom's' #9 -- e.g. U.S."
    want = [t.strip(T.TOKEN_EDGE).lower() for t in re.findall(T.WORD, text) if t.strip(T.TOKEN_EDGE)]
    assert one(spark, T.tokens(F.col("text")), text) == want
    assert one(spark, T.clean_value(F.col("text")), ' "{a  b},) ') == "a b"
    assert one(spark, T.tokens(F.col("text")), None) == []


def test_quality_counts(spark):
    text = "ab 12 §§ \x07é" + "x" * 30
    df = docs(spark, text).withColumn("k", T.tokens(F.col("text")))
    r = df.select(*[c.alias(n) for n, c in T.quality_counts(F.col("text"), F.col("k")).items()]).first()
    assert r.printable == sum(c in string.printable or c.isprintable() for c in text)
    assert r.alnum == sum(map(str.isalnum, text))
    assert r.symbols == sum(not c.isalnum() and not c.isspace() for c in text)
    assert r.long_tokens == 1 and r.non_ascii == 3


def test_units_and_windows(spark):
    df = docs(spark, "Dr. Who came. He left!\nEnd", None, "", " \n ", "word " * 300)
    got = {(r.doc_id, r.unit_order): r.text for r in units(df).collect()}
    assert [got[0, k] for k in range(3)] == ["Dr. Who came.", "He left!", "End"]
    assert {d for d, _ in got} == {0, 4}
    cut = [r.text for r in units(df.where("doc_id = 4"), 100).orderBy("unit_order").collect()]
    assert all(len(c) <= 100 for c in cut) and " ".join(cut) == ("word " * 300).strip()
    assert [len(r.text) for r in units(docs(spark, "x" * 250), 100).orderBy("unit_order").collect()] == [100, 100, 50]


def test_header_is_carried_in_order(spark):
    text = "item\tstate\tx\nnoise\na\topen\t1\nname\tplace\nb\tnorth\nc|south"
    rows = {(r.row_key, r.column): r.value for r in R.header_relations(docs(spark, text)).collect()}
    assert rows == {("a", "state"): "open", ("a", "x"): "1", ("b", "place"): "north", ("c", "place"): "south"}


def test_relations_dedupe_keeps_the_first(spark):
    got = R.dedupe(R.label_relations(docs(spark, "Owner: Ann\nowner:  ann; x: {no}\nowner: Bob"))).orderBy("line").collect()
    assert [(r.line, r.subject, r.value) for r in got] == [(0, "Owner", "Ann"), (2, "owner", "Bob")]
    assert R.dedupe(R.label_relations(docs(spark))).count() == 0


def test_objects(spark):
    got = R.object_relations(docs(spark, '{ item: "the gate", ids: {a: 1}, url: "x" } tail')).collect()
    assert {(r.subject, r.value) for r in got} >= {("item", "the gate"), ("a", "1"), ("url", "x")}
    assert len({r.record_group for r in got}) == 1


def test_latest_takes_the_first_of_equal_times(spark):
    df = spark.createDataFrame([("a", "2024-01-02", 1, "x"), ("a", "2024-01-02", 2, "y"), ("a", "2024-01-01", 3, "z"), (None, "2024", 4, "n")], "k string, t string, o int, v string")
    assert {(r.k, r.v) for r in binding.by_time(df, "k", "t", "o").collect()} == {("a", "x"), (None, "n")}
    assert {r.v for r in binding.by_time(df, "k", "t", "o", latest=False).collect()} == {"z", "n"}


def test_choose_breaks_ties_by_length_then_text(spark):
    df = spark.createDataFrame([("q", "bb", 1.0), ("q", "a", 1.0), ("q", '"b"', 1.0), ("q", "", 9.0)], "q string, value string, score double")
    assert binding.choose(df, "q").first().answer == "a"
    assert binding.list_values(df, "q").first().answer == "a; b; bb"


def test_chains_end_at_cycles(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "node string, parent string")
    got = {(r.node, r.ancestor): r.distance for r in graph.chains(df, 9).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2}


def test_search_counts_a_token_at_most_as_often_as_asked(spark):
    df = docs(spark, "Gate gate GATE", "the gate rusted", "no", None)
    got = lambda required: {r.doc_id: r.score for r in ranking.lexical_search(df, "doc_id", "gate gate rusted", required).collect()}
    assert got([]) == {0: 2.0, 1: 2.0} and got(["gate rusted"]) == {1: 6.0}  # without a required phrase a unit is out
    ranked = ranking.rank_documents(df, ["gate"], ["rusted"], [])
    assert [r.doc_id for r in ranked.collect()] == [1, 0]


def test_accessible_contexts(spark):
    df = spark.createDataFrame([(k,) for k in ("asserted", "quality:x", "reported", "dreamed")], "kind string")
    assert [r.ok for r in df.select(binding.accessible(F.col("kind"), ["reported"]).alias("ok")).collect()] == [True, True, True, False]


def test_value_types(spark):
    cases = {"": "unknown", "Yes.": "boolean", "https://a.b/c": "url", "12": "count", "2024-01-02 10:11": "date_time", "ABC-12": "identifier", "a/b.txt": "file_path", "the gate": "content_phrase"}
    for v, kind in cases.items():
        assert one(spark, X.value_type(F.col("text")), v) == kind, v


def test_folder_and_stream(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"One. Two\r\nThree")
    (tmp_path / "in" / "sub" / "b.bin").write_bytes(b"\xff\xfe")
    got = {r.rel_path: r for r in read_folder(spark, str(tmp_path / "in")).collect()}
    assert got["a.txt"].text == "One. Two\nThree" and got["a.txt"].decode_errors == "strict"
    assert got["sub/b.bin"].decode_errors == "replace"
    docs(spark, "One. Two", "Three").write.parquet(str(tmp_path / "docs"))
    schema = spark.read.parquet(str(tmp_path / "docs")).schema
    for _ in range(2):  # a restart repeats nothing
        out = stream_units(spark, str(tmp_path / "docs"), schema, str(tmp_path / "out"), str(tmp_path / "state"))
    assert out.count() == 3
