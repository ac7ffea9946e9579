"""The graph's tables, terms, contexts and questions on small texts."""

import re

import pytest
from pyspark.sql import functions as F

from loomtext.functions import extract, terms
from loomtext.functions.text import clean_value
from loomtext.operators import contexts as C
from loomtext.operators import provenance as P
from loomtext.operators import questions as Q
from loomtext.operators import ranking, retrieval
from loomtext.operators.units import placed_units

DOCS = "doc_id bigint, rel_path string, text string, mtime timestamp, ctime timestamp, kind string"
TEXTS = {
    1: 'Inspection Notes\nstatus: open\n{ item: "gate", status: "sealed", reference: "LOG-11" }\nDr. Ann Müntzig saw it. Nobody knew.',
    2: '2024-05-01 status: closed\n{"outer.key": "a b", "n": 5}\nGate | sealed | ABC-12\nwww.a-1.org and AB-12abc or file.extension',
    3: None, 4: "", 5: "   \n ", 6: 'Owner: Bob Stone\nplace: yard\n{ item: "door", status: "open", reference: "LOG-12" }\n{ item: "door", status: "open", reference: "LOG-11" }',
    7: "a" * 40_000 + " b. " * 3_000,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, f"notes/{k}.txt", t, None, None, "clash") for k, t in TEXTS.items()] + [(8, None, TEXTS[1], None, None, None)], DOCS)


@pytest.fixture(scope="module")
def units(docs):
    return placed_units(docs).cache()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_units_are_slices(units):
    rows = units.collect()
    assert all(TEXTS[1 if r.doc_id == 8 else r.doc_id][r.char_start:r.char_end] == r.text and r.text.strip() == r.text for r in rows)
    assert {r.doc_id for r in rows} == {1, 2, 6, 7, 8} and [r.text for r in rows if r.doc_id == 1][-2:] == ["Dr. Ann Müntzig saw it.", "Nobody knew."]
    assert sum(r.doc_id == 7 for r in rows) == 3_000


def test_units_of_a_text_that_holds_marks(spark):
    text = "Dr§ x. Mr.\nY! (Prof. Z) ends.\n\n\nlast"
    d = spark.createDataFrame([(1, "p", text)], "doc_id bigint, rel_path string, text string")
    assert [r.text for r in placed_units(d).orderBy("unit_order").collect()] == ["Dr§ x.", "Mr.", "Y!", "(Prof. Z) ends.", "last"]


@pytest.mark.parametrize("text, want", [("file.extension", []), ("AB-12abc", []), ("AB-12", ["AB-12"]), ("x deadbeef99 y", ["deadbeef99"]), ("a@b.org", ["a@b.org", "a@b.org".split("@")[1]]), ("ab_cdefgh1", ["ab_cdefgh1"]), ("", [])])
def test_identifiers_end_at_words(spark, text, want):
    got = one(spark, extract.identifiers(F.lit(text)))
    assert got == want


def test_labels_after_a_time(spark):
    got = one(spark, extract.label_pairs(F.lit("2024-05-01 10:00 status: open; x: 1, {a: 2}")))
    assert [(r.label, r.value) for r in got] == [("status", "open")]


def test_relations_and_groups(units):
    r = P.unit_relations(units)
    a = P.anchored(P.structure(units, r))
    rows = P.grouped_relations(r, a).orderBy(F.col("item").desc()).collect()  # the same pair may be read as a label, too
    g = {(x.doc_id, x.subject, x.value): x for x in rows}
    assert g[1, "status", "open"].section_anchor == "Inspection Notes" and g[1, "status", "open"].record_group.startswith("section_group_")
    assert g[1, "status", "sealed"].record_group == g[1, "reference", "LOG-11"].record_group and g[2, "key", "a b"].confidence == 0.84
    assert g[2, "status", "closed"].relation_type == "label_value" and g[2, "Gate", "sealed"].relation_type == "table_cell"
    assert g[6, "place", "yard"].section_anchor == "Bob Stone"  # a label heading opens the section of what follows
    again = r.groupBy("doc_id", "unit_order", "relation_type", "predicate", "subject", "value").count()
    assert again.where("count > 1").isEmpty()


def test_frames_identity_and_times(units, spark):
    r = P.unit_relations(units)
    assert P.frames(r, 1).groupBy("doc_id", "unit_order").count().where("count > 1").isEmpty()
    ids = P.self_identity(P.mention_rows(units), P.frame_arguments(P.frames(r)))
    assert ids.where("left_id = right_id").isEmpty()
    t = P.temporal_edges(r).collect()
    assert [(x.doc_id, x.temporal_value, x.state_value) for x in t] == [(2, "2024-05-01", "closed")]
    assert P.temporal_edges(r, edges=0).isEmpty()


def test_empty_tables(docs):
    none = placed_units(docs.limit(0))
    r = P.unit_relations(none)
    assert none.isEmpty() and r.isEmpty() and P.anchored(P.structure(none, r)).isEmpty() and P.carriers(docs.limit(0), none).isEmpty() and P.quality_contexts(docs.limit(0)).isEmpty()


def test_closure_goes_three_steps(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("d", "e"), ("a", "b")], "left_id string, right_id string")
    got = {(r.node, r.hops) for r in P.closure(spark.createDataFrame([("a",)], "seed string"), e).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_flatten_json(spark):
    raw = '{"a": {"b": [1, 2.50, null, true, ""]}, "c": "x"}'
    got = [(p.path, p.value) for p in one(spark, P.flatten_json(F.lit(raw)))]
    assert got == [("a.b.0", "1"), ("a.b.1", "2.50"), ("a.b.2", "null"), ("a.b.3", "true"), ("c", "x")]
    assert one(spark, P.flatten_json(F.lit("{broken"))) == [] and one(spark, P.flatten_json(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("term", ["signed", "parties", "classes", "bus", "analysis", "walking", "is", "LOG-1", ""])
def test_variants_agree_on_both_sides(spark, term):
    assert set(one(spark, terms.stems(F.lit(term.lower())))) - {""} == terms.variants(term)


def test_terms(spark):
    assert one(spark, terms.literal_list(F.lit("['a', 'b', \"c\"]"))) == "a, b, and c" and one(spark, terms.literal_list(F.lit("a, b"))) is None
    assert one(spark, terms.confidence_of(F.lit("Very High"))) == 0.95 and one(spark, terms.confidence_of(F.lit("7"))) == 1.0 and one(spark, terms.confidence_of(F.lit("?"))) == 0.65
    assert terms.temporal_scope("Most  Recent") == "latest" and terms.answer_type("Number") == "count" and terms.answer_type("?") == "unknown"
    assert terms.compound_variants("signed_at") == {"signed", "sign", "at"} and terms.compound_variants("plain") == set()
    assert one(spark, terms.answer_parts(F.lit(" a ; ;b."))) == ["a", "b"] and one(spark, terms.char_tokens(F.lit(""))) == 1


def test_frames_of_questions(spark):
    q = spark.createDataFrame([("q", "Who sealed LOG-11 at Pier Nine according to Bob?"), ("e", ""), ("n", None)], "question_id string, question string")
    got = {r.question_id: r for r in Q.frame_of(q).collect()}
    assert got["q"].target_terms == ["log-11", "pier nine", "pier_nine", "pier-nine", "bob"] and set(got["q"].relation_terms) == {"seal", "sealed"}
    assert got["e"].target_terms == [] and got["n"].relation_terms == []


@pytest.mark.parametrize("kind, answer_type, negated, required, asked, want", [
    ("asserted", "state", False, [], [], True), ("polarity:negative", "state", False, [], [], False), ("polarity:negative", "boolean", False, [], [], True), ("polarity:negative", "state", True, [], [], True),
    ("polarity:negative", "state", False, ["negative"], [], True), ("modality:planned", "state", False, [], [], False), ("modality:planned", "state", False, [], ["planned"], True), ("modality:planned", "boolean", False, [], [], False),
    ("drs:negated", "boolean", False, [], [], True), ("drs:reported", "boolean", False, [], [], False), ("drs:reported", "state", False, ["reported"], [], True), ("drs:asserted", "state", False, [], [], True), ("asserted", "state", False, ["mail"], [], False)])
def test_contexts(spark, kind, answer_type, negated, required, asked, want):
    strings = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    chain = F.array(F.struct(F.lit(kind).alias("kind"), F.lit("").alias("holder"), F.lit("").alias("evidence")))
    assert one(spark, C.accessible(chain, strings(required), strings(asked), F.lit(answer_type), F.lit(negated))) is want
    assert one(spark, C.accessible(F.filter(chain, lambda c: F.lit(False)), strings(required), strings(asked), F.lit(answer_type), F.lit(negated))) is True


def brute_answers(docs):
    """Record by record, in plain Python: the status beside each reference, most frequent first, then shorter, then lesser."""
    said = {}
    for text in docs.values():
        for ref, status in [(re.search(r'reference: "(.*?)"', x), re.search(r'status: "(.*?)"', x)) for x in re.findall(r"\{.*?\}", text or "")]:
            if ref and status:
                said.setdefault(ref[1], []).append(status[1])
    return {k: min(v, key=lambda s: (-v.count(s), len(s), s)) for k, v in said.items()}


def test_answers_agree_with_brute_force(spark, docs, units):
    r = P.unit_relations(units)
    g = P.grouped_relations(r, P.anchored(P.structure(units, r)))
    q = Q.frame_of(spark.createDataFrame([(k, f"What is the status of {k}?") for k in ("LOG-11", "LOG-12", "LOG-99")], "question_id string, question string")).withColumn("answer_type", F.lit("state"))
    rows = Q.groups_for(q, g)
    want = brute_answers(TEXTS | {8: TEXTS[1]})
    assert {x.question_id: x.answer for x in Q.choose(Q.bind_record_groups(rows), q).collect()} == want == {"LOG-11": "sealed", "LOG-12": "open"}
    batch = q.withColumns({"temporal_scope": F.lit(""), "aggregation": F.when(F.col("question_id") == "LOG-11", "count").otherwise("")})
    records = docs.select("doc_id", "rel_path", F.lit("encoding").alias("key"), F.lit("utf-8").alias("value"))
    done = {x.question_id: (x.answer, x.binder) for x in Q.execute(batch, g, units, records).collect()}
    assert done["LOG-11"] == ("3", "count") and done["LOG-12"][0] == "open" and "LOG-99" not in done
    lists = {(x.question_id, x.part) for x in Q.list_values(Q.bind_record_groups(rows), q).collect()}
    assert lists == {("LOG-11", "sealed"), ("LOG-11", "open"), ("LOG-12", "open")}
    gold = spark.createDataFrame([("LOG-11", "x", "sealed"), ("LOG-12", "x", "shut"), ("LOG-99", "y", "open")], "question_id string, category string, gold string")
    assert {tuple(x) for x in Q.accuracy(Q.choose(Q.bind_record_groups(rows), q), gold).collect()} == {("x", 2, 2, 1), ("y", 1, 0, 0)}


def test_required_phrases_filter_and_stop_words_do_not_count(spark, units):
    u = units.withColumn("key", F.concat_ws("/", "doc_id", "unit_order"))
    assert ranking.lexical_search(u, "key", "the it", []).isEmpty()
    got = ranking.lexical_search(u, "key", "Nobody knew the status", ["saw it"]).collect()
    assert {r.score for r in got} == {4.0} and len(got) == 2


def test_windows_and_neighbours(units):
    found = retrieval.all_containing(units, ["nobody", "knew"])
    w = {r.doc_id: r.window for r in retrieval.evidence_window(found, units, 1).collect()}
    assert w == {1: "Dr. Ann Müntzig saw it. Nobody knew.", 8: "Dr. Ann Müntzig saw it. Nobody knew."}
    assert retrieval.all_containing(units, []).isEmpty()


def test_values_are_typed(spark):
    kinds = {"in https://a.b/c": "url", "3 hours": "date_time", "12:30": "date_time", "AB-12": "identifier", "a/b.txt": "file_path", "yes, it is": "boolean", "17": "count", "": "unknown", "quiet": "content_phrase"}
    for v, want in kinds.items():
        assert one(spark, extract.value_type(F.lit(v))) == want, v
    assert one(spark, clean_value(F.lit(' "a" .'))) == "a"
