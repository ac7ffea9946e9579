"""Questions as rows: their frames, and answers bound over the graph's relations for all questions at once.

A question joins the record groups that share the first token of one of its target terms, an equi-join that keeps hot
tokens apart by group; what it joins is then tested as text.  No question is answered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import extract, terms
from loomtext.functions.text import bound, clean_value, normalize, tokens
from loomtext.runtime import durable

STRUCTURAL = ("url", "identifier", "file_path", "date_time", "count")
ANY_TYPE = ("content_phrase", "metadata_value", "unknown")


def anchors(question: Column) -> Column:
    """Addresses, identifiers and capitalised phrases of a question that do not merely open it, in order, each once."""
    phrases = F.filter(extract.phrases(question), lambda p: ~F.regexp_extract(p, r"^[^ \t\n]+", 0).isin(*terms.ANCHOR_SKIP) & ~p.isin(*terms.ANCHOR_SKIP) & ~((F.upper(p) == p) & (F.length(p) <= 5)))
    return F.filter(F.array_distinct(F.concat(extract.urls(question), extract.identifiers(question), phrases)), lambda a: a != "")


def frame_of(questions: DataFrame) -> DataFrame:
    """Adds ``target_terms`` and ``relation_terms`` to (question_id, question): the anchors, also with their blanks as _
    and -, and the other words with their variants, without what asks, names anything or stands in an anchor."""
    q = questions.withColumn("__a", F.transform(anchors(F.col("question")), lambda a: normalize(a)))
    spelt = F.flatten(F.transform("__a", lambda a: F.when(a.contains(" "), F.array(a, F.translate(a, " ", "_"), F.translate(a, " ", "-"))).otherwise(F.array(a))))
    said = tokens(F.regexp_replace(normalize(F.col("question")), r"(?:^|[^a-z0-9_])according to (?:.+)", " "))
    kept = F.filter(said, lambda t: ~t.isin(*terms.QUESTION_WORDS, *terms.GENERIC_NOUNS) & (F.length(t) > 1) & ~F.exists(F.col("__a"), lambda a: a.contains(t)))
    varied = F.array_distinct(F.flatten(F.transform(kept, lambda t: terms.stems(t))))
    return q.withColumns({"target_terms": F.array_distinct(spelt), "relation_terms": F.filter(varied, lambda t: ~terms.scope_of(t).isin("latest", "earliest"))}).drop("__a")


def has_term(material: Column, term: Column) -> Column:
    """Whether normalised material holds a term."""
    return (term != "") & material.contains(term)


def _hits(material: Column, found: Column) -> Column:
    return F.size(F.filter(found, lambda t: has_term(material, t)))


def relation_hits(material: Column, found: Column) -> Column:
    """How many of the terms are in the material, terms that share five letters counted once."""
    return F.size(F.array_distinct(F.transform(F.filter(found, lambda t: has_term(material, t)), lambda t: F.substring(t, 1, 5))))


def match_score(full: Column, local: Column, target: Column, relation: Column) -> Column:
    """4 a target term in the full material, 3 a relation term in the local one, and 1; 0 where targets or relations are
    asked and none is there, or where without a target only one of two or more relation terms is."""
    t, r = _hits(full, target), relation_hits(local, relation)
    asked = F.size(F.array_distinct(F.transform(relation, lambda x: F.substring(x, 1, 5))))
    bad = ((F.size(target) > 0) & (t == 0)) | ((F.size(relation) > 0) & (r == 0)) | ((F.size(target) == 0) & (asked >= 2) & (r < 2))
    return F.when(bad, 0.0).otherwise(4.0 * t + 3.0 * r + 1.0)


def is_target(value: Column, target: Column) -> Column:
    """Whether a value is one of the terms, or has the same parts."""
    same = lambda m, parts: (m != "") & F.exists(target, lambda t: (t == m) | ((F.size(parts) > 0) & (terms.token_set(t) == parts)))
    return bound(normalize(value), lambda m: bound(terms.token_set(m), lambda parts: same(m, parts)))


def contains_target(value: Column, target: Column) -> Column:
    """Whether a value holds all parts of a term it is not."""
    inside = lambda t, m, parts: bound(terms.token_set(t), lambda own: (F.size(own) > 0) & (F.size(F.array_except(own, parts)) == 0)) | (t.contains(" ") & m.contains(t))
    of = lambda m, parts: (m != "") & F.exists(target, lambda t: (t != "") & (t != m) & inside(t, m, parts))
    return bound(normalize(value), lambda m: bound(terms.token_set(m), lambda parts: of(m, parts)))


def compatible(value: Column, answer_type: Column) -> Column:
    """Whether a value's surface fits an answer type."""
    def fits(kind: Column) -> Column:
        role = ~kind.isin(*STRUCTURAL) & ~normalize(value).contains("http") & (F.size(extract.identifiers(value)) == 0)
        return (kind != "unknown") & (F.when(answer_type.isin("unknown", "metadata_value"), True).when(answer_type.isin("person", "actor", "organization"), role).when(answer_type == "content_phrase", ~kind.isin("url", "file_path", "identifier"))
                                      .when(answer_type == "state", ~kind.isin(*STRUCTURAL)).otherwise(kind == answer_type))

    return bound(extract.value_type(value), fits)


_DATES = r"((?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[ T][0-9]{1,2}:[0-9]{2})?)|[0-9]{1,2}:[0-9]{2})"
_PATHS = r"([A-Za-z0-9_-]+(?:/[A-Za-z0-9_.-]+)+|[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,12})"


def compatible_values(value: Column, answer_type: Column) -> Column:
    """What of a value answers a question of a type: the addresses, identifiers, paths, times or numbers in it, or the
    cleaned value itself where it fits."""
    trimmed = lambda found: F.transform(found, lambda x: F.rtrim(x, F.lit(".,;)")))

    def of(v: Column) -> Column:
        bare = F.regexp_replace(v, extract.URL, " ")
        out = (F.when(answer_type == "url", trimmed(extract.urls(v))).when(answer_type == "identifier", trimmed(extract.identifiers(v))).when(answer_type == "file_path", trimmed(extract.all_of(bare, _PATHS)))
               .when(answer_type == "date_time", extract.all_of(v, _DATES)).when(answer_type == "count", extract.all_of(v, extract.EDGE + "([0-9]+)" + extract.EDGE)).when(compatible(v, answer_type), F.array(v)))
        return F.filter(F.array_distinct(F.coalesce(out, F.array().cast("array<string>"))), lambda x: x != "")

    return bound(clean_value(value), of)


def canonical(value: Column, answer_type: Column) -> Column:
    """The one spelling under which equal answers are counted; '' where a value does not fit."""
    parts = lambda found: F.array_join(F.array_distinct(F.filter(F.transform(found, lambda p: F.coalesce(F.get(compatible_values(p, answer_type), F.lit(0)), F.lit(""))), lambda p: p != "")), "; ")
    people = lambda found: F.array_join(F.array_distinct(F.filter(found, lambda p: compatible(p, answer_type))), "; ")
    fitting = lambda v: F.when(compatible(v, answer_type), v).otherwise("")

    def of(v: Column) -> Column:
        whole = bound(F.coalesce(terms.literal_list(v), v), fitting)
        return (F.when(answer_type == "boolean", fitting(v)).when(answer_type.isin("person", "actor", "organization") & v.contains(";"), people(terms.answer_parts(v)))
                .when(answer_type.isin("person", "actor", "organization", "state", "content_phrase", "metadata_value"), whole).otherwise(parts(terms.answer_parts(v))))

    return bound(clean_value(value), of)


def _free(v: Column, q_type: Column, target: Column, relation: Column) -> Column:
    """Whether a value is given and not merely what was asked for."""
    return (v != "") & (q_type.isin(*STRUCTURAL) | (~is_target(v, target) & ~is_target(v, relation) & (q_type.isin(*ANY_TYPE) | ~contains_target(v, target))))


def _values(q_type: Column, target: Column, relation: Column) -> Column:
    """The values of a relation row that may answer: its value, else its subject, without what was asked for."""
    pick = lambda name: F.when(_free(F.col(name), q_type, target, relation), compatible_values(F.col(name), q_type)).otherwise(F.array().cast("array<string>"))
    return bound(pick("value"), lambda v: F.when(F.size(v) > 0, v).otherwise(pick("subject")))


def _row_material() -> Column:
    return normalize(F.concat_ws(" ", "relation_type", "predicate", "subject", "value", F.coalesce("section_anchor", F.lit(""))))


def groups_for(questions: DataFrame, relations: DataFrame) -> DataFrame:
    """The relation rows of every (question, record group) that share the first token of a target term, with the group's
    material.  Groups hold the relations of one object, row, unit or section."""
    key = ("doc_id", "record_group")
    r = relations.withColumn("__m", _row_material())
    said = r.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_order", "item", "__m"))), lambda x: x["__m"]), " ").alias("group_material"))
    in_groups = said.select(*key, F.explode(F.array_distinct(tokens(F.col("group_material")))).alias("__k"))
    wanted = questions.select("question_id", F.explode("target_terms").alias("__t")).select("question_id", F.get(tokens(F.col("__t")), F.lit(0)).alias("__k")).where("__k IS NOT NULL").distinct()
    pairs = in_groups.join(wanted, "__k").select("question_id", *key).distinct()
    q = questions.select("question_id", "target_terms", "relation_terms", "answer_type")
    return pairs.join(said, list(key)).join(r, list(key)).join(q, "question_id")


def bind_record_groups(rows: DataFrame) -> DataFrame:
    """Candidates (question_id, value, score, binder, …unit) from ``groups_for``: a target term anywhere in the group and a
    relation term in the row itself; (5 + 5 a target + 6 a relation term of the row + 1.5 of the group + 4 of the value),
    times the confidence."""
    t, g, r = _hits(F.col("group_material"), F.col("target_terms")), _hits(F.col("group_material"), F.col("relation_terms")), _hits(F.col("__m"), F.col("relation_terms"))
    ok = (t > 0) & ((F.size("relation_terms") == 0) | ((g > 0) & (r > 0)))
    found = rows.where(ok).select("question_id", "doc_id", "unit_order", "item", "confidence", "relation_terms", t.alias("t"), g.alias("g"), r.alias("r"), F.explode(_values(F.col("answer_type"), F.col("target_terms"), F.col("relation_terms"))).alias("value"))
    v = _hits(normalize(F.col("value")), F.col("relation_terms"))
    score = (5.0 + 5.0 * F.col("t") + 6.0 * F.col("r") + 1.5 * F.col("g") + 4.0 * v) * F.col("confidence")
    return found.select("question_id", "value", F.round(score, 6).alias("score"), F.lit("record_group").alias("binder"), "doc_id", "unit_order", "item")


def bind_relations(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates from the same rows by the relation alone: the target in the row or its unit's text, the relation term in
    the row; the split score times the confidence."""
    u = units.select("doc_id", "unit_order", normalize(F.col("text")).alias("__u"))
    full = F.concat_ws(" ", "__m", "__u")
    found = rows.join(u, ["doc_id", "unit_order"]).withColumn("__s", match_score(full, F.col("__m"), F.col("target_terms"), F.col("relation_terms"))).where("__s > 0")
    return found.select("question_id", F.explode(_values(F.col("answer_type"), F.col("target_terms"), F.col("relation_terms"))).alias("value"), F.round(F.col("__s") * F.col("confidence"), 6).alias("score"), F.lit("relation").alias("binder"), "doc_id", "unit_order", "item")


def bind_frames(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates from the same rows read as frames: target and relation terms anywhere in the frame or its unit's text;
    each argument that was not asked for may answer."""
    u = units.select("doc_id", "unit_order", normalize(F.col("text")).alias("__u"))
    full = F.concat_ws(" ", "__m", "__u")
    f = rows.where("relation_type <> 'temporal'").join(u, ["doc_id", "unit_order"]).withColumn("__s", match_score(full, full, F.col("target_terms"), F.col("relation_terms"))).where("__s > 0")
    args = F.filter(F.array("subject", "value"), lambda v: _free(v, F.col("answer_type"), F.col("target_terms"), F.col("relation_terms")))
    values = F.array_distinct(F.flatten(F.transform(args, lambda v: compatible_values(v, F.col("answer_type")))))
    return f.select("question_id", F.explode(values).alias("value"), F.round("__s", 6).alias("score"), F.lit("frame").alias("binder"), "doc_id", "unit_order", "item")


def bind_contexts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Candidates from (doc_id, kind, carrier_surface): for questions that ask for a context, the kinds carried by what
    names their target."""
    q = questions.where(F.exists("relation_terms", lambda t: t.startswith("context")) & F.col("answer_type").isin("content_phrase", "state", "metadata_value"))
    keyed = q.select("question_id", "target_terms", F.explode("target_terms").alias("__t")).withColumn("__k", F.get(tokens(F.col("__t")), F.lit(0)))
    c = contexts.withColumn("__m", normalize(F.concat_ws(" ", "kind", "carrier_surface")))
    found = c.withColumn("__k", F.explode(F.array_distinct(tokens(F.col("__m"))))).join(keyed, "__k").where(has_term(F.col("__m"), F.col("__t"))).select("question_id", "doc_id", "kind", "__t").distinct()
    value = F.regexp_replace("kind", "^[^:]*:", "")
    return found.groupBy("question_id", "doc_id", "kind").agg(F.count("*").alias("__n")).select("question_id", value.alias("value"), (4.0 * F.col("__n") + 1.0).alias("score"), F.lit("context").alias("binder"), "doc_id", F.lit(None).cast("int").alias("unit_order"), F.lit(None).cast("int").alias("item"))


def bind_metadata(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates from (doc_id, rel_path, key, value): for questions of type metadata_value or unknown, records whose
    document is named by a target's token in its path."""
    q = questions.where("answer_type IN ('metadata_value', 'unknown')").select("question_id", "answer_type", "target_terms", "relation_terms", F.explode("target_terms").alias("__t")).withColumn("__k", F.get(tokens(F.col("__t")), F.lit(0)))
    by_path = records.select("doc_id", "rel_path").distinct().select("doc_id", F.explode(F.array_distinct(F.concat(tokens(F.col("rel_path")), F.split(F.lower("rel_path"), "[/]")))).alias("__k")).distinct()
    pairs = by_path.join(q, "__k").select("question_id", "doc_id").distinct()
    m = normalize(F.concat_ws(" ", "rel_path", "key", "value"))
    rows = records.join(pairs, "doc_id").join(questions.select("question_id", "answer_type", "target_terms", "relation_terms"), "question_id")
    rows = rows.where((F.col("answer_type") != "unknown") | (_hits(normalize(F.col("key")), F.col("relation_terms")) > 0)).withColumn("score", match_score(m, m, F.col("target_terms"), F.col("relation_terms"))).where("score > 0")
    return rows.select("question_id", "value", "score", F.lit("metadata").alias("binder"), "doc_id", F.lit(None).cast("int").alias("unit_order"), F.lit(None).cast("int").alias("item"))


def bind_times(rows: DataFrame, latest: bool = True) -> DataFrame:
    """Candidates of questions with a temporal scope: the values at the latest (earliest) time of the rows' units."""
    timed = rows.where("relation_type = 'temporal'").groupBy("question_id", "doc_id", "unit_order").agg(F.max("value").alias("__time"))
    place = F.struct("__time", F.struct(-F.col("doc_id"), -F.col("unit_order"))) if latest else F.struct("__time", F.struct("doc_id", "unit_order"))
    best = timed.groupBy("question_id").agg((F.max_by if latest else F.min_by)(F.struct("doc_id", "unit_order"), place).alias("b")).select("question_id", "b.*")
    found = rows.where("relation_type <> 'temporal'").join(best, ["question_id", "doc_id", "unit_order"])
    return found.select("question_id", F.explode(_values(F.col("answer_type"), F.col("target_terms"), F.col("relation_terms"))).alias("value"), F.round(9.0 * F.col("confidence"), 6).alias("score"), F.lit("time").alias("binder"), "doc_id", "unit_order", "item")


def choose(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, answer, score, support, binder): of each question the canonical value with the greatest summed score,
    the shorter and then the lesser of equals; relation candidates of open questions count 7 more, frame candidates 3.

    Sums are made map-side, so that a question with a third of all candidates moves one row a task and value."""
    c = candidates.join(questions.select("question_id", "answer_type"), "question_id").withColumn("answer", canonical(F.col("value"), F.col("answer_type"))).where("answer <> ''")
    more = F.when(F.col("binder") == "frame", 3.0).when((F.col("binder") == "relation") & F.col("answer_type").isin("content_phrase", "unknown"), 7.0).otherwise(0.0)
    summed = c.groupBy("question_id", "answer").agg(F.round(F.sum(F.col("score") + more), 6).alias("score"), F.count("*").alias("support"), F.min("binder").alias("binder"))
    best = F.min_by(F.struct("answer", "score", "support", "binder"), F.struct(-F.col("score"), F.length("answer"), F.col("answer"))).alias("b")
    return summed.groupBy("question_id").agg(best).select("question_id", "b.*", F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.col("b.score") / 10)).alias("confidence"))


def grounded(answers: DataFrame, candidates: DataFrame, units: DataFrame) -> DataFrame:
    """Answers whose text stands in the unit of at least one of their candidates; the others are answered 'unknown'."""
    c = candidates.select("question_id", "doc_id", "unit_order").distinct().join(units.select("doc_id", "unit_order", normalize(F.col("text")).alias("__u")), ["doc_id", "unit_order"])
    seen = c.join(answers.select("question_id", normalize(F.col("answer")).alias("__a")), "question_id").where(F.col("__u").contains(F.col("__a"))).select("question_id").distinct().withColumn("__ok", F.lit(True))
    return answers.join(seen, "question_id", "left").withColumn("answer", F.when(F.col("__ok"), F.col("answer")).otherwise("unknown")).drop("__ok")


def list_values(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, part): all distinct parts of the canonical values of each question, one a row."""
    c = candidates.join(questions.select("question_id", "answer_type"), "question_id").withColumn("__c", canonical(F.col("value"), F.col("answer_type"))).where("__c <> ''")
    return c.select("question_id", F.explode(terms.answer_parts(F.col("__c"))).alias("part")).distinct()


def counted(rows: DataFrame) -> DataFrame:
    """(question_id, n): in how many units every relation term of the question stands in what the unit's rows say."""
    spans = rows.groupBy("question_id", "doc_id", "unit_order").agg(F.array_join(F.array_sort(F.collect_set("__m")), " ").alias("__s"), F.first("relation_terms").alias("__r"), F.first("target_terms").alias("__t"))
    ok = F.exists("__t", lambda t: has_term(F.col("__s"), t)) & F.forall("__r", lambda t: has_term(F.col("__s"), t))
    return spans.where(ok).groupBy("question_id").agg(F.count("*").alias("n"))


def ambiguous(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """(question_id) of the questions whose candidates stand beside two dates or more and hold two values or more."""
    date = F.regexp_extract(F.col("text"), extract.EDGE + _DATES + extract.EDGE, 1)
    c = candidates.join(units.select("doc_id", "unit_order", "text"), ["doc_id", "unit_order"]).select("question_id", date.alias("__d"), normalize(F.col("value")).alias("__v")).where("__d <> '' AND __v <> ''").distinct()
    sides = c.groupBy("question_id").agg(F.count_distinct("__d").alias("dates"), F.count_distinct("__v").alias("values"))
    return sides.where("dates >= 2 AND values >= 2").select("question_id")


def execute(questions: DataFrame, relations: DataFrame, units: DataFrame, records: DataFrame) -> DataFrame:
    """(question_id, answer, binder) for questions with ``target_terms``, ``relation_terms``, ``answer_type``,
    ``temporal_scope`` and ``aggregation``; a question that cannot be answered has no row.

    In this order: questions of yes or no have no answer here; with a temporal scope the values at that time, where there
    are any; without one, questions whose candidates disagree over time have none; counts count the units that say all
    that is asked, else the distinct values; lists join all values; of the rest the best value counts."""
    asked = questions.where("answer_type <> 'boolean'")
    rows = durable(groups_for(asked, relations))  # every binder starts from these
    facts = durable(bind_record_groups(rows).unionByName(bind_relations(rows, units)).unionByName(bind_frames(rows, units)))
    scope = lambda s: rows.join(asked.where(F.col("temporal_scope") == s).select("question_id"), "question_id", "left_semi")
    times = bind_times(scope("latest")).unionByName(bind_times(scope("earliest"), latest=False))
    timed = choose(times, asked)
    rest = facts.join(timed.select("question_id"), "question_id", "left_anti").unionByName(bind_metadata(asked, records))
    unclear = ambiguous(facts, units).join(asked.where("temporal_scope = ''").select("question_id"), "question_id", "left_semi")
    clear = asked.join(unclear, "question_id", "left_anti").join(timed.select("question_id"), "question_id", "left_anti")
    of = lambda how: clear.where(F.col("aggregation") == how).select("question_id", "answer_type")
    within = lambda df, how: df.join(of(how).select("question_id"), "question_id", "left_semi")
    spans = within(counted(rows), "count").select("question_id", F.col("n").cast("string").alias("answer"), F.lit("count").alias("binder"))
    parts = list_values(within(rest, "list"), of("list")).groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("part")), "; ").alias("answer"))  # the answer itself
    values = list_values(within(rest, "count").join(spans.select("question_id"), "question_id", "left_anti"), of("count")).groupBy("question_id").agg(F.count("*").cast("string").alias("answer"))
    best = choose(within(rest, ""), of(""))
    pick = lambda df, name=None: df.select("question_id", "answer", F.lit(name).alias("binder") if name else "binder")
    return pick(timed, "time").unionByName(spans).unionByName(pick(values, "count")).unionByName(pick(parts, "list")).unionByName(pick(best))


def accuracy(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """(category, total, answered, correct) of (question_id, category, gold); a question without an answer is wrong."""
    a = gold.join(answers.select("question_id", "answer"), "question_id", "left")
    ok = F.coalesce(normalize(F.col("answer")) == normalize(F.col("gold")), F.lit(False))
    return a.groupBy("category").agg(F.count("*").alias("total"), F.count("answer").alias("answered"), F.count_if(ok).alias("correct"))
