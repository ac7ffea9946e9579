"""Which contexts may speak for a question: requirements, polarity, modality and scope over chains of contexts.

A chain is an array of (kind, holder, evidence) from a context up to its root; what a question asks of contexts are the
columns ``requirements``, ``relation_terms``, ``answer_type`` and ``negated``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.terms import matches
from loomtext.functions.text import bound, normalize


def _surface(link: Column, *parts: str) -> Column:
    return normalize(F.concat_ws(" ", *[F.coalesce(link[p], F.lit("")) for p in parts]))


def chain_material(chain: Column) -> Column:
    return normalize(F.array_join(F.transform(chain, lambda c: _surface(c, "kind", "holder", "evidence")), " "))


def satisfied(chain: Column, requirements: Column) -> Column:
    """Whether everything that is required stands in the chain; without requirements true."""
    return bound(chain_material(chain), lambda m: F.forall(requirements, lambda r: matches(m, r)))


def accessible(chain: Column, requirements: Column, relation_terms: Column, answer_type: Column, negated: Column) -> Column:
    """Whether what stands in the context may answer.

    An empty chain is open.  A polarity closes it unless the question is of yes or no, negated, or requires that
    polarity; a modality unless the question requires it or asks for it by a relation term; any other box than the
    asserted one unless it is required, or is a negated one and the question is of yes or no or negated."""
    said = lambda c, *parts: bound(_surface(c, *parts), lambda m: F.exists(requirements, lambda r: matches(m, r)))
    asked = bound(chain_material(chain), lambda m: F.exists(relation_terms, lambda t: m.contains(t)))
    free = (answer_type == "boolean") | negated

    def open_(c: Column) -> Column:
        kind = normalize(F.coalesce(c["kind"], F.lit("asserted")))
        return (F.when(kind.startswith("polarity:"), free | said(c, "kind", "holder")).when(kind.startswith("modality:"), asked | said(c, "kind", "holder"))
                .when(kind.startswith("drs:") & (kind != "drs:asserted"), said(c, "kind", "holder", "evidence") | ((kind == "drs:negated") & free)).otherwise(True))

    return (F.size(chain) <= 0) | (satisfied(chain, requirements) & F.forall(chain, open_))


def scope_accessible(relation_type: Column, subject: Column, value: Column, chain: Column, requirements: Column, relation_terms: Column, answer_type: Column, negated: Column) -> Column:
    """``accessible`` for a relation: one of a box that declares another scope than asserted counts only where all that is
    required stands in its scope; where its chain is closed only for want of a requirement, its own object may give it."""
    declared = F.when(relation_type == "drs_condition", normalize(subject)).otherwise("")
    scope = normalize(F.concat_ws(" ", declared, F.coalesce(value, F.lit("")), chain_material(chain)))
    given = bound(scope, lambda m: (F.size(requirements) > 0) & F.forall(requirements, lambda r: matches(m, r)))
    plain = F.forall(chain, lambda c: ~normalize(c["kind"]).rlike("^(?:modality:|polarity:)") & ~(normalize(c["kind"]).startswith("drs:") & (normalize(c["kind"]) != "drs:asserted")))
    own = accessible(chain, requirements, relation_terms, answer_type, negated) | (plain & given)
    return own & ((declared == "") | (declared == "asserted") | given)
