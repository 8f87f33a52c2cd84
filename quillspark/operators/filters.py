"""Predicates over documents and chunks, built from optional parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.core import all_of, any_of

#: Fields that an equality filter may name.
EQUALITY_FIELDS = ("document_id", "document_type", "publication_status", "applicability_status", "language")
#: Topics that stand for title terms as well (fixed values).
TOPIC_TERMS = {
    "AML/CFT": ("aml", "cft", "mltf", "ml/tf", "money laundering", "terrorist financing", "customer due diligence", "remote customer onboarding", "compliance officer", "asylum seeker"),
}
#: Section paths of consultation material (fixed values): patterns in lower case.
CONSULTATION = (
    "%feedback on%consultation%",
    "%summary of responses%consultation%",
    "%public consultation%",
    "%analysis of responses%",
    "guidelines",
    "definitions",
    "%consultation%",
    "%feedback%",
)


def equalities(filters: dict[str, str | None], fields: tuple[str, ...] = EQUALITY_FIELDS) -> Column:
    """Conjunction over the filters that are given; nothing given is true."""
    return all_of([F.col(f) == filters[f] for f in fields if filters.get(f)])


def topic(name: str | None, topic_col: str = "topic", title_col: str = "title", terms: dict[str, tuple[str, ...]] | None = None) -> Column:
    if not name:
        return F.lit(True)
    wide = (terms or TOPIC_TERMS).get(name.upper())
    if wide is None:
        return F.col(topic_col) == name
    return any_of([F.upper(topic_col) == name.upper(), *(F.lower(title_col).contains(t) for t in wide)])


def not_consultation(path_col: str = "section_path", patterns: tuple[str, ...] = CONSULTATION) -> Column:
    path = F.lower(F.coalesce(F.col(path_col), F.lit("")))
    return ~any_of([path.like(p) for p in patterns])


def passed_gate(passed_col: str = "passed") -> Column:
    """A document without a report passes."""
    return F.coalesce(F.col(passed_col), F.lit(True))


def body_region(region_col: str = "document_region") -> Column:
    return F.coalesce(F.col(region_col), F.lit("body")).isin("body", "annex")
