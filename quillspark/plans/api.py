"""The request edge: validation, planning, envelopes and the size budget of answers.

Plans stay lazy DataFrames; only answers of at most ``MAX_CITATIONS`` rows are
collected here.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

BUDGET = 50_000
#: Characters and citations by response mode (fixed values).
MODES = {"brief": (600, 15), "standard": (1200, 10), "full": (5000, 5)}
MAX_CITATIONS = 50
LIMITS = {"query": 500, "document_id": 40, "paragraph_ref": 50, "section": 80, "chunk_id": 240, "version": 100, "filter": 80}
SEARCH_MODES = ("auto", "fts_only", "hybrid")
EXACT_ID = re.compile(r"^[A-Z]{2,6}/[A-Za-z-]+/\d{4}/\d+$", re.I)
ALLOWED_FILTERS = ("document_id", "document_type", "publication_status", "applicability_status", "language", "topic", "exclude_consultation_responses")
LIST_FILTERS = ("document_type", "publication_status", "applicability_status", "language", "topic")
#: Forms of references, version labels and chunk ids (fixed values).
REFERENCE = re.compile(r"[A-Za-z0-9][A-Za-z0-9 ._/-]*")
CHUNK_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9:._-]*")
CONTROL = re.compile(r"[\x00-\x1f\x7f]")


class InvalidRequest(ValueError):
    def __init__(self, where: str, what: str) -> None:
        super().__init__(f"{where}: {what}")
        self.where = where


def text_field(where: str, value: object, most: int, required: bool = True) -> str | None:
    if value is None and not required:
        return None
    if not isinstance(value, str):
        raise InvalidRequest(where, "must be a string")
    value = re.sub(r"\s+", " ", value).strip()
    if not value:
        raise InvalidRequest(where, "must not be empty")
    if len(value) > most:
        raise InvalidRequest(where, f"must have at most {most} characters")
    return value


def int_field(where: str, value: object, lo: int, hi: int, default: int | None) -> int | None:
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, int):
        raise InvalidRequest(where, "must be an integer")
    if not lo <= value <= hi:
        raise InvalidRequest(where, f"must be from {lo} to {hi}")
    return value


def filter_field(filters: object, allowed: tuple[str, ...] = ALLOWED_FILTERS) -> dict[str, object]:
    if filters is None:
        return {}
    if not isinstance(filters, dict):
        raise InvalidRequest("filters", "must be an object")
    out: dict[str, object] = {}
    for k, v in filters.items():
        if k not in allowed:
            raise InvalidRequest(f"filters.{k}", "is unknown")
        if k == "exclude_consultation_responses":
            if not isinstance(v, bool):
                raise InvalidRequest(f"filters.{k}", "must be a boolean")
            out[k] = v
            continue
        if isinstance(v, str) and CONTROL.search(v):
            raise InvalidRequest(f"filters.{k}", "has control characters")
        out[k] = text_field(f"filters.{k}", v, LIMITS["filter"])
        if k == "language" and out[k] != "en":
            raise InvalidRequest("filters.language", "must be en")
    return out


@dataclass(frozen=True)
class SearchRequest:
    query: str
    filters: dict
    limit: int
    mode: str
    max_chars: int
    max_citations: int

    @property
    def exact_id(self) -> bool:
        return bool(EXACT_ID.match(self.query))


def parse_search(raw: dict) -> SearchRequest:
    known = {"query", "filters", "limit", "response_mode", "search_mode", "max_chars", "max_citations"}
    for k in raw:
        if k not in known:
            raise InvalidRequest(k, "is unknown")
    response = raw.get("response_mode", "standard")
    if response not in MODES:
        raise InvalidRequest("response_mode", "is unknown")
    mode = raw.get("search_mode", "auto")
    if mode not in SEARCH_MODES:
        raise InvalidRequest("search_mode", "is unknown")
    chars, citations = MODES[response]
    return SearchRequest(
        text_field("query", raw.get("query"), LIMITS["query"]),
        filter_field(raw.get("filters")),
        int_field("limit", raw.get("limit"), 1, 50, 10),
        mode,
        int_field("max_chars", raw.get("max_chars"), 1, 100_000, chars),
        int_field("max_citations", raw.get("max_citations"), 1, MAX_CITATIONS, citations),
    )


def parse_paragraph(raw: dict) -> list[str]:
    """References of a paragraph request: one, or up to twenty."""
    one, many = raw.get("paragraph_ref"), raw.get("paragraph_refs")
    if one is None and not many:
        raise InvalidRequest("paragraph_ref", "give paragraph_ref or paragraph_refs")
    refs = [one] if one is not None else many
    if not isinstance(refs, list) or len(refs) > 20:
        raise InvalidRequest("paragraph_refs", "must be a list of at most 20")
    out = [text_field("paragraph_ref", r, LIMITS["paragraph_ref"]) for r in refs]
    if any(not REFERENCE.fullmatch(r) for r in out):
        raise InvalidRequest("paragraph_ref", "is malformed")
    return out


def _document_id(where: str, value: object) -> str:
    out = text_field(where, value, LIMITS["document_id"])
    if not EXACT_ID.fullmatch(out):
        raise InvalidRequest(where, "is malformed")
    return out


def _language(where: str, value: object) -> str:
    if value not in (None, "en"):
        raise InvalidRequest(where, "must be en")
    return "en"


def _shaped(most: int, shape: re.Pattern, required: bool = True):
    def check(where: str, value: object) -> str | None:
        out = text_field(where, value, most, required)
        if out is not None and not shape.fullmatch(out):
            raise InvalidRequest(where, "is malformed")
        return out

    return check


def _whole(lo: int, hi: int, default: int | None):
    return lambda where, value: int_field(where, value, lo, hi, default)


#: Fields of the requests other than search and paragraph, each with its check.
REQUESTS = {
    "document": {"document_id": _document_id, "language": _language, "max_chars": _whole(1, 100_000, None)},
    "section": {"document_id": _document_id, "section": _shaped(LIMITS["section"], REFERENCE), "language": _language, "limit": _whole(1, 300, 200), "max_chars": _whole(1, 100_000, None)},
    "outline": {"document_id": _document_id, "language": _language, "limit": _whole(1, 300, 200)},
    "list": {"filters": lambda where, value: filter_field(value, LIST_FILTERS), "limit": _whole(1, 100, 20)},
    "corpus": {},
    "status": {"document_id": _document_id},
    "versions": {"document_id": _document_id},
    "citation": {"chunk_id": _shaped(LIMITS["chunk_id"], CHUNK_ID, False), "citation_id": _shaped(LIMITS["chunk_id"], CHUNK_ID, False)},
    "difference": {"document_id": _document_id, "version_a": _shaped(LIMITS["version"], REFERENCE), "version_b": _shaped(LIMITS["version"], REFERENCE)},
}


def parse_request(kind: str, raw: dict | None) -> dict[str, object]:
    """Checked fields of a request of ``kind``, with defaults; unknown fields are refused."""
    fields, raw = REQUESTS[kind], raw or {}
    for k in raw:
        if k not in fields:
            raise InvalidRequest(k, "is unknown")
    out = {k: check(k, raw.get(k)) for k, check in fields.items()}
    if kind == "citation" and not (out["chunk_id"] or out["citation_id"]):
        raise InvalidRequest("chunk_id", "give chunk_id or citation_id")
    return out


def answerability(citations: list, filters: dict) -> str:
    if not citations:
        return "no_match"
    return "exact" if filters.get("document_id") else "partial"


def envelope(citations: list[dict], answer: str, filters: dict | None = None, warnings: list[str] | None = None, **more: object) -> dict:
    return {"answerability": answer, "filters_applied": filters or {}, "citations": citations, "warnings": warnings or [], "trace_id": str(uuid.uuid4()), **more}


def error_envelope(error: Exception) -> dict:
    return envelope([], "error", warnings=[str(error)])


def within_budget(response: dict, budget: int = BUDGET) -> dict:
    """Drops trailing citations while the answer's JSON is too long; the last one is cut."""
    size = lambda r: len(json.dumps(r, ensure_ascii=False, indent=2).encode("utf-16-le")) // 2
    kept = list(response["citations"])
    out = response | {"citations": kept}
    dropped = 0
    while len(kept) > 1 and size(out) > budget:
        kept.pop()
        dropped += 1
    if kept and size(out) > budget:
        kept[0] = kept[0] | {"text": str(kept[0].get("text", ""))[:200], "truncated": True}
    return out | ({"warnings": [*response["warnings"], f"{dropped} citations left out to keep the answer short"]} if dropped else {})
