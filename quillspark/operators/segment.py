"""Order-dependent segmentation: paragraphs from pages, outlines from chunks, long chunks split.

Documents are independent; the work inside one is sequential by nature. It runs in table
functions over rows that Spark partitions by document and sorts: a function is given one
row after the other and keeps its state, not the document.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

MAX_CHUNK = 4000
#: Headings without a number (fixed values).
HEADING = re.compile(
    r"^(Title\s+[IVXLC]+|Section\s+\d+|Article\s+\d+|Annex\s+[IVXLC\d]+|Chapter\s+\d+|Contents|Executive Summary|Background and rationale|Background|Rationale|"
    r"Status of these Guidelines|Reporting requirements|Subject matter(?: and scope of application)?|Definitions|Date of application|Repeal|General considerations|Next steps|Guidelines)$",
    re.I,
)
NUMBERED = re.compile(r"^\s*(\d+(?:\.\d+)*)\.?\s+\S")
BARE_NUMBER = re.compile(r"^\s*(\d+(?:\.\d+)*)\.?\s*$")
ID_LINE = re.compile(r"^[A-Z]{2,6}/[A-Za-z]+/\d{4}/\d+$")
#: Openers of sentences rather than titles (fixed values).
SENTENCE_OPENERS = (
    "a common ", "a number ", "after ", "another ", "before ", "by way ", "competent authorities ", "credit or financial institutions ", "firms ", "in accordance ",
    "in relation ", "many ", "other ", "several ", "some ", "the factors ", "the guidelines ", "the international ", "the management ", "the original ",
    "these guidelines ", "there are ", "this document ", "this section ", "through ", "to comply ", "regarding ", "when ", "where ",
)
CONSULTATION_PHRASES = ("do you have any comments", "feedback on", "summary of responses", "public consultation", "analysis of responses", "consultation responses")
BACK_PHRASES = ("accompanying documents", "feedback table")


def paragraph_ref(line: str, bare: bool = False) -> str | None:
    """The number that a line starts with, or is; plain numbers above 999 aren't one."""
    m = (BARE_NUMBER if bare else NUMBERED).match(line)
    if not m or ("." not in m[1] and int(m[1]) > 999):
        return None
    return m[1]


def is_heading(line: str) -> bool:
    s = line.strip()
    return bool(HEADING.match(s) or (len(s) <= 90 and len(s.split()) <= 8 and re.match(r"^\d+(?:\.\d+)*\.?\s+[A-Z]", s)))


def short_heading(line: str) -> bool:
    s = line.strip()
    return 0 < len(s) <= 100 and s[-1] not in ".;," and not paragraph_ref(s) and not paragraph_ref(s, bare=True) and any(c.isalpha() for c in s)


def region_mark(line: str) -> str | None:
    low = line.lower()
    if re.match(r"^annex\s+[ivxlcdm\d]+\b", low):
        return "annex"
    if any(x in low for x in ("feedback on the public consultation", "summary of responses", "consultation response")):
        return "consultation_feedback"
    return "back_matter" if low in ("repeal", "final provisions") or low.startswith("repeal ") else None


def kind_of(line: str, region: str, heading: bool = False) -> str:
    if re.match(r"^(Table|Figure)\s+\d+\b", line, re.I) or " | " in line:
        return "table"
    if re.match(r"^\d+\s+[A-Z]{2,6}/[A-Za-z]+/\d{4}/\d+\b", line):
        return "footnote"
    if region != "body":
        return "consultation_response" if region == "consultation_feedback" else region
    return "heading" if heading else "paragraph"


@dataclass
class Section:
    path: str = ""
    ref: str | None = None
    title: str | None = None
    level: int | None = None
    parent: str | None = None
    confidence: float = 0.0


@dataclass
class Paragraphs:
    """State over the lines of one document."""

    name: str
    language: str
    pages: int
    region: str = "front_matter"
    in_body: bool = False
    at: Section = field(default_factory=Section)
    stack: list[tuple[str, str, float]] = field(default_factory=list)
    ref: str | None = None
    held: list[str] = field(default_factory=list)
    kind: str = "paragraph"
    first_page: int = 0
    last_page: int = 0
    done: int = 0
    out: list[dict] = field(default_factory=list)

    def flush(self, region: str | None = None) -> None:
        if self.held:
            text, n, s = "\n".join(self.held), self.done, self.at
            self.done += 1
            ref = self.ref or s.ref
            shown = re.sub(r"[^A-Za-z0-9._-]", "_", ref or f"seq-{n}")[:50]
            digest = sha256(text.encode()).hexdigest()
            self.out.append(
                {
                    "chunk_id": f"{self.name}:{digest[:8]}:{self.language}:{self.kind[0]}:{shown}:p{self.first_page}:s{n}", "sequence_no": n, "text": text, "text_hash": digest[:16],
                    "chunk_type": self.kind, "document_region": region or self.region, "paragraph_ref": ref, "page_start": self.first_page, "page_end": self.last_page, "section_path": s.path,
                    "section_ref": s.ref, "section_title": s.title, "section_level": s.level, "parent_section_ref": s.parent, "metadata_confidence": min(1.0, max(0.0, s.confidence)),
                }
            )
        self.held, self.ref = [], None

    def start(self, line: str, page: int, heading: bool = False) -> None:
        self.held, self.kind, self.first_page, self.last_page = [line], kind_of(line, self.region, heading), page, page

    def open(self, ref: str | None, title: str, confidence: float) -> None:
        title = title.strip()[:160]
        if ref is None:
            self.stack, self.at = [], Section(title[:100], None, title, None, None, confidence)
            return
        parent = ref.rpartition(".")[0] or None
        if parent and all(r != parent for r, _, _ in self.stack):
            confidence = min(confidence, 0.85)
        self.stack = [x for x in self.stack if ref.startswith(x[0] + ".")] + [(ref, title, confidence)]
        self.inherit()

    def inherit(self) -> None:
        if self.stack:
            ref, title, confidence = self.stack[-1]
            self.at = Section(" > ".join(t for _, t, _ in self.stack)[:160], ref, title, ref.count(".") + 1, ref.rpartition(".")[0] or None, confidence)

    def move(self, page: int, line: str) -> None:
        """The region that a line is in; marks stick."""
        mark, low = region_mark(line), line.lower()
        if mark:
            if not (mark == "annex" and self.region == "consultation_feedback"):
                self.region = mark
            return
        if self.region in ("annex", "consultation_feedback", "back_matter"):
            return
        if (paragraph_ref(line) or is_heading(line)) and not low.startswith(("contents", "executive summary")):
            self.in_body, self.region = True, "body"
        if not self.in_body and page <= min(3, max(self.pages, 1)):
            self.region = "front_matter"
        elif page >= max(1, int(self.pages * 0.9)) and low.startswith(("repeal", "date of application")):
            self.region = "back_matter"
        elif self.in_body and self.region == "front_matter":
            self.region = "body"


#: Lines that a decision looks ahead.
AHEAD = 3


class ParagraphReader:
    """Chunks of one document, page by page; it holds an open chunk and ``AHEAD`` lines."""

    def __init__(self, name: str, language: str, pages: int, noise: set[str] = frozenset()):
        self.state, self.noise = Paragraphs(name, language, pages), noise
        self.contents, self.waiting = False, deque()

    def feed(self, page: int, text: str | None) -> Iterator[dict]:
        """Chunks that are complete with the lines of a page."""
        for line in (text or "").splitlines():
            line = re.sub(r"\s+", " ", line).strip()
            if line and line not in self.noise and not re.fullmatch(r"\d+", line):
                self.waiting.append((page, line))
                if len(self.waiting) > AHEAD:
                    yield from self._take()

    def finish(self) -> Iterator[dict]:
        while self.waiting:
            yield from self._take()
        self.state.flush()
        yield from self._given()

    def _given(self) -> list[dict]:
        out, self.state.out = self.state.out, []
        return out

    def _take(self) -> list[dict]:
        page, line = self.waiting.popleft()
        self._read(page, line, [x for _, x in list(self.waiting)[:AHEAD]])
        return self._given()

    def _read(self, page: int, line: str, follow: list[str]) -> None:
        s = self.state
        if ID_LINE.match(line):
            return  # no text, though it counts as a line that follows
        if page == 2 and (self.contents or line.lower() == "contents"):
            if not self.contents:
                s.flush()
                s.at = Section("Contents")
                s.stack = []
                s.region, self.contents = "front_matter", True
            return
        before = s.region
        s.move(page, line)
        if s.held and s.region != before:
            s.flush(before)
        bare, ref = paragraph_ref(line, bare=True), paragraph_ref(line)
        if bare:
            s.flush()
            if len(follow) > 1 and short_heading(follow[0]) and (short_heading(follow[1]) or paragraph_ref(follow[1])):
                return  # an entry of a table of contents
            s.inherit()
            s.ref = bare
        elif ref:
            s.flush()
            opens = len(line) <= 100 and len(line.split()) <= 15
            if opens:
                s.open(ref, line, 1.0)
            else:
                s.inherit()
            s.start(line, page, heading=opens and is_heading(line))
            s.ref = ref
        elif is_heading(line):
            s.flush()
            s.open(None, line, 0.9)
        elif s.held:
            s.held.append(line)
            s.last_page = page
        else:
            s.inherit()
            s.start(line, page)


def paragraphs(name: str, language: str, pages: list[tuple[int, str]], noise: set[str] = frozenset()) -> list[dict]:
    """Chunks of one document from its (page_no, text) in order."""
    reader = ParagraphReader(name, language, max((p for p, _ in pages), default=0), noise)
    return [c for p, text in pages for c in reader.feed(p, text)] + list(reader.finish())


CHUNK_SCHEMA = (
    "chunk_id string, sequence_no int, text string, text_hash string, chunk_type string, document_region string, paragraph_ref string, page_start int, page_end int, section_path string, "
    "section_ref string, section_title string, section_level int, parent_section_ref string, metadata_confidence double"
)


CHUNK_COLUMNS = tuple(x.split()[0] for x in CHUNK_SCHEMA.split(", "))


class ParagraphTable:
    """Table function: chunks of documents from a table with document_id, language, page_no,
    text, pages (the document's greatest page number) and noise (lines to leave out), by
    document_id in the order of page_no. It holds one page and an open chunk."""

    def __init__(self):
        self.reader = None

    def eval(self, row):
        if self.reader is None:
            self.document = row["document_id"]
            self.reader = ParagraphReader(self.document, row["language"] or "", row["pages"] or 0, set(row["noise"] or ()))
        yield from self._rows(self.reader.feed(row["page_no"], row["text"]))

    def terminate(self):
        if self.reader is not None:
            yield from self._rows(self.reader.finish())

    def _rows(self, chunks):
        for c in chunks:
            yield (self.document, *(c[n] for n in CHUNK_COLUMNS))


def paragraphize(pages: DataFrame, doc: str = "document_id", noise: DataFrame | None = None) -> DataFrame:
    """Chunks of all documents from rows (doc, language, page_no, text)."""
    held = pages.select(F.col(doc).cast("string").alias("document_id"), F.coalesce("language", F.lit("")).alias("language"), F.col("page_no").cast("int").alias("page_no"), "text")
    greatest = held.groupBy(F.col("document_id").alias("d")).agg(F.max("page_no").alias("pages"))
    held = held.join(greatest, F.col("document_id").eqNullSafe(F.col("d"))).drop("d")
    if noise is None:
        held = held.withColumn("noise", F.array().cast("array<string>"))
    else:
        lines = noise.groupBy(F.col(doc).cast("string").alias("document_id")).agg(F.collect_set("line").alias("noise"))
        held = held.join(lines, "document_id", "left")
    table = F.udtf(ParagraphTable, returnType="document_id string, " + CHUNK_SCHEMA)
    return table(held.asTable().partitionBy("document_id").orderBy("page_no"))


def split_text(text: str, most: int = MAX_CHUNK) -> list[str]:
    """Pieces of at most ``most`` characters, cut before list items and blank lines
    where the piece is full, else at any line once it is half full."""
    if len(text) <= most:
        return [text]
    item = re.compile(r"^(?:\s*$|\d+\.\s|[a-z]\)\s|[ivxlcdm]+\)\s|[-–•*]\s|\(\d+\)\s|\([a-z]\)\s)")
    parts, held, size = [], [], 0
    for line in text.splitlines(keepends=True):
        if held and size + len(line) > most and (item.match(line) or size >= most // 2):
            parts.append("".join(held))
            held, size = [], 0
        held.append(line)
        size += len(line)
    parts.append("".join(held))
    out = []
    for p in (x.strip() for x in parts):
        if len(p) <= most:
            out += [p] if p else []
        elif len(parts) > 1 and "\n" in p:
            out += split_text(p, most)
        else:
            out += [x for x in (p[i : i + most].strip() for i in range(0, len(p), most)) if x]
    return out


def text_slices(batch: pa.RecordBatch, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ``rows`` rows whose texts, the last column, take ``size`` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        to = min(max(to, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def split_long(chunks: DataFrame, most: int = MAX_CHUNK, doc: str = "document_id") -> DataFrame:
    """Oversized chunks in pieces with ids :subN; sequence numbers dense from 1."""
    from quillspark.operators.corpus import resequence

    short = F.length(F.coalesce("text", F.lit(""))) <= most
    same = chunks.where(short).withColumn("sub", F.lit(0)).withColumn("many", F.lit(False))
    others = [c for c in chunks.columns if c != "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in text_slices(whole)):
            pieces = [split_text(t, most) for t in b.column(b.num_columns - 1).to_pylist()]
            sizes = np.array([len(p) for p in pieces], np.int64)
            of = pa.array(np.repeat(np.arange(len(pieces)), sizes))
            sub = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [b.column(i).take(of) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sub, pa.int32()), pa.array([x for p in pieces for x in p], pa.string()), pa.array(np.repeat(sizes > 1, sizes))], names=[*others, "sub", "text", "many"])
            del b, pieces, columns
            pa.default_memory_pool().release_unused()

    long_rows = chunks.where(~short).select(*others, "text")
    fields = [*long_rows.schema.fields[:-1], StructField("sub", IntegerType()), StructField("text", StringType()), StructField("many", BooleanType())]
    long_ = long_rows.mapInArrow(cut, StructType(fields))
    each = same.unionByName(long_)
    changed = each.withColumn("chunk_id", F.when(F.col("many"), F.concat(F.col("chunk_id"), F.lit(":sub"), F.col("sub").cast("string"))).otherwise(F.col("chunk_id")))
    if "text_hash" in chunks.columns:
        changed = changed.withColumn("text_hash", F.when(F.col("many"), F.sha2("text", 256)).otherwise(F.col("text_hash")))
    return resequence(changed, doc, [F.col("sequence_no"), F.col("sub")]).drop("sub", "many")


class OutlineFold:
    """Outline of one document, row by row in sequence order; it holds the outline alone."""

    PREFIX = re.compile(r"^(\d+(?:\.\d+)*)\.?\s")

    def __init__(self, boilerplate: tuple[str, ...] = ("guidelines", "contents", "definitions", "(unsectioned)")):
        self.boilerplate, self.found, self.active, self.reset = boilerplate, {}, [], False

    @staticmethod
    def _sentence(title: str, ref: str) -> bool:
        rest = title[len(ref) :].lstrip(". ").lower()
        return len(rest.split()) > 16 or rest.startswith(SENTENCE_OPENERS)

    def _candidate(self, path: str, ref: str | None, line: str) -> tuple[str, str, str] | None:
        if (path.lower() in self.boilerplate or any(p in path.lower() for p in CONSULTATION_PHRASES)) and "." not in (ref or ""):
            return None
        m = self.PREFIX.match(path + " ")
        if m and m[1].count(".") < 3 and not self._sentence(path, m[1]):
            return m[1], path, "high"
        m = self.PREFIX.match(line + " ")
        if ref and "." in ref and ref.count(".") < 3 and m and m[1] == ref and not self._sentence(line, ref):
            return ref, line, "medium"
        return None

    def add(self, seq: int, path: str | None, ref: str | None, text: str | None, first: int | None, last: int | None) -> None:
        squeeze = lambda x: re.sub(r"\s+", " ", x or "").strip()
        path, line = squeeze(path) or "(unsectioned)", squeeze((text or "").split("\n", 1)[0])
        found = self.found
        if path == "Guidelines" and seq > 10 and not self.reset:
            self.found, self.active, self.reset = {}, [], True
            return
        if any(p in x.lower() for p in CONSULTATION_PHRASES + BACK_PHRASES for x in (path, line)):
            self.active = []
            return
        got = self._candidate(path, ref, line)
        if got and got[0] in found and seq - found[got[0]]["last_seq"] > 20:
            self.active = []
            return
        if got:
            level = got[0].count(".") + 1
            self.active = [*self.active[: level - 1], got[0]]
            found.setdefault(got[0], {"section_ref": got[0], "title": got[1], "level": level, "parent": got[0].rpartition(".")[0] or None, "confidence": got[2], "refs": {}, "first_seq": seq, "last_seq": seq, "page_start": first, "page_end": last, "chunk_count": 0})
        if self.active:
            x = found[self.active[-1]]
            if ref:
                x["refs"].setdefault(ref)
            x["last_seq"], x["chunk_count"] = seq, x["chunk_count"] + 1
            x["page_start"] = min((p for p in (x["page_start"], first) if p is not None), default=None)
            x["page_end"] = max((p for p in (x["page_end"], last) if p is not None), default=None)

    def sections(self) -> list[dict]:
        return [x | {"refs": list(x["refs"])} for x in sorted(self.found.values(), key=lambda x: x["first_seq"])]


def fold_outline(rows: list[tuple[int, str | None, str | None, str, int | None, int | None]], boilerplate: tuple[str, ...] = ("guidelines", "contents", "definitions", "(unsectioned)")) -> list[dict]:
    """Outline of one document from (sequence, section path, paragraph ref, text, first page, last page)."""
    fold = OutlineFold(boilerplate)
    for row in rows:
        fold.add(*row)
    return fold.sections()


OUTLINE_SCHEMA = "section_ref string, title string, level int, parent string, confidence string, refs array<string>, first_seq long, last_seq long, page_start int, page_end int, chunk_count int"
OUTLINE_COLUMNS = tuple(x.split()[0] for x in OUTLINE_SCHEMA.split(", "))


class OutlineTable:
    """Table function: outlines from a table with version_id, sequence_no, section_path,
    paragraph_ref, text, page_start and page_end, by version_id in the order of
    sequence_no. It holds the outline alone."""

    def __init__(self):
        self.fold, self.version = None, None

    def eval(self, row):
        if self.fold is None:
            self.fold, self.version = OutlineFold(), row["version_id"]
        self.fold.add(*(row[c] for c in ("sequence_no", "section_path", "paragraph_ref", "text", "page_start", "page_end")))

    def terminate(self):
        for x in self.fold.sections() if self.fold is not None else ():
            yield (self.version, *(x[c] for c in OUTLINE_COLUMNS))


def heuristic_outline(chunks: DataFrame, version: str = "version_id") -> DataFrame:
    """The folded outline of every version, from its chunks in sequence order."""
    kind = dict(chunks.dtypes)[version]
    rows = chunks.select(F.col(version).alias("version_id"), "sequence_no", "section_path", "paragraph_ref", "text", "page_start", "page_end")
    table = F.udtf(OutlineTable, returnType=f"version_id {kind}, {OUTLINE_SCHEMA}")
    return table(rows.asTable().partitionBy("version_id").orderBy("sequence_no")).withColumnRenamed("version_id", version)


def register(spark: SparkSession) -> None:
    """Names the table functions for SQL: paragraph_table and outline_table, over TABLE(...) PARTITION BY ... ORDER BY ..."""
    spark.udtf.register("paragraph_table", F.udtf(ParagraphTable, returnType="document_id string, " + CHUNK_SCHEMA))
    spark.udtf.register("outline_table", F.udtf(OutlineTable, returnType=f"version_id string, {OUTLINE_SCHEMA}"))
