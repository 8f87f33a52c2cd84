"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong kinds (an assignment to a secret's name, an access key id, a long hex
string) are reported wherever they stand. Weak kinds (identifiers, bare strings
that could be keys, endpoints) mean little alone; a weak candidate is reported only
if a complementary part stands within its scope, ``scope`` code points to either
side in the same text. Scopes are joined to parts by an interval join: parts fall
into all cells of the scope's width that they touch, a candidate meets the parts of
the cells that its scope touches, and a left-semi join keeps candidates with a part
in reach, so no pairs are made.

Positions are code points. A pattern's matches and the pieces between them come
from the same scan (extract all, split), so starts are running sums of lengths, taken
in runs: a text with many thousands of matches costs little more than its length.

Scale: texts are read once and never shuffled; spans go to the shared folder as
small rows, with one row for each text. Rows of a text are keyed by its id and
digest; rows that repeat are counted and given back as often.

Defined results: a null text is empty and has no spans; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.llm.arrays import bound, running_sums


@dataclass(frozen=True)
class Kind:
    name: str
    #: access, secret or endpoint.
    role: str
    #: Java regular expression; matches are leftmost and don't overlap.
    pattern: str
    strong: bool
    #: A cheap test that every text with a match passes.
    hint: str
    #: A match counts if this group (0: all of it) has so many characters.
    group: int = 0
    least: int = 1


ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"

KINDS = (
    Kind("assign", "secret", ASSIGN, True, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", group=2, least=6),
    Kind("access", "access", r"AKIA[A-Z0-9]+", True, r"AKIA[A-Z0-9]", least=20),
    Kind("hex", "secret", r"[0-9a-f]{24,}", True, r"[0-9a-f]{24}"),
    Kind("weak_id", "access", r"(?i:client_?id|access_?key_?id|account_?id|user_?name|user)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}", False, r"(?i)(?:id|user_?name|user)[\"']?\x20*[:=]"),
    Kind("weak_key", "secret", r"(?<![A-Za-z0-9/+_.-])(?=[A-Za-z/+]*[0-9])(?=[a-z0-9/+]*[A-Z])[A-Za-z0-9/+]{32,}+={0,2}+(?![A-Za-z0-9/+=_-]|\.[A-Za-z0-9/+=_-])", False, r"[A-Za-z0-9/+]{32}"),
    Kind("endpoint", "endpoint", r"(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis)://[^\x00-\x20\"'<>]+", False, "://"),
)

#: A weak part counts where a part of one of these roles is near; any kind of part serves.
COMPLEMENTS = {"access": ("secret",), "secret": ("access", "endpoint"), "endpoint": ("access", "secret")}

SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"


def spans_of(text: Column, kind: Kind, ordinal: int) -> Column:
    """Array of (kind, start, end) of the kind's matches that are long enough."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    between = F.split(text, kind.pattern, -1)

    def long(x: Column) -> Column:
        return F.length(x).cast("long")

    def placed(parts: Column) -> Column:
        ahead = running_sums(F.transform(parts, lambda x: x["b"] + x["m"]))
        spans = F.zip_with(parts, ahead, lambda x, at: F.struct(F.lit(ordinal).alias("kind"), (at + x["b"]).alias("start"), (at + x["b"] + x["m"]).alias("end"), x["c"].alias("c")))
        return F.transform(F.filter(spans, lambda s: s["c"] >= kind.least), lambda s: F.struct(s["kind"], s["start"], s["end"]))

    # the last piece follows the last match
    parts = F.arrays_zip(F.transform(whole, long).alias("m"), F.transform(counted, long).alias("c"), F.slice(F.transform(between, long), F.lit(1), F.size(whole)).alias("b"))
    found = bound(parts, placed)
    return F.when(text.rlike(kind.hint), found).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, digest, kind, start, end): all parts, and for each row of
    ``docs`` one with a null kind."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))), *(spans_of(F.col("t"), k, i) for i, k in enumerate(kinds)))
    # the digest comes before the explosion, else it would be computed for each span
    rows = t.select("doc_id", F.md5(F.encode("t", "UTF-8")).alias("digest"), found.alias("found")).select("doc_id", "digest", F.explode_outer("found").alias("s"))
    return materialize(rows.select("doc_id", "digest", "s.*"), "secret-spans")


def link(parts: DataFrame, kinds: tuple[Kind, ...] = KINDS, scope: int = 200) -> DataFrame:
    """The weak parts that have a complementary part within ``scope`` code points."""
    roles = F.element_at(F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(i), F.lit(k.role)))), F.col("kind"))
    weak = [i for i, k in enumerate(kinds) if not k.strong]
    parts = parts.where(F.col("kind").isNotNull()).withColumn("role", roles)
    near = parts.select(
        F.col("doc_id").alias("near_id"), F.col("digest").alias("near_digest"), F.col("role").alias("near_role"), F.col("start").alias("near_start"), F.col("end").alias("near_end"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("near_cell")
    )
    cells = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    candidates = parts.where(F.col("kind").isin(*weak)).withColumn("cell", F.explode(cells))
    fits = F.lit(False)
    for role, others in COMPLEMENTS.items():
        fits = fits | ((F.col("role") == role) & F.col("near_role").isin(*others))
    # spans apart by at most the scope, and not one inside the other
    reach = (F.col("near_start") <= F.col("end") + scope) & (F.col("near_end") + scope >= F.col("start")) & ((F.col("near_end") <= F.col("start")) | (F.col("near_start") >= F.col("end")))
    same = F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("digest") == F.col("near_digest")) & (F.col("cell") == F.col("near_cell"))
    return candidates.join(near, same & fits & reach, "left_semi").select("doc_id", "digest", "kind", "start", "end").distinct()


def find_secrets(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, scope: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: doc_id and ``spans``, an array of (start, kind, end) in order.

    ``kind`` is the ordinal in ``kinds``.
    """
    parts = scan(docs, kinds, doc_id, text)
    strong = [i for i, k in enumerate(kinds) if k.strong]
    own = parts.where(F.col("kind").isNull() | F.col("kind").isin(*strong))
    every = own.unionByName(link(parts, kinds, scope))
    got = every.groupBy("doc_id", "digest").agg(
        F.sum(F.when(F.col("kind").isNull(), 1).otherwise(0)).cast("int").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end")))).alias("spans"),
    )
    return got.select("doc_id", "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def spans_text(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
