"""Filter interaction audit: what each filter removes under every order of filters.

``document_facts`` reads each text once and tells which filters it fails;
``audit_orders`` counts, for every part of the corpus, order and step, the rows that
the step removes. A row's fate under all 120 orders of five filters is one row of a
table that is computed once: 32 sets of failed filters by 120 orders, the cell being
the step of the first failure. A task indexes the table with its rows' sets and
counts parts, orders, steps and labels by ``np.bincount``; these partial arrays, one a
task, part and order, are summed by Spark. Whatever else is reported follows from the
sums: a filter that comes first removes all that fail it, one that comes last removes
those that fail nothing else.

Scale: texts are read once and stay where they are; a digest of 16 bytes, an id and a
byte of flags go on. The copies of a text meet only in a minimum with a combiner, and
rows are joined to the least id by (digest, id), so that a group of copies of any size
is spread over tasks. A task holds arrays of ``HELD`` parts (17 KB each) at most and
gives them on when there are more.

Defined results: a null text is empty; a null part is the part ''; a null id is no
smaller id and has no label, so its row never fails E; rows that share id and text
are one document twice, neither a copy of the other; several labels of an id count if
any of them does; other columns are ignored, whatever their names; an empty table
has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.core import materialize

FILTERS = "ABCDE"
STEPS = len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts whose arrays a task holds before it gives them on.
HELD = 256
#: Texts above so many bytes are cut into words one by one.
LONG = 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The least words, distinct words a hundred words, capitals a hundred characters, and the symbols.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def first_failures() -> np.ndarray:
    """Sets of failed filters x orders: the step, from 0, of the first failure, and ``STEPS`` for none."""
    place = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
    failed = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1 == 1
    return np.where(failed[:, None, :], place[None], STEPS).min(axis=2)


def _word_counts(raw: bytes) -> tuple[int, int]:
    """Words and distinct words."""
    if len(raw) <= LONG:
        words = raw.split()  # bytes are split at the six ASCII spaces
        return len(words), len(set(words))
    n, seen = 0, set()
    for m in WORD.finditer(raw):
        n += 1
        seen.add(m.group())
    return n, len(seen)


def failed_filters(raw: bytes, chars: int) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    n, distinct = _word_counts(raw)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (n < LEAST_WORDS)
        | (100 * distinct < DISTINCT_PERCENT * n) << 1
        | (100 * capitals > CAPITAL_PERCENT * chars) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def document_facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, digest, failed): bits A to D and a 128-bit digest of every whole text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            chars = pc.utf8_length(texts).to_pylist()
            digests, failed = [], []
            for raw, n in zip(texts.cast(pa.binary()), chars):
                raw = raw.as_py()
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
                failed.append(failed_filters(raw, n))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(digests, pa.binary()), pa.array(failed, pa.int32())], names=["doc_id", "part", "digest", "failed"])

    return rows.mapInArrow(facts, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, digest binary, failed int")


def with_copies(facts: DataFrame) -> DataFrame:
    """Adds bit E to ``failed``: a smaller id has the same text."""
    first = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return facts.join(first, ["doc_id", "digest"], "left").withColumn("failed", F.col("failed") + F.when(copy, 1 << 4).otherwise(0)).drop("is_first", "digest")


def with_labels(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds ``good`` and ``toxic``; a row without a label is neither."""

    def has(c: str):
        return F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))

    told = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    return rows.join(told, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def order_counts(rows: DataFrame) -> DataFrame:
    """(part, order_no, counts): for steps 0 to ``STEPS`` three longs each, rows removed there,
    good ones and toxic ones among them; the last step holds those that stay.

    ``rows``: part, failed, good, toxic.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, orders, shape = first_failures(), np.arange(len(ORDERS)), (len(ORDERS), STEPS + 1, 4)
        held: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            by_label = np.stack(list(held.values()))
            counts = np.stack([by_label.sum(axis=3), by_label[..., 1] + by_label[..., 3], by_label[..., 2] + by_label[..., 3]], axis=3)
            flat = pa.array(counts.reshape(-1), pa.int64())
            width, n = 3 * (STEPS + 1), len(held) * len(ORDERS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat)
            parts = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), len(ORDERS))))
            return pa.RecordBatch.from_arrays([parts, pa.array(np.tile(orders, len(held)), pa.int32()), lists], names=["part", "order_no", "counts"])

        for b in batches:
            named = b.column("part").dictionary_encode()
            code, failed, good, toxic = (named.indices.to_numpy(), *(b.column(c).to_numpy() for c in ("failed", "good", "toxic")))
            names = named.dictionary.to_pylist()
            for low in range(0, len(names), HELD):  # so many parts at a time
                here = (code >= low) & (code < low + HELD)
                some = names[low : low + HELD]
                cell = ((code[here] - low)[:, None] * len(ORDERS) + orders) * (STEPS + 1) + table[failed[here]]
                counted = np.bincount((cell * 4 + (good + 2 * toxic)[here][:, None]).ravel(), minlength=len(some) * int(np.prod(shape))).reshape(len(some), *shape)
                if held and len(held.keys() | set(some)) > HELD:
                    yield given()
                    held.clear()
                for name, array in zip(some, counted):
                    held[name] = held[name] + array if name in held else array
        if held:
            yield given()

    partial = rows.select("part", F.col("failed").cast("int"), F.col("good").cast("int"), F.col("toxic").cast("int")).mapInArrow(tally, "part string, order_no int, counts array<bigint>")
    sums = [F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(3 * (STEPS + 1))]
    return partial.groupBy("part", "order_no").agg(*sums).select("part", "order_no", F.array(*(f"c{i}" for i in range(len(sums)))).alias("counts"))


def audit_orders(rows: DataFrame) -> DataFrame:
    """One row a part, order and step. ``rows``: part, failed (bits A to E), good, toxic."""
    count = lambda step, kind: F.get("counts", F.lit(3 * step + kind))
    total = sum((count(s, 0) for s in range(1, STEPS + 1)), count(0, 0))
    gone, steps = F.lit(0), []
    for s in range(STEPS):
        gone = gone + count(s, 0)
        steps.append(F.struct(F.lit(s + 1).alias("step"), (total - gone).alias("kept"), count(s, 0).alias("removed"), count(s, 1).alias("good_lost"), count(s, 2).alias("toxic_lost")))
    name = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("order_no") + 1)
    each = order_counts(rows).select("part", name.alias("filter_order"), F.inline(F.array(*steps)))
    each = each.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    # 120 rows a part and filter
    same = Window.partitionBy("part", "filter")
    at = lambda s: F.max(F.when(F.col("step") == s, F.col("removed"))).over(same)
    return each.select("part", "filter_order", "step", "filter", "kept", "removed", (at(1) - F.col("removed")).alias("redundant"), at(STEPS).alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(same).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of filters A to E over ``docs`` by ``part``.

    A: under 50 words. B: under 65 distinct words a hundred. C: over 5 capitals a hundred
    characters. D: any of ``#$%&*|``. E: the text of a smaller id.
    """
    facts = materialize(document_facts(docs, doc_id, text, part), "audit-facts")
    return audit_orders(with_labels(with_copies(facts), labels, doc_id))
