"""Ranked lexical search by Block-Max WAND over a block index of whole texts.

Two passes read the documents. The first counts documents and terms. The second builds
the index: a task's documents become shards, a term's postings in a shard blocks of
128, gaps and counts packed into bytes, each block with its greatest impact. For a
query, a shard's blocks are walked without unpacking: their first and last documents
cut the shard into stretches, over each of which the greatest impacts times the terms'
weights bound any document's score. Stretches are read from the highest bound down and
reading ends below the score of the k-th document; only blocks that reach into a
stretch that is read are unpacked. A shard's k best go on, and the k best of all
shards are the answer.

Scale: texts aren't shuffled. The lists of asked terms move to tasks that hold one
shard's (``SHARD_TOKENS`` tokens at most) for one block of queries; a frequent word has
a row a shard, so no task sees all its postings. Two numbers, documents and terms, go
through the driver.

Defined results: a null or empty text has no terms, as a document and as an item; rows
with equal ids are documents each; items that share an id are one item with the terms
of both; null ids come first among equal scores, and a null item is an item; other
columns are ignored; no documents or no items give no rows. Scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.operators import keyword_index
from quillspark.operators.search import ranked

#: Every byte that is part of a word, A-Z as a-z; all others as a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Saturation and the share of length normalization, in thousandths and hundredths.
K1_SCALED, B_PERCENT = 20, 50


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists, a long text's piece by piece."""
    text, at = raw.translate(FOLD), 0
    while len(text) - at > PIECE:
        end = text.rfind(b" ", at, at + PIECE)
        end = end if end > at else text.find(b" ", at + PIECE)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def words_of(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Of a batch with columns key and text: keys, terms of all texts, terms of each."""
    parts, lengths = [], []
    for raw in batch.column("text").cast(pa.binary()):
        n = 0
        for words in terms_of(raw.as_py() or b""):
            n += len(words)
            parts.append(pa.array(words, pa.binary()))
        lengths.append(n)
    return batch.column("key"), pa.concat_arrays(parts) if parts else pa.array([], pa.binary()), np.array(lengths, np.int64)


def text_counts(rows: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats. ``rows``: text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for b in batches:
            for raw in b.column("text").cast(pa.binary()):
                n = sum(map(len, terms_of(raw.as_py() or b"")))
                docs, terms = docs + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])

    got = rows.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(query_id, term): the distinct terms of each item."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words, lengths = words_of(b)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(ids)), lengths))), words.cast(pa.string())], names=["query_id", "term"])

    rows = items.select(F.col(item_id).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(terms, f"query_id {dict(rows.dtypes)['key']}, term string").distinct()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """An occurrence count's share of a term's weight; ``m`` grows with the document."""
    return (1_000_000_000 * tf) // (1000 * tf + K1_SCALED * m)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(query_id, rank, key, score): each item's k documents with the highest scores above 0."""
    rows = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text"))
    n_docs, n_terms = text_counts(rows)

    def size(n: np.ndarray) -> np.ndarray:
        return 100 - B_PERCENT + (B_PERCENT * n * n_docs) // max(1, n_terms)

    def words(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        keys, terms, lengths = words_of(batch)
        return keys, terms, lengths, size(lengths)

    index = materialize(keyword_index.build(rows, dict(rows.dtypes)["key"], lambda sizes: impact, words), "block-index")
    asked = item_terms(items, item_id, item_text)
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("double")
    # a term without weight adds nothing
    weights = keyword_index.term_counts(index, asked).select("term", weight.alias("weight")).where("weight > 0")
    told = materialize(asked.join(weights, "term"), "asked-terms")
    found = keyword_index.top_rows(index, told, k, impact)
    return ranked(found, [F.desc("score"), F.asc_nulls_first("key")], k).select("query_id", "rank", "key", F.col("score").cast("long").alias("score"))
