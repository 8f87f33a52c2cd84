"""A stored keyword index, and the best rows of whole tables of queries read from it.

The index is a table of posting lists by term and shard (``blocks``). A shard holds the
rows that one task read, so building it moves no text: texts are read once and
shuffled never. A corpus grows by adding the shards of its new rows. Queries move the
lists of their terms alone, a shard's lists meet a block of queries in one task, and
each returns k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.core import materialize, small_enough
from quillspark.operators import blocks

#: Tokens after which a shard is closed, rows cut into words at once, and queries that meet a shard at once.
SHARD_TOKENS, ROWS, QUERY_BLOCK, LEAST_BLOCK = 4_000_000, 500, 256, 8

#: A batch's (keys, tokens of all its rows, number of tokens of each row, size of each row).
Words = Callable[[pa.RecordBatch], tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]
#: Terms that are looked up by the statistics of files (as many as Spark gives to a scan as they are).
FEW = 10
#: What marks start with. They are listed as terms are, and no term starts so.
MARK = "@"


def listed_words(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Of a batch with columns key, words (a list, marks among them) and size."""
    words = batch.column("words")
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column("key"), words.flatten(), lengths, batch.column("size").to_numpy().astype(np.int64)


def build(rows: DataFrame, key_type: str, impact_of: Callable[[np.ndarray], blocks.Impact], words: Words = listed_words, name: str = "", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Index rows of ``rows``, to be written before they are read: shards go by the number of
    the task that writes them. ``impact_of``: the impacts of a shard whose rows have these
    sizes. ``name`` tells the shards of one build from those of others.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, held = TaskContext.get().partitionId(), 0, blocks.Counted()

        def closed():
            yield from blocks.counted_rows(f"{name}{task}-{shard}", held, impact_of(np.concatenate(held.sizes)))
            pa.default_memory_pool().release_unused()

        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            held.add(*words(b))
            if held.n_tokens >= shard_tokens:
                yield from closed()
                shard += 1
        if held.n_rows:
            yield from closed()

    return rows.mapInArrow(lists, blocks.index_columns(key_type))


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df, cf) of the terms in ``terms`` that the index has."""
    asked = terms.select("term").distinct()
    return _near(index, asked).select("term", "df", "cf").where("term <> ''").join(_sent(asked), "term").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def _near(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The index without files and row groups that a few terms can't be in; of many terms, the index."""
    some = [r["term"] for r in terms.select("term").distinct().limit(FEW + 1).collect()]
    return index.where(F.col("term").isin(*some)) if len(some) <= FEW else index


def _sent(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """Sent to all tasks if it is small by the optimizer's estimate, else left to a shuffle."""
    return F.broadcast(df) if small_enough(df.sparkSession, df, limit) else df


def top_rows(index: DataFrame, asked: DataFrame, k: int, impact: blocks.Impact, digits: int | None = None, either: bool = False, stretch_of: Callable[[np.ndarray], float] = lambda sizes: 1.0) -> DataFrame:
    """(query_id, key, score, every): the k best rows of each shard for each query.

    ``asked``: query_id, term, weight, each term of a query once. A row's score is the sum
    of weight x impact over the query's terms. With ``either``, the best rows that have
    all terms of which ``needed`` is true are given as well, scored by these, and
    ``every`` says which list a row is from. A term that starts with ``MARK`` is a filter:
    only rows with all of a query's marks are read. ``stretch_of``: by how much impacts
    may have grown since a shard with these sizes was built, 1 or more.
    """
    asked = asked if "needed" in asked.columns else asked.withColumn("needed", F.lit(True))
    asked = asked.withColumn("mark", F.startswith("term", F.lit(MARK)))
    queries, shards = asked.select("query_id").distinct().count(), index.where("term = ''").count()
    # of few shards, smaller blocks keep all cores at work
    tasks = 2 * asked.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-queries // QUERY_BLOCK), min(queries // LEAST_BLOCK, tasks // max(1, shards)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")
    total = asked.groupBy(F.col("query_id").alias("q")).agg(F.count_if(F.col("needed") & ~F.col("mark")).alias("n_needed"), F.count_if("mark").alias("n_marks"))
    # a block's queries share a row a term; written, so that its size is known
    by_term = asked.join(total, F.col("query_id").eqNullSafe(F.col("q"))).drop("q").withColumn("block", block).groupBy("block", "term").agg(F.collect_list(F.struct("query_id", "weight", "needed", "mark", "n_needed", "n_marks")).alias("asks"))
    by_term = materialize(by_term, "asked-by-term")
    lists = _near(index, asked).where("term <> ''").join(_sent(by_term), "term")
    heads = index.where("term = ''").select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")).withColumn("asks", F.lit(None).cast(dict(by_term.dtypes)["asks"]))
    columns = ["shard", "block", "term", "first", "last", "until", "most", "packed", "keys", "sizes", "asks"]
    key = dict(index.dtypes)["keys"].removeprefix("array<")[:-1]

    def read(rows: pa.Table) -> pa.Table:
        shard = blocks.Shard(rows, impact, stretch_of)
        asks = pa.concat_arrays(rows.column("asks").chunks)
        of = np.repeat(np.arange(len(asks)), pc.fill_null(pc.list_value_length(asks), 0).to_numpy(zero_copy_only=False))
        ask = asks.flatten()
        query_ids = ask.field("query_id")
        named = query_ids.dictionary_encode("encode")
        code, weight, n_needed, n_marks = named.indices.to_numpy(), *(ask.field(c).to_numpy() for c in ("weight", "n_needed", "n_marks"))
        needed, mark = (ask.field(c).to_numpy(zero_copy_only=False) for c in ("needed", "mark"))
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, bool))]
        for a, b in zip(starts, np.append(starts[1:], len(order))):
            mine = order[a:b]
            marks, mine = mine[mark[mine]], mine[~mark[mine]]
            if not len(mine) or len(marks) < n_marks[mine[0]]:
                continue
            within = shard.with_all(of[marks]) if len(marks) else None
            row, score = shard.best(of[mine], weight[mine], k, digits, within)
            out.append((np.full(len(row), mine[0]), row, score, np.zeros(len(row), bool)))
            must = mine[needed[mine]]
            if either and 0 < len(must) == n_needed[mine[0]]:
                row, score = shard.best_of_all(of[must], weight[must], k, digits, within)
                out.append((np.full(len(row), mine[0]), row, score, np.ones(len(row), bool)))
        at, row, score, every = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": query_ids.take(pa.array(at)), "key": shard.keys.take(pa.array(row)), "score": score, "every": every})

    schema = f"query_id {dict(asked.dtypes)['query_id']}, key {key}, score double, every boolean"
    return lists.select(columns).unionByName(heads.select(columns)).groupBy("shard", "block").applyInArrow(read, schema)


def strict_or_any(hits: DataFrame) -> DataFrame:
    """Of ``top_rows`` with ``either``: a query's rows with all terms if there are any, else those with any. Adds ``mode``."""
    strict = hits.groupBy("query_id").agg(F.max("every").alias("strict"))
    return hits.join(strict, "query_id").where("every = strict").withColumn("mode", F.when(F.col("strict"), "and").otherwise("or")).drop("every", "strict")


