"""Exact top-k by inner product, by reading sorted lists without random access.

The rows are dealt to groups of bounded size. A group keeps a sorted list of
(component, row) for every dimension. A query reads the lists of its dimensions side by
side from the end where its products are greatest (a list is read from the back where
the query's component is negative) and adds up what it reads. For each row this
gives a lower bound, unread products counted as the list's least, and an upper bound,
unread products counted as the last one read. Reading stops when
all rows but a small share (one in ``READS``) have an upper bound below the k-th lower
bound; rows not met in any list are ruled out in the same way. Those left are resolved
by their whole vectors. If the lists end first, all that may still qualify are resolved.

A query first meets one group, its home. The k-th score found there is a lower bound
for all others, in which reading stops earlier.

Scale: a task holds one group (``GROUP`` rows at most) and one block of queries
(``BLOCK`` at most). Rows are shuffled once a block of queries and pass, queries once a
group. A group returns k rows a query, and these are ranked with a limit before
the shuffle. All queries meet all groups, as an exact answer of all queries has it; no
pair of rows leaves a task unless it is among a group's best.

Defined results: null vectors, vectors with null or non-finite components and rows
without an id take no part; the end of a shorter vector counts as zeros; each row of the
queries is a query, and rows with a query's id are its own; equal rows are rows each;
ties go to the smaller id; no rows or no queries give no rows; components are whole
numbers within a long, and so must scores be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.operators.search import ranked

#: Rows of a group and queries of a block at most, and the least rows that a group has.
GROUP, BLOCK, LEAST_GROUP = 65_536, 65_536, 4_096
#: Rows that are resolved rather than read on for, at least; reading steps a list; and bounds held at once.
RESOLVED, READS, CELLS = 32, 16, 1 << 22


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x; null for vectors that take no part."""
    double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(double, lambda x: F.floor(F.lit(float(scale)) * x)))


def dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of longs, zeros behind the end of shorter ones."""
    lists = pa.concat_arrays(column.chunks)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(lengths.sum()) - np.repeat(starts, lengths)] = lists.flatten().to_numpy()
    return out


class SortedLists:
    """The rows of a group, and for each dimension its components from the greatest to the least."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, d = rows.shape
        order = np.argsort(-rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, order, axis=0).astype(np.float64)
        #: Where each row is in each list.
        self.place = np.empty((n, d), np.int32)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(n, dtype=np.int32)[:, None], (n, d)), axis=0)

    def candidates(self, queries: np.ndarray, k: int, floors: np.ndarray, own: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, float]]:
        """For each query its number, the rows that may be among the k best and reach its
        floor, and the share of list entries read for it. ``own``: rows that don't count.

        All queries read on step by step together, so what has been read of the lists is
        one matrix of rows and lists, and a product of matrices adds it up for all.
        """
        n, d = self.rows.shape
        # each list twice: from the front for queries that want it high, from the back for the others
        weight = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(np.float64)
        far = np.concatenate([self.values[-1], self.values[0]]) if n else np.zeros(2 * d)
        size = np.abs(weight) @ np.tile(np.abs(self.rows).max(axis=0, initial=0), 2)
        # sums of whole numbers are exact below 2^24 and 2^53; beyond that bounds are widened
        kind, slack = (np.float32, 0 * size) if size.max(initial=0) < 1 << 23 else (np.float64, np.where(size < 2.0**52, 0, size * 2.0**-48))
        enough, step = max(RESOLVED, 2 * k, n // READS), -(-n // READS)
        left = np.arange(len(queries))
        for end in [*range(step, n, step), n]:
            last = np.concatenate([self.values[end - 1], self.values[n - end]])
            # no row has a bound below this sum: with it at the floor or above, nothing is ruled out
            if end < n and ((weight[left] * last).sum(axis=1) >= np.maximum(floors[left], -1e300)).all() and np.isfinite(floors[left]).all():
                continue
            read = np.concatenate([self.place < end, self.place >= n - end], axis=1).astype(kind)
            held = read * np.tile(self.rows, 2).astype(kind)
            waiting = []
            for a in range(0, len(left), max(1, CELLS // n)):
                some = left[a : a + max(1, CELLS // n)]
                w = weight[some].astype(kind).T
                got, bounds = held @ w, []
                for unread in (last, far):
                    each = w * unread.astype(kind)[:, None]
                    bounds.append(got + (each.sum(axis=0) - read @ each))
                upper, lower = bounds
                for i, q in enumerate(some):
                    upper[own[q], i] = lower[own[q], i] = -np.inf
                bar = np.maximum(floors[some], np.partition(lower, n - k, axis=0)[n - k] if n > k else -np.inf) - slack[some]
                fits = upper >= bar
                for i, q in enumerate(some):
                    fits[own[q], i] = False
                done = (fits.sum(axis=0) <= enough) | (end == n)
                for i in np.flatnonzero(done):
                    yield some[i], np.flatnonzero(fits[:, i]), end / n
                waiting.append(some[~done])
            left = np.concatenate(waiting)
            if not len(left):
                return


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, key, score): the k rows of ``vectors`` with the highest products, for each row of ``queries``.

    Both have columns ``key`` and ``vector``.
    """
    spark = vectors.sparkSession

    def numbered(df: DataFrame, name: str, no: str) -> DataFrame:
        rows = df.select(F.col(key).alias(name), whole_numbers(F.col(vector), scale).alias("v")).where(f"{name} IS NOT NULL AND v IS NOT NULL")
        # the number is written, so that a task that runs again finds the same
        return materialize(rows.withColumn(no, F.monotonically_increasing_id()), f"nra-{no}")

    rows, asked = numbered(vectors, "key", "row_no"), numbered(queries, "query_id", "query_no")
    many = rows.count()
    size = min(GROUP, max(LEAST_GROUP, many // (3 * spark.sparkContext.defaultParallelism)))
    groups, blocks = max(1, -(-many // size)), max(1, -(-asked.count() // BLOCK))
    kind = dict(rows.dtypes)["key"]
    schema = f"query_no long, query_id {dict(asked.dtypes)['query_id']}, key {kind}, score long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return right.select(["query_no", "query_id"]).slice(0, 0).append_column("key", left.column("key").slice(0, 0)).append_column("score", pa.chunked_array([pa.array([], pa.int64())]))
        width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (left, right))
        keys = pa.concat_arrays(left.column("key").chunks)
        lists, asks = SortedLists(dense(left.column("v"), width)), dense(right.column("v"), width)
        ranks = pc.rank(keys, tiebreaker="dense").to_numpy()
        by_key = np.argsort(ranks, kind="stable")
        # rows with a query's id, if any, by the first place of the id among sorted ones
        place = pc.index_in(pa.concat_arrays(right.column("query_id").chunks).cast(keys.type), value_set=keys).to_numpy(zero_copy_only=False)
        floors = right.column("floor").to_numpy()
        of, at, scores = ([np.array([], np.int64)] for _ in range(3))
        own = [np.array([], np.int64)] * len(asks)
        for i in np.flatnonzero(~np.isnan(place)):
            mine = ranks[int(place[i])]
            own[i] = by_key[np.searchsorted(ranks, mine, sorter=by_key) : np.searchsorted(ranks, mine, "right", sorter=by_key)]
        for i, found, _ in lists.candidates(asks, k, floors, own):
            score = lists.rows[found] @ asks[i]
            best = np.lexsort((ranks[found], -score))[:k]
            of.append(np.full(len(best), i))
            at.append(found[best])
            scores.append(score[best])
        rows_of = pa.array(np.concatenate(of))
        return pa.table({"query_no": right.column("query_no").take(rows_of), "query_id": right.column("query_id").take(rows_of), "key": keys.take(pa.array(np.concatenate(at))), "score": pa.array(np.concatenate(scores), pa.int64())})

    def best(asks: DataFrame) -> DataFrame:
        dealt = rows.select("key", "v", (F.col("row_no") % groups).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        asks = asks.withColumn("block", (F.col("query_no") % blocks).cast("int"))
        return dealt.groupBy("group", "block").cogroup(asks.groupBy("group", "block")).applyInArrow(meet, schema)

    home = (F.xxhash64("query_no") % groups + groups) % groups
    no_floor = F.lit(float("-inf"))
    first = materialize(best(asked.select("query_no", "query_id", "v", home.cast("int").alias("group"), no_floor.alias("floor"))), "nra-home")
    bars = first.groupBy("query_no").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g != home)).alias("group")
    told = asked.join(bars, "query_no", "left").select("query_no", "query_id", "v", others, F.coalesce("floor", no_floor).alias("floor"))
    found = first.unionByName(best(told)) if groups > 1 else first
    return ranked(found, [F.desc("score"), F.col("key")], k, by="query_no").select("query_id", "rank", F.col("key").alias(key), "score")
