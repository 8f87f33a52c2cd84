"""Mixing sources to target weights with a hypergeometric splitting tree.

Sources get exact word quotas (water-filling up to a number of epochs). Each
source's documents are put in a seeded permuted order and cut into blocks of about
``block_words`` words; a source's quota is a number of whole passes over its
blocks and a prefix of one more pass. A splitting tree over the output shards then
divides the block quotas: each node draws, from a multivariate hypergeometric
distribution, how many blocks of each source go to its left half. The leaves say
how many blocks of each source a shard gets; blocks in permuted order are dealt
out in runs of these lengths, so shards are disjoint and the counts exact. Within a
shard documents follow a local random order.

Scale: positions within a source come from a two-level prefix sum (sums of hash
buckets, then rows within a bucket), and so do the ranks of a source's blocks; a
source with a third of all rows is spread over many tasks. Only per-source totals
reach the driver, a row a source, and the tree holds one number a source and node. All draws come from seeds and
row contents, hence reruns and recomputed tasks agree.

Defined results: a null text has size 0 and is taken in the passes that reach it
(it adds no words); a null source is a source of its own that comes last;
documents repeated in full are separate rows of equal rank, kept apart; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.core import join_on, materialize

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    max_epochs: float = 2.0
    block_words: int = 4096
    shards: int = 16
    seed: int = 20240229
    #: Rows that a hash bucket of the prefix sum holds on average.
    bucket_rows: int = 20_000


def water_fill(sizes: list[float], weights: list[float], total: float, caps: list[float]) -> list[float]:
    """Shares of ``total`` by weight, none above its cap; what is cut off is shared again.

    Ends when no share is above its cap, or when all are at it.
    """
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > caps[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        left_w = left
        for i in over:
            out[i] = float(caps[i])
            left_w -= caps[i]
        left = left_w
        full = set(over)
        open_ = [i for i in open_ if i not in full]
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard, an array (shards, sources).

    Shards get equal numbers of blocks, up to one. A node over shards [lo, hi)
    holds the quotas of its subtree and draws its left half's.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = int(quotas.sum())
    ends = [total * k // shards for k in range(shards + 1)]
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
        left = _hypergeometric(rng, have, ends[mid] - ends[lo])
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _hypergeometric(rng: np.random.Generator, have: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate draw as a chain of conditional ones."""
    got, rest = np.zeros_like(have), int(have.sum())
    for i, n in enumerate(have.tolist()):
        rest -= n
        if draws <= 0:
            break
        got[i] = draws if rest == 0 else (rng.hypergeometric(n, rest, draws) if n else 0)
        draws -= int(got[i])
    return got


def sized(docs: DataFrame, cfg: MixConfig, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, source, size, rank), rank a seeded hash of the row, written to the shared folder."""
    key = F.xxhash64(F.lit(cfg.seed), F.col(doc_id).cast("string"), F.col(source), F.col(text))
    df = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("rank"),
    )
    return materialize(df, "mix-sizes")


def source_targets(sizes: DataFrame, cfg: MixConfig) -> list[tuple]:
    """(source, source_size, target) by code point, null last: one row a source."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    # Python compares strings by code point
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    n = [int(r["n"]) for r in rows]
    w = [cfg.weights[i % len(cfg.weights)] for i in range(len(rows))]
    target = water_fill(n, w, cfg.share * sum(n), [cfg.max_epochs * x for x in n])
    return [(r["source"], s, t, int(r["rows"])) for r, s, t in zip(rows, n, target, strict=True)]


def _bucket(rank: Column, rows: int, cfg: MixConfig) -> Column:
    """The top bits of a signed 64-bit hash, which keep its order: as many as ``rows`` ask for."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / cfg.bucket_rows)))
    return F.shiftright(rank, 64 - bits) if bits else F.lit(0).cast("long")


def block_ranks(blocks: DataFrame, rows: int, cfg: MixConfig) -> DataFrame:
    """Adds ``at``, the block's place from 0 in its source's permuted order of blocks.

    Buckets of a hash are counted and their counts summed, then blocks are ranked
    within their bucket, so that no task ranks a whole source.
    """
    placed = blocks.withColumn("draw", F.xxhash64(F.lit(cfg.seed), "source", "pass", "block"))
    placed = placed.withColumn("part", _bucket(F.col("draw"), rows, cfg))
    sums = placed.groupBy("source", "part").agg(F.count("*").alias("held"))
    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("held").over(up_to), F.lit(0))).drop("held")
    within = Window.partitionBy("source", "part").orderBy("draw", "pass", "block")
    both = join_on(placed.withColumn("nth", F.row_number().over(within)), sums, ["source", "part"])
    return both.select(*blocks.columns, (F.col("ahead") + F.col("nth") - 1).alias("at"))


def positions(sizes: DataFrame, rows: int, cfg: MixConfig) -> DataFrame:
    """Adds ``before``, the words of the source ahead of the row in its permuted order,
    and (bucket, nth), which with the source name the row."""
    rows_ = sizes.withColumn("bucket", _bucket(F.col("rank"), rows, cfg))
    sums = rows_.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("held").over(up_to), F.lit(0))).drop("held")
    within = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size"))
    local = rows_.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("nth", nth)
    both = join_on(local, sums, ["source", "bucket"])
    return both.select("doc_id", "source", "size", "rank", "bucket", "nth", (F.col("ahead") + F.col("inside")).alias("before"))


def mix(docs: DataFrame, cfg: MixConfig | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(draws, documents).

    ``draws``: a row for each time that the mix takes a document: doc_id, source,
    size, rank, pass, block, shard, place (its order within the shard).
    ``documents``: every document with source_size, target and taken.
    """
    cfg = cfg or MixConfig()
    spark = docs.sparkSession
    sizes = sized(docs, cfg, doc_id, text, source)
    targets = source_targets(sizes, cfg)
    schema = T.StructType(
        [
            T.StructField("source", T.StringType()),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("whole", T.IntegerType()),
            T.StructField("rest", T.DoubleType()),
        ]
    )
    plan = []
    for name, n, target, _ in targets:
        whole = int(min(target // n, cfg.max_epochs)) if n else int(cfg.max_epochs)
        plan.append((name, n, float(target), whole, float(max(0.0, target - whole * n)) if n else 0.0))
    per_source = F.broadcast(spark.createDataFrame(plan, schema))  # a row a source, as many as source_targets holds
    placed = positions(sizes, sum(t[3] for t in targets), cfg)
    placed = join_on(placed, per_source, ["source"])
    # in the last pass a row is taken if its middle lies within what is left of the quota
    extra = (F.col("before") + F.col("size") / 2.0 < F.col("rest")) & (F.col("whole") < cfg.max_epochs)
    placed = materialize(placed.withColumn("times", F.col("whole") + F.when(extra, 1).otherwise(0)), "mix-placed")
    draws = placed.where("times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn("block", F.floor(F.col("before") / cfg.block_words))
    blocks = draws.groupBy("source", "pass", "block").agg(F.count("*").alias("rows"))
    blocks = materialize(blocks, "mix-blocks")
    quota = {r["source"]: int(r["n"]) for r in blocks.groupBy("source").agg(F.count("*").alias("n")).collect()}
    names = [t[0] for t in targets]
    tree = split_tree(np.array([quota.get(x, 0) for x in names], dtype=np.int64), cfg.shards, cfg.seed)
    ends = np.cumsum(tree, axis=0)
    runs = spark.createDataFrame(
        [(x, ends[:, i].tolist()) for i, x in enumerate(names)],
        T.StructType([T.StructField("source", T.StringType()), T.StructField("ends", T.ArrayType(T.LongType()))]),
    )
    ranked = block_ranks(blocks, sum(quota.values()), cfg)
    runs = F.broadcast(runs)  # a row a source
    shard = F.size(F.filter("ends", lambda e: e <= F.col("at")))
    dealt = join_on(ranked, runs, ["source"]).select("source", "pass", "block", shard.alias("shard"))
    out = join_on(draws, dealt, ["source", "pass", "block"]).select("doc_id", "source", "size", "rank", "bucket", "nth", "pass", "block", "shard")
    out = out.withColumn("place", F.xxhash64(F.lit(cfg.seed + 1), "shard", "pass", "rank"))
    # (source, bucket, nth) names a row, repeated rows too
    got = out.groupBy("source", "bucket", "nth").agg(F.sum("size").alias("taken"), F.collect_set("shard").alias("shards"))
    documents = join_on(placed, got, ["source", "bucket", "nth"], "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce(F.array_sort("shards"), F.array().cast("array<int>")).alias("shards"),
    )
    return out, documents
