"""Keyword, vector and hybrid search over chunks, for whole sets of queries at once.

Queries are a table; every operator returns ranked rows for all of them in one
plan. Keyword search reads a stored index alone, not the chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.core import arrow_store, fresh_path, materialize, spread
from quillspark.functions.text import RESERVED, tokens
from quillspark.operators import keyword_index

K1, B = 1.2, 0.75
#: Stands for an inverse document frequency that isn't positive.
LEAST_IDF = 1e-6
RRF_K = 60
#: When two texts say the same: least characters, least shared longer words, least share of them (fixed values).
LEAST_CHARS, LEAST_TOKENS, SHARE = 80, 12, 0.9
#: The columns of a chunk that are indexed (fixed values).
INDEXED = ("chunk_id", "document_id", "title", "section_path", "paragraph_ref", "text", "topic", "document_type")


def bm25_impact(mean: float) -> Callable:
    """What an occurrence count is worth in a chunk of ``size`` tokens, ``mean`` being the usual size."""
    return lambda tf, size: tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _usual(sizes) -> float:
    return max(1.0, float(sizes.mean())) if len(sizes) else 1.0


def build_index(chunks: DataFrame, columns: list[str], key: str = "chunk_id", marks: list[Column] | None = None, name: str = "") -> DataFrame:
    """The keyword index of the tokens of ``columns``, to be stored.

    ``marks``: by what searches can filter, text columns that start with ``@`` (null: no
    mark). They don't count as tokens. ``name`` tells the shards of one part of a
    corpus from those of others.
    """
    words = F.flatten(F.array(*(tokens(F.col(c)) for c in columns)))
    rows = spread(chunks).select(F.col(key).alias("key"), words.alias("words"), *(m.alias(f"m{i}") for i, m in enumerate(marks or [])))
    marked = F.array_compact(F.array(*(F.col(f"m{i}") for i in range(len(marks or []))))) if marks else F.array().cast("array<string>")
    rows = rows.select("key", F.concat("words", marked).alias("words"), F.size("words").cast("long").alias("size"))
    return keyword_index.build(rows, dict(rows.dtypes)["key"], lambda sizes: bm25_impact(_usual(sizes)), name=name)


def mark(name: str, value: Column) -> Column:
    """The mark of a field's value; null for null."""
    return F.concat(F.lit(f"{keyword_index.MARK}{name}:"), value.cast("string"))


def index_terms(index: DataFrame) -> DataFrame:
    """(term, df, cf) of all terms, from the index alone."""
    rows = index.select("term", "df", "cf").where(f"term <> '' AND NOT startswith(term, '{keyword_index.MARK}')")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def index_totals(index: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length, filters aside."""
    heads = index.where("term = ''").select(F.size("sizes").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))
    return heads.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))


def query_terms(text: str) -> list[str]:
    """Terms of a query string: ASCII words, reserved words dropped, as tokens."""
    return [w.lower() for w in re.sub(r"[^A-Za-z0-9_\s]", " ", text).replace("_", " ").split() if w.lower() not in RESERVED]


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def keyword_hits(index: DataFrame, asked: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, key, score, mode, rank): the k best chunks of each query by BM25.

    ``asked``: query_id, term, a term as often as the query repeats it, marks among them.
    Chunks with all terms but the reserved ones go by these; a query without such
    chunks has those with any of its terms, reserved ones included. A query of reserved
    words alone finds nothing. Scores that round to the same are ties, which go by key.
    """
    total = index_totals(index).first()
    n, avgdl = float(total["n"]), float(total["avgdl"] or 1) or 1.0
    times = asked.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    counts = keyword_index.term_counts(index, times)
    is_mark = F.startswith("term", F.lit(keyword_index.MARK))
    needed = ~is_mark & ~F.col("term").isin(*RESERVED)
    weight = F.when(is_mark, 0.0).otherwise(F.coalesce(F.col("times") * idf(F.lit(n), F.col("df")), F.lit(0.0)))
    weighed = times.join(counts, "term", "left").select("query_id", "term", weight.alias("weight"), needed.alias("needed"))
    told = materialize(weighed.withColumn("some", F.max("needed").over(Window.partitionBy("query_id"))).where("some").drop("some"), "asked-terms")
    found = materialize(keyword_index.top_rows(index, told, k, bm25_impact(avgdl), digits, True, lambda sizes: max(1.0, avgdl / _usual(sizes))), "keyword-hits")
    hits = keyword_index.strict_or_any(found).withColumn("score", F.round("score", digits))
    return ranked(hits, [F.desc("score"), F.col("key")], k)


def ranked(hits: DataFrame, order: list[Column], limit: int, by: str = "query_id", name: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each query. ``order`` ends with a unique key."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= limit)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 1024, group: int = 100_000, cells: int = 1 << 20) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest of all vectors, exactly.

    Queries are written to the shared folder in files of about ``block`` rows; a task
    holds ``group`` vectors and meets one file after the other, so neither the driver
    nor a task holds all queries. Of a group and query the k best are shuffled, found
    by products of matrices and measured again by differences. ``cells``: distances that
    a task holds at once, of a query at least.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    path = fresh_path(spark, "query-vectors")
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    files = max(1, -(-rows.count() // block))
    rows.repartition(files, "query_id").write.parquet(path)

    def best(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = arrow_store(path)
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))

        def meet(keys, v):
            square = np.einsum("ij,ij->i", v, v)
            step = max(1, cells // len(v))
            for name in names:
                t = pq.read_table(name, filesystem=store)
                if not t.num_rows:
                    continue
                every = t.column("query_id").to_numpy()
                all_q = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(every), -1)
                for at in range(0, len(every), step):
                    ids, q = every[at : at + step], all_q[at : at + step]
                    far = q @ v.T
                    far *= -2
                    far += square[None, :]
                    far += np.einsum("ij,ij->i", q, q)[:, None]
                    edge = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(ids), np.inf)
                    i, j = np.nonzero(far <= edge[:, None] + 1e-9)
                    parts = 1 + len(i) * v.shape[1] // cells
                    d = np.concatenate([np.sqrt(((v[y] - q[x]) ** 2).sum(axis=1)) for x, y in zip(np.array_split(i, parts), np.array_split(j, parts))])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), keys.take(pa.array(j)), pa.array(d, pa.float64())], names=["query_id", "key", "distance"])

        def all_held():
            keys, v = pa.concat_arrays(held_k), np.concatenate(held_v)
            held_k.clear(), held_v.clear()
            return keys, v

        held_k, held_v, n = [], [], 0
        for b in batches:
            # copies, since a column keeps the batch it is of
            held_k.append(b.column(0).take(pa.array(np.arange(b.num_rows))))
            held_v.append(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
            n += b.num_rows
            if n >= group:
                yield from meet(*all_held())
                n = 0
        if n:
            yield from meet(*all_held())

    each = vectors.select(key, vector).mapInArrow(best, f"query_id long, key {dict(vectors.dtypes)[key]}, distance double")
    return ranked(each, [F.col("distance"), F.col("key")], k).withColumnRenamed("key", key)


def fuse(keyword: DataFrame, vector: DataFrame, key: str = "chunk_id", w_keyword: float = 1.0, w_vector: float = 1.0, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists (query_id, key, rank)."""
    a = keyword.select("query_id", key, F.col("rank").alias("kw_rank"), F.lit(None).cast("int").alias("vec_rank"))
    b = vector.select("query_id", key, F.lit(None).cast("int").alias("kw_rank"), F.col("rank").alias("vec_rank"))
    both = a.unionByName(b).groupBy("query_id", key).agg(F.min("kw_rank").alias("kw_rank"), F.min("vec_rank").alias("vec_rank"))
    part = lambda w, c: F.coalesce(F.lit(w) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part(w_keyword, "kw_rank") + part(w_vector, "vec_rank"))


def fused_order(key: str = "chunk_id") -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("kw_rank"), F.asc_nulls_last("vec_rank"), F.col(key)]


def prefer_regions(hits: DataFrame, region: str = "document_region", rank: str = "rank", by: str = "query_id") -> DataFrame:
    """Body regions first, otherwise in the given order; no change where no region is known."""
    known = F.max(F.col(region).isNotNull().cast("int")).over(Window.partitionBy(by))
    late = F.when((known == 1) & F.col(region).isNotNull() & ~F.col(region).isin("body", "default"), 1).otherwise(0)
    return hits.withColumn("late", late).withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy("late", rank))).drop("late")


def normal_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def strong_overlap(a: Column, b: Column, least_chars: int = LEAST_CHARS, least_tokens: int = LEAST_TOKENS, share: float = SHARE) -> Column:
    """Whether two texts say the same: equal, contained, or sharing most longer words."""
    x, y = normal_text(a), normal_text(b)
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: F.length(w) >= 3))
    shared = F.size(F.array_intersect(words(x), words(y)))
    smaller = F.least(F.size(words(x)), F.size(words(y)))
    long_enough = (F.length(x) >= least_chars) & (F.length(y) >= least_chars)
    return long_enough & ((x == y) | F.contains(x, y) | F.contains(y, x) | ((shared >= least_tokens) & (shared >= F.ceil(smaller * share))))


def demote_generated(hits: DataFrame, generated: Column, series: Column, paragraph: str, text: str, key: str = "chunk_id", rank: str = "rank", by: str = "query_id") -> DataFrame:
    """Moves hits under a generated id behind all others if a canonical hit of the same
    series and paragraph says the same. Nothing is dropped."""
    from quillspark.operators.similar import similar_pairs

    rows = materialize(hits.withColumn("generated", generated).withColumn("series", series).withColumn("row", F.struct(by, key)), "hits-by-kind")
    pairs = similar_pairs(rows.where("generated"), rows.where(~F.col("generated")), [by, paragraph, "series"], "row", text)
    demoted = pairs.select("left_key.*", F.lit(1).alias("demoted")).distinct()
    out = rows.join(demoted, [by, key], "left").withColumn("demoted", F.coalesce("demoted", F.lit(0)))
    return out.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy("demoted", rank))).drop("generated", "series", "row")
