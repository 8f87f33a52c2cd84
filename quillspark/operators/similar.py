"""Pairs of texts that say the same, found by rare words instead of comparing all pairs.

Two texts say the same if their normal forms are equal, one contains the other, or
they share most of the longer words of the one with fewer (``search.strong_overlap``).
A text that is so close to another shares one of a few of its own rarest words with
it: of n words all but a tenth, or all but the two at its ends where it is contained.
So each text offers that many of its rarest words, meets the texts that have one of
them, and only these pairs are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.core import materialize
from quillspark.operators.search import LEAST_CHARS, LEAST_TOKENS, SHARE, normal_text, strong_overlap


def _words(normal: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal, " "), lambda w: F.length(w) >= 3))


def offered(n: Column, share: float = SHARE) -> Column:
    """How many of its ``n`` words a text offers, the rarest first."""
    return F.greatest(n - F.ceil(n * share) + 1, F.lit(3)).cast("int")


def candidate_pairs(left: DataFrame, right: DataFrame, on: list[str], key: str, text: str) -> DataFrame:
    """(left_key, right_key) of pairs with equal ``on`` that may say the same.

    Texts too short to be compared have no pairs, nor have nulls in ``on``. A text with
    fewer than three longer words offers the empty word, which all texts have: it
    meets all others with its ``on``.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(key).alias("k"), *on, normal_text(F.coalesce(F.col(text), F.lit(""))).alias("normal")).where(F.length("normal") >= LEAST_CHARS)
        return rows.select("k", *on, _words(F.col("normal")).alias("w")).withColumn("side", F.lit(name))

    both = materialize(side(left, "left").unionByName(side(right, "right")), "similar-words")
    each = both.select("side", "k", *on, F.size("w").alias("n"), F.explode("w").alias("word"))
    rare = each.groupBy("word").agg(F.count("*").alias("df"))
    # a text's words by how many texts have them: an array a text, of its own words
    ranked = each.join(rare, "word").groupBy("side", "k", *on).agg(F.array_sort(F.collect_set(F.struct("df", "word"))).alias("x"), F.first("n").alias("n"))
    offers = ranked.select("side", "k", *on, F.explode(F.slice(F.col("x.word"), F.lit(1), offered(F.col("n")))).alias("word"))
    few = both.where(F.size("w") < 3).select("side", "k", *on, F.lit("").alias("word"))
    has = each.select("side", "k", *on, "word").unionByName(both.select("side", "k", *on, F.lit("").alias("word")))
    offers = offers.unionByName(few)

    def met(a: str, b: str) -> DataFrame:
        mine = offers.where(F.col("side") == a).select(*on, "word", F.col("k").alias(f"{a}_key"))
        theirs = has.where(F.col("side") == b).select(*on, "word", F.col("k").alias(f"{b}_key"))
        return mine.join(theirs, [*on, "word"]).select("left_key", "right_key")

    return met("left", "right").unionByName(met("right", "left")).distinct()


def similar_pairs(left: DataFrame, right: DataFrame, on: list[str], key: str, text: str) -> DataFrame:
    """(left_key, right_key) of pairs with equal ``on`` whose texts say the same. ``key`` is unique on each side."""
    pairs = candidate_pairs(left, right, on, key, text)
    texts = lambda df, name: df.select(F.col(key).alias(f"{name}_key"), F.col(text).alias(f"{name}_text"))
    full = pairs.join(texts(left, "left"), "left_key").join(texts(right, "right"), "right_key")
    return full.where(strong_overlap(F.col("left_text"), F.col("right_text"), LEAST_CHARS, LEAST_TOKENS, SHARE)).select("left_key", "right_key")
