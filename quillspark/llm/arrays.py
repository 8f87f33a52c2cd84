"""Array expressions that the operators share, and what worker processes keep between tasks."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


_KEPT: list = []


def kept(make: Callable) -> Callable:
    """``make`` with its results kept in the worker process, for its later tasks, until ``release``."""
    cached = functools.cache(make)
    _KEPT.append(cached)
    return cached


def release() -> None:
    """Frees what earlier tasks kept in this process. A worker lives on for other stages, and one that needs memory calls this first."""
    for cached in _KEPT:
        cached.cache_clear()
    pa.default_memory_pool().release_unused()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """For each number of an array<bigint> the sum of those ahead of it.

    Sums are taken in runs of about the root of the array's length, then over the
    runs, so no array grows by single elements to its full length.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def sums(xs: Column, amount: Callable[[Column], Column]) -> Column:
        return F.aggregate(xs, start, lambda done, x: F.struct((done["at"] + amount(x)).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")))

    def all_of(xs: Column) -> Column:
        run = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"))
        firsts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / run).cast("int"))
        inside = F.transform(firsts, lambda k: sums(F.slice(xs, k * run + 1, run), lambda x: x))
        added = bound(inside, lambda runs: F.flatten(F.zip_with(runs, sums(runs, lambda r: r["at"])["out"], lambda r, base: F.transform(r["out"], lambda x: x + base))))
        return F.when(F.size(xs) > 0, added).otherwise(F.array().cast("array<bigint>"))

    return bound(numbers, all_of)
