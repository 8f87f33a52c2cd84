"""Answers cut to a size, for whole tables of requests: sizes added up by rank, one cut a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters (UTF-16 units) of an answer's JSON, and of a text that is cut (fixed values).
BUDGET, CUT = 50_000, 200


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def citation_chars(fields: list[str]) -> Column:
    """Length of a citation's JSON with an indent of two, as an element of an answer's list.

    The compact form plus what laying out adds: braces and fields on lines of their own,
    indented, and a space behind each colon. Fields are flat.
    """
    compact = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return utf16_units(compact) + 8 * len(fields) + 9


def cut_to_budget(citations: DataFrame, heads: DataFrame, fields: list[str], budget: int = BUDGET) -> DataFrame:
    """The citations that stay: all columns and ``dropped``, the number of those left out for their request.

    ``citations``: request_id, rank (1, 2, ...) and ``fields`` (text and truncated among
    them); ``heads``: request_id, head_chars, the length of the answer's JSON with an empty
    list. Citations go from the last while an answer is too long; the first one stays,
    its text cut where it is too long alone. A request without citations has no rows.
    """
    by = Window.partitionBy("request_id").orderBy("rank")
    rows = citations.join(heads.select("request_id", "head_chars"), "request_id").withColumn("chars", citation_chars(fields))
    # a list with elements has a line break at both ends and the closing indent; elements are parted by a comma and a break
    total = F.col("head_chars") + 4 + F.sum("chars").over(by) + 2 * (F.row_number().over(by) - 1)
    rows = rows.withColumns({"total": total, "nth": F.row_number().over(by), "many": F.count("*").over(Window.partitionBy("request_id"))})
    kept = rows.where((F.col("total") <= budget) | (F.col("nth") == 1))
    left = kept.withColumn("dropped", F.col("many") - F.count("*").over(Window.partitionBy("request_id")))
    too_long = (F.col("nth") == 1) & (F.col("total") > budget)
    cut = {"text": F.when(too_long, F.substring(F.coalesce("text", F.lit("")), 1, CUT)).otherwise(F.col("text")), "truncated": F.when(too_long, True).otherwise(F.col("truncated"))}
    return left.withColumns(cut).select("request_id", "rank", *fields, "dropped")
