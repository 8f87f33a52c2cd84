from itertools import accumulate

from pyspark.sql import functions as F

from quillspark.llm.arrays import running_sums


def test_running_sums(spark):
    rows = [(n, [(k * 7 + 3) % 11 for k in range(n)]) for n in (0, 1, 2, 15, 16, 17, 300, 1000)]
    got = spark.createDataFrame(rows, "n int, x array<bigint>").select("n", running_sums(F.col("x")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == {n: list(accumulate(x, initial=0))[:-1] for n, x in rows}
