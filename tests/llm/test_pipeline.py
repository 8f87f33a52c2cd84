import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from quillspark.core import materialize

    counts = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = materialize(stage(spark, docs, SF), "test-stage")
        counts.append(docs.count())
        assert tuple(docs.columns) == (P.COLUMNS if k < 4 else ("doc_id", "start", "n_tokens", "ids_crc32"))
    assert 200 > counts[0] > counts[1] >= counts[2] > 0 and counts[3] == counts[4]


def test_records_keep_the_order_of_the_mixture(spark):
    from quillspark.core import materialize

    docs = materialize(P.source_mixture(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), "test-mixture")
    rows = [r["doc_id"] for r in docs.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    got = [r["doc_id"] for r in P.token_records(spark, docs, SF).orderBy("start").collect()]
    assert got == rows != sorted(rows)


def test_stages_take_odd_rows(spark, odd):
    for _, stage in P.STAGES:
        assert stage(spark, odd, SF).count() > 0
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_duplicates_keep_one(spark, odd):
    got = sorted(r["doc_id"] for r in P.near_duplicates(spark, odd, SF).collect() if r["doc_id"] is not None)
    # 1, 2, 2 and 3 are alike, 4 and 5 are empty
    assert got == [1, 4, 6, 7, 8, 9]
