"""The queries of this package over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.core import materialize, table
from quillspark.llm import audit, bagminhash, blockmax, chat, ctxmix, decontam, licenses, mixing, nra, quality, records, secrets, suffix_dedup


@functools.cache
def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(2, len(w) - 8))) u(s) WHERE len(w) > 0
), dw AS (
  SELECT k, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM iw) z, unnest(range(1, len(w) - n + 2)) u(s)
), h AS (SELECT k, s, n, item_id FROM dw JOIN iw USING (n, g)),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + n)) u(p) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    typed = rows.unionByName(extra).withColumn("parts", chat.text_part(F.col("text")))
    back = chat.parse_formatted(chat.format_conversations(typed, parts="parts"))
    # each turn gives role, line feed, text, line feed
    shown = F.concat(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def _escaped_length(x: str) -> str:
    controls = r"(<\||</?s>|\[/?INST\]|<</?SYS>>)"
    return f"(length({x}) + length({x}) - length(replace({x}, chr(92), '')) + len(regexp_extract_all({x}, '{controls}')))"


OP3_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens -- the table's parts are all texts
FROM said GROUP BY conv_id
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_verdicts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, thousands, hundreds; a document whose first
    line speaks of a licence is the licence file of its source's thousand."""
    docs = table(spark, sf_dir, "documents")
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).rlike(r"^[^.\n]{0,80}[Ll]icense")
    number = F.col("doc_id").cast("string")
    top = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.floor(F.col("doc_id") / 1000).cast("string"))
    tree = F.when(first, F.concat_ws("/", top, F.concat(F.lit("LICENSE-"), number))).otherwise(F.concat_ws("/", top, F.floor(F.col("doc_id") / 100).cast("string"), number))
    return licenses.scan_licences(docs, tree, first)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "source", "size", "source_size", "target", "taken", F.to_json("shards").alias("shards"))


def op8_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bagminhash.near_duplicates(table(spark, sf_dir, "documents"))
    # a class goes by the least doc_id in it
    names = materialize(got.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "near-names")
    return got.join(names, "class").select("doc_id", "class_id", "class_size")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_documents(table(spark, sf_dir, "documents"), byte_tokenizer(), end_id=0)


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctxmix.score_documents(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = blockmax.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)
    return got.select(F.col("query_id").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), g AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) GROUP BY k, term),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, g GROUP BY term, n_docs),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (
  SELECT item_id, doc_id, k, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (k), g GROUP BY item_id, doc_id, k
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), g AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT part, array_to_string(list_transform(p, lambda k: 'ABCDE'[k]), '') AS filter_order, x.i AS step, 'ABCDE'[p[x.i]] AS filter,
    f[p[x.i]] AS fails, list_bool_or(list_transform(p[1:x.i - 1], lambda k: f[k])) IS TRUE AS gone, list_sum(list_transform(f, lambda b: b::INT)) = 1 AS alone, n, good, toxic
  FROM g, o, x
), r AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""

def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nra.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op3_chat_format": op3_chat_format,
    "op5_quality_rules": op5_quality_rules,
    "op6_licence_scan": op6_licence_scan,
    "op7_mix_sources": op7_mix_sources,
    "op8_minhash_classes": op8_minhash_classes,
    "op9_token_records": op9_token_records,
    "op10_context_mixing": op10_context_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_exact_topk": op13_exact_topk,
}

ORACLE_SQL = {
    "op3_chat_format": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_exact_topk": OP13_SQL,
}
