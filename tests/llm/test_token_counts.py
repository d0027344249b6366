import sentencepiece
from pyspark.sql import functions as F

from lakeloom.llm.common import tokenizer_path
from lakeloom.llm.token_counts import CACHE_SCHEMA, file_digest, fresh_cache, token_counts

MODEL = tokenizer_path("piece_bpe_32k.model")


def test_counts_and_cache(spark, documents, clashing):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    cache = fresh_cache(documents)
    rows = token_counts(clashing, MODEL, cache, limit=1000).collect()
    want = sorted((d["doc_id"] or -1, len((d["text"] or "").encode()), len(sp.encode(d["text"] or ""))) for d in documents.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1000) for r in rows)
    held = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    distinct = documents.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert held.count() == distinct

    more = documents.limit(10).union(spark.createDataFrame([(900, "quite new", None, None, 0)], documents.schema))
    assert token_counts(more, MODEL, cache).count() == 11
    assert spark.read.schema(CACHE_SCHEMA).parquet(cache).count() == distinct + 1
    other = tokenizer_path("byte_bpe_50k.json")
    assert token_counts(more, other, cache).count() == 11
    assert spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer_digest") == file_digest(other)).count() == more.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_known_counts_are_not_encoded_again(spark, documents):
    cache = fresh_cache(documents)
    planted = documents.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_digest"), F.lit(file_digest(MODEL)).alias("tokenizer_digest"), F.lit(7).cast("long").alias("n_tokens"))
    planted.write.parquet(cache)
    assert {r["n_tokens"] for r in token_counts(documents, MODEL, cache).collect()} == {7}


def test_empty_table(nothing):
    assert token_counts(nothing, MODEL, fresh_cache(nothing)).count() == 0
