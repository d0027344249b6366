"""Token counts behind a digest cache.

The cache is a Parquet table ``(content_digest, tokenizer_digest, n_tokens)``. Documents are joined to it
on the SHA-256 of their content and of the tokenizer file; only distinct texts that it lacks are encoded,
and their counts are appended. A run reads the cache's digests for its tokenizer and copies only the counts that its
own texts need. Content is normalised no further than null to the empty text: any other
normalisation could change a count.

Cases: null text counts as empty (0 bytes, and 0 tokens); repeated rows each keep their row; an empty
table gives an empty result; very long texts are encoded whole; extra columns are ignored. Copies meet after a map-side merge, so one text
that fills a third of the table sends one row per task to its reducer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, pieces_of, ship

_LOADED: dict[str, object] = {}

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def load_counter(path: str):
    """A function from texts to token counts, for a ``.model`` or ``.json`` file; one per worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(ids) for ids in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tk = Tokenizer.from_file(path)
            tk.no_truncation()
            tk.no_padding()
            _LOADED[path] = lambda texts: [len(e.ids) for e in tk.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[path]


def encoder(path: str, tokenizer: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(path)
        for batch in pieces_of(batches, 256):
            digests = batch.column(0)
            counts = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [digests, pa.array([tokenizer] * batch.num_rows, pa.string()), pa.array(counts, pa.int64())],
                ["content_digest", "tokenizer_digest", "n_tokens"],
            )

    return encode


def token_counts(docs: DataFrame, model_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every document; ``cache_path`` gains what it lacked."""
    spark = docs.sparkSession
    ship(spark)
    tokenizer = file_digest(model_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col), text.alias("_content"), F.sha2(text, 256).alias("content_digest"))

    scratch = Scratch(spark, "token-counts")
    rows = scratch.save(keyed.select(id_col, "content_digest", F.octet_length("_content").cast("long").alias("n_bytes")), "rows")

    # Opens the cache, empty where it is new, and takes from it what this table needs.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == tokenizer)
    needed = cache.join(rows.select("content_digest").distinct(), "content_digest", "left_semi")
    held = scratch.save(needed.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "held")  # two writers may have appended the same text

    distinct = keyed.groupBy("content_digest").agg(F.first("_content").alias("_content"))
    misses = distinct.join(held.select("content_digest"), "content_digest", "left_anti").select("content_digest", "_content")
    fresh = scratch.save(misses.mapInArrow(encoder(model_path, tokenizer), CACHE_SCHEMA), "fresh")
    fresh.write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)

    # Both are written, so that the join below is between plain exchanges, which can be split where a text has many copies.
    known = held.unionByName(fresh.select("content_digest", "n_tokens"))
    return rows.join(known, "content_digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(docs: DataFrame) -> str:
    """A cache path of its own in the shared folder."""
    return Scratch(docs.sparkSession, "token-cache").base
