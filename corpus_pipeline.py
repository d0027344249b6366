"""The corpus pipeline: toxic documents go, one of each group of near copies stays, documents with benchmark
passages go, and what is left is packed into training sequences. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, near_duplicates, packing, toxicity
from lakeloom.llm.common import Scratch, tokenizer_path

#: No stage's rows can be had from SQL.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with numbered columns, so that none clashes with an operator's own, and their numbers by name."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(number).alias(name) for name, number in names.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score under 0.7; labels of a third of the ids are left out of training, as in the query."""
    settings = toxicity.Settings()
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), settings, learn)
    rows, names = _numbered(docs)
    scored = toxicity.score(rows, model, settings, id_col=names["doc_id"], text_col=names["text"], keep=tuple(names.values()))
    return _named(scored.where(F.col("score") < 0.7), names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a shingle similarity of 0.8 or more."""
    rows, names = _numbered(docs)
    return _named(near_duplicates.one_of_each(rows, words=5, similarity=0.8, id_col=names["doc_id"], text_col=names["text"]), names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without any ten consecutive words of a benchmark item."""
    rows, names = _numbered(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(rows, benchmark, width=10, id_col=names["doc_id"], text_col=names["text"], keep=tuple(names.values()))
    return _named(found.where(F.size("spans") == 0), names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of at most 1,024 ids."""
    pieces = packing.document_pieces(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, capacity=1024).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("decontamination", drop_contaminated), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
