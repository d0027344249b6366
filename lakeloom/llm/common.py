"""Helpers shared by the training-data operators: shared scratch space and shipping of the package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words of the contracts, over UTF-8 bytes whose A-Z have been lower-cased.
SPACE_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 bytes with only A-Z lower-cased; null is the empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per context, whatever their own import path holds."""
    sc = spark.sparkContext
    if getattr(sc, "_lakeloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="lakeloom-")) / "lakeloom_pkg.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, str(Path(root.name) / path.relative_to(root)))
        sc.addPyFile(str(archive))
    sc._lakeloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or a folder of our own where it is unset on one machine
    (tests); a cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        where = getattr(spark.sparkContext, "_lakeloom_scratch", None)
        if where is None:
            where = tempfile.mkdtemp(prefix="lakeloom-shared-")
            spark.sparkContext._lakeloom_scratch = where
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Tables written to the shared folder by one run of an operator, so that a lost executor costs only a reread."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_partitions(spark: SparkSession) -> int:
    """Reduce-side partitions: the session's setting, which whoever runs a job sets by the size of its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release_memory() -> None:
    """Hands freed memory of this worker back, since a worker lives on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same batches in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tokenizer_path(name: str) -> str:
    """The default folder of public tokenizer files; operators take the path as a parameter."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
