"""Detection and parsing of record files, and exports.

Files are read by Spark's own readers; Python only where no reader exists (YAML, CSV rows of uneven width, magic
bytes), batch-wise on executors.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How much of a file its format is told from.
PROBE = 4096
#: Bytes up to which a JSON file is parsed as one value.
WHOLE = 16 << 20
RECORDS = "path string, position long, record string, error string"


# Detection --------------------------------------------------------------------------------------


def compression(path: Column, head: Column) -> Column:
    """By extension, then by magic bytes."""
    ext = F.lower(F.substring_index(path, ".", -1))
    magic = F.hex(F.substring(head, 1, 4))
    return F.when(ext == "gz", "gzip").when(ext == "zst", "zstd").when(magic.startswith("1F8B"), "gzip").when(magic == "28B52FFD", "zstd").otherwise("none")


def _ndjson(content: Column) -> Column:
    lines = F.transform(F.split(F.substring(content, 1, PROBE), "\n"), F.trim)
    shaped = F.filter(lines, lambda s: (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]")))
    return (F.size(lines) >= 2) & (F.size(F.filter(shaped, lambda s: F.try_parse_json(s).isNotNull())) >= 2)


def detect_format(path: Column, content: Column) -> Column:
    """ndjson, json, yaml, csv or unknown: by extension, else by the beginning of the content."""
    name = F.regexp_replace(F.lower(path), r"\.(gz|zst)$", "")
    ext = F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")
    head = F.regexp_replace(F.substring(content, 1, PROBE), r"^\s+|\s+$", "")
    object_ = head.startswith("{") & head.contains("}")
    list_ = head.startswith("[") & head.contains("]")
    return (
        F.when(ext.isin("ndjson", "jsonl"), "ndjson")
        .when(ext == "json", F.when(_ndjson(content), "ndjson").otherwise("json"))
        .when(ext.isin("yaml", "yml"), "yaml")
        .when(ext == "csv", "csv")
        .when(object_ & _ndjson(content), "ndjson")
        .when(object_ | list_, "json")
        .when(head.contains(":") & ~head.contains(","), "yaml")
        .when(head.contains(",") & head.contains("\n"), "csv")
        .otherwise("unknown")
    )


def probe_processor(content: Column) -> Column:
    """The first parser in order that takes the content: json, csv, yaml, else generic."""
    head = F.regexp_replace(F.substring(content, 1, PROBE), r"^\s+", "")
    first = F.get(F.split(head, "\n"), 0)
    return F.when(head.rlike(r"^[\[{]"), "json").when(first.contains(",") & head.contains("\n"), "csv").when(head.rlike(r"(?m)^(---|\s*[\w-]+:(\s|$))"), "yaml").otherwise("generic")


def typed_cell(cell: Column) -> Column:
    """JSON text of a CSV cell: null, integer, number, boolean or string."""
    text = F.trim(cell)
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    truth = F.when(text.isin("t", "T", "TRUE", "true", "True"), "true").when(text.isin("f", "F", "FALSE", "false", "False"), "false")
    quoted = F.to_json(F.array(text))
    return F.when(text == "", "null").otherwise(F.coalesce(whole.cast("string"), number.cast("string"), truth, F.substring(quoted, 2, F.length(quoted) - 2)))


def cell_kind(cell: Column) -> Column:
    text = typed_cell(cell)
    return F.when(text == "null", "null").when(text.isin("true", "false"), "bool").when(text.startswith('"'), "string").when(text.rlike(r"^-?\d+$"), "int").otherwise("float")


def is_header(cells: Column) -> Column:
    """A first row whose filled cells all have letters and are not numbers."""
    filled = F.filter(F.transform(cells, F.trim), lambda c: c != "")
    return ~F.exists(filled, lambda c: c.try_cast("double").isNotNull() | ~c.rlike("[A-Za-z]"))


# Reading ----------------------------------------------------------------------------------------


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of whole files, decompressed by magic bytes where Spark's codecs would go by name only."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                elif data[:4] == b"\x28\xb5\x2f\xfd":
                    import zstandard

                    data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
                out.append(data.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["path", "content"])

    return raw.mapInArrow(inflate, "path string, content string")


def ndjson_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, record, error)`` a line that is not blank: the record, or what is wrong."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull()
    return lines.select("path", F.when(~bad, F.col("value")).alias("record"), F.when(bad, F.concat(F.lit("not JSON: "), F.substring("value", 1, 80))).alias("error"))


def read_ndjson(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``(path, record)`` a line; a bad line is an error when strict and left out otherwise (see :func:`ndjson_lines`)."""
    lines = ndjson_lines(spark, path)
    if not strict:
        return lines.where("error is null").select("path", "record")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("record"))
    return lines.select("path", checked.alias("record"))


def _elements(files: DataFrame) -> DataFrame:
    """``(path, position, text)``: the texts of a list's elements, or the whole text, cut without building values."""
    space = re.compile(r"[ \t\n\r]*")

    def cut(text: str) -> Iterator[str]:
        scan = json.JSONDecoder().raw_decode
        at = space.match(text).end()
        if text[at : at + 1] != "[":
            yield text
            return
        at = space.match(text, at + 1).end()
        while text[at : at + 1] != "]":
            end = scan(text, at)[1]
            yield text[at:end]
            at = space.match(text, end).end()
            if text[at : at + 1] == ",":
                at = space.match(text, at + 1).end()
            elif text[at : at + 1] != "]":
                raise ValueError(f"neither a comma nor an end at {at}")
        if text[at + 1 :].strip():
            raise ValueError(f"text after the list at {at}")

    def batch_of(path: str, first: int, texts: list[str | None]) -> pa.RecordBatch:
        columns = [pa.array([path] * len(texts), pa.string()), pa.array(range(first, first + len(texts)), pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["path", "position", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file at a time
                path, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                at, held, size = 0, [], 0
                try:
                    for element in cut(text):
                        held.append(element)
                        size += len(element)
                        if len(held) >= 10_000 or size > 8 << 20:
                            yield batch_of(path, at, held)
                            at, held, size = at + len(held), [], 0
                except (ValueError, RecursionError):
                    held.append(None)
                yield batch_of(path, at, held)

    return files.select("path", "content").mapInArrow(run, "path string, position long, text string")


def json_records(files: DataFrame, tolerant: bool = False) -> DataFrame:
    """``(path, position, record)`` from ``(path, content)``: the elements of a list, or the one document.

    Files over ``WHOLE`` bytes are cut into elements first, so that a list has no largest size. Text that is not JSON
    is an error, or if tolerant, a row with an ``error`` instead of a record, after the elements before it.
    """
    small = files.where(F.octet_length("content") <= WHOLE)
    whole = F.try_parse_json("content")
    elements = F.when(F.trim("content").startswith("["), F.try_variant_get(whole, "$", "array<variant>"))
    listed = F.transform(elements, lambda v: F.to_json(v))
    rows = small.select("path", F.posexplode_outer(F.coalesce(listed, F.array(F.to_json(whole)))).alias("position", "record"))
    rows = rows.select("path", F.col("position").cast("long").alias("position"), "record").where("position is not null")
    large = _elements(files.where(F.octet_length("content") > WHOLE)).select("path", "position", F.to_json(F.try_parse_json("text")).alias("record"))
    rows = rows.unionByName(large)
    bad, text = F.col("record").isNull(), F.concat(F.lit("not JSON: "), F.col("path"))
    if tolerant:
        return rows.withColumn("error", F.when(bad, text))
    return rows.withColumn("record", F.when(bad, F.raise_error(text).cast("string")).otherwise(F.col("record")))


def _python_records(files: DataFrame, parse) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(parse(content))
                columns = [[path] * len(found), list(range(len(found))), [r for r, _ in found], [e for _, e in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "position", "record", "error"])

    return files.select("path", "content").mapInArrow(run, RECORDS)


def yaml_records(files: DataFrame) -> DataFrame:
    """A record for every document between ``---`` lines; one that cannot be read gives an error."""

    def parse(content: str) -> Iterator[tuple[str | None, str | None]]:
        import yaml

        for part in re.split(r"(?m)^---\s*$", content):
            if part.strip():
                try:
                    yield json.dumps(yaml.safe_load(part), default=str), None
                except yaml.YAMLError as e:
                    yield None, str(e).splitlines()[0]

    return _python_records(files, parse)


def csv_records(files: DataFrame) -> DataFrame:
    """A record for every row after the header, if the first row is one; rows may differ in width."""

    def value(text: str) -> object:
        text = text.strip()
        if not text:
            return None
        for kind in (int, float):
            try:
                if "_" not in text:
                    return kind(text)
            except ValueError:
                pass
        return True if text in ("t", "T", "TRUE", "true", "True") else False if text in ("f", "F", "FALSE", "false", "False") else text

    def parse(content: str) -> Iterator[tuple[str | None, str | None]]:
        rows = [r for r in csv.reader(io.StringIO(content), skipinitialspace=True) if r]
        filled = [c.strip() for c in rows[0] if c.strip()] if rows else []
        header = rows[0] if filled and all(isinstance(value(c), str | bool) and any("a" <= x.lower() <= "z" for x in c) for c in filled) else None
        for at, row in enumerate(rows[1:] if header else rows):
            names = [header[k] if header and k < len(header) else f"col_{k}" for k in range(len(row))]
            yield json.dumps(dict(zip(names, map(value, row))) | {"_row_number": at + bool(header), "_column_count": len(row)}), None

    return _python_records(files, parse)


def generic_records(files: DataFrame) -> DataFrame:
    """One record of statistics for files of no known format."""
    lines = F.size(F.split("content", "\n"))
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    record = F.to_json(F.struct(F.lit("text").alias("type"), F.octet_length("content").alias("size"), lines.alias("lines"), words.alias("words"), F.sha2("content", 256).alias("hash"), F.substring("content", 1, 100).alias("preview")))
    return files.select("path", F.lit(0).cast("long").alias("position"), record.alias("record"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(path, position, record, error)`` of all files under a path or glob, each by its own format."""
    files = read_files(spark, path).withColumn("format", detect_format(F.col("path"), F.col("content")))
    none = F.lit(None).cast("string").alias("error")
    of = lambda f: files.where(F.col("format") == f)
    lines = of("ndjson").select("path", F.posexplode(F.split("content", "\n")).alias("position", "record")).where(F.trim("record") != "")
    bad = F.try_parse_json("record").isNull()
    lines = lines.select("path", F.col("position").cast("long").alias("position"), F.when(~bad, F.col("record")).alias("record"), F.when(bad, F.concat(F.lit("line "), F.col("position") + 1)).alias("error"))
    parts = [json_records(of("json"), tolerant=True), lines, yaml_records(of("yaml")), csv_records(of("csv")), generic_records(of("unknown")).withColumn("error", none)]
    out = parts[0].select("path", "position", "record", "error")
    for part in parts[1:]:
        out = out.unionByName(part.select("path", "position", "record", "error"))
    return out


def tolerable(records: DataFrame, limit: float = 0.1) -> bool:
    """Whether at most this share of the records are errors."""
    row = records.agg(F.avg(F.col("error").isNotNull().cast("double")).alias("share")).first()
    return (row["share"] or 0.0) <= limit


# Envelopes and observations ---------------------------------------------------------------------


def unwrap(record: Column) -> Column:
    """``struct<payload, schema>``: the data of an envelope with its schema reference, or the record itself."""
    module, version, name = (F.get_json_object(record, f"$.schema.{k}") for k in ("module", "version", "name"))
    data = F.get_json_object(record, "$.data")
    wrapped = module.isNotNull() & data.isNotNull()
    reference = F.concat(module, F.coalesce(F.concat(F.lit("@"), version), F.lit("")), F.coalesce(F.concat(F.lit(":"), name), F.lit("")))
    return F.struct(F.when(wrapped, data).otherwise(record).alias("payload"), F.when(wrapped, reference).alias("schema"))


def observed_records(rows: DataFrame, column: str = "record") -> DataFrame:
    """``(target, position, record, error)`` from observation results: the records of a target, or what it is now."""
    shape = "struct<target: string, current: string, error: string>"
    held = rows.select(F.from_json(column, shape).alias("o")).select("o.*")
    listed = F.from_json(F.get_json_object("current", "$.records"), "array<string>")
    records = F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array("current")))
    return held.select("target", F.posexplode_outer(records).alias("position", "record"), "error")


def manifest_rows(rows: DataFrame, column: str = "record") -> DataFrame:
    """``(entry_type, target, status, record)``: the manifest itself and each of its actions."""
    shape = "array<struct<target: string, status: string, verb: string>>"
    whole = rows.select(F.lit("manifest").alias("entry_type"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("status"), F.col(column).alias("record"))
    actions = rows.select(F.explode(F.from_json(F.get_json_object(column, "$.actions"), shape)).alias("a"))
    status = F.when(F.col("a.status") == "ok", "converging").when(F.col("a.status") == "failed", "failed").otherwise("unknown")
    return whole.unionByName(actions.select(F.lit("action").alias("entry_type"), F.regexp_replace("a.target", "^//", "").alias("target"), status.alias("status"), F.to_json("a").alias("record")))


# Writing ----------------------------------------------------------------------------------------


def export(records: DataFrame, path: str, kind: str, column: str = "record", keys: list[str] | None = None) -> None:
    """Writes JSON records as ndjson (or json), csv with the sorted union of keys, or yaml documents."""
    if kind in ("json", "ndjson"):
        records.select(column).write.text(path)
    elif kind == "csv":
        if keys is None:
            keys = sorted(r[0] for r in records.select(F.explode(F.json_object_keys(column))).distinct().collect())
        records.select(*(F.get_json_object(column, f"$['{k}']").alias(k) for k in keys)).write.option("header", True).csv(path)
    elif kind == "yaml":

        def dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import yaml

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(["---\n" + yaml.safe_dump(json.loads(r)).rstrip() for r in batch.column(0).to_pylist()], pa.string())], ["value"])

        records.select(column).mapInArrow(dump, "value string").write.text(path)
    else:
        raise ValueError(f"no export as {kind}")
