"""Packing tokenised documents into fixed-length training sequences.

A document's ids are cut into whole sequences and a remainder. Remainders are counted by length, rounded up
to a grid, and the cutting-stock plan of that histogram says how many sequences of which pattern to make.
Pieces are ranked within their length class, and ranks are dealt to the places of the patterns.

Ranks come from counts per written partition and class, so a length that a third of the pieces share is
spread like any other. The plan has a fixed bound (see :mod:`lakeloom.llm.cutting_stock`).

Cases: null text is the empty text, whose only id is the end; repeated rows are packed each; an empty table
gives no rows; columns beside those asked for are ignored; texts of any length are encoded whole, also single words
or runs of white space of millions of characters; ``pack`` refuses tables with a column of a name it adds.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, pieces_of, ship
from lakeloom.llm.cutting_stock import plan

#: The public pre-tokenisation pattern of byte-level BPE.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which that pattern splits alike in both libraries; texts with others take the slower one.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u2010-\u2027]*")
#: Runs of white space that the library with ranks would follow too deep.
_DEEP = re.compile(r"(?<!\s)\s{10000}")

_ENCODERS: dict[str, Encoder] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a file.

    A byte-level BPE whose ids are in the order of its merges is the same as ranks over byte strings, which
    tiktoken encodes several times as fast; it takes texts of plain characters without special strings, and
    the tokenizers library itself takes all others.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.quick = self._ranked(json.load(f))

    def _ranked(self, spec: dict):
        """The tiktoken encoding of the same vocabulary, if the file has one."""
        model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        letters, vocabulary = byte_letters(), model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merged = [vocabulary.get(a + b, -1) for a, b in pairs]
        if any(x >= y for x, y in zip(merged, merged[1:])) or min(merged, default=0) < len(letters) or any(c not in vocabulary for c in letters):
            return None
        names = [*letters, *(a + b for a, b in pairs)]
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks={bytes(letters[c] for c in n): vocabulary[n] for n in names}, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.quick is not None and _PLAIN.fullmatch(text) and not _DEEP.search(text) and not any(s in text for s in self.special):
            with contextlib.suppress(Exception), _panics():
                return np.array(self.quick.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@contextlib.contextmanager
def _panics() -> Iterator[None]:
    """Turns a panic of a native library, which no handler of exceptions sees, into an exception."""
    try:
        yield
    except BaseException as e:
        if type(e).__name__ == "PanicException":
            raise RuntimeError(str(e)) from e
        raise


def load_encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def document_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, length, doc_tokens, ids)``: every document's ids and an end, cut at multiples of the capacity."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer_path)
        for batch in pieces_of(batches, 256):
            row, start, length, total, ids = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = encoder.encode(text or "") + end
                n = len(raw) // 4
                for at in range(0, n, capacity):
                    row.append(k)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    total.append(n)
                    ids.append(raw[4 * at : 4 * (at + capacity)])
            columns = [batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "start", "length", "doc_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, start long, length long, doc_tokens long, ids binary")
    return out.withColumnRenamed("_id", id_col)


def pack(pieces: DataFrame, capacity: int = 1024, grid: int = 4) -> DataFrame:
    """``pieces`` with a ``length`` of at most the capacity, each with its ``sequence_id`` and ``offset`` there."""
    if capacity % grid:
        raise ValueError("the grid must divide the capacity")
    columns = pieces.columns
    if clash := {"_serial", "_class", "_part", "_rank", "_slot", "_before", "_n", "sequence_id", "offset"}.intersection(columns):
        raise ValueError(f"columns {sorted(clash)} are added here and must not be in the table")
    scratch = Scratch(pieces.sparkSession, "packing")
    serial = F.monotonically_increasing_id()
    rows = pieces.withColumn("_serial", serial).withColumn("_class", F.ceil(F.col("length") / grid).cast("int"))
    rows = scratch.save(rows.withColumn("_part", F.shiftright("_serial", 33)), "pieces")

    counts = scratch.save(rows.groupBy("_part", "_class").agg(F.count(F.lit(1)).alias("_n")), "counts")
    histogram = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    full = capacity // grid
    whole = histogram.pop(full, 0)  # each fills a sequence, or nearly
    patterns = plan(histogram, full)

    # Runs of ranks of a class: rank r from ``start`` on goes to sequence ``base`` + r - start, place ``slot``.
    runs: dict[int, list[tuple[int, int, int]]] = {full: [(0, 0, 0)]}
    dealt: dict[int, int] = {}
    base = whole
    for pattern in patterns:
        for slot, size in enumerate(pattern.sizes):
            start = dealt.get(size, 0)
            runs.setdefault(size, []).append((start, base, slot))
            dealt[size] = start + pattern.uses
        base += pattern.uses
    tables = {c: tuple(np.array(x, np.int64) for x in zip(*r)) for c, r in runs.items()}

    earlier = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_class", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part", "_class").orderBy("_serial")
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["_part", "_class"])
    ranked = ranked.select(*columns, "_class", (F.col("_rank") + F.col("_before")).alias("_rank"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for c in np.unique(sizes):
                at = np.flatnonzero(sizes == c)
                starts, bases, slots = tables[int(c)]
                run = np.searchsorted(starts, rank[at], "right") - 1
                sequence[at] = bases[run] + rank[at] - starts[run]
                slot[at] = slots[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(slot)], [*columns, "sequence_id", "_slot"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt_rows = ranked.mapInArrow(deal, f"{kinds}, sequence_id long, _slot long")
    so_far = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return dealt_rows.withColumn("offset", F.coalesce(F.sum("length").over(so_far), F.lit(0))).drop("_slot")
