"""Benchmark decontamination with one FM-index per training shard.

Each task cuts its documents into shards of bounded length. A shard's words become ids of the test
vocabulary; only runs of such words that are as long as the shortest window can hold an occurrence, and
they make up the indexed sequence. All windows are searched backwards at once, occurrences are located
through sampled suffix positions, and overlapping ones merge into removal spans of word places. Documents
are never shuffled and whole texts are searched.

Test items are read in blocks of a bounded number of windows, so what is broadcast at a time has a fixed
bound; with more than one block, the spans of a document from all of them are merged by row.

Cases: null texts have no words; items without words have no window; items that share a text are all
reported; an item id that is null is reported as "null"; repeated document rows each get a row; either
table may be empty; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import ALNUM_WORDS, Scratch, lower_bytes, pieces_of, ship
from lakeloom.llm.fm_index import FMIndex

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Windows of a block of test items, and words of a shard.
BLOCK_WINDOWS, SHARD_WORDS = 50_000, 1_000_000


class Windows:
    """The distinct windows of a block of items as rows of word ids, with the items that hold each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        vocabulary: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], dict[str, None]] = {}
        for item, words in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
            for at in range(max(1, len(ids) - width + 1)):
                rows.setdefault(tuple(ids[at : at + width]), {})[item] = None
        self.vocabulary = vocabulary
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.shortest = int(self.lengths.min(initial=width))
        self.patterns = np.zeros((len(rows), width), np.int64)
        for k, row in enumerate(rows):
            self.patterns[k, : len(row)] = row
        self.names = list(dict.fromkeys(item for item, _ in items))
        number = {name: k for k, name in enumerate(self.names)}
        self.holders = np.array([number[i] for held in rows.values() for i in held], np.int64)
        self.held_from = np.concatenate(([0], np.cumsum([len(held) for held in rows.values()]))).astype(np.int64)


def window_blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, limit: int) -> Iterator[Windows]:
    """Blocks of items; the driver holds one at a time."""
    held, windows = [], 0
    for item, text in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col)).toLocalIterator():
        words = ALNUM_WORDS.findall(lower_bytes(text))
        if not words:
            continue
        held.append((item, words))
        windows += max(1, len(words) - width + 1)
        if windows >= limit:
            yield Windows(held, width)
            held, windows = [], 0
    if held:
        yield Windows(held, width)


def long_runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of non-zero ids of at least this length: starts and ends."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).astype(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= shortest
    return starts[keep], ends[keep]


def occurrences(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence in a shard, whose documents are divided by zeros."""
    starts, ends = long_runs(ids, windows.shortest)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = ends - starts
    offset = np.cumsum(lengths + 1) - lengths  # place of each run in the sequence, after the first separator
    sequence = np.zeros(int(lengths.sum()) + len(lengths) + 1, np.int64)
    inside = np.repeat(offset - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(int(lengths.sum()))
    origin = np.repeat(starts - offset, lengths)
    sequence[inside] = ids[inside + origin]
    moved = np.zeros(len(sequence), np.int64)
    moved[inside] = origin
    index = FMIndex(sequence, len(windows.vocabulary) + 1)
    low, high = index.search(windows.patterns, windows.lengths)
    found = np.flatnonzero(high > low)
    counts = (high - low)[found]
    rows = np.repeat(low[found] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
    places = index.locate(rows)
    return places + moved[places], np.repeat(found, counts)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _shard(texts: list[str | None], windows: Windows) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """Per document of a shard: words, spans and items."""
    get = windows.vocabulary.get
    parts, sizes = [], []
    gap = np.zeros(1, np.int32)
    for text in texts:
        words = ALNUM_WORDS.findall(lower_bytes(text))
        parts += [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)), gap]
        sizes.append(len(words))
    ids = np.concatenate(parts) if parts else gap
    begins = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)))
    places, which = occurrences(ids, windows)
    spans: list[list[dict]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if len(places):
        delta = np.zeros(len(ids) + 1, np.int64)
        np.add.at(delta, places, 1)
        np.add.at(delta, places + windows.lengths[which], -1)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(delta) > 0).astype(np.int8), [0]))))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            doc = int(np.searchsorted(begins, start, "right")) - 1
            spans[doc].append({"start": start - int(begins[doc]), "end": end - int(begins[doc])})
        pairs = np.unique(np.stack((np.searchsorted(begins, places, "right") - 1, which)), axis=1)
        for doc, window in pairs.T.tolist():
            items[doc] += windows.holders[windows.held_from[window] : windows.held_from[window + 1]].tolist()
        items = [[windows.names[k] for k in dict.fromkeys(held)] for held in items]
    return sizes, spans, items


def searcher(windows, columns: list[str]):
    """``windows``: a broadcast :class:`Windows`; ``columns`` go through, and the text comes after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.RecordBatch] = []
        texts: list[str | None] = []
        held = 0

        def out() -> pa.RecordBatch:
            sizes, spans, items = _shard(texts, windows.value)
            held = pa.Table.from_batches(carried).combine_chunks().to_batches()[0]
            found = [pa.array(sizes, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*held.columns[:-1], *found], [*columns, "n_words", "spans", "items"])

        for batch in pieces_of(batches, 64):
            carried.append(batch)
            fresh = batch.column(batch.num_columns - 1).to_pylist()
            texts += fresh
            held += sum(len(t) // 4 for t in fresh if t)
            if held >= SHARD_WORDS:
                yield out()
                carried, texts, held = [], [], 0
        if texts:
            yield out()

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, n_words, spans, items)``: merged spans of words [start, end) inside occurrences, and whose."""
    spark = docs.sparkSession
    ship(spark)
    blocks = [spark.sparkContext.broadcast(w) for w in window_blocks(benchmark, item_col, item_text_col, width, block_windows)]
    if not blocks:
        blocks = [spark.sparkContext.broadcast(Windows([], width))]
    columns = [id_col, *(c for c in keep if c != id_col)]
    result = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"

    def search(rows: DataFrame, carried: list[str], block) -> DataFrame:
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
        return rows.mapInArrow(searcher(block, carried), f"{kinds}, {result}")

    if len(blocks) == 1:
        return search(docs.select(*columns, F.col(text_col).alias("_searched_text")), columns, blocks[0])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *columns, F.col(text_col).alias("_searched_text"))
    rows = Scratch(spark, "decontaminate").save(rows, "rows")
    found = reduce(DataFrame.unionByName, (search(rows.select("_row", "_searched_text"), ["_row"], b) for b in blocks))
    merged = found.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in merge_spans([(s["start"], s["end"]) for s in held])] for held in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, SPANS), batch.column(3)], ["_row", "n_words", "spans", "items"])

    merged = merged.mapInArrow(merge, f"_row long, {result}")
    return rows.select("_row", *columns).join(merged, "_row").select(*columns, "n_words", "spans", "items")


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of these spans, and without what stands between the words of one span."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in ALNUM_WORDS.finditer(raw.lower())]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")
