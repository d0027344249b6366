"""Document fingerprints as invertible Bloom lookup sketches.

A text is a multiset of digests of its paragraphs; a paragraph is cut further after words that end in certain
letters, so an edit changes only the digests around it. A digest falls into three cells, each in
its own third of the sketch; a cell keeps how many digests it holds, their exclusive or and that of their
checks. Subtracting the sketches of two versions leaves only what differs. Cells that hold a single digest
give it up and are peeled off, which frees others; if any remain, peeling failed and is retried with larger
sketches, sized by the spread of the counts and at least doubled. Likeness is twice the shared digests over all digests of both texts, or 1 for equal texts.

Cases: null text is the empty text, which has no digests and is like only another empty one (1) and nothing
else (0); repeats of a digest are told apart by their number; a text never fails, since sizes grow until
peeling succeeds; repeated rows and null ids have a place in the order like any other row, and the
texts of one id are ordered by their hash; ids are numbers; very long texts are taken whole; an empty table gives no
rows and extra columns are ignored. White space around a text and between pieces is no part of a digest, so texts that
differ in nothing else have a likeness of 1.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import input_partitions, pieces_of, ship

#: Cells of a fingerprint, a multiple of three.
CELLS = 48
#: Between paragraphs, and between the pieces of a paragraph.
_CUT = re.compile(rb"(?<=[dhsyDHSY.,!?\x81\x89\x91\x99\xa1\xa9\xb1\xb9])[\x20\t]+|\n")

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = (np.uint64(n) for n in (30, 27, 31))
_THREE = [np.uint64(n) for n in (0, 21, 42)]
_LOW = np.uint64(0x1FFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> _S30)
    x *= _MIX1
    x ^= x >> _S27
    x *= _MIX2
    x ^= x >> _S31
    return x


def paragraph_digests(text: str | None, seed: int = 7) -> np.ndarray:
    """A 64-bit digest of every piece of every paragraph; the k-th repeat of a piece has a digest of its own."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass").strip()
    digest = xxhash.xxh64_intdigest
    out = [digest(piece, seed) for piece in _CUT.split(raw) if piece]
    values = np.array(out, np.uint64)
    if len(values) < 2:
        return values
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    if len(starts) == len(ranked):
        return ranked
    repeat = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(ranked)]))))
    return np.where(repeat > 0, mix(ranked + repeat.astype(np.uint64) * _MIX2), ranked)


class Sketch:
    """Counts, sums of digests and sums of checks of ``cells`` cells."""

    def __init__(self, cells: int, counts: np.ndarray, sums: np.ndarray, checks: np.ndarray):
        self.cells, self.counts, self.sums, self.checks = cells, counts, sums, checks

    @staticmethod
    def places(digests: np.ndarray, cells: int) -> np.ndarray:
        """The cells of each digest in the first third, then those in the second and the last."""
        third = np.uint64(cells // 3)
        spread = mix(digests + _MIX1)
        parts = [(spread >> shift & _LOW) % third for shift in _THREE]
        parts[1] += third
        parts[2] += third + third
        return np.concatenate(parts).astype(np.int64)

    @classmethod
    def of(cls, digests: np.ndarray, cells: int) -> Sketch:
        return cls.difference(digests, digests[:0], cells)

    @classmethod
    def difference(cls, left: np.ndarray, right: np.ndarray, cells: int) -> Sketch:
        """The sketch of the left minus that of the right; sketches add up, so one is filled with both."""
        out = cls(cells, np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64))
        signs = np.ones(len(left) + len(right), np.int64)
        signs[len(left) :] = -1
        out.add(np.concatenate((left, right)) if len(right) else left, signs)
        return out

    def add(self, digests: np.ndarray, signs: np.ndarray) -> None:
        if not len(digests):
            return
        spots, checks = self.places(digests, self.cells), mix(digests ^ _MIX2)
        np.add.at(self.counts, spots, np.concatenate((signs, signs, signs)))
        np.bitwise_xor.at(self.sums, spots, np.concatenate((digests, digests, digests)))
        np.bitwise_xor.at(self.checks, spots, np.concatenate((checks, checks, checks)))

    def __sub__(self, other: Sketch) -> Sketch:
        return Sketch(self.cells, self.counts - other.counts, self.sums ^ other.sums, self.checks ^ other.checks)

    def apart(self) -> int:
        """About how many digests a difference holds, from the spread of its counts."""
        return int(np.dot(self.counts, self.counts)) // 3

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The digests only on the left and only on the right, or None where cells remain; empties the sketch.

        A difference of many more digests than cells cannot be peeled and is not begun.
        """
        if self.apart() > 1.5 * self.cells + 8:
            return None
        found, signs = [], []
        while True:
            pure = np.flatnonzero(np.abs(self.counts) == 1)
            sums = self.sums[pure]
            pure = pure[mix(sums ^ _MIX2) == self.checks[pure]]
            if not len(pure):
                break
            digests, at = np.unique(self.sums[pure], return_index=True)
            sign = self.counts[pure[at]]
            self.add(digests, -sign)
            found.append(digests)
            signs.append(sign)
        if self.counts.any() or self.sums.any() or self.checks.any():
            return None
        digests = np.concatenate(found) if found else np.empty(0, np.uint64)
        sign = np.concatenate(signs) if signs else np.empty(0, np.int64)
        return digests[sign > 0], digests[sign < 0]

    def dump(self) -> str:
        cells = np.zeros(self.cells, [("n", "<i4"), ("sum", "<u8"), ("check", "<u2")])
        cells["n"], cells["sum"], cells["check"] = self.counts, self.sums, self.checks & np.uint64(0xFFFF)
        return base64.b64encode(struct.pack("<I", self.cells) + cells.tobytes()).decode()


def differing(left: np.ndarray, right: np.ndarray, cells: int = CELLS, sketches: tuple[Sketch, Sketch] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests only on the left and only on the right, by sketches that grow until peeling succeeds."""
    rest = sketches[0] - sketches[1] if sketches else Sketch.difference(left, right, cells)
    while True:
        apart = rest.apart()  # before peeling empties it
        peeled = rest.peel()
        if peeled is not None:
            return peeled
        cells = max(2 * rest.cells, CELLS * -(-8 * apart // (5 * CELLS)))
        rest = Sketch.difference(left, right, cells)


def likeness(left: np.ndarray, right: np.ndarray, cells: int = CELLS, sketches: tuple[Sketch, Sketch] | None = None) -> float:
    total = len(left) + len(right)
    if not total:
        return 1.0
    a, b = differing(left, right, cells, sketches)
    return (total - len(a) - len(b)) / total


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the start of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def version_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Every text beside its edited version and the next text by ascending id; after the last comes the first.

    Ranges of ids and text hashes are cut by Spark's range partitioning of those two alone. Texts are then dealt once,
    to their ranges, and the first row of a range is also sent to the range before it, so each range is walked through
    on its own. That is one extra row for each range; the driver sees the first id and hash of each.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    tasks = input_partitions(spark) * 2
    ranges = tasks * 6  # several ranges a task even out
    slim = rows.select("_id", "_h").repartitionByRange(ranges, F.col("_id").asc_nulls_first(), "_h")
    heads = slim.withColumn("_pid", F.spark_partition_id()).groupBy("_pid").agg(F.min(F.struct(F.col("_id").isNotNull().alias("k"), F.col("_id").alias("i"), F.col("_h").alias("h"))).alias("head")).collect()
    cuts = sorted({(int(r["head"]["k"]), r["head"]["i"] if r["head"]["k"] else 0, r["head"]["h"]) for r in heads})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their range; a row that is the first of a range comes again for the range before (``_last`` 1), or for
        the last range (2)."""
        starts = {cut: k for k, cut in enumerate(cuts)}
        for batch in pieces_of(batches, 4096):
            names = [(0 if i is None else 1, i or 0, h) for i, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            home = pa.array([bisect_right(cuts, n) - 1 for n in names], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), home, pa.array([0] * len(names), pa.int32())], columns)
            first = {starts[n]: k for k, n in enumerate(names) if n in starts}  # one of equal rows
            if first:
                again = batch.take(pa.array(list(first.values())))
                before = [(part - 1) % len(cuts) for part in first]
                kinds = [1 if part else 2 for part in first]
                yield pa.RecordBatch.from_arrays([again.column(0), again.column(1), pa.array(before, pa.int32()), pa.array(kinds, pa.int32())], columns)

    columns = ["_id", "_text", "_part", "_last"]
    dealt = rows.mapInArrow(place, f"_id {kind}, _text string, _part int, _last int")
    dealt = dealt.repartition(tasks, "_part").sortWithinPartitions("_part", "_last", F.col("_id").asc_nulls_first(), F.xxhash64("_text"), "_text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            for id_, text, part, last in zip(*(c.to_pylist() for c in batch.columns)):
                digests = paragraph_digests(text)
                sketch = Sketch.of(digests, cells)
                if held is not None and held[2] == part:
                    prior_id, prior, _, prior_last, prior_digests, prior_sketch = held
                    if not prior_last:
                        changed = edited_text(prior, text)
                        changed_digests = paragraph_digests(changed)
                        changed_sketch = Sketch.of(changed_digests, cells)
                        out.append(
                            (
                                prior_id,
                                len(prior),
                                hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                prior_sketch.dump(),
                                changed_sketch.dump(),
                                likeness(prior_digests, changed_digests, cells, (prior_sketch, changed_sketch)),
                                likeness(prior_digests, digests, cells, (prior_sketch, sketch)),
                            )
                        )
                held = (id_, text, part, last, digests, sketch)
            if out:
                columns = list(zip(*out))
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out = dealt.mapInArrow(compare, f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("_id", id_col)

