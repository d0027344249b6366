"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints are 64 majority bits of the XXH64 of word shingles. Two fingerprints within ``radius`` bits
agree on all but ``radius`` of the 8-bit bands they are cut into, so every choice of 8 - radius bands names
a block that must hold a linked pair: no link is missed. With the default radius a block's members share
48 bits, so no block can hold more than 65,536 distinct fingerprints, however many documents there are.

Within a block, bit planes are stored vertically: plane k is one integer whose bit i is bit k of member i.
A member is compared with all others at once: each plane, inverted where the member's own bit is set, is
added to carry-save counters (ones, twos, ...) with bitwise operations, eight planes at a time; then lanes past
the radius are marked over, and the block is abandoned once every lane is over. Links inside a block are reported as a spanning
forest, so output is linear in the members.

Cases: null text is the empty text; a text without words has fingerprint zero, linked like any other;
texts shorter than a shingle hash their whole word sequence; equal fingerprints (copies) are compared once;
null ids sort last and never name a component that holds another id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import SPACE_WORDS, Scratch, input_partitions, lower_bytes, pieces_of, ship
from lakeloom.llm.components import components

BANDS, BAND_BITS = 8, 8
_LANES = 4096
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each space-joined shingle of lower-cased words, repeats included, in reading order."""
    found = SPACE_WORDS.findall(lower_bytes(text))
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], np.uint64)
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; zero where there are none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        raw = np.ascontiguousarray(hashes[at : at + _CHUNK].astype(">u8")).view(np.uint8)
        counts += np.unpackbits(raw).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprinter(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 512):
            prints = [majority(shingle_hashes(t, words, seed)) for t in batch.column(1).to_pylist()]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["_id", "_fp"])

    return run


def _add(a: int, b: int, c: int) -> tuple[int, int]:
    """Carry-save: the carries and sums of three planes, lane by lane."""
    u = a ^ b
    return a & b | u & c, u ^ c


class Block:
    """Distinct fingerprints of one block as vertical bit planes, in lanes of bounded width.

    Bits in which no members differ have no plane, unless ``bits`` says how many there are: then queries may be others.
    """

    def __init__(self, members: list[int], radius: int, bits: int = 0):
        self.members, self.radius = members, radius
        varied = (1 << bits) - 1
        for x in members:
            varied |= x ^ members[0]
        width = max(1, (bits + 7) // 8, *((x.bit_length() + 7) // 8 for x in members))
        self.slices = []
        for at in range(0, len(members), _LANES):
            lane = members[at : at + _LANES]
            full = (1 << len(lane)) - 1
            raw = np.frombuffer(b"".join(x.to_bytes(width, "little") for x in lane), np.uint8).reshape(-1, width)
            packed = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
            planes = [(b, (plane := int.from_bytes(packed[b].tobytes(), "little"), plane ^ full)) for b in range(varied.bit_length()) if varied >> b & 1]
            planes += [(0, (0, 0))] * (-len(planes) % 8)
            self.slices.append((at, len(lane), planes))

    def within(self, query: int, at: int, radius: int | None = None) -> int:
        """The members of slice ``at`` within the radius, as a bit mask over its lanes."""
        _, n, planes = self.slices[at]
        limit = self.radius if radius is None else radius
        full = (1 << n) - 1
        ones = twos = fours = over = 0
        high = [0] * (limit.bit_length() - 3)
        for k in range(0, len(planes), 8):  # eight planes into the counters at a time
            a, b, c, d, e, f, g, h = [pair[query >> bit & 1] for bit, pair in planes[k : k + 8]]
            two_a, ones = _add(ones, a, b)
            two_b, ones = _add(ones, c, d)
            four_a, twos = _add(twos, two_a, two_b)
            two_a, ones = _add(ones, e, f)
            two_b, ones = _add(ones, g, h)
            four_b, twos = _add(twos, two_a, two_b)
            carry, fours = _add(fours, four_a, four_b)
            for i in range(len(high)):
                high[i], carry = high[i] ^ carry, high[i] & carry
            over |= carry | self._past([ones, twos, fours, *high], limit, full)
            if over == full:
                return 0
        return ~over & full

    @staticmethod
    def _past(counters: list[int], limit: int, full: int) -> int:
        """Lanes whose counter is over the limit, compared from the highest bit down."""
        greater, equal = 0, full
        for k in reversed(range(len(counters))):
            if limit >> k & 1:
                equal &= counters[k]
            else:
                greater |= equal & counters[k]
                equal &= ~counters[k]
        return greater

    def forest(self) -> list[tuple[int, int]]:
        """Links that join all members connected within the radius: at most one less than there are members."""
        n = len(self.members)
        if n == 2:
            a, b = self.members
            return [(a, b)] if self.within(a, 0) == 3 else []
        parent = list(range(n))
        own: dict[int, list[int]] = {}

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def lanes(root: int) -> list[int]:
            if root not in own:
                own[root] = [1 << (root - at) if at <= root < at + k else 0 for at, k, _ in self.slices]
            return own[root]

        out = []
        for i, query in enumerate(self.members):
            for s, (at, _, _) in enumerate(self.slices):
                fresh = self.within(query, s) & ~lanes(find(i))[s]
                while fresh:
                    j = at + (fresh & -fresh).bit_length() - 1
                    a, b = find(i), find(j)
                    out.append((query, self.members[j]))
                    ma, mb = lanes(a), lanes(b)
                    parent[b] = a
                    own[a] = [x | y for x, y in zip(ma, mb)]
                    del own[b]
                    fresh &= ~own[a][s]
        return out


def block_linker(radius: int):
    """Over rows sorted by (combo, key): the forest of every block of at least two members."""

    def links(key: tuple, members: list[int]) -> list[tuple[int, int]]:
        return Block(members, radius).forest() if len(members) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            combo, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.flatnonzero((combo[1:] != combo[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(fp)]))
            prints = fp.view(np.uint64)
            out: list[tuple[int, int]] = []
            first = (int(combo[0]), int(key[0]))
            if first == held_key:
                held += prints[: ends[0]].tolist()
                if len(ends) > 1:
                    out += links(held_key, held)
            else:
                out += links(held_key, held)
                held = prints[: ends[0]].tolist()
                if len(ends) > 1:
                    out += links(first, held)
            if len(ends) > 1:
                for k in np.flatnonzero((ends - starts)[1:-1] > 1) + 1:
                    out += links((), prints[starts[k] : ends[k]].tolist())
                held = prints[starts[-1] :].tolist()
            held_key = (int(combo[-1]), int(key[-1]))
            if out:
                yield _link_batch(out)
        if out := links(held_key, held):
            yield _link_batch(out)

    return run


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """Spanning links ``(a, b)`` of the distinct fingerprints ``prints(_fp)`` within the radius."""
    band = (1 << BAND_BITS) - 1
    masks = []
    for kept in combinations(range(BANDS), BANDS - radius):
        masks.append(_signed(sum(band << (BAND_BITS * k) for k in kept)))
    keys = F.explode(F.array([F.struct(F.lit(i).cast("int").alias("combo"), F.col("_fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    blocks = prints.select("_fp", keys.alias("_k")).select("_k.combo", "_k.key", "_fp")
    blocks = blocks.repartition(input_partitions(prints.sparkSession), "combo", "key").sortWithinPartitions("combo", "key")
    return blocks.mapInArrow(block_linker(radius), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 5, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)``: documents grouped by chains of fingerprints within the radius."""
    if not 0 <= radius < BANDS:
        raise ValueError(f"radius must be from 0 to {BANDS - 1}")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "simhash")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = scratch.save(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(fingerprinter(words, seed), f"_id {id_type}, _fp long"), "prints")
    distinct = scratch.save(rows.groupBy("_fp").agg(F.min("_id").alias("_first")), "distinct")
    roots = components(scratch.save(fingerprint_links(distinct.select("_fp"), radius), "found"))
    named = distinct.join(roots, distinct["_fp"] == roots["node"], "left").select("_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    named = scratch.save(named, "named")
    firsts = scratch.save(named.groupBy("_root").agg(F.min("_first").alias("component_id")), "firsts")
    mapping = scratch.save(named.join(firsts, "_root").select("_fp", "component_id"), "mapping")
    hexed = F.lower(F.lpad(F.hex("_fp"), 16, "0"))
    return rows.join(mapping, "_fp").select(F.col("_id").alias(id_col), hexed.alias("fingerprint"), "component_id")
