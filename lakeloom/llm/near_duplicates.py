"""Near-duplicate groups by word-shingle similarity, through SimHash fingerprints compared bit-sliced.

Texts with the same set of shingles are one member. A member has a 128-bit SimHash of its distinct shingles and
seven minima of re-scrambled shingle hashes; members that share any two minima meet in a block. At a similarity
of 0.8 a pair misses all its 21 blocks with a chance of 4 in 10,000, above 0.9 with less than one in a million.
In a block the fingerprints are compared by bit planes (see :mod:`lakeloom.llm.simhash`), and the links that first
connect two parts are reported, at most as many as members, so that large groups never produce all their pairs.
They make loose groups, in which the shingle sets come together once, and every pair within the radius that is
not connected yet is checked by its exact similarity. Checked links make the groups.

No task holds a whole block or loose group. One of more than ``TILE`` members or ``SHINGLES`` shingles is dealt into parts by hash, and
compared in units: a part with itself, and a part that is held with another that streams past it, so that every
pair meets in one unit. In a large loose group the parts are first compared with themselves and along the links
that were reported; every member outside the largest group so found is then compared with all members of other
groups, in units. Sizes decide only how the pairs are dealt over tasks, never which pairs are compared.

Cases: null text is the empty text; texts without words have equal, empty sets and form one group; shorter
texts have their whole word sequence as their only shingle; very long texts have sets as long as they are; repeated
rows form a group and one row stays; an empty table stays empty; further columns are carried along, and may not be
named ``_row`` or ``_group`` (an error says so).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import Scratch, input_partitions, pieces_of, ship
from lakeloom.llm.components import components
from lakeloom.llm.simhash import Block, majority, shingle_hashes

MINIMA = 7
#: Members, and shingles of their sets, of a part.
TILE, SHINGLES = 2048, 4_000_000
#: Differing bits of 128. At a similarity of 0.8, 19 bits differ on average, and over 42 of them with a chance of 2 in
#: 10 million. Sets of 4 and 5 shingles are the worst: 24 bits on average, over 42 with a chance of 5 in 100,000.
#: The first radius joins most near copies, so that few pairs are left to compare at the second.
RADII = (22, 42)

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def describer(words: int):
    """Rows (key, text) to (key, member, size of its set, fingerprint halves, block keys)."""
    pairs = list(combinations(range(MINIMA), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 256):
            member, size, high, low, keys = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, words)
                member.append(xxhash.xxh64_intdigest(found.tobytes(), 3))
                size.append(len(found))
                high.append(majority(scramble(found, 101)))
                low.append(majority(scramble(found, 102)))
                least = [int(scramble(found, k + 1).min()) if len(found) else 0 for k in range(MINIMA)]
                keys.append([xxhash.xxh64_intdigest(b"%d,%d,%d,%d" % (a, least[a], b, least[b]), 9) for a, b in pairs])
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            flat = np.array(keys, np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * len(pairs)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(member), pa.array(size, pa.int64()), signed(high), signed(low), lists], ["_row", "member", "size", "high", "low", "keys"])

    return run


class Unit:
    """Members held in order of their size, compared with themselves or with members that stream past them.

    With shingle sets, a link is a pair whose sets are alike; without them, a pair within the radius whose sizes
    allow the similarity. Only pairs that links do not connect yet are compared exactly.
    """

    def __init__(self, similarity: float):
        self.similarity = similarity
        self.members: list[int] = []
        self.roots: list[int] = []
        self.prints: list[int] = []
        self.sizes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.block: Block | None = None
        self.above: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def hold(self, member: int, root: int, fingerprint: int, size: int, shingles: np.ndarray | None) -> None:
        self.members.append(member)
        self.roots.append(root)
        self.prints.append(fingerprint)
        self.sizes.append(size)
        if shingles is not None:
            self.sets.append(shingles)

    def find(self, r: int) -> int:
        while (up := self.above.get(r, r)) != r:
            self.above[r] = self.above.get(up, up)
            r = up
        return r

    def _ready(self) -> None:
        self.block = Block(self.prints, RADII[-1], bits=128)
        self.bounds = np.array(self.sizes)
        self.lanes: dict[int, int] = {}  # held members of a part, by its root
        for k, root in enumerate(self.roots):
            self.lanes[root] = self.lanes.get(root, 0) | 1 << k
        if self.sets:
            self.starts = np.concatenate(([0], np.cumsum(self.bounds)))
            self.names, self.local = np.unique(np.concatenate(self.sets), return_inverse=True)
            self.mark = np.zeros(len(self.names) + 1, np.int32)

    def _alike(self, shingles: np.ndarray, lanes: int) -> list[int]:
        """Those of the lanes whose sets are alike to the given one, compared together."""
        raw = np.frombuffer(lanes.to_bytes((len(self.members) + 7) // 8, "little"), np.uint8)
        at = np.flatnonzero(np.unpackbits(raw, bitorder="little"))
        if not len(shingles):
            return at.tolist()  # only equal, empty sets have the size
        spots = np.searchsorted(self.names, shingles)
        spots[spots == len(self.names)] = 0
        spots = spots[self.names[spots] == shingles]
        self.mark[spots] = 1
        if len(at) < 8:
            both = np.array([self.mark[self.local[self.starts[k] : self.starts[k + 1]]].sum() for k in at.tolist()])
        else:
            sums = np.concatenate(([0], np.cumsum(self.mark[self.local[self.starts[at[0]] : self.starts[at[-1] + 1]]])))
            both = sums[self.starts[at + 1] - self.starts[at[0]]] - sums[self.starts[at] - self.starts[at[0]]]
        self.mark[spots] = 0
        return at[both >= self.similarity * (len(shingles) + self.bounds[at] - both) - 1e-9].tolist()

    def _compare(self, member: int, root: int, fingerprint: int, size: int, shingles: np.ndarray | None, lanes: int, radius: int) -> None:
        low = int(np.searchsorted(self.bounds, self.similarity * size - 1e-9))
        high = int(np.searchsorted(self.bounds, size / self.similarity + 1e-9, "right"))
        lanes &= (1 << high) - (1 << low)
        lanes &= ~self.lanes.get(self.find(root), 0)
        near = 0
        if lanes > 0:
            for s, (at, _, _) in enumerate(self.block.slices):
                near |= self.block.within(fingerprint, s, radius) << at
        fresh = near & lanes
        if not fresh:
            return
        if shingles is None:
            while fresh:
                k = (fresh & -fresh).bit_length() - 1
                self._join(member, root, k)
                fresh &= ~self.lanes[self.find(root)]
        else:
            for k in self._alike(shingles, fresh):
                self._join(member, root, k)

    def _join(self, member: int, root: int, k: int) -> None:
        a, b = self.find(root), self.find(self.roots[k])
        if a != b:
            self.above[b] = a
            self.lanes[a] = self.lanes.get(a, 0) | self.lanes.pop(b, 0)
            self.links.append((member, self.members[k]))

    def with_itself(self) -> list[tuple[int, int]]:
        self._ready()
        for radius in RADII:
            if len(self.lanes) < 2:
                break
            for k, row in enumerate(zip(self.members, self.roots, self.prints, self.sizes, self.sets or [None] * len(self.members))):
                self._compare(*row, (1 << k) - 1, radius)
        return self.links

    def with_others(self, rows: list[tuple]) -> list[tuple[int, int]]:
        if self.block is None:
            self._ready()
        self.links = []
        for radius in RADII:
            for row in rows:
                self._compare(*row, (1 << len(self.members)) - 1, radius)
        return self.links


def linker(similarity: float, exact: bool):
    """Over rows (group, j, i, side, size, member, root, high, low, and shingles if exact) sorted in that order: the
    links of every unit. Side 0 is held, side 1 streams past it; where i is j, side 0 is compared with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        unit = Unit(similarity)
        out: list[tuple[int, int]] = []

        def finish() -> None:
            if held and held[1] == held[2] and len(unit.members) > 1:
                out.extend(unit.with_itself())

        for batch in pieces_of(batches, 512 if exact else 1 << 20):
            group, j, i, side, size, member, root, high, low = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(9))
            high, low = high.view(np.uint64), low.view(np.uint64)
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (j[1:] != j[:-1]) | (i[1:] != i[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(group)]))
            for k in np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(group))).tolist():
                s, e = int(starts[k]), int(ends[k])
                if (name := (group[s], j[s], i[s])) != held:
                    finish()
                    held, unit = name, Unit(similarity)
                sets = [np.frombuffer(x, np.uint64) for x in batch.column(9).slice(s, e - s).to_pylist()] if exact else [None] * (e - s)
                prints = [h << 64 | w for h, w in zip(high[s:e].tolist(), low[s:e].tolist())]
                rows = list(zip(member[s:e].tolist(), root[s:e].tolist(), prints, size[s:e].tolist(), sets))
                first = int(np.searchsorted(side[s:e], 1))
                for row in rows[:first]:
                    unit.hold(*row)
                if first < len(rows) and unit.members:
                    out.extend(unit.with_others(rows[first:]))
            if out:
                yield _pairs(out)
                out = []
        finish()
        if out:
            yield _pairs(out)

    return run


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with ``p``, ``few`` and ``many`` to a row for each unit of theirs: part p is one of ``few`` that are held,
    against themselves and every later part, or one of ``many`` that only stream past those."""
    place = lambda j, i, side: F.struct(j.cast("long").alias("j"), i.cast("long").alias("i"), F.lit(side).alias("side"))
    p, few, many = (F.col(c) for c in ("p", "few", "many"))
    upto = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    holds = F.transform(upto(p, F.when(p < few, few + many - 1).otherwise(-1)), lambda i: place(p, i, 0))
    passes = F.transform(upto(F.lit(0).cast("long"), F.least(p, few) - 1), lambda j: place(j, p, 1))
    return rows.select("*", F.explode(F.concat(holds, passes)).alias("_u")).select("*", "_u.*").drop("_u", "p", "few", "many")


_UNIT = ["group", "j", "i", "side", "size", "member", "root", "high", "low"]


def unit_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links of the units in ``rows``, which have the columns ``_UNIT`` and may have ``shingles``."""
    exact = "shingles" in rows.columns
    rows = rows.select(*_UNIT, *(["shingles"] if exact else []))
    rows = rows.repartition(input_partitions(rows.sparkSession), "group", "j", "i").sortWithinPartitions(*_UNIT[:6])
    return rows.mapInArrow(linker(similarity, exact), "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], ["a", "b"])


def set_builder(words: int):
    """Rows (member, text, ...) to (member, shingles, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 256):
            sets = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), *batch.columns[2:]], ["member", "shingles", *batch.schema.names[2:]])

    return run


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the similarity of two sorted sets reaches the threshold."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def checker(similarity: float):
    """Rows (a, b, x, y) to the links whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 512):
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            mask = pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def links_between(scratch: Scratch, sets: DataFrame, checked: DataFrame, similarity: float) -> DataFrame:
    """Links of alike members that ``checked`` leaves apart, in the loose groups of ``sets``. Members of the largest
    group of each are not compared with one another; all other pairs are, in units of one part against another."""
    roots = components(checked)
    rooted = sets.join(roots, F.col("member") == F.col("node"), "left").select("group", "member", "size", F.coalesce("root", "member").alias("root"))
    rooted = scratch.save(rooted, "rooted")
    counts = scratch.save(rooted.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")), "counts")
    plan = counts.groupBy("group").agg(F.max(F.struct("n", "root", "s")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    plan = plan.select("group", F.col("most.root").alias("main"), (F.col("n") - F.col("most.n")).alias("n"), (F.col("s") - F.col("most.s")).alias("s"), "most").where("n > 0")
    parts = plan.select("group", "main", _parts("n", "s").alias("few"), _parts("most.n", "most.s").alias("many"))
    placed = rooted.join(scratch.save(parts, "parts"), "group")
    h = F.xxhash64("member", F.lit(1))
    placed = placed.withColumn("p", F.when(F.col("root") != F.col("main"), F.pmod(h, "few")).otherwise(F.col("few") + F.pmod(h, "many")))
    units = dealt(placed.select("member", "root", "p", "few", "many"))
    units = units.join(sets.select("member", "group", "size", "high", "low", "shingles"), "member")
    return unit_links(units, similarity)


def _parts(n: str, size: str) -> F.Column:
    """How many parts so many members with so many shingles are dealt into."""
    return F.greatest(F.ceil(F.col(n) / TILE), F.ceil(F.col(size) / SHINGLES), F.lit(1)).cast("long")


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_row``, a number of each row, and ``_group``, equal for rows linked by near copies."""
    spark = docs.sparkSession
    ship(spark)
    if clash := {"_row", "_group"}.intersection(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are added here and must not be in the table")
    scratch = Scratch(spark, "near-duplicates")
    rows = scratch.save(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    described = rows.select("_row", F.col(text_col).alias("_text")).mapInArrow(describer(words), "_row long, member long, size long, high long, low long, keys array<long>")
    described = scratch.save(described, "described")
    distinct = described.groupBy("member").agg(F.min("_row").alias("_row"))
    distinct = scratch.save(distinct, "distinct")

    # One row of every member stands for it.
    standing = described.join(distinct.select("_row"), "_row", "left_semi")
    blocks = standing.select(F.explode("keys").alias("group"), "size", "member", "high", "low")
    hot = blocks.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    hot = scratch.save(hot.select("group", F.ceil(F.col("n") / TILE).cast("long").alias("few")), "hot")
    blocks = blocks.join(hot, "group", "left").withColumn("few", F.coalesce("few", F.lit(1).cast("long"))).withColumn("many", F.lit(0).cast("long"))
    blocks = dealt(blocks.withColumn("p", F.pmod(F.xxhash64("member"), "few"))).withColumn("root", F.col("member"))
    links = scratch.save(unit_links(blocks, similarity).distinct(), "candidates")

    # Loose groups, in parts of bounded size.
    loose = components(links).join(distinct, F.col("node") == F.col("member")).join(described.select("_row", "size", "high", "low"), "_row")
    loose = scratch.save(loose.select("_row", "member", F.col("root").alias("group"), "size", "high", "low"), "loose")
    sizes = loose.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    sizes = scratch.save(sizes.select("group", _parts("n", "s").alias("few")), "sizes")
    texts = rows.select("_row", F.col(text_col).alias("_text")).join(loose.join(sizes, "group"), "_row")
    texts = texts.select("member", "_text", "group", "size", "high", "low", "few")
    sets = scratch.save(texts.mapInArrow(set_builder(words), "member long, shingles binary, group long, size long, high long, low long, few long"), "sets")
    own = F.pmod(F.xxhash64("member"), "few").alias("j")
    found = unit_links(sets.select("group", own, own.alias("i"), F.lit(0).alias("side"), "size", "member", F.col("member").alias("root"), "high", "low", "shingles"), similarity)
    if sizes.where("few > 1").limit(1).count():
        large = sets.where("few > 1")
        across = links.join(large.select(F.col("member").alias("a"), F.col("shingles").alias("x")), "a").join(large.select(F.col("member").alias("b"), F.col("shingles").alias("y")), "b")
        across = across.select("a", "b", "x", "y").mapInArrow(checker(similarity), "a long, b long")
        checked = scratch.save(found.unionByName(across), "checked")
        checked = checked.unionByName(scratch.save(links_between(scratch, large, checked, similarity), "between"))
    else:
        checked = scratch.save(found, "checked")
    scratch.drop("sets")

    roots = components(checked)
    groups = described.select("_row", "member").join(roots, F.col("member") == F.col("node"), "left").select("_row", F.coalesce("root", "member").alias("_group"))
    groups = scratch.save(groups, "groups")
    scratch.drop("described")
    return rows.join(groups, "_row")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` for one row of each group of near copies: that of the smallest id."""
    grouped = near_duplicate_groups(docs, words, similarity, text_col)
    scratch = Scratch(docs.sparkSession, "one-of-each")
    first = grouped.groupBy("_group").agg(F.min(F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("_row"))).alias("m")).select(F.col("m._row").alias("_row"))
    return grouped.join(scratch.save(first, "kept"), "_row", "left_semi").select(*docs.columns)
