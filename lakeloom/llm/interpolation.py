"""Deleted interpolation: a trigram model whose estimates are mixed by how often the context was seen.

P(w | u, v) = l(u, v) c(u, v, w) / c(u, v) + (1 - l(u, v)) P(w | v), P(w | v) = m(v) c(v, w) / c(v) + (1 - m(v)) P(w), and
P(w) = n c(w) / N + (1 - n) / (V + 1), where l and m depend on the bucket of the context's count, its power of two.
The weights are learned by expectation-maximisation, from the lowest order up: part of the training documents is
deleted from the counts, and the weights are chosen to make that part likely. The final counts are those of all
training documents.

Texts are cut into chunks of ``CHUNK_TOKENS`` tokens, a longer text into several, each of which begins with the two
words before it. A chunk sends each distinct word, pair and triple that it holds once, as a digest with two counts, to
the bucket of that digest; the bucket adds up and answers every chunk in the order it asked in, so answers need no
keys. Buckets are ranges of the digests, as many as there are ``BUCKET_TOKENS`` tokens, so that a bucket has bounded
size; digests go sorted, as the gaps between them. A chunk sends at most one message for each order and bucket and no
more than it has keys, so messages never outnumber the keys. Digests of pairs and triples have 22 bits more than
the number of tokens needs, so that one key in 4 million at most is taken for another; those of words have 64.
Every table between steps is written to the shared folder. Expectation-maximisation needs only, for each bucket of
contexts, a histogram of the ratio of the two estimates (16 bins to a doubling, with their means), which is all the driver sees.

Cases: null text is the empty text, one end token; the end of the text before stands for the start, and the first word
of a text has no triple; words that training lacks share the uniform part; without training documents, or without
deleted ones, the weights are one half; repeated rows score alike; an empty table gives no rows; very long texts are
cut and their parts added up; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import SPACE_WORDS, Scratch, lower_bytes, pieces_of, release_memory, ship

CHUNK_TOKENS, BUCKET_TOKENS = 900_000, 1_000_000
#: Parts of the documents: scored only, counted, deleted from the counts while weights are learned; and words that a
#: chunk only repeats from the one before.
UNSEEN, KEPT, DELETED, CONTEXT = 0, 1, 2, 3
ORDERS = (1, 2, 3)
_BINS, _STEP, _CONTEXTS = 1280, 16, 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = 8
    while used > 1 and not wide[:, used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.compress(np.ascontiguousarray(wide[:, :used].T).tobytes(), 6)


def expand(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : blob[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def _slices(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces that end before white space."""
    at = 0
    while at < len(raw):
        space = _SPACE.search(raw, at + size)
        end = space.start() if space else len(raw)
        yield raw[at:end]
        at = end


def chunker(id_type: pa.DataType):
    """Documents to chunks: ids, numbers of texts in several chunks, parts, lengths, word numbers, digests of words."""
    columns = ["chunk", "n_tokens", "ids", "texts", "parts", "lengths", "tokens", "digests"]
    kinds = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), *[pa.binary()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = cut = held = 0
        number: dict[bytes, int] = {b"": 0}
        ids, texts, parts, lengths, coded = [], [], [], [], []
        base = TaskContext.get().partitionId() << 24

        def begin(id_, text: int | None, part: int) -> None:
            ids.append(id_)
            texts.append(text)
            parts.append(part)
            lengths.append(0)

        def add(words: list[bytes]) -> None:
            nonlocal held
            for w in set(words).difference(number):
                number[w] = len(number)
            coded.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            lengths[-1] += len(words)
            held += len(words)

        def out() -> pa.RecordBatch:
            nonlocal serial, held
            digests = np.array([xxhash.xxh64_intdigest(w, 5) for w in number], np.uint64)
            row = [base + serial, held, ids.copy(), texts.copy(), squeeze(np.array(parts)), squeeze(np.array(lengths)), squeeze(np.concatenate(coded)), digests.tobytes()]
            number.clear()
            number[b""] = 0
            for held_list in (ids, texts, parts, lengths, coded):
                held_list.clear()
            serial, held = serial + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], columns)

        for batch in pieces_of(batches, 256):
            for id_, text, part in zip(*(c.to_pylist() for c in batch.columns)):
                begin(id_, None, part)
                last: list[bytes] = []
                for piece in _slices(lower_bytes(text)):
                    words = SPACE_WORDS.findall(piece)
                    for at in range(0, len(words), CHUNK_TOKENS):
                        some = words[at : at + CHUNK_TOKENS]
                        add(some)
                        last = (last + some[-2:])[-2:]
                        if held >= CHUNK_TOKENS and lengths[-1]:
                            if texts[-1] is None:
                                texts[-1], cut = base + cut, cut + 1
                            number_of_text = texts[-1]
                            yield out()
                            begin(None, None, CONTEXT)
                            add(last)
                            begin(id_, number_of_text, part)
                add([b""])  # the end
                if held >= CHUNK_TOKENS:
                    yield out()
        if ids:
            yield out()
        release_memory()

    return run


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One chunk at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
    release_memory()


def _mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29)) ^ (first << np.uint64(1))


class Chunk:
    """A chunk's tokens with their contexts."""

    def __init__(self, row: dict):
        self.parts, self.lengths, self.words = expand(row["parts"]), expand(row["lengths"]), expand(row["tokens"]).astype(np.int32)
        self.before = np.concatenate((np.zeros(1, np.int32), self.words[:-1]))  # a text begins after the end of another
        self.part_of = np.repeat(self.parts.astype(np.int8), self.lengths)


class Keys:
    """The distinct words, pairs or triples of a chunk as sorted digests, and the place of every number's or token's own
    there; the end is among the words even if no text ends in the chunk, since it is the context of a first word."""

    def __init__(self, chunk: Chunk, digests: np.ndarray, order: int, bits: int):
        values, word = digests, digests[chunk.words]
        if order > 1:
            values = pair = _mix(digests[chunk.before], word)
        if order > 2:
            values = _mix(np.concatenate((np.zeros(1, np.uint64), pair[:-1])), word)
            values[chunk.before == 0] = 0  # no triple
        self.bits = 64 if order == 1 else bits
        self.distinct, place = np.unique(values >> np.uint64(64 - self.bits), return_inverse=True)
        self.place = place.astype(np.int32)
        self.of_token = self.place[chunk.words] if order == 1 else self.place

    def counts(self, on: np.ndarray) -> np.ndarray:
        return np.bincount(self.of_token[on], minlength=len(self.distinct))

    def ends(self, buckets: int) -> list[int]:
        """Where each bucket ends: bucket k has the digests from k / buckets of all possible ones on."""
        bounds = np.array([((k + 1) << self.bits) // buckets for k in range(buckets - 1)], np.uint64)
        return [*np.searchsorted(self.distinct, bounds).tolist(), len(self.distinct)]


def gaps(sorted_values: np.ndarray) -> bytes:
    return squeeze(np.diff(sorted_values, prepend=np.uint64(0)))


def from_gaps(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob).view(np.uint64), dtype=np.uint64)


MESSAGE = "bucket long, chunk long, size int, keys binary, kept binary, deleted binary"
ANSWER = "chunk long, bucket long, size int, kept binary, deleted binary, totals array<long>, histogram array<long>"


def asker(buckets: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for row in single_rows(batches):
            chunk, digests = Chunk(row), np.frombuffer(row["digests"], np.uint64)
            for order in ORDERS:
                keys = Keys(chunk, digests, order, bits)
                kept, deleted = (keys.counts(chunk.part_of == part) for part in (KEPT, DELETED))
                out, start = [], 0
                for bucket, end in enumerate(keys.ends(buckets)):
                    if end > start:
                        out.append((bucket, row["chunk"], order, gaps(keys.distinct[start:end]), squeeze(kept[start:end]), squeeze(deleted[start:end])))
                    start = end
                for at in range(0, len(out), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 512]), kinds)], ["bucket", "chunk", "size", "keys", "kept", "deleted"])

    return run


def add_up(group: pa.Table) -> pa.Table:
    """One bucket: the sums of every key, in the order that each chunk asked in, and totals over distinct words.

    ``totals``: kept tokens, deleted tokens, words that are kept, words of either kind. ``histogram``: deleted
    tokens by the power of two (in sixteenths) of their word's kept count, the last entry for kept counts of 0; then
    the sums of those counts in the same bins.
    """
    rows = sorted(group.to_pylist(), key=lambda r: (r["size"], r["chunk"]))
    out = []
    for size in ORDERS:
        own = [r for r in rows if r["size"] == size]
        if not own:
            continue
        keys = [from_gaps(r["keys"]) for r in own]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.zeros(len(distinct), np.int64) for _ in range(2)]
        for held, name in zip(sums, ("kept", "deleted")):
            np.add.at(held, place, np.concatenate([expand(r[name]) for r in own]))
        kept, deleted = sums
        ends = np.cumsum([len(k) for k in keys])
        totals = histogram = None
        for r, k, end in zip(own, keys, ends):
            if size == 1 and totals is None:
                totals = [int(kept.sum()), int(deleted.sum()), int((kept > 0).sum()), int((kept + deleted > 0).sum())]
                histogram = np.zeros((2, _CONTEXTS * _STEP + 1), np.int64)
                seen = kept > 0
                bins = np.rint(np.log2(kept[seen]) * _STEP).astype(np.int64)
                np.add.at(histogram[0], bins, deleted[seen])
                np.add.at(histogram[1], bins, deleted[seen] * kept[seen])
                histogram[0, -1] = deleted[~seen].sum()
                histogram = histogram.ravel().tolist()
            else:
                totals, histogram = totals and [0] * 4, None
            mine = place[end - len(k) : end]
            out.append((r["chunk"], r["bucket"], size, squeeze(kept[mine]), squeeze(deleted[mine]), totals, histogram))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    rows = own = keys = distinct = place = sums = None
    release_memory()
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["chunk", "bucket", "size", "kept", "deleted", "totals", "histogram"])


JOINED = ["ids", "texts", "parts", "lengths", "tokens", "kept_1", "deleted_1", "kept_2", "deleted_2", "kept_3", "deleted_3"]


def answered(buckets: int, bits: int, id_type: pa.DataType):
    """Joins a chunk with its answers: counts of its words by number, and of the pair and triple of every token."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk, digests = Chunk(row), np.frombuffer(row["digests"], np.uint64)
        out = [row[c] for c in JOINED[:5]]
        answers = sorted(right.select(["bucket", "size", "kept", "deleted"]).to_pylist(), key=lambda r: r["bucket"])
        for order in ORDERS:
            keys = Keys(chunk, digests, order, bits)
            for name in ("kept", "deleted"):
                values = np.concatenate([expand(r[name]) for r in answers if r["size"] == order])
                out.append(squeeze(values[keys.place]))
        kinds = [pa.list_(id_type), pa.list_(pa.int64()), *[pa.binary()] * 9]
        row = chunk = answers = keys = None
        release_memory()
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(out, kinds)], JOINED)

    return run


class Counts:
    """Per token of a chunk: counts of the triple, the pair and the word, and of the contexts of the first two."""

    def __init__(self, row: dict, deleted_too: bool):
        self.chunk = chunk = Chunk(row)
        word, self.pair, self.triple = (expand(row[f"kept_{n}"]) + (expand(row[f"deleted_{n}"]) if deleted_too else 0) for n in ORDERS)
        self.word, self.context = word[chunk.words], word[chunk.before]
        self.wide = np.concatenate((np.zeros(1, np.int64), self.pair[:-1]))  # of the two words before
        self.wide[chunk.before == 0] = 0  # a text's first word has no such context
        self.triple[chunk.before == 0] = 0


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 and the power of two."""
    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0)


def unigram(word: np.ndarray, total: int, kinds: int, weight: float) -> np.ndarray:
    return weight * word / max(total, 1) + (1 - weight) / (kinds + 1)


@dataclass
class Mixture:
    """Totals, the weight of words, and the weights of pairs and triples by bucket of their context."""

    total: int
    kinds: int
    weight: float
    pairs: list[float] | None = None
    triples: list[float] | None = None

    def words(self, c: Counts) -> np.ndarray:
        return unigram(c.word, self.total, self.kinds, self.weight)

    def of_pairs(self, c: Counts) -> np.ndarray:
        m = np.array(self.pairs)[context_bucket(c.context)]
        return m * c.pair / np.maximum(c.context, 1) + (1 - m) * self.words(c)

    def of_triples(self, c: Counts) -> np.ndarray:
        m = np.array(self.triples)[context_bucket(c.wide)]
        return m * c.triple / np.maximum(c.wide, 1) + (1 - m) * self.of_pairs(c)


def ratio_counter(mixture: Mixture):
    """For each bucket of contexts: deleted tokens by the ratio of an estimate to the one below it, for pairs, or once
    their weights are known, for triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, mass = np.zeros((_CONTEXTS + 1, _BINS + 1), np.int64), np.zeros((_CONTEXTS + 1, _BINS + 1))
        for row in single_rows(batches):
            c = Counts(row, deleted_too=False)
            count, context, below = (c.pair, c.context, mixture.words(c)) if mixture.pairs is None else (c.triple, c.wide, mixture.of_pairs(c))
            on = (c.chunk.part_of == DELETED) & (context > 0)
            count, context, below = count[on], context[on], below[on]
            ratio = count / context / below
            place = np.full(len(count), _BINS)
            seen = count > 0
            place[seen] = np.clip(np.rint(np.log2(ratio[seen]) * _STEP) + _BINS // 2, 0, _BINS - 1)
            np.add.at(sums, (context_bucket(context), place), 1)
            np.add.at(mass, (context_bucket(context), place), ratio)
        where = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(where[0].astype(np.int64)), pa.array(where[1].astype(np.int64)), pa.array(sums[where]), pa.array(mass[where])], ["context", "place", "n", "mass"])

    return run


def mixture_weight(ratios: np.ndarray, counts: np.ndarray, rounds: int = 200) -> float:
    """Expectation-maximisation of the weight of one estimate against another, from their ratio at each event."""
    total, weight = counts.sum(), 0.5
    if not total:
        return weight
    for _ in range(rounds):
        share = weight * ratios / (weight * ratios + 1 - weight)
        weight = float(np.clip((counts * share).sum() / total, 1e-6, 1 - 1e-6))
    return weight


def bucket_weights(joined: DataFrame, mixture: Mixture) -> list[float]:
    """The weight of each bucket of contexts for the next order; buckets without deleted tokens have that of the one before."""
    ratios = joined.mapInArrow(ratio_counter(mixture), "context long, place long, n long, mass double")
    found = ratios.groupBy("context", "place").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).collect()
    weights = [0.0]
    for context in range(1, _CONTEXTS + 1):
        own = sorted((r["place"], r["n"], r["mass"]) for r in found if r["context"] == context)
        n, mass = np.array([k for _, k, _ in own], np.float64), np.array([x for *_, x in own])
        weights.append(mixture_weight(mass / n, n) if own else weights[-1] or 0.5)
    return weights


def scorer(mixture: Mixture, id_type: pa.DataType):
    names = ["_id", "_text", "_part", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in single_rows(batches):
            c = Counts(row, deleted_too=True)
            base = np.log10((c.word + 0.5) / (mixture.total + 0.5 * (mixture.kinds + 1)))
            at = np.concatenate(([0], np.cumsum(c.chunk.lengths)[:-1]))
            sums = lambda x: np.add.reduceat(x, at)
            values = [c.chunk.lengths, sums((c.word > 0).astype(np.int64)), sums(base), sums(np.log10(mixture.of_triples(c)))]
            arrays = [pa.array(row["ids"], id_type), pa.array(row["texts"], pa.int64()), pa.array(c.chunk.parts), *map(pa.array, values)]
            own = pa.array(c.chunk.parts != CONTEXT)
            yield pa.RecordBatch.from_arrays([a.filter(own) for a in arrays], names)

    return run


def score_documents(docs: DataFrame, part: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, part, n_tokens, n_known, train_tokens, base_score, score)``; ``part``: UNSEEN, KEPT or DELETED."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "interpolation")
    kind = docs.schema[id_col].dataType
    id_type, id_sql = to_arrow_type(kind), kind.simpleString()
    chunk_sql = f"ids array<{id_sql}>, texts array<long>, parts binary, lengths binary, tokens binary"

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), part.cast("int").alias("_part"))
    chunks = scratch.save(rows.mapInArrow(chunker(id_type), f"chunk long, n_tokens long, {chunk_sql}, digests binary"), "chunks")
    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets, bits = -(-tokens // BUCKET_TOKENS) or 1, min(64, tokens.bit_length() + 22)

    asked = chunks.mapInArrow(asker(buckets, bits), MESSAGE)
    answers = scratch.save(asked.groupBy("bucket").applyInArrow(add_up, ANSWER), "answers")
    sums = answers.where("totals is not null").agg(*(F.sum(F.col("totals")[k]).alias(f"t{k}") for k in range(4))).first()
    kept, deleted, kept_kinds, kinds = (int(x or 0) for x in sums)
    held = answers.where("histogram is not null").select(F.posexplode("histogram").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).where("n > 0").collect()
    binned = np.zeros(2 * (_CONTEXTS * _STEP + 1))
    for r in held:
        binned[r["at"]] = r["n"]
    n, mass = binned.reshape(2, -1)
    weight = mixture_weight(mass[n > 0] / n[n > 0] / max(kept, 1) * (kept_kinds + 1), n[n > 0])

    counts_sql = ", ".join(f"{c} binary" for c in JOINED[5:])
    joined = chunks.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "size", "kept", "deleted").groupBy("chunk")).applyInArrow(answered(buckets, bits, id_type), f"{chunk_sql}, {counts_sql}")
    joined = scratch.save(joined, "joined")
    scratch.drop("chunks")
    scratch.drop("answers")

    mixture = Mixture(kept, kept_kinds, weight)
    mixture.pairs = bucket_weights(joined, mixture)
    mixture.triples = bucket_weights(joined, mixture)
    mixture = Mixture(kept + deleted, kinds, weight, mixture.pairs, mixture.triples)
    sums_of = ["n_tokens", "n_known", "base_score", "score"]
    scored = joined.mapInArrow(scorer(mixture, id_type), f"_id {id_sql}, _text long, _part long, n_tokens long, n_known long, base_score double, score double")
    scored = scratch.save(scored, "scored")
    scratch.drop("joined")
    parted = scored.where("_text is not null").groupBy("_text").agg(F.first("_id").alias("_id"), F.first("_part").alias("_part"), *(F.sum(c).alias(c) for c in sums_of))
    scored = scored.where("_text is null").unionByName(parted)
    return scored.select(F.col("_id").alias(id_col), F.col("_part").alias("part"), "n_tokens", "n_known", F.lit(kept + deleted).cast("long").alias("train_tokens"), "base_score", "score")
