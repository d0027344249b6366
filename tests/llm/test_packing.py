import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm.common import tokenizer_path
from lakeloom.llm.cutting_stock import plan, solve
from lakeloom.llm.packing import _PLAIN, Encoder, document_pieces, pack

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_and_is_near_the_bound(seed):
    rng = random.Random(seed)
    histogram = Counter(min(64, int(rng.expovariate(1 / 20)) + 1) for _ in range(5000))
    patterns = plan(dict(histogram), 64)
    assert all(sum(p.sizes) <= 64 for p in patterns)
    held = Counter()
    for p in patterns:
        for s in p.sizes:
            held[s] += p.uses
    assert held == histogram
    assert sum(p.uses for p in patterns) * 64 <= 1.03 * sum(s * n for s, n in histogram.items()) + 64


def test_linear_program_reaches_the_known_optimum():
    columns, uses = solve(np.array([45, 36, 31, 14]), np.array([97.0, 610.0, 395.0, 211.0]), 100, tolerance=1e-9)
    assert 452 < uses.sum() < 452.5 + 0.5 and (columns.T @ np.array([45, 36, 31, 14]) <= 100).all()
    assert plan({}, 10) == []


def test_encoder_gives_the_library_ids():
    encoder, rng = Encoder(PATH), random.Random(2)
    assert encoder.quick is not None
    pool = [chr(c) for c in range(0x2030) if _PLAIN.fullmatch(chr(c))] + ["中", "\U0001f600", "\x85", " "]
    texts = ["", " ", "a<|endoftext|>b", "it's  9,9\n\n x", "A" * 3000] + ["".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice(" \n\t'sdaT9.") for _ in range(rng.randrange(40))) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(documents, clashing):
    encoder = Encoder(PATH)
    pieces = document_pieces(clashing, PATH, capacity=64).cache()
    rows = pack(pieces, capacity=64, grid=4).collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_document[r["doc_id"], r["doc_tokens"]].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for d in documents.collect():
        ids = encoder.encode(d["text"] or "") + b"\0\0\0\0"
        own = sorted({(r["start"], bytes(r["ids"])) for r in by_document[d["doc_id"], len(ids) // 4]})
        assert b"".join(p for _, p in own) == ids
    assert len(rows) == pieces.count()
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) * 64 < 1.15 * total + 64


def test_empty_table(nothing):
    assert pack(document_pieces(nothing, PATH).drop("ids")).count() == 0
    assert pack(document_pieces(nothing, PATH).withColumn("n", F.lit(1)).drop("ids")).columns[-2:] == ["sequence_id", "offset"]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000, " \n\t" * 300_000, "a" * 1_500_000 + " " * 20_000 + "b", ("x" + " " * 9_999) * 20], ids=["blanks", "lines", "mixed", "word", "runs"])
def test_very_long_texts_have_the_library_ids(text):
    encoder = Encoder(PATH)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_very_long_texts_are_packed_and_clashing_names_refused(spark):
    docs = spark.createDataFrame([(1, " " * 1_200_000), (2, "\n" * 1_000_000 + "end"), (3, "w " * 400_000)], "doc_id long, text string")
    pieces = document_pieces(docs, PATH).cache()
    rows = pack(pieces.drop("ids")).collect()
    encoder = Encoder(PATH)
    for d in docs.collect():
        assert sum(r["length"] for r in rows if r["doc_id"] == d["doc_id"]) == len(encoder.encode(d["text"])) // 4 + 1
    with pytest.raises(ValueError, match="_rank"):
        pack(pieces.withColumn("_rank", F.lit(1)))
