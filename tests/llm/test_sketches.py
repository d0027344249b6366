import hashlib
import random

import numpy as np
import pytest

from lakeloom.llm.sketches import Sketch, differing, edited_text, likeness, paragraph_digests, version_sketches


@pytest.mark.parametrize("n", [0, 1, 3, 40, 700])
def test_peeling_recovers_the_difference(n):
    rng = np.random.default_rng(n)
    shared, left, right = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (500, n, n // 2))
    a, b = differing(np.concatenate((shared, left)), np.concatenate((shared, right)))
    assert set(a.tolist()) == set(left.tolist()) and set(b.tolist()) == set(right.tolist())


def test_too_small_a_sketch_fails():
    values = np.arange(1000, dtype=np.uint64)
    assert Sketch.of(values, 48).peel() is None
    assert Sketch.of(values, 3072).peel() is not None


def test_likeness():
    a, b = paragraph_digests("one two\nthree\nthree"), paragraph_digests("one two\nthree\nfour")
    assert len(set(a.tolist())) == 3 and likeness(a, a) == 1.0
    assert likeness(a, b) == pytest.approx(4 / 6)
    none = paragraph_digests(None)
    assert likeness(none, none) == 1.0 and likeness(none, a) == 0.0


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_versions_against_brute_force(spark, documents, clashing, nothing, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = {}
        for r in version_sketches(clashing).collect():
            rows.setdefault(r["doc_id"], []).append(r)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = sorted(((d["doc_id"] is not None, d["doc_id"] or 0, digest(d["text"] or ""), d["text"] or "", d["doc_id"]) for d in documents.collect()))
    for k, (_, _, _, text, id_) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][3]
        edited = edited_text(text, following)
        own = paragraph_digests(text)
        want = (len(text), digest(edited), Sketch.of(own, 48).dump(), round(likeness(own, paragraph_digests(edited)), 9), round(likeness(own, paragraph_digests(following)), 9))
        assert want in [(r["n_chars"], r["edited_sha256"], r["fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows[id_]]
    assert sum(map(len, rows.values())) == len(docs)
    assert version_sketches(nothing).count() == 0


def test_one_document_follows_itself(spark, nothing):
    one = spark.createDataFrame([(5, "abcdefgh", None, None, 8)], nothing.schema)
    assert version_sketches(one).first()["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_an_edit_is_nearer_than_another_text():
    rng = random.Random(3)
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(9999)}s" for _ in range(30)) for _ in range(10))
    for _ in range(20):
        a, b = text(), text()
        own = paragraph_digests(a)
        assert likeness(own, paragraph_digests(edited_text(a, b))) > 0.6 > 0.1 > likeness(own, paragraph_digests(b))


def test_a_repeated_id_and_very_long_texts(spark):
    rng = random.Random(9)
    rows = [(7, " ".join(f"w{rng.randrange(99)}d" for _ in range(20)) + f" {k}") for k in range(300)] + [(1, "a " * 400_000 + "end. " * 100_000), (9, "z"), (None, "n")]
    got = version_sketches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] == 7 for r in got) == 300
    edited = {r["edited_sha256"] for r in got}
    one = next(t for i, t in rows if i == 1)
    assert sum(hashlib.sha256(edited_text(one, t).encode()).hexdigest() in edited for i, t in rows if i == 7) == 1  # the first by hash follows
    assert hashlib.sha256(edited_text("n", one).encode()).hexdigest() in edited and hashlib.sha256(edited_text("z", "n").encode()).hexdigest() in edited
