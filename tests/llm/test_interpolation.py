import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import interpolation
from lakeloom.llm.common import SPACE_WORDS, lower_bytes
from lakeloom.llm.interpolation import DELETED, KEPT, UNSEEN, expand, from_gaps, gaps, mixture_weight, score_documents, squeeze


def tokens(text):
    return SPACE_WORDS.findall(lower_bytes(text)) + [b""]


def column():
    k = F.coalesce(F.col("doc_id") % 5, F.lit(2))
    return F.when(k == 1, UNSEEN).when(k == 0, DELETED).otherwise(KEPT)


def part(d):
    k = 2 if d["doc_id"] is None else d["doc_id"] % 5
    return UNSEEN if k == 1 else DELETED if k == 0 else KEPT


@pytest.mark.parametrize("chunk", [100, 1_000_000])
def test_counts_and_scores_against_brute_force(spark, documents, clashing, monkeypatch, chunk):
    monkeypatch.setattr(interpolation, "CHUNK_TOKENS", chunk)
    docs = documents.collect()
    rows = score_documents(clashing, column()).collect()
    words, pairs, triples, kept, kept_pairs, kept_triples = (Counter() for _ in range(6))
    for d in docs:
        t = tokens(d["text"])
        p = list(zip([b""] + t[:-1], t))
        for group, on in (((words, pairs, triples), part(d) != UNSEEN), ((kept, kept_pairs, kept_triples), part(d) == KEPT)):
            if on:
                group[0].update(t)
                group[1].update(p)
                group[2].update(zip(p[:-1], t[1:]))
    total, kinds = sum(words.values()), len(words)
    kept_total, kept_kinds = sum(kept.values()), len(kept)
    held = [d for d in docs if part(d) == DELETED]
    bucket = lambda n: int(math.log2(n)) + 1 if n else 0

    def weights(events):
        """Expectation-maximisation on the events themselves: (context's count, ratio)."""
        by_bucket, out, last = {}, {0: 0.0}, 0.0
        for n, ratio in events:
            if n:
                by_bucket.setdefault(bucket(n), []).append(ratio)
        for b in range(1, 65):
            last = mixture_weight(np.array(by_bucket[b]), np.ones(len(by_bucket[b]))) if b in by_bucket else last or 0.5
            out[b] = last
        return out

    def positions(d):
        t = tokens(d["text"])
        before = [b""] + t[:-1]
        return [((before[i - 1], before[i]) if i else None, before[i], w) for i, w in enumerate(t)]

    n = mixture_weight(np.array([(kept[w] / kept_total) * (kept_kinds + 1) for d in held for w in tokens(d["text"])]), np.ones(sum(len(tokens(d["text"])) for d in held)))
    uni = lambda w, c, t, k: n * c[w] / t + (1 - n) / (k + 1)
    events = [(kept[v], kept_pairs[v, w] / max(kept[v], 1) / uni(w, kept, kept_total, kept_kinds)) for d in held for _, v, w in positions(d)]
    pair_weights = weights(events)

    def two(v, w, c, p, t, k):
        m = pair_weights[bucket(c[v])]
        return m * p[v, w] / max(c[v], 1) + (1 - m) * uni(w, c, t, k)

    events = [(kept_pairs[x], kept_triples[x, w] / max(kept_pairs[x], 1) / two(v, w, kept, kept_pairs, kept_total, kept_kinds)) for d in held for x, v, w in positions(d) if x]
    triple_weights = weights(events)
    want = {}
    for d in docs:
        t = tokens(d["text"])
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        s = 0.0
        for x, v, w in positions(d):
            below = two(v, w, words, pairs, total, kinds)
            m = triple_weights[bucket(pairs[x])] if x else 0.0
            s += math.log10(m * triples[x, w] / max(pairs[x], 1) + (1 - m) * below if x else below)
        want.setdefault((d["doc_id"], len(t)), (sum(words[w] > 0 for w in t), base, s))
    assert len(rows) == len(docs)
    for r in rows:
        known, base, s = want[r["doc_id"], r["n_tokens"]]
        assert r["n_known"] == known and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(s, rel=0.01)


def test_texts_in_several_chunks_score_like_whole_ones(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice((0, 1, 7, 400, 3000))))) for k in range(60)]
    rows += [(70, "word " * 250_000), (71, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    whole = {r["doc_id"]: r for r in score_documents(docs, column()).collect()}
    monkeypatch.setattr(interpolation, "BUCKET_TOKENS", 5000)
    monkeypatch.setattr(interpolation, "CHUNK_TOKENS", 333)
    cut = score_documents(docs, column()).collect()
    assert len(cut) == len(rows)
    for r in cut:
        one = whole[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["part"], r["train_tokens"]) == (one["n_tokens"], one["n_known"], one["part"], one["train_tokens"])
        assert r["base_score"] == pytest.approx(one["base_score"], rel=1e-9) and r["score"] == pytest.approx(one["score"], rel=1e-9)


def test_repeated_documents_score_apart(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(150))
    near = lambda t: " ".join(w if rng.random() < 0.8 else f"w{rng.randrange(4000)}" for w in t.split())
    once, twice, others = ([text() for _ in range(n)] for n in (60, 20, 20))
    docs = [(5 * k + 2, t) for k, t in enumerate(once + twice + twice)] + [(5 * k, near(t)) for k, t in enumerate(others)] + [(5 * k + 3, t) for k, t in enumerate(others)]
    scores = {r["doc_id"]: r["score"] for r in score_documents(spark.createDataFrame(docs, "doc_id long, text string"), column()).collect()}
    lone, both = [scores[5 * k + 2] for k in range(60)], [scores[5 * k + 2] for k in range(60, 100)]
    higher = np.mean([b > x for b in both for x in lone])  # of all pairs of a repeated and a lone text
    assert max(higher, 1 - higher) > 0.95  # which way depends on what was deleted


def test_beats_the_base_on_held_out_text(spark):
    rng, rows = random.Random(6), []
    for k in range(100):
        walk = [rng.randrange(50)]
        while len(walk) < 60:
            walk.append((walk[-1] * 7 + 1) % 50 if rng.random() < 0.8 else rng.randrange(50))
        rows.append((k, " ".join(f"w{w}" for w in walk)))
    scored = score_documents(spark.createDataFrame(rows, "doc_id long, text string"), column()).where(F.col("part") == UNSEEN)
    sums = scored.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums["s"] > sums["b"] * 0.6


def test_without_training_documents(documents, nothing):
    rows = score_documents(documents, F.lit(UNSEEN)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)
    assert score_documents(nothing, column()).count() == 0


def test_blobs_and_weights():
    for values in ([], [0, 1, 2], [300, 0, 2**40]):
        assert expand(squeeze(np.array(values, np.int64))).tolist() == values
    sorted_values = np.array([0, 5, 5 + 2**63, 2**64 - 1], np.uint64)
    assert from_gaps(gaps(sorted_values)).tolist() == sorted_values.tolist()
    assert mixture_weight(np.array([0.0, 4.0]), np.array([1, 3])) == pytest.approx(1 - 1 / 3, abs=0.35)
    assert mixture_weight(np.array([]), np.array([])) == 0.5
