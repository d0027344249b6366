import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import toxicity
from lakeloom.llm.common import ALNUM_WORDS, lower_bytes
from lakeloom.llm.toxicity import Network, Settings, fit, grams, score, train, windows_of

SMALL = Settings(window=16, stride=8, epochs=6, train_each=200)


def corpus(n, seed):
    rng = random.Random(seed)
    stems = ["vilro", "naskep", "dredmu"]
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(["ta", "lo", "mi", "ren", "su", "ka"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(10, 80))]
        bad = int(k % 3 == 0)
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(["", "ta", "lo", "miren"])
        rows.append((k, " ".join(words), bad))
    return rows


def test_gradients_match_differences():
    net = Network(Settings(hidden=3, learned=2, buckets=16, window=4), {b"aa": 0.5}, {b"<aa": 0.4})
    ids = np.stack([net.ids([b"aa", b"bb", b"cc", b"aa"]), net.ids([b"cc", b"dd", b"bb", b"bb"])]).T
    mask = np.array([[True, True], [True, True], [True, True], [True, False]])
    labels, weight, drop = np.array([1, 0], np.float32), np.ones(2, np.float32), np.zeros(ids.shape, bool)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    _, grads = net.gradients(ids, mask, labels, weight, drop)
    rng = np.random.default_rng(0)
    for name, grad in grads.items():
        at = tuple(rng.integers(0, s) for s in grad.shape) if name not in ("word", "char") else np.unravel_index(np.abs(grad).argmax(), grad.shape)
        step, keep = 1e-3, net.w[name][at]
        values = []
        for sign in (1, -1):
            net.w[name][at] = keep + sign * step
            values.append(net.gradients(ids, mask, labels, weight, drop)[0])
        net.w[name][at] = keep
        assert (values[0] - values[1]) / (2 * step) == pytest.approx(float(grad[at]), rel=0.05, abs=2e-3)


def test_windows_cover_a_text():
    for n in (1, 15, 16, 17, 40, 100):
        spans = windows_of(n, 16, 8)
        assert set().union(*(range(a, b) for a, b in spans)) == set(range(n)) and spans[-1][1] == n


def test_held_out_accuracy(spark, nothing):
    rows = corpus(420, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("score", F.lit("clash"))
    with pytest.raises(ValueError, match="score"):
        score(docs, None, SMALL, keep=("score",))
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in rows] + [(5, 0, None)], "doc_id long, quality int, toxic int")
    model = fit(docs, labels, SMALL, F.col("doc_id") % 4 != 1)
    scores = {r["doc_id"]: r["score"] for r in score(docs, model, SMALL).collect()}
    held = [(scores[k], y) for k, _, y in rows if k % 4 == 1]
    assert all(0 <= s <= 1 for s, _ in held)
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) >= 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "ta lo"), (3, "vilrota " * 2000)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in score(odd, model, SMALL).collect()}
    assert got[1] == got[2] == 0.0 and got[3] >= 0.7
    assert score(nothing, model, SMALL).count() == 0


def test_without_labels_of_both_kinds(spark, documents):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert fit(documents, labels, SMALL, F.lit(True)) is None
    assert {r["score"] for r in score(documents, None, SMALL).collect()} == {0.0}
    assert train([], [], SMALL) is None


def test_model_survives_storage():
    rows = corpus(60, 2)
    net = train([t for _, t, _ in rows], [y for _, _, y in rows], SMALL)
    again = Network.load(SMALL, net.dump())
    texts = [t for _, t, _ in rows[:20]]
    assert np.allclose(net.scores(texts), again.scores(texts), atol=1e-5)


def plain_score(net, text):
    """The score by its definition: every window on its own, one word at a time."""
    w, s = net.w, net.s
    words = ALNUM_WORDS.findall(lower_bytes(text))
    if not words:
        return 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = s.hidden

    def vector(word):
        known, strength, row, buckets = net.describe([word])[0]
        return np.concatenate(([known, strength], w["word"][row], w["char"][buckets].mean(axis=0)))

    def run(xs, side):
        state, out = np.zeros(h), []
        for x in xs:
            part, rec = x @ w[f"x{side}"] + w[f"c{side}"], state @ w[f"u{side}"]
            z, r = sig(part[:h] + rec[:h]), sig(part[h : 2 * h] + rec[h : 2 * h])
            fresh = np.tanh(part[2 * h :] + r * rec[2 * h :])
            state = (1 - z) * fresh + z * state
            out.append(state)
        return out

    worst = -np.inf
    for a, b in windows_of(len(words), s.window, s.stride):
        xs = [vector(x) for x in words[a:b]]
        states = np.array([np.concatenate(p) for p in zip(run(xs, "f"), run(xs[::-1], "b")[::-1])])
        energy = np.tanh(states @ w["att"]) @ w["v"]
        weight = np.exp(energy - energy.max())
        worst = max(worst, (weight / weight.sum()) @ states @ w["out"] + w["bias"][0])
    return sig(worst * w["fit"][0] + w["fit"][1])


def test_scores_against_brute_force():
    rows = corpus(90, 3)
    net = train([t for _, t, _ in rows], [y for _, _, y in rows], SMALL)
    texts = [t for _, t, _ in rows[:15]] + ["", None, "ta", "ta " * 16, " ".join(t for _, t, _ in rows[:6]), "lo" * 100 + " ta"]
    assert np.allclose(net.scores(texts), [plain_score(net, t) for t in texts], atol=2e-4)


def test_long_words_are_read_to_their_end():
    rows = corpus(120, 4)
    net = train([t for _, t, _ in rows], [y for _, _, y in rows], SMALL)
    for size in (40, 4090, 4094, 100_000):
        clean = ("talo" * size)[:size]
        longer, shorter = net.describe([(clean + "vilro").encode(), clean.encode()])
        assert longer[1] > shorter[1]
    assert grams(b"x" * 5000) == {b"<xx", b"<xxx", b"<xxxx", b"<xxxxx", b"xxx", b"xxxx", b"xxxxx", b"xxxxxx", b"xx>", b"xxx>", b"xxxx>", b"xxxxx>"}
    net.scores(["w" * 3_000_000 + " ta " * 300_000])


def test_one_text_of_a_repeated_id_is_learned_from(spark, monkeypatch):
    seen = []
    docs = spark.createDataFrame([(k % 2, f"ta lo {k}") for k in range(500)], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "repartition", lambda self, n: seen.append(self.count()) or self.coalesce(n))
    fit(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"), SMALL, F.lit(True))
    assert seen == [2]


def test_descriptions_by_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 101, int(n)).astype(np.uint8)) for n in rng.integers(1, 14, 400)] + [b"a", b"\xc3\xa9", b"d" * 300]
    pool = sorted(set().union(*map(grams, words)))
    known = {pool[int(k)]: float(rng.random()) for k in rng.integers(0, len(pool), 200)}
    net = Network(Settings(), {b"a": 0.5}, known)
    want = [max((known.get(g, 0.0) for g in grams(w)), default=0.0) for w in words]
    assert [r[1] for r in net.describe(words)] == want
    assert [net.describe([w])[0] for w in words] == net.describe(words) and net.describe([]) == []
    assert all(r[3] == sorted(set(r[3])) and 1 <= len(r[3]) <= len(w) for r, w in zip(net.describe(words), words))
    whole = net.describe(words)
    chunks = toxicity._marked_chunks
    monkeypatch.setattr(toxicity, "_marked_chunks", lambda w: chunks(w, 16))
    assert net.describe(words) == whole
    assert Network(Settings(), {}, {}).describe([b"abc"])[0][:3] == (0.0, 0.0, 0)
