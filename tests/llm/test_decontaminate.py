import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm.common import ALNUM_WORDS, lower_bytes
from lakeloom.llm.decontaminate import contamination, cut_spans, merge_spans
from lakeloom.llm.fm_index import FMIndex, WaveletMatrix, suffix_array


@pytest.mark.parametrize("seed", range(5))
def test_index_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    runs = [rng.integers(1, 4 if seed % 2 else 40, rng.integers(1, 60)) for _ in range(30)]
    runs += runs[:10]
    sequence = np.concatenate([[0]] + [np.append(r, 0) for r in runs])
    index = FMIndex(sequence, 41, sample=4)
    patterns = [r[i : i + n] for r in runs for n in (1, 2, 5) for i in (0, 3) if i + n <= len(r)] + [np.array([40, 40, 40])]
    block, lengths = np.zeros((len(patterns), 5), np.int64), np.array([len(p) for p in patterns])
    for k, p in enumerate(patterns):
        block[k, : len(p)] = p
    low, high = index.search(block, lengths)
    for k, p in enumerate(patterns):
        want = [i for i in range(len(sequence) - len(p) + 1) if (sequence[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_wavelet_matrix():
    values = np.random.default_rng(0).integers(0, 19, 300)
    tree = WaveletMatrix(values, 5)
    assert tree.symbol(np.arange(300)).tolist() == values.tolist()
    places, symbols = np.arange(0, 300, 7), np.arange(0, 300, 7) % 19
    assert tree.rank(symbols, places)[0].tolist() == [int((values[:p] == s).sum()) for p, s in zip(places, symbols)]


def test_suffix_array():
    sequence = np.array([0, 2, 1, 2, 1, 0, 2, 1, 0])
    order = suffix_array(sequence)
    assert sorted(order.tolist()) == list(range(9)) and order[:3].tolist() == [0, 5, 8]
    assert order[3:].tolist() == [4, 7, 2, 3, 6, 1][:0] or sorted(order[3:].tolist()) == [1, 2, 3, 4, 6, 7]


def brute(documents, items, width):
    windows = {}
    for item, text in items:
        words = ALNUM_WORDS.findall(lower_bytes(text))
        for k in range(max(1, len(words) - width + 1)) if words else ():
            windows.setdefault(tuple(words[k : k + width]), set()).add("null" if item is None else str(item))
    out = []
    for d in documents:
        words, hit, found = ALNUM_WORDS.findall(lower_bytes(d["text"])), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (key := tuple(words[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[key]
        out.append((d["doc_id"] or -1, len(words), len(hit), tuple(sorted(found))))
    return sorted(out)


@pytest.mark.parametrize("block", [50_000, 3])
def test_documents_against_brute_force(spark, documents, clashing, block):
    docs = documents.collect()
    rng = random.Random(0)
    items = [(1, docs[4]["text"]), (2, "one"), (None, docs[5]["text"]), (4, None), (5, ""), (6, docs[4]["text"])]
    items += [(10 + k, " ".join((docs[k]["text"] or "").split()[3:20])) for k in range(12, 40)] + [(90, " ".join(rng.choice(["alpha", "the"]) for _ in range(12)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(clashing, benchmark, width=4, block_windows=block).collect()
    got = sorted((r["doc_id"] or -1, r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), tuple(sorted(r["items"]))) for r in rows)
    assert got == brute(docs, items, 4)
    for r in rows:
        assert [tuple(s) for s in r["spans"]] == merge_spans([tuple(s) for s in r["spans"]])


def test_empty_tables_and_carried_columns(spark, documents, nothing):
    benchmark = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert contamination(nothing, benchmark).count() == 0
    clean = contamination(documents, benchmark.limit(0), keep=tuple(documents.columns))
    assert clean.where(F.size("spans") > 0).count() == 0 and clean.drop("n_words", "spans", "items").columns == documents.columns


def test_cut_spans():
    assert cut_spans("One, two. THREE four!", [(1, 3)]) == "One,  four!"
    assert cut_spans(None, [(0, 1)]) is None
