import random

import pyarrow as pa
import pytest
import xxhash

from lakeloom.llm import near_duplicates
from lakeloom.llm.common import SPACE_WORDS, lower_bytes
from lakeloom.llm.components import components
from lakeloom.llm.near_duplicates import near_duplicate_groups, one_of_each, shingle_set
from lakeloom.llm.simhash import Block, fingerprint_links, simhash_groups


def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_fingerprint(text, words=3):
    found = SPACE_WORDS.findall(lower_bytes(text))
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_block_forest_connects_what_is_near(radius):
    rng = random.Random(radius)
    members = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        members |= {base} | {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(4)}
    members = sorted(members)
    forest = Block(members, radius).forest()
    near = [(a, b) for a in members for b in members if a < b and (a ^ b).bit_count() <= radius]
    assert all((a ^ b).bit_count() <= radius for a, b in forest) and len(forest) < len(members)
    assert groups_of(members, forest) == groups_of(members, near)


def test_no_link_is_missed_across_blocks(spark):
    rng = random.Random(1)
    members = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        members |= {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(5)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = fingerprint_links(spark.createDataFrame([(signed(m),) for m in members], "_fp long"), 2).collect()
    near = [(signed(a), signed(b)) for a in members for b in members if a < b and (a ^ b).bit_count() <= 2]
    nodes = [signed(m) for m in members]
    assert groups_of(nodes, [tuple(r) for r in found]) == groups_of(nodes, near)


def test_components_of_chains_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == groups_of({n for x in links for n in x}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_against_brute_force(documents, clashing, nothing):
    rows = simhash_groups(clashing, words=3, radius=2).collect()
    docs = documents.collect()
    prints = [brute_fingerprint(d["text"]) for d in docs]
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in rows) == sorted((d["doc_id"] or -1, f"{p:016x}") for d, p in zip(docs, prints))
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = groups_of(range(len(docs)), links)
    least = {}
    for i, d in enumerate(docs):
        if d["doc_id"] is not None:
            least[root[i]] = min(least.get(root[i], d["doc_id"]), d["doc_id"])
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(d["doc_id"], least[root[i]]) for i, d in enumerate(docs)}
    assert simhash_groups(nothing).count() == 0


def test_near_copies_by_similarity(spark, documents, nothing):
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(5000)}"
    rows = []
    for base in range(12):
        words = [word() for _ in range(200)]
        for copy in range(6):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(200)] = word()
            rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows), ""), (len(rows) + 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(shingle_set(t, 5).tolist()) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0]
    want = groups_of(range(len(rows)), links)
    got = {}
    for r in near_duplicate_groups(docs).collect():
        got.setdefault(r["_group"], []).append(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(k for k in want if want[k] == root) for root in set(want.values()))
    assert sorted(r["doc_id"] for r in one_of_each(docs).collect()) == sorted(set(want.values()))
    assert one_of_each(nothing).count() == 0
    kept = one_of_each(documents)
    assert kept.columns == documents.columns and len({(r["text"] or "").lower().split().__str__() for r in kept.collect()}) == kept.count()


def same_groups(docs, rows):
    """Groups of row numbers as found, and by brute force."""
    sets = [set(shingle_set(t, 5).tolist()) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0]
    want = groups_of(range(len(rows)), links)
    got = {}
    for r in near_duplicate_groups(docs).collect():
        got.setdefault(r["_group"], []).append(r["doc_id"])
    return sorted(map(sorted, got.values())), sorted(sorted(k for k in want if want[k] == root) for root in set(want.values()))


@pytest.mark.parametrize(("tile", "shingles"), [(5, 10**9), (2048, 3000)])
def test_groups_do_not_depend_on_the_size_of_parts(spark, monkeypatch, tile, shingles):
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    monkeypatch.setattr(near_duplicates, "SHINGLES", shingles)
    rng = random.Random(22)
    rows = []
    for family in range(2):  # copies are near the base, and few are near one another
        base = [f"f{family}w{k}" for k in range(204)]
        rows.append((len(rows), " ".join(base)))
        for copy in range(60):
            changed = list(base)
            for k in rng.sample(range(0, 204, 5), 4 if copy % 3 else 5):
                changed[k] = f"c{copy}x{k}"
            rows.append((len(rows), " ".join(changed)))
    chain = [f"chain{k}" for k in range(100)]  # each link is near the one before, the ends are far apart
    for step in range(40):
        chain = chain[4:] + [f"step{step}x{k}" for k in range(4)]
        rows.append((len(rows), " ".join(chain)))
    got, want = same_groups(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert got == want


def test_units_link_what_is_within_the_radius(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(12):  # chains that lead away from their first print
        at = rng.getrandbits(128)
        for _ in range(15):
            prints.append(at)
            at ^= sum(1 << b for b in rng.sample(range(128), 18))
    rng.shuffle(prints)
    sizes = [rng.choice((0, 40, 49, 60, 75)) for _ in prints]
    radius = near_duplicates.RADII[-1]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    for parts in (1, 12, 400):
        rows = [(7, sizes[k], k, k, signed(v >> 64), signed(v % 2**64), k * 7 % parts, parts, 0) for k, v in enumerate(prints)]
        rows += [(8, *r[1:]) for r in rows[:3]]
        dealt = near_duplicates.dealt(spark.createDataFrame(rows, "group long, size long, member long, root long, high long, low long, p long, few long, many long"))
        links = [(r["a"], r["b"]) for r in near_duplicates.unit_links(dealt, 0.8).collect()]
        assert groups_of(range(len(prints)), links) == groups_of(range(len(prints)), near)
        assert len(links) <= len(prints) * parts


def test_near_copies_of_very_long_texts_and_clashing_names(spark, documents):
    rng = random.Random(3)
    words = [f"l{rng.randrange(10**6)}" for _ in range(300_000)]
    near = list(words)
    for k in rng.sample(range(len(words)), 5000):
        near[k] = "changed"
    far = [w if k % 10 else "other" for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in one_of_each(docs).collect()) == [1, 3]
    with pytest.raises(ValueError, match="_row"):
        near_duplicate_groups(documents.withColumnRenamed("source", "_row"))


def test_short_near_copies_are_within_the_radius():
    texts = []
    for k in range(1000):  # 8 and 9 words: 4 and 5 shingles, a similarity of 0.8
        words = [f"p{k}w{i}" for i in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    highs, lows = [], []
    for out in near_duplicates.describer(5)(iter([batch])):
        highs += out.column(3).to_pylist()
        lows += out.column(4).to_pylist()
    prints = [(h % 2**64) << 64 | w % 2**64 for h, w in zip(highs, lows)]
    sets = [shingle_set(t, 5) for t in texts]
    missed = 0
    for k in range(0, len(texts), 2):
        unit = near_duplicates.Unit(0.8)
        for at in (k, k + 1):
            unit.hold(at, at, prints[at], len(sets[at]), sets[at])
        missed += not unit.with_itself()
    assert missed == 0
