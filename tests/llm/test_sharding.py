import random

from collections import Counter

from pyspark.sql import functions as F

from lakeloom.llm.sharding import stratified_shards


def test_sizes_slots_and_mixture(documents, clashing):
    rows = stratified_shards(clashing, shards=7).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == documents.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    mixture = Counter((r["source"], r["shard"]) for r in rows)
    for source, n in Counter(r["source"] for r in rows).items():
        assert all(abs(mixture[source, s] - n / 7) < 2 for s in sizes)


def test_same_for_the_same_seed(documents):
    key = lambda r: tuple(map(repr, r))
    once, again = (sorted(stratified_shards(documents.repartition(n), 5, seed=3).collect(), key=key) for n in (2, 5))
    assert [(r["doc_id"], r["shard"]) for r in once] == [(r["doc_id"], r["shard"]) for r in again]


def test_few_and_no_rows(spark, nothing):
    assert stratified_shards(nothing).count() == 0
    one = nothing.sparkSession.createDataFrame([(1, "a", None, None, 1)], nothing.schema)
    row = stratified_shards(one, 16).first()
    assert (row["shard"], row["slot"], row["size"]) == (0, 0, 2)


def test_shards_against_a_plain_ranking(spark):
    rng = random.Random(7)
    rows = [(k, f"t{rng.randrange(40)}", rng.choice(["a", "a", "a", "b", "c", None])) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = docs.select("doc_id", "source", F.xxhash64(F.lit(17), "doc_id", "text").alias("h"), F.xxhash64(F.lit(17), "source").alias("turn")).collect()
    order = []
    for source in {r["source"] for r in hashed}:
        own = sorted((r for r in hashed if r["source"] == source), key=lambda r: (r["h"], r["doc_id"]))
        order += [((rank + 0.5) / len(own), r["turn"], source or "", rank, r["doc_id"]) for rank, r in enumerate(own)]
    order.sort()
    want, slots = {}, {}
    for place, (*_, doc_id) in enumerate(order):
        shard = place * 16 // len(order)
        want[doc_id] = (shard, slots.setdefault(shard, 0))
        slots[shard] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in stratified_shards(docs, shards=16).collect()} == want
