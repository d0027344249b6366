import random
from binascii import crc32

import corpus_pipeline


def test_stages_drop_what_is_planted_and_nothing_else(spark, tmp_path):
    rng = random.Random(12)
    syllables = ["ta", "lo", "mi", "ren", "su", "ka", "pel", "dor"]
    words = lambda n: ["".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(n)]
    rows, labels = [], []
    for k in range(400):  # clean and toxic texts, most of them labelled
        text = words(rng.randrange(30, 90))
        toxic = int(k % 4 == 0)
        for _ in range(4 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["vilro", "naskep", "dredmu"]) + rng.choice(["", "ta"]))
        rows.append((k, " ".join(text)))
        labels.append((k, 0, toxic))
    toxic = {k for k in range(400) if k % 4 == 0}
    base = words(120)
    rows += [(1000, " ".join(base)), (1001, " ".join(base)), (1002, " ".join(base[:-3] + words(3))), (1003, " ".join(base[:60] + words(60)))]
    passage = words(12)
    rows += [(2000, " ".join(words(20) + passage + words(20))), (2001, " ".join(words(20) + passage[:9] + words(20))), (3000, ""), (3001, None), (3002, " ".join(words(300_000)))]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b1", " ".join(passage))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    every = {k for k, _ in rows}
    unseen = {k for k in toxic if crc32(str(k).encode()) % 3 == 1}
    assert len(toxic - kept["toxicity"]) >= 0.9 * len(toxic) and len(unseen - kept["toxicity"]) >= 0.9 * len(unseen)
    assert len(every - toxic - kept["toxicity"]) <= 3 and {1000, 1001, 1002, 1003, 2000, 2001, 3000, 3001, 3002} <= kept["toxicity"]
    assert kept["near_duplicates"] == kept["toxicity"] - {1001, 1002, 3001}
    assert kept["decontamination"] == kept["near_duplicates"] - {2000}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == kept["decontamination"]
    for k in kept["decontamination"]:
        own = sorted((r["start"], r["length"]) for r in packed if r["doc_id"] == k)
        assert [s for s, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    run = {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()}
    assert run == {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed}
