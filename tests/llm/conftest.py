import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Texts with copies, near copies, nulls, empties, ties, long words, and columns whose names clash with inner ones."""
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "the", "of", "und", "éa", "x1", "kilo", "lima", "mike"] + [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 5, 30, 120)))) for _ in range(60)]
    texts += [texts[7]] * 5 + [texts[9] + " extra words here", texts[10].replace(" ", "\n", 3), None, None, "", " \t\n ", "A" * 5000, "one", "ONE", "word " * 3000]
    rows = [(k, t, "en", ["big", "big", "big", "s1", "s2", None][k % 6], len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], (None, texts[0], None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    return documents.withColumns({c: F.lit("x") for c in ("_id", "_text", "score", "chunk", "spans", "slot", "member", "_row", "n_words", "shard", "size")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
