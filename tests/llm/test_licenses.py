import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lakeloom.llm.licenses import _MARK, BASE_PHRASES, TEMPLATES, Scanner, compile_template, license_matches
from lakeloom.llm.queries import ORACLES, QUERIES


def spans(markup, text):
    return compile_template("t", markup).matches(text.encode().split())


def test_regions():
    assert spans("a b", "x a b a b") == [(1, 3), (3, 5)]
    assert spans("a [[ very ]] b", "a b a very b a quite b") == [(0, 2), (2, 5)]
    assert spans("(( a | b c )) d", "a d b c d c d") == [(0, 2), (2, 5)]
    assert spans("version {{n:[0-9]+:1-2}}", "version 2 0 x version x version 3") == [(0, 3), (6, 8)]
    assert spans("c {{who:.+:0-2}} end", "c end c x end c x y end c x y z end") == [(0, 2), (2, 5), (5, 9)]
    for broken in ("a [[ b", "a ]] b", "[[ a ]]", "(( a | b"):
        with pytest.raises(ValueError):
            compile_template("t", broken)


def test_mandatory_wording_has_to_match():
    scanner = Scanner(BASE_PHRASES, TEMPLATES)
    label = lambda t: sorted({m[0] for m in scanner.scan(t)[1]})
    assert label("Released under the MIT License.") == ["mit", "mit-grant"]
    assert label("Licensed under the Apache License, Version 2.0.") == ["apache-2", "apache-2.0"]
    assert label("Licensed under CC BY-NC 4.0.") == ["cc-by-nc", "cc-by-nc-versioned"]
    assert label("This work is licensed under the GNU General Public License, version 3.") == ["gpl"]
    assert label("This work is licensed under a GNU General Public License, version 3.") == []
    assert label("under the mit-like license") == []


def test_every_place_against_brute_force(documents, clashing, nothing):
    extra = documents.sparkSession.createDataFrame([(500, "Under the MIT license, under the mit LICENSE; cc-by-nc", None, None, 0)], documents.schema)
    for d, rows in ((documents.union(extra), license_matches(documents.union(extra)).collect()), (documents, license_matches(clashing).collect())):
        import re

        want = []
        for r in d.collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
            places = sum(words[i : i + len(p.split())] == p.split() for _, p in BASE_PHRASES for i in range(len(words)))
            want.append((r["doc_id"] or -1, len(words), places))
        assert sorted((r["doc_id"] or -1, r["n_words"], sum(m["base"] for m in r["matches"])) for r in rows) == sorted(want)
    assert license_matches(nothing).count() == 0
    assert license_matches(extra).select(F.size("matches")).first()[0] == 3


def instance(markup, rng):
    """A text that a template accepts, as words with whether each is mandatory."""
    tokens, at = _MARK.findall(markup), 0

    def sequence(required):
        nonlocal at
        out = []
        while at < len(tokens) and tokens[at] not in ("]]", "))", "|"):
            token = tokens[at]
            at += 1
            if token in ("[[", "(("):
                branches = []
                while True:
                    branches.append(sequence(False))
                    at += 1
                    if tokens[at - 1] != "|":
                        break
                out += rng.choice(branches + [[]] * (token == "[["))
            elif token.startswith("{{"):
                _, pattern, span = token[2:-2].rsplit(":", 2)
                least, most = map(int, span.split("-"))
                word = {".+": "acme", "[0-9]+": "7", "[1a]": "1", "[2b]": "b", "[3c]": "3", "https?": "https"}[pattern]
                out += [(word, False)] * rng.randint(least, most)
            else:
                out.append((token, required))
        return out

    return sequence(True)


@pytest.mark.parametrize(("label", "markup"), TEMPLATES, ids=[t[0] for t in TEMPLATES])
def test_wording_is_accepted_and_any_change_of_it_is_not(label, markup):
    rng, scanner = random.Random(label), Scanner(BASE_PHRASES, TEMPLATES)
    labels = lambda words: {m[0] for m in scanner.scan("Before: " + ", ".join(words).upper() + ". After")[1]}
    for _ in range(6):
        words = instance(markup, rng)
        assert label in labels([w for w, _ in words])
        mandatory = [k for k, (_, must) in enumerate(words) if must]
        for k in rng.sample(mandatory, min(8, len(mandatory))):
            changed = [w for w, _ in words]
            assert label not in labels([*changed[:k], "qqq", *changed[k + 1 :]])
            assert label not in labels([*changed[:k], *changed[k + 1 :]])
            if k + 1 in mandatory:  # nothing may stand between two mandatory words
                assert label not in labels([*changed[: k + 1], "but", "never", *changed[k + 1 :]])


def test_scores_rise_with_mandatory_words():
    scores = {label: compile_template(label, markup).score for label, markup in BASE_PHRASES + TEMPLATES}
    assert scores["mit-text"] > scores["mit-grant"] >= 0.5 and scores["bsd-3-clause"] > scores["bsd-2-clause"] > 0.9 and all(0 < s < 1 for s in scores.values())


def test_sql_agrees_on_license_texts_and_long_texts(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(w for w, _ in instance(markup, rng)) for _, markup in TEMPLATES for _ in range(2)]
    texts += [t.replace(" the ", " a ", 1) for t in texts] + ["word " * 100_000 + texts[2], "under the mit license " * 20_000, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op8_licenses"](spark, str(tmp_path))
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = database.execute(ORACLES["op8_licenses"])
    names = [c[0] for c in found.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(found.fetchall())
