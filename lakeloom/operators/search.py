"""Full-text search over facts: boolean queries, phrases, prefixes, and BM25 ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.scores import decayed
from lakeloom.plans.terms import RuleError

#: Parameters of the ranking function.
K1, B = 1.2, 0.75
_TOKEN = re.compile(r'"([^"]*)"(\*?)|(\()|(\))|([^\s()"]+)')
_WORDS = r"[^\p{L}\p{N}]+"


def search_text(args: Column) -> Column:
    """The strings, numbers and booleans of a JSON object in the order of their keys; other text as it is."""
    held = F.from_json(args, "map<string,string>")
    kinds = F.transform(F.array_sort(F.map_keys(held)), lambda k: held[k])
    flat = F.filter(kinds, lambda v: v.isNotNull() & ~(v.startswith("{") | v.startswith("[")))
    return F.when(F.try_parse_json(args).isNull() | held.isNull(), args).otherwise(F.array_join(flat, " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORDS), lambda t: t != "")


def _leaf(words: list[str], prefix: bool, found: Column) -> Column:
    if not words:
        return F.lit(False)
    if len(words) == 1:
        return F.exists(found, lambda t: t.startswith(words[0])) if prefix else F.array_contains(found, words[0])
    line = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))  # tokens hold no blanks
    return line.contains(" " + " ".join(words) + ("" if prefix else " "))


def match(query: str, found: Column) -> Column:
    """A predicate on a token array: words are ANDed; AND, OR, NOT, parentheses, "phrases" and prefix* as usual."""
    items: list[tuple[str, object]] = []
    for phrase, star, opening, closing, word in _TOKEN.findall(query):
        if opening or closing:
            items.append((opening or closing, None))
        elif word in ("AND", "OR", "NOT"):
            items.append((word, None))
        else:
            raw = phrase if not word else word
            prefix = bool(star) or raw.endswith("*")
            words = [w for w in re.split(r"[^\w]+|_", raw.lower()) if w]
            items.append(("leaf", _leaf(words, prefix, found)))
    at = 0

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(items) and items[at][0] == "OR":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = single()
        while at < len(items) and items[at][0] not in ("OR", ")"):
            negate = items[at][0] == "NOT"
            at += items[at][0] in ("AND", "NOT")
            right = single()
            out = out & (~right if negate else right)
        return out

    def single() -> Column:
        nonlocal at
        if at >= len(items):
            raise RuleError(f"the search {query!r} ends too early")
        kind, leaf = items[at]
        at += 1
        if kind == "(":
            out = either()
            if at >= len(items) or items[at][0] != ")":
                raise RuleError(f"the search {query!r} has an open parenthesis")
            at += 1
            return out
        if kind != "leaf":
            raise RuleError(f"{kind} stands where a word should in {query!r}")
        return leaf

    out = either()
    if at != len(items):
        raise RuleError(f"the search {query!r} cannot be read")
    return out


def _occurrences(word: str) -> Column:
    return F.size(F.filter("_t", lambda t: t == word))


def bm25(texts: DataFrame, query_words: list[str], id_col: str, text_col: str) -> DataFrame:
    """``(id, score)`` of texts with any of the words: one pass for the statistics, without an exploded index."""
    words = [w.lower() for w in dict.fromkeys(query_words)]
    found = texts.select(id_col, tokens(F.col(text_col)).alias("_t")).select(id_col, F.size("_t").alias("_n"), *(_occurrences(w).alias(f"_f{k}") for k, w in enumerate(words)))
    stats = found.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"), *(F.count_if(F.col(f"_f{k}") > 0).alias(f"_d{k}") for k in range(len(words))))
    rows = found.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(words)):
        f, d = F.col(f"_f{k}"), F.col(f"_d{k}")
        idf = F.greatest(F.log((F.col("_docs") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))
    any_word = F.lit(False)
    for k in range(len(words)):
        any_word = any_word | (F.col(f"_f{k}") > 0)
    return rows.where(any_word).select(id_col, score.alias("score"))


def search(facts: DataFrame, query: str, relation: str | None = None, limit: int | None = 20) -> DataFrame:
    """Current facts that match, best first; all of them where ``limit`` is None."""
    live = facts.where("valid_end is null and tx_end is null")
    if relation is not None:
        live = live.where(F.col("relation") == relation)
    live = live.withColumn("_text", search_text(F.col("args")))
    hits = live.where(match(query, tokens(F.col("_text"))))
    words = [w for w in re.findall(r"[\w]+", query.lower()) if w not in ("and", "or", "not")]
    ranked = hits.join(bm25(live, words, "id", "_text"), "id", "left")
    ranked = ranked.orderBy(F.desc_nulls_last("score"), "id").drop("_text")
    return ranked if limit is None else ranked.limit(limit)


def memory_context(facts: DataFrame, query: str, now: int, limit: int = 10) -> DataFrame:
    """Promoted observations that match, ranked by what is left of their worth."""
    live = facts.where("valid_end is null and tx_end is null and relation = 'observation'").where(F.get_json_object("args", "$.status") == "promoted")
    hits = live.where(match(query, tokens(search_text(F.col("args")))))
    worth = F.coalesce(F.get_json_object("args", "$.worth").try_cast("double"), F.lit(0.5))
    hits = hits.withColumn("decayed_worth", decayed(worth, F.lit(now) - F.col("valid_start")))
    return hits.orderBy(F.desc("decayed_worth"), "id").limit(limit).select("id", "args", "source", "decayed_worth")
