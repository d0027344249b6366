"""The thin ``opN_*`` queries: one operator each, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, html_text, interpolation, licenses, packing, sharding, simhash, sketches, token_counts, toxicity
from lakeloom.llm.common import tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(of: int) -> F.Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def op1_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(_remainder(5) == 1, interpolation.UNSEEN).when(_remainder(5) == 0, interpolation.DELETED).otherwise(interpolation.KEPT)
    scored = interpolation.score_documents(_table(spark, sf_dir, "documents"), part)
    held_out = (F.col("part") == interpolation.UNSEEN).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.document_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=1024)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, capacity=1024).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.stratified_shards(_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), words=3, radius=2)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, tokenizer_path("piece_bpe_32k.model"), token_counts.fresh_cache(docs))


def op6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketches.version_sketches(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, settings = _table(spark, sf_dir, "documents"), toxicity.Settings()
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), settings, learn=_remainder(3) != 1)
    scored = toxicity.score(docs, model, settings)
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _joined(labels) -> F.Column:
    return F.concat_ws(",", F.sort_array(F.array_distinct(labels)))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(_table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _joined(F.transform(base, lambda m: m["label"])).alias("base_labels"),
        _joined(F.transform("matches", lambda m: m["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    items = F.concat_ws(",", F.sort_array("items"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract_pages(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Query] = {
    "op1_interpolation": op1_interpolation,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_sketches": op6_sketches,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_decontamination": op9_decontamination,
    "op10_html_text": op10_html_text,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(table: str, key: str) -> str:
    """Words of a table's texts as a list, in DuckDB."""
    return rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {table}"


def template_pattern(markup: str) -> str:
    """A template as a regular expression over words that each follow a blank."""
    out, depth = "", 0
    for token in licenses._MARK.findall(markup):
        if token in ("[[", "(("):
            out, depth = out + "(?:", depth + 1
        elif token == "]]":
            out, depth = out + ")?", depth - 1
        elif token == "))":
            out, depth = out + ")", depth - 1
        elif token == "|":
            out += "|"
        elif token.startswith("{{"):
            _, pattern, span = token[2:-2].rsplit(":", 2)
            out += f"(?: {pattern.replace('.', '[^ ]')}){{{span.replace('-', ',')}}}"
        else:
            out += " " + token
    return out + " "


def licenses_sql() -> str:
    phrases = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for label, phrase in licenses.BASE_PHRASES)
    score = lambda template: repr(licenses.compile_template(*template).score)
    templates = ", ".join(f"CASE WHEN regexp_matches(line, '{template_pattern(markup)}') THEN {{{{'label': '{label}', 'score': {score((label, markup))}::DOUBLE}}}} END" for label, markup in licenses.TEMPLATES).replace("{{", "{").replace("}}", "}")
    bases = " ".join(f"WHEN '{label}' THEN {score((label, phrase))}::DOUBLE" for label, phrase in licenses.BASE_PHRASES)
    return f"""WITH w AS ({_words_sql("documents", "doc_id")}), l AS (SELECT doc_id, ws, len(ws) AS n, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM w),
c AS (SELECT doc_id, ws, n, label, phrase, k FROM l, (VALUES {phrases}) t(label, phrase, k) WHERE contains(line, ' ' || phrase || ' ')),
h AS (SELECT doc_id, label, i - 1 AS start FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM c) WHERE array_to_string(list_slice(ws, i, i + k - 1), ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS base, max(CASE label {bases} END) AS worth FROM h GROUP BY doc_id),
m AS (SELECT doc_id, list_filter([{templates}], lambda x: x IS NOT NULL) AS own FROM l)
SELECT l.doc_id, l.n AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), list_transform(own, lambda x: x.label)))), ',') AS labels, coalesce(greatest(list_max(list_transform(own, lambda x: x.score)), worth), 0.0::DOUBLE) AS score
FROM l JOIN m USING (doc_id) LEFT JOIN b USING (doc_id)"""


DECONTAMINATION_SQL = f"""WITH w AS ({_words_sql("documents", "doc_id")}), b AS (SELECT item_id, ws, greatest(len(ws) - 9, 1) AS n FROM ({_words_sql("benchmark", "item_id")}) WHERE len(ws) > 0),
v AS (SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + 9), ' ') AS key, least(len(ws), 10) AS k FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM b)),
d AS (SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS key FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM v))),
o AS (SELECT doc_id, item_id, i, k FROM d JOIN v USING (k, key)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

#: For pages whose article is one element of headings and paragraphs, as in the shared tables.
HTML_SQL = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', '''')) AS parts FROM b),
d AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM d)"""

#: The other operators' rows cannot be had from SQL; those queries are tested against brute force.
ORACLES: dict[str, str] = {"op8_licenses": licenses_sql(), "op9_decontamination": DECONTAMINATION_SQL, "op10_html_text": HTML_SQL}
