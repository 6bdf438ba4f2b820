"""The queries of this subpackage: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from .bpe import bpe_encode
from .common import documents
from .decontaminate import overlaps
from .exact_dedup import exact_dedup
from .language_id import identify, train
from .line_dedup import MIN_SITES, remove_boilerplate
from .ngram_join import N, THRESHOLD, ngram_jaccard_join
from .secret_scan import RULES, scan_secrets
from .substring_dedup import MIN_WORDS, repeated_passages
from .token_counts import count_tokens
from .token_output import token_shards


def op1_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir))


def op2_token_shards(spark, sf_dir):
    return token_shards(documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard_join(documents(spark, sf_dir))


def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return identify(docs.select("doc_id", "text"), train(docs)).drop("text")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op6_secret_scan(spark, sf_dir):
    return scan_secrets(documents(spark, sf_dir)).select("doc_id", "rule", "nth", "secret")


def op7_line_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return remove_boilerplate(docs).drop("source")


def op8_decontaminate(spark, sf_dir):
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


def op9_bpe(spark, sf_dir):
    encoded = bpe_encode(documents(spark, sf_dir).select("doc_id", "text"))
    return encoded.drop("text")


def op10_substring_dedup(spark, sf_dir):
    return repeated_passages(documents(spark, sf_dir))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_token_shards, op3_ngram_jaccard_join, op4_language_id, op5_exact_dedup, op6_secret_scan, op7_line_dedup, op8_decontaminate, op9_bpe, op10_substring_dedup, pipeline)}

def _secrets_sql() -> str:
    parts = []
    for rule, expression in RULES.items():
        body = expression.removeprefix("\\b").replace("'", "''")
        whole = f"(?:^|[^0-9A-Za-z_-])({body})" if expression.startswith("\\b") else f"({body})"
        parts.append(f"SELECT doc_id, '{rule}' AS rule, regexp_extract_all(text, '{whole}', 1) AS found FROM documents")
    return f"SELECT doc_id, rule, CAST(generate_subscripts(found, 1) AS INTEGER) AS nth, unnest(found) AS secret FROM ({' UNION ALL '.join(parts)}) WHERE len(found) > 0"


#: The words of common.Words.
_WORDS = r"list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> '')"

_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(0, len(ws) - {N - 1}), lambda p: array_to_string(list_slice(ws, p + 1, p + {N}), ' ')) END)) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT g, min(doc_id) AS name, count(DISTINCT doc_id) AS copies FROM s GROUP BY g),
e AS (SELECT name, len(g) AS size, unnest(g) AS gram FROM n),
o AS (SELECT a.name AS a, b.name AS b, count(*) AS shared, any_value(a.size + b.size) AS sizes FROM e a JOIN e b ON a.gram = b.gram AND a.name < b.name GROUP BY ALL),
p AS (SELECT a, b FROM o WHERE shared >= {THRESHOLD} * (sizes - shared)),
t AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT a AS name, a AS root FROM t UNION SELECT t.b, r.root FROM r JOIN t ON r.name = t.a),
c AS (SELECT name, min(root) AS class_id FROM r GROUP BY name),
l AS (SELECT a AS name, sum(copies) AS links FROM t JOIN n ON t.b = n.name GROUP BY a)
SELECT d.doc_id, coalesce(class_id, name, d.doc_id) AS class_id, CAST(coalesce(links, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN n USING (g) LEFT JOIN c USING (name) LEFT JOIN l USING (name)
"""

_LINES = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
b AS (SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS text, count(b.line) AS n_removed FROM l LEFT JOIN b ON l.line = b.line GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL
"""

_PASSAGES = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, p, array_to_string(list_slice(ws, p + 1, p + {MIN_WORDS}), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {MIN_WORDS - 1})) AS p FROM w WHERE len(ws) >= {MIN_WORDS})),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS lo, max(doc_id) OVER (PARTITION BY g) AS hi FROM g),
r AS (SELECT *, lo = doc_id AS own, p - lag(p) OVER (PARTITION BY doc_id, lo = doc_id ORDER BY p) AS gap FROM f WHERE lo <> hi),
k AS (SELECT *, sum(CASE WHEN gap <= {MIN_WORDS} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, own ORDER BY p) AS span FROM r)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + {MIN_WORDS} AS INTEGER) AS end_word, CAST(max(p) + {MIN_WORDS} - min(p) AS INTEGER) AS n_words, min(lo) AS first_doc_id FROM k GROUP BY doc_id, own, span
"""

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": _JACCARD,
    "op5_exact_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NULL",
    "op6_secret_scan": _secrets_sql(),
    "op7_line_dedup": _LINES,
    "op10_substring_dedup": _PASSAGES,
}
