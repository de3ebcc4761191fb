"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._common import durable, table
from sparkloom.llm.decontaminate import contaminated_spans
from sparkloom.llm.html_extract import main_text
from sparkloom.llm.language_id import fit, identify
from sparkloom.llm.mixing import with_rates
from sparkloom.llm.near_dedup import near_duplicates
from sparkloom.llm.paragraph_dedup import duplicate_paragraphs
from sparkloom.llm.secret_scan import findings_by_path, scan_new
from sparkloom.llm.suffix_dedup import repeated_passages
from sparkloom.llm.topk_search import top_k
from sparkloom.llm.url_filter import RULES, filter_urls


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_paragraphs(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instalments of the corpus: conversations, then documents, of which only the texts that the ledger does not list yet are scanned."""
    docs, talks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    ledger = durable(scan_new(talks))
    ledger = ledger.unionByName(durable(scan_new(docs, ledger)))
    return findings_by_path(docs, ledger, ["source", "doc_id"])


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).withColumn("rules", F.array_join("rules", ","))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rates(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "tokens", "rate", "copies")


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_minhash_near_dedup, op3_paragraph_dedup, op4_decontamination, op5_html_extraction,
        op6_language_id, op7_topk_search, op8_secret_scan, op9_url_filter, op10_mixing,
    )
}

def _like(glob: str) -> str:
    """A glob as a regular expression for SQL."""
    parts = re.findall(r"\[[^\]]+\]|.", glob)
    return "".join(".*" if p == "*" else "." if p == "?" else p.replace("[!", "[^") if len(p) > 1 else re.escape(p) for p in parts).replace("'", "''")


_MATCHES = ", ".join(f"CASE WHEN regexp_full_match(c, '{_like(g)}', 's') THEN {i} END" for i, (_, g, _) in enumerate(RULES))
_NAMES = ", ".join(f"'{n}'" for n, _, _ in RULES)
_ALLOW = ", ".join(str(a == "allow").lower() for _, _, a in RULES)

SQL: dict[str, str] = {
    # every window of 50 words, by its text
    "op1_suffix_dedup": """
        WITH w AS (
            SELECT DISTINCT doc_id, text, list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
        ), g AS (
            SELECT doc_id, text, unnest(range(len(ws) - 49)) AS i, unnest(list_transform(range(len(ws) - 49), lambda j: md5(array_to_string(ws[j + 1:j + 50], ' ')))) AS k
            FROM w WHERE len(ws) >= 50
        ), c AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS LAST, i) AS r FROM g),
        s AS (
            SELECT doc_id, text, 'repeated' AS role, i AS s, i + 50 AS e FROM c WHERE n > 1
            UNION ALL SELECT doc_id, text, 'remove', i, i + 50 FROM c WHERE r > 1
        ), m AS (
            SELECT *, coalesce(s > max(e) OVER (PARTITION BY doc_id, text, role ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INTEGER AS new FROM s
        ), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text, role ORDER BY s) AS run FROM m)
        SELECT doc_id, role, min(s)::INTEGER AS start_word, max(e)::INTEGER AS end_word, (max(e) - min(s))::INTEGER AS n_words FROM r GROUP BY doc_id, text, role, run
    """,
    # common runs on each diagonal of a document and an item that exceed a limit, without those that another one holds
    "op4_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{80}-\\x{10FFFF}]+') AS ws FROM documents WHERE text IS NOT NULL),
        b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[0-9a-z_\\x{80}-\\x{10FFFF}]+') AS ws FROM benchmark WHERE text IS NOT NULL),
        dg AS (SELECT doc_id, unnest(range(len(ws) - 7)) AS i, unnest(list_transform(range(len(ws) - 7), lambda j: array_to_string(ws[j + 1:j + 8], ' '))) AS k FROM d WHERE len(ws) >= 8),
        bg AS (SELECT item_id, len(ws) AS size, unnest(range(len(ws) - 7)) AS j, unnest(list_transform(range(len(ws) - 7), lambda x: array_to_string(ws[x + 1:x + 8], ' '))) AS k FROM b WHERE len(ws) >= 8),
        h AS (SELECT doc_id, item_id, size, i, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM dg JOIN bg USING (k)),
        m AS (SELECT doc_id, item_id, size, min(i) AS s, max(i) + 8 AS e FROM h GROUP BY doc_id, item_id, size, diagonal, run HAVING max(i) + 8 - min(i) >= 13 OR max(i) + 8 - min(i) >= 0.6 * size),
        t AS (SELECT doc_id, s, e, min(struct_pack(size := size, item_id := item_id)) AS item FROM m
            WHERE NOT EXISTS (FROM m o WHERE o.doc_id = m.doc_id AND o.s <= m.s AND o.e >= m.e AND o.e - o.s > m.e - m.s) GROUP BY doc_id, s, e)
        SELECT doc_id, s::INTEGER AS start_word, e::INTEGER AS end_word, (e - s)::INTEGER AS n_words, item.item_id AS item_id, (e - s)::DOUBLE / item.size AS coverage FROM t
    """,
    "op7_topk_search": """
        WITH pairs AS (
            SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour_id)::INTEGER AS rank FROM pairs)
        SELECT vec_id, rank, neighbour_id, round(d, 6) AS distance FROM ranked WHERE rank <= 10
    """,
    # the forms of URL that the table has: no user, port, escape or dot segment
    "op9_url_filter": f"""
        WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM pages),
        p AS (SELECT page_id, regexp_replace(lower(split_part(split_part(u, '?', 1), '/', 1)), '^www[.]', '') AS host, list_filter(string_split(split_part(u, '?', 1), '/')[2:], lambda x: x <> '') AS parts,
            list_sort(list_filter(string_split(split_part(u, '?', 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_|(gclid|fbclid|ref)(=|$))'))) AS fields FROM u),
        c AS (SELECT page_id, host || '/' || coalesce(array_to_string(parts, '/'), '') || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS c FROM p),
        m AS (SELECT page_id, c, list_filter([{_MATCHES}], lambda x: x IS NOT NULL) AS hit FROM c)
        SELECT page_id, c AS canonical_url, coalesce(array_to_string(list_transform(hit, lambda i: [{_NAMES}][i + 1]), ','), '') AS rules, [{_NAMES}][hit[-1] + 1] AS rule,
            coalesce([{_ALLOW}][hit[-1] + 1], true) AS kept FROM m
    """,
}
