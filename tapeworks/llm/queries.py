"""The queries of this subpackage, by name, and SQL for those that have any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .contamination import op10_contamination
from .importance import op6_importance
from .jaccard import op1_ngram_join
from .language import op3_language
from .lm import op5_lm_score
from .packing import op8_packing
from .quality import op4_line_labels
from .secrets import op7_secret_scan
from .tokens import op9_token_counts
from .warc import op2_content_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_content_archive": op2_content_archive,
    "op3_language": op3_language,
    "op4_line_labels": op4_line_labels,
    "op5_lm_score": op5_lm_score,
    "op6_importance": op6_importance,
    "op7_secret_scan": op7_secret_scan,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_contamination": op10_contamination,
}

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"""

#: Operators whose results SQL can express; the others are held against brute
#: force, the libraries' own results, or held-out rows in tests.
ORACLES: dict[str, str] = {
    "op1_ngram_join": f"""WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM words),
        shingles AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM sets),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a)
        SELECT s.doc_id, any_value(CAST(len(s.g) AS BIGINT)) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id""",
    "op2_content_archive": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p""",
    "op10_contamination": f"""WITH item_words AS (SELECT item_id, {_WORDS.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: w[i:i + least(13, len(w)) - 1])), ' ') AS t FROM item_words WHERE len(w) > 0),
        doc_words AS (SELECT doc_id, {_WORDS.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
        places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
        found AS (SELECT doc_id, p.n, i, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM places) p JOIN windows USING (n, t)),
        hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
