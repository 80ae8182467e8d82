"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op13_tokenizer_alignment
from .class_lm import op8_brown_lm
from .decontamination import op7_decontamination
from .divergence import op12_source_divergence
from .language_id import op4_crf_language
from .mixing import op1_source_mixing
from .near_dups import op5_ngram_jaccard_join
from .pii import op10_weak_pii
from .quality import op3_mcd_quality
from .secrets import op6_secret_scan
from .token_output import op9_token_output
from .toxicity import op2_toxicity
from .vectors import op11_vector_links

QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixing,
        op2_toxicity,
        op3_mcd_quality,
        op4_crf_language,
        op5_ngram_jaccard_join,
        op6_secret_scan,
        op7_decontamination,
        op8_brown_lm,
        op9_token_output,
        op10_weak_pii,
        op11_vector_links,
        op12_source_divergence,
        op13_tokenizer_alignment,
    )
}

#: Links by shared shingles over all pairs, then the smallest doc_id that is reachable.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), tokens AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
    SELECT doc_id AS node, doc_id AS root FROM sets
    UNION
    SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(sets.doc_id, min(root)) AS component_id
FROM sets JOIN reach ON reach.node = sets.doc_id
GROUP BY sets.doc_id, len(s)
"""

#: Every pair of sources over every kept term, without grouping.
DIVERGENCE = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
    SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), langs AS (
    SELECT lang, sum(n) AS total, CAST(count(*) AS HUGEINT) AS size FROM kept GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
    SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + l.size) AS p, 1 + 1000000000 * (k.n + 1) // (l.total + l.size) AS whole
    FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, (p - whole) * (p - whole) // whole FROM shares WHERE n > 0 AND p > whole
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL: dict[str, str] = {"op5_ngram_jaccard_join": NEAR_DUPLICATES, "op12_source_divergence": DIVERGENCE}
