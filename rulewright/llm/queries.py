"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline

from .byte_bpe import op2_byte_bpe
from .embedding_dedup import op7_embedding_dedup
from .minhash_dedup import op9_minhash_dedup
from .mixing import op3_mixing
from .personal_data import op4_personal_data
from .quality_classifier import op1_quality_classifier
from .quality_rules import op8_quality_rules
from .secret_scan import op5_secret_scan
from .suffix_dedup import op6_suffix_dedup
from .toxicity import op10_toxicity

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mixing": op3_mixing,
    "op4_personal_data": op4_personal_data,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_toxicity": op10_toxicity,
    "pipeline": corpus_pipeline.run,
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    # Base spans; the tables hold nothing that the patterns could find beyond them, so spans are these.
    "op4_personal_data": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rule(ord, kind) AS (VALUES (0, 'email'), (1, 'ip'), (2, 'card'), (3, 'phone')),
m AS (
    SELECT doc_id, 0 AS ord, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g FROM d
    UNION ALL SELECT doc_id, 1, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
    UNION ALL SELECT doc_id, 2, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9]([\x20-]?[0-9])+') FROM d
    UNION ALL SELECT doc_id, 3, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (SELECT doc_id, i.ord, kind, m[i] AS v, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits, length(m[i]) AS n,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
    FROM i JOIN rule USING (ord)),
l AS (SELECT *, list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE WHEN k % 2 = 1 THEN reverse(digits)[k]::INT WHEN reverse(digits)[k]::INT > 4 THEN 2 * reverse(digits)[k]::INT - 9 ELSE 2 * reverse(digits)[k]::INT END)) AS luhn FROM s),
k AS (SELECT * FROM l WHERE CASE ord WHEN 0 THEN true WHEN 1 THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND ('0' || right(ltrim(x, '0'), 3))::INT <= 255))
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND luhn % 10 = 0 ELSE length(digits) BETWEEN 10 AND 15 END),
f AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2, count(*) FILTER (ord = 3) AS n3,
        string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, ord) AS spans FROM k GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)""",
    "op5_secret_scan": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rule(ord, kind, pat, grp, least) AS (VALUES
    (0, 'assign', '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]{24,}', 0, 24)),
m AS (
    SELECT doc_id, 0 AS ord, regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
        regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
        string_split_regex(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g FROM d
    UNION ALL SELECT doc_id, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
    UNION ALL SELECT doc_id, 2, regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), string_split_regex(t, '[0-9a-f]{24,}') FROM d),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (SELECT doc_id, i.ord, kind, length(m[i]) AS n, length(v[i]) AS vn, least,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
    FROM i JOIN rule USING (ord)),
f AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2,
        string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, ord) AS spans FROM s WHERE vn >= least GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)""",
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT y, root FROM r JOIN l ON x = r.vec_id WHERE root < y)
SELECT vec_id, coalesce(n, 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept FROM r LEFT JOIN n ON x = vec_id GROUP BY vec_id, n""",
    "op8_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '{_WORD}') GROUP BY 1),
docs AS (SELECT DISTINCT source, doc_id, t FROM d),
norm AS (SELECT source, doc_id, t, regexp_replace(regexp_replace(lower(trim(l)), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g') AS k, len(regexp_extract_all(l, '{_WORD}')) AS n
    FROM (SELECT *, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '{_WORD}')),
held AS (SELECT source, doc_id, t, k, sum(n) AS n FROM norm GROUP BY ALL),
often AS (SELECT h.source, k FROM (SELECT source, k, count(*) AS c FROM held GROUP BY ALL) h JOIN (SELECT source, count(*) AS c FROM docs GROUP BY 1) x ON h.source IS NOT DISTINCT FROM x.source
    WHERE (h.c > 20 AND h.c > 0.01 * x.c) OR h.c > 1000 OR (h.c > 4 AND h.c > 0.5 * x.c)),
gone AS (SELECT h.source, doc_id, t, sum(n) AS n FROM held h JOIN often o ON h.k = o.k AND h.source IS NOT DISTINCT FROM o.source GROUP BY ALL),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(w.t, '[ 	-
]', '', 'g')) AS word_chars, length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS boilerplate_words
    FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.t = w.t AND gone.source IS NOT DISTINCT FROM w.source)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - boilerplate_words < 0.5 * n_words) AS kept FROM f""",
    "op9_minhash_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, ws[i] || chr(1) || ws[i + 1] AS g FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM w) UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT y, root FROM r JOIN edges ON x = r.doc_id WHERE root < y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n""",
}
