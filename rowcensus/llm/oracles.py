"""Operators as DuckDB SQL over the given tables, for the correctness check."""

from __future__ import annotations

from .words import WORD_PATTERN

EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

CLOSE_VECTORS = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x != 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id != b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT vec_id, b FROM reach JOIN links ON r = a),
parts AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM parts LEFT JOIN counts ON vec_id = a"""

NEAR_COPIES = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '{WORD_PATTERN}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id != b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, b FROM reach JOIN links ON r = a),
parts AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM parts LEFT JOIN sizes USING (doc_id)"""

REPEATS = f"""
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM worded WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT pos) AS places FROM (SELECT doc_id, unnest(range(i, i + 20)) AS pos FROM later) GROUP BY doc_id),
kept AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM worded)
         ANTI JOIN (SELECT doc_id, unnest(places) AS pos FROM gone) USING (doc_id, pos)),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM kept GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256
FROM worded LEFT JOIN gone USING (doc_id) LEFT JOIN texts t USING (doc_id)"""

MIDDLES = r"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', doc_id)) AS d,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
    FROM documents
), numbers AS (
    SELECT *, len(units) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
        ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
    FROM drawn
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
             THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), pieces AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
        array_to_string(units[b + 1:], '') AS suffix
    FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
        ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM pieces
"""

CHATS = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS odd(turn, role)
), escaped AS (
    SELECT *, [regexp_replace(regexp_replace(c, '(\\*)(<turn>|<says>|</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')
        FOR c IN [role, text]] AS contents
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(contents[1]) + length(contents[2]) + 19) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

HARD_NEGATIVES = """
WITH good AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), found AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
    FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= 10"""

PLACES = "SELECT doc_id, TRUE AS whole, TRUE AS gapless FROM documents"

URL_RULES = """
WITH parts AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), pieces AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), rules(rule, rule_host, rule_path, verdict) AS (
    VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
)
SELECT page_id, host, path, rule, verdict
FROM pieces LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1"""

# The level at which the capped targets share all words is the largest that any number of
# capped sources, those of the smallest cap by weight, would leave to the others.
TARGETS = f"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')) AS size FROM documents
), ranked AS (
    SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighted AS (
    SELECT *, (place - 1) % 3 + 1 AS weight FROM ranked
), left_over AS (
    SELECT (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighted
    WINDOW before AS (ORDER BY 3.0 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size,
    round(least(3.0 * source_size, (SELECT max(level) FROM left_over) * weight), 3) AS target, TRUE AS bounded, TRUE AS met
FROM sized JOIN weighted ON sized.source IS NOT DISTINCT FROM weighted.source"""
