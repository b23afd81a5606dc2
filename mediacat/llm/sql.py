"""DuckDB SQL for the corpus queries that SQL can state."""

from __future__ import annotations

from .chat import CONTROL

OP2 = """WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
e AS (SELECT doc_id, list_filter(w, lambda x: x <> '') AS w FROM d),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]) END AS g FROM e),
n AS (SELECT doc_id, len(g) AS n FROM s), u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT b, m FROM r JOIN both_ways ON a = r.doc_id WHERE m < b)
SELECT n.doc_id, n.n AS n_shingles, min(m) AS component_id, min(m) = n.doc_id AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""

_ESCAPES = " + ".join(["length(text) - length(replace(text, '\\', ''))", *(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in CONTROL)])

OP3 = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(12 + length(role) + 1 + length(text) + 11 + {_ESCAPES})::bigint AS formatted_chars FROM t GROUP BY conv_id"""

# base 32: each 5 hexadecimal digits are 4 letters
OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT page_id, html, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(html))::bigint AS payload_bytes,
array_to_string(flatten([[('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[(((('0x' || h[5*i+1:5*i+5])::int >> (15 - 5*j)) & 31) + 1)::int] for j in range(0, 4)] for i in range(0, 8)]), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11 = f"""WITH t AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents), d AS (SELECT r, doc_id, len(w) AS n FROM t WHERE len(w) > 0),
g AS (SELECT count(*) AS n_docs, sum(n)::bigint AS n_terms FROM d), b AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT i, term, count(*) AS repeats FROM (SELECT i, unnest(w) AS term FROM b) GROUP BY 1, 2),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT i, r, sum(repeats * floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::bigint AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), g GROUP BY 1, 2),
k AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM k JOIN b USING (i) WHERE rank <= 20"""

OP12 = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, ('0x' || substr(h, 1, 8))::bigint AS h1, ('0x' || substr(h, 9, 8))::bigint AS h2, ('0x' || substr(h, 17, 8))::bigint AS h3, ('0x' || substr(h, 25, 8))::bigint AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a+1:b], ''), '') AS y, coalesce(array_to_string(u[b+1:n], ''), '') AS z FROM c)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
