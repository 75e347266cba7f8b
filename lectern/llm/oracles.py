"""SQL (DuckDB) for the operators of which SQL can express the whole result."""

from __future__ import annotations

#: Counts of terms by language and source, shares in billionths, all pairs and the top terms.
DIVERGENCE = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
v AS MATERIALIZED (SELECT lang, term, count(*) AS uses FROM d GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS uses FROM d SEMI JOIN v USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS v, sum(uses) + 2 * count(*) AS size FROM v GROUP BY 1),
g AS MATERIALIZED (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(n, 0) + 2 * coalesce(l.v, 0) AS size FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) g
LEFT JOIN (SELECT lang, source, sum(uses) AS n FROM c GROUP BY 1, 2) n USING (lang, source) LEFT JOIN l USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(c.uses, 0) AS uses, CAST(1 + 1000000000 * (coalesce(c.uses, 0) + 2)::HUGEINT // g.size AS BIGINT) AS p, CAST(1 + 1000000000 * (v.uses + 2)::HUGEINT // l.size AS BIGINT) AS q
FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE uses > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""


def lloyd(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd's rounds over the parts of all vectors, one after the other."""
    near = """SELECT x.id, x.p, arg_min(b.e, (d.v, b.e)) AS e, min(d.v) AS d FROM x JOIN b{k} b ON b.p = x.p, LATERAL (SELECT CAST(list_sum(list_transform(list_zip(x.c, b.c), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))) AS BIGINT) AS v) d GROUP BY 1, 2"""
    steps = []
    for k in range(rounds):
        steps.append(f"""a{k} AS MATERIALIZED ({near.format(k=k)}),
s{k} AS (SELECT p, e, j, sum(v) AS s, count(*) AS n FROM (SELECT a.p, a.e, unnest(x.c) AS v, generate_subscripts(x.c, 1) AS j FROM a{k} a JOIN x USING (id, p)) GROUP BY 1, 2, 3),
m{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{k} GROUP BY 1, 2),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))""")
    return f"""WITH r AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS id, list_transform(embedding, lambda v: CAST(floor({scale} * v::DOUBLE) AS BIGINT)) AS c FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT id, q.p, c[q.p * len(c) // {parts} + 1 : (q.p + 1) * len(c) // {parts}] AS c FROM r, (SELECT unnest(range({parts})) AS p) q),
b0 AS (SELECT p, CAST(id - 1 AS INTEGER) AS e, c FROM x WHERE id <= {entries}),
{", ".join(steps)},
z AS (SELECT id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM ({near.format(k=rounds)}) GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM r JOIN z USING (id)"""


#: Documents whose sets of five-word shingles are at least four fifths alike, and what they reach. Only sets of which four
#: fifths stand elsewhere can have a link; equal sets are one class.
NGRAM_JOIN = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM w),
s AS MATERIALIZED (SELECT id, list(g ORDER BY g) AS g, count(*) AS n FROM g GROUP BY 1),
c AS MATERIALIZED (SELECT min(id) AS c, g AS k FROM s GROUP BY g),
m AS MATERIALIZED (SELECT id, c, n FROM s JOIN c ON s.g = c.k),
u AS MATERIALIZED (SELECT g.id AS c, g.g FROM g SEMI JOIN c ON g.id = c.c),
d AS MATERIALIZED (SELECT g FROM u GROUP BY 1 HAVING count(*) > 1),
v AS MATERIALIZED (SELECT u.c, any_value(m.n) AS n FROM u SEMI JOIN d USING (g) JOIN m ON m.id = u.c GROUP BY 1 HAVING count(*) * 5 >= any_value(m.n) * 4),
x AS MATERIALIZED (SELECT u.c, u.g, v.n FROM u JOIN v USING (c) SEMI JOIN d USING (g)),
p AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.g = b.g AND a.c <> b.c AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4 GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
z AS (SELECT r.a AS c, min(w.doc_id) AS component_id FROM r JOIN m ON m.c = r.b JOIN w ON w.id = m.id GROUP BY 1)
SELECT w.doc_id, coalesce(m.n, 0) AS n_shingles, coalesce(z.component_id, w.doc_id) AS component_id FROM w LEFT JOIN m ON m.id = w.id LEFT JOIN z USING (c)"""
