"""Expected rows of the operators that SQL can express, for an independent engine."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
items AS (
    SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
    SELECT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
    SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT r, item_id, i, size FROM grams JOIN windows USING (size, phrase)),
hit_words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
hit_items AS (
    SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words hw USING (r) LEFT JOIN hit_items hi USING (r)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, s
    FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs LEFT JOIN sizes USING (doc_id) JOIN least_of USING (doc_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
    SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = other),
least_of AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least_of USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

_PART_ROUNDS = 4


def _vector_codes() -> str:
    """Codebooks by plain search, round after round."""
    apart = "list_sum(list_transform(list_zip(parts.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(_PART_ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
    SELECT r, parts.p, min(struct_pack(d := coalesce({apart}, 0), e := c.e)) AS best FROM parts JOIN c{k} c ON c.p = parts.p GROUP BY r, parts.p)""")
        if k < _PART_ROUNDS:
            steps.append(f"""m{k} AS (
    SELECT p, e, i, CAST((t - ((t % n) + n) % n) // n AS BIGINT) AS x
    FROM (SELECT parts.p, best.e AS e, i, sum(s[i]) AS t, count(*) AS n
          FROM parts JOIN a{k} USING (r, p), (SELECT unnest(range(1, (SELECT max(len(s)) FROM parts) + 1)) AS i) GROUP BY ALL)),
c{k + 1} AS MATERIALIZED (
    SELECT p, e, coalesce(n.s, c.s) AS s FROM c{k} c LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS s FROM m{k} GROUP BY p, e) n USING (p, e))""")
    last = _PART_ROUNDS
    return f"""
WITH vectors AS (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS s FROM vectors, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, r - 1 AS e, s FROM parts WHERE r <= 256),
{", ".join(steps)},
codes AS (
    SELECT r, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
    FROM a{last} GROUP BY r),
books AS (
    SELECT sha256(string_agg(CAST(s[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS digest
    FROM c{last}, (SELECT unnest(range(1, (SELECT max(len(s)) FROM parts) + 1)) AS i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM vectors JOIN codes USING (r), books
"""


VECTOR_CODES = _vector_codes()

_TERMS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
RANKED_SEARCH = f"""
WITH docs AS (
    SELECT r, doc_id, w, len(w) AS n
    FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(f"coalesce({_LOWER}, '')")} AS w FROM documents) WHERE len(w) > 0),
size AS (SELECT count(*) AS n_docs, sum(n) AS n_words FROM docs),
postings AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) GROUP BY r, t),
weights AS (
    SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
    FROM postings, size GROUP BY t),
item_terms AS (
    SELECT item_id, t, count(*) AS repeats
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL), (SELECT unnest({_TERMS.format(_LOWER)}) AS t) GROUP BY ALL),
shares AS (
    SELECT r, t, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + CAST((75 * n * n_docs) // n_words AS BIGINT))) AS share
    FROM postings JOIN docs USING (r), size),
scores AS (
    SELECT item_id, r, CAST(sum(repeats * weight * share) AS BIGINT) AS score
    FROM item_terms JOIN weights USING (t) JOIN shares USING (t) GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM scores JOIN docs USING (r) WHERE score > 0) WHERE rank <= 10
"""

WORD_REPEATS = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
    SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS phrase
    FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
earliest AS (SELECT phrase, min(doc_id) AS first_id FROM windows GROUP BY phrase HAVING count(*) > 1),
gone AS (
    SELECT r, list(DISTINCT p) AS places
    FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM windows JOIN earliest USING (phrase) WHERE first_id < doc_id) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(places, z[2])), lambda z: z[1]), ' ') END) AS kept_sha256
FROM docs LEFT JOIN gone USING (r)
"""

#: Where a document lies in the tree of files, in SQL that both engines read.
FILE_PATH = """concat(coalesce(source, 'none'), '/',
    CASE WHEN CAST(floor(doc_id / 20) AS BIGINT) % 1000 = 0 THEN ''
         WHEN CAST(floor(doc_id / 20) AS BIGINT) % 100 = 0 THEN concat('d', CAST(CAST(floor(doc_id / 2000) AS BIGINT) AS STRING), '/')
         ELSE concat('d', CAST(CAST(floor(doc_id / 2000) AS BIGINT) AS STRING), '/e', CAST(CAST(floor(doc_id / 200) AS BIGINT) % 10 AS STRING), '/') END,
    CASE WHEN CAST(floor(doc_id / 20) AS BIGINT) % 5 = 0 THEN 'LICENSE' ELSE concat('part-', CAST(doc_id AS STRING)) END)"""

_STATEMENTS = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
)
_VALUES = ", ".join(f"('{name}', '{text}')" for name, text in _STATEMENTS)
_WORDS = "regexp_extract_all({}, '[a-z0-9]+')"

LICENCES = f"""
WITH templates(licence, statement) AS (VALUES {_VALUES}),
template_terms AS (
    SELECT licence, term, count(*) AS tf
    FROM (SELECT licence, unnest({_WORDS.format("lower(statement)")}) AS term FROM templates) GROUP BY ALL),
inverse AS (
    SELECT term, ln((1.0 + (SELECT count(*) FROM templates)) / (1 + count(*))) + 1 AS idf FROM template_terms GROUP BY term),
template_norm AS (
    SELECT licence, sqrt(sum((tf * idf) ** 2)) AS size FROM template_terms JOIN inverse USING (term) GROUP BY licence),
files AS (SELECT row_number() OVER () AS r, doc_id, {FILE_PATH} AS path, coalesce({_LOWER}, '') AS low FROM documents),
statements AS (
    SELECT row_number() OVER () AS s, r, statement
    FROM (SELECT r, unnest(string_split(regexp_replace(low, '([.!?;]) +', '\\1' || chr(10), 'g'), chr(10))) AS statement FROM files)),
terms AS (
    SELECT s, r, term, count(*) AS tf FROM (SELECT s, r, unnest({_WORDS.format("statement")}) AS term FROM statements) GROUP BY ALL),
norms AS (
    SELECT s, sqrt(sum((tf * coalesce(idf, ln(1.0 + (SELECT count(*) FROM templates)) + 1)) ** 2)) AS size
    FROM terms LEFT JOIN inverse USING (term) GROUP BY s),
scores AS (
    SELECT terms.r, licence, round(sum(terms.tf * t.tf * idf * idf) / (any_value(n.size) * any_value(tn.size)), 6) AS score
    FROM terms JOIN template_terms t USING (term) JOIN inverse USING (term) JOIN norms n USING (s) JOIN template_norm tn USING (licence)
    GROUP BY terms.r, terms.s, licence),
best AS (SELECT r, max(struct_pack(score := score, licence := licence)) AS own FROM scores WHERE score >= 0.7 GROUP BY r),
own AS (
    SELECT doc_id, path, own, array_to_string(string_split(path, '/')[:-2], '/') AS dir, string_split(path, '/')[-1] AS name
    FROM files LEFT JOIN best USING (r)),
by_dir AS (SELECT dir AS above, max(own) AS found FROM own WHERE own IS NOT NULL AND name = 'LICENSE' GROUP BY dir),
nearest AS (
    SELECT d.dir, arg_max(struct_pack(above := above, found := found), length(above)) AS nearest
    FROM (SELECT DISTINCT dir FROM own) d JOIN by_dir b ON b.above = '' OR b.above = d.dir OR starts_with(d.dir, b.above || '/') GROUP BY d.dir)
SELECT doc_id, path, coalesce(own.licence, nearest.found.licence) AS licence, coalesce(own.score, nearest.found.score) AS score,
       CASE WHEN own IS NOT NULL THEN 'own' WHEN nearest IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own IS NOT NULL THEN own.dir WHEN nearest IS NOT NULL THEN nearest.above END AS from_dir
FROM own LEFT JOIN nearest ON own.dir = nearest.dir
"""
