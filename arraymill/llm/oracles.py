"""DuckDB SQL for the corpus queries that SQL can express at a small scale."""

from __future__ import annotations

from .licenses import AGREE, PHRASES, RARE, TEMPLATES

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = vec_id
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word, w FROM d),
g AS (SELECT doc_id, i, word, CASE WHEN i + 13 <= n THEN array_to_string(w[i + 1:i + 13], ' ') END AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM g WHERE g IS NOT NULL GROUP BY g),
s AS (SELECT g.doc_id, g.i, g.word, CAST(coalesce(f.first < g.doc_id, false) AS INT) AS start FROM g LEFT JOIN f ON g.g = f.g),
r AS (SELECT doc_id, i, word, max(start) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM s),
a AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

DECONTAMINATION = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS l FROM (SELECT item_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, l, array_to_string(w[i + 1:i + l], ' ') AS g FROM (SELECT item, l, w, unnest(range(len(w) - l + 1)) AS i FROM b)),
d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM documents),
dw AS (SELECT doc_id, i, l, array_to_string(w[i + 1:i + l], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hits AS (SELECT doc_id, i, dw.l, item FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
marked AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def licenses() -> str:
    """The license scan: the postings of each template's rarest key words are joined to all words, grouped by start, and what all of them name is compared word by word."""
    every = [(label, p, ((0, len(p.split())),), True) for p, label in PHRASES.items()] + [(*t, False) for t in TEMPLATES]
    words = [(t, o, w) for t, (_, text, _, _) in enumerate(every) for o, w in enumerate(text.split())]
    keys = sorted({(t, o) for t, (_, _, ks, _) in enumerate(every) for a, n in ks for o in range(a, a + n)})
    kinds = [(t, label, base, len(text.split())) for t, (label, text, _, base) in enumerate(every)]
    rows = lambda some: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in some)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n_words FROM d),
tw(t, o, word) AS (VALUES {rows(words)}), tk(t, o) AS (VALUES {rows(keys)}), tt(t, label, base, n) AS (VALUES {rows(kinds)}),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM p WHERE word IN (SELECT word FROM tw) GROUP BY word),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM documents)) / (1.0 + coalesce(n, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word)),
post AS (SELECT * FROM (SELECT t, o, word, row_number() OVER (PARTITION BY t ORDER BY idf DESC, o) AS k FROM tw JOIN tk USING (t, o) JOIN idf USING (word)) WHERE k <= {RARE}),
met AS (SELECT doc_id, n_words, t, s FROM (SELECT doc_id, n_words, t, i - o AS s, count(*) AS named FROM p JOIN post USING (word) GROUP BY doc_id, n_words, t, i - o) JOIN (SELECT t, count(*) AS k FROM post GROUP BY t) USING (t) WHERE named = k),
same AS (SELECT m.doc_id, m.t, m.s, tw.o, idf.idf, CAST(coalesce(p.word = tw.word, false) AS INT) AS ok, tk.o IS NOT NULL AS is_key
  FROM met m JOIN tt USING (t) JOIN tw USING (t) JOIN idf ON idf.word = tw.word LEFT JOIN tk ON tk.t = tw.t AND tk.o = tw.o LEFT JOIN p ON p.doc_id = m.doc_id AND p.i = m.s + tw.o
  WHERE m.s >= 0 AND m.s + tt.n <= m.n_words),
m AS (SELECT doc_id, s, label, base, CASE WHEN base THEN 0.0 ELSE weight END AS weight FROM (
  SELECT doc_id, t, s, sum(ok) AS agree, min(CASE WHEN is_key THEN ok ELSE 1 END) AS keyed, sum(ok * idf) / sum(idf) AS weight FROM same GROUP BY doc_id, t, s) JOIN tt USING (t)
  WHERE keyed = 1 AND agree >= CASE WHEN base THEN n ELSE ceil({AGREE} * n) END),
a AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(weight) AS best FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(CAST(least(1.0, CASE WHEN n_base > 0 THEN greatest(coalesce(best, 0), 0.5) ELSE coalesce(best, 0) END) AS DOUBLE), 6) AS score
FROM d LEFT JOIN a USING (doc_id)
"""
