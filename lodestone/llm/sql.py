"""DuckDB SQL for those operators that SQL can express; the driver runs it on small tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low('text')}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_low('text')}, '{_ALNUM}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, s, s + 12), ' ') AS piece
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS piece
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hits AS (SELECT doc_id, s, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.piece = iw.piece),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked ON d.doc_id = marked.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
x AS (SELECT doc_id, s, row_number() OVER (PARTITION BY piece ORDER BY doc_id, s) AS nth
      FROM (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS piece FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM x WHERE nth > 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT e.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL) AS body
         FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low('text')}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 75 * (a.n + b.n - i)),
links AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, k.v FROM reach r JOIN links k ON r.v = k.u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_ AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT u, min(v) AS least_ FROM reach GROUP BY 1) ON d.doc_id = u
"""


def _runs(name: str, length: int) -> str:
    """Maximal runs of bytes in strings of `length` bytes that start more than once.  Texts are cut into overlapping chunks, as
    a place in a long string is costly to reach."""
    return f"""
{name}_w AS (SELECT doc_id, c * 512 + i AS s, md5(substr(piece, 2 * i + 1, {2 * length})) AS g
  FROM (SELECT doc_id, c, piece, unnest(range(0, least(512, n - {length} + 1 - c * 512))) AS i
        FROM (SELECT doc_id, n, c, substr(x, c * 1024 + 1, {1024 + 2 * length}) AS piece FROM (SELECT doc_id, x, n, unnest(range(0, (n - {length}) // 512 + 1)) AS c FROM d WHERE n >= {length})))),
{name}_s AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS l FROM {name}_w WHERE g IN (SELECT g FROM {name}_w GROUP BY g HAVING count(*) > 1)),
{name} AS (SELECT doc_id, min(s) AS a, max(s) + {length} AS b FROM (SELECT doc_id, s, sum(CASE WHEN l IS NULL OR s - l > {length} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM {name}_s) GROUP BY doc_id, r)"""


PHRASES = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents), {_runs("gone", 400)}, {_runs("seen", 200)},
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS o FROM gone),
kept AS (SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * o + 1, 2 * (a - o)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS body FROM cut JOIN d ON d.doc_id = cut.doc_id GROUP BY 1),
again AS (SELECT doc_id, sum(b - a) AS n_repeated FROM seen GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(body, x))) AS kept_sha256, CAST(coalesce(n_repeated, 0) AS BIGINT) AS n_repeated
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN again ON d.doc_id = again.doc_id
"""

SQL = {"op2_decontamination": DECONTAMINATION, "op6_substring_dedup": SUBSTRINGS, "op7_jaccard_join": JACCARD, "op10_phrase_dedup": PHRASES}
