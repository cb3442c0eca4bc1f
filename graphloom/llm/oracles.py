"""SQL that the queries of this subpackage are held against on another engine."""

from __future__ import annotations

from .op8 import KINDS

_WORD = "[^\\x20\\x09-\\x0D]+"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
s AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
g AS (SELECT rid, doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
c AS (SELECT DISTINCT rid, p + k AS i FROM g JOIN m USING (h), range(13) r(k) WHERE least < doc_id),
x AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN c USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
ln AS (SELECT a, b, c = x.n AND c = y.n AS same FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS o, doc_id AS z FROM d UNION SELECT r.o, ln.b FROM r JOIN ln ON ln.a = r.z),
q AS (SELECT o, min(z) AS least FROM r GROUP BY o)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least AS component_id, (1 + coalesce(e.k, 0))::BIGINT AS n_copies, coalesce(e.l, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN q ON q.o = d.doc_id LEFT JOIN (SELECT a, count(*) FILTER (WHERE same) AS k, count(*) AS l FROM ln GROUP BY a) e ON e.a = d.doc_id"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str, value: int, keep: str) -> str:
    """Rows (rid, s, k, e, v) of a pattern's matches: places from the lengths of the parts between them and of the matches."""
    return f"""SELECT rid, s, {kind} AS k, s + length(m) AS e, v FROM (
      SELECT rid, m, v, (sum(length(b)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS s
      FROM (SELECT rid, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(bs[1:len(ms)]) AS b FROM (
        SELECT rid, regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_extract_all(text, '{pattern}', {value}) AS vs, string_split_regex(text, '{pattern}') AS bs FROM d))
      WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE {keep}"""


def op8() -> str:
    name = "CASE k " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(KINDS)) + " END || ':' || s || ':' || e"
    said = lambda where: f"coalesce(string_agg({name}, ',' ORDER BY s, k) FILTER (WHERE {where}), '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
base AS ({_spans(0, _ASSIGN, 1, "length(v) >= 6")} UNION ALL {_spans(1, "AKIA[A-Z0-9]{16,}", 0, "true")} UNION ALL {_spans(2, "[0-9a-f]{24,}", 0, "true")}),
more AS (SELECT * FROM ({_spans(3, "[A-Za-z0-9_+/=-]{20,}", 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")}) o WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.s < o.e AND o.s < b.e)),
al AS (SELECT * FROM base UNION ALL SELECT * FROM more),
ow AS (SELECT v, count(DISTINCT owner) <= 2 AS few FROM al JOIN d USING (rid) GROUP BY v),
t AS (SELECT * FROM al JOIN ow USING (v))
SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, sha256({said("k < 3")}) AS base_sha256,
{said("k < 3 OR few")} AS spans, count(*) FILTER (WHERE k = 3 AND few) AS n_owned, count(*) FILTER (WHERE few) AS n_live, count(*) FILTER (WHERE k < 3 AND NOT few) AS n_shared, {said("few")} AS live
FROM d LEFT JOIN t USING (rid) GROUP BY rid, doc_id"""
