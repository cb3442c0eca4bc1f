"""Plain SQL for the registered queries, run by another engine on the same tables."""

from __future__ import annotations

FN = """fn AS (SELECT 'func:' || p_partkey AS id, p_partkey AS pk, p_name AS name, p_brand || '.' || p_name || '#' || p_partkey AS qualifiedName, p_brand AS filePath,
  (10 * row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS lineStart, (10 * row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 9)::INT AS lineEnd,
  p_size <= 10 AS isPublic, lower(p_type) AS domain, CASE WHEN p_size > 40 THEN 'feature' ELSE 'master' END AS branch, 'func ' || p_name || '()' AS signature, p_size AS size FROM part)"""
ED = (
    FN
    + """, ed AS (SELECT a.id AS src, b.id AS dst, (50 + (s * 7 + d * 3) % 50)::INT AS confidence, (a.lineStart + d % 9)::INT AS callSite, b.name AS calleeRaw
  FROM (SELECT DISTINCT s, d FROM (SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS d FROM lineitem) WHERE d IS NOT NULL) JOIN fn a ON a.pk = s JOIN fn b ON b.pk = d)"""
)
HUB = ", hub AS (SELECT dst AS id FROM ed GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), top AS (SELECT src AS id FROM ed GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
UN = """, un AS (SELECT src, 'func:unresolved::' || calleeRaw AS dst, calleeRaw, CASE WHEN confidence % 10 = 0 THEN 0 ELSE confidence END::INT AS confidence FROM (SELECT src, calleeRaw, min(confidence) AS confidence FROM ed GROUP BY ALL))"""
MEM = ", mem AS (SELECT DISTINCT id, process FROM (SELECT e.dst AS id, 'process:' || f.filePath AS process FROM ed e JOIN fn f ON f.id = e.src WHERE f.isPublic UNION ALL SELECT id, 'process:' || filePath FROM fn WHERE isPublic))"
G = "WITH RECURSIVE " + ED + HUB + UN + MEM
#: The call graph of line items of quantity 40 or more: thin enough for another engine to list all trails, and with leaves.
THIN = G.replace("FROM lineitem)", "FROM lineitem WHERE l_quantity >= 40)")


def trails(start: str, depth: int, back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f""", tr AS (SELECT {b} AS node, 1 AS depth, [{a}, {b}] AS path, [src || '>' || dst] AS steps FROM ed WHERE {a} IN (SELECT id FROM {start})
  UNION ALL SELECT e.{b}, t.depth + 1, list_append(t.path, e.{b}), list_append(t.steps, e.src || '>' || e.dst) FROM tr t JOIN ed e ON e.{a} = t.node WHERE t.depth < {depth} AND NOT list_contains(t.steps, e.src || '>' || e.dst))"""


def reach(name: str, start: str, depth: int, back: bool = False) -> str:
    """start, node, depth of the least depth; walks by level, kept distinct."""
    a, b = ("dst", "src") if back else ("src", "dst")
    return f""", {name}_w AS (SELECT DISTINCT {a} AS start, {b} AS node, 1 AS depth FROM ed WHERE {a} IN (SELECT id FROM {start})
  UNION SELECT w.start, e.{b}, w.depth + 1 FROM {name}_w w JOIN ed e ON e.{a} = w.node WHERE w.depth < {depth}), {name} AS (SELECT start, node, min(depth) AS depth FROM {name}_w GROUP BY ALL)"""


TERMS = r"list_filter(string_split_regex(lower(regexp_replace({0}, '([A-Z])', ' \1', 'g')), '[^a-zA-Z0-9一-鿿]+'), lambda x: length(x) > 1)"


def terms(x: str) -> str:
    return TERMS.replace("{0}", x)


BM = f"""WITH tk AS (SELECT doc_id AS id, {terms("text")} AS t FROM documents), pt AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk), tf AS (SELECT id, dl, term, count(*) AS tf FROM pt GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS mean FROM tk),
  mi AS (SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) AS m FROM df, st),
  qt AS (SELECT term, count(*) AS times FROM (SELECT unnest({terms("text")}) AS term FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)) GROUP BY term),
  wt AS (SELECT term, times, CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * m ELSE ln(n - df + 0.5) - ln(df + 0.5) END AS idf FROM qt JOIN df USING (term), st, mi),
  sc AS (SELECT id, round(sum(idf * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM tf JOIN wt USING (term), st GROUP BY id),
  bm AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0)"""
VEC = """, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
  vs AS (SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], v) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(v, v)), 6) AS cos FROM embeddings, q),
  vr AS (SELECT id, cos, row_number() OVER (ORDER BY cos DESC, id) AS rank FROM vs)"""
FUSED = """SELECT coalesce(b.id, v.id) AS id, b.rank AS bm25_rank, v.rank AS vec_rank, round(coalesce(1 / (60 + b.rank), 0) + coalesce(1 / (60 + v.rank), 0), 9) AS score
  FROM (SELECT * FROM bm WHERE rank <= 30) b FULL JOIN {right} v ON b.id = v.id ORDER BY score DESC, id LIMIT 10"""
DOMAIN_SQL = "CASE {cases} ELSE replace(lower(x), ' ', '_') END"

#: The records of the source files that the tables are written as: fs functions, cs calls in their bodies.
SRC = (
    ED
    + """, fs AS (SELECT *, replace(filePath, 'Brand#', '') AS g, 'app/Modules/M' || replace(filePath, 'Brand#', '') || '/Brand' || replace(filePath, 'Brand#', '') || '.swift' AS path,
  'Brand' || replace(filePath, 'Brand#', '') || '.f' || pk AS q, 4 + 6 * (lineStart // 10 - 1) AS a, 3 + 6 * (lineStart // 10) AS b FROM fn),
  cd AS (SELECT DISTINCT s.path, s.q, s.a, s.pk, d.pk AS d FROM ed e JOIN fs s ON s.id = e.src JOIN fs d ON d.id = e.dst),
  cs AS (SELECT path, q, 'f' || d AS callee, 'obj' AS receiver, a + 2 AS line FROM cd WHERE d % 3 = 0
    UNION ALL SELECT path, q, 'f' || d, NULL, min(line) FROM (SELECT path, q, pk AS d, a AS line FROM fs UNION ALL SELECT path, q, d, a + 2 FROM cd WHERE d % 3 <> 0) x
      WHERE NOT EXISTS (SELECT 1 FROM cd WHERE cd.q = x.q AND cd.d = x.d AND cd.d % 3 = 0) GROUP BY path, q, d)"""
)
