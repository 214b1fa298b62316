"""DuckDB SQL for the corpus queries, where SQL can state them."""

from segflow.llm.secrets import BASE, KINDS, PATTERNS, SCOPE

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each_line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM split),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {WHITE})")} AS k FROM each_line),
common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.k = c.k GROUP BY doc_id
"""

OP9 = f"""
WITH words AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wins),
docwins AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM words, lens, unnest(range(1, len(w) - n + 2)) AS r(i)),
hits AS (SELECT doc_id, i, d.n, item_id FROM docwins d JOIN wins USING (n, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _spans(kind: str) -> str:
    pattern, text = PATTERNS[kind].replace("'", "''"), "coalesce(text, '')"
    valid = {"assign": f"length(regexp_extract(v, '{pattern}', 2)) >= 6", "blob": "regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"}.get(kind, "true")
    return f"""SELECT doc_id, {list(KINDS).index(kind)} AS k, '{kind}' AS kind, '{KINDS[kind]}' AS part, before + gaps AS s, before + gaps + length(v) AS e FROM (
  SELECT doc_id, v, sum(length(g)) OVER w AS gaps, sum(length(v)) OVER w - length(v) AS before FROM (
    SELECT doc_id, unnest(m) AS v, unnest(string_split_regex(t, '{pattern}')[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM (
      SELECT doc_id, {text} AS t, regexp_extract_all({text}, '{pattern}') AS m FROM documents) WHERE len(m) > 0)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {valid}"""


_WRITTEN = "coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k, e){}, '')"
OP6 = f"""
WITH found AS ({" UNION ALL ".join(map(_spans, KINDS))}),
linked AS (SELECT a.doc_id, a.k AS ak, a.s AS sa, a.e AS ea, o.k AS ok, o.s AS so, o.e AS eo FROM found a JOIN found o ON a.doc_id = o.doc_id AND a.part = 'secret' AND o.part <> 'secret' AND (o.kind <> 'endpoint' OR a.kind <> 'blob') AND o.s <= a.e + {SCOPE} AND o.e >= a.s - {SCOPE}),
kept AS (SELECT doc_id, k, kind, s, e FROM found f WHERE k < {len(BASE)}
  OR EXISTS (SELECT 1 FROM linked l WHERE l.doc_id = f.doc_id AND ok = k AND so = s AND eo = e)
  OR EXISTS (SELECT 1 FROM linked l WHERE l.doc_id = f.doc_id AND ak = k AND sa = s AND ea = e))
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  sha256({_WRITTEN.format(f" FILTER (k < {len(BASE)})")}) AS base_sha256, {_WRITTEN.format(" FILTER (k IS NOT NULL)")} AS spans
FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""


def _nearest(vectors: str, centroids: str) -> str:
    """(vec_id, v, cluster, distance): the nearest centroid, in doubles that hold these whole numbers exactly."""
    return f"""SELECT vec_id, v, n, arg_min(cluster, distance * 1024 + cluster) AS cluster, min(distance) AS distance FROM (
    SELECT vec_id, n, v, cluster, CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) AS distance FROM {vectors}, {centroids}) GROUP BY vec_id, n, v"""


_K, _ROUNDS = 40, 5
_MOVE = """moved{i} AS (SELECT cluster, list(x ORDER BY d) AS c FROM (SELECT cluster, d, CAST((s - ((s % n + n) % n)) // n AS DOUBLE) AS x FROM (
  SELECT cluster, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS d FROM near{i}) GROUP BY cluster, d)) GROUP BY cluster),
c{j} AS (SELECT cluster, coalesce(moved{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN moved{i} USING (cluster))"""
OP12 = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster, v AS c FROM kept ORDER BY cluster LIMIT {_K}),
{", ".join(f"near{i} AS MATERIALIZED ({_nearest('kept', f'c{i}')}), " + _MOVE.format(i=i, j=i + 1) for i in range(_ROUNDS))},
last AS MATERIALIZED ({_nearest("kept", f"c{_ROUNDS}")})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM last JOIN c{_ROUNDS} USING (cluster)
"""
