"""DuckDB SQL for the registered queries, stated from the definitions and not from the plans."""

from __future__ import annotations

from strandgraph.functions import predicates, text
from strandgraph.operators.relations import DEFAULT_PRIOR, PRIORS
from strandgraph.plans.registry import BUDGET, DECAY, EPSILON, FINE, MAX_FILES, MIN_SUPPORT, PUSHES, RANKS, RELATED, SEEDS

_PRIOR = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORS.items()) + f" ELSE {DEFAULT_PRIOR} END"

CHANGES = f"""
changes AS (SELECT DISTINCT l_orderkey AS commit_id, 'part:' || l_partkey AS path FROM lineitem),
totals AS (SELECT path, count(*) AS commits FROM changes GROUP BY path),
small AS (SELECT commit_id FROM changes GROUP BY commit_id HAVING count(*) <= {MAX_FILES}),
cochange AS (
  SELECT a.path AS l, b.path AS r, count(*) AS n, list(left(a.commit_id::VARCHAR, 8) ORDER BY a.commit_id DESC) AS commits
  FROM changes a JOIN changes b ON a.commit_id = b.commit_id AND a.path < b.path
  WHERE a.commit_id IN (SELECT commit_id FROM small) GROUP BY 1, 2 HAVING count(*) >= {MIN_SUPPORT}),
confident AS (
  SELECT l AS source_id, r AS target_id, 'CO_CHANGES' AS kind, n AS count, least(1.0, n::DOUBLE / (a.commits + b.commits - n) * (1 - exp(-n / 2.0::DOUBLE))) AS confidence
  FROM cochange JOIN totals a ON a.path = l JOIN totals b ON b.path = r)"""

EDGES = f"""{CHANGES},
relations AS (
  SELECT * FROM confident
  UNION ALL SELECT 'brand:' || p_brand, 'part:' || p_partkey, 'CONTAINS', 1, 1.0 FROM part
  UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'CONTAINS', 1, 1.0 FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IMPORTS', 1, 0.9 FROM supplier
  UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'SHIPS', 1, 0.95 FROM lineitem),
summed AS (SELECT source_id, target_id, kind, sum(count)::BIGINT AS count, sum(confidence::DOUBLE * count) / sum(count) AS confidence FROM relations GROUP BY 1, 2, 3),
edges AS (
  SELECT *, round(least(1.0, ({_PRIOR})::DOUBLE * confidence * (0.5 + 0.5 * ln(1 + count) / ln(1 + max(count) OVER (PARTITION BY kind)))), 9) AS strength FROM summed)"""

PAIRS = f"""{EDGES},
pairs AS (
  SELECT least(source_id, target_id) AS u, greatest(source_id, target_id) AS v, 1 - product(1 - strength) AS weight, min((source_id, target_id, kind)) AS first
  FROM edges WHERE source_id <> target_id GROUP BY 1, 2),
sides AS (SELECT u AS node, v AS neighbour, weight, first FROM pairs UNION ALL SELECT v, u, weight, first FROM pairs),
adjacent AS (SELECT node, neighbour, weight, row_number() OVER (PARTITION BY node ORDER BY first) AS place FROM sides),
top AS (SELECT path, commits::DOUBLE AS score, row_number() OVER (ORDER BY commits DESC, path) AS rank FROM totals),
seeds AS (SELECT path AS node_id, score, rank FROM top WHERE rank <= {SEEDS})"""

PATHS = f"""{PAIRS},
hop0 AS (SELECT node_id AS cur, score / (SELECT max(score) FROM seeds) AS score, [node_id] AS path, [rank] AS places FROM seeds),
hop1 AS (SELECT neighbour AS cur, score * {DECAY}::DOUBLE * weight AS score, list_append(path, neighbour) AS path, list_append(places, place) AS places FROM hop0 JOIN adjacent ON cur = node WHERE NOT list_contains(path, neighbour)),
hop2 AS (SELECT neighbour AS cur, score * {DECAY}::DOUBLE * weight AS score, list_append(path, neighbour) AS path, list_append(places, place) AS places FROM hop1 JOIN adjacent ON cur = node WHERE NOT list_contains(path, neighbour)),
reached AS (SELECT *, row_number() OVER (PARTITION BY cur ORDER BY score DESC, len(path), places) AS n FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)),
best AS (SELECT cur AS node_id, score, len(path) - 1 AS depth, path FROM reached WHERE n = 1),
steps AS (
  SELECT node_id, step - 1 AS step, path[step] AS from_id, path[step + 1] AS to_id FROM (SELECT node_id, path, unnest(range(1, len(path))) AS step FROM best))"""


def _pagerank() -> str:
    ranks = ["r0 AS (SELECT node_id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(RANKS):
        ranks.append(f"""r{k + 1} AS (
  SELECT n.node_id, 0.85::DOUBLE * (coalesce(f.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node_id NOT IN (SELECT node FROM outs)) * n.p) + 0.15::DOUBLE * n.p AS rank
  FROM nodes n LEFT JOIN (SELECT neighbour, sum(rank * weight / o) AS got FROM sides JOIN outs USING (node) JOIN r{k} ON r{k}.node_id = sides.node GROUP BY neighbour) f ON f.neighbour = n.node_id)""")
    return f"""WITH {PAIRS},
outs AS (SELECT node, sum(weight) AS o FROM sides GROUP BY node),
named AS (SELECT source_id AS node_id FROM edges UNION SELECT target_id FROM edges UNION SELECT 'customer:' || c_custkey FROM customer),
nodes AS (SELECT node_id, coalesce(score / (SELECT sum(score) FROM seeds), 0) AS p FROM named LEFT JOIN seeds USING (node_id)),
{', '.join(ranks)}
SELECT node_id, round(rank, 9) AS rank FROM r{RANKS}"""


def _push() -> str:
    states = ["s0 AS (SELECT node_id AS seed, node_id AS node, 0.0::DOUBLE AS rank, 1.0::DOUBLE AS residual FROM seeds)"]
    for k in range(RANKS):
        states.append(f"""s{k + 1} AS MATERIALIZED (SELECT seed, node, sum(rank) AS rank, sum(residual) AS residual FROM (
  SELECT seed, node, rank + CASE WHEN residual > {EPSILON}::DOUBLE * coalesce(o, 1) THEN 0.15::DOUBLE * residual ELSE 0 END AS rank, CASE WHEN residual > {EPSILON}::DOUBLE * coalesce(o, 1) THEN 0 ELSE residual END AS residual FROM s{k} LEFT JOIN outs USING (node)
  UNION ALL SELECT seed, neighbour, 0, 0.85::DOUBLE * residual * weight / o FROM s{k} JOIN outs USING (node) JOIN sides USING (node) WHERE residual > {EPSILON}::DOUBLE * o
  UNION ALL SELECT seed, seed, 0, 0.85::DOUBLE * residual FROM s{k} WHERE node NOT IN (SELECT node FROM outs) AND residual > {EPSILON}::DOUBLE) GROUP BY 1, 2)""")
    return f"""WITH {PAIRS},
outs AS (SELECT node, sum(weight) AS o FROM sides GROUP BY node),
{', '.join(states)}
SELECT seed, node AS node_id, round(rank, 8) AS rank, round(residual, 8) AS residual FROM s{RANKS}"""


_WORDS = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_.]*[\p{L}\p{N}_])?"


def _ngrams(source: str, key: str, column: str) -> str:
    """``(key, block, term)`` with repeats."""
    return f"""
cut AS (SELECT {key} AS key, regexp_extract_all(lower({column}), '{_WORDS}') AS w, list_filter(regexp_split_to_array(lower({column}), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> '') AS c FROM {source}),
grams AS (
  SELECT key, 'word' AS block, unnest(w) AS term FROM cut
  UNION ALL SELECT key, 'word', unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM cut
  UNION ALL SELECT key, 'char', substring(p, k, n) FROM (
    SELECT key, p, n, unnest(range(1, greatest(length(p) - n + 2, 1))) AS k FROM (
      SELECT key, ' ' || x || ' ' AS p, unnest([3, 4, 5]) AS n FROM (SELECT key, unnest(c) AS x FROM cut))))"""


def _tfidf() -> str:
    docs = _ngrams("(SELECT conv_id || ':' || turn AS node_id, coalesce(text, '') AS t FROM conversations)", "node_id", "t")
    expanded = "replace(replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '-', ' ')"
    asked = _ngrams(f"(SELECT item_id, {expanded} AS t FROM benchmark)", "item_id", "t").replace("cut AS", "cut2 AS").replace("FROM cut", "FROM cut2").replace("grams AS", "grams2 AS")
    return f"""WITH {docs}, {asked},
tf AS (SELECT key, block, term, 1 + ln(count(*)) AS tf FROM grams GROUP BY 1, 2, 3),
idf AS (SELECT block, term, ln((1 + (SELECT count(*) FROM conversations)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY 1, 2),
posting AS (SELECT key, block, term, tf * idf AS w FROM tf JOIN idf USING (block, term)),
dnorm AS (SELECT key, block, sqrt(sum(w * w)) AS n FROM posting GROUP BY 1, 2),
q AS (SELECT key AS qid, block, term, (1 + ln(count(*))) * any_value(idf) AS w FROM grams2 JOIN idf USING (block, term) GROUP BY 1, 2, 3),
qnorm AS (SELECT qid, block, sqrt(sum(w * w)) AS n FROM q GROUP BY 1, 2),
dlen AS (SELECT key, sqrt(sum(CASE block WHEN 'word' THEN 0.49 ELSE 0.09 END::DOUBLE)) AS l FROM dnorm GROUP BY 1),
qlen AS (SELECT qid, sqrt(sum(CASE block WHEN 'word' THEN 0.49 ELSE 0.09 END::DOUBLE)) AS l FROM qnorm GROUP BY 1),
dots AS (SELECT qid, key, block, sum(q.w * p.w) AS d FROM q JOIN posting p USING (block, term) GROUP BY 1, 2, 3),
parts AS (SELECT qid, key, sum(CASE block WHEN 'word' THEN 0.49 ELSE 0.09 END::DOUBLE * d / (dn.n * qn.n)) AS s FROM dots JOIN dnorm dn USING (key, block) JOIN qnorm qn USING (qid, block) GROUP BY 1, 2),
scored AS (SELECT qid, key, round(s / (dlen.l * qlen.l), 9) AS score FROM parts JOIN dlen USING (key) JOIN qlen USING (qid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM scored)
SELECT qid AS query_id, rank::INTEGER AS rank, key AS node_id, round(score, 5) AS score FROM ranked WHERE rank <= 10"""


def _ended(sql: str) -> str:
    """The same with PageRank itself instead of its first pushes: the ranks repeat until what moves is under a double's digits."""
    first, last = sql.index("s0 AS ("), sql.index("ranks AS (")
    walk = f"""walk AS (SELECT 0 AS round, qid, node, share AS rank FROM shares
  UNION ALL SELECT round, qid, node, sum(rank) FROM (
    SELECT round + 1 AS round, qid, neighbour AS node, 0.85::DOUBLE * rank * weight / o AS rank FROM walk JOIN outs USING (node) JOIN adjacent USING (node)
    UNION ALL SELECT round + 1, qid, h.node, share * (0.15::DOUBLE + 0.85::DOUBLE * coalesce(sum(w.rank) FILTER (w.node NOT IN (SELECT node FROM outs)), 0)) FROM shares h JOIN walk w USING (qid) GROUP BY 1, 2, 3, share) WHERE round <= 250 GROUP BY 1, 2, 3),
s{PUSHES} AS (SELECT qid, node, rank FROM walk WHERE round = 250),
"""
    return (sql[:first] + walk + sql[last:]).replace("WITH ", "WITH RECURSIVE ", 1)


def _retrieval(result: str) -> str:
    """Anchors, all simple paths of two hops from them, PageRank pushed round by round, and the rankings made of these."""
    scored = _tfidf()
    scored = scored[: scored.index("scored AS (")]
    push, states = f"residual > {FINE}::DOUBLE * coalesce(o, 1)", ["s0 AS (SELECT qid, node, 0.0::DOUBLE AS rank, share AS residual FROM shares)"]
    for k in range(PUSHES):
        states.append(f"""s{k + 1} AS MATERIALIZED (SELECT qid, node, sum(rank) AS rank, sum(residual) AS residual FROM (
  SELECT qid, node, rank + CASE WHEN {push} THEN 0.15::DOUBLE * residual ELSE 0 END AS rank, CASE WHEN {push} THEN 0 ELSE residual END AS residual FROM s{k} LEFT JOIN outs USING (node)
  UNION ALL SELECT qid, neighbour, 0, 0.85::DOUBLE * residual * weight / o FROM s{k} JOIN outs USING (node) JOIN adjacent USING (node) WHERE {push}
  UNION ALL SELECT h.qid, h.node, 0, share * handed FROM shares h JOIN (SELECT qid, 0.85::DOUBLE * sum(residual) AS handed FROM s{k} WHERE node NOT IN (SELECT node FROM outs) AND residual > {FINE}::DOUBLE GROUP BY 1) USING (qid)) GROUP BY 1, 2)""")
    hop = lambda k: f"SELECT qid, neighbour AS cur, score * {DECAY}::DOUBLE * weight AS score, list_append(path, neighbour) AS path, list_append(places, place) AS places FROM hop{k} JOIN adjacent ON cur = node WHERE NOT list_contains(path, neighbour)"
    return f"""{scored}
direct AS MATERIALIZED (SELECT qid, key, s / (dlen.l * qlen.l) AS score FROM parts JOIN dlen USING (key) JOIN qlen USING (qid)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM direct),
turns AS (SELECT DISTINCT conv_id, turn FROM conversations),
follows AS (SELECT conv_id || ':' || turn AS a, conv_id || ':' || after AS b, 0.5::DOUBLE + ((conv_id * 37 + turn * 101) % 997) / 2000.0::DOUBLE AS weight FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM turns) WHERE after IS NOT NULL),
adjacent AS MATERIALIZED (SELECT node, neighbour, 1 - (1 - weight) AS weight, row_number() OVER (PARTITION BY node ORDER BY a, b) AS place FROM (SELECT a AS node, b AS neighbour, * FROM follows UNION ALL SELECT b, a, * FROM follows)),
outs AS (SELECT node, sum(weight) AS o FROM adjacent GROUP BY node),
anchors AS (SELECT qid, key, score, rank FROM ranked WHERE rank <= {SEEDS}),
hop0 AS (SELECT qid, key AS cur, score / max(score) OVER (PARTITION BY qid) AS score, [key] AS path, [rank] AS places FROM anchors),
hop1 AS ({hop(0)}),
hop2 AS ({hop(1)}),
reached AS (SELECT *, row_number() OVER (PARTITION BY qid, cur ORDER BY score DESC, len(path), places) AS n FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2) h WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE a.qid = h.qid AND a.key = h.cur)),
shares AS (SELECT qid, key AS node, score / sum(score) OVER (PARTITION BY qid) AS share FROM anchors),
{', '.join(states)},
ranks AS (SELECT qid, node, rank, rank / max(rank) OVER (PARTITION BY qid) AS part FROM s{PUSHES}),
related AS MATERIALIZED (
  SELECT r.qid, r.cur, coalesce(d.score, 0) AS direct, r.score AS relationship, coalesce(k.rank, 0) AS pagerank, coalesce(k.part, 0) AS part, row_number() OVER (PARTITION BY r.qid ORDER BY r.score DESC, coalesce(k.rank, 0) DESC, r.cur) AS rank
  FROM (SELECT qid, cur, score FROM reached WHERE n = 1) r LEFT JOIN direct d ON d.qid = r.qid AND d.key = r.cur LEFT JOIN ranks k ON k.qid = r.qid AND k.node = r.cur),
chosen AS (SELECT qid, key AS node, 0 AS part, rank FROM anchors UNION ALL SELECT qid, cur, 1, rank FROM related WHERE rank <= {RELATED}),
lexical AS MATERIALIZED (SELECT qid AS query_id, rank, key AS node_id FROM ranked WHERE rank <= {BUDGET}),
short AS (SELECT query_id, node_id, rank FROM (SELECT qid AS query_id, node AS node_id, row_number() OVER (PARTITION BY qid ORDER BY part, rank) AS rank FROM chosen) WHERE rank <= {BUDGET}),
once AS (SELECT qid, node, min((part, rank)) AS seat FROM (SELECT * FROM chosen UNION ALL SELECT query_id, node_id, 2, rank FROM lexical) GROUP BY 1, 2),
expanded AS (SELECT query_id, node_id, rank FROM (SELECT qid AS query_id, node AS node_id, row_number() OVER (PARTITION BY qid ORDER BY seat) AS rank FROM once) WHERE rank <= {BUDGET}),
judged AS (SELECT query_id, node_id, 'answer' AS role FROM lexical WHERE rank = 1 UNION ALL SELECT query_id, neighbour, 'supporting' FROM lexical JOIN adjacent ON node = node_id WHERE rank = 1),
rows AS (SELECT j.*, a.rank AS a, b.rank AS b FROM judged j LEFT JOIN lexical a USING (query_id, node_id) LEFT JOIN expanded b USING (query_id, node_id)),
{result}"""


def _bundled(result: str) -> str:
    """The paths to related nodes and the edges of their steps; no path has a node that is ranked nowhere, since all reached ones are related."""
    return _retrieval(f"""best AS MATERIALIZED (SELECT r.qid, r.rank, h.path, r.relationship FROM related r JOIN reached h ON h.qid = r.qid AND h.cur = r.cur AND h.n = 1 WHERE r.rank <= {RELATED}),
hops AS (SELECT qid, path[k] AS x, path[k + 1] AS y FROM (SELECT qid, path, unnest(range(1, len(path))) AS k FROM best)),
used AS MATERIALIZED (SELECT qid, 'FOLLOWS:' || a || '->' || b AS edge FROM (SELECT qid, a, b FROM hops JOIN follows ON a = x AND b = y UNION SELECT qid, a, b FROM hops JOIN follows ON a = y AND b = x)),
{result}""")


JUDGED = """
docs AS (SELECT lang AS query_id, doc_id AS node_id, n_chars FROM documents),
judged AS (SELECT query_id, node_id, CASE WHEN toxic = 1 THEN 'supporting' WHEN quality = 1 THEN 'answer' END AS role FROM docs JOIN labels ON doc_id = node_id WHERE toxic = 1 OR quality = 1),
lexical AS (SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, node_id) AS a FROM docs) WHERE a <= 20),
expanded AS (SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, node_id) AS b FROM docs) WHERE b <= 20),
rows AS (SELECT * FROM judged LEFT JOIN lexical USING (query_id, node_id) LEFT JOIN expanded USING (query_id, node_id))"""


def _metrics(rank: str) -> str:
    best = f"min({rank}) FILTER (role = 'answer')"
    hit = lambda k: f"CASE WHEN {rank} <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE"
    return f"""SELECT query_id, {best} AS answer_rank, CASE WHEN {best} <= 10 THEN 1.0::DOUBLE / {best} ELSE 0.0 END AS answer_mrr_at_10, avg({hit(10)}) AS recall_at_10,
  avg({hit(20)}) AS recall_at_20, avg({hit(10)}) FILTER (role = 'supporting') AS supporting_recall_at_10 FROM rows GROUP BY query_id"""


_M = ["answer_mrr_at_10", "recall_at_10", "recall_at_20", "supporting_recall_at_10"]
_FILL = "SELECT query_id, node_id, {k} AS part, row_number() OVER (PARTITION BY query_id ORDER BY {o}, node_id) AS rank FROM base QUALIFY rank <= {n}"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_LOCAL = predicates.POSIX_PATH.replace("(?<![A-Za-z0-9:])", "(?:^|[^A-Za-z0-9:])")
_WIN = predicates.WINDOWS_PATH.replace("(?<![A-Za-z0-9])", "(?:^|[^A-Za-z0-9])")
_INNER = "trim(trim(trim(v), '\"''') )"
_DYNAMIC = " OR ".join(f"starts_with(lower({_INNER}), '{p}')" for p in predicates.DYNAMIC_PREFIXES)

ORACLE_SQL: dict[str, str] = {
    "cochange_pairs": f"WITH {CHANGES} SELECT l AS left_path, r AS right_path, n, array_to_string(commits, ',') AS commits FROM cochange",
    "commit_totals": f"WITH {CHANGES} SELECT path, commits FROM totals",
    "cochange_confidence": f"WITH {CHANGES} SELECT source_id, target_id, count, round(confidence, 6) AS confidence FROM confident",
    "typed_edge_strength": f"WITH {EDGES} SELECT source_id, target_id, kind, count, round(confidence, 6) AS confidence, round(strength, 6) AS strength FROM edges",
    "edge_kind_summary": f"WITH {EDGES} SELECT kind, count(*) AS edges, printf('%.3f', avg(strength))::DOUBLE AS mean_strength FROM edges GROUP BY kind",
    "projection_noisy_or": f"WITH {EDGES} SELECT least(source_id, target_id) AS u, greatest(source_id, target_id) AS v, round(1 - product(1 - strength), 6) AS weight, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM edges WHERE source_id <> target_id GROUP BY 1, 2",
    "overview_rollup": f"WITH {EDGES} SELECT a.p_brand AS source_group, b.p_brand AS target_group, kind, round(1 - product(1 - strength), 6) AS strength, count(*) AS n FROM edges JOIN part a ON source_id = 'part:' || a.p_partkey JOIN part b ON target_id = 'part:' || b.p_partkey WHERE kind = 'CO_CHANGES' AND a.p_brand <> b.p_brand GROUP BY 1, 2, 3",
    "node_degrees": f"WITH {EDGES} SELECT node_id, count(*) AS degree, round(sum(strength::DECIMAL(18, 9)), 6)::DOUBLE AS total_strength FROM (SELECT source_id AS node_id, strength FROM edges UNION ALL SELECT target_id, strength FROM edges WHERE source_id <> target_id) GROUP BY 1",
    "strongest_paths_2hop": f"WITH {PATHS} SELECT node_id, round(score, 6) AS score, depth::INTEGER AS depth, array_to_string(path, '>') AS path FROM best",
    "related_pruned": f"WITH {PATHS} SELECT node_id, round(score, 6) AS score, depth::INTEGER AS depth, array_to_string(path, '>') AS path FROM best WHERE node_id NOT IN (SELECT node_id FROM seeds)",
    "path_steps": f"WITH {PATHS} SELECT node_id, step::INTEGER AS step, from_id, to_id, round(weight, 6) AS combined_strength FROM steps JOIN pairs ON u = least(from_id, to_id) AND v = greatest(from_id, to_id)",
    "step_contributions": f"WITH {PATHS} SELECT node_id, step::INTEGER AS step, kind || ':' || source_id || '->' || target_id AS edge_id, CASE WHEN kind = 'CO_CHANGES' THEN 'undirected' WHEN source_id = from_id THEN 'forward' ELSE 'reverse' END AS traversal_direction, round(strength, 6) AS strength FROM steps JOIN edges ON (source_id = from_id AND target_id = to_id) OR (source_id = to_id AND target_id = from_id)",
    "neighborhood_top8": f"""WITH {EDGES}, ends AS (SELECT source_id AS node_id, target_id AS neighbour_id, * FROM edges UNION ALL SELECT target_id, source_id, * FROM edges),
one AS (SELECT *, row_number() OVER (PARTITION BY node_id, neighbour_id ORDER BY strength DESC, kind, source_id, target_id) AS k FROM ends WHERE node_id <> neighbour_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY strength DESC, coalesce(p_retailprice, 0) DESC, neighbour_id) AS place FROM one LEFT JOIN part ON neighbour_id = 'part:' || p_partkey WHERE k = 1)
SELECT node_id, place::INTEGER AS place, neighbour_id, kind, round(strength, 6) AS strength FROM placed WHERE place <= 8""",
    "induced_subgraph": f"WITH {PATHS}, chosen AS (SELECT DISTINCT unnest(path) AS c FROM best) SELECT source_id, target_id, kind, round(strength, 6) AS strength FROM edges WHERE source_id IN (SELECT c FROM chosen) AND target_id IN (SELECT c FROM chosen)",
    "strongest_pair_edge": f"WITH {EDGES} SELECT source_id, target_id, kind, round(strength, 6) AS strength FROM edges QUALIFY row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY strength DESC, source_id, target_id, kind) = 1",
    "pagerank_k": _pagerank(),
    "pagerank_push": _push(),
    "word_ngram_df": f"WITH {_ngrams('documents', 'doc_id', 'text')} SELECT term, count(DISTINCT key) AS df FROM grams WHERE block = 'word' GROUP BY term",
    "char_wb_df": f"WITH {_ngrams('benchmark', 'item_id', 'text')} SELECT term, count(DISTINCT key) AS df FROM grams WHERE block = 'char' GROUP BY term",
    "tfidf_top_k": _tfidf(),
    "tfidf_block_max": _tfidf(),
    "related_nodes": _ended(_retrieval(f"""answer AS (SELECT 1)
SELECT qid AS query_id, rank::INTEGER AS rank, cur AS node_id, round(direct, 6) AS direct, round(relationship, 6) AS relationship, round(pagerank, 6) AS pagerank, round(part, 6) AS pagerank_share FROM related WHERE rank <= {RELATED}""")),
    "retrieval_rankings": _retrieval("""answer AS (SELECT 1)
SELECT query_id, rank::INTEGER AS rank, l.node_id AS lexical, s.node_id AS graph FROM lexical l FULL JOIN short s USING (query_id, rank)"""),
    "query_bundles": _bundled(f"""a AS (SELECT qid, string_agg(key, ',' ORDER BY rank) AS l FROM anchors GROUP BY 1),
r AS (SELECT qid, string_agg(cur, ',' ORDER BY rank) AS l FROM related WHERE rank <= {RELATED} GROUP BY 1),
p AS (SELECT qid, string_agg(array_to_string(path, '>'), ',' ORDER BY rank) AS l, round(min(relationship), 6) AS least FROM best GROUP BY 1),
e AS (SELECT qid, string_agg(edge, ',' ORDER BY edge) AS l FROM used GROUP BY 1)
SELECT item_id AS query_id, coalesce(a.l, '') AS anchors, coalesce(r.l, '') AS related_nodes, coalesce(p.l, '') AS paths, coalesce(e.l, '') AS selected_edges, least
FROM benchmark LEFT JOIN a ON a.qid = item_id LEFT JOIN r ON r.qid = item_id LEFT JOIN p ON p.qid = item_id LEFT JOIN e ON e.qid = item_id"""),
    "bundle_faults": _bundled("""answer AS (SELECT 1)
SELECT qid AS query_id, 'used edge is not selected' AS fault, min(edge) AS at FROM used WHERE qid % 3 = 0 GROUP BY qid
UNION ALL SELECT qid, 'path score does not follow', path[-1] FROM best WHERE rank = 1 AND qid % 3 = 1"""),
    "retrieval_metrics": _retrieval(f"""x AS ({_metrics('a')}), y AS ({_metrics('b')}), answer AS (SELECT {', '.join(f'(SELECT avg({m}) FROM x) AS lexical_{m}, (SELECT avg({m}) FROM y) AS graph_{m}' for m in _M)})
SELECT {', '.join(f'round(lexical_{m}, 6) AS lexical_{m}, round(graph_{m}, 6) AS graph_{m}, round(graph_{m} - lexical_{m}, 6) AS delta_{m}' for m in _M)} FROM answer"""),
    "graph_ranking_fill": f"""WITH base AS (SELECT role AS query_id, conv_id || ':' || turn AS node_id, max(length(text)) AS n FROM conversations GROUP BY 1, 2),
parts AS ({_FILL.format(k=0, o='n DESC', n=6)} UNION ALL {_FILL.format(k=1, o='n', n=10)} UNION ALL {_FILL.format(k=2, o='length(node_id) DESC', n=20)}),
once AS (SELECT query_id, node_id, min((part, rank)) AS seat FROM parts GROUP BY 1, 2)
SELECT query_id, rank::INTEGER AS rank, node_id FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY seat) AS rank FROM once) WHERE rank <= 20""",
    "rank_metrics": f"WITH {JUDGED}, m AS ({_metrics('a')}) SELECT query_id, answer_rank, {', '.join(f'round({m}, 6) AS {m}' for m in _M)} FROM m",
    "rank_comparison": f"""WITH {JUDGED}, per AS (SELECT query_id, min(a) FILTER (role = 'answer') AS x, min(b) FILTER (role = 'answer') AS y,
  coalesce(list_sort(list(node_id) FILTER (coalesce(b <= 10, false) AND NOT coalesce(a <= 10, false))), []) AS new, coalesce(list_sort(list(node_id) FILTER (coalesce(a <= 10, false) AND NOT coalesce(b <= 10, false))), []) AS lost FROM rows GROUP BY 1)
SELECT query_id, x - y AS answer_rank_change, array_to_string(new, ',') AS newly_retrieved, array_to_string(lost, ',') AS newly_missed, (x IS NOT NULL AND (y IS NULL OR y > x)) OR len(lost) > 0 AS regression FROM per""",
    "metric_deltas": f"WITH {JUDGED}, x AS ({_metrics('a')}), y AS ({_metrics('b')}) SELECT {', '.join(f'round((SELECT avg({m}) FROM y) - (SELECT avg({m}) FROM x), 6) AS delta_{m}' for m in _M)}",
    "credential_documents": f"""WITH found AS (SELECT doc_id, text, unnest(list_concat(regexp_extract_all(text, '{_q(predicates.ASSIGNMENT)}', 1), [''])) AS v FROM documents)
SELECT DISTINCT doc_id FROM found WHERE regexp_matches(text, '{_q('|'.join(predicates.TOKENS))}') OR regexp_matches(text, '{_q(predicates.BEARER)}') OR regexp_matches(text, '{_q(predicates.PRIVATE_KEY)}') OR regexp_matches(text, '{_q(predicates.URL_CREDENTIAL)}')
  OR NOT (length({_INNER}) < 6 OR regexp_matches({_INNER}, '[{{<$]') OR {_DYNAMIC} OR regexp_full_match({_INNER}, '[A-Za-z_][A-Za-z0-9_.]*'))""",
    "expand_identifiers": "SELECT page_id, md5(e) AS digest, length(e)::BIGINT AS n_chars FROM (SELECT page_id, replace(replace(regexp_replace(html, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '-', ' ') AS e FROM pages)",
    "local_path_strings": f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[^:]*://[^/]*(/[^?#]*)', 1) AS path FROM pages),
v AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN path WHEN 1 THEN chr(9) || path WHEN 2 THEN chr(10) || ' /data' || path WHEN 3 THEN 'see /tmp' || path || ' for it' WHEN 4 THEN 'C:/Users' || path WHEN 5 THEN chr(8195) || '''/x' || path || '''' WHEN 6 THEN 'src' || path ELSE url END AS v FROM p),
t AS (SELECT page_id, v, trim(v, chr(9) || chr(10) || chr(13) || ' ' || chr(8195)) AS bare FROM v)
SELECT page_id, bare <> '' AND (regexp_matches(trim(bare, '"'''), '^(?:/|[A-Za-z]:[\\\\/])') OR regexp_matches(v, '{_q(_LOCAL)}') OR regexp_matches(v, '{_q(_WIN)}')) AS is_local FROM t""",
    "display_rounding": "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.3f', l_quantity * 0.0005::DOUBLE + l_linenumber)::DOUBLE AS rounded FROM lineitem",
    "json_leaks": """SELECT page_id, '$.page.from.file' AS path, 'local path' AS problem FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, '$.fields[0].password', 'secret field' FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id, '$.notes[0][1]', 'local path' FROM pages WHERE page_id % 7 = 0""",
    "sanitized_urls": """WITH c AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\\1') AS clean FROM pages),
d AS (SELECT page_id, lower(regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*')) || regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$', 1) AS clean FROM c)
SELECT page_id, clean, coalesce(nullif(regexp_replace(regexp_extract(regexp_replace(regexp_extract(clean, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(.*)$', 1), '/+$', ''), '([^/]*)$', 1), '[.]git$', ''), ''), 'none') AS name FROM d""",
    "snippet_truncate": """SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(left(text, 79), '[\\s\\x1c-\\x1f]+$', '') || '…' END AS snippet FROM documents""",
    "method_calls": """WITH m AS (SELECT 'src/m' || s_suppkey || '.py' AS p FROM supplier)
SELECT 'file:' || p AS source_id, 'symbol:' || p || '::' || n AS target_id, 'CONTAINS' AS kind, 1::BIGINT AS count, 1.0::DOUBLE AS confidence FROM m, (VALUES ('helper'), ('Box'), ('use')) t(n)
UNION ALL SELECT 'symbol:' || p || '::Box', 'symbol:' || p || '::Box.' || n, 'CONTAINS', 1, 1.0 FROM m, (VALUES ('helper'), ('run')) t(n)
UNION ALL SELECT 'symbol:' || p || '::Box.run', 'symbol:' || p || '::Box.helper', 'CALLS', 1, 0.95 FROM m""",
    # worked out by hand from the two sources: kinds' priors times the confidence of the rule that resolves each name
    "python_symbols": """SELECT * FROM (VALUES
  ('file:src/app/core.py', 'symbol:src/app/core.py::Base', 'CONTAINS', 1::BIGINT, 0.45::DOUBLE), ('file:src/app/core.py', 'symbol:src/app/core.py::Work', 'CONTAINS', 1, 0.45),
  ('symbol:src/app/core.py::Work', 'symbol:src/app/core.py::Work.run', 'CONTAINS', 1, 0.45), ('file:src/app/core.py', 'symbol:src/app/core.py::helper', 'CONTAINS', 1, 0.45),
  ('file:tests/test_core.py', 'symbol:tests/test_core.py::test_helper', 'CONTAINS', 1, 0.45), ('file:tests/test_core.py', 'file:src/app/core.py', 'IMPORTS', 1, 0.65),
  ('symbol:src/app/core.py::Work', 'symbol:src/app/core.py::Base', 'INHERITS', 1, 0.9025), ('symbol:src/app/core.py::Work.run', 'symbol:src/app/core.py::helper', 'CALLS', 1, 0.95),
  ('symbol:src/app/core.py::helper', 'symbol:src/app/core.py::Work', 'INSTANTIATES', 1, 0.855), ('symbol:src/app/core.py::helper', 'symbol:src/app/core.py::Work.run', 'CALLS', 1, 0.85),
  ('symbol:tests/test_core.py::test_helper', 'symbol:src/app/core.py::helper', 'TESTS', 1, 0.8075)) t(source_id, target_id, kind, count, strength)""",
}
assert text.WORD == f"({_WORDS})"
