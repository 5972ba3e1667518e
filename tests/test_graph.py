"""Graph retrieval operators against closed forms and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.config import BenchmarkError
from strandgraph.functions import predicates, text
from strandgraph.operators import evaluation, graph, relations, skew
from strandgraph.plans import registry

EDGES = "source_id string, target_id string, kind string, count long, confidence double, strength double, evidence array<string>"


def test_parallel_edges_combine(spark):
    rows = [("r", "h", "CALLS", 1, 0.95, 0.9, []), ("h", "r", "IMPORTS", 1, 1.0, 0.4, []), ("r", "h", "CO_CHANGES", 1, 1.0, 0.25, [])]
    edges = spark.createDataFrame(rows, EDGES)
    pairs = graph.projection(edges)
    assert abs(pairs.first().weight - 0.955) < 1e-12
    seeds = spark.createDataFrame([("r", 0.8, 1)], "node_id string, seed_score double, seed_rank int")
    paths = graph.strongest_paths(pairs, seeds, hops=1)
    assert abs(paths.first().score - 0.85 * 0.955) < 1e-12
    used = graph.step_contributions(graph.path_steps(paths, pairs, ["node_id"]).drop("kinds"), edges, ["node_id"]).collect()
    assert {u.kind: u.traversal_direction for u in used} == {"CALLS": "forward", "IMPORTS": "reverse", "CO_CHANGES": "undirected"}


def test_pagerank_sums_to_one_and_converges(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5)], "u string, v string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node_id string")
    got = {r.node_id: r.rank for r in graph.pagerank(pairs, nodes, spark.createDataFrame([("a", 0.0), ("d", 0.0)], "node_id string, weight double"), iterations=30).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["b"] > got["c"]
    # rankings of several keys in one loop equal those of one at a time, each stopping on its own
    personal = [(1, "a", 2.0), (1, "c", 1.0), (2, "d", 1.0), (3, "b", 0.0)]
    both = graph.pagerank(pairs, nodes, spark.createDataFrame(personal, "q int, node_id string, weight double"), keys=["q"], tolerance=1e-3).collect()
    for q in (1, 2, 3):
        alone = graph.pagerank(pairs, nodes, spark.createDataFrame([p[1:] for p in personal if p[0] == q], "node_id string, weight double"), tolerance=1e-3).collect()
        assert {r.node_id: r.rank for r in both if r.q == q} == pytest.approx({r.node_id: r.rank for r in alone}, abs=1e-15)


def test_metrics_comparison_and_validation(spark):
    judged = spark.createDataFrame([("q1", "a1", "answer", 3), ("q1", "s1", "supporting", 1), ("q2", "a2", "answer", 3), ("q2", "s2", "supporting", 1)], "query_id string, node_id string, role string, relevance int")

    def ranking(**tops):
        rows = [(q, k + 1, n) for q, top in tops.items() for k, n in enumerate([*top, *[f"{q}x{j}" for j in range(20 - len(top))]])]
        return spark.createDataFrame(rows, "query_id string, rank int, node_id string")

    lexical, worse = ranking(q1=["a1", "s1"], q2=["no", "a2"]), ranking(q1=["no", "a1", "s1"], q2=["no", "a2"])
    row = evaluation.evaluate_rankings(judged, lexical).first()
    assert tuple(row) == (0.75, 0.75, 0.75, 0.5)
    compared = {r.query_id: r for r in evaluation.compare_queries(judged, lexical, worse).collect()}
    assert compared["q1"].answer_rank_change == -1 and compared["q1"].regression and not compared["q2"].regression
    assert "answer MRR@10 decreases by 0.250; recall@10 is unchanged" in evaluation.compare_rankings(judged, lexical, worse).first().conclusion
    evaluation.validate_rankings(lexical, judged)
    for bad in (lexical.filter("rank < 20"), lexical.withColumn("node_id", F.lit("a1"))):
        with pytest.raises(BenchmarkError):
            evaluation.validate_rankings(bad, judged)
    with pytest.raises(BenchmarkError):
        evaluation.validate_judgments(judged.filter("role = 'answer'"))


def test_publication_predicates(spark):
    secret = ['password = "hunter2hunter2!"', "Authorization: Bearer abcdefghijklmnop", "-----BEGIN RSA PRIVATE KEY-----", "https://u:p4ss@host/x", "ghp_" + "a" * 24]
    fine = ["token = os.environ['X_TOKEN']", "api_key: ${KEY}", "token = load_token()", "GET /api/items", "password: changeme"]
    rows = spark.createDataFrame([(v,) for v in secret + fine], "v string").select(predicates.contains_credential(F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == [True] * 5 + [False] * 5
    urls = [("https://u:p@Example.test:8443/a/b.git?x#y", "https://example.test:8443/a/b.git"), ("git@example.test:acme/s.git", "ssh://example.test/acme/s.git"), ("/srv/x", None), ("file:///x", None), ("plain", None), ("", None)]
    rows = spark.createDataFrame([(u,) for u, _ in urls], "u string").select(text.sanitize_remote_url(F.col("u")).alias("c")).collect()
    assert [r.c for r in rows] == [c for _, c in urls]
    cut = spark.createDataFrame([("  abcdefghijkl  ",)], "v string").select(*[text.truncate_source(F.col("v"), k).alias(f"c{k}") for k in (1, 2, 12)]).first()
    assert tuple(cut) == ("…", "…", "  abcdefghi…")
    whole = spark.createDataFrame([(" ab ",), ("\u00a0ab\x1f\n",)], "v string").select(text.truncate_source(F.col("v"), 5).alias("t"), text.strip(F.col("v")).alias("s")).collect()
    assert [tuple(r) for r in whole] == [(" ab ", "ab"), ("\u00a0ab\x1f\n", "ab")]


def test_secret_fields_and_public_strings(spark):
    rows = [
        ("password", "hunter2", "secret field"), ("api_key", "${KEY}", None), ("token", "redacted", None), ("Secret", "'none'", None), ("title", "hunter2", None),
        (None, "/home/me/x.py", "local path"), (None, "C:\\\\data\\\\x", "local path"), (None, "GET /api/items", None), (None, "token = 'abc-123456'", "credential"),
        ("id", "file:src/../x.py", "unsafe node path"), ("id", "file:src/x.py::f", None), (None, "", None),
    ]
    got = spark.createDataFrame(rows, "field string, value string, want string").select("want", predicates.public_problem(F.col("field"), F.col("value")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_display_rounding_is_half_even(spark):
    values = [0.0625, 0.1875, 0.5, 1 / 3, 2.0]
    row = spark.createDataFrame([(v,) for v in values], "v double").select(text.display_round(F.col("v"), 3).alias("r")).collect()
    assert [r.r for r in row] == [round(v, 3) for v in values]


def plain_paths(weights, order, seeds, hops, decay):
    """Every simple path from the seeds, extended hop by hop in neighbour order; the first best counts."""
    top = max(seeds.values()) or 1.0
    frontier, best = [(n, s / top, (n,)) for n, s in seeds.items()], {}
    for _ in range(hops):
        further = []
        for node, score, path in frontier:
            for other in order[node]:
                if other not in path:
                    got = score * decay * weights[frozenset((node, other))]
                    if got > best.get(other, (0.0, ()))[0]:
                        best[other] = (got, (*path, other))
                    further.append((other, got, (*path, other)))
        frontier = further
    return best


@pytest.mark.parametrize("seed", range(4))
def test_strongest_paths_equal_all_simple_paths(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(9)]
    strengths = [0.5, 0.5, 1.0] if seed % 2 else [rng.random() for _ in range(5)]
    ends = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(16)})
    edges = spark.createDataFrame([(a, b, "CALLS", 1, 1.0, rng.choice(strengths), []) for a, b in ends], EDGES)
    pairs = graph.projection(edges)
    weights = {frozenset((r.u, r.v)): r.weight for r in pairs.collect()}
    order = {n: [b if a == n else a for a, b in ends if n in (a, b)] for n in names}
    seeds = {"n0": 1.0, "n3": 1.0 if seed % 2 else 0.7, "n5": 0.4}
    table = spark.createDataFrame([(n, s, k + 1) for k, (n, s) in enumerate(seeds.items())], "node_id string, seed_score double, seed_rank int")
    for hops in (2, 3):
        want = plain_paths(weights, order, seeds, hops, 0.85)
        got = {r.node_id: (r.score, tuple(r.path)) for r in graph.strongest_paths(pairs, table, hops=hops).collect()}
        assert got == want
        pruned = {r.node_id: (r.score, tuple(r.path)) for r in graph.strongest_paths(pairs, table, hops=hops, exhaustive=False).collect()}
        assert {n: v for n, v in pruned.items() if n not in seeds} == {n: v for n, v in want.items() if n not in seeds}


def test_paths_through_a_hub_are_dealt_to_several_tasks(spark):
    # every leaf hangs on the hub, two leaves carry a tail each
    n = 600
    rows = [("hub", f"leaf{k:03d}", (k % 9 + 1) / 10) for k in range(n)] + [("leaf007", "tail_a", 0.5), ("leaf008", "tail_b", 0.5)]
    pairs = spark.createDataFrame([(u, v, w, u, v, "K") for u, v, w in rows], "u string, v string, weight double, first_source string, first_target string, first_kind string")
    assert [k for k, parts in skew.hot_keys(graph.adjacency(pairs), ["node"]) if parts > 1] == ["hub"]
    seeds = spark.createDataFrame([("leaf000", 1.0, 0), ("hub", 0.5, 1)], "node_id string, seed_score double, seed_rank int")
    got = {r.node_id: (round(r.score, 9), tuple(r.path)) for r in graph.strongest_paths(pairs, seeds, hops=2, hop_decay=0.8).collect()}
    first, expected = 0.1 * 0.8, {}
    for k in range(1, n):
        one, two = 0.5 * 0.8 * (k % 9 + 1) / 10, first * 0.8 * (k % 9 + 1) / 10
        expected[f"leaf{k:03d}"] = (round(max(one, two), 9), ("hub", f"leaf{k:03d}"))
    expected |= {f"tail_{x}": (round(0.5 * 0.8 * w * 0.8 * 0.5, 9), ("hub", leaf, f"tail_{x}")) for x, leaf, w in (("a", "leaf007", 0.8), ("b", "leaf008", 0.9))}
    expected |= {"hub": (round(first, 9), ("leaf000", "hub")), "leaf000": (round(0.5 * first, 9), ("hub", "leaf000"))}
    assert got == expected


def test_steps_in_words(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS", 1, 1.0, 0.9, []), ("b", "a", "IMPORTS", 1, 1.0, 0.95, []), ("c", "b", "CO_CHANGES", 1, 1.0, 0.5, [])], EDGES)
    paths = spark.createDataFrame([(1, "c", ["a", "b", "c"]), (2, "x", ["b", "x"])], "k int, node_id string, path array<string>")
    names = spark.createDataFrame([(n, n.upper()) for n in "abcx"], "node_id string, name string")
    got = {r.k: r.text for r in graph.format_paths(paths.drop("node_id"), graph.projection(edges), edges, names, ["k"]).collect()}
    assert got == {1: "A <-[IMPORTS 0.95]- B -[CO_CHANGES 0.50]- C", 2: "B -- X"}


def test_default_nodes(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS", 1, 1.0, 0.9, []), ("c", "b", "CALLS", 1, 1.0, 0.1, []), ("c", "c", "CALLS", 1, 1.0, 0.1, [])], EDGES)
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node_id string")
    assert graph.default_node(edges, nodes).first().node_id == "b" and graph.default_node(edges, nodes, "d").first().node_id == "d"
    ranked = spark.createDataFrame([(1, "a", 0.1, 0.0, False), (1, "b", 0.1, 0.5, False), (2, "a", 0.9, 0.0, False), (2, "c", 0.2, 0.0, True)], "query_id int, node_id string, direct double, relationship double, top_anchor boolean")
    assert {r.query_id: r.node_id for r in graph.default_query_node(ranked).collect()} == {1: "b", 2: "c"}


def test_joins_on_hot_keys_lose_nothing(spark):
    rng = random.Random(1)
    left = [(0 if rng.random() < 0.4 else rng.randrange(1, 50), k) for k in range(2000)] + [(None, -1)]
    right = [(k, f"r{k}") for k in range(0, 40)] + [(0, "again"), (None, "none")]
    a, b = spark.createDataFrame(left, "k int, row int"), spark.createDataFrame(right, "k int, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = skew.spread_join(a, b, ["k"], "row", how), a.join(b, ["k"], how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [k for k, _ in skew.hot_keys(a, ["k"])] == [0] and not skew.hot_keys(a.filter("k > 0"), ["k"])


def test_large_commits_count_but_make_no_pairs(spark):
    changes = spark.createDataFrame([(c, p) for c in "xyz" for p in "abc"] + [("x", p) for p in "defg"], "commit_id string, path string")
    pairs = relations.cochange_pairs(changes, minimum_support=2, maximum_files=3)
    assert {(r.left_path, r.right_path, r.n) for r in pairs.collect()} == {("a", "b", 2), ("a", "c", 2), ("b", "c", 2)}
    assert {r.path: r.commits for r in relations.commit_totals(changes).collect()}["a"] == 3


def test_changes_move_once_by_commit(spark, monkeypatch):
    """They were made distinct, stored and moved twice more before; a row has the paths of a small commit or one path of a large one."""
    plans = {}
    keep = relations.stored
    monkeypatch.setattr(relations, "stored", lambda df, name="table": (plans.setdefault(name, _plan(df)), keep(df, name))[1])
    changes = spark.createDataFrame([(c, p, -c) for c in range(3) for p in "abab"] + [(7, f"p{k}", -7) for k in range(5)] + [(8, None, -8)], "commit_id long, path string, ord long")
    rows = relations._commits(changes, 3).collect()
    assert sorted((r.commit_id, r.ord, r.paths) for r in rows if r.commit_id < 7) == [(c, -c, ["a", "b"]) for c in range(3)]
    assert sorted(r.paths for r in rows if r.commit_id == 7) == [[f"p{k}"] for k in range(5)]
    assert list(plans) == ["commits"] and plans["commits"].count("Exchange") == 1
    paths = ("a", "b")
    assert [(r.source_id, r.target_id, r["count"]) for r in relations.cochange_relations(changes, maximum_files=3).collect()] == [(*paths, 3)]


def test_edges_by_pair_do_not_move_again(spark, tiny):
    """Pairs, their strongest edges and the edges of steps were dealt by pair again, each time."""
    edges, pairs = registry._graph(spark, tiny)
    for frame in (graph.projection(edges), graph.strongest_edges(edges)):
        assert "hashpartitioning(u" not in _plan(frame) and "Bucketed: true" in _plan(frame)
    plain = edges.drop("u", "v").localCheckpoint()
    assert sorted(map(str, graph.projection(plain).collect())) == sorted(map(str, graph.projection(edges).collect())) != []
    assert sorted(map(str, graph.strongest_edges(plain).collect())) == sorted(map(str, graph.strongest_edges(edges).collect()))
    assert pairs.count() == graph.projection(plain).count() and not [t for t in spark.catalog.listTables() if "counted" in t.name or "pairs" in t.name]


def test_registered_pairs_keep_the_references_limit(spark, tmp_path):
    sizes = {1: 20, 2: 20, 3: 21, 4: 21}
    rows = [(c, p, 1) for c, n in sizes.items() for p in range(100 * (c > 2), 100 * (c > 2) + n)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.cochange_pairs(spark, str(tmp_path)).collect()
    assert len(got) == 190 and {(r.n, r.commits) for r in got} == {(2, "2,1")}


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Tables of two parts, three suppliers and five customers; parts and suppliers meet in shipments only."""
    root = tmp_path_factory.mktemp("tiny")
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(1, 1, 1), (2, 1, 2), (3, 2, 2), (4, 2, 2)]),
        "part": ("p_partkey long, p_brand string, p_retailprice double", [(1, "A", 5.0), (2, "B", 7.0)]),
        "nation": ("n_nationkey long, n_regionkey long", [(1, 1)]),
        "supplier": ("s_suppkey long, s_nationkey long", [(1, 1), (2, 1), (3, 1)]),
        "customer": ("c_custkey long", [(k,) for k in range(1, 6)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(root / f"{name}.parquet"))
    return str(root)


def test_graph_queries_walk_shipments(spark, tiny):
    assert {r.node_id: r.degree for r in registry.node_degrees(spark, tiny).collect()} == {
        "part:1": 3, "part:2": 2, "supplier:1": 2, "supplier:2": 3, "supplier:3": 1, "nation:1": 4, "region:1": 1, "brand:A": 1, "brand:B": 1
    }
    paths = {r.node_id: r.path for r in registry.strongest_paths_2hop(spark, tiny).collect()}
    assert paths["supplier:1"] == "part:1>supplier:1" and paths["nation:1"].split(">")[1] in ("supplier:1", "supplier:2")
    kinds = {r.edge_id.split(":")[0] for r in registry.step_contributions(spark, tiny).collect()}
    assert kinds == {"SHIPS", "CONTAINS", "IMPORTS"}
    assert ("part:1", "supplier:1") in {(r.node_id, r.neighbour_id) for r in registry.neighborhood_top8(spark, tiny).collect()}
    assert "SHIPS" in {r.kind for r in registry.induced_subgraph(spark, tiny).collect()}
    assert {r.node_id for r in registry.related_pruned(spark, tiny).collect()} >= {"supplier:1", "supplier:2"}


def test_pagerank_counts_every_customer(spark, tiny):
    weights = {(r.u, r.v): r.weight for r in graph.projection(registry._edges(spark, tiny)).collect()}
    nodes = sorted({n for pair in weights for n in pair} | {f"customer:{k}" for k in range(1, 6)})
    flow = np.zeros((len(nodes), len(nodes)))
    for (u, v), w in weights.items():
        i, j = nodes.index(u), nodes.index(v)
        flow[i, j] = flow[j, i] = w
    out = flow.sum(axis=1)
    flow = np.divide(flow, out[:, None], out=np.zeros_like(flow), where=out[:, None] > 0)
    # both parts are seeds and stand in two and two commits
    p = np.array([{"part:1": 0.5, "part:2": 0.5}.get(n, 0.0) for n in nodes])
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(registry.RANKS):
        rank = 0.85 * (rank @ flow + rank[out == 0].sum() * p) + 0.15 * p
    got = {r.node_id: r.rank for r in registry.pagerank_k(spark, tiny).collect()}
    assert sorted(got) == nodes and all(abs(got[n] - r) < 1e-8 for n, r in zip(nodes, rank, strict=True))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_that_fan_out_or_gather_state_their_number_of_tasks(spark):
    """Partitions joined by their written size held more in memory the larger the input was."""
    from strandgraph.operators import relations
    from strandgraph.plans.lineage import dealt, shares_of, stored

    cores = spark.sparkContext.defaultParallelism
    assert shares_of(10, spark) == cores and shares_of(1_000_000 * cores, spark) == 2 * cores
    changes = spark.createDataFrame([(c, f"p{k}") for c in range(6) for k in range(c)], "commit_id long, path string")
    assert dealt(changes, 40_000_000, "path").rdd.getNumPartitions() == 80
    related = relations.cochange_relations(changes)
    assert "evidence" in related.columns
    plain = relations.aggregate_relations(related.drop("evidence"), 10)
    whole = relations.aggregate_relations(related)
    assert "evidence" not in plain.columns
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, whole.drop("evidence").collect())) != []
    for frame in (relations.cochange_pairs(changes), graph.projection(plain), graph.strongest_edges(plain)):
        assert "REPARTITION_BY_NUM" in _plan(frame)
    assert stored(plain).count() == plain.count()


def test_pagerank_broadcasts_no_table_of_all_nodes(spark, monkeypatch):
    """Equal ranks make small files, which passed for small tables: millions of rows were broadcast in each round."""
    plans = []
    keep = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name="table": (plans.append(_plan(df)) if name == "ranks" else None) or keep(df, name))
    pairs = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 0.5) for k in range(10, 40)], "u string, v string, weight double")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(10, 45)], "node_id string")
    graph.pagerank(pairs, nodes, spark.createDataFrame([("n10", 1.0)], "node_id string, weight double"), iterations=2, tolerance=None)
    assert len(plans) == 3 and all("SortMergeJoin" in p for p in plans)


def test_a_pairs_first_edge_and_kinds_are_gathered_without_a_sort(spark):
    """Strings as least values had all edges sorted by pair; kinds and ways are numbers now, and edges without kinds count too."""
    rng, kinds = random.Random(5), ["b", "a", "CALLS", "é", "z", None]
    rows = [(a, b, k, 1, 1.0, rng.random(), []) for a, b, k in {(rng.choice("pqrs"), rng.choice("pqrs"), rng.choice(kinds)) for _ in range(60)}]
    edges = spark.createDataFrame(rows, EDGES)
    for extra in (0, 80):
        more = [("x", "y", f"k{k:02d}", 1, 1.0, 0.01, []) for k in range(extra)]
        met = {}
        for s, t, k, *_ in rows + more:
            if s != t:
                met.setdefault((min(s, t), max(s, t)), []).append((s, t, k))
        got = graph.projection(edges.union(spark.createDataFrame(more, EDGES)) if more else edges)
        for r in got.collect():
            found = met.pop((r.u, r.v))
            assert (r.first_source, r.first_target, r.first_kind) == min(found, key=lambda e: (e[0], e[1], (e[2] is not None, e[2] or "")))
            assert r.kinds == sorted({k for _, _, k in found if k is not None})
        assert not met
    assert "SortAggregate" not in _plan(graph.projection(edges))


def test_a_small_frontier_and_its_steps_move_no_pairs(spark, tiny, monkeypatch):
    """All neighbours were stored in both directions and shuffled in each hop, and pairs and edges sorted for the steps."""
    edges, pairs, seeds, paths = registry._walked(spark, tiny)
    names, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name="table": names.append(name) or keep(df, name))
    few, many = ({tuple(r) for r in graph.strongest_paths(pairs, seeds, few=n).select("node_id", "score", "depth", "path").withColumn("path", F.array_join("path", ">")).collect()} for n in (100_000, 0))
    assert few == many and len(few) == paths.count() > 0 and names.count("adjacency") == 1
    steps = graph.path_steps(paths, pairs, ["node_id"])
    for frame in (steps, graph.step_contributions(steps.drop("combined_strength"), edges, ["node_id"])):
        assert "ShuffledHashJoin" in _plan(frame) or "BroadcastHashJoin" in _plan(frame)
    # a step over no pair stays
    lost = paths.limit(1).withColumn("path", F.array(F.lit("no"), F.lit("where")))
    assert [tuple(r) for r in graph.path_steps(lost, pairs, ["node_id"]).select("from_id", "to_id", "combined_strength").collect()] == [("no", "where", None)]


def test_edges_by_pair_keep_lost_ends_and_every_kind_of_way(spark):
    rows = [("a", "b", "K", 1, 0.5), ("b", "a", "K", 2, 0.5), ("a", "b", "K", 3, 1.0), ("c", "c", "K", 1, 1.0), (None, "d", "K", 1, 1.0), ("d", None, "K", 1, 1.0), (None, None, "K", 1, 1.0)]
    frame = spark.createDataFrame(rows, "source_id string, target_id string, kind string, count long, confidence double")
    want, got = (sorted(map(str, relations.aggregate_relations(frame, 7, by_pair=b).drop("u", "v").collect())) for b in (False, True))
    assert got == want and len(got) == 6


def test_neighbours_are_chosen_by_pair(spark, tiny):
    """Both directions of all edges were dealt anew to choose among parallel ones."""
    edges = registry._edges(spark, tiny)
    near = relations.strongest_per_neighbour(edges)
    assert "REPARTITION_BY_NUM" not in _plan(near) and "hashpartitioning(_h" not in _plan(near) and "Bucketed: true" in _plan(near)
    assert sorted(map(str, near.collect())) == sorted(map(str, relations.strongest_per_neighbour(edges.drop("u", "v").localCheckpoint(), 9).collect())) != []
