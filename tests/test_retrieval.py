"""Sparse PageRank, early-ending search, and the predicates and functions that publication depends on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.config import RetrievalConfig
from strandgraph.functions import predicates, text
from strandgraph.operators import graph, search
from strandgraph.plans.build import graph_tables


def random_pairs(spark, rng, n, edges):
    ends = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(edges)} | {(0, k) for k in range(1, n // 2)})
    rows = [(f"n{a:03d}", f"n{b:03d}", 0.1 + 0.9 * rng.random()) for a, b in ends]
    return rows, spark.createDataFrame(rows, "u string, v string, weight double")


def dense_rank(rows, names, personal, alpha=0.85):
    at = {n: k for k, n in enumerate(names)}
    flow = np.zeros((len(names), len(names)))
    for u, v, w in rows:
        flow[at[u], at[v]] = flow[at[v], at[u]] = w
    out = flow.sum(axis=1)
    flow = np.divide(flow, out[:, None], out=np.zeros_like(flow), where=out[:, None] > 0)
    p = np.array([personal.get(n, 0.0) for n in names])
    p /= p.sum()
    rank = p.copy()
    for _ in range(300):
        rank = alpha * (rank @ flow + rank[out == 0].sum() * p) + (1 - alpha) * p
    return rank, out


def test_pushed_ranks_keep_their_bound_and_order(spark):
    rng = random.Random(4)
    rows, pairs = random_pairs(spark, rng, 60, 90)
    names = [f"n{k:03d}" for k in range(60)] + ["alone"]
    asked = {"q1": {"n003": 2.0, "n010": 1.0}, "q2": {"alone": 1.0, "n005": 1.0}, "q3": {"n000": 0.0, "n001": 0.0}}
    personal = spark.createDataFrame([(q, n, w) for q, own in asked.items() for n, w in own.items()], "q string, node_id string, weight double")
    for epsilon in (1e-2, 1e-5):
        found = graph.push_pagerank(pairs, personal, epsilon=epsilon, keys=["q"], block=7).collect()
        for q, own in asked.items():
            own = own if any(own.values()) else dict.fromkeys(own, 1.0)
            true, out = dense_rank(rows, names, own)
            got = {r.node_id: r for r in found if r.q == q}
            short = np.array([true[k] - (got[n].rank if n in got else 0.0) for k, n in enumerate(names)])
            assert short.min() > -1e-12
            assert abs(short.sum() - sum(r.residual for r in got.values())) < 1e-9
            assert all(short[k] <= epsilon * max(out[k], 1.0 if n == "alone" else 0.0) * (3 if q == "q2" else 1) + 1e-12 for k, n in enumerate(names))
            order, place = sorted(range(len(names)), key=lambda k: -true[k]), lambda k: got[names[k]].rank if names[k] in got else 0.0  # noqa: B023
            sure = [(a, b) for a, b in zip(order, order[1:], strict=False) if true[a] - true[b] > 3 * epsilon * max(out[a], 1.0)]
            assert all(place(a) > place(b) for a, b in sure) and (len(sure) > 20 or epsilon > 1e-4)


def test_a_far_graph_is_not_touched(spark):
    chain = [(f"c{k:03d}", f"c{k + 1:03d}", 1.0) for k in range(200)]
    personal = spark.createDataFrame([("c000", 1.0)], "node_id string, weight double")
    pairs = spark.createDataFrame(chain, "u string, v string, weight double")
    assert graph.push_pagerank(pairs, personal, epsilon=1e-2).count() < 40
    assert graph.push_pagerank(pairs, personal.limit(0)).count() == 0


@pytest.mark.parametrize("size", [4, 128])
def test_strongest_blocks_give_the_same_first_nodes_from_fewer_postings(spark, size):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    docs = [(f"d{k:04d}", " ".join(rng.choice(words[: 5 + k % 55]) for _ in range(rng.randrange(1, 40)))) for k in range(600)] + [("e", "unlike anything"), ("f", "unlike anything"), ("g", "")]
    index = search.build_search_index(spark.createDataFrame(docs, "node_id string, document string"))
    queries = spark.createDataFrame([("a", "w50 w51 w3"), ("b", "unlike"), ("c", "w1 w1 w2"), ("d", "zzzz")], "query_id string, query string")
    scores = search.query_scores(index, queries).withColumn("score", F.round("score", 9))
    want = {tuple(r) for r in search.top_ranked(scores, 5).select("query_id", "rank", "node_id", "score").collect()}
    read = []
    got = {tuple(r) for r in search.block_max_top_k(search.impact_index(index, size), queries, 5, read=read).collect()}
    assert {r[:3] for r in got} == {r[:3] for r in want} and len(read) >= 2
    assert {r[0] for r in got} >= {"a", "b", "c"}
    if size == 4:
        every = index.postings.join(search._terms(queries, "query_id", text.expand_identifiers(F.col("query"))).select("query_id", "block", "term"), ["block", "term"]).count()
        assert read[-2] < every and read[0] < every / 4


def test_rankings_side_by_side(spark):
    a = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y"), ("r", 1, "z")], "query_id string, rank int, node_id string")
    b = spark.createDataFrame([("q", 1, "y")], "query_id string, rank int, node_id string")
    assert {tuple(r) for r in search.ranking_table(a, b).collect()} == {("q", 1, "x", "y"), ("q", 2, "y", None), ("r", 1, "z", None)}


def test_self_outside_a_class_is_not_a_call_of_the_module(spark):
    one = b"def helper():\n    pass\n\n\ndef use(self):\n    return self.helper()\n"
    two = b"class Box:\n    def helper(self):\n        pass\n\n    def run(self):\n        return self.helper()\n"
    files = spark.createDataFrame([("src/one.py", one), ("src/two.py", two)], "path string, content binary")
    _, edges, _, counts = graph_tables(files, None)
    calls = {(r.source_id, r.target_id, r.confidence) for r in edges.filter("kind = 'CALLS'").collect()}
    assert calls == {("symbol:src/two.py::Box.run", "symbol:src/two.py::Box.helper", 0.95)}
    assert {r.outcome: r.n for r in counts.collect()}["unresolved_calls"] == 1


def test_white_space_hides_no_path_and_no_secret(spark):
    rows = [("\t/data/x", "local path"), ("\n/data/secret", "local path"), ("\u00a0/x", "local path"), ("\x1f C:\\\\x\t", "local path"), ("a\n/b", None), ("\tfile:/x::y", "local path"), (" \t", None)]
    got = spark.createDataFrame(rows, "value string, want string").select("want", predicates.public_problem(F.lit(None).cast("string"), F.col("value")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    named = spark.createDataFrame([("\t'redacted'\n", None), ("\thunter2", "secret field")], "value string, want string")
    got = named.select("want", predicates.public_problem(F.lit("password"), F.col("value")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(16)
    values = [0.0025, 2.6745, 0.0005, 0.0015, 1e-9, 0.0, -0.0025, -2.6745, 0.9995, 0.99949999999999994, 123456.0005, 2.0**40 / 3]
    values += [rng.random() * 10 ** rng.randrange(-4, 5) for _ in range(3000)] + [k / 2000 for k in range(4000)]
    near = [k / 2000 for k in range(500)]
    values += [float(np.nextafter(v, 9)) for v in near] + [float(np.nextafter(v, -9)) for v in near]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3):
        got = [r.r for r in rows.select(text.display_round(F.col("v"), digits).alias("r")).collect()]
        assert got == [round(v, digits) for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(text.display_round(F.col("v"), 3).alias("r")).collect()
    assert odd[0].r is None and odd[1].r != odd[1].r


def test_words_end_at_any_white_space(spark):
    row = spark.createDataFrame([("ab\u00a0cd\u2003ef\x1cg",)], "v string").select(text.char_wb_ngrams(F.col("v")).alias("g")).first()
    assert {" ab ", " cd ", " ef ", " g "} <= set(row.g)


def test_leaks_of_nested_json_are_those_of_the_nested_value(spark):
    import json

    from strandgraph.operators import leaks
    from strandgraph.plans.export import strings

    values = [
        {"a": {"b": [{"password": "hunter2"}, ["/home/me/x", "fine"], {"token": "redacted"}]}, "c": "token = 'abc-123456'"}, ["C:\\data\\x", {"id": "file:../x"}], "plain", "/etc/x", 5, None, True,
        {}, [], {"a.b": {"[0]": "\t/srv/y"}}, {"deep": [[[[[["/tmp/q"]]]]]]}, {"password": 7}, {"secret": ["hunter2"]},
    ]
    texts = [json.dumps(v) for v in values] + ["no json /tmp/z", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, value string")
    found = {(r.k, r.field, r.value) for r in leaks.json_strings(rows, ["k"]).collect()}
    want = {(k, f, s) for k, v in enumerate(values) for f, s in strings(v)} | {(len(values), None, "no json /tmp/z"), (len(values) + 2, None, "")}
    assert found == want
    got = {(r.k, r.path, r.problem) for r in leaks.leaks(rows, ["k"]).collect()}
    assert got == {
        (0, "$.a.b[0].password", "secret field"), (0, "$.a.b[1][0]", "local path"), (0, "$.c", "credential"), (1, "$[0]", "local path"), (1, "$[1].id", "unsafe node path"), (3, "$", "local path"),
        (9, "$.a.b.[0]", "local path"), (10, "$.deep[0][0][0][0][0][0]", "local path"), (13, "$", "local path"),
    }


def test_identifiers_are_cut_at_case_underscores_and_hyphens(spark):
    rows = [("buildSearchIndex", "build Search Index"), ("HTTPServer2Go", "HTTPServer2 Go"), ("snake_case-name", "snake case name"), ("aB_cD-eF9G", "a B c D e F9 G"), ("", "")]
    got = spark.createDataFrame(rows, "v string, want string").select("want", text.expand_identifiers(F.col("v")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_scores_of_many_queries_take_passes_and_tasks_of_bounded_size(spark, monkeypatch):
    """Documents of one file were cut by one task, and a row was made for every query, node and common term."""
    cut = []
    keep = search._terms
    monkeypatch.setattr(search, "_terms", lambda docs, key, text: cut.append(docs.rdd.getNumPartitions()) or keep(docs, key, text))
    docs = spark.createDataFrame([(f"n{k}", f"alpha w{k % 7} w{k % 5} text") for k in range(40)], "node_id string, document string").coalesce(1)
    asked = spark.createDataFrame([(k, f"w{k} text and w{k + 1}") for k in range(6)] + [(9, "§"), (10, "")], "query_id long, query string")
    index = search.build_search_index(docs)
    assert cut[0] >= spark.sparkContext.defaultParallelism
    want = {(r.query_id, r.node_id): r.score for r in search.query_scores(index, asked).collect()}
    monkeypatch.setattr(search, "QUERIES", 2)
    monkeypatch.setattr(search, "CELLS", 8)
    got = {(r.query_id, r.node_id): r.score for r in search.query_scores(index, asked).collect()}
    assert want.keys() == got.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and {q for q, _ in want} >= set(range(6))


def test_first_nodes_come_without_a_row_for_every_query_and_node(spark, monkeypatch):
    """All direct scores were stored, a row for every query and node."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(f"n{k:04d}", " ".join(rng.choice("alpha beta gamma delta eps zeta".split()) for _ in range(1 + k % 9))) for k in range(600)], "node_id string, document string")
    asked = spark.createDataFrame([(0, "alpha beta"), (1, "gamma gamma zeta"), (2, "nothing"), (3, "")], "query_id int, query string")
    edges = spark.createDataFrame([(f"n{k:04d}", f"n{k + 1:04d}", "FOLLOWS", 1, 1.0, 0.5 + k % 97 / 200) for k in range(599)], "source_id string, target_id string, kind string, count long, confidence double, strength double")
    index = search.build_search_index(docs)
    monkeypatch.setattr(search, "CELLS", 64)
    every, some = search.query_scores(index, asked), search.query_scores(index, asked, first=5)
    ranked = [{(r.query_id, r.rank, r.node_id, r.score) for r in search.top_ranked(x.withColumn("score", F.round("score", 9)), 5).collect()} for x in (every, some)]
    assert ranked[0] == ranked[1] and some.count() < every.count() / 2
    config = RetrievalConfig(seed_count=3, related_count=4)
    results = [search.query_graph(docs.select("node_id"), edges, index, asked, config, pagerank_iterations=3, epsilon=1e-3, first=first) for first in (None, 5)]
    table = lambda frame: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()}
    for name in ("anchors", "related"):
        assert table(getattr(results[0], name)) == table(getattr(results[1], name))
    lexical = [table(search.lexical_ranking(r.direct, docs.select("node_id"), asked, 5)) for r in results]
    assert lexical[0] == lexical[1]
    assert results[1].direct.count() < results[0].direct.count() / 2


def test_rounds_of_the_block_search_store_no_postings(spark, monkeypatch):
    """Each round stored the postings once more for every query, and its lower bounds stayed."""
    tables, keep, gone = [], search.stored, []
    monkeypatch.setattr(search, "stored", lambda frame, name="table", *rest: tables.append((name, "postings" in frame.columns)) or keep(frame, name, *rest))
    monkeypatch.setattr(search, "discard", lambda frame, drop=search.discard: gone.append(frame.columns) or drop(frame))
    docs = spark.createDataFrame([(f"n{k:03d}", f"alpha w{k % 7} w{k % 5}") for k in range(60)], "node_id string, document string")
    index = search.impact_index(search.build_search_index(docs), 4)
    tables.clear()
    assert search.block_max_top_k(index, spark.createDataFrame([(0, "alpha w3"), (1, "w1")], "query_id int, query string"), 3).count() == 6
    assert not any(held for _, held in tables)
    assert sum("lower" in columns for columns in gone) == sum(name == "lower" for name, _ in tables) > 0


def test_walks_run_to_their_end(spark, monkeypatch):
    """related_nodes ended PageRank after six rounds of pushes, which left a third of the rank unsaid."""
    rng = random.Random(7)
    rows, _ = random_pairs(spark, rng, 12, 14)
    rows += [(f"c{k:03d}", f"c{k + 1:03d}", 0.3 + k % 7 / 10) for k in range(10)]
    pairs = spark.createDataFrame(rows, "u string, v string, weight double")
    names = sorted({n for r in rows for n in r[:2]}) + ["alone"]
    asked = {"q1": {"n003": 2.0, "c005": 1.0}, "q2": {"alone": 1.0, "n005": 1.0}, "q3": {"alone": 0.0}}
    personal = spark.createDataFrame([(q, n, w) for q, own in asked.items() for n, w in own.items()], "q string, node_id string, weight double")
    ended = []
    keep = graph._pushed_on
    monkeypatch.setattr(graph, "_pushed_on", lambda *own: ended.append(own) or keep(*own))
    for within in (graph.WITHIN, 10):
        monkeypatch.setattr(graph, "WITHIN", within)
        epsilon = 1e-13 if within > 10 else 1e-2
        found = {(r.q, r.node_id): r.rank for r in graph.push_pagerank(pairs, personal, epsilon=epsilon, rounds=None, keys=["q"]).collect()}
        for q, own in asked.items():
            true, out = dense_rank(rows, names, own if any(own.values()) else dict.fromkeys(own, 1.0))
            assert all(-1e-11 < true[k] - found.get((q, n), 0.0) <= 3 * epsilon * max(out[k], 1.0) + 1e-11 for k, n in enumerate(names))
        assert bool(ended) == (within > 10)
        ended.clear()


def test_related_nodes_ask_for_whole_ranks(spark, monkeypatch):
    from strandgraph.plans import registry

    got = {}
    monkeypatch.setattr(registry, "_conversations", lambda *_: spark.createDataFrame([("1:1", "a")], "node_id string, document string"))
    monkeypatch.setattr(registry, "_asked", lambda *_: None)
    monkeypatch.setattr(registry, "_turn_edges", lambda *_: None)
    monkeypatch.setattr(search, "build_search_index", lambda docs: None)
    monkeypatch.setattr(search, "query_graph", lambda *_, **kw: got.update(kw) or search.QueryResult(*[spark.createDataFrame([], "query_id int, rank int, node_id string, direct double, relationship double, pagerank double, pagerank_share double")] * 6))
    assert registry.related_nodes(spark, "nowhere").count() == 0
    assert got["pagerank_iterations"] is None and got["epsilon"] <= 1e-12


def test_rounds_read_no_more_than_all_postings_and_runs_of_a_term_may_lie_apart(spark):
    """Rounds went on to the last block with a row for each query and posting, and all postings were moved four times to be cut in blocks."""
    from dataclasses import replace

    rng = random.Random(12)
    docs = [(f"d{k:03d}", " ".join(rng.choice("ab cd ef gh".split()) for _ in range(1 + k % 6))) for k in range(120)]
    index = search.build_search_index(spark.createDataFrame(docs, "node_id string, document string"))
    index = replace(index, postings=index.postings.repartition(3))
    asked = spark.createDataFrame([(k, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(5))) for k in range(12)], "query_id int, query string")
    built, read = search.impact_index(index, 4), []
    rows = built.blocks.collect()
    assert sum(len(r.postings) for r in rows) == index.postings.count() and max(len(r.postings) for r in rows) == 4
    assert all(r.top == r.postings[0].impact and [p.impact for p in r.postings] == sorted((p.impact for p in r.postings), reverse=True) for r in rows)
    got = {tuple(r) for r in search.block_max_top_k(built, asked, 5, read=read).collect()}
    scores = search.query_scores(index, asked).withColumn("score", F.round("score", 9))
    assert {r[:3] for r in got} == {tuple(r) for r in search.top_ranked(scores, 5).select("query_id", "rank", "node_id").collect()}
    assert max(read[1:]) <= index.postings.count()
