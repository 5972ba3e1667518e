"""Registered queries of the graph-retrieval operators over the driver tables, with oracle SQL.

Roles: an order is a commit and a part a file, so parts ordered together co-change; brands
contain parts; conversations are searched with benchmark items as queries; labels judge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.config import RetrievalConfig
from strandgraph.functions import predicates, text
from strandgraph.operators import bundles, evaluation, graph, leaks, relations, search
from strandgraph.plans.lineage import laid_out, stored

MAX_FILES, MIN_SUPPORT, HOPS, DECAY, SEEDS, RANKS = 20, 2, 2, 0.85, 6, 8
#: Residual per weighted degree at which a walk ends.
EPSILON = 1e-5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(column, digits: int = 6):
    return F.round(column, digits)


# --- relations ---


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, the greatest key as the newest."""
    part = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), part.alias("path"), (-F.col("l_orderkey")).alias("ord"))


def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = relations.cochange_pairs(changes(spark, sf_dir), minimum_support=MIN_SUPPORT, maximum_files=MAX_FILES)
    return pairs.select("left_path", "right_path", "n", F.array_join("commits", ",").alias("commits"))


def commit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.commit_totals(changes(spark, sf_dir))


#: Commits with their parts and commits per part, stored.
Commits = tuple[DataFrame, DataFrame]


def _commits(spark: SparkSession, sf_dir: str) -> Commits:
    commits = relations.gathered_commits(changes(spark, sf_dir), MAX_FILES)
    return commits, stored(relations.totals_of(commits), "totals")


def _cochange(spark: SparkSession, sf_dir: str, commits: Commits | None = None) -> DataFrame:
    commits, totals = commits or _commits(spark, sf_dir)
    return relations.cochange_relations(changes(spark, sf_dir), minimum_support=MIN_SUPPORT, maximum_files=MAX_FILES, commits=commits, totals=totals)


def cochange_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cochange(spark, sf_dir).select("source_id", "target_id", "count", _r("confidence").alias("confidence"))


def _relations(spark: SparkSession, sf_dir: str, commits: Commits | None = None) -> DataFrame:
    part, nation, supplier = (_table(spark, sf_dir, t) for t in ("part", "nation", "supplier"))
    line = _table(spark, sf_dir, "lineitem")

    def relation(frame: DataFrame, source: F.Column, target: F.Column, kind: str, confidence: float) -> DataFrame:
        return frame.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("count"), F.lit(confidence).alias("confidence"))

    name = lambda kind, column: F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))
    return (
        stored(_cochange(spark, sf_dir, commits).drop("evidence"), "cochange")
        .unionByName(relation(part, name("brand", "p_brand"), name("part", "p_partkey"), "CONTAINS", 1.0))
        .unionByName(relation(nation, name("region", "n_regionkey"), name("nation", "n_nationkey"), "CONTAINS", 1.0))
        .unionByName(relation(supplier, name("supplier", "s_suppkey"), name("nation", "s_nationkey"), "IMPORTS", 0.9))
        .unionByName(relation(line, name("supplier", "l_suppkey"), name("part", "l_partkey"), "SHIPS", 0.95))
    )


def _edges(spark: SparkSession, sf_dir: str, commits: Commits | None = None) -> DataFrame:
    """Edges without evidence, which no query shows; counted once and stored by pair."""
    every = _relations(spark, sf_dir, commits)
    edges = relations.aggregate_relations(every, every.count(), by_pair=True)
    return edges.withColumn("strength", _r("strength", 9))


def typed_edge_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("source_id", "target_id", "kind", "count", _r("confidence").alias("confidence"), _r("strength").alias("strength"))


def edge_kind_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.edge_summary(_edges(spark, sf_dir))


# --- graph: edges of all kinds ---


def _graph(spark: SparkSession, sf_dir: str, commits: Commits | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and pairs, stored by pair, for queries that read both or the pairs in several plans; none shows a pair's kinds."""
    edges = _edges(spark, sf_dir, commits)
    return edges, laid_out(graph.projection(edges).drop("kinds"), edges.count(), "u", "v", name="pairs")


def projection_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = graph.projection(_edges(spark, sf_dir))
    return every.select("u", "v", _r("weight").alias("weight"), F.array_join("kinds", ",").alias("kinds"))


def overview_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("group"))
    rolled = graph.overview(_edges(spark, sf_dir).filter("kind = 'CO_CHANGES'"), part)
    return rolled.select("source_group", "target_group", "kind", _r("strength").alias("strength"), "n")


def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths have nine decimals, so their sums are taken exactly."""
    edges = _edges(spark, sf_dir).withColumn("strength", F.col("strength").cast("decimal(18,9)"))
    return graph.degrees(edges).select("node_id", "degree", _r(F.col("total_strength")).cast("double").alias("total_strength"))


def _seeds(commits: Commits) -> DataFrame:
    """The parts of most commits, scored by their commits; a few stored rows."""
    totals = commits[1].orderBy(F.desc("commits"), "path").limit(SEEDS)
    rank = F.row_number().over(Window.orderBy(F.desc("commits"), "path"))
    return stored(totals.select(F.col("path").alias("node_id"), F.col("commits").cast("double").alias("seed_score"), rank.alias("seed_rank")), "seeds")


def _walked(spark: SparkSession, sf_dir: str, *, exhaustive: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges, pairs, seeds and the stored best paths from these."""
    commits = _commits(spark, sf_dir)
    edges, pairs = _graph(spark, sf_dir, commits)
    seeds = _seeds(commits)
    return edges, pairs, seeds, stored(graph.strongest_paths(pairs, seeds, hops=HOPS, hop_decay=DECAY, exhaustive=exhaustive), "paths")


def strongest_paths_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir)[3].select("node_id", _r("score").alias("score"), "depth", F.array_join("path", ">").alias("path"))


def related_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without seeds, by the pruned frontier that retrieval uses."""
    _, _, seeds, paths = _walked(spark, sf_dir, exhaustive=False)
    return paths.join(seeds.select("node_id"), "node_id", "left_anti").select("node_id", _r("score").alias("score"), "depth", F.array_join("path", ">").alias("path"))


def path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs, _, paths = _walked(spark, sf_dir)
    steps = graph.path_steps(paths, pairs, ["node_id"])
    return steps.select("node_id", "step", "from_id", "to_id", _r("combined_strength").alias("combined_strength"))


def step_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, pairs, _, paths = _walked(spark, sf_dir)
    rows = graph.step_contributions(graph.path_steps(paths, pairs, ["node_id"]).drop("combined_strength"), edges, ["node_id"])
    return rows.select("node_id", "step", text.edge_id(F.col("source_id"), F.col("target_id"), F.col("kind")).alias("edge_id"), "traversal_direction", _r("strength").alias("strength"))


def neighborhood_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevance = _table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id"), F.col("p_retailprice").alias("relevance"))
    near = graph.neighbourhood(_edges(spark, sf_dir), relevance, 8)
    return near.select("node_id", "place", "neighbour_id", "kind", _r("strength").alias("strength"))


def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _, _, paths = _walked(spark, sf_dir)
    chosen = paths.select(F.explode("path").alias("node_id"))
    return graph.induced_subgraph(edges, chosen).select("source_id", "target_id", "kind", _r("strength").alias("strength"))


def strongest_pair_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strongest_edges(_edges(spark, sf_dir)).select("source_id", "target_id", "kind", _r("strength").alias("strength"))


def pagerank_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = _commits(spark, sf_dir)
    edges, pairs = _graph(spark, sf_dir, commits)
    nodes = edges.select(F.col("source_id").alias("node_id")).union(edges.select("target_id")).union(_table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")))).distinct()
    personal = _seeds(commits).select("node_id", F.col("seed_score").alias("weight"))
    ranks = graph.pagerank(pairs, nodes, personal, iterations=RANKS, tolerance=None)
    return ranks.select("node_id", _r("rank", 9).alias("rank"))


def pagerank_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking per seed, of the nodes that its walks reach."""
    commits = _commits(spark, sf_dir)
    personal = _seeds(commits).select(F.col("node_id").alias("seed"), "node_id", F.lit(1.0).alias("weight"))
    ranks = graph.push_pagerank(_graph(spark, sf_dir, commits)[1], personal, epsilon=EPSILON, rounds=RANKS, keys=["seed"])
    return ranks.select("seed", "node_id", _r("rank", 8).alias("rank"), _r("residual", 8).alias("residual"))


# --- text ---


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node_id"), F.coalesce("text", F.lit("")).alias("document"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def word_ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.word_ngrams(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def char_wb_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _asked(spark, sf_dir).select(F.explode(F.array_distinct(text.char_wb_ngrams(F.col("query")))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    index = search.build_search_index(_conversations(spark, sf_dir))
    scores = search.query_scores(index, _asked(spark, sf_dir), first=k).withColumn("score", _r("score", 9))
    return search.top_ranked(scores, k)


def tfidf_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, 10).select("query_id", "rank", "node_id", _r("score", 5).alias("score"))


def tfidf_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking, from blocks of the strongest postings."""
    index = search.impact_index(search.build_search_index(_conversations(spark, sf_dir)))
    return search.block_max_top_k(index, _asked(spark, sf_dir), 10).withColumn("score", _r("score", 5))


def graph_ranking_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest turns, then turns of the shortest ids, then the best matching ones; 20 distinct per query."""
    base = _table(spark, sf_dir, "conversations").select(F.col("role").alias("query_id"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node_id"), F.length("text").alias("n"))
    base = base.groupBy("query_id", "node_id").agg(F.max("n").alias("n"))
    parts = [search.top_ranked(base, k, *order) for k, order in ((6, (F.desc("n"),)), (10, (F.asc("n"),)), (20, (F.desc(F.length("node_id")),)))]
    return search.fill_ranking(parts, 20)


# --- retrieval: turns of a conversation are linked to the next one ---

#: What a query takes: nodes per ranking, related nodes, rounds and residual of PageRank.
BUDGET, RELATED, PUSHES, FINE = 20, 25, 6, 1e-4
#: Residual per weighted degree of walks to their end: less than rounding moves a rank.
LEAST = 1e-14
_CONFIG = RetrievalConfig(seed_count=SEEDS, hops=HOPS, related_count=RELATED, hop_decay=DECAY)


def _turn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn leads to the next; the strength depends on the ids, so that few paths are equally strong."""
    turns = _table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    after = F.min("turn").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, 1))
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), F.col(turn).cast("string"))
    strength = 0.5 + F.pmod(F.col("conv_id") * 37 + F.col("turn") * 101, F.lit(997)) / 2000
    linked = turns.withColumn("after", after).filter("after is not null")
    return linked.select(name("turn").alias("source_id"), name("after").alias("target_id"), F.lit("FOLLOWS").alias("kind"), F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("confidence"), strength.alias("strength"))


def _answered(spark: SparkSession, sf_dir: str, iterations: int | None = PUSHES, epsilon: float = FINE) -> search.QueryResult:
    """The benchmark's questions asked of the turns."""
    docs, asked = _conversations(spark, sf_dir).dropDuplicates(["node_id"]), _asked(spark, sf_dir)
    return search.query_graph(docs.select("node_id"), _turn_edges(spark, sf_dir), search.build_search_index(docs), asked, _CONFIG, pagerank_iterations=iterations, epsilon=epsilon, first=BUDGET)


def _retrieved(spark: SparkSession, sf_dir: str) -> tuple[search.QueryResult, DataFrame, DataFrame]:
    """What is found for the questions, with the lexical and the graph ranking."""
    docs, asked, result = _conversations(spark, sf_dir).dropDuplicates(["node_id"]), _asked(spark, sf_dir), _answered(spark, sf_dir)
    lexical = stored(search.lexical_ranking(result.direct, docs.select("node_id"), asked, BUDGET), "lexical")
    return result, lexical, stored(search.graph_ranking(result, lexical, BUDGET), "graph")


def related_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph adds to each question's best turns, with its scores. PageRank runs to its end."""
    related = _answered(spark, sf_dir, None, LEAST).related
    return related.select("query_id", "rank", "node_id", _r("direct").alias("direct"), _r("relationship").alias("relationship"), _r("pagerank").alias("pagerank"), _r("pagerank_share").alias("pagerank_share"))


def retrieval_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings side by side; the graph's is cut to its anchors and related nodes, so it may be shorter."""
    result, lexical, _ = _retrieved(spark, sf_dir)
    return search.ranking_table(lexical, search.fill_ranking([result.anchors, result.related], BUDGET))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four metrics of both rankings. A question's best turn is its answer, the turns next to that support it."""
    _, lexical, expanded = _retrieved(spark, sf_dir)
    best = lexical.filter("rank = 1").select("query_id", "node_id")
    ends = _turn_edges(spark, sf_dir).select("source_id", "target_id")
    near = ends.union(ends.select("target_id", "source_id")).toDF("node_id", "other")
    supporting = best.join(near, "node_id").select("query_id", F.col("other").alias("node_id"), F.lit("supporting").alias("role"))
    judgments = best.withColumn("role", F.lit("answer")).unionByName(supporting)
    row = evaluation.compare_rankings(judgments, lexical, expanded)
    return row.select(*[_r(f"{side}_{m}").alias(f"{side}_{m}") for side in ("lexical", "graph", "delta") for m in evaluation.METRICS])


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle of each question: its best turns, what the graph adds, the paths to these and their edges."""
    turns = _conversations(spark, sf_dir).groupBy(F.col("node_id").alias("id")).agg(F.min("document").alias("source"))
    name, place = F.col("id").alias("name"), F.concat(F.lit("turns/"), F.col("id")).alias("path")
    nodes = turns.select("id", F.lit("turn").alias("kind"), name, name.alias("qualified_name"), F.lit("text").alias("language"), place, F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "source")
    edges = _turn_edges(spark, sf_dir).withColumn("evidence", F.array().cast("array<string>"))
    return bundles.query_bundles(nodes, edges, _answered(spark, sf_dir), _asked(spark, sf_dir), _CONFIG)


def query_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bundles in one job; their lists as text, and the least score of a path."""
    ids = lambda c: F.array_join(F.transform(c, lambda r: r["node"]["node_id"]), ",").alias(c)
    paths = F.array_join(F.transform("strongest_paths", lambda p: F.array_join(p["node_ids"], ">")), ",").alias("paths")
    used = F.array_join(F.transform("selected_edges", lambda e: e["edge_id"]), ",").alias("selected_edges")
    least = _r(F.array_min(F.transform("strongest_paths", lambda p: p["relationship_score"]))).alias("least")
    return _bundles(spark, sf_dir).select("query_id", ids("anchors"), ids("related_nodes"), paths, used, least)


def bundle_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found after a third of the bundles lost their first edge and a third had the score of their first path raised."""
    third = F.pmod(F.col("query_id"), F.lit(3))
    raised = lambda p, k: F.when(k == 0, p.withField("relationship_score", p["relationship_score"] + 0.5)).otherwise(p)
    edges = F.when(third == 0, F.expr("slice(selected_edges, 2, size(selected_edges) + 1)")).otherwise(F.col("selected_edges"))
    paths = F.when(third == 1, F.transform("strongest_paths", raised)).otherwise(F.col("strongest_paths"))
    damaged = _bundles(spark, sf_dir).withColumn("selected_edges", edges).withColumn("strongest_paths", paths)
    return bundles.bundle_faults(stored(damaged, "bundles"), _CONFIG)


# --- evaluation ---


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("node_id"), "n_chars")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("node_id"), "quality", "toxic")
    role = F.when(F.col("toxic") == 1, "supporting").when(F.col("quality") == 1, "answer")
    judgments = docs.join(labels, "node_id").select("query_id", "node_id", role.alias("role"), F.lit(1).alias("relevance")).filter("role is not null")
    rank = lambda *order: docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "node_id"))).filter("rank <= 20")
    return judgments, rank(F.desc("n_chars")), rank(F.asc("n_chars"))


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    judgments, lexical, _ = _judged(spark, sf_dir)
    return evaluation.evaluate_queries(judgments, lexical).select("query_id", F.col("answer_rank").cast("long").alias("answer_rank"), *[_r(m).alias(m) for m in evaluation.METRICS])


def rank_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.compare_queries(*_judged(spark, sf_dir))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("query_id", F.col("answer_rank_change").cast("long").alias("answer_rank_change"), joined("newly_retrieved"), joined("newly_missed"), "regression")


def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = evaluation.compare_rankings(*_judged(spark, sf_dir))
    return row.select(*[_r(f"delta_{m}").alias(f"delta_{m}") for m in evaluation.METRICS])


# --- strings ---


def credential_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").filter(predicates.contains_credential(F.col("text"))).select("doc_id")


def expand_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' sources with their identifiers expanded, as a digest and a length."""
    expanded = text.expand_identifiers(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(expanded.cast("binary")).alias("digest"), F.length(expanded).cast("long").alias("n_chars"))


def local_path_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the pages' URLs in several settings, white space before them included."""
    path = F.regexp_extract("url", r"^[^:]*://[^/]*(/[^?#]*)", 1)
    forms = [path, F.concat(F.lit("\t"), path), F.concat(F.lit("\n /data"), path), F.concat(F.lit("see /tmp"), path, F.lit(" for it")), F.concat(F.lit("C:/Users"), path), F.concat(F.lit("\u2003'/x"), path, F.lit("'")), F.concat(F.lit("src"), path), F.col("url")]
    value = F.element_at(F.array(*forms), (F.pmod(F.col("page_id"), F.lit(len(forms))) + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", predicates.looks_like_local_path(value).alias("is_local"))


def display_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values near halves of three digits; what they are in binary decides."""
    value = F.col("l_quantity") * 0.0005 + F.col("l_linenumber")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.display_round(value, 3).alias("rounded"))


def json_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string of a nested document per page that must not be published."""
    host, path = F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1), F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1)
    every = lambda n: F.pmod(F.col("page_id"), F.lit(n)) == 0
    place = F.when(every(3), F.concat(F.lit("\t/data"), path)).otherwise(F.concat(F.lit("src"), path)).alias("file")
    secret = F.struct(F.when(every(5), host).otherwise(F.lit("redacted")).alias("password"), F.col("page_id").alias("token"))
    note = F.when(every(7), F.concat(F.lit("see /tmp"), path)).otherwise(F.lit("nothing"))
    document = F.struct(F.struct(F.col("url"), F.struct(place).alias("from")).alias("page"), F.array(secret).alias("fields"), F.array(F.array(F.lit("fine"), note)).alias("notes"))
    return leaks.leaks(_table(spark, sf_dir, "pages").select("page_id", F.to_json(document).alias("value")), ["page_id"])


def sanitized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.sanitize_remote_url(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", clean.alias("clean"), text.repository_name(clean, F.lit("none")).alias("name"))


def snippet_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncate_source(F.col("text"), 80).alias("snippet"))


def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and relations of two literal sources, resolved."""
    from strandgraph.plans.build import graph_tables

    files = [("src/app/core.py", b"class Base:\n    pass\n\n\nclass Work(Base):\n    def run(self):\n        return helper()\n\n\ndef helper():\n    return Work().run()\n"), ("tests/test_core.py", b"from app.core import helper\n\n\ndef test_helper():\n    assert helper()\n")]
    nodes, edges, _, _ = graph_tables(spark.createDataFrame(files, "path string, content binary"), None)
    return edges.select("source_id", "target_id", "kind", "count", _r("strength").alias("strength"))


def method_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a module per supplier, in which self is used inside and outside a class."""
    from strandgraph.plans.build import graph_tables

    lines = ["def helper():", "    return 1", "", "", "class Box:", "    def helper(self):", "        return 2", "", "    def run(self):", "        return self.helper()", "", "", "def use(self):", "    return self.helper()", ""]
    key = F.col("s_suppkey").cast("string")
    files = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/m"), key, F.lit(".py")).alias("path"), F.lit("\n".join(lines)).cast("binary").alias("content"))
    edges = graph_tables(files, None)[1]
    return edges.select("source_id", "target_id", "kind", "count", _r("confidence").alias("confidence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        cochange_pairs, commit_totals, cochange_confidence, typed_edge_strength, edge_kind_summary, projection_noisy_or, overview_rollup, node_degrees, strongest_paths_2hop,
        related_pruned, path_steps, step_contributions, neighborhood_top8, induced_subgraph, strongest_pair_edge, pagerank_k, pagerank_push, word_ngram_df, char_wb_df, tfidf_top_k, tfidf_block_max,
        related_nodes, retrieval_rankings, retrieval_metrics, query_bundles, bundle_faults, graph_ranking_fill, rank_metrics, rank_comparison, metric_deltas, credential_documents, expand_identifiers, local_path_strings, display_rounding, json_leaks, sanitized_urls, snippet_truncate, python_symbols, method_calls,
    )
}
