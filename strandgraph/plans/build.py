"""Repository to validated graph tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.config import GraphConfig
from strandgraph.functions.text import display_round, location, node_document
from strandgraph.operators import relations
from strandgraph.operators.graph import format_paths
from strandgraph.plans.lineage import stored
from strandgraph.sources import git
from strandgraph.sources.python_source import extract

#: The fields of a node that its search document names, in this order.
IDENTITY = ["kind", "path", "module", "language", "qualified_name", "signature", "docstring"]


@dataclass(frozen=True)
class KnowledgeGraph:
    snapshot: git.Snapshot
    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame
    resolution_counts: DataFrame


def graph_tables(files: DataFrame, log: DataFrame | None, *, minimum_support: int = 2, maximum_files: int = 20) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(nodes, edges, issues, resolution counts)`` of ``files(path, content)`` and ``log(commit_id, path)``."""
    nodes, found, bindings, issues = extract(files)
    nodes = stored(relations.with_file_order(nodes, "at").drop("at"))
    pending = found.filter("not resolved")
    fixed = found.filter("resolved").select("source_id", F.col("target_text").alias("target_id"), "kind", "count", "confidence", "evidence")
    resolved, counts = relations.resolve_relations(nodes, pending, bindings)
    every = fixed.unionByName(resolved)
    if log is not None:
        known = log.join(nodes.filter("kind = 'file'").select("path"), "path", "left_semi")
        pairs = relations.cochange_relations(known, minimum_support=minimum_support, maximum_files=maximum_files)
        named = [F.concat(F.lit("file:"), c).alias(c) for c in ("source_id", "target_id")]
        every = every.unionByName(pairs.select(*named, "kind", "count", "confidence", "evidence"))
    edges = stored(relations.aggregate_relations(every))
    return nodes.drop("ord"), edges, issues, counts


def build_knowledge_graph(spark: SparkSession, config: GraphConfig) -> KnowledgeGraph:
    """Read, parse, resolve, aggregate and validate; fails if the repository changes meanwhile."""
    root = config.repository
    paths = git.discover(root)
    before = git.snapshot(spark, root, paths, public=config.is_public, expected_commit=config.expected_commit, retrieval=config.retrieval)
    tables = graph_tables(git.read_files(spark, root, paths), git.read_log(spark, root), minimum_support=config.cochange_minimum_support, maximum_files=config.cochange_maximum_files)
    git.verify_snapshot(spark, root, before)
    relations.validate_graph(tables[0], tables[1])
    return KnowledgeGraph(before, *tables)


def search_documents(nodes: DataFrame) -> DataFrame:
    """``(node_id, document)`` for the text index."""
    return nodes.select(F.col("id").alias("node_id"), node_document({c: F.col(c) for c in IDENTITY}, F.col("source")).alias("document"))


def result_tables(graph: KnowledgeGraph, result) -> tuple[DataFrame, DataFrame]:
    """Anchors and related nodes of a query result as they are shown: names, places, rounded scores, paths in words."""
    about = graph.nodes.select(F.col("id").alias("node_id"), F.col("qualified_name").alias("node"), "kind", location(F.col("path"), F.col("start_line")).alias("location"))
    names = about.select("node_id", F.col("node").alias("name"))
    shown = lambda name, alias: display_round(F.col(name), 4).alias(alias)
    anchors = result.anchors.join(about, "node_id").select("query_id", "rank", "node_id", "node", "kind", "location", shown("direct", "direct_relevance"))
    keys = ["query_id", "node_id"]
    paths = result.paths.join(result.related.select(*keys), keys, "left_semi")
    words = format_paths(paths, result.pairs, graph.edges, names, keys).withColumnRenamed("text", "strongest_path")
    related = result.related.join(about, "node_id").join(words, keys).select(
        "query_id", "rank", "node_id", "node", "kind", "location", shown("relationship", "relationship_strength"), shown("pagerank_share", "pagerank"),
        shown("direct", "direct_relevance"), "strongest_path",
    )
    return anchors, related
