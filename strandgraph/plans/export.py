"""Documents for publication: what a graph, a query and an evaluation show, without layout.

The rows come from joins and aggregates; the documents hold the files of one repository or
what one query selected, and are put together on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.config import WEB_DATA_SCHEMA_VERSION, PublicExportError
from strandgraph.functions import predicates, text
from strandgraph.operators import graph as graph_operators
from strandgraph.operators import relations
from strandgraph.operators.search import QueryResult
from strandgraph.plans.build import KnowledgeGraph
from strandgraph.sources.git import Snapshot

# Colours of node kinds and of anchors.
NODE_COLORS = {"file": "#64748b", "class": "#a78bfa", "method": "#60a5fa", "function": "#34d399", "test": "#f472b6", "fixture": "#facc15"}
OTHER_COLOR, ANCHOR_COLOR, TOP_ANCHOR_COLOR = "#38bdf8", "#f59e0b", "#fb7185"
INSPECTED = ["id", "label", "group", "color", "size", "tooltip", "qualified_name", "kind", "path", "start_line", "end_line", "signature", "docstring"]


# --- what must not be published ---


def strings(value: Any, name: str | None = None) -> Iterator[tuple[str | None, str]]:
    """``(field, string)`` of every string in a nested value; a list's strings have no field of their own."""
    if isinstance(value, str):
        yield name, value
    elif isinstance(value, dict):
        for key, child in value.items():
            yield from strings(child, key if isinstance(key, str) else None)
    elif isinstance(value, (list, tuple)):
        for child in value:
            yield from strings(child)


def problems(found: DataFrame) -> DataFrame:
    """The rows of ``found(field, value)`` that must not be published, with ``problem``."""
    return found.withColumn("problem", predicates.public_problem(F.col("field"), F.col("value"))).filter("problem is not null")


def validate_public(spark: SparkSession, payload: Any) -> None:
    """Raise if a string of the payload is a local path, a credential or an unsafe node path."""
    found = spark.createDataFrame(list(strings(payload)), "field string, value string")
    for row in problems(found).limit(1).collect():
        shown = "" if row.problem in ("credential", "secret field") else f": {row.value}"
        raise PublicExportError(f"public export contains a {row.problem}{shown}")


def verify_publishable(snapshot: Snapshot, expected_commit: str | None = None) -> None:
    """Raise unless the snapshot is clean, complete and, if one is expected, of that commit."""
    if snapshot.dirty:
        raise PublicExportError("public export needs a clean repository")
    if snapshot.shallow:
        raise PublicExportError("public export needs the whole history")
    if expected_commit is not None and snapshot.commit_sha != expected_commit:
        raise PublicExportError(f"public export is of {snapshot.commit_sha} and not of {expected_commit}")


# --- elements ---


def node_tooltip() -> Column:
    title = F.when(F.col("signature") != "", F.col("signature")).otherwise(F.col("qualified_name"))
    place = text.location(F.col("path"), F.col("start_line"))
    lines = [F.concat(F.lit("<b>"), text.html_escape(title), F.lit("</b>")), text.html_escape(place), F.concat(F.lit("kind: "), text.html_escape(F.col("kind")))]
    return F.concat_ws("<br>", *lines, text.html_escape(F.substring("docstring", 1, 500)))


def _edge_rows(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``edges(source_id, target_id, kind, strength)`` with a tooltip; names: node_id, name."""
    a, b = names.toDF("source_id", "source_name"), names.toDF("target_id", "target_name")
    arrow = F.when(F.col("kind") == "CO_CHANGES", " -- ").otherwise(" -> ")
    both = F.concat(text.html_escape(F.col("source_name")), arrow, text.html_escape(F.col("target_name")))
    strength = F.format_string("strength: %.3f", text.display_round(F.col("strength"), 3))
    tip = F.concat_ws("<br>", F.concat(F.lit("<b>"), F.col("kind"), F.lit("</b>")), both, strength)
    return edges.join(a, "source_id").join(b, "target_id").withColumn("tooltip", tip)


def overview_elements(graph: KnowledgeGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the repository seen file by file."""
    files = graph.nodes.filter("kind = 'file'")
    home = graph.nodes.select(F.col("id"), "path").join(files.select("path", F.col("id").alias("group")), "path").select("id", "group")
    rolled = graph_operators.overview(graph.edges, home).withColumnsRenamed({"source_group": "source_id", "target_group": "target_id"})
    ends = rolled.select(F.col("source_id").alias("id")).union(rolled.select("target_id")).groupBy("id").agg(F.count("*").alias("degree"))
    nodes = files.join(ends, "id", "left").select(
        "*", F.col("path").alias("label"), F.lit("file").alias("group"), F.lit(NODE_COLORS["file"]).alias("color"),
        text.overview_node_size(F.coalesce("degree", F.lit(0))).alias("size"), node_tooltip().alias("tooltip"),
    )
    edges = _edge_rows(rolled.drop("n"), files.select(F.col("id").alias("node_id"), F.col("path").alias("name")))
    return nodes.select(*INSPECTED), edges.select("source_id", "target_id", "kind", "strength", "tooltip")


def query_elements(graph: KnowledgeGraph, result: QueryResult, query_id: Any) -> tuple[DataFrame, DataFrame]:
    """Nodes and strongest edges among what one query found: anchors, related nodes and those on their paths."""
    own = lambda frame: frame.filter(F.col("query_id") == query_id)
    anchors, related = own(result.anchors), own(result.related)
    paths = own(result.paths).join(related.select("node_id"), "node_id", "left_semi")
    chosen = anchors.select("node_id").union(related.select("node_id")).union(paths.select(F.explode("path"))).distinct()
    at = anchors.select("node_id", F.col("rank").alias("anchor"))
    direct = own(result.direct).select("node_id", F.col("score").alias("direct_relevance"))
    near = own(result.paths).select("node_id", F.col("score").alias("relationship_strength"))
    rows = chosen.join(at, "node_id", "left").join(direct, "node_id", "left").join(near, "node_id", "left").fillna(0.0, ["direct_relevance", "relationship_strength"])
    rows = rows.join(graph.nodes.withColumnRenamed("id", "node_id"), "node_id")
    kinds = F.create_map(*[F.lit(x) for item in NODE_COLORS.items() for x in item])
    group = F.when(F.col("anchor") == 1, "top anchor").when(F.col("anchor").isNotNull(), "anchor").otherwise(F.col("kind"))
    color = F.when(F.col("anchor") == 1, TOP_ANCHOR_COLOR).when(F.col("anchor").isNotNull(), ANCHOR_COLOR).otherwise(F.coalesce(kinds[F.col("kind")], F.lit(OTHER_COLOR)))
    score = lambda label, name: F.format_string(f"{label}: %.4f", text.display_round(F.col(name), 4))
    tip = F.concat_ws("<br>", node_tooltip(), score("direct relevance", "direct_relevance"), score("relationship strength", "relationship_strength"))
    nodes = rows.select(
        "*", F.col("node_id").alias("id"), F.col("qualified_name").alias("label"), group.alias("group"), color.alias("color"),
        text.node_size(F.col("direct_relevance"), F.col("relationship_strength")).alias("size"), tip.alias("tooltip"),
    )
    names = graph.nodes.select(F.col("id").alias("node_id"), F.col("qualified_name").alias("name"))
    inside = graph_operators.strongest_edges(graph_operators.induced_subgraph(graph.edges, chosen)).filter("source_id <> target_id")
    edges = _edge_rows(inside, names)
    more = F.concat_ws("<br>", "tooltip", F.format_string("confidence: %.3f", text.display_round(F.col("confidence"), 3)), F.concat(F.lit("evidence count: "), F.col("count").cast("string")))
    evidence = F.concat_ws("<br>", F.transform("evidence", text.html_escape))
    edges = edges.withColumn("tooltip", F.concat_ws("<br>", more, evidence))
    return nodes.select(*INSPECTED, "direct_relevance", "relationship_strength"), edges.select("source_id", "target_id", "kind", "strength", "tooltip")


def inspection(nodes: DataFrame, edges: DataFrame) -> dict:
    """The elements as lists of records, checked."""
    scores = [c for c in ("direct_relevance", "relationship_strength") if c in nodes.columns]
    rows = [{c: r[c] for c in INSPECTED} | {c: r[c] if c in scores else None for c in ("direct_relevance", "relationship_strength")} for r in nodes.orderBy("id").collect()]
    links = [r.asDict() for r in edges.orderBy("source_id", "target_id", "kind").collect()]
    found = {"nodes": rows, "edges": links}
    validate_inspection(found)
    return found


def validate_inspection(found: Any) -> None:
    """Raise unless the nodes have distinct ids and every edge a finite strength and two of the nodes as ends."""
    if not isinstance(found, dict) or not isinstance(found.get("nodes"), list) or not isinstance(found.get("edges"), list):
        raise PublicExportError("there is no inspection data")
    ids = [n.get("id") if isinstance(n, dict) else None for n in found["nodes"]]
    if not ids or not all(isinstance(i, str) and i for i in ids) or len(set(ids)) != len(ids):
        raise PublicExportError("inspection nodes must be some and have distinct ids")
    known = set(ids)
    for edge in found["edges"]:
        strength = edge.get("strength") if isinstance(edge, dict) else None
        if isinstance(strength, bool) or not isinstance(strength, (int, float)) or strength != strength or abs(strength) == float("inf") or not isinstance(edge.get("kind"), str):
            raise PublicExportError("inspection edge without a kind and a finite strength")
        if edge.get("source_id") not in known or edge.get("target_id") not in known:
            raise PublicExportError("inspection edge with an end that is no node")


# --- documents ---


def provenance(snapshot: Snapshot) -> dict:
    return {
        "repository": snapshot.name, "commit": snapshot.commit_sha, "tree": snapshot.tree_sha, "branch": snapshot.branch, "detached": snapshot.detached,
        "clean": not snapshot.dirty, "shallow": snapshot.shallow, "schema_version": snapshot.graph_schema_version, "extractor_version": snapshot.extractor_version,
        "indexed_source_sha256": snapshot.indexed_source_sha256, "retrieval": snapshot.retrieval,
    }


def _checked(graph: KnowledgeGraph, payload: dict) -> dict:
    payload = {"schema_version": WEB_DATA_SCHEMA_VERSION, "provenance": provenance(graph.snapshot), **payload}
    validate_public(graph.nodes.sparkSession, payload)
    return payload


def repository_payload(graph: KnowledgeGraph, repository_id: str) -> dict:
    verify_publishable(graph.snapshot)
    node_kinds = {r.kind: r.nodes for r in relations.node_summary(graph.nodes).orderBy("kind").collect()}
    edge_kinds = {r.kind: r.edges for r in relations.edge_summary(graph.edges).orderBy("kind").collect()}
    outcomes = {r.outcome: r.n for r in graph.resolution_counts.orderBy("outcome").collect()}
    summary = {"node_count": sum(node_kinds.values()), "edge_count": sum(edge_kinds.values()), "issue_count": graph.issues.count(), "resolution_counts": outcomes}
    shown = {"id": repository_id, "name": graph.snapshot.name, "commit": graph.snapshot.commit_sha, "summary": summary, "counts": {"nodes": node_kinds, "edges": edge_kinds}}
    return _checked(graph, {**shown, "inspection": inspection(*overview_elements(graph))})


def query_payload(graph: KnowledgeGraph, result: QueryResult, query_id: str, query: str, *, label: str, description: str) -> dict:
    verify_publishable(graph.snapshot)
    shown = {"id": query_id, "label": label, "query": query, "description": description}
    return _checked(graph, {**shown, "inspection": inspection(*query_elements(graph, result, query_id))})


def evaluation_payload(graph: KnowledgeGraph, document: dict) -> dict:
    """The evaluation with where each ranked node stands; ``document`` as of ``evaluation_document``."""
    names = sorted({n for s in ("lexical", "graph_expanded") for q in document[s]["queries"] for n in q["ranking"]})
    wanted = graph.nodes.sparkSession.createDataFrame([(n,) for n in names], "id string")
    about = {r.id: r for r in graph.nodes.join(F.broadcast(wanted), "id").select("id", "qualified_name", "kind", "path", "start_line", "end_line").collect()}
    if set(names) - set(about):
        raise PublicExportError(f"ranked nodes that are not in the graph: {sorted(set(names) - set(about))}")
    metrics = ["answer_mrr_at_10", "recall_at_10", "recall_at_20", "supporting_recall_at_10"]

    def strategy(query: dict) -> dict:
        judged = {j["node_id"]: j for j in query["judgments"]}
        answers = [j["rank"] for j in query["judgments"] if j["role"] == "answer" and j["rank"] is not None]
        rows = []
        for rank, node_id in enumerate(query["ranking"], 1):
            place = {c: about[node_id][c] for c in ("qualified_name", "kind", "path", "start_line", "end_line")}
            judgment = judged.get(node_id, {})
            rows.append({"rank": rank, "node_id": node_id, **place, "judgment_role": judgment.get("role"), "relevance": judgment.get("relevance")})
        scores = {m: query[m] for m in ("reciprocal_answer_rank_at_10", *metrics[1:])}
        return {"answer_rank": min(answers, default=None), **scores, "ranking": rows}

    aggregate = {s: {m: document[s][m] for m in metrics} for s in ("lexical", "graph_expanded")}
    delta = {m: aggregate["graph_expanded"][m] - aggregate["lexical"][m] for m in metrics}
    rows = []
    for lexical, expanded, change in zip(document["lexical"]["queries"], document["graph_expanded"]["queries"], document["queries"], strict=True):
        if not lexical["id"] == expanded["id"] == change["id"]:
            raise PublicExportError("the queries of the two strategies are not aligned")
        compared = {k: v for k, v in change.items() if k != "id"}
        rows.append({"id": lexical["id"], "query": lexical["query"], "lexical": strategy(lexical), "graph_expanded": strategy(expanded), "comparison": compared})
    shown = {k: document[k] for k in ("repository", "ranking_budget", "metric_definition")}
    return _checked(graph, {**shown, "aggregate": {**aggregate, "delta": delta, "conclusion": document["conclusion"]}, "queries": rows})


def manifest_payload(graph: KnowledgeGraph, entries: list[dict], repository_id: str, repository_label: str) -> dict:
    listed = [{"id": repository_id, "label": repository_label, "file": "repository.json"}]
    return _checked(graph, {"repositories": listed, "queries": entries, "evaluation": "evaluation.json"})
