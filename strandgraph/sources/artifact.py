"""Stored graphs: Parquet tables as the native form, canonical JSON as the exchange form."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.config import GRAPH_SCHEMA_VERSION
from strandgraph.operators.relations import validate_graph
from strandgraph.plans.build import KnowledgeGraph
from strandgraph.sources.git import Snapshot
from strandgraph.sources.python_source import NODE

EDGE = "source_id string, target_id string, kind string, count long, confidence double, strength double, evidence array<string>"


def write_tables(graph: KnowledgeGraph, path: str) -> None:
    """Nodes and edges as Parquet, the snapshot as one JSON row beside them."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")
    graph.issues.write.mode("overwrite").parquet(f"{path}/issues")
    graph.resolution_counts.write.mode("overwrite").parquet(f"{path}/resolution_counts")
    graph.nodes.sparkSession.createDataFrame([(json.dumps(asdict(graph.snapshot)),)], "value string").write.mode("overwrite").text(f"{path}/snapshot")


def read_tables(spark: SparkSession, path: str) -> KnowledgeGraph:
    snapshot = Snapshot(**json.loads(spark.read.text(f"{path}/snapshot").first().value))
    if snapshot.graph_schema_version != GRAPH_SCHEMA_VERSION:
        raise ValueError(f"unknown graph schema version {snapshot.graph_schema_version}")
    edges = spark.read.parquet(f"{path}/edges").select(*[f.split()[0] for f in EDGE.split(", ")])
    graph = KnowledgeGraph(snapshot, spark.read.parquet(f"{path}/nodes"), edges, spark.read.parquet(f"{path}/issues"), spark.read.parquet(f"{path}/resolution_counts"))
    validate_graph(graph.nodes, graph.edges)
    return graph


def _lines(frame: DataFrame, *order: str) -> list[dict]:
    return [json.loads(r.j) for r in frame.orderBy(*order).select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]


def graph_json(graph: KnowledgeGraph) -> str:
    """Canonical JSON: sorted keys and rows, compact, no local path, one line end."""
    payload = {
        "schema_version": GRAPH_SCHEMA_VERSION, "snapshot": asdict(graph.snapshot), "nodes": _lines(graph.nodes, "id"),
        "edges": _lines(graph.edges, "source_id", "target_id", "kind", "evidence"), "issues": _lines(graph.issues, "path"),
        "resolution_counts": {r.outcome: r.n for r in graph.resolution_counts.collect()},
    }
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"


def graph_from_json(spark: SparkSession, content: str) -> KnowledgeGraph:
    try:
        payload = json.loads(content)
        if payload["schema_version"] != GRAPH_SCHEMA_VERSION:
            raise ValueError(f"unknown graph schema version {payload['schema_version']}")
        shape = lambda rows, schema: spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")
        graph = KnowledgeGraph(
            Snapshot(**payload["snapshot"]), shape(payload["nodes"], NODE), shape(payload["edges"], EDGE), shape(payload["issues"], "path string, message string"),
            spark.createDataFrame(list(payload["resolution_counts"].items()), "outcome string, n long"),
        )
    except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as error:
        raise ValueError(f"malformed graph: {error}") from error
    validate_graph(graph.nodes, graph.edges)
    return graph
