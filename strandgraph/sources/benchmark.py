"""Judged benchmarks: reading and checking the file that states questions and judgments."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strandgraph.config import BENCHMARK_SCHEMA_VERSION, BenchmarkError, full_commit
from strandgraph.operators.evaluation import validate_judgments

QUERIES = "query_id string, query string, ord int"
JUDGMENTS = "query_id string, node_id string, role string, relevance int, ord int"


@dataclass(frozen=True)
class Benchmark:
    """queries: query_id, query, ord; judgments: query_id, node_id, role, relevance, ord."""

    repository: dict[str, str]
    review_status: str
    queries: DataFrame
    judgments: DataFrame


def _text(record: Any, key: str, where: str) -> str:
    value = record.get(key) if isinstance(record, dict) else None
    if not isinstance(value, str) or not value.strip():
        raise BenchmarkError(f"{where}.{key} must be a text that is not blank")
    return value


def _items(record: Any, key: str, where: str) -> list:
    value = record.get(key) if isinstance(record, dict) else None
    if not isinstance(value, list) or not value:
        raise BenchmarkError(f"{where}.{key} must be a list that is not empty")
    return value


def parse_benchmark(spark: SparkSession, content: str, nodes: DataFrame | None = None) -> Benchmark:
    """The benchmark in ``content``; with ``nodes(node_id)`` every judged node must be one of them.

    A benchmark is written by hand, so the file is read on the driver; what it is compared
    with stays in tables.
    """
    try:
        root = json.loads(content)
    except json.JSONDecodeError as error:
        raise BenchmarkError(f"the benchmark is not JSON: {error}") from error
    if not isinstance(root, dict) or root.get("schema_version") != BENCHMARK_SCHEMA_VERSION:
        raise BenchmarkError(f"benchmark.schema_version must be {BENCHMARK_SCHEMA_VERSION}")
    about = {key: _text(root.get("repository"), key, "benchmark.repository") for key in ("name", "url", "commit")}
    try:
        exact = full_commit(about["commit"]) == about["commit"]
    except ValueError:
        exact = False
    if not exact:
        raise BenchmarkError("benchmark.repository.commit must be a full commit id in lower case")
    status = _text(root, "review_status", "benchmark")
    queries, judgments = [], []
    for k, question in enumerate(_items(root, "queries", "benchmark")):
        where = f"benchmark.queries[{k}]"
        query_id = _text(question, "id", where)
        if any(q[0] == query_id for q in queries):
            raise BenchmarkError(f"duplicate benchmark query id: {query_id}")
        queries.append((query_id, _text(question, "query", where), k))
        for j, judgment in enumerate(_items(question, "judgments", where)):
            at = f"{where}.judgments[{j}]"
            node_id, relevance = _text(judgment, "node_id", at), judgment.get("relevance")
            if type(relevance) is not int or not isinstance(judgment.get("role"), str):
                raise BenchmarkError(f"{at} needs a role and a whole relevance")
            judgments.append((query_id, node_id, judgment["role"], relevance, j))
    judged = spark.createDataFrame(judgments, JUDGMENTS)
    validate_judgments(judged, nodes)
    return Benchmark(about, status, spark.createDataFrame(queries, QUERIES), judged)


def load_benchmark(spark: SparkSession, path: str, nodes: DataFrame | None = None) -> Benchmark:
    return parse_benchmark(spark, spark.read.text(path, wholetext=True).first().value, nodes)
