"""Command line: ``index`` a repository, ``query`` a graph or a repository, ``message`` from a bundle, ``evaluate`` a benchmark.

What was asked for goes to standard output, everything else to standard error; 2 is returned
for an error that the caller can mend.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from strandgraph.config import GraphConfig, RetrievalConfig, full_commit, resolve_repository_root


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="strandgraph")
    commands = parser.add_subparsers(dest="command", required=True)
    index, query, message, evaluate = (commands.add_parser(name) for name in ("index", "query", "message", "evaluate"))
    for sub in (index, query, evaluate):
        for name, kind, value in (("--seed-count", int, 6), ("--hops", int, 2), ("--related-count", int, 25), ("--hop-decay", float, 0.85)):
            sub.add_argument(name, type=kind, default=value)
        sub.add_argument("--expected-commit", required=sub is evaluate)
    index.add_argument("--repo")
    index.add_argument("--out", required=True)
    index.add_argument("--mode", choices=("dev", "public", "demo"), default="dev")
    source = query.add_mutually_exclusive_group(required=True)
    source.add_argument("--graph")
    source.add_argument("--repo")
    query.add_argument("--query", required=True)
    query.add_argument("--format", choices=("json", "markdown"), default="json")
    query.add_argument("--include-source", action="append", default=[])
    message.add_argument("bundle")
    evaluate.add_argument("--repo")
    evaluate.add_argument("--benchmark", required=True)
    evaluate.add_argument("--out", required=True)
    evaluate.add_argument("--id", required=True)
    evaluate.add_argument("--format", choices=("json", "markdown"), default="json")
    return parser


def _index(arguments: argparse.Namespace, retrieval: RetrievalConfig, spark) -> str:
    from strandgraph.plans.build import build_knowledge_graph
    from strandgraph.sources.artifact import graph_json

    config = GraphConfig(resolve_repository_root(arguments.repo), arguments.mode, arguments.expected_commit, retrieval=retrieval)
    graph, out = build_knowledge_graph(spark, config), Path(arguments.out)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(graph_json(graph), encoding="utf-8")
    print(f"{graph.nodes.count()} nodes and {graph.edges.count()} edges at {graph.snapshot.commit_sha} in {out}", file=sys.stderr)
    return ""


def _query(arguments: argparse.Namespace, retrieval: RetrievalConfig, spark) -> str:
    from strandgraph.operators import bundle, search
    from strandgraph.plans.build import build_knowledge_graph, search_documents
    from strandgraph.sources.artifact import graph_from_json

    asked, commit = arguments.query.strip(), full_commit(arguments.expected_commit)
    if not asked:
        raise ValueError("the query is blank")
    if arguments.graph:
        graph = graph_from_json(spark, Path(arguments.graph).read_text(encoding="utf-8"))
        state = graph.snapshot
        if commit and (state.commit_sha != commit or state.dirty or state.shallow):
            raise ValueError(f"the graph is not of a clean, complete checkout of {commit}")
    else:
        config = GraphConfig(resolve_repository_root(arguments.repo), "public" if commit else "dev", commit, retrieval=retrieval)
        graph = build_knowledge_graph(spark, config)
    index = search.build_search_index(search_documents(graph.nodes))
    result = search.query_graph(index.nodes, graph.edges, index, spark.createDataFrame([(0, asked)], "query_id int, query string"), retrieval)
    document = bundle.build_bundle(graph.snapshot, graph.nodes, graph.edges, result, 0, asked, config=retrieval, include_source=bool(arguments.include_source), reviewed=arguments.include_source)
    return bundle.bundle_json(document) if arguments.format == "json" else bundle.bundle_markdown(document)


def _evaluate(arguments: argparse.Namespace, retrieval: RetrievalConfig, spark) -> str:
    from strandgraph.operators.evaluation import evaluation_json, evaluation_markdown
    from strandgraph.plans.judged import build_data

    document = build_data(
        spark, resolve_repository_root(arguments.repo), arguments.benchmark, Path(arguments.out), expected_commit=arguments.expected_commit, repository_id=arguments.id, retrieval=retrieval
    )
    return evaluation_json(document) if arguments.format == "json" else evaluation_markdown(document)


def run(arguments: argparse.Namespace, spark) -> str:
    """The payload for standard output."""
    if arguments.command == "message":
        from strandgraph.operators import bundle

        return bundle.agent_message(bundle.bundle_from_json(Path(arguments.bundle).read_text(encoding="utf-8")))
    retrieval = RetrievalConfig(arguments.seed_count, arguments.hops, arguments.related_count, arguments.hop_decay)
    return {"index": _index, "query": _query, "evaluate": _evaluate}[arguments.command](arguments, retrieval, spark)


def main(argv: list[str] | None = None, spark=None) -> int:
    arguments = _parser().parse_args(argv)
    try:
        if spark is None and arguments.command != "message":
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("strandgraph").getOrCreate()
        sys.stdout.write(run(arguments, spark))
    except (OSError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
