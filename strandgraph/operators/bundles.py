"""The bundles of a whole table of queries as nested rows, built and checked by joins.

A bundle holds at most seed_count + related_count + path nodes and the parallel edges of its
steps, so a row is of bounded size; how many queries there are does not matter, and nothing
goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.config import BUNDLE_SCHEMA_VERSION, RetrievalConfig
from strandgraph.functions.text import edge_id, sanitize_bundle_url, strip, truncate_source
from strandgraph.operators.bundle import MAX_SNIPPET_CHARACTERS, MAX_SNIPPETS, TOLERANCE
from strandgraph.operators.graph import path_steps, step_contributions
from strandgraph.operators.search import QueryResult
from strandgraph.plans.lineage import stored
from strandgraph.sources.git import Snapshot

KEY, PARTS = "query_id", ("anchors", "related_nodes", "strongest_paths", "selected_edges", "source_snippets")
LARGEST = 1.7976931348623157e308


def _listed(rows: DataFrame, name: str, at: Column, value: Column) -> DataFrame:
    """A row per query with ``value`` of its rows as an array in the order of ``at``."""
    sorted_ = F.sort_array(F.collect_list(F.struct(at.alias("at"), value.alias("value"))))
    return rows.groupBy(KEY).agg(F.transform(sorted_, lambda x: x["value"]).alias(name))


def _location() -> Column:
    return F.struct("path", "start_line", "end_line").alias("location")


def _ranked(rows: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    about = nodes.select(F.col("id").alias("node_id"), "kind", "name", "qualified_name", "language", "path", "start_line", "end_line")
    node = F.struct("node_id", "kind", "name", "qualified_name", "language", _location()).alias("node")
    scores = [F.col(c).cast("double").alias(f"{label}_score") for c, label in (("direct", "direct"), ("relationship", "relationship"), ("pagerank", "pagerank"))]
    return _listed(rows.join(about, "node_id", "left"), name, F.col("rank"), F.struct(F.col("rank").cast("int").alias("rank"), node, *scores))


def query_bundles(
    nodes: DataFrame, edges: DataFrame, result: QueryResult, queries: DataFrame, config: RetrievalConfig, *, reviewed: DataFrame | None = None, max_characters: int = MAX_SNIPPET_CHARACTERS
) -> DataFrame:
    """``(query_id, query, anchors, related_nodes, strongest_paths, selected_edges, source_snippets)``, a row for each of ``queries``.

    nodes: id, kind, name, qualified_name, language, path, start_line, end_line, and source if there are
    ``reviewed(query_id, place, node_id)`` snippets. A query without any match has empty lists. The
    paths lead to the related nodes; inner nodes of theirs that are ranked nowhere follow the related nodes in the order in which
    the paths meet them.
    """
    keys = [KEY, "node_id"]
    chosen = result.related.select(KEY, "node_id", F.col("rank").alias("at"))
    paths = stored(result.paths.select(KEY, "node_id", "score", "path").join(chosen, keys), "paths")
    shown = result.anchors.select(*keys).unionByName(result.related.select(*keys))
    met = paths.select(KEY, "at", F.posexplode("path").alias("pos", "node_id")).groupBy(*keys).agg(F.min(F.struct("at", "pos")).alias("first"))
    inner = met.join(shown, keys, "left_anti")
    last = F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy(KEY).orderBy("first"))
    inner = inner.join(result.related.groupBy(KEY).agg(F.max("rank").alias("n")), KEY, "left").select(*keys, last.alias("rank"))
    score = lambda frame, name, value="score": frame.select(*keys, F.col(value).alias(name))
    for frame in (score(result.direct, "direct"), score(result.paths, "relationship"), score(result.ranks, "pagerank", "pagerank")):
        inner = inner.join(frame, keys, "left")
    shape = [*keys, "rank", "direct", "relationship", "pagerank"]
    related = result.related.select(*shape).unionByName(inner.fillna(0.0).select(*shape))

    steps = stored(path_steps(paths, result.pairs, keys), "steps")
    used = step_contributions(steps.drop("combined_strength", "kinds"), edges, keys).filter("kind is not null")
    used = stored(used.withColumn("edge_id", edge_id(F.col("source_id"), F.col("target_id"), F.col("kind"))), "used")
    order = F.when(F.col("traversal_direction") == "forward", 0).when(F.col("traversal_direction") == "reverse", 1).otherwise(2)
    link = F.struct(order.alias("order"), F.col("kind").alias("by"), F.struct("edge_id", "kind", "traversal_direction", "strength").alias("value"))
    links = used.groupBy(*keys, "step").agg(F.transform(F.sort_array(F.collect_list(link)), lambda x: x["value"]).alias("contributions"))
    joined = steps.join(links, [*keys, "step"], "left")
    none = F.array().cast(links.schema["contributions"].dataType)
    step = F.struct(F.col("from_id").alias("from_node_id"), F.col("to_id").alias("to_node_id"), "combined_strength", F.coalesce("contributions", none).alias("contributions"))
    walked = joined.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", step.alias("value")))), lambda x: x["value"]).alias("steps"))
    document = F.struct(F.col("path")[0].alias("source_id"), F.col("node_id").alias("target_id"), F.col("score").alias("relationship_score"), F.col("path").alias("node_ids"), "steps")
    ends = ["source_id", "target_id", "kind"]
    way = F.when(F.col("kind") == "CO_CHANGES", "undirected").otherwise("directed").alias("direction")
    selected = used.select(KEY, *ends, "edge_id").distinct().join(edges.select(*ends, "count", "strength", "confidence", "evidence"), ends)
    parts = [
        _ranked(result.anchors, nodes, "anchors"), _ranked(related, nodes, "related_nodes"), _listed(paths.join(walked, keys), "strongest_paths", F.col("at"), document),
        _listed(selected, "selected_edges", F.col("edge_id"), F.struct("edge_id", *ends, way, "count", "strength", "confidence", "evidence")),
    ]
    if reviewed is None:
        reviewed, nodes = queries.select(KEY, F.lit(0).alias("place"), F.lit(None).cast("string").alias("node_id")).filter("false"), nodes.withColumn("source", F.lit(None).cast("string"))
    texts = reviewed.join(nodes.withColumnRenamed("id", "node_id"), "node_id", "left")
    snippet = F.struct("node_id", _location(), truncate_source(strip(F.col("source")), max_characters).alias("text"), F.lit(True).alias("reviewed"))
    parts.append(_listed(texts, "source_snippets", F.col("place"), snippet))
    out = queries.select(KEY, "query")
    for name, part in zip(PARTS, parts, strict=True):
        out = out.join(part, KEY, "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def _number(value: Column, high: float = LARGEST) -> Column:
    return F.coalesce(value.between(0.0, high), F.lit(False))


def bundle_faults(bundles: DataFrame, config: RetrievalConfig) -> DataFrame:
    """``(query_id, fault, at)``: what does not hold in each bundle; no rows where all is in order.

    Ranks, places, scores and paths are checked inside a row; the score of each path is taken anew from its anchor and
    its steps, the strength of each step from its edges. The edges that steps use and those selected are compared by a full
    outer join. ``at`` names the path's target or the edge, else it is null. ``bundles`` is read several times.
    """
    known = F.transform(F.concat("anchors", "related_nodes"), lambda r: r["node"]["node_id"])
    gap = lambda c: F.exists(F.transform(c, lambda r, k: r["rank"] != k + 1), lambda x: x)

    def placed(r: Column) -> Column:
        at = r["node"]["location"]
        safe = (at["path"] != "") & ~at["path"].startswith("/") & ~F.array_contains(F.split(at["path"], "/"), "..") & ~F.substring(at["path"], 1, 2).contains(":")
        return F.coalesce(safe & (at["start_line"] >= 1) & (at["end_line"] >= at["start_line"]), F.lit(False))

    scored = lambda r: _number(r["direct_score"]) & _number(r["relationship_score"]) & _number(r["pagerank_score"])
    edge_ids = F.transform("selected_edges", lambda e: e["edge_id"])
    snippets = F.transform("source_snippets", lambda s: s["node_id"])
    held = F.forall("selected_edges", lambda e: F.coalesce(e["count"] >= 1, F.lit(False)) & _number(e["strength"], 1.0) & _number(e["confidence"], 1.0))
    whole = {
        "blank query": F.coalesce(strip(F.col("query")) != "", F.lit(False)),
        "node ranked twice": F.size(F.array_distinct(known)) == F.size(known),
        "ranks have gaps": ~gap(F.col("anchors")) & ~gap(F.col("related_nodes")),
        "unsafe path or line span": F.forall(F.concat("anchors", "related_nodes"), placed),
        "bad score": F.forall(F.concat("anchors", "related_nodes"), scored),
        "selected edges repeat or are out of order": edge_ids == F.array_sort(F.array_distinct(edge_ids)),
        "bad edge": held,
        "bad snippet": (F.size(F.array_distinct(snippets)) == F.size(snippets)) & (F.size(snippets) <= MAX_SNIPPETS) & (F.size(F.array_except(snippets, known)) == 0) & F.forall("source_snippets", lambda s: F.coalesce(s["reviewed"], F.lit(False))),
    }
    named = lambda checks: F.explode(F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(what)) for what, ok in checks.items()]), lambda x: x.isNotNull()))
    faults = bundles.select(KEY, named(whole).alias("fault"), F.lit(None).cast("string").alias("at"))

    greatest = F.array_max(F.transform("anchors", lambda a: a["direct_score"]))
    top = F.when(greatest > 0, greatest).otherwise(F.lit(1.0))
    rows = bundles.select(KEY, "anchors", known.alias("known"), top.alias("top"), F.explode("strongest_paths").alias("p"))
    start = F.get(F.filter("anchors", lambda a: a["node"]["node_id"] == F.col("p.source_id")), F.lit(0))["direct_score"] / F.col("top")
    follows = F.transform("p.steps", lambda s, k: (s["from_node_id"] == F.get("p.node_ids", k)) & (s["to_node_id"] == F.get("p.node_ids", k + 1)))
    combined = lambda s: 1.0 - F.aggregate(s["contributions"], F.lit(1.0), lambda miss, c: miss * (1.0 - c["strength"]))
    score = F.aggregate("p.steps", start, lambda total, s: total * config.hop_decay * s["combined_strength"])
    each = lambda test: F.forall("p.steps", lambda s: F.coalesce(test(s), F.lit(False)))
    along = {
        "path ends are not ranked": (F.size(F.array_except("p.node_ids", "known")) == 0) & start.isNotNull() & (F.get("p.node_ids", F.lit(0)) == F.col("p.source_id")) & (F.element_at("p.node_ids", -1) == F.col("p.target_id")),
        "steps do not follow the path": (F.size("p.steps") == F.size("p.node_ids") - 1) & (F.size("p.steps") >= 1) & F.forall(follows, lambda x: F.coalesce(x, F.lit(False))),
        "step without edges or with one twice": each(lambda s: (F.size(s["contributions"]) > 0) & (F.size(F.array_distinct(F.transform(s["contributions"], lambda c: c["edge_id"]))) == F.size(s["contributions"]))),
        "combined strength does not follow": each(lambda s: F.abs(s["combined_strength"] - combined(s)) <= TOLERANCE),
        "path score does not follow": F.abs(score - F.col("p.relationship_score")) <= TOLERANCE,
    }
    faults = faults.unionByName(rows.select(KEY, named(along).alias("fault"), F.col("p.target_id").alias("at")))

    hops = bundles.select(KEY, F.explode("strongest_paths").alias("p")).select(KEY, F.explode("p.steps").alias("s")).select(KEY, "s.from_node_id", "s.to_node_id", F.explode("s.contributions").alias("c"))
    used = hops.select(KEY, F.col("c.edge_id").alias("edge_id"), "from_node_id", "to_node_id", "c").distinct()
    chosen = bundles.select(KEY, F.explode("selected_edges").alias("e")).select(KEY, F.col("e.edge_id").alias("edge_id"), "e")
    forward = (F.col("e.source_id") == F.col("from_node_id")) & (F.col("e.target_id") == F.col("to_node_id"))
    reverse = (F.col("e.source_id") == F.col("to_node_id")) & (F.col("e.target_id") == F.col("from_node_id"))
    way = F.when(~forward & ~reverse, "none").when(F.col("e.kind") == "CO_CHANGES", "undirected").when(forward, "forward").otherwise("reverse")
    same = F.col("c.kind").eqNullSafe(F.col("e.kind")) & F.col("c.strength").eqNullSafe(F.col("e.strength"))
    what = (
        F.when(F.col("e").isNull(), "used edge is not selected").when(F.col("c").isNull(), "selected edge is not used").when(~same, "contribution differs from its edge")
        .when(~F.col("c.traversal_direction").eqNullSafe(way), "wrong direction")
    )
    compared = used.join(chosen, [KEY, "edge_id"], "full").select(KEY, what.alias("fault"), F.col("edge_id").alias("at")).filter("fault is not null").distinct()
    return faults.unionByName(compared)


def bundle_documents(bundles: DataFrame, snapshot: Snapshot, config: RetrievalConfig) -> DataFrame:
    """``(query_id, document)``: each bundle as JSON, the repository and the settings included."""
    plain = {"name": snapshot.name, "commit_sha": snapshot.commit_sha, "tree_sha": snapshot.tree_sha, "branch": snapshot.branch, "detached": snapshot.detached, "clean": not snapshot.dirty}
    plain |= {k: getattr(snapshot, k) for k in ("shallow", "indexed_source_sha256", "graph_schema_version", "extractor_version")}
    repository = F.struct(sanitize_bundle_url(F.lit(snapshot.remote_url).cast("string")).alias("remote_url"), *[F.lit(v).alias(k) for k, v in plain.items()])
    retrieval = F.struct(*[F.lit(getattr(config, k)).alias(k) for k in ("seed_count", "hops", "related_count", "hop_decay")])
    whole = F.struct(F.lit(BUNDLE_SCHEMA_VERSION).alias("schema_version"), "query", repository.alias("repository"), retrieval.alias("retrieval"), *PARTS)
    return bundles.select(KEY, F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))
