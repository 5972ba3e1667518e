"""Graph operators on edge tables: projection, strongest paths, PageRank, roll-up, neighbourhoods."""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.text import display_round
from strandgraph.operators.relations import pair_columns, strongest_of_pairs, strongest_per_neighbour
from strandgraph.operators.skew import hot_keys, spread_join
from strandgraph.plans.lineage import bucketed, dealt, discard, drop, shares_of, stored


def noisy_or(strength: Column) -> Column:
    """1 - product of (1 - strength): that one of independent links holds."""
    return 1 - F.product(1 - strength)


#: Rows of a side that is small whatever the other is: such a side is broadcast, a larger one is shuffled.
FEW = 100_000


def _by_pair(edges: DataFrame) -> DataFrame:
    return edges if "u" in edges.columns else dealt(pair_columns(edges), edges.count(), "u", "v")


def projection(edges: DataFrame) -> DataFrame:
    """Undirected weighted pairs ``(u, v, weight, kinds, first_source, first_target, first_kind)``, u < v.

    The first edge of a pair in edge order fixes the pair's place among a node's neighbours. ``edges`` should come from a stored
    table: they are counted, to deal them to tasks of bounded size, unless they lie by pair.
    """
    edges = _by_pair(edges).filter("u <> v")
    names = sorted(r[0] for r in edges.select("kind").distinct().collect() if r[0] is not None)
    # kinds, which are few, by their place in order: sums, least numbers and bits are gathered by hashing, strings would have all edges sorted
    listed, base = F.array(*[F.lit(n) for n in names]).cast("array<string>"), len(names) + 1
    code = F.coalesce(F.array_position(listed, F.col("kind")), F.lit(0)).cast("int")
    coded = edges.withColumn("_code", code)
    first = F.min(F.when(F.col("source_id") == F.col("u"), F.col("_code")).otherwise(F.col("_code") + base)).alias("_first")
    bits = F.bit_or(F.expr("if(_code > 0, shiftleft(1L, _code - 1), 0L)"))
    masked = base < 62
    kinds = bits if masked else F.array_sort(F.collect_set("kind"))
    pairs = coded.groupBy("u", "v").agg(noisy_or(F.col("strength")).alias("weight"), kinds.alias("kinds"), first)
    if masked:
        chosen = [F.when(F.col("kinds").bitwiseAND(F.lit(1 << k)) != 0, F.lit(n)) for k, n in enumerate(names)]
        pairs = pairs.withColumn("kinds", F.array_compact(F.array(*chosen).cast("array<string>")))
    ahead, place = F.col("_first") < base, F.col("_first") % base
    ends = [F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(f"first_{end}") for a, b, end in (("u", "v", "source"), ("v", "u", "target"))]
    return pairs.select("u", "v", "weight", "kinds", *ends, F.when(place > 0, F.get(listed, place - 1)).alias("first_kind"))


def adjacency(pairs: DataFrame) -> DataFrame:
    """``(node, neighbour, weight, place)`` in both directions.

    ``place`` orders a node's neighbours by the first edge to each. It is that edge's key and
    not a row number, so a hub's neighbours need not be sorted in one task.
    """
    place = F.struct("first_source", "first_target", "first_kind").alias("place")
    both = pairs.select(F.col("u").alias("node"), F.col("v").alias("neighbour"), "weight", place)
    return both.union(pairs.select(F.col("v"), F.col("u"), "weight", place))


def strongest_paths(pairs: DataFrame, seeds: DataFrame, *, hops: int = 2, hop_decay: float = 0.85, exhaustive: bool = True, keys: list[str] | None = None, few: int = FEW) -> DataFrame:
    """``(keys..., node_id, score, depth, path)``: the best multiplicative path from any seed to each node.

    seeds: keys..., node_id, seed_score, seed_rank. Scores start at seed_score / max and each
    hop multiplies by the decay and the pair's weight; paths are simple. Ties go to fewer
    hops, then to the order of seeds and neighbours.

    Of the candidates that reach a node from one seed in one number of hops only the best
    goes on, so the frontier stays within seeds x nodes. That loses nothing: a better
    candidate that cannot be extended to some node has that node on its path, and so has
    reached it before with a higher score. A frontier of at most ``few`` rows is broadcast to the pairs, which do
    not move then; for a larger one the neighbours are stored, those of a hub are dealt to several tasks and
    its frontier rows are copied to each. Without ``exhaustive`` the best candidate of all
    seeds goes on alone, which is the same for all nodes but the seeds. ``pairs`` should come from a stored table: each hop reads them.
    """
    if isinstance(hops, bool) or hops < 1 or not 0 < hop_decay <= 1:
        raise ValueError("hops must be positive and hop_decay in (0, 1]")
    keys = keys or []
    adj, hubs = adjacency(pairs), None
    top = seeds.groupBy(*keys).agg(F.max("seed_score").alias("top"))
    start = seeds.join(top, keys) if keys else seeds.crossJoin(F.broadcast(top))  # one row
    no_place = F.array().cast("array<struct<first_source: string, first_target: string, first_kind: string>>")
    frontier = start.select(
        *keys, F.col("node_id").alias("origin"), F.col("seed_rank").cast("int").alias("seed_rank"), F.col("node_id").alias("cur"),
        (F.col("seed_score") / F.when(F.col("top") == 0, F.lit(1.0)).otherwise(F.col("top"))).alias("score"), F.array("node_id").alias("path"), no_place.alias("places"),
    )
    rank = F.struct((-F.col("score")).alias("s"), F.size("path").alias("d"), F.col("seed_rank").alias("r"), F.col("places").alias("p"))
    group = [*keys, "origin", "cur"] if exhaustive else [*keys, "cur"]
    rest = [c for c in ("origin", "seed_rank", "score", "path", "places") if c not in group]
    found = None
    for _ in range(hops):
        frontier = stored(frontier, "frontier")
        if frontier.count() <= few:
            met = adj.join(F.broadcast(frontier.withColumnRenamed("cur", "node")), "node")
        else:
            if hubs is None:
                adj = stored(adj, "adjacency")
                hubs = hot_keys(adj, ["node"])
            met = spread_join(adj, frontier.withColumnRenamed("cur", "node"), ["node"], "neighbour", found=hubs)
        frontier = (
            met.filter(~F.array_contains("path", F.col("neighbour")))
            .select(
                *keys, "origin", "seed_rank", F.col("neighbour").alias("cur"), (F.col("score") * hop_decay * F.col("weight")).alias("score"),
                F.concat("path", F.array("neighbour")).alias("path"), F.concat("places", F.array("place")).alias("places"),
            )
            .filter("score > 0")
        )
        frontier = frontier.groupBy(*group).agg(F.min_by(F.struct(*rest), rank).alias("b")).select(*group, "b.*")
        frontier = frontier.select(*keys, "origin", "seed_rank", "cur", "score", "path", "places")
        found = frontier if found is None else found.unionByName(frontier)
    best = found.groupBy(*keys, F.col("cur").alias("node_id")).agg(F.min_by(F.struct("score", "path"), rank).alias("b"))
    return best.select(*keys, "node_id", F.col("b.score").alias("score"), (F.size("b.path") - 1).alias("depth"), F.col("b.path").alias("path"))


def edge_steps(steps: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., step, from_id, to_id, text)``: each step as its strongest edge in words.

    The arrow says in which direction the step crosses the edge and has none for a co-change;
    of equally strong edges the last text stands, ``--`` where there is no edge.
    """
    rows = step_contributions(steps, edges, keys)
    name = F.format_string("[%s %.2f]", F.col("kind"), display_round(F.col("strength"), 2))
    way = F.col("traversal_direction")
    text = F.concat(F.when(way == "reverse", "<-").otherwise("-"), name, F.when(way == "forward", "->").otherwise("-"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct(F.col("strength"), text.alias("text")))).alias("best")
    grouped = rows.groupBy(*keys, "step", "from_id", "to_id").agg(best)
    return grouped.select(*keys, "step", "from_id", "to_id", F.coalesce("best.text", F.lit("--")).alias("text"))


def format_paths(paths: DataFrame, pairs: DataFrame, edges: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., text)``: the names on each path with its steps between them. names: node_id, name."""
    steps = edge_steps(path_steps(paths, pairs, keys).drop("combined_strength", "kinds"), edges, keys)
    to = names.select(F.col("node_id").alias("to_id"), F.col("name").alias("to_name"))
    first = paths.select(*keys, F.col("path")[0].alias("from_id")).join(names.toDF("from_id", "start"), "from_id").select(*keys, "start")
    parts = steps.join(to, "to_id").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", F.concat_ws(" ", "text", "to_name").alias("part")))).alias("parts"))
    return first.join(parts, keys, "left").select(*keys, F.concat_ws(" ", F.col("start"), F.col("parts.part")).alias("text"))


def _seek(steps: DataFrame, table: DataFrame) -> DataFrame:
    """``steps(u, v, ...)`` joined on the left with the rows of ``table`` for their pairs.

    Each pair is looked up once, however many steps cross it, by a hash of the pairs sought in a task: ``table``
    is read where it lies and neither moved nor sorted.
    """
    sought = steps.select("u", "v").distinct().hint("shuffle_hash")
    return steps.join(table.join(sought, ["u", "v"], "left_semi"), ["u", "v"], "left")


def path_steps(paths: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per step of each path with the pair's combined strength, and its kinds where ``pairs`` have them."""
    kinds = ["kinds"] if "kinds" in pairs.columns else []
    steps = paths.select(*keys, F.posexplode(F.expr("transform(sequence(1, size(path) - 1), k -> struct(path[k - 1] AS from_id, path[k] AS to_id))")).alias("step", "s"))
    steps = steps.select(*keys, "step", "s.from_id", "s.to_id")
    joined = _seek(steps.withColumn("u", F.least("from_id", "to_id")).withColumn("v", F.greatest("from_id", "to_id")), pairs.select("u", "v", "weight", *kinds))
    return joined.select(*keys, "step", "from_id", "to_id", F.col("weight").alias("combined_strength"), *kinds)


def step_contributions(steps: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every parallel edge of each step with the direction in which the step crosses it."""
    steps = steps.withColumn("u", F.least("from_id", "to_id")).withColumn("v", F.greatest("from_id", "to_id"))
    joined = _seek(steps, pair_columns(edges))
    direction = F.when(F.col("kind") == "CO_CHANGES", "undirected").when(F.col("source_id") == F.col("from_id"), "forward").otherwise("reverse")
    return joined.select(*keys, "step", "from_id", "to_id", "source_id", "target_id", "kind", direction.alias("traversal_direction"), "strength")


def pagerank(
    pairs: DataFrame, nodes: DataFrame, personal: DataFrame, *, alpha: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, keys: list[str] | None = None
) -> DataFrame:
    """``(keys..., node_id, rank)``: personalized PageRank on the undirected weighted pairs, for all keys in one loop.

    nodes: node_id; personal: keys..., node_id, weight (shares are taken per key; all zero
    means uniform over its nodes). Starts uniform; isolated nodes hand their rank to the
    personal shares. A key stops once its L1 change is under nodes x tolerance; a tolerance
    of None runs all iterations. Without keys there is one ranking, without any personal
    rows it is empty.

    A round is one job over the stored ranks. The rank that isolated nodes hand on only
    reaches personal nodes, so its sums are joined with those few rows. Equal ranks make small files, so tables of
    all nodes would pass for small: they meet in merge joins. The links are bucketed by node and written once,
    so that a round moves ranks and flow only.
    """
    keys = keys or []
    nodes = stored(nodes, "nodes")
    spark, n = pairs.sparkSession, nodes.count()
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    weight = F.sum("weight").over(per_key)
    shares = personal.withColumn("p", F.when(weight > 0, F.col("weight") / weight).otherwise(1 / F.count("*").over(per_key)))
    shares = stored(shares.select(*keys, "node_id", "p"), "personal")
    ends = pairs.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight").union(pairs.select("v", "u", "weight"))
    out = ends.groupBy("a").agg(F.sum("weight").alias("out"))
    out = stored(out, "out")
    links, label = bucketed(ends.join(out.hint("merge"), "a").select("a", "b", (F.col("weight") / F.col("out")).alias("flow")), ["a"], "links", shares_of(2 * pairs.count(), spark))
    isolated = nodes.join(out.hint("merge"), F.col("node_id") == F.col("a"), "left_anti").select("node_id", F.lit(True).alias("loose"))
    named = shares.select(*keys).distinct() if keys else shares.limit(1).select()
    base = nodes.join(isolated.hint("merge"), "node_id", "left").crossJoin(F.broadcast(named))  # a ranking of all nodes per key
    base = stored(base.join(shares, [*keys, "node_id"], "left").select(
        *keys, "node_id", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("loose", F.lit(False)).alias("loose"), F.lit(1.0 / max(n, 1)).alias("rank"), F.lit(False).alias("done")
    ), "ranks")
    for _ in range(iterations):
        handed = base.filter("loose").groupBy(*keys).agg((alpha * F.sum("rank")).alias("handed"))
        handed = base.filter("p > 0").select(*keys, "node_id").join(F.broadcast(handed), keys) if keys else base.filter("p > 0").select("node_id").crossJoin(F.broadcast(handed))
        flow = links.join(base.filter("not done").select(*keys, F.col("node_id").alias("a"), "rank").hint("merge"), "a").groupBy(*keys, F.col("b").alias("node_id")).agg((alpha * F.sum(F.col("flow") * F.col("rank"))).alias("got"))
        got = base.join(flow.hint("merge"), [*keys, "node_id"], "left").join(handed, [*keys, "node_id"], "left")
        new = F.coalesce("got", F.lit(0.0)) + (F.coalesce("handed", F.lit(0.0)) + (1 - alpha)) * F.col("p")
        moved = stored(got.select(*keys, "node_id", "p", "loose", "done", F.when(F.col("done"), F.col("rank")).otherwise(new).alias("rank"), F.col("rank").alias("before")), "ranks")
        discard(base)
        base = moved.drop("before")
        if tolerance is not None:
            change = moved.groupBy(*keys).agg((F.sum(F.abs(F.col("rank") - F.col("before"))) < n * tolerance).alias("still"))
            still = change.agg(F.min("still").alias("all")).first()
            if still["all"] or still["all"] is None:
                break
            if keys:
                base = base.join(F.broadcast(change), keys).withColumn("done", F.col("done") | F.col("still")).drop("still")
    drop(spark, label)
    return base.select(*keys, "node_id", "rank")


def push_pagerank(
    pairs: DataFrame, personal: DataFrame, *, alpha: float = 0.85, epsilon: float = 1e-6, rounds: int | None = 200, keys: list[str] | None = None, block: int = 10_000
) -> DataFrame:
    """``(keys..., node_id, rank, residual)``: personalized PageRank by forward push, with rows for reached nodes only.

    personal: keys..., node_id, weight (shares are taken per key; all zero means uniform). Every node holds a
    residual, at first its personal share. A node whose residual is over ``epsilon`` times its weighted degree keeps
    1 - alpha of it as rank and pushes the rest along its edges, an isolated one to the personal
    shares; all such nodes push together, until there are none or ``rounds`` are over.

    The true rank of a node is at least ``rank``. Over all nodes of a key the ranks fall short of the truth by the sum of the
    residuals; once no node is left to push, a node's own rank falls short by at most epsilon times its weighted
    degree (where an isolated personal node is none of the graph's), since a walk back over undirected edges gathers residuals in proportion to their degree.

    Rows grow with what is reached above ``epsilon`` and not with queries times nodes. The links are bucketed by node and written once, so that
    a round moves the frontier only. The links of a hub are cut into blocks of about ``block``, and its frontier row is copied
    to each, so no task has them all.

    Without ``rounds`` (None, which needs keys) nothing ends the walks but ``epsilon``. Once a round reaches no new node, what each key has reached is
    pushed on in a task, by the same rounds, if no key has reached over ``WITHIN`` links. A key that is about to leave the nodes it
    has reached goes on by rounds of all keys.
    """
    keys = keys or []
    if rounds is None and not keys:
        raise ValueError("walks to their end are told apart by keys")
    spark = pairs.sparkSession
    ends = stored(pairs.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight").union(pairs.select("v", "u", "weight")), "ends")
    sizes = stored(ends.groupBy("a").agg(F.sum("weight").alias("out"), F.ceil(F.count("*") / block).cast("int").alias("parts")), "sizes")
    links = spread_join(ends, sizes, ["a"], "b").withColumn("block", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    links = stored(links.select("a", "block", "b", (F.col("weight") / F.col("out")).alias("flow")), "links")
    links = spread_join(links, sizes.toDF("b", "out_b", "parts_b"), ["b"], "a")
    links, label = bucketed(links.select("a", "block", "b", "flow", "out_b", "parts_b"), ["a", "block"], "links")
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    weight = F.sum("weight").over(per_key)
    shares = personal.withColumn("share", F.when(weight > 0, F.col("weight") / weight).otherwise(1 / F.count("*").over(per_key)))
    shares = stored(shares.select(*keys, "node_id", "share").join(sizes.withColumnRenamed("a", "node_id"), "node_id", "left"), "personal")
    row = [*keys, "node_id", "rank", "residual", "out", "parts"]
    state = stored(shares.withColumn("rank", F.lit(0.0)).withColumn("residual", F.col("share")).select(*row), "ranks")
    active = F.col("residual") > epsilon * F.coalesce("out", F.lit(1.0))
    known = None
    for _ in range(rounds) if rounds is not None else count():
        if rounds is None:
            before, known = known, state.count()
            reached = stored(state.select(*keys, F.col("node_id").alias("a")).join(links.select("a", "b", "flow"), "a"), "reached") if known == before else None
            if reached is not None and (reached.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= WITHIN:
                alone = state.join(shares.select(*keys, "node_id", "share"), [*keys, "node_id"], "left")
                pushed = alone.groupBy(*keys).cogroup(reached.groupBy(*keys)).applyInPandas(_pushed_on(alpha, epsilon), alone.schema).select(*row)
                pushed = stored(pushed, "ranks")
                discard(state)
                state = pushed
        frontier = state.filter(active)
        if not frontier.limit(1).count():
            break
        rest = state.select(
            *keys, "node_id", (F.col("rank") + F.when(active, (1 - alpha) * F.col("residual")).otherwise(0.0)).alias("rank"), F.when(active, 0.0).otherwise(F.col("residual")).alias("residual"), "out", "parts"
        )
        sent = frontier.filter("out is not null").select(*keys, F.col("node_id").alias("a"), "residual", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
        got = sent.join(links, ["a", "block"]).select(*keys, F.col("b").alias("node_id"), F.lit(0.0).alias("rank"), (alpha * F.col("residual") * F.col("flow")).alias("residual"), F.col("out_b").alias("out"), F.col("parts_b").alias("parts"))
        handed = frontier.filter("out is null").groupBy(*keys).agg((alpha * F.sum("residual")).alias("handed"))
        back = shares.join(handed, keys) if keys else shares.crossJoin(F.broadcast(handed))  # one row
        back = back.select(*keys, "node_id", F.lit(0.0).alias("rank"), (F.col("share") * F.col("handed")).alias("residual"), "out", "parts")
        met = rest.unionByName(got).unionByName(back).groupBy(*keys, "node_id")
        new = stored(met.agg(*[F.sum(c).alias(c) for c in ("rank", "residual")], *[F.max(c).alias(c) for c in ("out", "parts")]), "ranks")
        discard(state)
        state = new
    drop(spark, label)
    discard(ends)
    return state.select(*keys, "node_id", "rank", "residual")


#: Links that a key may have reached for its walks to be ended in one task.
WITHIN = 200_000


def _pushed_on(alpha: float, epsilon: float):
    """The rounds of ``push_pagerank`` over the rows of one key, until no node is left to push or one with links beyond these rows is."""

    def run(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        at = pd.Index(rows["node_id"])
        a, b, flow = at.get_indexer(links["a"]), at.get_indexer(links["b"]), links["flow"].to_numpy(float)
        leaves = np.zeros(len(rows), bool)
        leaves[a[b < 0]] = True
        a, b, flow = a[b >= 0], b[b >= 0], flow[b >= 0]
        rank, residual, out, share = (rows[c].to_numpy(float, na_value=np.nan).copy() for c in ("rank", "residual", "out", "share"))
        loose, share, least = np.isnan(out), np.nan_to_num(share), epsilon * np.where(np.isnan(out), 1.0, out)
        while True:
            active = residual > least
            if not active.any() or (active & leaves).any():
                return rows.assign(rank=rank, residual=residual)
            sent = np.where(active, residual, 0.0)
            rank = rank + (1 - alpha) * sent
            got = np.bincount(b, alpha * sent[a] * flow, len(rows))
            residual = residual - sent + got + share * (alpha * sent[loose].sum())

    return run


def default_node(edges: DataFrame, nodes: DataFrame, preferred: str | None = None) -> DataFrame:
    """The node to look at first, one row ``(node_id)``: the preferred one, else that of the most and strongest edges."""
    counted = nodes.select("node_id").join(degrees(edges), "node_id", "left").fillna(0)
    order = [F.desc(F.col("node_id").eqNullSafe(F.lit(preferred))), F.desc("degree"), F.desc("total_strength"), "node_id"]
    return counted.orderBy(*order).limit(1).select("node_id")


def default_query_node(ranked: DataFrame) -> DataFrame:
    """One row ``(query_id, node_id)`` per query of ``ranked(query_id, node_id, direct, relationship, top_anchor)``: its top
    anchor, else the node of the highest scores."""
    order = F.struct((~F.col("top_anchor")).alias("a"), (-F.col("direct")).alias("d"), (-F.col("relationship")).alias("r"), F.col("node_id").alias("i"))
    return ranked.groupBy("query_id").agg(F.min_by("node_id", order).alias("node_id"))


def overview(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges rolled up to groups, ``(source_group, target_group, kind, strength, n)``, none within a group.

    members: id, group.
    """
    a, b = members.toDF("source_id", "source_group"), members.toDF("target_id", "target_group")
    joined = edges.join(a, "source_id").join(b, "target_id").filter("source_group <> target_group")
    return joined.groupBy("source_group", "target_group", "kind").agg(noisy_or(F.col("strength")).alias("strength"), F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node_id, degree, total_strength)``; a self-loop counts once."""
    ends = edges.select(F.col("source_id").alias("node_id"), "strength").union(edges.filter("source_id <> target_id").select("target_id", "strength"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"), F.sum("strength").alias("total_strength"))


def neighbourhood(edges: DataFrame, relevance: DataFrame, top: int = 8) -> DataFrame:
    """Each node's ``top`` neighbours by strength, relevance and id. relevance: node_id, relevance."""
    rows = None if "u" in edges.columns else edges.count()
    best = strongest_per_neighbour(edges, rows).join(relevance.toDF("neighbour_id", "relevance"), "neighbour_id", "left").fillna(0.0, ["relevance"])
    order = Window.partitionBy("node_id").orderBy(F.desc("strength"), F.desc("relevance"), "neighbour_id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def induced_subgraph(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges whose two ends are in ``chosen(node_id)``."""
    a, b = (chosen.toDF(end).distinct().hint("shuffle_hash") for end in ("source_id", "target_id"))  # the edges are not sorted
    return edges.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi")


def strongest_edges(edges: DataFrame) -> DataFrame:
    """The strongest edge of each unordered pair; ties go to the first in edge order."""
    return strongest_of_pairs(edges, None if "u" in edges.columns else edges.count(), F.desc("strength"), "source_id", "target_id", "kind")
