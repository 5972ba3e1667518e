"""Relations to typed edges: co-change statistics, aggregation, symbol resolution, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions.text import display_round
from strandgraph.plans.lineage import dealt, laid_out, stored

#: Prior weight of each edge kind; other kinds have the default.
PRIORS = {"CALLS": 1.0, "INHERITS": 0.95, "INSTANTIATES": 0.9, "TESTS": 0.85, "CO_CHANGES": 0.8, "IMPORTS": 0.65, "CONTAINS": 0.45}
DEFAULT_PRIOR = 0.5
RELATION_COLUMNS = ["source_id", "target_id", "kind", "count", "confidence", "evidence"]


def _once(changes: DataFrame) -> DataFrame:
    """Each path of a commit once, with the commit's place ``ord`` (its id, if the log gives no order)."""
    place = F.col("ord") if "ord" in changes.columns else F.col("commit_id")
    return changes.groupBy("commit_id", "path").agg(F.min(place).alias("ord"))


def commit_totals(changes: DataFrame) -> DataFrame:
    """Commits per path of ``changes(commit_id, path)``; large commits count too."""
    return _totals(_once(changes))


def totals_of(commits: DataFrame) -> DataFrame:
    """``commit_totals`` of ``gathered_commits``."""
    return _totals(commits.select(F.explode("paths").alias("path")))


def _totals(once: DataFrame) -> DataFrame:
    return once.groupBy("path").agg(F.count("*").alias("commits"))


def cochange_pairs(changes: DataFrame, *, minimum_support: int = 2, maximum_files: int = 20) -> DataFrame:
    """``(left_path, right_path, n, commits)`` of paths that changed together.

    Commits of more than ``maximum_files`` paths make no pairs, so a commit gives at most
    maximum_files^2 / 2 of them. ``commits`` lists short ids in the order of the column
    ``ord`` of ``changes``, by which a log counts from its newest commit. The paths of a commit are gathered
    once, in an array of bounded size, and paired there: no self-join. Commits and pairs are dealt to tasks by their
    numbers, so what a task holds does not grow with the input.
    """
    return _pairs(gathered_commits(changes, maximum_files), minimum_support)


def gathered_commits(changes: DataFrame, maximum_files: int = 20) -> DataFrame:
    """Stored ``(commit_id, ord, paths)``: the sorted paths of each commit, in one row; one row per path where they are more than ``maximum_files``.

    ``changes`` move once, by commit, and are sorted once: repeats go, paths are counted and gathered in that order. An array
    holds at most ``maximum_files`` + 1 paths, whatever a commit has.
    """
    place = F.col("ord") if "ord" in changes.columns else F.col("commit_id")
    commit = Window.partitionBy("commit_id")
    ordered = commit.orderBy("path")
    rows = dealt(changes, changes.count(), "commit_id").select("commit_id", "path", place.alias("ord"))
    rows = rows.select("*", F.row_number().over(ordered).alias("k"), F.lag("path").over(ordered).alias("before"), F.min("ord").over(commit).alias("first"))
    once = rows.filter((F.col("k") == 1) | ~F.col("path").eqNullSafe(F.col("before")))
    once = once.select("commit_id", "path", "k", F.col("first").alias("ord"), F.collect_list("path").over(ordered.rowsBetween(0, maximum_files)).alias("paths"), F.count("*").over(commit).alias("files"))
    alone = F.array_compact(F.array("path"))
    gathered = once.filter(f"files > {maximum_files} or k = 1").select("commit_id", "ord", F.when(F.col("files") > maximum_files, alone).otherwise(F.col("paths")).alias("paths"))
    return stored(gathered, "commits")


def _pairs(commits: DataFrame, minimum_support: int) -> DataFrame:
    kept = commits.filter(F.col("commit_id").isNotNull() & (F.size("paths") > 1))
    size = F.size("paths").cast("long")
    number = kept.agg(F.coalesce(F.sum(size * (size - 1) / 2), F.lit(0)).cast("long")).first()[0]
    rest = lambda x, k: F.transform(F.slice("paths", k + 2, F.greatest(F.size("paths") - k - 1, F.lit(0))), lambda y: F.struct(x.alias("l"), y.alias("r")))
    pairs = kept.select("commit_id", "ord", F.explode(F.flatten(F.transform("paths", rest))).alias("p")).select("commit_id", "ord", F.col("p.l").alias("left_path"), F.col("p.r").alias("right_path"))
    found = dealt(pairs, number, "left_path", "right_path").groupBy("left_path", "right_path").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("ord", F.substring(F.col("commit_id").cast("string"), 1, 8).alias("id")))).alias("commits")
    )
    return found.filter(F.col("n") >= minimum_support).withColumn("commits", F.col("commits.id"))


def cochange_relations(changes: DataFrame, *, minimum_support: int = 2, maximum_files: int = 20, commits: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """CO_CHANGES relations: Jaccard of the commits times 1 - exp(-n / 2), at most 1.

    The evidence says so in words: the commits, their Jaccard and their short ids. ``commits`` and ``totals`` are the
    ``gathered_commits`` of the changes and the ``totals_of`` these, where the caller has them.
    """
    commits = gathered_commits(changes, maximum_files) if commits is None else commits
    pairs, totals = _pairs(commits, minimum_support), totals_of(commits) if totals is None else totals
    # totals grow with the paths and make small files: they are not broadcast
    joined = pairs.join(totals.toDF("left_path", "left_n").hint("merge"), "left_path").join(totals.toDF("right_path", "right_n").hint("merge"), "right_path")
    n = F.col("n")
    jaccard = n / (F.col("left_n") + F.col("right_n") - n)
    evidence = F.concat(n.cast("string"), F.lit(" non-merge commits; Jaccard="), F.format_string("%.3f", display_round(jaccard, 3)), F.lit("; commits="), F.array_join("commits", ", "))
    return joined.select(
        F.col("left_path").alias("source_id"), F.col("right_path").alias("target_id"), F.lit("CO_CHANGES").alias("kind"),
        n.alias("count"), F.least(F.lit(1.0), jaccard * (1 - F.exp(-n / 2))).alias("confidence"), F.array(evidence).alias("evidence"),
    )


def prior(kind: Column) -> Column:
    out = F.lit(DEFAULT_PRIOR)
    for name, value in PRIORS.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def aggregate_relations(relations: DataFrame, rows: int | None = None, *, by_pair: bool = False) -> DataFrame:
    """Typed edges of ``relations``: one row per (source_id, target_id, kind) with count, confidence, strength, evidence.

    Counts add up, confidence is their weighted mean, and strength compares the count with
    the largest of its kind. The kind maxima are a small aggregate joined back, so no kind is
    gathered in one task. The counted edges are stored, since both read them. Relations without ``evidence`` give edges
    without it; ``rows``, where the caller knows about how many relations there are, bounds what a task gathers. With ``by_pair`` edges have their ends in order too, as ``u`` and ``v``, and lie by these: what joins or
    gathers them by pair moves none.
    """
    if by_pair and rows is None:
        raise ValueError("by_pair needs rows")
    total = F.sum("count")
    evidence = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")] if "evidence" in relations.columns else []
    ends = ["source_id", "target_id"]
    if by_pair:
        # the pair and the way across it instead of four ends: 0 from u to v, 1 back, 2 without a source, 3 without a target
        ends = ["u", "v", "way"]
        way = F.when(F.col("source_id").isNull(), 2).when(F.col("target_id").isNull(), 3).when(F.col("source_id") <= F.col("target_id"), 0).otherwise(1)
        u, v = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
        relations = dealt(relations.select(u.alias("u"), v.alias("v"), way.cast("byte").alias("way"), "kind", "count", "confidence", *["evidence" for _ in evidence]), rows, "u", "v")
    elif rows is not None:
        relations = dealt(relations, rows, "source_id", "target_id", "kind")
    edges = relations.groupBy(*ends, "kind").agg(total.alias("count"), (F.sum(F.col("confidence") * F.col("count")) / total).alias("confidence"), *evidence)
    edges = laid_out(edges, rows, "u", "v", name="counted") if by_pair else stored(edges, "counted")
    top = edges.groupBy("kind").agg(F.max("count").alias("top"))
    support = 0.5 + 0.5 * F.log1p("count") / F.log1p("top")
    strength = F.least(F.lit(1.0), prior(F.col("kind")) * F.col("confidence") * support)
    edges = edges.join(F.broadcast(top), "kind")
    if by_pair:
        source = F.when(F.col("way").isin(0, 3), F.col("u")).when(F.col("way") == 1, F.col("v"))
        target = F.when(F.col("way") == 0, F.col("v")).when(F.col("way") != 3, F.col("u"))
        edges = edges.withColumns({"source_id": source, "target_id": target})
    return edges.select("source_id", "target_id", "kind", "count", "confidence", strength.alias("strength"), *["evidence" for _ in evidence], *ends[:-1] * by_pair)


def edge_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("edges"), display_round(F.avg("strength"), 3).alias("mean_strength"))


def node_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("nodes"))


def validate_graph(nodes: DataFrame, edges: DataFrame) -> None:
    """Raise if an endpoint is missing, a strength leaves [0, 1] or a line span is empty."""
    ids = nodes.select("id")
    for end in ("source_id", "target_id"):
        lost = edges.join(ids, edges[end] == ids.id, "left_anti").select(end).limit(1).collect()
        if lost:
            raise ValueError(f"edge endpoint is no node: {lost[0][0]}")
    if edges.filter(~F.col("strength").between(0, 1) | F.isnan("strength")).limit(1).count():
        raise ValueError("edge strength outside [0, 1]")
    if nodes.filter("start_line < 1 or end_line < start_line").limit(1).count():
        raise ValueError("node with an empty line span")


def _last(nodes: DataFrame, keys: dict[str, Column], value: Column, name: str) -> DataFrame:
    """A look-up with one row per key: the last in file order wins."""
    return nodes.select(*[c.alias(k) for k, c in keys.items()], value.alias("_v"), "ord").groupBy(*keys).agg(F.max_by("_v", "ord").alias(name))


def _unique(nodes: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
    """A look-up of keys that name exactly one node."""
    found = nodes.select(*[c.alias(k) for k, c in keys.items()], "id").groupBy(*keys).agg(F.count("*").alias("_n"), F.first("id").alias(name))
    return found.filter("_n = 1").drop("_n")


def resolve_relations(nodes: DataFrame, pending: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets of pending relations by the first rule that hits; ``(relations, outcome counts)``.

    nodes: id, kind, name, qualified_name, path, module, ord (file order). pending:
    source_id, kind, target_text, count, evidence. bindings: path, bound, module, symbol
    (empty for a module), ord. Every rule is a left join with a look-up of one row per key,
    so no join fans out; "longest prefix" rules explode the prefixes and keep the longest.
    """
    symbols = nodes.filter("kind <> 'file'")
    files = nodes.filter("kind = 'file'")
    local = F.expr("substring_index(qualified_name, '.', -1)")
    by_module = _last(files, {"m": F.col("module")}, F.col("id"), "file_hit")
    exact = _last(symbols, {"m": F.col("module"), "q": F.col("qualified_name")}, F.col("id"), "hit")
    in_module = _unique(symbols, {"m": F.col("module"), "s": local}, "hit")
    anywhere = _unique(symbols, {"s": local}, "hit")
    classes = symbols.filter("kind = 'class'").select(F.col("module").alias("m"), F.col("qualified_name").alias("q")).distinct()
    aliases = bindings.groupBy(F.col("path").alias("p"), F.col("bound").alias("b")).agg(F.max_by(F.struct("module", "symbol"), "ord").alias("alias"))

    origin = nodes.select(F.col("id").alias("source_id"), F.col("kind").alias("source_kind"), F.col("path"), F.col("module").alias("own"), F.col("qualified_name").alias("own_name"))
    rows = stored(pending.withColumn("pid", F.monotonically_increasing_id()).join(origin, "source_id"), "pending")
    text = F.col("target_text")
    is_module = text.startswith("@module:")
    rows = rows.withColumn("root", F.substring_index(text, ".", 1)).withColumn("rest", F.expr("CASE WHEN instr(target_text, '.') > 0 THEN substring(target_text, instr(target_text, '.') + 1) ELSE '' END"))
    rows = rows.withColumn("short", F.substring_index(text, ".", -1))

    def prefixes(value: Column) -> Column:
        parts = F.split(value, r"\.")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))

    # the class around a symbol is named by a proper prefix of its own name
    holders = rows.select("pid", "own", F.explode(prefixes(F.col("own_name"))).alias("q"), "own_name").filter("q <> own_name")
    holders = holders.join(classes, (F.col("own") == F.col("m")) & (holders.q == classes.q)).groupBy("pid").agg(F.max_by(holders.q, F.length(holders.q)).alias("holder"))
    rows = rows.join(holders, "pid", "left").join(aliases, (F.col("path") == F.col("p")) & (F.col("root") == F.col("b")), "left").drop("p", "b")

    def look(frame: DataFrame, table: DataFrame, name: str, **keys: Column) -> DataFrame:
        table = table.toDF(*[f"_{k}" for k in table.columns[:-1]], name)
        on = [keys[k] == F.col(f"_{k}") for k in keys]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        return frame.join(table, condition, "left").drop(*[f"_{k}" for k in keys])

    alias_symbol = F.when(F.col("alias.symbol") == "", F.col("rest")).when(F.col("rest") == "", F.col("alias.symbol")).otherwise(F.concat_ws(".", F.col("alias.symbol"), F.col("rest")))
    rows = rows.withColumn("alias_symbol", alias_symbol)
    rows = look(rows, by_module, "h1", m=F.when(is_module, F.expr("substring(target_text, 9)")))
    rows = look(rows, exact, "h2", m=F.col("own"), q=F.when(F.col("root").isin("self", "cls") & (F.col("rest") != "") & F.col("holder").isNotNull(), F.concat_ws(".", "holder", "rest")))
    rows = look(rows, exact, "h3a", m=F.col("alias.module"), q=F.when(F.col("alias_symbol") != "", F.col("alias_symbol")))
    rows = look(rows, in_module, "h3b", m=F.col("alias.module"), s=F.when(F.col("alias_symbol") != "", F.substring_index("alias_symbol", ".", -1)))
    rows = look(rows, by_module, "h3c", m=F.when(F.col("alias_symbol") == "", F.col("alias.module")))
    dotted = F.col("rest") != ""
    rows = look(rows, exact, "h4a", m=F.col("own"), q=F.when(dotted, text))
    rows = look(rows, exact, "h4b", m=F.col("own"), q=F.when(~dotted & F.col("holder").isNotNull(), F.concat_ws(".", "holder", "target_text")))
    top_level = _unique(symbols.filter("qualified_name not like '%.%'"), {"m": F.col("module"), "s": local}, "hit")
    rows = look(rows, top_level, "h4c", m=F.col("own"), s=F.when(~dotted, text))
    rows = look(rows, in_module, "h4d", m=F.col("own"), s=F.when(~dotted, text))
    parts = rows.filter(dotted & ~is_module).select("pid", "target_text", F.explode(prefixes(text)).alias("prefix")).filter("prefix <> target_text")
    parts = parts.withColumn("tail", F.expr("substring(target_text, length(prefix) + 2)"))
    longest = parts.join(exact, (F.col("prefix") == F.col("m")) & (F.col("tail") == F.col("q"))).groupBy("pid").agg(F.max_by("hit", F.length("prefix")).alias("h5"))
    rows = rows.join(longest, "pid", "left")
    rows = look(rows, anywhere, "h6", s=F.col("short"))

    def choice(hit: str, confidence: float) -> Column:
        return F.when(F.col(hit).isNotNull(), F.struct(F.col(hit).alias("id"), F.lit(confidence).alias("confidence")))

    cascade = F.coalesce(*[choice(h, c) for h, c in (("h2", 0.95), ("h3a", 0.95), ("h3b", 0.85), ("h3c", 0.95), ("h4a", 0.95), ("h4b", 0.95), ("h4c", 0.95), ("h4d", 0.85), ("h5", 0.9), ("h6", 0.6))])
    rows = rows.withColumn("found", F.when(is_module, choice("h1", 1.0)).otherwise(cascade))
    target = nodes.select(F.col("id").alias("target_id"), F.col("kind").alias("target_kind"), F.col("path").alias("target_path"))
    rows = rows.join(target, F.col("found.id") == F.col("target_id"), "left")
    final = F.when((F.col("kind") == "CALLS") & (F.col("target_kind") == "class"), "INSTANTIATES").when(
        (F.col("kind") == "CALLS") & (F.col("source_kind") == "test") & ~F.col("target_path").startswith("tests/"), "TESTS"
    ).otherwise(F.col("kind"))
    outcome = (
        F.when(F.col("target_id").isNull(), F.when(F.col("kind") == "IMPORTS", "external_imports").otherwise(F.concat(F.lit("unresolved_"), F.lower("kind"))))
        .when(F.col("target_id") == F.col("source_id"), F.concat(F.lit("self_"), F.lower("kind")))
        .otherwise(F.concat(F.lit("resolved_"), F.lower(final)))
    )
    rows = rows.withColumn("outcome", outcome).withColumn("final", final)
    resolved = rows.filter(F.col("target_id").isNotNull() & (F.col("target_id") != F.col("source_id"))).select(
        "source_id", "target_id", F.col("final").alias("kind"), "count", F.col("found.confidence").alias("confidence"), "evidence"
    )
    return resolved, rows.groupBy("outcome").agg(F.count("*").alias("n"))


def file_order(paths: Column) -> Column:
    """Sort key of paths by their parts."""
    return F.split(paths, "/")


def with_file_order(nodes: DataFrame, within: str) -> DataFrame:
    """``ord``: place of a node by file order, then by ``within`` its file."""
    return nodes.withColumn("ord", F.struct(file_order(F.col("path")), F.col(within)))


def pair_columns(edges: DataFrame) -> DataFrame:
    """``edges`` with their ends in order, ``u`` and ``v``; where they have these, they lie by them."""
    if "u" in edges.columns:
        return edges
    return edges.withColumn("u", F.least("source_id", "target_id")).withColumn("v", F.greatest("source_id", "target_id"))


def strongest_of_pairs(edges: DataFrame, rows: int | None, *order: Column | str) -> DataFrame:
    """The edge of each unordered pair that is first by ``order``. Edges that do not lie by pair are dealt, where ``rows`` says how many they are.

    A hash of the pair leads the sort: ids with a common beginning are slow to compare.
    """
    placed = edges if "u" in edges.columns else pair_columns(edges) if rows is None else dealt(pair_columns(edges), rows, "u", "v")
    best = Window.partitionBy("_h", "u", "v").orderBy(*order)
    return placed.withColumn("_h", F.xxhash64("u", "v")).withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_h", "_n", "u", "v")


def strongest_per_neighbour(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``(node_id, neighbour_id, kind, source_id, target_id, strength)``: the preferred edge to each neighbour.

    It is the same seen from both ends, so it is chosen by pair, where edges may lie already, and turned afterwards.
    """
    best = strongest_of_pairs(edges.filter("source_id <> target_id"), rows, F.desc("strength"), "kind", "source_id", "target_id")
    turned = F.array(*[F.struct(F.col(a).alias("node_id"), F.col(b).alias("neighbour_id")) for a, b in (("source_id", "target_id"), ("target_id", "source_id"))])
    return best.withColumn("_e", F.explode(turned)).select("_e.node_id", "_e.neighbour_id", "kind", "source_id", "target_id", "strength")
