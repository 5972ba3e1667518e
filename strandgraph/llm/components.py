"""Connected components and exact verification of candidate buckets, both distributed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import discard, stored
from strandgraph.operators.skew import spread_join


def _with_least(links: DataFrame, least: DataFrame, hub: float) -> DataFrame:
    """``links(u, v)`` with the least ``m`` of each u.

    Nodes with over ``hub`` links are fewer than all links divided by that; their rows of
    ``least(u, m, n)`` come to the driver and back by broadcast. The others meet in merge joins: their
    tables grow with the input, and no part of them may pass through the driver.
    """
    found = least.filter(F.col("n") > hub).select("u", "m").collect()
    if not found:
        return links.join(least.select("u", "m").hint("merge"), "u")
    hubs = F.broadcast(links.sparkSession.createDataFrame(found, "u long, m long"))
    return links.join(hubs.select("u"), "u", "left_anti").join(least.select("u", "m").hint("merge"), "u").unionByName(links.join(hubs, "u"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Alternating large-star and small-star rounds. A star's minimum comes from an aggregate
    with map-side partial sums and is joined back, a hub's by broadcast, so its neighbours never meet in one
    task. Each round is written to the checkpoint folder; the loop ends when the
    set of edges repeats (count and order-free checksum). No edges give no rows.
    """
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = stored(current.distinct(), "links")
    state = None
    while True:
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now[0] == 0 or tuple(now) == state:
            break
        state = tuple(now)
        hub = max(1.0, now[0] / int(current.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        both = current.union(current.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.filter("v > u"), low, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        large = stored(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, hub).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.union(least.select("u", "m")).distinct(), "links")
        discard(current)
        discard(large)
        current = after
    members = current.groupBy("u").agg(F.min("v").alias("root")).toDF("node", "root")
    return members.union(current.select(F.col("v"), F.col("v")).distinct())


def _labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links left-right."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        keep = label[left] != label[right]
        left, right = left[keep], right[keep]
    return label


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups: the rows arrive sorted by column ``g``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            count += held[-1].num_rows
            if count >= rows:
                whole = pa.Table.from_batches(held)
                g = whole["g"].to_numpy()
                cut = int(np.searchsorted(g, g[-1], side="left"))
                if cut:
                    yield whole.slice(0, cut)
                    held = whole.slice(cut).combine_chunks().to_batches()
                    count = whole.num_rows - cut
    if count:
        yield pa.Table.from_batches(held)


def verified_links(
    members: DataFrame, same: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray], block: int = 256, payload: DataFrame | None = None
) -> DataFrame:
    """Spanning links ``(a, b)`` of every bucket of ``members(bucket long, node long)``, a stored table.

    ``same(rows, i, j)`` decides exactly whether rows i and j are linked; the rows have the
    columns of ``payload(node, ...)`` too. A bucket of more
    than ``block`` members is cut into blocks by a hash of the node, and every pair of
    blocks becomes a group of its own: no task holds more than two blocks, and no member
    is skipped. A group of m members gives at most m - 1 links, never its pairs. Sizes are
    partial sums; those of buckets with very many members reach these by broadcast. The joins are merge joins, because
    ``members`` may be exploded from a table that looks small enough for a broadcast.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = spread_join(members, sizes, ["bucket"], "node", hint="merge").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(group.alias("g"), "bucket", "node")
    if payload is not None:
        dealt = dealt.join(payload.hint("merge"), "node")  # a node is in few groups of each of its buckets
    dealt = dealt.repartition("g").sortWithinPartitions("g", "bucket", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 4096):
            g, bucket, node = (rows[c].to_numpy() for c in ("g", "bucket", "node"))
            n = len(g)
            start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (bucket[1:] != bucket[:-1])])
            room = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n])) - np.arange(n)
            left, right = [], []
            active, step = np.flatnonzero(room > 1), 1
            while len(active):
                ok = same(rows, active, active + step)
                left.append(active[ok])
                right.append(active[ok] + step)
                step += 1
                active = active[room[active] > step]
            if left:
                label = _labels(n, np.concatenate(left), np.concatenate(right))
                out = np.flatnonzero(label != np.arange(n))
                yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(node[label[out]])], names=["a", "b"])

    return dealt.mapInArrow(link, "a long, b long").distinct()
