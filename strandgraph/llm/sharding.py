"""Global shuffle into shards by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records by a seeded hash into buckets that fit in memory. Pass 2 shuffles
each bucket by Fisher-Yates (Spark's seeded ``shuffle`` of an array) and writes it. A row's place in the
whole order is its bucket's offset plus its place in the bucket, and shard k takes the k-th
contiguous part of that order, so counts differ by at most one. A task has ranges of buckets that follow one
another, so it writes into few shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandgraph.llm.common import col, fresh, stored

#: A task holds at most 128 buckets at once, where Spark's aggregation of lists turns to sorting: 512 MB.
SHARDS, SEED, BUCKET_BYTES = 40, 20240131, 4 << 20
#: Buckets of one range, and ranges at most in one shuffle.
RANGE, MAX_TASKS = 16, 100_000
#: A bucket so many times the aimed size holds rows that are equal in every column, or a giant one.
CROWDED = 4


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def shuffled_shards(
    rows: DataFrame, n_shards: int = SHARDS, *, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
    size: F.Column | None = None, shard_col: str = "shard", slot_col: str = "slot",
) -> DataFrame:
    """``rows`` with ``shard`` (int) and gapless ``slot`` (long from 0); every row once.

    ``size`` estimates a row's bytes in memory (64 if not given). A row's bucket depends on
    all its columns but maps, so rows that share an id, source or text are still scattered.
    Rows equal in every column are counted where they lie and numbered, and the number takes part in the hash (not so in tables with
    maps, whose equal rows share a bucket). Nulls hash like values. With fewer rows than
    shards the surplus shards stay empty; an empty table gives no rows. Existing columns
    keep their names and values; a new column whose name is taken gets underscores at its end.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    shard_col, slot_col = fresh(shard_col, rows.columns), fresh(slot_col, rows.columns)
    h, b, at, all_, group, weight, copy = (fresh(x, rows.columns) for x in ("__h", "__bucket", "__at", "__rows", "__range", "__size", "__copy"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.lit(64) if size is None else size).alias("bytes")).first()
    n_buckets = max(1, math.ceil((total.bytes or 0) / bucket_bytes))
    hashed = rows.withColumn(h, F.xxhash64(F.lit(seed), *[col(f.name) for f in rows.schema.fields if _hashable(f.dataType)]))
    hashed = hashed.withColumn(b, F.pmod(F.col(h), F.lit(n_buckets)))

    def counted(frame: DataFrame) -> DataFrame:
        held = frame.withColumn(weight, F.lit(64) if size is None else size)
        return stored(held.groupBy(F.col(b).alias("of")).agg(F.count("*").alias("n"), F.sum(weight).alias("bytes")), "buckets")

    counts = counted(hashed)
    crowded = counts.filter(F.col("bytes") > CROWDED * bucket_bytes).select("of")
    if all(_hashable(f.dataType) for f in rows.schema.fields) and crowded.limit(1).count():
        keys = [col(c) for c in rows.columns]
        inside = F.col(b) == F.col("of")
        equal = hashed.join(F.broadcast(crowded), inside, "left_semi").groupBy(*keys, F.col(h)).agg(F.count("*").alias(copy))
        equal = equal.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copy)))).withColumn(h, F.xxhash64(F.lit(seed), h, copy)).drop(copy)
        equal = equal.withColumn(b, F.pmod(F.col(h), F.lit(n_buckets)))
        hashed = hashed.join(F.broadcast(crowded), inside, "left_anti").unionByName(equal)
        counts = counted(hashed)

    # one row per range: the place at which it starts, from blocks of ranges, so that no task sorts all of them
    ranges = max(1, min(MAX_TASKS, n_buckets // RANGE))
    range_of = lambda bucket: F.expr(f"(`{bucket}` * {ranges}L) div {n_buckets}L").cast("int")
    held = counts.groupBy(range_of("of").alias(group)).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("of", "n"))).alias("sizes"))
    held = held.withColumn("block", F.expr(f"`{group}` div 1024"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = held.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy("block")).alias("start"))
    starts = held.withColumn("inner", before(Window.partitionBy("block").orderBy(group))).join(F.broadcast(blocks), "block")
    # a range has RANGE buckets or few more (all of 4 MB) up to MAX_TASKS ranges, so its starts are a short array
    sums = F.expr("transform(sequence(1, size(sizes)), k -> start + inner + aggregate(slice(sizes, 1, k - 1), 0L, (s, x) -> s + x.n))")
    starts = starts.select(group, F.map_from_arrays("sizes.of", sums).alias("starts")).repartitionById(ranges, F.col(group))

    # a range is a task, so it writes into few shards; the sort makes each list, and so its shuffle, the same when a task is run again
    dealt = hashed.withColumn(group, range_of(b)).repartitionById(ranges, F.col(group)).sortWithinPartitions(b, h)
    lists = dealt.groupBy(group, b).agg(F.collect_list(F.struct(*[col(c) for c in rows.columns])).alias(all_))
    # the starts are laid out like the lists, which therefore stay where they are
    lists = lists.join(starts.hint("shuffle_hash"), group)
    place = (F.element_at("starts", F.col(b)) + F.col(at)).alias("place")
    placed = lists.select(b, "starts", F.posexplode(F.shuffle(F.col(all_), seed)).alias(at, all_)).select(F.col(all_).alias("r"), place)
    sharded = placed.withColumn("k", F.expr(f"(place * {n_shards}L) div {max(total.n, 1)}L"))
    slot = F.col("place") - F.expr(f"(k * {total.n}L + {n_shards - 1}L) div {n_shards}L")
    fields = [F.col("r").getField(c).alias(c) for c in rows.columns]
    return sharded.select(*fields, F.col("k").cast("int").alias(shard_col), slot.cast("long").alias(slot_col))


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """One folder of Parquet files per shard, rows in slot order within each file."""
    sharded.sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).mode("overwrite").parquet(path)
