"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.plans.lineage import discard, stored

__all__ = ["LOWER", "by_size", "col", "crc_remainder", "discard", "fresh", "in_filter", "key_filter", "numbered", "running", "stored", "table", "text_key"]

#: Bits of a filter of keys: 16 MB.
FILTER_BITS = 27
#: ASCII upper case to lower case on UTF-8 bytes; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(prefix: str, taken: list[str]) -> str:
    """A column name that differs, case aside, from all taken ones."""
    lower, name = {t.lower() for t in taken}, prefix
    while name.lower() in lower:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """64-bit hash of a text; null hashes as a value of its own."""
    return F.xxhash64(text, text.isNull())


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with each of ``sums`` as the total over all rows before it in ``order``, without one task that sorts them all.

    The rows are range-partitioned and stored, so their parts stay as they are; each part's
    total, one row per part, gives the next ones their start.
    """
    part, place = fresh("__part", df.columns), fresh("__order", df.columns)
    keys = [f"{place}{k}" for k in range(len(order))]
    own = {name: fresh("__" + name, df.columns) for name in sums}
    ranged = df.select("*", *[o.alias(k) for o, k in zip(order, keys, strict=True)], *[v.alias(own[n]) for n, v in sums.items()])
    ranged = stored(ranged.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(part).agg(*[F.sum(own[n]).alias("of_" + own[n]) for n in sums])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(part, *[F.coalesce(F.sum("of_" + own[n]).over(before), F.lit(0)).alias("start_" + own[n]) for n in sums])
    inner = Window.partitionBy(part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), part)
    return out.select(*[col(c) for c in df.columns], *[(F.coalesce(F.sum(own[n]).over(inner), F.lit(0)) + F.col("start_" + own[n])).alias(n) for n in sums])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the column ``name``: each row's place in ``order``, from 0."""
    return running(df, order, {name: F.lit(1).cast("long")})


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``2 ** bits`` bits in which the low bits of each of ``keys(key long)`` are set: all that reaches the driver."""
    h = F.col("key").bitwiseAND((1 << bits) - 1)
    out = np.zeros((1 << bits) // 8, np.uint8)
    pages = keys.select(F.shiftright(h, 15).alias("page"), h.bitwiseAND(32767).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map"))
    for r in pages.collect():
        out[r.page * 4096 : r.page * 4096 + 4096] = np.frombuffer(r.map, np.uint8)
    return out


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of the bitmap: all that are, and few others."""
    h = keys & (len(bitmap) * 8 - 1)
    return (bitmap[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1


def by_size(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts in ``column`` have about ``limit`` bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64) + 64
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
