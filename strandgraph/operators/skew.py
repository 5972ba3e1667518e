"""Joins on keys that a few values dominate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _taken(name: str, *frames: DataFrame) -> str:
    lower = {c.lower() for f in frames for c in f.columns}
    while name in lower:
        name += "_"
    return name


def hot_keys(frame: DataFrame, keys: list[str], share: float | None = None) -> list[tuple]:
    """``(keys..., parts)`` of the keys that hold over ``share`` of the rows.

    There are fewer than 1 / share such keys, so they may come to the driver. ``parts`` is
    the number of tasks that the key's rows are spread over. By default a key is hot above
    half of what a shuffle partition gets on average.
    """
    share = share or 1 / (2 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = max(1.0, frame.count() * share)
    counts = frame.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > limit)
    return [tuple(r) for r in counts.select(*keys, F.ceil(F.col("rows") / limit).cast("int")).collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str | Column, how: str = "inner", share: float | None = None, found: list[tuple] | None = None, hint: str | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``keys``; rows of a hot key on the left are dealt to several tasks.

    Which of them a row goes to depends on a hash of ``spread``, a value that differs
    among the rows of a key and is the same when a task runs again. The matching rows of ``right`` are copied once per task. For
    inner, left, left_semi and left_anti joins; null keys match nothing. ``left`` is read
    for its hot keys first, so it should be a stored table; without hot keys the join is a plain one.
    ``found`` are the hot keys where the caller has them already, as for a table that is joined in every round of a loop.
    ``hint`` names the join's strategy: ``merge`` where Spark would take a side for small that its estimate misjudges.
    """
    found = hot_keys(left, keys, share) if found is None else found
    if not found:
        return left.join(right.hint(hint) if hint else right, keys, how)
    parts, salt = _taken("__parts", left, right), _taken("__salt", left, right)
    schema = StructType([StructField(k, left.schema[k].dataType) for k in keys] + [StructField(parts, IntegerType())])
    hot = left.sparkSession.createDataFrame(found, schema)
    spread = F.col(spread) if isinstance(spread, str) else spread
    dealt = F.when(F.col(parts).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col(parts)).cast("int"))
    one = left.join(F.broadcast(hot), keys, "left").withColumn(salt, dealt).drop(parts)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))
    other = right.join(F.broadcast(hot), keys, "left").withColumn(salt, copies).drop(parts)
    return one.join(other.hint(hint) if hint else other, [*keys, salt], how).drop(salt)
