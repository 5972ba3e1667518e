"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Targets: the sources' weights share the word budget; a target stops at ``most`` times its
source's size and the excess is shared again by weight. The fixed point is found in closed
form: with sources in order of cap per weight, the level is the largest of
(budget - caps before) / (weights from here on).

Order: each source's documents stand in the order of a seeded hash, so a document covers
words [c, c + size) of its source's demand, and again one source size later if the
target goes round twice. The source's weight over training time is a piecewise linear
schedule; its integral is the share of demand met by time t, and inverting it turns c into
a training position in [0, 1]. Documents are range-sorted by position.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.common import col, fresh, running, stored

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 20240217
#: (time, relative weight) knots for each entry of WEIGHTS: the broad sources fade, the small ones grow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
#: Hash ranges of a source hold so many rows on average.
ROWS_PER_BUCKET = 4096
ONE_TASK = 100_000
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, one_task: int = ONE_TASK) -> DataFrame:
    """``sizes(source, source_size)`` with kind (index of its weight) and target, one row per source.

    Up to ``one_task`` sources are ordered in one task, more of them in ranges.
    """
    if sizes.count() <= one_task:

        def before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
            window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
            return df.select("*", *[F.coalesce(F.sum(v).over(window), F.lit(0)).alias(n) for n, v in sums.items()])
    else:
        before = running
    by_name = [F.col("source").isNull(), F.col("source")]
    ranked = before(sizes, by_name, {"rank": F.lit(1).cast("long")}).withColumn("kind", (F.col("rank") % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most))
    total = ranked.agg((F.sum("source_size") * share).alias("budget"), F.sum("weight").alias("weights"))
    ranked = before(ranked, [F.col("cap") / F.col("weight"), *by_name], {"caps": F.col("cap"), "lighter": F.col("weight")}).crossJoin(F.broadcast(total))  # one row
    level = ranked.agg(F.max((F.col("budget") - F.col("caps")) / (F.col("weights") - F.col("lighter"))).alias("level"))
    ranked = ranked.crossJoin(F.broadcast(level))  # one row
    return ranked.select("source", "source_size", "kind", F.least("cap", F.greatest(F.lit(0.0), F.col("weight") * F.col("level"))).alias("target"))


def position(kind: Column, met: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which the share ``met`` of a source's demand has been served; over 1 it goes on linearly."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        segments = list(zip(knots, knots[1:], strict=False))
        total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in segments)
        at, end = met, total
        for (t0, w0), (t1, w1) in reversed(segments):
            begin = end - (t1 - t0) * (w0 + w1) / 2
            rest = F.greatest(met * total - begin, F.lit(0.0))
            slope = (w1 - w0) / (t1 - t0)
            # root of w0 x + slope x^2 / 2 = rest, in the form that holds for a flat segment too
            time = t0 + 2 * rest / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0))))
            at = F.when(met * total < end, F.least(time, F.lit(t1))).otherwise(at)
            end = begin
        out = F.when(kind == k, at).otherwise(out)
    return out


def curriculum(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, most: int = MOST, schedules: tuple = SCHEDULES, seed: int = SEED, prefix: str = "mix_",
) -> DataFrame:
    """``docs`` with the columns size, source_size, target, taken, starts, takes and copies (``prefix`` before each).

    taken: the words of the document inside its source's target, repeats counted; summed
    over a source it is the target rounded to a word. starts: the training positions at
    which the document begins, in every pass; takes: the words taken in each. copies: passes of which at least half lies
    inside the target, for those who take whole documents. A null text has size 0, a null
    source is a source of its own; repeated rows count each; an empty table gives no rows.

    A source's prefix sums are taken in hash ranges (a first sum per range, then a running
    sum within it), so one source may hold any share of the rows.
    """
    p = {x: fresh(prefix + x, docs.columns) for x in ("h", "bucket", "key", "kind", "offset", "c", "size", "source_size", "target", "taken", "starts", "takes", "copies", "key_of")}
    bits = max(0, math.ceil(math.log2(max(1, docs.count()) / ROWS_PER_BUCKET)))
    known = docs.withColumn(p["size"], word_count(col(text_col)))
    known = known.withColumn(p["h"], F.xxhash64(F.lit(seed), col(id_col), col(text_col), col(text_col).isNull()))
    known = known.withColumn(p["bucket"], F.shiftrightunsigned(F.col(p["h"]), 64 - bits) if bits else F.lit(0).cast("long"))

    parts = known.groupBy(col(source_col).alias("source"), F.col(p["bucket"]).alias("bucket")).agg(F.sum(p["size"]).alias("size"))
    parts = stored(parts, "parts")
    sizes = parts.groupBy("source").agg(F.sum("size").alias("source_size"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("offset", F.coalesce(before, F.lit(0)))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "of")
    parts = parts.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        F.struct("source", F.coalesce("bucket", F.lit(0)).cast("long").alias("bucket")).alias(p["key_of"]), F.col("offset").alias(p["offset"]),
        F.col("source_size").alias(p["source_size"]), F.col("target").alias(p["target"]), F.col("kind").alias(p["kind"]),
    )

    # a single key, in which nulls are equal, for the window and for the join, so the texts move once
    known = known.withColumn(p["key"], F.struct(col(source_col).alias("source"), F.col(p["bucket"]).alias("bucket")))
    here = Window.partitionBy(F.col(p["key"])).orderBy(F.col(p["h"]), col(id_col), F.col(p["size"]))
    running = F.sum(p["size"]).over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col(p["size"])
    joined = known.withColumn(p["c"], running).join(parts, F.col(p["key"]) == F.col(p["key_of"]))
    c, size, whole = F.col(p["offset"]) + F.col(p["c"]), F.col(p["size"]), F.col(p["source_size"])
    quota = F.round(F.col(p["target"])).cast("long")
    begins = [c + k * whole for k in range(most)]
    takes = [F.greatest(F.lit(0), F.least(size, quota - at)).cast("long") for at in begins]
    taken = sum(takes, F.lit(0))
    copies = sum((F.when(at + size / 2 <= quota, 1).otherwise(0) for at in begins), F.lit(0))
    share_met = [F.when(quota > 0, at / quota).otherwise(F.lit(1.0)) for at in begins]
    starts = F.array(*[position(F.col(p["kind"]), met, schedules) for met in share_met])
    keep = [col(x) for x in docs.columns] + [F.col(p[x]) for x in ("size", "source_size", "target")]
    return joined.select(*keep, taken.cast("long").alias(p["taken"]), starts.alias(p["starts"]), F.array(*takes).alias(p["takes"]), copies.cast("int").alias(p["copies"]))


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The training sequence: whole documents, a row per copy, range-sorted by position.

    A copy is kept if at least half of its words lie inside its source's target.
    """
    prefix = fresh("__mix_", docs.columns)
    mixed = curriculum(docs, prefix=prefix, **options)
    at = fresh("__position", mixed.columns)
    copies = mixed.select(*[col(c) for c in docs.columns], F.explode(F.slice(f"{prefix}starts", 1, F.col(f"{prefix}copies"))).alias(at))
    return copies.repartitionByRange(F.col(at)).sortWithinPartitions(at).drop(at)
