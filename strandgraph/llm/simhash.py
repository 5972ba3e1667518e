"""SimHash near-duplicates found by covering locality-sensitive hashing.

Texts are lower-cased in A-Z, cut at ASCII white space into words and into 4-word
shingles with repeats. A fingerprint bit is 1 if it is set in over half of the shingles'
XXH64 values. Fingerprints of at most ``radius`` differing bits are linked.

Candidate search: each of the 64 positions carries a non-zero vector of radius + 1 bits,
and table v keeps the positions whose vector has an odd product with v. Positions that
differ give at most ``radius`` equations in radius + 1 unknowns, so some v other than 0
solves them all and the pair agrees in that table: no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import LOWER, col, fresh, stored, text_key
from strandgraph.llm.components import connected_components, verified_links
from strandgraph.operators.skew import spread_join

SHINGLE, SEED, RADIUS = 4, 42, 4
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint; no words give 0, fewer than four words one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1][: len(words) - SHINGLE + 1].tolist()
        shingles = [joined[s:e] for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, fp)``, one row per row of ``docs``. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_key", "fp"])

    thin = docs.select(col(id_col).cast("long").alias("doc_id"), text_key(col(text_col)).alias("text_key"), col(text_col).alias("text"))
    return thin.mapInArrow(run, "doc_id long, text_key long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks as signed longs; every set of ``radius`` positions misses one."""
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(64)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_components(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(node, root)`` of all fingerprints ``distinct(fp)`` that have a link to another one."""
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(radius))])
    members = distinct.select(F.explode(keys).alias("bucket"), F.col("fp").alias("node"))  # from a stored table

    def near(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        node = rows["node"].to_numpy().view(np.uint64)
        return np.bitwise_count(node[i] ^ node[j]) <= radius

    return connected_components(verified_links(members, near))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, text_key, fp, component_id, first_key)``, one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links (null only if all ids there
    are null); first_key is the text_key of the row that stands for the component. Equal
    fingerprints are joined first, so copies cost one row each and never form pairs. Empty
    and null texts have fingerprint 0 and are linked like any other. An empty table gives
    no rows; repeated rows all return.
    """
    prints = stored(fingerprints(docs, id_col, text_col))
    distinct = stored(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")))
    linked = fingerprint_components(distinct.select("fp"), radius)
    roots = distinct.join(linked.hint("merge"), F.col("fp") == F.col("node"), "left")
    roots = roots.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = stored(roots, "roots")
    heads = roots.groupBy("root").agg(F.min("first").alias("head"))
    named = spread_join(roots, heads, ["root"], "fp", hint="merge").select("fp", F.col("head.doc_id").alias("component_id"), F.col("head.text_key").alias("first_key"))
    # rows of one fingerprint may be a third of all; the stored rows' order tells them apart
    return spread_join(prints, named, ["fp"], F.monotonically_increasing_id(), hint="merge").select("doc_id", "text_key", "fp", "component_id", "first_key")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row left of each component: the smallest doc_id.

    Of several rows with that id the smallest text hash stays; of wholly repeated rows one.
    Only the keys of the rows to drop are joined against the documents, by a merge join: they may be most of all
    rows and must not pass through the driver.
    """
    found = stored(near_duplicates(docs, id_col, text_col, radius))
    first = (F.col("doc_id").eqNullSafe(F.col("component_id"))) & (F.col("text_key") == F.col("first_key"))
    of, key = fresh("__doc_id", docs.columns), fresh("__text_key", docs.columns)
    drop = found.filter(~first).select(F.col("doc_id").alias(of), F.col("text_key").alias(key + "_of")).distinct()
    again = found.filter(first).groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count()
    keyed = docs.withColumn(key, text_key(col(text_col)))
    left = keyed.join(drop.hint("merge"), col(id_col).cast("long").eqNullSafe(F.col(of)) & (F.col(key) == F.col(key + "_of")), "left_anti")
    if again:
        left = left.dropDuplicates([id_col, key])
    return left.drop(key)
