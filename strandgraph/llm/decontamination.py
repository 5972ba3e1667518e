"""Benchmark decontamination by spaced seeds.

A mask is a row of ones and zeros laid on consecutive tokens; positions under a zero are
ignored, so a substituted token there does not break the seed's hash. The seeds of the
benchmark are joined with those of the documents on their hash, each distinct hash of a text once;
where a text and an item meet, the places of their common seeds fix the diagonals, and along
each diagonal the tokens themselves are compared. A document is
contaminated by an item if some stretch of at least ``min_tokens`` aligned tokens (the
whole item, if it is shorter) agrees in at least ``similarity`` of its places. An item that
is shorter is cut into one block more than it may have substitutions, and one block agrees.

Tokens are runs of letters, digits and other non-ASCII characters after lower-casing A-Z;
they are compared by 64-bit hashes.

A seed that m items and d texts share gives m x d rows, one per text and item, as does the result where
all of them overlap; how often the seed stands in a text or an item does not matter.

The documents are read once, however large the benchmark is. Only the seeds that the
benchmark has too leave a document, with its tokens. Which these are is known exactly where
the benchmark has at most ``EXACT_SEEDS`` seeds, which are then broadcast; beyond, a bitmap of fixed
size lets a few others pass, and the join removes them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import LOWER, col, fresh, in_filter, key_filter, stored, text_key
from strandgraph.operators.skew import spread_join

#: Of every 13 to 25 tokens of which a fifth at most is substituted, anywhere, at least one mask
#: hits at some offset. Longer stretches can be cut into such ones.
MASKS = ("111111", "1000101111", "11101011", "1101101001", "110111")
MIN_TOKENS, SIMILARITY = 13, 0.8
#: At most so many seeds (32 MB) are broadcast, and a list of so many texts (16 MB).
EXACT_SEEDS, BROADCAST_TEXTS = 4_000_000, 2_000_000
_TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """The hashes of a text's tokens."""
    words = _TOKEN.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def seeds(row: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place at which the mask fits into the tokens; those of different masks differ."""
    n = len(row) - len(mask) + 1
    out = np.full(max(n, 0), xxhash.xxh3_64_intdigest(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = (out ^ row[k : k + n]) * _STEP
            out ^= out >> np.uint64(29)
    return out


def blocks(n: int, similarity: float) -> list[tuple[int, int]]:
    """Places [s, e) of n tokens cut into one block more than substitutions are allowed."""
    cuts = min(n, int((1.0 - similarity) * n + 1e-9) + 1)
    return [(n * k // cuts, n * (k + 1) // cuts) for k in range(cuts)]


def item_seeds(row: np.ndarray, masks: tuple[str, ...], min_tokens: int, similarity: float) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """``(mask, places, hashes)`` of an item: all places of every mask, and the blocks of a short item."""
    for mask in masks:
        found = seeds(row, mask)
        if len(found):
            yield mask, np.arange(len(found)), found
    if 0 < len(row) < max(min_tokens, min((len(m) for m in masks), default=0)):
        for s, e in blocks(len(row), similarity):
            yield "1" * (e - s), np.array([s]), seeds(row[s:e], "1" * (e - s))


def longest_stretch(equal: np.ndarray, least: int, similarity: float) -> tuple[int, int] | None:
    """The longest [s, e) of at least ``least`` places with a share of ``similarity`` equal; first of ties."""
    n = len(equal)
    if n < least or least == 0:
        return None
    total = np.r_[0, np.cumsum(np.where(equal, 1.0 - similarity, -similarity))]
    # suffix maxima fall from left to right: for each start the furthest end that still pays
    ahead = np.maximum.accumulate(total[::-1])[::-1]
    ends = np.searchsorted(-ahead, -(total - 1e-9), side="right") - 1
    length = ends - np.arange(n + 1)
    s = int(np.argmax(length))
    if length[s] < least:
        return None
    e = int(ends[s])
    inside = np.flatnonzero(equal[s:e])
    if not len(inside):
        return None
    trimmed = s + int(inside[0]), s + int(inside[-1]) + 1
    return trimmed if trimmed[1] - trimmed[0] >= least else (s, e)


def best_overlap(row: np.ndarray, item: np.ndarray, diagonals: Iterable[int], min_tokens: int, similarity: float) -> tuple[int, int, int, float] | None:
    """``(start, aligned, matched, similarity)`` of the stretch with the most agreeing places on the ascending diagonals."""
    best = None
    for diagonal in diagonals:
        start, end = max(0, diagonal), min(len(row), diagonal + len(item))
        equal = row[start:end] == item[start - diagonal : end - diagonal]
        span = longest_stretch(equal, min(min_tokens, len(item)), similarity)
        if span:
            s, e = span
            hit = (start + s, e - s, int(equal[s:e].sum()), float(equal[s:e].mean()))
            if best is None or (hit[2], -hit[0]) > (best[2], -best[0]):
                best = hit
            if hit[2] == len(item):  # the whole item; later diagonals start later
                break
    return best


def common_diagonals(keys: np.ndarray, places: np.ndarray, n: int, item_keys: np.ndarray, item_places: np.ndarray, m: int) -> np.ndarray:
    """All ``place - item place`` of equal keys, ascending; ``item_keys`` are sorted, ``n`` and ``m`` the numbers of tokens.

    A key with very many places on both sides is handled by one convolution of its places, so memory
    stays at n + m however many pairs of places there are.
    """
    low, high = np.searchsorted(item_keys, keys, "left"), np.searchsorted(item_keys, keys, "right")
    met = high > low
    keys, places, low, high = keys[met], places[met], low[met], high[met]
    counts = high - low
    if counts.sum() <= 8 * (n + m):
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.unique(np.repeat(places, counts) - item_places[np.repeat(low, counts) + inner])
    seen = np.zeros(n + m, bool)  # the diagonal -(m - 1) is at 0
    order = np.argsort(keys, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
        own, other = places[at], item_places[low[at[0]] : high[at[0]]]
        if len(own) * len(other) <= 8 * (n + m):
            seen[np.subtract.outer(own, other).ravel() + m - 1] = True
        else:
            a, b = np.zeros(n + m), np.zeros(n + m)
            a[own], b[m - 1 - other] = 1.0, 1.0
            seen |= np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), n + m) > 0.5
    return np.flatnonzero(seen) - (m - 1)


def _membership(keys: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Whether seeds are among the stored ``keys(key)``: exactly, or by a bitmap if they are very many."""
    context = keys.sparkSession.sparkContext
    if keys.count() <= EXACT_SEEDS:
        exact = np.sort(keys.toArrow()["key"].to_numpy())
        sent = context.broadcast((exact, key_filter(keys, 24)))

        def inside(found: np.ndarray) -> np.ndarray:
            exact, bitmap = sent.value
            out = in_filter(bitmap, found)
            at = np.flatnonzero(out)
            place = np.minimum(np.searchsorted(exact, found[at]), max(len(exact) - 1, 0))
            out[at] = exact[place] == found[at] if len(exact) else False
            return out

        return inside
    broad = context.broadcast(key_filter(keys, 29))
    return lambda found: in_filter(broad.value, found)


def _items(benchmark: DataFrame, item_col: str, text_col: str, masks: tuple[str, ...], min_tokens: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Stored ``(item, item_id, tokens)`` and the distinct ``(key, item, mask)``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pa.array([tokens(t).tobytes() for t in batch.column(2).to_pylist()], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rows], names=["item", "item_id", "tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for mask, _, found in item_seeds(np.frombuffer(data, np.uint64), masks, min_tokens, similarity):
                    found = np.unique(found.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), item)), pa.array([mask] * len(found))], names=["key", "item", "mask"])

    items = benchmark.select(F.monotonically_increasing_id().alias("item"), col(item_col).cast("long").alias("item_id"), col(text_col).alias("text"))
    items = stored(items.filter("text is not null").mapInArrow(read, "item long, item_id long, tokens binary"), "items")
    return items, stored(items.select("item", "tokens").mapInArrow(cut, "key long, item long, mask string").distinct(), "seeds")


def _overlaps(thin: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, masks: tuple[str, ...], min_tokens: int, similarity: float) -> DataFrame:
    """``(doc_id, text_key, item_id, doc_start, aligned, matched, similarity)`` of ``thin(doc_id, text_key, text)``."""
    items, item_keys = _items(benchmark, item_col, item_text_col, masks, min_tokens, similarity)
    used = sorted(r.mask for r in item_keys.select("mask").distinct().collect())
    inside = _membership(stored(item_keys.select("key").distinct(), "keys"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(2).to_pylist()):
                row = tokens(text)
                keys, places = [], []
                for mask in used:
                    found = seeds(row, mask).view(np.int64)
                    at = np.flatnonzero(inside(found))
                    if len(at):
                        keys.append(found[at])
                        places.append(at)
                if keys:
                    hits = [pa.array([np.concatenate(x).astype(np.int64)], pa.list_(pa.int64())) for x in (keys, places)]
                    one = [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([row.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*one, *hits], names=["doc_id", "text_key", "tokens", "keys", "places"])

    marked = thin.mapInArrow(find, "doc_id long, text_key long, tokens binary, keys array<long>, places array<long>")
    marked = stored(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    hits = marked.select("row", F.explode(F.array_distinct("keys")).alias("key"))
    pairs = stored(spread_join(hits, item_keys.select("key", "item").distinct(), ["key"], "row").select("row", "item").distinct(), "pairs")
    sides = spread_join(pairs, items.withColumnRenamed("tokens", "item_tokens"), ["item"], "row")
    sides = sides.join(marked, "row")
    names = ["doc_id", "text_key", "item_id", "doc_start", "aligned", "matched", "similarity"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(1024)
        def sorted_seeds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
            cut = [(found.view(np.int64), places) for _, places, found in item_seeds(np.frombuffer(data, np.uint64), masks, min_tokens, similarity)]
            keys, places = (np.concatenate(c) for c in zip(*cut, strict=True))
            order = np.argsort(keys, kind="stable")
            return keys[order], places[order]

        for batch in batches:
            rows = []
            lists = [(c.flatten().to_numpy(), np.r_[0, np.cumsum(c.value_lengths().to_numpy())]) for c in (batch.column("keys"), batch.column("places"))]
            for k, r in enumerate(batch.drop_columns(["keys", "places"]).to_pylist()):
                row, item = (np.frombuffer(r[c], np.uint64) for c in ("tokens", "item_tokens"))
                keys, places = (values[ends[k] : ends[k + 1]] for values, ends in lists)
                diagonals = common_diagonals(keys, places, len(row), *sorted_seeds(r["item_tokens"]), len(item))
                hit = best_overlap(row, item, diagonals.tolist(), min_tokens, similarity)
                if hit:
                    rows.append((r["doc_id"], r["text_key"], r["item_id"], *hit))
            kinds = [pa.int64()] * 6 + [pa.float64()]
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return sides.select("doc_id", "text_key", "item_id", "keys", "places", "tokens", "item_tokens").mapInArrow(verify, "doc_id long, text_key long, item_id long, doc_start long, aligned long, matched long, similarity double")


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY,
) -> DataFrame:
    """``(doc_id, item_id, doc_start, aligned, matched, similarity)`` of every document and item that overlap.

    Null or empty texts and items never overlap; an item with a null id counts and is returned with a null ``item_id``;
    repeated documents and items return a row each. Ids are cast to long. Texts of any length are searched whole. An empty benchmark or table gives no rows.
    """
    thin = docs.select(col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), col(text_col).alias("text"))
    return _overlaps(thin, benchmark, item_col, item_text_col, masks, min_tokens, similarity).drop("text_key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no item, unchanged, with whatever other columns they have.

    Whether a row overlaps depends on its text alone, so rows go by a 64-bit hash of the text.
    """
    thin = docs.select(F.lit(None).cast("long").alias("doc_id"), text_key(col(text_col)).alias("text_key"), col(text_col).alias("text"))
    leaks = _overlaps(thin, benchmark, item_col, item_text_col, MASKS, MIN_TOKENS, SIMILARITY)
    key, of = fresh("__text_key", docs.columns), fresh("__leaking", docs.columns)
    leaks = stored(leaks.select(F.col("text_key").alias(of)).distinct(), "leaks")
    keyed = docs.withColumn(key, text_key(col(text_col)))
    if leaks.count() <= BROADCAST_TEXTS:
        return keyed.join(F.broadcast(leaks), F.col(key) == F.col(of), "left_anti").drop(key)
    spread = F.xxhash64(*[col(f.name) for f in docs.schema.fields if f.dataType.typeName() in ("long", "integer", "string")])
    return spread_join(keyed, leaks.withColumnRenamed(of, key), [key], spread, "left_anti").select(*[col(c) for c in docs.columns])
