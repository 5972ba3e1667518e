"""Substring deduplication: paragraph MinHash banding, and passages inside other paragraphs.

Words are runs between ASCII white space after lower-casing A-Z. Two kinds of pieces are
compared across documents (rows of the table, whatever their ids).

* A paragraph is a line of at least ``min_words`` words, by default all that have a
  five-word shingle. Equal paragraphs are one node. Each node has a MinHash signature cut into bands;
  nodes that collide in a band are verified by the exact Jaccard similarity of their
  shingle sets, and the components of verified links are the clusters.
* A passage that repeats inside otherwise different paragraphs has no similar paragraph
  around it. So ``UNIT`` words are also taken at content-chosen anchors: a start is an
  anchor if its hash is the least of some ``ANCHOR`` consecutive starts. Any shared run of
  UNIT + ANCHOR - 1 = 51 words has an anchor in common, so one of its units is equal.

Equal pieces are those with the same words: they agree in 96 bits of a 128-bit hash of
their bytes. In every cluster the occurrences in the first document (the smallest id, nulls
last, then table order) stay, the others are removals.

A piece that very many documents share never meets in one task: each worker names the
pieces it has seen often, those that are frequent in the sum are few, and their first
documents are found by a partial aggregate and joined back by broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.common import LOWER, by_size, col, in_filter, key_filter, numbered, stored
from strandgraph.llm.components import connected_components, grouped, verified_links

SHINGLE, SIMILARITY = 5, 0.8
MIN_WORDS = SHINGLE
#: At similarity 0.8 the bands miss a pair with probability (1 - 0.8^2)^6 = 0.002.
BANDS, ROWS = 6, 2
UNIT, ANCHOR = 40, 12
#: A worker names a piece that it has seen so often; over LOCAL x partitions documents share one that none names.
LOCAL, NAMED = 8, 50_000
#: Texts of so many bytes are cut up together.
TEXT_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_draw = np.random.default_rng(7)
_A = _draw.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """A hash of each run of five words."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, SHINGLE):
        out = out * _BASE + hashes[k : k + n]
    return _mix(out)


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    return np.minimum(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def anchored(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the anchored units in texts that lie one after another; ``ends`` are the texts' ends, by word."""
    n = len(hashes)
    if n < UNIT + ANCHOR - 1:
        return np.zeros(0, np.int64)
    a = np.empty(n, np.uint64)
    a[:-1] = hashes[:-1] * _BASE + hashes[1:]
    a[-1] = hashes[-1]
    a = _mix(a) | np.uint64(1)
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    low = _least(a, ANCHOR)
    starts = np.arange(len(low))
    low[starts + UNIT + ANCHOR - 1 > end[: len(low)]] = 0  # some start of the window has no whole unit
    pad = np.zeros(ANCHOR - 1, np.uint64)
    high = ~_least(~np.concatenate([pad, low, pad]), ANCHOR)
    return np.flatnonzero((a == high) & (np.arange(n) + UNIT <= end))


def _digests(pieces: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 96 bits that stand for each piece: a long and an int."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].view(np.int64), (both[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


class Words:
    """The words of texts one after another, with the places of lines and texts."""

    def __init__(self, texts: list[str | None]) -> None:
        cut = [[line.split() for line in (t or "").encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n")] for t in texts]
        lines = list(chain.from_iterable(cut))
        self.words = list(chain.from_iterable(lines))
        self.line_ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
        self.text_ends = self.line_ends[np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))) - 1] if cut else np.zeros(0, np.int64)
        self.lines = lines

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))

    def paragraphs(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes, starts and sizes of the lines that are paragraphs."""
        sizes = np.diff(np.r_[0, self.line_ends])
        at = np.flatnonzero(sizes >= max(min_words, 1))
        return at, self.line_ends[at] - sizes[at], sizes[at]

    def units(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the units that begin at the starts."""
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)
        text = b" ".join(self.words)
        begin = np.r_[0, ends[:-1]][starts].tolist()
        end = (ends[starts + UNIT - 1] - 1).tolist()
        return _digests(text[s:e] for s, e in zip(begin, end, strict=True))


def signatures(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The band hashes of the paragraphs at the starts, a row each; of fewer than five words the bands of all of them."""
    long = sizes >= SHINGLE
    out = np.zeros((len(starts), BANDS), np.uint64)
    if long.any():
        s, n = starts[long], sizes[long] - SHINGLE + 1
        first = np.r_[0, np.cumsum(n)[:-1]]
        own = shingles_of(hashes)[np.repeat(s - first, n) + np.arange(n.sum())]
        low = [np.minimum.reduceat(own * a + b, first) for a, b in zip(_A, _B, strict=True)]
        for k in range(BANDS):
            band = low[k * ROWS]
            for x in low[k * ROWS + 1 : (k + 1) * ROWS]:
                band = _mix(band) * _BASE + x
            out[long, k] = _mix(band + np.uint64(k + 1))
    for i in np.flatnonzero(~long).tolist():
        out[i] = _mix(hashes[starts[i] : starts[i] + sizes[i]].sum(dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64))
    return out


#: A document's paragraphs and units; ``mark`` is the check in the upper and the start in the lower half of a long.
PIECES = (
    "row long, line_key array<long>, line_mark array<long>, line_size array<int>, bands array<array<long>>, unit_key array<long>, unit_mark array<long>, named array<long>, times array<int>"
)


def _marks(check: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (check.astype(np.int64) << 32) | start


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, kind))


def pieces(docs: DataFrame, min_words: int) -> DataFrame:
    """The pieces of each row of ``docs(row, text)``, and rows that name what a worker has seen often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PIECES.split(", ")]
        seen: Counter[int] = Counter()
        none = pa.array([[]], pa.list_(pa.int64()))

        def often(least: int) -> pa.RecordBatch:
            found = [(k, n) for k, n in seen.items() if n >= least]
            seen.clear()
            named = [pa.array([[k for k, _ in found]], pa.list_(pa.int64())), pa.array([[n for _, n in found]], pa.list_(pa.int32()))]
            empty = pa.array([[]], pa.list_(pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), none, none, pa.array([[]], pa.list_(pa.int32())), empty, none, none, *named], names=names)

        for batch in batches:
            for part in by_size(batch, 1, TEXT_BYTES):
                text = Words(part.column(1).to_pylist())
                hashes = text.hashes()
                at, starts, sizes = text.paragraphs(min_words)
                bands = signatures(hashes, starts, sizes)
                line_key, line_check = _digests(b" ".join(text.lines[k]) for k in at.tolist())
                units = anchored(hashes, text.text_ends)
                unit_key, unit_check = text.units(units) if len(units) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
                # of a run of equal units the first
                fresh = np.r_[True, (unit_key[1:] != unit_key[:-1]) | (np.diff(units) > 1)] if len(units) else np.zeros(0, bool)
                units, unit_key, unit_check = units[fresh], unit_key[fresh], unit_check[fresh]
                begin = np.r_[0, text.text_ends[:-1]]
                line_ends, unit_ends = np.searchsorted(starts, text.text_ends), np.searchsorted(units, text.text_ends)
                own = lambda x: begin[np.searchsorted(text.text_ends, x, side="right")]  # noqa: E731, B023
                line_mark, unit_mark = _marks(line_check, starts - own(starts)), _marks(unit_check, units - own(units))
                seen.update(line_key.tolist())
                seen.update(unit_key.tolist())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(at) + 1, BANDS), pa.int32()), pa.array(bands.ravel().view(np.int64)))
                nested = pa.ListArray.from_arrays(pa.array(np.r_[0, line_ends], pa.int32()), flat)
                empty = pa.array([None] * part.num_rows, pa.list_(pa.int64())), pa.array([None] * part.num_rows, pa.list_(pa.int32()))
                i64, i32 = pa.int64(), pa.int32()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), _lists(line_key, line_ends, i64), _lists(line_mark, line_ends, i64), _lists(sizes.astype(np.int32), line_ends, i32), nested,
                    _lists(unit_key, unit_ends, i64), _lists(unit_mark, unit_ends, i64), *empty,
                ], names=names)
                if len(seen) > 20 * NAMED:
                    yield often(LOCAL)
        yield often(LOCAL)

    return docs.mapInArrow(run, PIECES)


def _first_rows(occurrences: DataFrame, hot: DataFrame, extra: list[str]) -> DataFrame:
    """One row ``(key, check, low, high, extra...)`` per distinct piece of ``occurrences(key, mark, row, extra...)``.

    low and high are the first and last row that has it; extra are columns that equal
    pieces agree in. Pieces of ``hot(key)`` go through a partial aggregate, the others are sorted
    by key and read once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in occurrences.schema.fields}
    fields = ["key", "check", "low", "high", *extra]
    schema = ", ".join(f"`{c}` {kinds.get(c, 'bigint') if c != 'check' else 'bigint'}" for c in fields)
    check = F.shiftright("mark", 32).alias("check")
    thin = occurrences.select(F.col("key").alias("g"), "mark", "row", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 1 << 16):
            g, mark, row = (table[c].to_numpy() for c in ("g", "mark", "row"))
            check = mark >> 32
            order = np.lexsort((row, check, g))
            g, check, row = g[order], check[order], row[order]
            first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (check[1:] != check[:-1])])
            last = np.r_[first[1:], len(g)] - 1
            more = table.take(pa.array(order[first])).combine_chunks()
            arrays = [pa.array(g[first]), pa.array(check[first]), pa.array(row[first]), pa.array(row[last]), *(more[c].combine_chunks() for c in extra)]
            yield pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=fields)

    cold = thin.join(F.broadcast(hot.toDF("g")), "g", "left_anti").repartition("g").sortWithinPartitions("g")
    warm = occurrences.join(F.broadcast(hot), "key").groupBy("key", check).agg(F.min("row").alias("low"), F.max("row").alias("high"), *[F.first(c).alias(c) for c in extra])
    return cold.mapInArrow(run, schema).unionByName(warm.select(*fields))


def _joined_back(occurrences: DataFrame, found: DataFrame, hot: DataFrame) -> DataFrame:
    """``occurrences`` with the columns of ``found(key, check, ...)``; those of hot keys by broadcast."""
    occurrences = occurrences.withColumn("check", F.shiftright("mark", 32))
    cold = occurrences.join(F.broadcast(hot), "key", "left_anti").join(found.join(F.broadcast(hot), "key", "left_anti"), ["key", "check"])
    warm = occurrences.join(F.broadcast(found.join(F.broadcast(hot), "key", "left_semi")), ["key", "check"])
    return cold.unionByName(warm)


def shingle_sets(docs: DataFrame, sought: DataFrame, min_words: int) -> DataFrame:
    """``(key, check, shingles)`` of the paragraphs in ``sought(key, check)``, read from the texts of ``docs(text)`` again.

    A filter of fixed size spares most other lines; the join decides.
    """
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(sought))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 0, TEXT_BYTES):
                text = Words(part.column(0).to_pylist())
                at, _, _ = text.paragraphs(min_words)
                key, check = _digests(b" ".join(text.lines[k]) for k in at.tolist())
                hit = np.flatnonzero(in_filter(sent.value, key))
                if len(hit):
                    sets = [np.unique(shingles_of(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)))).view(np.int64) for w in (text.lines[k] for k in at[hit].tolist())]
                    lists = _lists(np.concatenate(sets), np.cumsum([len(s) for s in sets]), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(check[hit].astype(np.int64)), lists], names=["key", "check", "shingles"])

    found = docs.select("text").mapInArrow(run, "key long, check long, shingles array<long>")
    return found.groupBy("key", "check").agg(F.first("shingles").alias("shingles")).join(sought, ["key", "check"])


def jaccard_at_least(rows: pa.Table, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sorted shingle sets of rows i and j reach the Jaccard similarity, exactly."""
    lists = rows["shingles"].combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    sets = [flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
    out = np.zeros(len(i), bool)
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        small, large = sorted((len(sets[x]), len(sets[y])))
        if small and small >= similarity * large - 1e-9:
            both = np.concatenate([sets[x], sets[y]])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out[k] = common >= similarity * (small + large - common) - 1e-9
    return out


def paragraph_links(docs: DataFrame, nodes: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Verified links ``(a, b)`` between ``nodes(node, key, check, bands)``, the distinct paragraphs of ``docs(text)``."""
    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    crowded = stored(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "crowded")
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(crowded.select(F.col("bucket").alias("key"))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_filter(sent.value, batch.column(0).to_numpy())
            yield batch.filter(pa.array(hit))

    members = members.mapInArrow(near, "bucket long, node long")
    members = stored(members.join(crowded.select("bucket"), "bucket", "left_semi"), "members")
    sought = nodes.select("node", "key", "check").join(members.select("node").distinct(), "node", "left_semi")
    sets = stored(shingle_sets(docs, sought, min_words).select("node", "shingles"), "sets")
    return verified_links(members, lambda rows, i, j: jaccard_at_least(rows, i, j, similarity), block=128, payload=sets)


def repeated_spans(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """``(doc_id, start, end, first_doc_id, n_units, removed)``: word spans that repeat across documents.

    Overlapping or touching pieces of one document are merged if the same document keeps them,
    so spans of different keepers can overlap. ``removed`` is false for the span that stays,
    and first_doc_id names the document that keeps it. Every row is a document: rows that
    share an id, repeated rows and rows without an id are compared with one another like any others.
    Documents without a repeat across documents give no row, and neither do null and empty
    texts nor an empty table. Only the id and the text are read, so other columns may have any name.
    """
    thin = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).filter("text is not null")
    odd = thin.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if odd:
        # ids that do not tell rows apart: rows get numbers in the order of id and table
        thin = stored(thin.withColumn("at", F.monotonically_increasing_id()), "rows")
        names = stored(numbered(thin.select("doc_id", "at"), [F.col("doc_id").isNull(), F.col("doc_id"), F.col("at")], "row"), "names")
        thin = thin.drop("doc_id").join(names.select("at", "row"), "at").select("row", "text")
    else:
        thin, names = thin.withColumnRenamed("doc_id", "row"), None

    found = stored(pieces(thin, min_words), "pieces")
    named = found.filter("row is null").select(F.explode(F.arrays_zip("named", "times")).alias("x")).select(F.col("x.named").alias("key"), F.col("x.times").alias("n"))
    hot = stored(named.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(NAMED).select("key"), "hot")
    found = found.filter("row is not null")

    unzip = lambda *fields: F.explode(F.arrays_zip(*fields)).alias("x")
    units = found.select("row", unzip("unit_key", "unit_mark")).select(F.col("x.unit_key").alias("key"), F.col("x.unit_mark").alias("mark"), "row")
    shared = stored(_first_rows(units, hot, []).filter("low < high").select("key", "check", "low"), "shared")
    repeated = key_filter(shared.select("key"))
    passages = _joined_back(_spared(units, repeated), shared, hot)
    start = F.col("mark").bitwiseAND((1 << 32) - 1)
    passages = passages.select("row", start.alias("start"), (start + UNIT).alias("end"), "low")

    lines = found.select("row", unzip("line_key", "line_mark", "line_size", "bands")).select(
        F.col("x.line_key").alias("key"), F.col("x.line_mark").alias("mark"), "row", F.col("x.line_size").alias("size"), F.col("x.bands").alias("bands")
    )
    nodes = _first_rows(lines, hot, ["bands"]).withColumn("node", F.monotonically_increasing_id())
    nodes = stored(nodes, "nodes")
    roots = connected_components(paragraph_links(thin, nodes, min_words, similarity))
    rooted = nodes.select("node", "key", "check", "low", "high").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted.filter("low < high or root <> node").unionByName(rooted.filter("low = high and root = node").join(roots.select(F.col("root")).distinct(), "root", "left_semi").select(*rooted.columns)), "rooted")
    clusters = rooted.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    kept = stored(rooted.select("root", "key", "check").join(clusters.select("root", "low"), "root").select("key", "check", "low"), "kept")
    spans = _joined_back(_spared(lines.drop("bands"), key_filter(kept.select("key"))), kept, hot)
    spans = spans.select("row", start.alias("start"), (start + F.col("size")).alias("end"), "low")

    merged = merged_spans(passages.union(spans))
    if names is None:
        return merged.withColumnsRenamed({"row": "doc_id", "low": "first_doc_id"}).select("doc_id", "start", "end", "first_doc_id", "n_units", "removed")
    own, first = names.select("row", "doc_id"), names.select(F.col("row").alias("low"), F.col("doc_id").alias("first_doc_id"))
    return merged.join(own, "row").join(first, "low").select("doc_id", "start", "end", "first_doc_id", "n_units", "removed")


def _spared(occurrences: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The rows whose key may be in the filter; the others need not be shuffled."""
    sent = occurrences.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(sent.value, batch.column(0).to_numpy())))

    return occurrences.mapInArrow(run, occurrences.schema)


def merged_spans(found: DataFrame) -> DataFrame:
    """``found(row, start, end, low)`` with touching spans of one row and one keeper put together."""
    found = found.withColumn("removed", F.col("row") > F.col("low"))
    order = Window.partitionBy("row", "low").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("opens", F.when(F.col("start") <= reached, 0).otherwise(1))
    found = found.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy("row", "low", "removed", "island").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.count("*").alias("n_units")).drop("island")
