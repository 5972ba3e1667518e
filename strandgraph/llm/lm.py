"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Words are runs between ASCII white space after lower-casing A-Z; each text ends with one
end token. Every word seen ``n`` times or more in training has a symbol of its own, where n
is the least count that keeps their number within ``HEAD_WORDS``; the rarer ones are told
apart by the class of their last two bytes. So the model grows with the corpus up to that bound, which is the
memory a worker may spend (two vectors of ``WIDTH`` floats a word), and the classes take the rest.

The context of a token is ``g = c1 * r_u + c2 * r_v + c3 * mean(r)`` over the word before, the
one before that, and all earlier words of the text; the score of word w is ``g . q_w + b_w``.
Each r and q is the word's own vector plus that of its class, so a rare word is near its
likes. Training is noise-contrastive in numpy over every training token: partitions
train side by side, and a row's new value is the mean over the partitions that
touched it, weighted by how often. It goes in rounds, each from the mean of the last one.

Probabilities are normalised exactly over all symbols. For that the context is rounded to one of
``STATES`` x ``STATES`` vectors, a two-level code book fitted to the contexts of all training tokens, which a
table of cells sums up; batched matrix products
of these with all word vectors give the log normaliser of each, once. A token then costs
its place in the code book and one product. A word of a class gets the class's probability times its
smoothed share of the class, so the whole distribution adds to one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import LOWER, by_size, col, crc_remainder, discard, stored
from strandgraph.operators.skew import hot_keys

HEAD_WORDS, CLASSES, WIDTH, STATES = 300_000, 1024, 16, 64
BATCH, RUN, NOISE, RATE, SEED, FLUSH = 1024, 32, 96, 0.04, 11, 400_000
#: A trainer gets about this many tokens at least, and a small corpus passes this many by, in at most ``PASSES`` passes.
TRAINER_TOKENS, PASSES = 2_000_000, 4
#: Share of the texts in the first round; the second round has the others.
FIRST_ROUND = 1 / 16
#: The contexts of all training tokens are summed up in cells: groups of the word before, of the one before that, and
#: so many halvings of the mean. Their sums meet in so many blocks.
LAST_GROUPS, OTHER_GROUPS, HALVINGS, CELL_BLOCKS = 128, 64, 3, 16
CELLS = LAST_GROUPS * OTHER_GROUPS << HALVINGS
#: Texts of so many bytes are encoded, texts of so many tokens learnt and scored together.
TEXT_BYTES, CHUNK = 1 << 20, 1 << 17
BLOCK_ROWS = 8192
SMOOTH, HELD_OUT_OF = 0.1, 10


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return data.translate(LOWER).split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def count_words(texts: DataFrame) -> DataFrame:
    """``(word binary, n long)`` over all rows of ``texts(text)``; workers add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(words_of(text))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Whole-corpus counts: of each head word, and of each class over the words beyond the head."""

    index: dict[bytes, int]  # head words by falling count
    counts: np.ndarray  # of the head words
    n_end: int
    n_tokens: int  # N
    n_types: int  # V, the end token among them
    class_tokens: np.ndarray
    class_types: np.ndarray

    @classmethod
    def of(cls, counted: DataFrame, n_docs: int) -> Vocabulary:
        """``counted`` holds each word once. A histogram, at most HEAD_WORDS words and a row per class reach the driver.

        The least count of the head comes from a histogram of logarithmic steps (exact below 23), so no
        task sorts the words.
        """
        step = F.floor(F.log2("n") * 16)
        sizes = counted.groupBy(step.alias("step")).agg(F.count("*").alias("types"), F.min("n").alias("low"), F.sum("n").alias("tokens")).orderBy(F.desc("step")).collect()
        least, kept = 1 << 62, 0
        for r in sizes:
            kept += r.types
            if kept > HEAD_WORDS:
                break
            least = r.low
        head = counted.filter(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
        words, counts = head["word"].to_pylist(), head["n"].to_numpy()
        suffix = F.crc32(F.substring("word", F.greatest(F.length("word") - 1, F.lit(1)), F.lit(2))) % CLASSES
        beyond = counted.filter(F.col("n") < least).groupBy(suffix.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
        tokens, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for r in beyond:
            tokens[r.k], types[r.k] = r.n, r.types
        n_tokens, n_types = sum(r.tokens for r in sizes) + n_docs, sum(r.types for r in sizes) + (n_docs > 0)
        return cls(dict(zip(words, range(len(words)), strict=True)), np.array(counts, np.int64), n_docs, n_tokens, n_types, tokens, types)

    @property
    def end(self) -> int:
        """The end token's symbol; head words and classes stand before it, the begin of a text after it."""
        return len(self.index) + CLASSES

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.counts, self.class_tokens, [self.n_end]])

    def classes(self) -> np.ndarray:
        """The class of every symbol; end and begin have one of their own."""
        own = np.fromiter(map(class_of, self.index), np.int64, len(self.index))
        return np.concatenate([own, np.arange(CLASSES), [CLASSES, CLASSES + 1]]).astype(np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """The symbols of all texts one after another, each closed by its end; where each ends; its words outside the head."""
        size, end = len(self.index), self.end
        at, ends, beyond = [], [], []
        for text in texts:
            words = words_of(text)
            places = [self.index.get(w, -1) for w in words]
            beyond.append([w for w, k in zip(words, places, strict=True) if k < 0] if -1 in places else [])
            at += places
            at.append(end)
            ends.append(len(at))
        symbols = np.array(at, np.int32)
        symbols[symbols < 0] = [size + class_of(w) for rare in beyond for w in rare]
        return symbols, np.array(ends, np.int64), beyond


@dataclass
class Encoded:
    """Texts as symbols one after another, each after two begins and closed by its end.

    ``starts`` and ``ends`` bound each text's own symbols.
    """

    symbols: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, ends: np.ndarray, begin: int) -> Encoded:
        """From symbols without begins and the texts' ends among them."""
        shift = 2 * np.arange(1, len(ends) + 1)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) + shift
        out = np.full(len(symbols) + 2 * len(ends), begin, np.int32)
        real = np.ones(len(out), bool)
        real[starts - 1] = real[starts - 2] = False
        out[real] = symbols
        return cls(out, starts, ends + shift)

    def means(self, vectors: np.ndarray) -> np.ndarray:
        """The mean vector of all earlier symbols of the same text, zero at its begin; of no use at the begins."""
        total = _running_sums(vectors)
        length = self.ends - self.starts + 2
        place = np.arange(len(self.symbols)) - np.repeat(self.starts, length)
        # up to the symbol before, less what lies before the text
        out = total - vectors
        out -= np.repeat(total[self.starts - 1], length, axis=0)
        out /= np.maximum(place, 1)[:, None]
        return out.astype(np.float32)


def _running_sums(x: np.ndarray, block: int = 60) -> np.ndarray:
    """The sum of each row of ``x`` and all before it; blocks of rows are added up side by side."""
    cube = np.zeros((-(-len(x) // block), block, x.shape[1]))
    out = cube.reshape(-1, x.shape[1])[: len(x)]
    out[:] = x
    for k in range(1, block):
        cube[:, k] += cube[:, k - 1]
    cube[1:] += np.cumsum(cube[:-1, -1], axis=0)[:, None]
    return out


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sum of each one's values and how often it occurs."""
    order = rows.argsort(kind="stable" if rows.dtype.itemsize == 2 else None)
    rows = rows.take(order)
    fresh = np.empty(len(rows), bool)
    fresh[:1] = True
    np.not_equal(rows[1:], rows[:-1], out=fresh[1:])
    first = fresh.nonzero()[0]
    times = np.empty(len(first), np.int64)
    times[:-1] = first[1:] - first[:-1]
    times[-1:] = len(rows) - first[-1:]
    return rows[first], np.add.reduceat(values.take(order, axis=0), first), times


class LogBilinear:
    """Parameters of all symbols; ``of`` is the class of each symbol.

    Tables: own context vectors r, own output vectors q with the bias as last column, the same
    of the classes (s, t), and the three context weights c. Steps are those of Adagrad with
    one rate per row.
    """

    def __init__(self, of: np.ndarray, tables: dict[str, np.ndarray], noise: np.ndarray) -> None:
        self.of, self.tables, self.noise = of, tables, noise
        self.begin = len(noise)
        self.upto = np.cumsum(noise)
        self.log_kp = np.log(NOISE * noise).astype(np.float32)
        #: Of each row the sum of its squared gradients, from 1, and how often it was touched.
        self.steps = {name: np.tile(np.array([1, 0], np.float32), (len(x), 1)) for name, x in tables.items()}

    @classmethod
    def new(cls, vocabulary: Vocabulary) -> LogBilinear:
        rng = np.random.default_rng(SEED)
        counts = vocabulary.symbol_counts() + 1.0
        noise, n = counts / counts.sum(), len(counts)
        q = np.zeros((n, WIDTH + 1), np.float32)
        q[:, WIDTH] = np.log(noise)
        tables = {
            "r": np.zeros((n + 1, WIDTH), np.float32), "q": q, "s": rng.normal(0, 0.1, (CLASSES + 2, WIDTH)).astype(np.float32),
            "t": np.zeros((CLASSES + 2, WIDTH), np.float32), "c": np.ones((3, WIDTH), np.float32),
        }
        return cls(vocabulary.classes(), tables, noise)

    def input(self) -> np.ndarray:
        """The context vector of every symbol."""
        return self.tables["r"] + self.tables["s"][self.of]

    def output(self) -> tuple[np.ndarray, np.ndarray]:
        """Vector and bias of every symbol."""
        return self.tables["q"][:, :WIDTH] + self.tables["t"][self.of[: self.begin]], self.tables["q"][:, WIDTH]

    def contexts(self, text: Encoded, vectors: np.ndarray) -> np.ndarray:
        """The context vector g of every symbol of ``text``; vectors as of ``input``. Those of begins are of no use."""
        x, c = vectors.take(text.symbols, axis=0), self.tables["c"]
        out = text.means(x) * c[2]
        out[1:] += x[:-1] * c[0]
        out[2:] += x[:-2] * c[1]
        return out

    def _step(self, name: str, rows: np.ndarray, grad: np.ndarray, times: np.ndarray) -> None:
        table = self.tables[name]
        state = self.steps[name].take(rows, axis=0)
        state[:, 0] += np.einsum("ij,ij->i", grad, grad)
        state[:, 1] += times
        self.steps[name][rows] = state
        table[rows] = table.take(rows, axis=0) - (RATE * grad.shape[1] ** 0.5 / np.sqrt(state[:, :1])) * grad

    def train(self, symbols: np.ndarray, mean: np.ndarray, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation on runs of symbols.

        Each row of ``symbols`` has the two symbols before a run and the run; ``mean`` are the
        vectors of all earlier words, for each symbol of the run.
        """
        tables, c = self.tables, self.tables["c"]
        sample = np.searchsorted(self.upto, rng.random(NOISE)).clip(0, self.begin - 1)
        places, runs = symbols.ravel(), symbols.shape
        x = tables["r"].take(places, axis=0)
        x += tables["s"].take(self.of.take(places), axis=0)
        x = x.reshape(*runs, WIDTH)
        # a last column of ones meets the bias
        guess = np.ones((runs[0], runs[1] - 2, WIDTH + 1), np.float32)
        guess[:, :, :WIDTH] = x[:, 1:-1] * c[0] + x[:, :-2] * c[1] + mean * c[2]
        guess = guess.reshape(-1, WIDTH + 1)
        target = symbols[:, 2:].ravel()
        gone = np.flatnonzero(target == self.begin)
        n = len(target)
        out = np.concatenate([target, sample])
        out[gone] = 0
        rows = tables["q"].take(out, axis=0)
        rows[:, :WIDTH] += tables["t"].take(self.of.take(out), axis=0)
        rows[:, WIDTH] -= self.log_kp.take(out)
        true = np.einsum("ij,ij->i", guess, rows[:n])
        # the sigmoid of the noise scores, zero where there is no target
        df = guess @ -rows[n:].T
        with np.errstate(over="ignore"):
            np.exp(df, out=df)
            dt = -1 / (1 + np.exp(true))
        df += 1
        np.reciprocal(df, out=df)
        df[gone] = 0
        dt[gone] = 0
        dg = dt[:, None] * rows[:n, :WIDTH] + df @ rows[n:, :WIDTH]
        grad = np.empty((len(out), WIDTH + 1), np.float32)
        np.multiply(dt[:, None], guess, out=grad[:n])
        np.matmul(df.T, guess, out=grad[n:])
        at, total, times = _sums(out, grad)
        self._step("q", at, total, times)
        self._step("t", *_sums(self.of.take(at), total[:, :WIDTH]))
        dg = dg.reshape(*mean.shape)
        dx = np.zeros_like(x)
        dx[:, 1:-1] = dg * c[0]
        dx[:, :-2] += dg * c[1]
        weights = np.stack([np.einsum("ijk,ijk->k", dg, y) for y in (x[:, 1:-1], x[:, :-2], mean)])
        at, total, times = _sums(places, dx.reshape(-1, WIDTH))
        self._step("r", at, total, times)
        self._step("s", *_sums(self.of.take(at), total))
        self._step("c", np.arange(3), weights, np.full(3, n))

    def learn(self, text: Encoded, rng: np.random.Generator) -> None:
        """One pass over the tokens in runs of random order; the means are of the vectors before it."""
        symbols = text.symbols
        x = self.tables["r"].take(symbols, axis=0)
        x += self.tables["s"].take(self.of.take(symbols), axis=0)
        n = -(-(len(symbols) - 2) // RUN)
        padded = np.full(n * RUN + 2, self.begin, np.int32)
        padded[: len(symbols)] = symbols
        mean = np.zeros((n * RUN + 2, WIDTH), np.float32)
        mean[: len(symbols)] = text.means(x)
        runs, inner, order = np.lib.stride_tricks.sliding_window_view(padded, RUN + 2)[::RUN], mean[2:].reshape(n, RUN, WIDTH), rng.permutation(n)
        for lo in range(0, n, BATCH // RUN):
            at = order[lo : lo + BATCH // RUN]
            self.train(runs[at], inner[at], rng)


PARTS = "key string, lane int, rows binary, weights binary, vectors binary, width int"
_PARTS = pa.schema([("key", pa.string()), ("lane", pa.int32()), ("rows", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32())])


def _blocks(model: LogBilinear, lane: int) -> Iterator[pa.RecordBatch]:
    """The rows that were touched, in blocks of a table; half floats are precise enough for a mean."""
    for name, steps in model.steps.items():
        touched = steps[:, 1]
        rows = np.flatnonzero(touched)
        for block in np.unique(rows // BLOCK_ROWS).tolist():
            own = rows[(rows >= block * BLOCK_ROWS) & (rows < (block + 1) * BLOCK_ROWS)]
            values = model.tables[name][own].astype(np.float16)
            record = {"key": f"{name}:{block}", "lane": lane, "rows": (own - block * BLOCK_ROWS).astype(np.int16).tobytes(), "weights": touched[own].tobytes(), "vectors": values.tobytes(), "width": values.shape[1]}
            yield pa.RecordBatch.from_pylist([record], schema=_PARTS)


def _rows(part: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block and their vectors, which are half floats at first and floats after a sum."""
    rows = np.frombuffer(part["rows"], np.int16).astype(np.int64)
    kind = np.float16 if len(part["vectors"]) == 2 * part["width"] * len(rows) else np.float32
    return rows, np.frombuffer(part["vectors"], kind).reshape(-1, part["width"])


def _merged(parts: DataFrame, lanes: int, fan_in: int = 64) -> DataFrame:
    """One weighted mean per key of ``parts``, whose lanes are 0 to ``lanes`` - 1; a task adds up about ``fan_in`` parts of a key at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            for p in batch.to_pylist():
                rows, vectors = _rows(p)
                weights = np.frombuffer(p["weights"], np.float32)
                held = sums.setdefault((p["key"], p["lane"]), [np.zeros((BLOCK_ROWS, p["width"])), np.zeros(BLOCK_ROWS)])
                held[0][rows] += weights[:, None] * vectors
                held[1][rows] += weights
        for (key, lane), (total, weight) in sums.items():
            rows = np.flatnonzero(weight)
            mean = (total[rows] / weight[rows, None]).astype(np.float32)
            record = {"key": key, "lane": lane, "rows": rows.astype(np.int16).tobytes(), "weights": weight[rows].astype(np.float32).tobytes(), "vectors": mean.tobytes(), "width": mean.shape[1]}
            yield pa.RecordBatch.from_pylist([record], schema=_PARTS)

    held = None
    while held is None or lanes > 1:
        lanes = -(-lanes // fan_in)
        dealt = parts.withColumn("lane", F.expr(f"lane div {fan_in}").cast("int")).repartition(32 * lanes, "key", "lane")
        done = stored(dealt.mapInArrow(add, PARTS), "merged")
        if held is not None:
            discard(held)
        parts = held = done
    return parts


def _laid_out(batch: pa.RecordBatch, begin: int) -> Encoded:
    """The texts of a batch whose first column has their symbols, as bytes of ints."""
    ends = np.cumsum(_lengths(batch))
    return Encoded.of(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), ends, begin)


def _lengths(batch: pa.RecordBatch) -> np.ndarray:
    return pc.binary_length(batch.column(0)).to_numpy().astype(np.int64) // 4


def _round(encoded: DataFrame, model: LogBilinear, trainers: int, passes: int) -> LogBilinear:
    """The model after one round over ``encoded(symbols, h)``.

    The hash of a text gives it its trainer and its place there, so the model is the same however the rows
    were partitioned. A trainer is one task.
    """
    sent = encoded.sparkSession.sparkContext.broadcast((model.of, model.tables, model.noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, tables, noise = sent.value
        own, rng, lane = LogBilinear(of, {name: x.copy() for name, x in tables.items()}, noise), np.random.default_rng(SEED), None
        for part in _portions(batches, CHUNK):
            text, lane = _laid_out(part, own.begin), part.column(1)[0].as_py()
            for _ in range(passes):
                own.learn(text, rng)
        if lane is not None:
            yield from _blocks(own, lane)

    dealt = encoded.withColumn("lane", F.pmod("h", F.lit(trainers)).cast("int"))
    dealt = dealt.repartitionById(trainers, F.col("lane")).sortWithinPartitions("h").select("symbols", "lane")
    merged = _merged(dealt.mapInArrow(run, PARTS), trainers)
    tables = {name: x.copy() for name, x in model.tables.items()}
    for p in merged.drop("lane", "weights").toArrow().to_pylist():
        name, block = p["key"].split(":")
        rows, vectors = _rows(p)
        tables[name][int(block) * BLOCK_ROWS + rows] = vectors
    discard(merged)
    sent.destroy()
    return LogBilinear(model.of, tables, model.noise)


def _portions(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``limit`` symbols."""
    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum(_lengths(batch))
        at = 0
        while at < batch.num_rows:
            before = int(lengths[at - 1]) if at else 0
            end = int(np.searchsorted(lengths, before + limit - size, side="right"))
            if end <= at and held:
                # the next row goes into a batch of its own, wherever the batches before were cut
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
                continue
            end = max(at + 1, end)
            held.append(batch.slice(at, end - at))
            size += int(lengths[end - 1]) - before
            at = end
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def train_model(encoded: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    """The model after all rounds; every row of the stored ``encoded(symbols, h, row)`` is in one of them.

    Rows are dealt by ``h``, a hash of id and text, so copies of a text meet many trainers. Rows that share
    both and are more than half a task's share are dealt by ``row`` too.
    """
    model = LogBilinear.new(vocabulary)
    trainers = max(1, vocabulary.n_tokens // TRAINER_TOKENS)
    passes = int(np.clip(TRAINER_TOKENS // max(1, vocabulary.n_tokens), 1, PASSES))
    crowded = [k for k, _ in hot_keys(encoded, ["h"])]
    h = F.when(F.col("h").isin(crowded), F.xxhash64("h", "row")).otherwise(F.col("h")) if crowded else F.col("h")
    encoded = encoded.select("symbols", h.alias("h"))
    first = F.pmod(F.xxhash64(F.lit(SEED), "h"), F.lit(1 << 20)) < int(FIRST_ROUND * (1 << 20))
    model = _round(encoded.filter(first), model, max(1, int(trainers * FIRST_ROUND)), passes)
    return _round(encoded.filter(~first), model, trainers, passes)


@dataclass
class CodeBook:
    """Contexts in two levels: ``top`` of STATES vectors, under each of them STATES in ``low``."""

    top: np.ndarray
    low: np.ndarray

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        out, half = np.empty(len(x), np.int64), 0.5 * (centres * centres).sum(axis=1)
        for at in range(0, len(x), 1 << 14):
            near = x[at : at + (1 << 14)] @ centres.T
            near -= half
            out[at : at + (1 << 14)] = near.argmax(axis=1)
        return out

    @classmethod
    def _means(cls, x: np.ndarray, weights: np.ndarray, rng: np.random.Generator, many: int = STATES, turns: int = 12) -> np.ndarray:
        centres = x[rng.choice(len(x), many, p=weights / weights.sum())].copy() if len(x) else np.zeros((many, WIDTH), np.float32)
        for _ in range(turns if len(x) else 0):
            near = cls._nearest(x, centres)
            n = np.bincount(near, weights, many)
            rows = np.flatnonzero(n)
            total = np.stack([np.bincount(near, weights * x[:, k], many) for k in range(x.shape[1])], axis=1)
            centres[rows] = total[rows] / n[rows, None]
        return centres

    @classmethod
    def fit(cls, x: np.ndarray, weights: np.ndarray | None = None) -> CodeBook:
        """The code book of the points ``x``, each counted ``weights`` times."""
        rng, weights = np.random.default_rng(SEED), np.ones(len(x)) if weights is None else weights
        top = cls._means(x, weights, rng)
        group = cls._nearest(x, top) if len(x) else np.zeros(0, np.int64)
        own = lambda at: cls._means(x[at], weights[at], rng)
        low = np.stack([own(group == k) if (group == k).any() else np.repeat(top[k : k + 1], STATES, axis=0) for k in range(STATES)])
        return cls(top, low)

    def states(self, x: np.ndarray) -> np.ndarray:
        group = self._nearest(x, self.top)
        order = group.astype(np.uint8).argsort(kind="stable")
        edges = np.searchsorted(group[order], np.arange(STATES + 1))
        out = np.empty(len(x), np.int64)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[k] : edges[k + 1]]
            out[at] = k * STATES + self._nearest(x[at], self.low[k])
        return out


class Cells:
    """A table of ``CELLS`` cells over contexts, laid by the model and the counts of the whole corpus.

    The symbols are grouped by what they add to a context, once as the word before and once as the one before that; the mean of earlier
    words is halved along its widest axes. Every context is in one cell, which look-ups find.
    """

    def __init__(self, model: LogBilinear) -> None:
        x, c, rng = model.input(), model.tables["c"], np.random.default_rng(SEED)
        # no context has the end, as many have the begin
        weights = np.append(model.noise, model.noise[-1])
        self.last, self.other = (CodeBook._nearest(y, CodeBook._means(y, weights, rng, many)).astype(np.int32) for y, many in ((x * c[0], LAST_GROUPS), (x * c[1], OTHER_GROUPS)))
        x = x * c[2]
        middle = weights @ x / weights.sum()
        self.axes = np.linalg.eigh(((x - middle) * weights[:, None]).T @ (x - middle))[1][:, -HALVINGS:].astype(np.float32)
        self.middle = (middle @ self.axes).astype(np.float32)

    def places(self, model: LogBilinear, vectors: np.ndarray, text: Encoded, g: np.ndarray) -> np.ndarray:
        """The cell of each context ``g`` of ``text``; vectors as of ``model.input``. Those of begins are of no use."""
        before, other = np.roll(text.symbols, 1), np.roll(text.symbols, 2)
        # the mean is what the two words leave of a context
        mean, c = g @ self.axes, model.tables["c"]
        mean -= (vectors @ (self.axes * c[0][:, None])).take(before, axis=0)
        mean -= (vectors @ (self.axes * c[1][:, None])).take(other, axis=0)
        side = (mean > self.middle) @ (1 << np.arange(HALVINGS))
        return ((self.last.take(before) * OTHER_GROUPS + self.other.take(other)) << HALVINGS) + side


_CELLS = pa.schema([("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary())])


def summed_contexts(encoded: DataFrame, model: LogBilinear) -> tuple[np.ndarray, np.ndarray]:
    """Means and counts of the contexts of every token of ``encoded(symbols)``, for each cell that has any.

    Tasks send a row per block of cells, and a row per block reaches the driver.
    """
    sent = encoded.sparkSession.sparkContext.broadcast((model, Cells(model)))
    size = CELLS // CELL_BLOCKS

    def rows(counts: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for block in range(CELL_BLOCKS):
            at = block * size + np.flatnonzero(counts[block * size : (block + 1) * size])
            if len(at):
                record = {"block": block, "cells": at.astype(np.int32).tobytes(), "counts": counts[at].tobytes(), "sums": sums[at].astype(np.float32).tobytes()}
                yield pa.RecordBatch.from_pylist([record], schema=_CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cells = sent.value
        vectors = own.input()
        counts, sums = np.zeros(CELLS, np.int64), np.zeros((CELLS, WIDTH))
        for part in _portions(batches, CHUNK):
            text = _laid_out(part, own.begin)
            g, real = own.contexts(text, vectors), text.symbols != own.begin
            at, g = cells.places(own, vectors, text, g)[real], g[real]
            counts += np.bincount(at, minlength=CELLS)
            filled, total, _ = _sums(at.astype(np.uint16), g)
            sums[filled] += total
        yield from rows(counts, sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(CELLS, np.int64), np.zeros((CELLS, WIDTH))
        for batch in batches:
            for p in batch.to_pylist():
                at = np.frombuffer(p["cells"], np.int32)
                counts[at] += np.frombuffer(p["counts"], np.int64)
                sums[at] += np.frombuffer(p["sums"], np.float32).reshape(-1, WIDTH)
        yield from rows(counts, sums)

    found = encoded.mapInArrow(run, "block int, cells binary, counts binary, sums binary").repartition(CELL_BLOCKS, "block")
    found = sorted(found.mapInArrow(add, "block int, cells binary, counts binary, sums binary").collect())
    sent.destroy()
    counts = np.frombuffer(b"".join(r.counts for r in found), np.int64)
    sums = np.frombuffer(b"".join(r.sums for r in found), np.float32).reshape(-1, WIDTH)
    return sums / counts[:, None].astype(np.float32), counts


def fit_code_book(encoded: DataFrame, model: LogBilinear) -> CodeBook:
    """The code book of the contexts of every token of ``encoded(symbols)``."""
    return CodeBook.fit(*summed_contexts(encoded, model))


def encode_texts(thin: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Stored ``(row, h, doc_id, held_out, symbols, tail)`` of ``thin(doc_id, text, held_out)``; tail counts the words outside the head."""
    sent = thin.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in by_size(batch, 1, TEXT_BYTES):
                symbols, ends, beyond = known.encode(part.column(1).cast(pa.binary()).to_pylist())
                found = [Counter(words) for words in beyond]
                flat = [pa.array([w for c in found for w in c], pa.binary()), pa.array([k for c in found for k in c.values()], pa.int64())]
                tails = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(flat, ["word", "tf"]))
                data, cuts = symbols.tobytes(), [0, *(4 * ends).tolist()]
                own = pa.array([data[s:e] for s, e in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), own, tails], names=["doc_id", "held_out", "symbols", "tail"])

    found = thin.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, symbols binary, tail array<struct<word: binary, tf: long>>")
    h = F.xxhash64(F.lit(SEED + 2), "doc_id", "symbols")
    encoded = stored(found.withColumn("row", F.monotonically_increasing_id()).withColumn("h", h), "encoded")
    sent.destroy()
    return encoded


def normalisers(low: np.ndarray, vectors: np.ndarray, bias: np.ndarray, rows: int = 16) -> np.ndarray:
    """The log of the summed exponentials of all symbols' scores, for each context vector."""
    out = np.empty(len(low))
    for lo in range(0, len(low), rows):
        s = low[lo : lo + rows] @ vectors.T + bias
        top = s.max(axis=1)
        out[lo : lo + rows] = top + np.log(np.exp(s - top[:, None]).sum(axis=1, dtype=np.float64))
    return out


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    Rows whose crc32(id) mod 10 is 0 are held out of all learning. Scores are log10
    probabilities of the text and its end. Null and empty texts consist of the end token.
    Repeated rows count each in learning and all return. With nothing to learn from, counts are 0 and the model is near uniform over symbols.
    """
    spark = docs.sparkSession
    thin = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    thin = thin.withColumn("held_out", crc_remainder(F.col("doc_id"), HELD_OUT_OF) == 0)
    learnt = thin.filter(~F.col("held_out"))
    counted = stored(count_words(learnt.select("text")), "words")
    vocabulary = Vocabulary.of(counted, learnt.select("doc_id").count())
    encoded = encode_texts(thin, vocabulary)
    learnt = encoded.filter(~F.col("held_out"))
    model = train_model(learnt.select("symbols", "h", "row"), vocabulary)
    model.steps = {}
    book = fit_code_book(learnt.select("symbols"), model)
    # the words themselves are not needed any more
    small = Vocabulary({}, vocabulary.counts, vocabulary.n_end, vocabulary.n_tokens, vocabulary.n_types, vocabulary.class_tokens, vocabulary.class_types)
    vocabulary = small
    sent = spark.sparkContext.broadcast((small, model, book))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, own, held = sent.value
        vectors, bias = own.output()
        for batch in batches:
            for k in batch.column(0).to_pylist():
                z = normalisers(held.low[k], vectors, bias)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([z.tobytes()], pa.binary())], names=["k", "z"])

    found = spark.range(STATES).repartition(16).mapInArrow(blocks, "k long, z binary").collect()
    norms = spark.sparkContext.broadcast(np.concatenate([np.frombuffer(r.z, float) for r in sorted(found)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own, held = sent.value
        inner, (vectors, bias) = own.input(), own.output()
        states, norm, n_head, end = held.low.reshape(-1, WIDTH), norms.value, len(known.counts), own.begin - 1
        symbol_counts = np.concatenate([np.log10(known.counts + SMOOTH), np.zeros(CLASSES), [np.log10(known.n_end + SMOOTH)]])
        share = np.zeros(end + 1)
        share[n_head:end] = -np.log10(known.class_tokens + SMOOTH * (known.class_types + 1))
        per_token = np.log10(known.n_tokens + SMOOTH * (known.n_types + 1))
        for part in _portions(batches, CHUNK):
            text = _laid_out(part, own.begin)
            n = text.ends - text.starts
            first = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)[:-1]])
            real = text.symbols != own.begin
            symbols, g = text.symbols[real], own.contexts(text, inner)[real]
            log_p = np.empty(len(symbols))
            for at in range(0, len(symbols), 1 << 14):
                here = slice(at, at + (1 << 14))
                s, w = held.states(g[here]), symbols[here]
                log_p[here] = np.einsum("ij,ij->i", states[s], vectors[w]) + bias[w] - norm[s]
            add = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
            n_known = add((symbols < n_head).astype(np.int64)) + (known.n_end > 0)
            base = add(symbol_counts[symbols]) - n * per_token
            # a class word has the class's probability, then its share: the count comes by the join
            cols = [pa.array(n, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(add(log_p) / np.log(10) + add(share[symbols]))]
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), *cols], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"])

    scored = encoded.select("symbols", "row", "doc_id", "held_out").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"
    )
    tail = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf")
    tail = tail.join(counted, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))).alias("known"), F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("logs")
    )
    both = scored.join(tail, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
