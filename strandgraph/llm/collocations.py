"""Phrase collocation mining: sketch upper bounds choose candidates, automata count them exactly.

A text is cut at punctuation into pieces and those into words; a phrase is two to four words that stand
together in a piece, and everything is counted per language.

1. Words are counted exactly. A count-min sketch in one row of 2^40 cells then takes the pairs of
   frequent words, and after it the triples and quadruples whose pairs are all frequent by the sketch.
   Tasks send each of their cells once, with its partial count, so its size follows the data. A cell's
   count is an upper bound of its phrases' counts. What goes back to the workers is one bit per cell, for the cells
   that reach the threshold, in bitmaps of fixed size: with more cells they let more phrases through, and never lose one.
2. The phrases of the cells above the threshold are the candidates. Texts are reduced to the
   runs of words whose neighbouring pairs pass, which hold every occurrence of every candidate.
3. The candidates that stand in a portion of the runs are compiled into an Aho-Corasick automaton, which scans that portion. A key has a
   delimiter on both sides and so has each word of the scanned text, so matches begin and end with words; they may
   overlap. Tasks send their phrases with partial counts in lists by bucket, and the threshold is applied to the sums.

An automaton is bounded, and the runs are read once at any number of candidates. Scores and the tests for longer
phrases are joins on the counted phrases, in exact arithmetic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.common import by_size, col, discard, in_filter, key_filter, stored
from strandgraph.operators.skew import spread_join

MAX_WORDS, LEAST, TOP, SHARE = 4, 30, 2000, 80
#: Candidates of one automaton: some 250 bytes each.
BLOCK = 500_000
#: Bytes of text that a task works on at once, and of one stored run of words.
PORTION, RUN = 3 << 20, 256 << 10
#: The same for runs that are scanned, beside whose text stands an automaton.
SCANNED = 3 << 19
#: Cells, words or phrases that a task holds before it sends them on.
HELD = 2_000_000
#: The sketch has 2 to this power cells.
CELL_BITS = 40
#: Candidates whose counts meet in one bucket, on average.
BUCKET = 50_000
#: Stands for the end of a piece among the words; no byte of UTF-8.
BREAK = b"\xff"
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLD = bytes(BREAK[0] if b in ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Groups in which the first phrases of a language are found before they meet.
SALTS = 64


def normalised(texts: list[bytes]) -> bytes:
    """The texts folded to words with white space around each, and a break between pieces."""
    return (b" " + BREAK + b" ").join(texts).translate(FOLD).replace(BREAK, b" " + BREAK + b" ")


def word_key(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, zlib.crc32(lang.encode()))


class Coded:
    """Texts of one language as codes into their distinct words, each with a 64-bit key."""

    def __init__(self, lang: str, texts: list[bytes], keyed: bool = True):
        cut = pc.ascii_split_whitespace(pa.array([normalised(texts)], pa.binary()).view(pa.string())).flatten()
        encoded = cut.view(pa.binary()).dictionary_encode()
        self.codes = encoded.indices.to_numpy()
        self.words = encoded.dictionary.to_pylist()
        if keyed:
            seed = zlib.crc32(lang.encode())
            self.keys = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.real = np.array([w != BREAK and w != b"" for w in self.words], bool)


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(29))


def full_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """The 64-bit hash of the phrase of ``n`` words that begins at each word."""
    out = keys
    for k in range(1, n):
        out = _mixed(out[:-1]) + keys[k:]
    return _mixed(out + np.uint64(n))


def phrase_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """The sketch's cell of that phrase."""
    return (full_keys(keys, n) >> np.uint64(64 - CELL_BITS)).view(np.int64)


def _portions(batches: Iterator[pa.RecordBatch], limit: int = PORTION) -> Iterator[tuple[str, list[bytes]]]:
    """``(lang, texts)`` of about ``limit`` bytes over all languages; a longer text comes alone."""
    held, size = {}, 0
    for batch in batches:
        for part in by_size(batch, 1, limit):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).view(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= limit:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _text(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).view(pa.string())


def _same(value: str | None, n: int) -> pa.Array:
    return pa.array([value] * n, pa.string())


class Cells:
    """Partial counts of cells, summed over a task's portions; they leave when ``HELD`` different ones are there, and at the end."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array]]:
        own, counts = np.unique(keys, return_counts=True)
        if not len(own):
            return
        merged = np.concatenate([self.keys, own])
        order = merged.argsort(kind="stable")
        merged, counts = merged[order], np.concatenate([self.counts, counts])[order]
        first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
        self.keys, self.counts = merged[first], np.add.reduceat(counts, first)
        if len(self.keys) > HELD:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[pa.Array, pa.Array]]:
        if len(self.keys):
            yield pa.array(self.keys), pa.array(self.counts)
        self.__init__()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, word, n)``; the row without a word has the sum of all."""
    held: dict[str, dict[bytes, int]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            yield _batch(lang=_same(lang, len(words)), word=_text(list(words)), n=pa.array(list(words.values()), pa.int64()))
        held.clear()

    for lang, texts in _portions(batches):
        coded = Coded(lang, texts, keyed=False)
        counts = np.bincount(coded.codes, minlength=len(coded.words)).tolist()
        known, every = held.setdefault(lang, {}), 0
        for word, n, real in zip(coded.words, counts, coded.real.tolist(), strict=True):
            if real:
                every += n
                known[word] = known.get(word, 0) + n
        yield _batch(lang=_same(lang, 1), word=_same(None, 1), n=pa.array([every]))
        if sum(map(len, held.values())) > HELD // 8:
            yield from sent()
    yield from sent()


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(1).view(pa.binary()).to_pylist()
        keys = [word_key(lang, word) for lang, word in zip(batch.column(0).to_pylist(), words, strict=True)]
        yield _batch(key=pa.array(np.array(keys, np.uint64).view(np.int64)))


def _pairs_of(coded: Coded, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys at each word, places of pairs of frequent words, and the keys of those pairs."""
    good = (coded.real & in_filter(words, coded.keys.view(np.int64)))[coded.codes]
    keys = coded.keys[coded.codes]
    at = np.flatnonzero(good[:-1] & good[1:])
    return keys, at, phrase_keys(keys, 2)[at] if len(keys) > 1 else np.zeros(0, np.int64)


def _sketch_pairs(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells()
        for lang, texts in _portions(batches):
            for key, n in cells.add(_pairs_of(Coded(lang, texts), sent.value)[2]):
                yield _batch(key=key, n=n)
        for key, n in cells.rest():
            yield _batch(key=key, n=n)

    return run


def _cut_runs(sent: Broadcast):
    """The runs of words whose pairs pass, and the sketch of the longer phrases in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = sent.value
        cells = Cells()
        sketch = lambda key, n: _batch(lang=_same(None, len(key)), text=_same(None, len(key)), key=key, n=n)
        for lang, texts in _portions(batches):
            coded = Coded(lang, texts)
            keys, at, pair = _pairs_of(coded, words)
            linked = np.zeros(len(keys) + 1, bool)
            linked[at[in_filter(pairs, pair)]] = True
            found, together = [], linked[:-1]
            for n in range(3, MAX_WORDS + 1):
                together = together[:-1] & linked[n - 2 : len(keys)]
                starts = np.flatnonzero(together[: max(0, len(keys) - n + 1)])
                found.append(phrase_keys(keys, n)[starts] if len(starts) else np.zeros(0, np.int64))
            for key, n in cells.add(np.concatenate(found)):
                yield sketch(key, n)
            before = np.append(False, linked[:-1])[: len(keys)]
            inside, starts = linked[:-1] | before, linked[:-1] & ~before
            place = np.cumsum(inside) - 1
            chosen = np.insert(coded.codes[inside], place[starts], len(coded.words))
            named = [*coded.words, b"\n"]
            joined, at, rows = b" ".join(map(named.__getitem__, chosen.tolist())), 0, []
            while at < len(joined):
                end = joined.find(b"\n", at + RUN)
                end = len(joined) if end < 0 else end
                rows.append(joined[at:end])
                at = end
            for k in range(0, len(rows), 16):
                part = rows[k : k + 16]
                none = pa.nulls(len(part), pa.int64())
                yield _batch(lang=_same(lang, len(part)), text=_text(part), key=none, n=none)
        for key, n in cells.rest():
            yield sketch(key, n)

    return run


def automaton(phrases: list[bytes]) -> ahocorasick.Automaton:
    """Its keys are the phrases' bytes between delimiters."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):
        out.add_word(" " + phrase.decode("latin-1") + " ", k)
    out.make_automaton()
    return out


def matches(phrases: list[bytes], text: bytes, block: int) -> np.ndarray:
    """How often each of ``phrases`` stands in ``text``, by automata of ``block`` phrases."""
    found, decoded = [np.zeros(0, np.int64)], text.decode("latin-1")
    for at in range(0, len(phrases), block):
        own = phrases[at : at + block]
        found.append(np.bincount(np.fromiter((k for _, k in automaton(own).iter(decoded)), np.int64), minlength=len(own)))
    return np.concatenate(found)


#: Sorted phrases of a bucket and their counts, both compressed; the phrases' bytes, and the bytes of a count.
LISTS = "bucket int, lang string, phrases binary, counts binary, size long, width int"


def _scan(sent: Broadcast, buckets: int, block: int):
    """Rows of ``LISTS``: the phrases of the runs whose cells pass and a task's matches of them, in sorted lists by bucket of their cell.

    The automata of a portion of text have just the candidates that stand in it, so a text is read once however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], dict[bytes, int]] = {}
        size = 0

        def lists() -> Iterator[pa.RecordBatch]:
            for (bucket, lang), counted in held.items():
                phrases = sorted(counted)
                counts = np.array([counted[p] for p in phrases], np.uint64)
                counts = counts.astype(np.min_scalar_type(counts.max()))
                joined = b"\n".join(phrases)
                packed = [pa.array([pa.compress(x, "zstd", asbytes=True)], pa.binary()) for x in (joined, counts.tobytes())]
                yield _batch(bucket=pa.array([bucket], pa.int32()), lang=_same(lang, 1), phrases=packed[0], counts=packed[1], size=pa.array([len(joined)]), width=pa.array([counts.itemsize], pa.int32()))
            held.clear()

        for lang, texts in _portions(batches, SCANNED):
            coded = Coded(lang, texts)
            real, keys = coded.real[coded.codes], coded.keys[coded.codes]
            whole, cells, phrases = real, [], []
            for n in range(2, MAX_WORDS + 1):
                if len(keys) < n:
                    break
                whole = whole[:-1] & real[n - 1 :]
                at = np.flatnonzero(whole)
                key = phrase_keys(keys, n)[at]
                passed = in_filter(sent.value, key)
                # two phrases of one cell would be taken for one, so the full hash tells them apart
                full = full_keys(keys, n)[at[passed]]
                _, first = np.unique(full, return_index=True)
                spans = coded.codes[at[passed][first][:, None] + np.arange(n)]
                cells += (key[passed][first] % buckets).tolist()
                phrases += [b" ".join([coded.words[c] for c in span]) for span in spans.tolist()]
            text = b" " + b" ".join(map(coded.words.__getitem__, coded.codes.tolist())) + b" "
            for bucket, phrase, n in zip(cells, phrases, matches(phrases, text, block).tolist(), strict=True):
                own = held.setdefault((bucket, lang), {})
                if phrase in own:
                    own[phrase] += n
                else:
                    own[phrase] = n
                    size += 1
            if size > HELD // 8:
                yield from lists()
                size = 0
        yield from lists()

    return run


def _sum_lists(least: int):
    """``(lang, phrase, n)`` of at least ``least`` matches; the lists of a bucket come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for (_, lang), parts in groupby(rows, itemgetter(0, 1)):
            total: dict[str, int] = {}
            for _, _, some, counts, size, width in parts:
                phrases = pa.decompress(some, size, "zstd", asbytes=True).decode().split("\n")
                counts = pa.decompress(counts, width * len(phrases), "zstd", asbytes=True)
                for phrase, n in zip(phrases, np.frombuffer(counts, f"u{width}").tolist(), strict=True):
                    total[phrase] = total.get(phrase, 0) + n
            found = [(phrase, n) for phrase, n in total.items() if n >= least]
            yield _batch(lang=_same(lang, len(found)), phrase=pa.array([phrase for phrase, _ in found], pa.string()), n=pa.array([n for _, n in found], pa.int64()))

    return run


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(phrases(lang, phrase, n), words(lang, word, n))`` of at least ``least`` occurrences, stored; exact.

    The row of ``words`` without a word has the number of all words of its language. A null
    language is ``und``, a null text is empty.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(counted.filter((F.col("n") >= least) | F.col("word").isNull()), "words")

    def heavy(cells: DataFrame) -> np.ndarray:
        return key_filter(cells.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))

    frequent = key_filter(words.filter("word is not null").select("lang", "word").mapInArrow(_word_keys, "key long"))
    sent = spark.sparkContext.broadcast(frequent)
    pairs = heavy(texts.mapInArrow(_sketch_pairs(sent), "key long, n long"))
    both = spark.sparkContext.broadcast((frequent, pairs))
    runs = stored(texts.mapInArrow(_cut_runs(both), "lang string, text string, key long, n long"), "runs")
    longer = heavy(runs.filter("key is not null"))
    passing = pairs | longer
    cells = spark.sparkContext.broadcast(passing)
    held = runs.filter("text is not null").select("lang", "text")
    # a cell passes for each bit that is set, and more phrases than bits only where cells share one
    buckets = 1 + int(np.bitwise_count(passing).sum()) // BUCKET
    lists = held.mapInArrow(_scan(cells, buckets, block), LISTS).repartition("bucket").sortWithinPartitions("bucket", "lang")
    phrases = stored(lists.mapInArrow(_sum_lists(max(1, least)), "lang string, phrase string, n long"), "phrases")
    for old in (sent, both, cells):
        old.unpersist()
    discard(runs)
    return phrases, words.select("lang", "word", "n")


def _exact(value: Column, digits: int = 19) -> Column:
    return value.cast(f"decimal({digits},0)")


def cut_scores(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)``: the lowest-scoring cut of each phrase in two.

    A frequent first or last word takes part in very many cuts; such keys are dealt to several tasks.
    """
    known = phrases.select("lang", F.col("phrase").alias("part"), "n").unionByName(words.filter("word is not null").select("lang", F.col("word").alias("part"), "n"))
    w = F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice(w, start, size), " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = stored(cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size(w) - F.col("k")).alias("rest")), "cuts")
    left = spread_join(cuts, known.select("lang", F.col("part").alias("first"), F.col("n").alias("l")), ["lang", "first"], "phrase")
    left = stored(left, "cuts")
    both = spread_join(left, known.select("lang", F.col("part").alias("rest"), F.col("n").alias("r")), ["lang", "rest"], "phrase")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))").alias("score")
    least = both.select("lang", "phrase", "a", F.struct(score, "k", "l", "r").alias("cut"))
    return least.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def inside_longer(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, longest)``: the greatest count of a longer phrase around each phrase."""
    w = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda at: F.array_join(F.slice(w, at, n), " "))))
    return phrases.filter(F.size(w) > 2).select("lang", F.explode(spans).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def first_per_language(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their rank: first within salted groups, then among what those leave."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, share: int = SHARE, block: int = BLOCK
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of two to four words.

    a: the phrase's occurrences, l and r: those of its parts at the lowest-scoring cut, n: all
    words of the language; score is floor(2000000 a / (l + r)). Phrases that stand in a longer one of
    at least ``share`` percent of their count are left out. Ties go to the greater count, then
    to the smaller phrase by its bytes.

    A null language is ``und``, a null or empty text has no words, repeated rows count each, other columns
    and their names play no part, an empty table gives no rows. A very long text is worked on whole, in memory of some
    twenty times its size.
    """
    phrases, words = phrase_counts(docs, text_col=text_col, lang_col=lang_col, least=least, block=block)
    kept = cut_scores(phrases, words).join(inside_longer(phrases), ["lang", "phrase"], "left")
    kept = kept.filter(F.col("longest").isNull() | (100 * _exact(F.col("longest")) < share * _exact(F.col("a"))))
    ranked = first_per_language(kept.drop("longest"), top)
    return ranked.join(words.filter("word is null").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
