"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

Texts are cut at the vocabulary's added tokens and by its pre-tokenizer pattern. The
distinct unseen pre-tokens of a batch lie end to end in one numpy array of symbols. In
each round every sequence finds its lowest-ranked adjacent pair, all places of that pair
merge at once from left to right, and sequences without a ranked pair retire. Merging all
places at once equals one merge at a time because a symbol is made by one merge only and
every merge that uses it has a higher rank; loading a vocabulary verifies this.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from strandgraph.llm.common import col

#: Fixed value: the published byte-level pre-tokenizer pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES, CACHE_LENGTH, ROUND_SYMBOLS = 400_000, 64, 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in such vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class BpeCounter:
    """Counts tokens as the vocabulary's library does with its default settings."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        added = [t["content"] for t in spec["added_tokens"]]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only byte-level vocabularies without normalizer, prefix space or stripping added tokens")
        vocab, bytes_of = model["vocab"], byte_alphabet()
        self.symbol_of_byte = np.zeros(256, np.int64)
        for char, byte in bytes_of.items():
            self.symbol_of_byte[byte] = vocab[char]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = np.full(len(vocab) + 1, -1, np.int64)
        born[made] = np.arange(len(merges))
        if len(np.unique(made)) != len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("merging all places of a pair at once is not exact for this vocabulary")
        self.none = len(merges)
        self.made = made
        keys = left << 32 | right
        self._table(keys)
        self.split = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}

    def _table(self, keys: np.ndarray) -> None:
        """Open-addressing table of pair -> rank, filled and probed with whole arrays."""
        self.bits = int(np.ceil(np.log2(len(keys) + 1))) + 3
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, self.none, np.int64)
        todo, ranks, step = keys, np.arange(len(keys)), 0
        while len(todo):
            at = (self._hash(todo) + step) & ((1 << self.bits) - 1)
            free = self.slot_key[at] == -1
            first = np.zeros(len(at), bool)
            first[np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_rank[at[put]] = todo[put], ranks[put]
            todo, ranks, step = todo[~put], ranks[~put], step + 1
        self.probes = step

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, size = a << 32 | b, (1 << self.bits) - 1
        slot = self._hash(keys)
        out = np.where(self.slot_key[slot] == keys, self.slot_rank[slot], self.none)
        open_ = np.flatnonzero((self.slot_key[slot] != keys) & (self.slot_key[slot] != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + step) & size
            got = self.slot_key[at] == keys[open_]
            out[open_[got]] = self.slot_rank[at[got]]
            open_ = open_[~got & (self.slot_key[at] != -1)]
        return out

    def count_sequences(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each byte sequence."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = lengths.copy()
        symbols = self.symbol_of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        alive = np.flatnonzero(lengths > 1)
        symbols = symbols[np.repeat(lengths > 1, lengths)]
        size = lengths[alive]
        while len(alive):
            ends = np.cumsum(size)
            owner = np.repeat(np.arange(len(alive)), size)
            rank = np.full(len(symbols), self.none, np.int64)
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
            rank[ends - 1] = self.none
            low = np.minimum.reduceat(rank, ends - size)
            merge = (rank == low[owner]) & (rank < self.none)
            # places of one pair overlap only in runs of one symbol: take every other from the left
            place = np.arange(len(merge))
            run = place - np.maximum.accumulate(np.where(merge, -1, place))
            merge &= run % 2 == 1
            symbols[merge] = self.made[rank[merge]]
            keep = np.ones(len(symbols), bool)
            keep[np.flatnonzero(merge) + 1] = False
            size = size - np.add.reduceat(merge.astype(np.int64), ends - size)
            counts[alive] = size
            go = (low < self.none) & (size > 1)
            keep &= go[owner]
            symbols, alive, size = symbols[keep], alive[go], size[go]
        return counts

    def _learn(self, unseen: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        at = 0
        while at < len(unseen):
            part, size = [], 0
            while at < len(unseen) and (not part or size < ROUND_SYMBOLS):
                part.append(unseen[at].encode("utf-8"))
                size += len(part[-1])
                at += 1
            out.update(zip(unseen[at - len(part) : at], self.count_sequences(part).tolist(), strict=True))
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        words, ends, special = [], [], []
        for text in texts:
            n = 0
            if text:
                parts = self.split.split(text) if self.split else [text]
                n = len(parts) - 1
                for part in parts:
                    words += self.words.findall(part)
            special.append(n)
            ends.append(len(words))
        if not words:
            return special
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        known = list(map(self.cache.get, words))
        if None in known:
            learnt = self._learn(list({w for w, k in zip(words, known, strict=True) if k is None}))
            known = [learnt[w] if k is None else k for w, k in zip(words, known, strict=True)]
            self.cache.update((w, n) for w, n in learnt.items() if len(w) <= CACHE_LENGTH)
        total = np.r_[0, np.cumsum(known)][np.r_[0, ends]]
        return (np.diff(total) + special).tolist()


@lru_cache(maxsize=2)
def counter(path: str) -> BpeCounter:
    return BpeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    ``vocabulary`` is the file's path; it is sent to the executors with the job. Null and
    empty texts have no bytes and no tokens.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(SparkFiles.get(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                n = bpe.counts(texts)
                size = [len((t or "").encode("utf-8")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
