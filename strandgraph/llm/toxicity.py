"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features come from the text alone: densities of fixed and of one learnt lexicon, lexicon words
near second-person words, capitals, punctuation and obfuscation. The trees are grown in
numpy on a bounded sample of labelled rows (``SAMPLE`` by hash order of the id). Learnt
terms are words and word stems (beginnings, marked by a star) that stand mostly in toxic
texts; texts with the same least word hashes count once, so copies lend no weight. Trees
see learnt terms and calibration sees margins from the other folds only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.llm.common import col, crc_remainder, fresh, stored

SAMPLE, FOLDS, LEARNT_TERMS, STEMS = 20_000, 3, 400, (4, 5, 6, 7)
#: A learnt term stands in so many toxic texts at least (the first number where there are few, one in
#: ``RAMP`` of them up to the second), in this share of them, and mostly in toxic ones. The first
#: number was chosen by cross-validation on the training rows.
LEARNT_DOCS, RAMP, LEARNT_SHARE, PURITY = (3, 6), 60, 0.004, 0.6
#: Common words of abuse by kind, and second-person words.
INSULTS = """idiot moron clown loser trash scum worthless pathetic disgusting stupid dumb dumbass imbecile
 cretin fool foolish jerk scumbag garbage filth filthy vermin swine coward creep freak weirdo
 lunatic psycho retard retarded brainless clueless useless hopeless ugly fat hideous repulsive vile nasty
 despicable contemptible shameful laughable ridiculous twit halfwit nitwit dimwit dunce buffoon degenerate
 parasite leech maggot idiotic moronic asinine ignorant liar fraud crook thug brat snob sucker
 idiota imbécil estúpido estúpida tonto basura asqueroso patético idiot dumm dummkopf trottel arschloch
 abschaum widerlich erbärmlich wertlos imbécile crétin stupide abruti minable ordure dégoûtant""".split()
PROFANITY = """damn crap shit shitty bullshit fuck fucking fucker motherfucker bitch bastard ass asshole
 arse dick prick cunt whore slut piss bollocks wanker puta mierda joder scheisse scheiße merde putain connard
 salope""".split()
THREATS = """kill murder destroy hurt beat stab shoot burn hang hate despise loathe exterminate crush
 strangle choke punch smash""".split()
SECOND = frozenset("you your yours yourself u ur youre du dich dir dein deine ihr euch tu te toi ton ta tes vous usted ustedes tú".split())
_GROUPS = (frozenset(INSULTS), frozenset(PROFANITY), frozenset(THREATS))
_ALL = frozenset().union(*_GROUPS)
_LEET = str.maketrans({"@": "a", "4": "a", "0": "o", "1": "i", "!": "i", "3": "e", "$": "s", "5": "s", "7": "t", "9": "g", "*": None, ".": None, "_": None, "-": None})
_OUTER = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»…“”‘’"
_WORD, _TRIPLE = re.compile(r"[^\W\d_]+"), re.compile(r"([a-z])\1\1")
_RUN, _SPACED = re.compile(r"(.)\1{2,}"), re.compile(r"(?<![^\W\d_])(?:[a-z][ .*-]){3,}[a-z](?![^\W\d_])")
_BANGS, _SHOUT = re.compile(r"[!?]{2,}"), re.compile(r"\b[A-Z]{3,}\b")
NAMES = ["words", "insults", "profanity", "threats", "lexicon_count", "learnt", "learnt_count", "near_you", "second", "capitals", "shouting", "bangs", "bang_runs", "punctuation", "digits", "odd_tokens", "masked_hits"]


def _in_lexicon(word: str, lexicon: frozenset[str]) -> bool:
    return word in lexicon or (word[-1:] == "s" and word[:-1] in lexicon)


def _unmasked(token: str) -> bool:
    """Whether a token with symbols among its letters spells a lexicon word."""
    if _in_lexicon(token.translate(_LEET), _ALL):
        return True
    if "*" not in token:
        return False
    return any(len(w) == len(token) and all(a in ("*", b) for a, b in zip(token, w, strict=True)) for w in _ALL if w[0] == token[0])


def in_learnt(word: str, learnt: frozenset[str]) -> bool:
    """Whether a learnt word or stem matches."""
    return word in learnt or (len(word) > STEMS[0] and any(word[:k] + "*" in learnt for k in STEMS if len(word) > k))


def features(text: str | None, learnt: frozenset[str]) -> list[float]:
    text = text or ""
    lower = text.lower()
    words = _WORD.findall(lower)
    n = max(1, len(words))
    kinds = set(words)
    known = {w for w in kinds if w in _ALL or (w[-1:] == "s" and w[:-1] in _ALL)}
    hits = [(i, w) for i, w in enumerate(words) if w in known] if known else []
    groups = [sum(1 for _, w in hits if _in_lexicon(w, g)) for g in _GROUPS]
    terms = {w for w in kinds if in_learnt(w, learnt)} if learnt else set()
    learnt_hits = sum(1 for w in words if w in terms) if terms else 0
    second = [i for i, w in enumerate(words) if w in SECOND]
    abuse = np.array([i for i, _ in hits])
    near = 0
    if len(abuse) and second:
        s = np.array(second)
        at = np.searchsorted(s, abuse)
        near = int(((np.abs(s[np.minimum(at, len(s) - 1)] - abuse) <= 5) | (np.abs(s[np.maximum(at - 1, 0)] - abuse) <= 5)).sum())
    odd = masked = 0
    for token in lower.split():
        if not token.isalpha():
            core = token.strip(_OUTER)
            whole = token if token[:1] in "@$" and len(token) > 1 else core
            if whole and not whole.isalpha() and any(c.isalpha() for c in whole):
                odd += 1
                masked += _unmasked(whole.rstrip(_OUTER.replace("*", "")))
    for w in kinds:
        if _TRIPLE.search(w):
            masked += any(_RUN.sub(r"\1" * size, w) in _ALL for size in (1, 2))
    for m in _SPACED.finditer(lower):
        masked += _in_lexicon(re.sub(r"[^a-z]", "", m.group()), _ALL)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum() + raw[192:].sum()))
    size = max(1, int(raw.sum()))
    bangs = int(raw[33] + raw[63])
    return [
        float(np.log1p(len(words))), *(100 * g / n for g in groups), float(np.log1p(sum(groups))), 100 * learnt_hits / n, float(np.log1p(learnt_hits)),
        100 * near / n, 100 * len(second) / n, raw[65:91].sum() / letters, 100 * len(_SHOUT.findall(text)) / n, 100 * bangs / n,
        100 * len(_BANGS.findall(text)) / n if bangs > 1 else 0.0, (raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()) / size,
        raw[48:58].sum() / size, 100 * odd / n, float(np.log1p(masked)),
    ]


@dataclass
class BoostedTrees:
    """Binary log-loss boosting; trees of fixed depth over quantile bins, stored as arrays."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 48
    damping: float = 1.0
    cuts: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros(x.shape, int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(np.unique(v), np.linspace(0, 1, self.bins + 1)[1:-1])) for v in x.T]
        binned, wide = self._bin(x), self.bins + 1
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            node = np.zeros(len(y), np.int64)
            which, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, wide)
            for level in range(self.depth):
                first, n = (1 << level) - 1, 1 << level
                local = node - first
                gain, best = np.full(n, 1e-3), np.zeros(n, np.int64)
                for k in range(x.shape[1]):
                    at = local * wide + binned[:, k]
                    g, h = (np.bincount(at, w, n * wide).reshape(n, wide).cumsum(axis=1) for w in (grad, hess))
                    g0, h0 = g[:, -1:], h[:, -1:]
                    value = g**2 / (h + self.damping) + (g0 - g) ** 2 / (h0 - h + self.damping) - g0**2 / (h0 + self.damping)
                    value[(h < 0.5) | (h0 - h < 0.5)] = -1
                    top = value.argmax(axis=1)
                    better = value[np.arange(n), top] > gain
                    gain[better], best[better] = value[np.arange(n), top][better], top[better]
                    which[first : first + n][better], cut[first : first + n][better] = k, best[better]
                node = 2 * node + 1 + (binned[np.arange(len(y)), which[node]] > cut[node])
            leaf = node - len(which)
            g, h = np.bincount(leaf, grad, len(which) + 1), np.bincount(leaf, hess, len(which) + 1)
            value = -self.rate * g / (h + self.damping)
            self.nodes.append((which, cut, value))
            score += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, score, row = self._bin(x), np.full(len(x), self.start), np.arange(len(x))
        for which, cut, value in self.nodes:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[row, which[node]] > cut[node])
            score += value[node - len(which)]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on score (pool adjacent violators)."""
    at, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []
    for x, v, w in zip(at, np.bincount(inverse, y) / weight, weight, strict=True):
        blocks.append([v, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, _, hi = blocks.pop()
            v0, w0, lo, _ = blocks[-1]
            blocks[-1] = [(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, lo, hi]
    knots = [(x, b[0]) for b in blocks for x in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class ToxicityModel:
    learnt: frozenset[str] = frozenset()
    trees: BoostedTrees | None = None
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.trees is None:
            return [float(self.knots[1][0])] * len(texts)
        margin = self.trees.margin(np.array([features(t, self.learnt) for t in texts], float).reshape(len(texts), len(NAMES)))
        level = np.interp(margin, *self.knots)
        return (0.998 * level + 0.002 / (1 + np.exp(-margin))).tolist()  # the second part orders ties


def _fold(doc_id) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(3), doc_id), F.lit(FOLDS)).cast("int")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` labelled ids, none with crc32(id) mod 5 = 0.

    Null labels and ids are left out; an id labelled twice counts as toxic if one label is.
    Rows that share an id all have its label; if that makes far more rows than ids, about
    ``sample`` of them are taken by a hash. Without labels of both kinds, as with an empty table, the score is the smoothed share of toxic ones.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), 5) != 0))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = stored(rows.select(_fold(F.col("doc_id")).alias("fold"), F.col("y").cast("int").alias("y"), "text", F.rand(7).alias("draw")), "labelled")
    n_rows = rows.count()
    rows = (rows if n_rows <= 2 * sample else rows.filter(F.col("draw") < sample / n_rows)).drop("draw")

    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\P{L}+"), lambda w: F.length(w) >= 3))
    hashes = F.array_sort(F.transform("words", lambda w: F.xxhash64(w)))
    stems = [F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS]
    # the sketch is computed before the explode: beside it, it would be computed for every word
    held = rows.select("fold", "y", words.alias("words")).select("fold", "y", "words", F.xxhash64(F.slice(hashes, 1, 3)).alias("sketch"))
    held = held.select("fold", "y", "sketch", F.explode("words").alias("word"))
    held = held.select("fold", "y", "sketch", F.explode(F.array_compact(F.array("word", *stems))).alias("term"))
    held = held.groupBy("term", "y", "sketch").agg(F.min("fold").alias("fold"))
    per_fold = [f(F.when(F.col("fold") == k, v)).alias(f"{name}{k}") for k in range(FOLDS) for name, v, f in (("n", 1, F.count), ("t", F.col("y"), F.sum))]
    toxic = rows.filter("y = 1").count()
    least = max(float(np.clip(toxic / RAMP, *LEARNT_DOCS)), LEARNT_SHARE * toxic)
    ever = held.groupBy("term").agg(*per_fold, F.sum("y").alias("t"), F.count("*").alias("n"))
    ever = ever.filter((F.col("t") >= least) & (F.col("t") >= PURITY * F.col("n")))
    top = ever.orderBy(F.desc(F.col("t") * F.pow(F.col("t") / F.col("n"), 2)), "term").limit(LEARNT_TERMS).collect()

    def learnt(without: int | None) -> frozenset[str]:
        """The terms that hold without one of the folds."""
        sums = {r.term: [sum((r[f"{x}{k}"] or 0) for k in range(FOLDS) if k != without) for x in "nt"] for r in top}
        return frozenset(term for term, (n, t) in sums.items() if t >= least / 2 and t >= PURITY * n)

    lexicons = [learnt(k) for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, y, text = (c.to_pylist() for c in b.columns)
            x = [features(t, lexicons[k]) for t, k in zip(text, fold, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["fold", "y", "x"])

    got = rows.mapInArrow(run, "fold int, y int, x array<double>").collect()
    y = np.array([r.y for r in got], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(knots=(np.zeros(1), np.array([(y.sum() + 0.5) / (len(y) + 1)])))
    x, fold = np.array([r.x for r in got]), np.array([r.fold for r in got])
    order = np.lexsort((*x.T[::-1], y, fold))  # rows arrive in any order
    x, y, fold = x[order], y[order], fold[order]
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        other, own = fold != k, fold == k
        if own.any() and other.any():
            margin[own] = BoostedTrees().fit(x[other], y[other]).margin(x[own])
    return ToxicityModel(learnt(None), BoostedTrees().fit(x, y), isotonic(margin, y))


def with_score(docs: DataFrame, model: ToxicityModel, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``name``: the calibrated score of each whole text, null texts as empty.

    Equal texts score alike, so repeated rows all return with one score; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(sent.value.scores(batch.tolist()), dtype=float)

    return docs.withColumn(name, F.pandas_udf(score, "double").asNondeterministic()(col(text_col)))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, unchanged, with whatever other columns they have.

    Null and empty texts score as empty ones, rows without an id like any others.
    """
    name = fresh("__toxicity", docs.columns)
    return with_score(docs, train(docs, labels, text_col=text_col), name, text_col).filter(F.col(name) < threshold).drop(name)
