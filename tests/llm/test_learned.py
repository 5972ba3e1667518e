"""Paragraph dedup, language model, toxicity and the pipeline: brute force, planted cases, held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandgraph.llm import lm, paragraphs, queries, toxicity
from tests.llm.cases import TEXTS, edge_docs, empty_docs, frame

SF = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- op3 ---


def shared_runs(texts, width):
    """Documents that share a run of ``width`` words with another one."""
    seen = {}
    for d, text in enumerate(texts):
        words = (text or "").lower().split()
        for k in range(len(words) - width + 1):
            seen.setdefault(tuple(words[k : k + width]), set()).add(d)
    return {d for ds in seen.values() if len(ds) > 1 for d in ds}


def test_embedded_passages_and_similar_paragraphs(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    text = lambda n: [word() for _ in range(n)]
    texts, near = [], set()
    for _ in range(12):
        passage = text(rng.randint(51, 80))
        for _ in range(rng.randint(2, 4)):
            texts.append(" ".join(text(rng.randint(0, 60)) + passage + text(rng.randint(0, 60))))
    for _ in range(6):
        line = text(100)
        for _ in range(3):
            own = list(line)
            for k in rng.sample(range(5, 95, 10), 1):
                own[k] = word()
            near.add(len(texts))
            texts.append("\n".join([" ".join(text(9)), " ".join(own), " ".join(text(7))]))
    short = text(30)
    texts += [" ".join(text(20) + short + text(20)) for _ in range(5)] + [" ".join(text(200)) for _ in range(10)]
    rows = paragraphs.repeated_spans(frame(spark, texts)).collect()
    found = {r.doc_id for r in rows}
    assert shared_runs(texts, 51) | near <= found <= shared_runs(texts, 40) | near
    for r in rows:
        assert 0 <= r.start < r.end <= len(texts[r.doc_id].split()) and (r.removed or r.first_doc_id == r.doc_id)
    assert {r.doc_id for r in rows if not r.removed} and {r.doc_id for r in rows if r.removed}


def test_short_paragraphs_are_compared(spark):
    line = lambda k, n: " ".join(f"p{k}x{j}" for j in range(n))
    texts = []
    for k, n in enumerate((5, 10, 20, 49)):
        texts += [f"{line(k, n)}\n{line(90 + k, 7)}", f"{line(70 + k, 6)}\n{line(k, n)}"]
    texts += [line(50, 30), f"{line(50, 29)} other", line(60, 4), line(60, 4)]
    got = {(r.doc_id, r.start, r.end, r.first_doc_id, r.removed) for r in paragraphs.repeated_spans(frame(spark, texts)).collect()}
    want = {(2 * k, 0, n, 2 * k, False) for k, n in enumerate((5, 10, 20, 49))} | {(2 * k + 1, 6, 6 + n, 2 * k, True) for k, n in enumerate((5, 10, 20, 49))}
    assert got == want | {(8, 0, 30, 8, False), (9, 0, 30, 8, True)}


def test_every_keeper_of_joined_passages_is_named(spark):
    line = lambda k, n: " ".join(f"p{k}x{j}" for j in range(n))
    texts = [line(0, 20), line(1, 70), line(2, 60), "\n".join([line(0, 20), line(1, 70), line(2, 60)]), f"{line(1, 70)} {line(2, 60)}"]
    rows = paragraphs.repeated_spans(frame(spark, texts)).collect()
    got = {(r.doc_id, r.start, r.end, r.first_doc_id) for r in rows if r.removed}
    assert {g for g in got if g[0] == 3} == {(3, 0, 20, 0), (3, 20, 90, 1), (3, 90, 150, 2)}
    owned = {w: d for d in (0, 1, 2) for w in texts[d].split()}
    # the units that cross from one passage into the next are first held by document 3
    across = [r for r in rows if r.doc_id == 4 and r.first_doc_id != 3]
    assert {r.first_doc_id for r in across} == {1, 2}
    assert all(owned[w] == r.first_doc_id for r in across for w in texts[4].split()[r.start : r.end])


def test_jaccard_is_exact():
    import pyarrow as pa

    rng = random.Random(1)
    sets = [sorted(rng.sample(range(60), rng.randint(0, 50))) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    got = paragraphs.jaccard_at_least(pa.table({"shingles": pa.array(sets, pa.list_(pa.int64()))}), i, j, 0.5)
    want = [bool(sets[a] and sets[b]) and len({*sets[a]} & {*sets[b]}) >= 0.5 * len({*sets[a]} | {*sets[b]}) for a, b in zip(i, j, strict=True)]
    assert got.tolist() == want


def plain_words(text):
    return [line.split() for line in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split("\n")]


def plain_units(words):
    """Starts of the anchored units of one text, window by window."""
    import xxhash

    n, mask = len(words) - paragraphs.UNIT + 1, (1 << 64) - 1
    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
    a = []
    for k in range(max(n, 0)):
        x = (h[k] * int(paragraphs._BASE) + h[k + 1]) & mask
        x = ((x ^ (x >> 31)) * int(paragraphs._MIX)) & mask
        a.append((x ^ (x >> 29)) | 1)
    at = set()
    for k in range(n - paragraphs.ANCHOR + 1):
        window = a[k : k + paragraphs.ANCHOR]
        at |= {k + j for j, x in enumerate(window) if x == min(window)}
    out, before = [], None
    for k in sorted(at):
        unit = tuple(words[k : k + paragraphs.UNIT])
        if before != (k - 1, unit):
            out.append(k)
        before = (k, unit)
    return out


def plain_spans(texts, min_words=5, similarity=0.8):
    """(row, start, end, keeper, removed, units) by comparing all paragraphs and all units with one another."""
    found, lines, units = [], [], {}
    for row, text in enumerate(texts):
        place, flat = 0, []
        for words in plain_words(text):
            if len(words) >= min_words:
                lines.append((row, place, place + len(words), frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)), tuple(words)))
            place += len(words)
            flat += words
        for k in plain_units(flat):
            units.setdefault(tuple(flat[k : k + paragraphs.UNIT]), []).append((row, k, k + paragraphs.UNIT))
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if lines[i][4] == lines[j][4] or len(lines[i][3] & lines[j][3]) >= similarity * len(lines[i][3] | lines[j][3]) - 1e-9 and lines[i][3]]
    root = {k: k for k in range(len(lines))}
    for _ in range(len(lines)):
        moved = False
        for i, j in pairs:
            low = min(root[i], root[j])
            moved |= root[i] != low or root[j] != low
            root[i] = root[j] = low
        if not moved:
            break
    groups = list(units.values()) + [[lines[k][:3] for k in range(len(lines)) if root[k] == r] for r in set(root.values())]
    for group in groups:
        low = min(row for row, _, _ in group)
        if max(row for row, _, _ in group) > low:
            found += [(row, low, s, e) for row, s, e in group]
    out = []
    for row, low in {f[:2] for f in found}:
        spans = sorted(f[2:] for f in found if f[:2] == (row, low))
        merged = [[*spans[0], 1]]
        for s, e in spans[1:]:
            if s <= merged[-1][1]:
                merged[-1][1:] = [max(e, merged[-1][1]), merged[-1][2] + 1]
            else:
                merged.append([s, e, 1])
        out += [(row, s, e, low, row > low, n) for s, e, n in merged]
    return sorted(out)


def as_rows(rows):
    return sorted((r.doc_id, r.start, r.end, r.first_doc_id, r.removed, r.n_units) for r in rows)


def changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def test_spans_equal_the_comparison_of_everything(spark):
    rng = random.Random(12)
    some = [[f"v{rng.randrange(400)}" for _ in range(n)] for n in (5, 6, 8, 12, 30, 60, 70, 120)]
    texts = []
    for _ in range(70):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = rng.choice(some)
            kind = rng.random()
            if kind < 0.3:
                line = changed(rng, line, max(1, len(line) // 60))
            elif kind < 0.5:
                line = [f"x{rng.randrange(900)}" for _ in range(rng.randint(0, 30))] + line + [f"y{rng.randrange(900)}" for _ in range(rng.randint(0, 30))]
            elif kind < 0.6:
                line = ["same"] * rng.randint(3, 80)
            lines.append(" ".join(line).upper())
        texts.append("\n".join(lines))
    assert as_rows(paragraphs.repeated_spans(frame(spark, texts)).collect()) == plain_spans(texts)


def test_recall_of_paragraphs_at_the_threshold(spark):
    """Pairs of paragraphs with a similarity of 0.8 to 0.9: bands are tuned to miss two in a thousand."""
    rng = random.Random(2)
    texts, near = [], 0
    while near < 400:
        line = [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(50, 90))]
        other = changed(rng, line, 1)
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (line, other)]
        if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.9:
            texts += [" ".join(line), " ".join(other)]
            near += 1
    links = {(r.a, r.b) for r in linked(spark, texts)}
    assert len(links) >= 0.99 * near


def linked(spark, texts):
    table = frame(spark, texts).selectExpr("doc_id AS row", "text")
    found = paragraphs.pieces(table, 5).filter("row is not null").selectExpr("row AS node", "line_key[0] AS key", "shiftright(line_mark[0], 32) AS check", "bands[0] AS bands")
    nodes = paragraphs.stored(found)
    return paragraphs.paragraph_links(table, nodes, 5, 0.8).collect()


def test_rows_are_documents_whatever_their_ids(spark):
    line = lambda k, n: " ".join(f"p{k}x{j}" for j in range(n))
    rows = [(3, line(1, 120)), (3, line(1, 120)), (None, line(2, 120)), (None, line(2, 120)), (2, line(3, 9)), (None, line(3, 9)), (7, None), (7, "")]
    found = paragraphs.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.start, r.end, r.first_doc_id, r.removed) for r in found) == Counter({
        (3, 0, 120, 3, False): 1, (3, 0, 120, 3, True): 1, (None, 0, 120, None, False): 1, (None, 0, 120, None, True): 1, (2, 0, 9, 2, False): 1, (None, 0, 9, 2, True): 1
    })


def test_pieces_that_very_many_documents_share(spark, monkeypatch):
    """Those named by the workers take the path of hot keys and give the same rows."""
    rng = random.Random(6)
    common = " ".join(f"c{k}" for k in range(60))
    texts = [f"{common}\n" + " ".join(f"o{rng.randrange(10**6)}" for _ in range(20)) if k % 3 else f"own{k} " * 9 for k in range(240)]
    assert as_rows(paragraphs.repeated_spans(frame(spark, texts)).collect()) == plain_spans(texts)
    monkeypatch.setattr(paragraphs, "LOCAL", 1 << 30)
    assert as_rows(paragraphs.repeated_spans(frame(spark, texts)).collect()) == plain_spans(texts)


def test_the_filter_holds_every_key(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    bitmap = paragraphs.key_filter(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert paragraphs.in_filter(bitmap, keys).all() and paragraphs.in_filter(bitmap, rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)).sum() < 20
    assert not paragraphs.in_filter(paragraphs.key_filter(spark.createDataFrame([], "key long")), keys).any()


def test_repeated_spans_on_documents_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert as_rows(paragraphs.repeated_spans(docs).collect()) == plain_spans(texts)
    rows = paragraphs.repeated_spans(edge_docs(spark)).collect()
    assert {r.doc_id for r in rows} == {1, 5, 6} and Counter(r.doc_id for r in rows if not r.removed) == {1: 1, 5: 1}
    assert paragraphs.repeated_spans(empty_docs(spark)).count() == 0


# --- op6 ---


def plain_base(rows):
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    counts = Counter(w for t in train for w in (t or "").encode().lower().split())
    total, types = sum(counts.values()) + len(train), len(counts) + bool(train)
    log = lambda c: math.log10((c + 0.1) / (total + 0.1 * (types + 1)))
    out = Counter()
    for i, t in rows:
        words = (t or "").encode().lower().split()
        known = sum(w in counts for w in words) + bool(train)
        out[i, len(words) + 1, known, total, round(sum(log(counts[w]) for w in words) + log(len(train)), 4)] += 1
    return out


@pytest.mark.parametrize("head", [lm.HEAD_WORDS, 600])
def test_base_scores_and_gain_over_the_base(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    docs = documents(spark)
    rows = lm.lm_scores(docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == plain_base([(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r.held_out]
    gain = 1 - sum(r.score for r in held) / sum(r.base_score for r in held)
    assert len(held) > 50 and gain > (0.05 if head > 600 else 0.02)


def encoded(known, texts):
    return lm.Encoded.of(*known.encode(texts)[:2], known.end + 1)


def small_model(spark, texts):
    table = frame(spark, texts).select("text")
    known = lm.Vocabulary.of(lm.count_words(table), len(texts))
    model, rng = lm.LogBilinear.new(known), np.random.default_rng(0)
    for _ in range(60):
        model.learn(encoded(known, texts), rng)
    return known, model


def test_model_is_a_distribution_and_learns_its_contexts(spark):
    rng = random.Random(8)
    words = [[f"{c}{k}" for k in range(12)] for c in "xy"]
    texts = [" ".join(rng.choices(words[k % 2], k=30)) for k in range(60)]
    known, model = small_model(spark, texts)
    text = encoded(known, texts)
    real = text.symbols != model.begin
    symbols, g = text.symbols[real], model.contexts(text, model.input())[real]
    book = lm.CodeBook.fit(g)
    vectors, bias = model.output()
    low = book.low.reshape(-1, lm.WIDTH)
    norm = lm.normalisers(low, vectors, bias)
    assert np.allclose(np.exp(low @ vectors.T + bias - norm[:, None]).sum(axis=1), 1, atol=1e-4)
    states = book.states(g)
    group = ((g[:, None, :] - book.top[None]) ** 2).sum(axis=2)
    assert (np.take_along_axis(group, (states // lm.STATES)[:, None], 1)[:, 0] <= group.min(axis=1) + 1e-4).all()
    log_p = (low[states] * vectors[symbols]).sum(axis=1) + bias[symbols] - norm[states]
    inside = symbols != known.end
    assert log_p[inside].mean() > -math.log(16), "the other text's words are unlikely; 24 are equally likely without context"


def test_code_book_counts_the_context_of_every_training_token(spark):
    """More texts than the 2000 that the code book was once fitted to, and long ones."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefgh", k=k % 5)) for k in range(2500)] + [" ".join(rng.choices("abcdefgh", k=400)) for _ in range(9)] + [None]
    table = frame(spark, texts).withColumn("held_out", F.lit(False))
    known = lm.Vocabulary.of(lm.count_words(table.select("text")), len(texts))
    model = lm.LogBilinear.new(known)
    model.learn(encoded(known, texts), np.random.default_rng(0))
    text = encoded(known, texts)
    g, real = model.contexts(text, model.input()), text.symbols != model.begin
    cells, g = lm.Cells(model).places(model, model.input(), text, g)[real], g[real]
    means, counts = lm.summed_contexts(lm.encode_texts(table, known).select("symbols").repartition(5), model)
    places, n = np.unique(cells, return_counts=True)
    assert 0 <= cells.min() and cells.max() < lm.CELLS and len(places) > 50
    assert counts.sum() == known.n_tokens == len(g) and np.abs(counts - n).sum() <= 0.01 * len(g)
    assert np.allclose(counts @ means, g.sum(axis=0, dtype=float), rtol=1e-4, atol=1e-2)
    book = lm.fit_code_book(lm.encode_texts(table, known).select("symbols"), model)
    low = book.low.reshape(-1, lm.WIDTH)
    near = ((g - low[book.states(g)]) ** 2).sum(axis=1).mean()
    assert near < 0.2 * g.var(axis=0).sum()


def test_symbols_contexts_and_means(spark):
    known = lm.Vocabulary.of(lm.count_words(frame(spark, ["a a b", "b c", None]).select("text")), 3)
    assert known.n_tokens == 8 and known.n_types == 4 and list(known.index) == [b"a", b"b", b"c"] and known.counts.tolist() == [2, 2, 1]
    text = encoded(known, ["A b", None, "zz c a"])
    assert known.encode(["A b", None, "zz c a"])[2] == [[], [], [b"zz"]]
    end, begin, zz = known.end, known.end + 1, 3 + lm.class_of(b"zz")
    assert text.symbols.tolist() == [begin, begin, 0, 1, end, begin, begin, end, begin, begin, zz, 2, 0, end]
    assert text.starts.tolist() == [2, 7, 10] and text.ends.tolist() == [5, 8, 14]
    x = np.arange(14, dtype=np.float32)[:, None]
    assert text.means(x)[text.symbols != begin, 0].tolist() == [0, 2, 2.5, 0, 0, 10, 10.5, 11]
    model = lm.LogBilinear.new(known)
    vectors, c = model.input(), model.tables["c"]
    c[:] = np.array([[2.0], [3.0], [5.0]])
    g = model.contexts(text, vectors)
    assert np.allclose(g[13], 2 * vectors[0] + 3 * vectors[2] + 5 * vectors[[zz, 2, 0]].mean(axis=0), atol=1e-5)
    assert np.allclose(g[2], 5 * vectors[begin], atol=1e-5) and np.allclose(g[3], 2 * vectors[0] + 3 * vectors[begin] + 5 * vectors[0], atol=1e-5)


def test_training_steps_follow_the_gradient():
    """A step moves every parameter down the slope of the contrastive loss, found by differences."""
    rng = np.random.default_rng(4)
    known = lm.Vocabulary({f"w{k}".encode(): k for k in range(6)}, np.array([9, 7, 5, 4, 3, 2]), 4, 34, 7, np.zeros(lm.CLASSES, int), np.zeros(lm.CLASSES, int))
    model = lm.LogBilinear.new(known)
    for name in "rqstc":
        model.tables[name] += rng.normal(0, 0.3, model.tables[name].shape).astype(np.float32)
    symbols = np.array([[model.begin, model.begin, 0, 1, 2], [1, 2, 4, known.end, model.begin]], np.int32)
    mean = rng.normal(size=(2, 3, lm.WIDTH)).astype(np.float32)
    sample = np.searchsorted(model.upto, np.random.default_rng(9).random(lm.NOISE)).clip(0, model.begin - 1)

    def loss(tables):
        x = tables["r"][symbols] + tables["s"][model.of[symbols]]
        g = x[:, 1:-1] * tables["c"][0] + x[:, :-2] * tables["c"][1] + mean * tables["c"][2]
        q, total = tables["q"][:, : lm.WIDTH] + tables["t"][model.of[: model.begin]], 0.0
        for i, j in ((i, j) for i in range(2) for j in range(3) if symbols[i, j + 2] != model.begin):
            score = q @ g[i, j] + tables["q"][:, lm.WIDTH] - model.log_kp
            total += np.logaddexp(0, -score[symbols[i, j + 2]]) + np.logaddexp(0, score[sample]).sum()
        return total

    tables = {name: x.astype(float) for name, x in model.tables.items()}
    before = {name: x.copy() for name, x in model.tables.items()}
    model.train(symbols, mean, np.random.default_rng(9))
    for name, row, column in (("r", 1, 2), ("r", model.begin, 0), ("q", 4, 3), ("q", known.end, lm.WIDTH), ("s", int(model.of[2]), 1), ("t", int(model.of[0]), 5), ("c", 2, 4), ("c", 0, 0)):
        up, down = ({n: x.copy() for n, x in tables.items()} for _ in range(2))
        up[name][row, column] += 1e-4
        down[name][row, column] -= 1e-4
        slope, step = (loss(up) - loss(down)) / 2e-4, float(model.tables[name][row, column] - before[name][row, column])
        expected = -lm.RATE * before[name].shape[1] ** 0.5 * slope / model.steps[name][row, 0] ** 0.5
        assert step == pytest.approx(expected, rel=2e-2, abs=1e-4), name


def test_portions_keep_rows_and_order():
    import pyarrow as pa

    rng = random.Random(4)
    rows = [[rng.randrange(9) for _ in range(rng.choice([0, 1, 3, 40]))] for _ in range(60)]
    data = [np.array(r, np.int32).tobytes() for r in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(data[k : k + 7], pa.binary())], names=["symbols"]) for k in range(0, 60, 7)]
    for limit in (1, 10, 1000):
        parts = list(lm._portions(iter(batches), limit))
        assert [r for p in parts for r in p.column(0).to_pylist()] == data
        assert all(sum(map(len, p.column(0).to_pylist()[:-1])) <= 4 * limit for p in parts)
        texts = [lm._laid_out(p, 99) for p in parts]
        assert [t.symbols[s:e].tolist() for t in texts for s, e in zip(t.starts, t.ends, strict=True)] == rows


def test_the_head_is_bounded_by_a_least_count(spark, monkeypatch):
    texts = frame(spark, [" ".join(["one"] * 9 + ["two"] * 5 + ["three", "four"] * 2 + ["five"])]).select("text")
    for bound, head in ((9, 5), (4, 4), (3, 2), (1, 1), (0, 0)):
        monkeypatch.setattr(lm, "HEAD_WORDS", bound)
        known = lm.Vocabulary.of(lm.count_words(texts), 1)
        assert len(known.index) == head and known.n_tokens == 20 and known.n_types == 6
        assert known.symbol_counts().sum() == 20 and known.class_types.sum() == 5 - head


def test_parts_of_trainers_meet_as_weighted_means(spark):
    rng = np.random.default_rng(3)
    n, trainers = lm.BLOCK_ROWS + 40, 130
    total, weight, rows = np.zeros((n, 2)), np.zeros(n), []
    for lane in range(trainers):
        model = lm.LogBilinear(np.zeros(0, int), {"r": rng.normal(size=(n, 2)).astype(np.float32)}, np.ones(1))
        touched = model.steps["r"][:, 1]
        touched[rng.integers(0, n, 30)] = rng.integers(1, 9)
        hit = touched > 0
        total[hit] += touched[hit, None] * model.tables["r"][hit]
        weight += touched
        rows += [r for b in lm._blocks(model, lane) for r in b.to_pylist()]
    merged = lm._merged(spark.createDataFrame([tuple(r.values()) for r in rows], lm.PARTS), trainers).collect()
    got = np.zeros((n, 2))
    for p in merged:
        at, vectors = lm._rows(p.asDict())
        got[int(p.key.split(":")[1]) * lm.BLOCK_ROWS + at] = vectors
    assert len(merged) == 2 and np.allclose(got[weight > 0], total[weight > 0] / weight[weight > 0, None], atol=0.01)


def test_the_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 50_000)
    docs = documents(spark).select("doc_id", "text", F.lit(False).alias("held_out"))
    known = lm.Vocabulary.of(lm.count_words(docs.select("text")), docs.count())
    assert known.n_tokens > 150_000
    # a fifth of the rows once more, and one row very often
    again = docs.filter("doc_id % 5 = 0").unionByName(docs.filter("doc_id = 7").crossJoin(spark.range(300)).drop("id")).unionByName(docs)
    one, other = (lm.train_model(lm.encode_texts(d, known).select("symbols", "h", "row"), known) for d in (docs.coalesce(1), docs.repartition(7, "text")))
    for name, table in one.tables.items():
        assert np.allclose(table, other.tables[name], atol=1e-4), name
    many = lm.train_model(lm.encode_texts(again, known).select("symbols", "h", "row"), known)
    assert all(np.isfinite(x).all() for x in many.tables.values())


def test_lm_edge_cases(spark):
    rows = lm.lm_scores(edge_docs(spark)).collect()
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    assert got == plain_base([(i, t) for i, t, *_ in TEXTS])
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert lm.lm_scores(empty_docs(spark)).count() == 0


# --- op10 ---


def test_toxicity_on_held_out_rows(spark):
    docs, labels = documents(spark).select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.with_score(docs, model, "score").join(labels, "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert len(rows) > 40 and all(0 <= r.score <= 1 for r in rows)
    again = toxicity.train(docs, labels)
    texts = [r.text for r in docs.limit(50).collect()]
    assert model.scores(texts) == again.scores(texts)
    clean, bad = model.scores(["A calm note on the weather and the garden. " * 8, "You are a worthless idiot, you stupid moron! Pathetic loser, disgusting trash. " * 4])
    assert clean < 0.5 < bad


def test_recall_and_precision_on_held_out_rows(spark):
    """On the 97 toxic among the 825 labelled rows of sf0.1 that training never sees; also of the pipeline's stage."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    rows = queries.op10_toxicity(spark, folder).join(held, "doc_id").collect()
    toxic, flagged = sum(r.toxic for r in rows), sum(r.predicted for r in rows)
    both = sum(r.toxic and r.predicted for r in rows)
    assert len(rows) > 800 and toxic > 90 and all(r.held_out for r in rows) and all((r.score >= 0.5) == r.predicted for r in rows)
    assert both >= 0.9 * toxic and both >= 0.9 * flagged
    wanted = docs.join(held.select("doc_id"), "doc_id", "left_semi")
    kept = {r.doc_id for r in toxicity.with_score(wanted, toxicity.train(docs, labels), "score").filter("score < 0.5").collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


def test_obfuscated_words_are_seen():
    at = toxicity.NAMES.index("masked_hits")
    for text in ("you id1ot", "a m0r0n", "such $tupid", "w*rthless thing", "stuuuupid", "i d i o t here", "l.o.s.e.r"):
        assert toxicity.features(text, frozenset())[at] > 0, text
    assert toxicity.features("version 1.2 of the file-name at 10:30, e.g. a b c", {})[at] == 0


def test_terms_match_words_and_stems():
    learnt = frozenset({"bad", "evil*", "evildo*"})
    assert [toxicity.in_learnt(w, learnt) for w in ("bad", "badly", "evil", "evils", "evildoer", "goodness")] == [True, False, False, True, True, False]


def test_an_id_on_very_many_rows_is_bounded(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("1L AS doc_id", "concat('you idiot ', id) AS text").union(spark.createDataFrame([(k, "calm words") for k in (2, 3, 7)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (7, 0)], "doc_id long, toxic int")
    seen = []
    kept = toxicity.isotonic
    monkeypatch.setattr(toxicity, "isotonic", lambda margin, y: seen.append(len(y)) or kept(margin, y))
    model = toxicity.train(docs, labels, sample=50)
    assert (seen[0] < 150 if seen else model.trees is None), "far fewer than 3003 rows reach the driver"


def test_trees_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = toxicity.BoostedTrees().fit(x[:2000], y[:2000])
    assert ((trees.margin(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95
    at, level = toxicity.isotonic(rng.normal(size=500), rng.integers(0, 2, 500).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(level) >= 0).all()


def test_toxicity_edge_cases(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (7, 0), (7, 1), (5, 0)], "doc_id long, toxic int")
    for use in (labels, labels.limit(0), labels.filter("toxic = 0")):
        kept = toxicity.without_toxic(docs, use)
        assert kept.columns == docs.columns and kept.count() <= len(TEXTS)
        assert toxicity.with_score(empty_docs(spark), toxicity.train(docs, use), "score").count() == 0


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    columns = documents(spark).columns
    docs = documents(spark)
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == (columns if k < 4 else [*columns, "shard", "slot"])
        seen.append(docs)
    keys = [{(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()} for d in seen]
    assert all(b <= a for a, b in zip(keys, keys[1:], strict=False)) and keys[4] == keys[5]
    counts = [d.count() for d in seen]
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[5]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    # what goes is what the classifier scores at 0.5 or more; how well it does is measured on held-out rows above
    gone = keys[0] - keys[1]
    predicted = {r.doc_id for r in queries.op10_toxicity(spark, SF).filter("predicted = 1").collect()}
    assert {i for i, _ in gone} == predicted and sum(labels.get(i) == 0 for i, _ in gone) == 0
    sizes = Counter(r.shard for r in seen[5].select("shard").collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 40


def test_pipeline_on_edge_cases(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.without_toxic(empty_docs(spark), labels).count() == 0
    labels_folder = labels.selectExpr("doc_id", "0 AS quality", "toxic")
    folder = str(tmp_path)
    labels_folder.write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = edge_docs(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty_docs(spark), folder).count() == 0
        out = stage(spark, docs, folder)
        assert out.columns == (docs.columns if k < 4 else [*docs.columns, "shard_", "slot"]) and out.count() >= 1


def test_the_whole_pipeline_writes_shards(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "shard", "slot").collect()
    sizes = Counter(r.shard for r in rows)
    assert rows and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in sorted(sizes) for k in range(sizes[s])]
