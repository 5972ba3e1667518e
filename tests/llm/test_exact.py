"""Operators with exact results against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandgraph.llm import bpe, common, components, decontamination, licenses, media, mixing, sharding, simhash
from strandgraph.llm import queries
from strandgraph.llm.queries import vocabulary_path
from tests.llm.cases import TEXTS, edge_docs, empty_docs, frame

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- components ---


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(-40, 40)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots([p for p in pairs if p[0] != p[1]]).items()}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op4 ---


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not m & flips for m in masks)


@pytest.mark.parametrize("block", [4, 256])
def test_components_of_fingerprints_against_all_pairs(spark, block, monkeypatch):
    rng = random.Random(block)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = {c ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(25)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    monkeypatch.setattr(simhash, "verified_links", lambda m, s: components.verified_links(m, s, block))
    got = {r.node: r.root for r in simhash.fingerprint_components(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4]
    assert got == roots(pairs)


def test_no_join_of_simhash_passes_its_tables_through_the_driver(spark):
    """31 rows a fingerprint look as small as the fingerprints they are exploded from, and the rows to drop may be most of all."""
    prints = common.stored(spark.range(400).select(F.xxhash64("id").alias("fp")))
    members = prints.select(F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp")) for t in range(31)])).alias("bucket"), F.col("fp").alias("node"))
    near = lambda rows, i, j: np.ones(len(i), bool)
    docs = frame(spark, [f"text number {k % 40} of some" for k in range(200)])
    assert simhash.keep_first(docs).count() == 40
    for plan in (components.verified_links(members, near), simhash.near_duplicates(docs), simhash.keep_first(docs)):
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in shown and "BroadcastExchange" not in shown  # no key is hot here


def test_simhash_on_documents_and_edge_cases(spark):
    for docs in (documents(spark), edge_docs(spark)):
        rows = docs.select("doc_id", "text").collect()
        fps = [plain_fingerprint(r.text) for r in rows]
        pairs = [(i, j) for i in range(len(fps)) for j in range(i + 1) if bin(fps[i] ^ fps[j]).count("1") <= 4]
        root = roots(pairs)
        best = defaultdict(set)
        for i, r in enumerate(rows):
            if r.doc_id is not None:
                best[root[i]].add(r.doc_id)
        want = Counter((r.doc_id, fps[i], min(best[root[i]], default=None)) for i, r in enumerate(rows))
        got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
        assert got == want
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_keep_first_leaves_one_row_of_each_component(spark):
    docs = edge_docs(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    heads = {(r.component_id, r.first_key) for r in simhash.near_duplicates(docs).collect()}
    assert len(rows) == len(heads) and Counter(i for i, _ in rows)[1] == 1


# --- op1 ---


def plain_overlap(words, item, least=13, share=0.8):
    """Matched places of the longest stretch of any diagonal, by all stretches of all diagonals."""
    best, least = None, min(least, len(item))
    for d in range(-len(item) + 1, len(words)):
        lo, hi = max(0, d), min(len(words), d + len(item))
        equal = [words[p] == item[p - d] for p in range(lo, hi)]
        for s in range(len(equal)):
            hits = 0
            for e in range(s, len(equal)):
                hits += equal[e]
                if e - s + 1 >= least and hits >= share * (e - s + 1) - 1e-9 and (best is None or hits > best):
                    best = hits
    return best


def test_every_overlap_with_substitutions_is_found(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (4, 9, 13, 20, 40, 40, 60)]
    texts = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if rng.random() < 0.7:
            item = rng.choice(items).split()
            s = rng.randint(0, len(item) - 1)
            part = item[s : s + rng.randint(8, 30)]
            part = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.1, 0.2]) else w for w in part]
            words[len(words) // 2 : len(words) // 2] = part
        texts.append(" ".join(words).upper())
    docs = frame(spark, texts)
    bench = spark.createDataFrame([*enumerate(items), (99, None), (None, "x"), (98, "")], "item_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if plain_overlap(t.lower().split(), item.split())}
    for exact in (decontamination.EXACT_SEEDS, 0):  # seeds of the benchmark known exactly, or by a bitmap alone
        monkeypatch.setattr(decontamination, "EXACT_SEEDS", exact)
        rows = decontamination.contamination(docs, bench).collect()
        assert Counter((r.doc_id, r.item_id) for r in rows) == dict.fromkeys(want, 1) and len(want) > 15
    for few in (decontamination.BROADCAST_TEXTS, 0):  # contaminated texts broadcast or joined
        monkeypatch.setattr(decontamination, "BROADCAST_TEXTS", few)
        clean = {r.doc_id for r in decontamination.decontaminated(docs, bench).collect()}
        assert clean == set(range(60)) - {d for d, _ in want}


def hit(item, words):
    """Whether some seed of the item stands in the words on a diagonal that overlaps enough."""
    found = {}
    for mask, places, keys in decontamination.item_seeds(item, decontamination.MASKS, decontamination.MIN_TOKENS, decontamination.SIMILARITY):
        for place, key in zip(places.tolist(), keys.tolist(), strict=True):
            found.setdefault((mask, key), []).append(place)
    diagonals = [at - p for mask in {m for m, _ in found} for at, key in enumerate(decontamination.seeds(words, mask).tolist()) for p in found.get((mask, key), [])]
    return decontamination.best_overlap(words, item, diagonals, decontamination.MIN_TOKENS, decontamination.SIMILARITY) is not None


@pytest.mark.parametrize("n", range(1, 22))
def test_every_placement_of_substitutions_is_found(n):
    from itertools import combinations

    item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for places in combinations(range(n), n // 5):
        words = item.copy()
        words[list(places)] = np.arange(len(places)) + 7
        assert hit(item, np.concatenate([[np.uint64(3)], words, [np.uint64(4)]])), places


@pytest.mark.parametrize("n", range(22, 31))
def test_longer_items_are_found_with_a_fifth_substituted(n):
    rng = random.Random(n)
    item = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(3000):
        words = item.copy()
        words[rng.sample(range(n), n // 5)] = 7
        assert hit(item, words)


def test_decontamination_edge_cases(spark):
    docs = edge_docs(spark)
    bench = spark.createDataFrame([(1, TEXTS[0][1])], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.contamination(docs, bench).collect()] == [(1, 1), (1, 1)]
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 2
    assert decontamination.decontaminated(docs, bench.limit(0)).count() == len(TEXTS)
    assert decontamination.contamination(empty_docs(spark), bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).count() == 0
    twice = bench.union(bench)
    assert decontamination.contamination(docs, twice).count() == 4 and decontamination.decontaminated(docs, twice).count() == len(TEXTS) - 2
    long = decontamination.contamination(docs, spark.createDataFrame([(5, " ".join(TEXTS[7][1].split()[-30:]))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.aligned) for r in long} == {(5, 30), (6, 30)}


@pytest.mark.parametrize("words", [1, 2, 50])
def test_diagonals_are_those_of_all_pairs_of_places(words):
    rng = np.random.default_rng(words)
    for n, m in ((1, 1), (40, 7), (900, 300)):
        own, other = rng.integers(0, words, n), np.sort(rng.integers(0, words, m))
        places = rng.permutation(m)
        want = sorted({int(a - p) for a, key in enumerate(own) for p in places[other == key]})
        assert decontamination.common_diagonals(own, np.arange(n), n, other, places, m).tolist() == want


def test_decontamination_of_repeated_words_and_items_without_id(spark, monkeypatch):
    met, join = [], decontamination.spread_join

    def counted(*sides):
        met.append(join(*sides))
        return met[-1]

    monkeypatch.setattr(decontamination, "spread_join", counted)
    docs = frame(spark, ["spam " * 20_000, "egg ham " * 5_000, "one two three four five six seven eight nine ten eleven twelve thirteen", "egg spam " * 4_000])
    bench = spark.createDataFrame([(1, "spam " * 800), (2, "spam " * 699 + "toast " * 101), (None, "one two three four five six seven eight nine ten eleven twelve thirteen"), (3, "ham egg " * 300)], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): (r.doc_start, r.aligned, r.matched) for r in decontamination.contamination(docs, bench).collect()}
    assert rows == {(0, 1): (0, 800, 800), (0, 2): (0, 699, 699), (1, 3): (1, 600, 600), (2, None): (0, 13, 13)}
    # distinct seeds joined: 5 masks of one word in two pairs, two for each mask of two words, all 8 + 4 + 6 + 4 + 8 places of 13 words
    assert met[0].count() == 5 + 5 + 10 + 30
    assert [r.doc_id for r in decontamination.decontaminated(docs, bench).collect()] == [3]


# --- op2 ---


def plain_scan(text):
    words = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, name) for phrase, name in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels = {n for _, n in places}
    for line in (text or "").split("\n"):
        held = set(re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in line)))
        for label, t in licenses.TEMPLATES:
            tokens = set(licenses.words_of(t))
            if len(tokens & held) >= licenses.THRESHOLD * len(tokens):
                labels.add(label)
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in places})), ",".join(sorted(labels))


def test_license_scan(spark):
    lines = [
        "All rights reserved. all RIGHTS-reserved", "cc by, CC-BY 4.0 licensed under", "x\nReleased under the MIT License.\ny", "GENERAL public license", "general public licenses",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documents", "licensed under the Apache License", "all rights\nreserved",
        "licenſe K all rights reservedé", "reserved all rights reserved", *[t for _, t in licenses.TEMPLATES],
    ]
    for docs in (frame(spark, lines), edge_docs(spark), documents(spark)):
        rows = docs.select("doc_id", "text").collect()
        want = Counter((r.doc_id, *plain_scan(r.text)) for r in rows)
        found = licenses.scan_licenses(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in found) == want
        assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in found)
    assert licenses.scan_licenses(empty_docs(spark)).count() == 0


def test_wrapped_notices_keep_their_labels(spark):
    import textwrap

    texts, want = [], []
    for label, t in licenses.TEMPLATES:
        for width, mark in ((75, ""), (40, "# "), (20, " * ")):
            texts.append("\n".join(["Some words before it"] + textwrap.wrap(t, width, initial_indent=mark, subsequent_indent=mark) + ["and words after"]))
            want.append(label)
    mit = licenses.TEMPLATES[11][1].split()
    texts += ["\n".join(mit[:10]) + "\n" + "other " * 30 + "\n" + "\n".join(mit[10:]), "Licensed under the\n\nMIT License", "Licensed under the\nbroad MIT License", "word MIT\n" + " ".join(mit) + "\nhereby granted"]
    want += ["", "mit", "", "mit"]
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert [set(want[k].split(",")) <= set(rows[k].labels.split(",")) for k in range(len(want) - 4)] == [True] * (len(want) - 4)
    assert [rows[k].labels for k in range(len(want) - 4, len(want))] == want[-4:]
    assert [rows[k].n_blocks for k in range(len(want) - 4, len(want))] == [0, 1, 0, 1]
    assert all(rows[k].n_blocks == 1 for k, label in enumerate(want[:-4]) if label in ("mit", "bsd", "isc", "cc0"))


# --- op5 ---


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 2048])
def test_shards_are_even_gapless_and_repeatable(spark, bucket_bytes):
    docs = documents(spark).select("doc_id", "source")
    runs = [{r.doc_id: (r.shard, r.slot) for r in sharding.shuffled_shards(docs, 7, bucket_bytes=bucket_bytes).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == docs.count()
    slots = defaultdict(list)
    for shard, slot in runs[0].values():
        slots[shard].append(slot)
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [i for i, _ in sorted(runs[0].items(), key=lambda x: x[1])]
    assert sum(a < b for a, b in zip(order, order[1:], strict=False)) < 0.65 * len(order)


def test_sharding_edge_cases(spark, tmp_path):
    docs = edge_docs(spark)
    out = sharding.shuffled_shards(docs, 4)
    assert out.columns == [*docs.columns, "shard_", "slot"]
    assert Counter(tuple(r)[:-2] for r in out.collect()) == Counter(map(tuple, docs.collect()))
    assert sharding.shuffled_shards(empty_docs(spark)).count() == 0
    sharding.write_shards(sharding.shuffled_shards(frame(spark, ["a", "b", "c"]), 2), str(tmp_path / "out"))
    assert sorted(r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 0, 1]


def test_equal_rows_are_spread_over_buckets(spark):
    rows = spark.createDataFrame([(1, "the same")] * 3000 + [(k, "other") for k in range(500)], "doc_id long, text string")
    out = sharding.shuffled_shards(rows, 5, bucket_bytes=2048)
    plan = out.collect()
    assert Counter((r.doc_id, r.text) for r in plan) == Counter(map(tuple, rows.collect()))
    slots = defaultdict(list)
    for r in plan:
        slots[r.shard].append((r.slot, r.text))
    assert all([s for s, _ in sorted(v)] == list(range(700)) for v in slots.values())
    assert all(520 < sum(t == "the same" for _, t in v) < 680 for v in slots.values()), "the equal rows are in all shards alike"


def test_registered_sharding_writes_records_through_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1)
    kept = sharding.shuffled_shards
    seen = {}

    def small(rows, **options):
        seen["columns"] = rows.columns
        return kept(rows, bucket_bytes=20_000, **options)

    monkeypatch.setattr(sharding, "shuffled_shards", small)
    rows = queries.op5_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    assert "text" in seen["columns"] and Counter(r.doc_id for r in rows) == dict.fromkeys(docs, 1)
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


# --- op7 ---


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(2)
    odd = ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x3000), rng.randrange(0x1F000, 0x1FA00)])) for _ in range(200)) for _ in range(60)]
    odd += ["aaaaaaaaaaaaaaaa" * 9, "ab" * 5000, "<|endoftext|><|endoftext|> x", "it's we'll I'M", "  \n\n  \t x", "​\x1c\x1d\x85 "]
    for docs in (frame(spark, odd), edge_docs(spark), documents(spark)):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.select("doc_id", "text").collect())
        rows = bpe.token_counts(docs, vocabulary_path()).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert bpe.token_counts(empty_docs(spark), vocabulary_path()).count() == 0


def test_white_space_is_the_librarys_for_every_code_point():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    counter = bpe.BpeCounter(vocabulary_path())
    texts = [f"a{chr(c)}{chr(c)}b 1{chr(c)}2" for c in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x20000, 7)]]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    got = counter.counts(texts)
    wrong = [hex(ord(t[1])) for t, a, b in zip(texts, got, want, strict=True) if a != b]
    assert not wrong, wrong[:50]


# --- op8 ---


def test_png_round_trip_and_all_line_filters():
    rng = np.random.default_rng(0)
    for n in (1, 3, 700):
        data = rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes()
        assert media.decode_png(media.encode_png(data)).tobytes() == data
    image = rng.integers(0, 256, (12, 8), dtype=np.uint8)
    lines, above = [], np.zeros(8, int)
    for y, row in enumerate(image.astype(int)):
        left, corner = np.r_[0, row[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        dist = np.abs(np.stack([p - left, p - above, p - corner]))
        paeth = np.where((dist[0] <= dist[1]) & (dist[0] <= dist[2]), left, np.where(dist[1] <= dist[2], above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][y % 5]
        lines.append(bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    head = media._chunk(b"IHDR", (8).to_bytes(4) + (12).to_bytes(4) + bytes([8, 0, 0, 0, 0]))
    png = b"\x89PNG\r\n\x1a\n" + head + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == image).all()
    for at in (0, 20, 60, len(png) - 6):
        with pytest.raises(ValueError):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(png[:-12])


def test_cosine_hash_is_stable_under_noise_and_tells_images_apart():
    rng = np.random.default_rng(1)
    one = np.kron(rng.integers(20, 230, (12, 8)), np.ones((8, 8))).astype(np.uint8)
    bits = lambda a, b: sum(bin(p ^ q).count("1") for p, q in zip(media.cosine_hash(a), media.cosine_hash(b), strict=True))
    assert bits(one, np.clip(one + rng.normal(0, 4, one.shape), 0, 255).astype(np.uint8)) <= 12
    assert bits(one, rng.integers(0, 256, one.shape, dtype=np.uint8)) >= 16


def test_media_digest(spark):
    docs = edge_docs(spark)
    stored = media.media_columns(docs)
    rows = media.media_digest(stored).collect()
    want = []
    for i, text, *_ in TEXTS:
        data = (text or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        want.append((i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert Counter(tuple(r)[:5] for r in rows) == Counter(want)
    assert {(len(r.media), hashlib.sha256(r.media).hexdigest()) for r in stored.collect()} == {(r.media_bytes, r.media_sha256) for r in rows}
    assert media.media_digest(media.media_columns(empty_docs(spark))).count() == 0


# --- op9 ---


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("per_bucket", [4096, 2])
def test_mix_meets_its_targets(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", per_bucket)
    for docs in (documents(spark), edge_docs(spark)):
        rows = mixing.curriculum(docs, prefix="mix_").collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
        sizes, taken = Counter(), Counter()
        for r in rows:
            assert r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.mix_taken <= 2 * r.mix_size
            sizes[r.source] += r.mix_size
            taken[r.source] += r.mix_taken
        want = plain_targets(sizes)
        for r in rows:
            assert sum(r.mix_takes) == r.mix_taken and len(r.mix_takes) == len(r.mix_starts) == 2
            assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        again = {(r.doc_id, r.text, r.mix_taken, tuple(r.mix_starts)) for r in mixing.curriculum(docs, prefix="mix_").collect()}
        assert again == {(r.doc_id, r.text, r.mix_taken, tuple(r.mix_starts)) for r in rows}
    assert mixing.curriculum(empty_docs(spark)).count() == 0


def test_targets_of_very_many_sources(spark):
    """Ordering the sources in ranges gives the targets of ordering them in one task."""
    rng = random.Random(5)
    sizes = {f"s{k}": rng.randrange(0, 5000) for k in range(300)} | {None: 77, "é": 5, "\U0001f600": 6}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = plain_targets(sizes)
    for one_task in (1000, 10):
        got = {r.source: r.target for r in mixing.source_targets(table, one_task=one_task).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_registered_mix_names_every_position(spark):
    rows = queries.op9_mixing(spark, SF).collect()
    for r in rows:
        assert len(r.positions) == (-(-r.taken // r["size"]) if r["size"] else 0) and r.positions == sorted(r.positions)
        assert not r.positions or r.positions[0] == r.position
    assert {len(r.positions) for r in rows} == {0, 1, 2}


def test_running_totals_over_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), k, rng.randrange(9)) for k in range(500)]
    got = common.running(spark.createDataFrame(rows, "a int, k int, x int"), [F.col("a"), F.col("k")], {"before": F.col("x").cast("long")}).collect()
    total, want = 0, {}
    for a, k, x in sorted(rows):
        want[k] = total
        total += x
    assert {r.k: r.before for r in got} == want


def test_positions_invert_the_integral_of_the_schedule(spark):
    met = [k / 50 for k in range(50)]
    rows = spark.createDataFrame([(k, m) for k in range(3) for m in met], "k int, m double").select("k", "m", mixing.position(F.col("k"), F.col("m")).alias("t")).collect()
    for r in rows:
        grid = np.linspace(0, r.t, 20_001)
        full = np.linspace(0, 1, 20_001)
        f = lambda t, k=r.k: np.interp(t, *zip(*mixing.SCHEDULES[k], strict=True))
        assert abs(np.trapezoid(f(grid), grid) / np.trapezoid(f(full), full) - r.m) < 1e-6


def test_training_order_repeats_whole_documents(spark):
    docs = edge_docs(spark)
    out = mixing.training_order(docs)
    assert out.columns == docs.columns
    assert set(Counter((r.doc_id, r.text) for r in out.collect()).values()) <= {1, 2, 3, 4}
