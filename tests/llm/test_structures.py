"""Conversation repair, collocations and URL filters against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from strandgraph.llm import collocations, queries, repair, urls
from tests.llm.cases import edge_docs, empty_docs, frame

SF = "/root/testdata/sf0.001"


# --- op11 ---


def cheapest(rows):
    """(cost, audit) of rows (initial, has to go, truncated), by trying every edit."""

    @lru_cache(None)
    def go(i, state, inserted):
        wanted = "a" if state == "u" else "u"
        options = [(0, "")] if i == len(rows) and state in "ea" else []
        if inserted < 4:
            cost, audit = go(i, wanted, inserted + 1)
            options.append((2 + cost, "I" + audit))
        if i < len(rows):
            initial, must_go, truncated = rows[i]
            cost, audit = go(i + 1, state, 0)
            options.append((3 + cost, "D" + audit))
            if not must_go:
                if initial == wanted or (initial == "s" and state == "e"):
                    cost, audit = go(i + 1, initial, 0)
                    options.append((truncated + cost, "K" + audit))
                cost, audit = go(i + 1, wanted, 0)
                options.append((2 + truncated + cost, "R" + audit))
        return min(options, default=(10**9, "~"))

    return go(0, "e", 0)


def test_repair_of_random_conversations_is_the_cheapest_and_smallest():
    rng, machine = random.Random(11), repair.Determinised()
    for _ in range(5000):
        rows = tuple((rng.choice(("u", "u", "a", "a", "s", "x", "")), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(10)))
        symbols = bytes(repair.symbol(i, "blank" if gone else "truncated" if cut else None) for i, gone, cut in rows)
        cost, trace = machine.repair(symbols)
        assert (cost, "".join(letters for _, letters in trace)) == cheapest(rows), rows
    assert len(machine.vectors) < 40


def plain_repair(rows):
    """The contract's row of rows (turn, role, text) in order, without damage."""
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\r\x0b\x0c")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    cost, audit = cheapest(tuple((role[:1], k in ("blank", "duplicate"), k == "truncated") for (_, role, _), k in zip(rows, kinds, strict=True)))
    lines, left, last = [], list(rows), "a"
    for letter in audit:
        role, text = left.pop(0)[1:] if letter != "I" else (None, "")
        if letter != "D":
            role = role if letter == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[0]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_repair_without_damage_equals_the_plain_one_and_a_long_conversation_spans_tasks(spark):
    rng, rows = random.Random(5), []
    for conv in range(60):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, None if rng.random() < 0.1 else turn * rng.randrange(1, 3), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No", "", " \t", "ok?\n", "long " * 9])))
    rows += [(None, 1, "user", "Hi."), (None, 2, "user", "Hi.")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in repair.repair_conversations(given, damage=False).collect()}
    of = {}
    for conv, turn, role, text in rows:
        of.setdefault(conv, []).append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert got == {conv: plain_repair(sorted(own, key=order)) for conv, own in of.items()}
    many = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(4000)]
    row = repair.repair_conversations(spark.createDataFrame(many, "conv_id long, turn long, role string, text string"), damage=False).first()
    assert (row.cost, row.audit) == (0, "K" * 4000)
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in many).encode()).hexdigest()


def test_repair_takes_nulls_empty_tables_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, None, None, None), (7, 1, "user", None), (8, None, "assistant", "x" * 200_000), (9, 2, "", "A."), (9, 2, "", "A.")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("conv", "pos", "copy", "fault", "kind", "state", "of"):
        given = given.withColumn(name, F.lit(1))
    found = {r.conv_id: r for r in repair.repair_conversations(given).collect()}
    assert set(found) == {None, 7, 8, 9}
    assert repair.repair_conversations(given.limit(0)).count() == 0
    named = spark.createDataFrame([("a", 0, "user", "Q?")], "id string, t int, r string, x string")
    assert repair.repair_conversations(named, id_col="id", turn_col="t", role_col="r", text_col="x", damage=False).first().audit == "KI"


def test_op11_covers_every_conversation(spark):
    out = queries.op11_conversation_repair(spark, SF)
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    assert out.count() == conversations.select("conv_id").distinct().count()
    assert all(re.fullmatch("[DIKR]*", r.audit) for r in out.collect())


# --- op12 ---


def plain_collocations(rows, least, top):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + n])) for n in range(1, 5) for i in range(len(w) - n + 1))
    some = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, w), a in some.items():
        longer = [v for (other, x), v in some.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if any(100 * v >= 80 * a for v in longer):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, k + 1, p.decode(), -a, x, y, totals[lang], -s) for lang, found in out.items() for k, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("block", [100_000, 7])
def test_collocations_equal_plain_counting_in_any_number_of_blocks(spark, block):
    rng = random.Random(12)
    words = ["a", "b", "c", "da", "Da", "ä", "漢", "x\x85y", "a-b", "\x1c", "\x00"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "! "]
    rows = [(k % 3 and ["en", "de", None][rng.randrange(3)], "".join(rng.choice(words[: rng.choice((3, 11))]) + rng.choice(ends) for _ in range(rng.randrange(60)))) for k in range(150)]
    rows = [(lang or None, text) for lang, text in rows] + [("en", None), (None, ""), ("und", "a b c a b c " * 200)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(r) for r in collocations.collocations(docs, least=5, top=40, block=block).collect()]
    want = plain_collocations(rows, 5, 40)
    assert len(got) == len(want) and set(got) == want


def test_runs_are_read_once_at_any_number_of_candidates(spark):
    docs, jobs = frame(spark, ["a b c d e f g h a c e g"] * 6), []
    for block in (2, 1000):
        spark.sparkContext.setJobGroup(f"op12 {block}", "")
        assert collocations.phrase_counts(docs, least=5, block=block)[0].count() == 11 + 10 + 9
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"op12 {block}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_overlaps_count_and_counts_may_pass_64_bits_in_products(spark):
    docs = frame(spark, ["x x x x x x"] * 10)
    assert {(r.phrase, r.a) for r in collocations.phrase_counts(docs, least=5)[0].select("phrase", F.col("n").alias("a")).collect()} == {("x x", 50), ("x x x", 40), ("x x x x", 30)}
    big = 6_000_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, n long")
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7), ("en", None, 3 * big)], "lang string, word string, n long")
    assert collocations.cut_scores(phrases, words).first().score == 2_000_000 * big // (2 * big + 7)


def test_collocations_take_edge_documents(spark):
    assert collocations.collocations(empty_docs(spark)).count() == 0
    assert collocations.collocations(edge_docs(spark), least=2, top=5).count() > 0
    assert collocations.collocations(frame(spark, [None, "", " ", ".", "one"]), least=1).count() == 0


# --- op13 ---


def folded(url):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    return "^" + re.sub(r"[^a-z0-9/.\-_:?&=%#~+]", "*", lower) + "$"


def plain_judgement(given):
    """(host, path, rule, score) of each URL; the probabilities by recursion over contexts."""
    rules, rows = dict(urls.RULES), []
    for url in given:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rows.append((folded(url), host, path, max(fits, key=len, default=None), url is not None and hashlib.md5(url.encode()).hexdigest()[0] < "3"))
    n = {True: Counter(), False: Counter()}
    for text, _, _, rule, held_out in rows:
        if rule and not held_out:
            n[rules[rule]].update((text[e - k : e], text[e]) for e in range(1, len(text)) for k in range(5) if e >= k)
    total, kinds = {ok: Counter() for ok in n}, {ok: Counter() for ok in n}
    for ok, counts in n.items():
        for (context, _), v in counts.items():
            total[ok][context] += v
            kinds[ok][context] += 1
    every = total[True][""] + total[False][""]

    def p(ok, context, s):
        shorter = p(ok, context[1:], s) if context else 1 / (len(urls.SYMBOLS) + 1)
        if not every or total[True][context] + total[False][context] < every / 4096 or not total[ok][context]:
            return shorter
        return (n[ok][context, s] + kinds[ok][context] * shorter) / (total[ok][context] + kinds[ok][context])

    score = lambda t: sum(math.log(p(True, t[max(0, e - 4) : e], t[e]) / p(False, t[max(0, e - 4) : e], t[e])) for e in range(1, len(t))) / (len(t) - 1)
    return [(host, path, rule, score(text)) for text, host, path, rule, _ in rows]


def test_scores_and_rules_equal_a_plain_model(spark):
    given = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    given += [None, "", "no scheme/es/", "http://EXAMPLE.org/en/1x", "ftp://org", "ftp://org/", "a://b.com/fr/?q", "x://y://com/de/", "http://notorg/", "ünï://漢.example.org/es/a?b#c", "http://u.net/" + "ab/" * 3000]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = urls.judge_urls(pages).orderBy("page_id").collect()
    for row, (host, path, rule, score) in zip(got, plain_judgement(given), strict=True):
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert abs(row.score - score) < 1e-5
        assert row.verdict == ("allow" if (dict(urls.RULES)[rule] if rule else row.score >= row.threshold) else "block")


def test_models_agree_with_rules_that_they_have_not_seen(spark):
    rows = urls.judge_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")).filter("rule is not null")
    good = rows.filter((F.col("score") >= F.col("threshold")) == (F.col("verdict") == "allow")).count()
    assert good >= 0.95 * rows.count()


def test_urls_take_edge_tables(spark):
    pages = spark.createDataFrame([(1, None), (None, "http://a.net/x"), (2, "http://a.net/x"), (2, "http://a.net/x"), (3, "")], "page_id long, url string")
    for name in ("host", "score", "gram", "text", "row", "allowed", "__k"):
        pages = pages.withColumn(name, F.lit("c"))
    rows = urls.judge_urls(pages).collect()
    assert len(rows) == 5 and {(r.score, r.verdict) for r in rows} == {(0.0, "allow")}
    assert urls.judge_urls(pages.limit(0)).count() == 0
    mixed = spark.createDataFrame([(k, f"http://{'a.org' if k % 2 else 'b.com'}/{'x' if k % 2 else 'de'}/{k}") for k in range(200)] + [(None, None)], "page_id long, url string").withColumn("verdict", F.lit(1))
    kept = urls.allowed_pages(mixed)
    assert kept.columns == mixed.columns and {r.page_id for r in kept.filter("page_id is not null").collect()} == set(range(1, 200, 2))
