"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import bpe, collocations, decontamination, licenses, lm, media, mixing, paragraphs, repair, sharding, simhash, toxicity, urls
from strandgraph.llm.common import crc_remainder, table
from strandgraph.plans.lineage import shared_folder


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_spans(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole records are shuffled and written by shard; the rows are those read back from the files."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(sharding.shuffled_shards(table(spark, sf_dir, "documents"), size=size), path)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return spark.read.parquet(path).select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.media_columns(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.curriculum(docs, prefix="")
    drawn = F.filter(F.arrays_zip("starts", "takes"), lambda x: x["takes"] > 0)
    positions = F.transform(drawn, lambda x: x["starts"]).alias("positions")
    mixed = mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.element_at("starts", 1).alias("position"), positions)
    return mixed.repartitionByRange("position").sortWithinPartitions("position", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_score(docs, model, "score").drop("text")
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.withColumns({c: F.round(c, 4) for c in ("score", "threshold")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_license_scan, op3_paragraph_dedup, op4_simhash, op5_sharding,
        op6_lm_scores, op7_token_counts, op8_media, op9_mixing, op10_toxicity,
        op11_conversation_repair, op12_collocations, op13_url_filter,
    )
}


def _op2_sql() -> str:
    """Base scan and template containment stated directly, without filters or order."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    templates = []
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        tokens = sorted(set(licenses.words_of(text)))
        need = -int(-(licenses.THRESHOLD * len(tokens) - 1e-9) // 1)
        templates += [f"({k}, '{label}', {len(tokens)}, {need}, '{t}')" for t in tokens]
    cases = []
    for phrase, label in licenses.PHRASES.items():
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        cases.append(f"WHEN {test} THEN '{label}'")
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS w FROM docs),
places AS (SELECT r, i, CASE {' '.join(cases)} END AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE regexp_matches(t, 'cc|general|reserved'))),
base AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, array_agg(DISTINCT label) AS labels FROM places WHERE label IS NOT NULL GROUP BY r),
templates(k, label, size, need, token) AS (VALUES {', '.join(templates)}),
blocks AS (SELECT DISTINCT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)),
numbered AS (SELECT row_number() OVER () AS b, r, line FROM blocks),
held AS (SELECT DISTINCT b, r, word FROM (SELECT b, r, unnest(regexp_extract_all(line, '{word}')) AS word FROM numbered)),
met AS (SELECT h.b, h.r, m.label, count(*) / m.size AS containment FROM held h JOIN templates m ON h.word = m.token GROUP BY h.b, h.r, m.k, m.label, m.size, m.need HAVING count(*) >= m.need),
found AS (SELECT r, array_agg(DISTINCT label) AS labels, max(containment) AS best, count(DISTINCT b) AS n_blocks FROM met GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0 ELSE coalesce(f.best, 0.0) END::DOUBLE AS score, coalesce(f.n_blocks, 0)::BIGINT AS n_blocks
FROM words d LEFT JOIN base b USING (r) LEFT JOIN found f USING (r)"""


#: A checksum by table, then the cheapest repair from each state as a struct of cost, letters and lines, from the last row to the first.
_OP11_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS kind FROM keyed, tbl),
rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM rows),
faulty AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS ini,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM placed),
ends AS (SELECT conv_id, max(i) AS n FROM faulty GROUP BY 1),
dp(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, {'c': 0, 's': '', 't': NULL::VARCHAR}, {'c': 4, 's': 'II', 't': 'user:' || chr(10) || 'assistant:'}, {'c': 2, 's': 'I', 't': 'assistant:'}, {'c': 0, 's': '', 't': NULL::VARCHAR} FROM ends
  UNION ALL
  SELECT conv_id, i,
    least(b0, {'c': 2 + x2.c, 's': 'I' || x2.s, 't': concat_ws(chr(10), 'user:', x2.t)}), least(b1, {'c': 2 + x2.c, 's': 'I' || x2.s, 't': concat_ws(chr(10), 'user:', x2.t)}), x2, x3
  FROM (SELECT *, least(b2, {'c': 2 + b3.c, 's': 'I' || b3.s, 't': concat_ws(chr(10), 'assistant:', b3.t)}) AS x2, least(b3, {'c': 2 + b2.c, 's': 'I' || b2.s, 't': concat_ws(chr(10), 'user:', b2.t)}) AS x3
  FROM (SELECT conv_id, i,
    least({'c': 3 + v0.c, 's': 'D' || v0.s, 't': v0.t}, {'c': CASE WHEN free AND ini = 'u' THEN k + v2.c WHEN free AND ini = 's' THEN k + v1.c ELSE 1000000 END, 's': 'K' || CASE ini WHEN 'u' THEN v2.s ELSE v1.s END, 't': concat_ws(chr(10), line, CASE ini WHEN 'u' THEN v2.t ELSE v1.t END)}, {'c': CASE WHEN free THEN 2 + k + v2.c ELSE 1000000 END, 's': 'R' || v2.s, 't': concat_ws(chr(10), 'user:' || text, v2.t)}) AS b0,
    least({'c': 3 + v1.c, 's': 'D' || v1.s, 't': v1.t}, {'c': CASE WHEN free AND ini = 'u' THEN k + v2.c ELSE 1000000 END, 's': 'K' || v2.s, 't': concat_ws(chr(10), line, v2.t)}, {'c': CASE WHEN free THEN 2 + k + v2.c ELSE 1000000 END, 's': 'R' || v2.s, 't': concat_ws(chr(10), 'user:' || text, v2.t)}) AS b1,
    least({'c': 3 + v2.c, 's': 'D' || v2.s, 't': v2.t}, {'c': CASE WHEN free AND ini = 'a' THEN k + v3.c ELSE 1000000 END, 's': 'K' || v3.s, 't': concat_ws(chr(10), line, v3.t)}, {'c': CASE WHEN free THEN 2 + k + v3.c ELSE 1000000 END, 's': 'R' || v3.s, 't': concat_ws(chr(10), 'assistant:' || text, v3.t)}) AS b2,
    least({'c': 3 + v3.c, 's': 'D' || v3.s, 't': v3.t}, {'c': CASE WHEN free AND ini = 'u' THEN k + v2.c ELSE 1000000 END, 's': 'K' || v2.s, 't': concat_ws(chr(10), line, v2.t)}, {'c': CASE WHEN free THEN 2 + k + v2.c ELSE 1000000 END, 's': 'R' || v2.s, 't': concat_ws(chr(10), 'user:' || text, v2.t)}) AS b3
  FROM (SELECT d.conv_id, f.i, v0, v1, v2, v3, ini, text, role || ':' || text AS line, coalesce(fault = 'truncated', false)::INT AS k, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS free
    FROM dp d JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i - 1)))),
steps AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faulty),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM steps GROUP BY 1),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.s, '') AS audit, sha256(coalesce(v0.t, '')) AS repaired_sha256
FROM every e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN dp d ON d.conv_id IS NOT DISTINCT FROM e.conv_id AND d.i = 1"""

#: All phrases counted directly.
_OP12_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM cut, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY 1, 2, 3),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, phrase, n AS a FROM f WHERE k > 1 AND n >= 30),
cuts AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM (SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, c.c, (2000000::HUGEINT * a // (x.n + y.n))::BIGINT AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM cand s JOIN (SELECT lang, k, a, string_split(phrase, ' ') AS w FROM cand) g ON g.lang = s.lang AND g.k > s.k AND contains(' ' || array_to_string(g.w, ' ') || ' ', ' ' || s.phrase || ' ') AND 100::HUGEINT * g.a >= 80::HUGEINT * s.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM lowest WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def _op13_sql() -> str:
    """The models' probabilities by length of context, and every symbol of a URL looked up at its longest kept context."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = []
    for rule, allowed in urls.RULES:
        name, _, rest = rule.partition("/")
        fits.append(f"('{rule}', '{name}', '/{rest}', {str(allowed).lower()})")
    levels, previous = [], None
    for size in range(1, urls.ORDER + 2):
        short = "1.0::DOUBLE / 50 AS sy, 1.0::DOUBLE / 50 AS sn FROM known" if previous is None else f"s.py AS sy, s.pn AS sn FROM known JOIN {previous} s ON s.gram = substring(known.gram, 2)"
        levels.append(f"""l{size} AS (SELECT gram, by_, bn, sy, sn, CASE WHEN ny + ty > 0 THEN (yes + ty * sy) / (ny + ty) ELSE sy END AS py, CASE WHEN nn + tn > 0 THEN (no_ + tn * sn) / (nn + tn) ELSE sn END AS pn
  FROM (SELECT known.*, {short} WHERE length(known.gram) = {size}))""")
        previous = f"l{size}"
    every = " UNION ALL ".join(f"SELECT gram, ln(py / pn) - ln(sy / sn) - (ln(by_) - ln(bn)) AS w FROM l{k + 1}" for k in range(urls.ORDER + 1))
    return rf"""
WITH rules(rule, name, start, allowed) AS (VALUES {', '.join(fits)}),
pages_ AS (SELECT row_number() OVER () AS r, page_id, url, coalesce(url, '') AS u FROM pages),
cut AS (SELECT r, page_id, url, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_replace(translate(u, '{upper}', '{lower}'), '(?s)[^a-z0-9/.\-_:?&=%#~+]', '*', 'g') AS t FROM pages_),
fit AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(allowed, length(rule)) AS allowed FROM cut JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY r),
rows AS (SELECT c.*, rule, allowed, coalesce(left(md5(url), 1) < '3', false) AS held_out, '^' || t || '$' AS m FROM cut c LEFT JOIN fit USING (r)),
grams AS (SELECT r, allowed, held_out, t, e, n, substring(m, e - n + 1, n) AS gram FROM (SELECT *, unnest(range(1, least({urls.ORDER + 1}, e) + 1)) AS n FROM (SELECT *, unnest(range(1, length(m) + 1)) AS e FROM rows))),
counted AS (SELECT gram, left(gram, length(gram) - 1) AS c, count(*) FILTER (allowed) AS yes, count(*) FILTER (NOT allowed) AS no_ FROM grams WHERE allowed IS NOT NULL AND NOT held_out AND gram <> '^' GROUP BY 1),
held AS (SELECT c, sum(yes) AS ny, sum(no_) AS nn, count(*) FILTER (yes > 0) AS ty, count(*) FILTER (no_ > 0) AS tn FROM counted GROUP BY 1),
kept AS (
  SELECT *, CASE WHEN ny + ty > 0 THEN ty / (ny + ty)::DOUBLE ELSE 1.0 END AS by_, CASE WHEN nn + tn > 0 THEN tn / (nn + tn)::DOUBLE ELSE 1.0 END AS bn
  FROM held WHERE ny + nn >= (SELECT ny + nn FROM held WHERE c = '') * {urls.KEPT}::DOUBLE),
known AS (SELECT gram, c, yes, no_, ny::DOUBLE AS ny, nn::DOUBLE AS nn, ty, tn, by_, bn FROM counted JOIN kept USING (c)),
{', '.join(levels)},
weights AS (SELECT gram, round(sum(w) * 1000000)::BIGINT AS w FROM ({every} UNION ALL SELECT c, ln(by_) - ln(bn) FROM kept) GROUP BY 1),
sums AS (SELECT r, sum(w)::BIGINT AS s FROM grams LEFT JOIN weights USING (gram) GROUP BY r),
scored AS (SELECT rows.*, coalesce(s, 0) / (length(t) + 1)::DOUBLE + coalesce((SELECT w FROM weights WHERE gram = ''), 0) AS score FROM rows JOIN sums USING (r)),
bins AS (SELECT greatest(-{urls.WIDEST}, least({urls.WIDEST}, floor(score / {urls.BIN}))) AS bin, count(*) FILTER (allowed) AS yes, count(*) FILTER (NOT allowed) AS no_ FROM scored WHERE allowed IS NOT NULL AND held_out GROUP BY 1),
cuts AS (
  SELECT coalesce((lag(bin) OVER (ORDER BY bin) + 1 + bin) / 2, bin) AS at_, coalesce(sum(yes) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost,
    coalesce(sum(no_) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caught, sum(yes) OVER () AS ay, sum(no_) OVER () AS an FROM bins),
best AS (SELECT coalesce((SELECT at_ * {urls.BIN} FROM cuts WHERE ay > 0 AND an > 0 ORDER BY round(lost / ay + 1 - caught / an, 9), abs(at_), at_ LIMIT 1), 0.0) AS threshold)
SELECT page_id, host, path, rule, CASE WHEN coalesce(allowed, score >= threshold) THEN 'allow' ELSE 'block' END AS verdict, round(score / 1000000, 4) AS score, round(threshold / 1000000, 4) AS threshold FROM scored, best"""


ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": _op2_sql(), "op11_conversation_repair": _OP11_SQL, "op12_collocations": _OP12_SQL, "op13_url_filter": _op13_sql(),
}
