"""URL filters by a ratio of character language models, in DataFrame functions only.

Listed rules settle the URLs of their hosts and paths. For all others two Markov models of variable
order, one of the URLs that the rules allow and one of those that they block, give log-probabilities; their
difference per character is compared with a calibrated threshold.

Characters are folded to fifty symbols. Contexts of up to four symbols are kept if they hold a
share of all symbols, so there are at most ``1 / KEPT`` of them in each order, at any size of the input. A context's
distribution is Witten-Bell smoothed with that of the next shorter one:
``p(s | c) = (n(cs) + t(c) p(s | c')) / (n(c) + t(c))`` with t the number of different symbols behind c, down to the
uniform distribution. Where s never follows c, both models back off by factors that do not depend on s. The
logarithm of the ratio is therefore a sum over the URL's n-grams: what a seen symbol adds to the shorter
context, and for each context its backing off. The two make one table of weights by n-gram, of a proven
bound, which is broadcast; scoring cuts a URL into n-grams and adds their weights, as whole millionths, so sums do not
depend on their order.

Four fifths of the settled URLs, chosen by a digest, train the models; on the other fifth the threshold is taken where
the shares of wrongly blocked and wrongly passed URLs have the least sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.llm.common import col, fresh, stored
from strandgraph.operators.skew import spread_join

#: Fixed values: (rule, allowed); a rule is a host with its subdomains, and the beginning of the path.
RULES = (("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False))
#: Symbols of a context, and the least share of all symbols that a kept context holds.
ORDER, KEPT = 4, 1 / 4096
#: Every other character counts as the last of the symbols.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789/.-_:?&=%#~+*"
BEGIN, END = "^", "$"
#: Characters of a URL that are cut at once, and the width of a bin of scores in the calibration.
PIECE, BIN, WIDEST = 256, 10_000, 2_000
MICRO = 1_000_000


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = (host.eqNullSafe(F.lit(name)) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def allowed_by(rule: Column, rules: tuple = RULES) -> Column:
    return F.when(rule.isin([r for r, ok in rules if ok]), True).when(rule.isNotNull(), False)


def folded(url: Column) -> Column:
    """The URL in the models' symbols; a null one is empty."""
    lower = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(lower, r"(?s)[^a-z0-9/.\-_:?&=%#~+]", "*")


def ngrams(frame: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``(keys..., gram)``: all n-grams of the folded URL between its marks, n up to ``ORDER + 1``.

    A long URL is cut into pieces first, each with the end of the one before it, so that no character is looked up
    from the beginning of a long text.
    """
    whole = F.concat(F.lit(BEGIN), F.col(text), F.lit(END))
    pieces = frame.select(*keys, F.regexp_extract_all(whole, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("__pieces"))
    cut = pieces.select(*keys, "__pieces", F.posexplode("__pieces").alias("__k", "__own"))
    before = F.when(F.col("__k") > 0, F.right(F.get("__pieces", F.col("__k") - 1), F.lit(ORDER))).otherwise(F.lit(""))
    cut = cut.select(*keys, before.alias("__before"), "__own").select(*keys, F.length("__before").alias("__skip"), F.concat("__before", "__own").alias("__piece"))
    ends = cut.select(*keys, "__piece", F.explode(F.sequence(F.col("__skip") + 1, F.length("__piece"))).alias("__end"))
    sized = ends.select(*keys, "__piece", "__end", F.explode(F.sequence(F.lit(1), F.least(F.lit(ORDER + 1), F.col("__end")))).alias("__n"))
    return sized.select(*keys, F.substring(F.col("__piece"), F.col("__end") - F.col("__n") + 1, F.col("__n")).alias("gram"))


def weights(settled: DataFrame, *, order: int = ORDER, kept: float = KEPT) -> DataFrame:
    """``(gram, weight)`` in millionths, of the URLs ``settled(text, allowed)``: the models' difference, cut by n-grams.

    Without URLs there is no weight; a context that one of the models has not seen leaves its shorter one as it is.
    """
    pre = settled.groupBy("text", "allowed").agg(F.count("*").alias("times"))
    counted = ngrams(pre, "text", ["allowed", "times"]).filter(F.col("gram") != BEGIN)
    yes, no = (F.sum(F.when(F.col("allowed") == a, F.col("times")).otherwise(0)).alias(n) for a, n in ((True, "yes"), (False, "no")))
    grams = stored(counted.groupBy("gram").agg(yes, no), "grams")
    context = F.expr("left(gram, length(gram) - 1)")
    of = grams.withColumn("context", context)
    held = of.groupBy("context").agg(
        F.sum("yes").alias("n_yes"), F.sum("no").alias("n_no"), F.count_if(F.col("yes") > 0).alias("t_yes"), F.count_if(F.col("no") > 0).alias("t_no")
    )
    # the empty context has all symbols, and so the total
    total = held.filter("context = ''").select((F.col("n_yes") + F.col("n_no")).alias("all"))
    held = held.crossJoin(F.broadcast(total)).filter((F.col("n_yes") + F.col("n_no")) >= F.col("all") * kept)  # one row
    contexts = F.broadcast(held.drop("all"))
    known = stored(of.join(contexts, "context"), "grams")
    uniform = F.lit(1.0 / (len(SYMBOLS) + 1))
    smooth = lambda n, t, count, shorter: F.when(F.col(n) + F.col(t) > 0, (F.col(count) + F.col(t) * shorter) / (F.col(n) + F.col(t))).otherwise(shorter)
    level, out = None, None
    for size in range(1, order + 2):
        here = known.filter(F.length("gram") == size)
        if level is None:
            here = here.withColumn("short_yes", uniform).withColumn("short_no", uniform)
        else:
            here = here.join(F.broadcast(level), F.expr("substring(gram, 2)") == F.col("short")).drop("short")
        here = here.withColumn("p_yes", smooth("n_yes", "t_yes", "yes", F.col("short_yes"))).withColumn("p_no", smooth("n_no", "t_no", "no", F.col("short_no")))
        here = stored(here, "level")
        level = here.select(F.col("gram").alias("short"), F.col("p_yes").alias("short_yes"), F.col("p_no").alias("short_no"))
        own = F.log(F.col("p_yes") / F.col("p_no")) - F.log(F.col("short_yes") / F.col("short_no")) - _back_off()
        part = here.select("gram", own.alias("weight"))
        out = part if out is None else out.unionByName(part)
    backing = held.filter("context <> ''").select(F.col("context").alias("gram"), _back_off().alias("weight"))
    empty = held.filter("context = ''").select(F.lit("").alias("gram"), _back_off().alias("weight"))
    summed = out.unionByName(backing).unionByName(empty).groupBy("gram").agg(F.sum("weight").alias("weight"))
    return summed.select("gram", F.round(F.col("weight") * MICRO).cast("long").alias("weight"))


def _back_off() -> Column:
    """What a symbol that never follows the context takes from its shorter one, as a logarithm of the two models' factors."""
    factor = lambda n, t: F.when(F.col(n) + F.col(t) > 0, F.col(t) / (F.col(n) + F.col(t))).otherwise(F.lit(1.0))
    return F.log(factor("n_yes", "t_yes")) - F.log(factor("n_no", "t_no"))


def scored(frame: DataFrame, table: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``(keys..., score)``: the weights of a folded URL's n-grams per symbol, in millionths. ``table`` is of bounded size."""
    every_symbol = table.filter("gram = ''").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("__each"))
    found = ngrams(frame, text, [*keys, text]).join(F.broadcast(table), "gram", "left")
    sums = found.groupBy(*keys, text).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("__sum")).crossJoin(F.broadcast(every_symbol))  # one row
    return sums.select(*keys, (F.col("__sum") / (F.length(text) + 1) + F.col("__each")).alias("score"))


def threshold(held_out: DataFrame) -> DataFrame:
    """One row ``(threshold)``, the cut with the least sum of both shares of errors over ``held_out(score, allowed)``; 0 if a side is missing.

    Scores are counted in bins of a fixed number. A cut lies in the middle between two neighbouring bins that hold URLs;
    of equally good cuts the one nearest to 0 is taken.
    """
    bins = F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.floor(F.col("score") / BIN))).cast("int")
    yes, no = F.count_if("allowed").alias("yes"), F.count_if(~F.col("allowed")).alias("no")
    counts = held_out.groupBy(bins.alias("bin")).agg(yes, no)
    below, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    gap = F.coalesce((F.lag("bin").over(Window.orderBy("bin")) + 1 + F.col("bin")) / 2, F.col("bin")).alias("at")
    cuts = counts.select(gap, before("yes").alias("lost"), before("no").alias("caught"), F.sum("yes").over(every).alias("all_yes"), F.sum("no").over(every).alias("all_no"))
    errors = F.col("lost") / F.col("all_yes") + 1 - F.col("caught") / F.col("all_no")
    usable = cuts.filter("all_yes > 0 and all_no > 0").select(F.struct(F.round(errors, 9).alias("errors"), F.abs("at").alias("far"), "at").alias("cut"))
    return usable.agg(F.coalesce(F.min("cut")["at"] * BIN, F.lit(0.0)).cast("double").alias("threshold"))


def judge_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict, score and threshold.

    rule: the longest one that fits, else null. verdict: ``allow`` or ``block``, the rule's, else ``allow`` if the score
    reaches the threshold. score: how much likelier a symbol of the URL is, on average, among allowed than
    among blocked URLs, as a natural logarithm.

    A null URL, and one without ``://``, has an empty host and path and is judged by the models as what it is. Repeated
    rows count each and get a row each, other columns and their names play no part, an empty table gives no rows. Where the
    rules settle no URL all scores are 0 and all verdicts ``allow``. URLs may be of any length.
    """
    url = col(url_col)
    host, path = host_of(url), path_of(url)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("allowed", allowed_by(F.col("rule"), rules))
    held_out = F.coalesce(F.left(F.md5(F.col("url").cast("binary")), F.lit(1)) < "3", F.lit(False)).alias("held_out")
    rows = rows.select("row", "id", "host", "path", "rule", "allowed", held_out, folded(F.col("url")).alias("text"))
    table = stored(weights(rows.filter("allowed is not null and not held_out").select("text", "allowed")), "weights")
    found = stored(scored(rows, table, "text", ["row", "id", "host", "path", "rule", "allowed", "held_out"]), "scores")
    cut = threshold(found.filter("allowed is not null and held_out"))
    judged = found.crossJoin(F.broadcast(cut))  # one row
    verdict = F.when(F.coalesce(F.col("allowed"), F.col("score") >= F.col("threshold")), "allow").otherwise("block")
    micro = lambda c: (F.col(c) / MICRO).alias(c)
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), micro("score"), micro("threshold"))


def allowed_pages(pages: DataFrame, *, url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """``pages`` whose URL is allowed, all columns as they are; a URL that many pages share is dealt to several tasks."""
    urls = pages.select(col(url_col).alias("url")).distinct()
    good = judge_urls(urls, id_col="url", url_col="url", rules=rules).filter("verdict = 'allow'")
    key, of = fresh("__url", pages.columns), F.coalesce(F.concat(F.lit("u"), col(url_col)), F.lit(""))
    kept = good.select(F.coalesce(F.concat(F.lit("u"), "url"), F.lit("")).alias(key))
    keyed = stored(pages.withColumn(key, of), "pages")
    return spread_join(keyed, kept, [key], F.monotonically_increasing_id(), "left_semi").drop(key)
