"""Scalar text functions as pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script and the underscore, as the tokenizer's word class.
W = r"[\p{L}\p{N}_]"
WORD = rf"({W}(?:[\p{{L}}\p{{N}}_.]*{W})?)"


#: Characters that count as white space at the ends of a text.
_SPACE = r"[\s\x1c-\x1f]"


def expand_identifiers(value: Column) -> Column:
    """A space at lower-to-upper boundaries; underscores and hyphens become spaces."""
    return F.translate(F.regexp_replace(value, r"(?<=[a-z0-9])(?=[A-Z])", " "), "_-", "  ")


def node_document(node: dict[str, Column], source: Column) -> Column:
    """Identity, its expanded form and the source, on lines of their own."""
    identity = F.concat_ws(" ", *node.values())
    return F.concat_ws("\n", identity, expand_identifiers(identity), source)


def words(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(1))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_ngrams(value: Column) -> Column:
    """Words and adjacent pairs of words, repeats kept."""

    def both(w: Column) -> Column:
        firsts = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
        pairs = F.zip_with(firsts, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(w, pairs)

    return _bound(words(value), both)


def char_wb_ngrams(value: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside white-space words padded by one space, repeats kept."""
    padded = F.transform(F.filter(F.split(F.lower(value), rf"(?U){_SPACE}+"), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x, F.lit(" ")))

    def of_size(word: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
        return F.transform(starts, lambda at: F.when(F.length(word) >= n, F.substring(word, at, F.lit(n))))

    def grams(word: Column) -> Column:
        return F.filter(F.concat(*[of_size(word, n) for n in range(low, high + 1)]), lambda g: g.isNotNull())

    return F.flatten(F.transform(padded, grams))


def location(path: Column, start_line: Column) -> Column:
    return F.when(start_line <= 0, path).otherwise(F.concat_ws(":", path, start_line.cast("string")))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(kind, F.lit(":"), source, F.lit("->"), target)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def truncate_source(text: Column, limit: int) -> Column:
    """A text of at most ``limit`` characters as it is; of a longer one the beginning, stripped at its end, and an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, limit - 1), rf"(?U){_SPACE}+\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def display_round(value: Column, digits: int) -> Column:
    """Rounded for display: to the nearest of the binary value itself, and exact halves to the even digit.

    The value is compared with the half between two results in whole numbers: its bits are taken in three
    pieces of 30, which reach below any half of a result that is not 0. Beyond a million, where doubles have few digits left, the decimal text is rounded.
    """
    scale = 10**digits
    size = F.abs(value)
    low = F.floor(size * scale)

    def compare(x: Column) -> Column:
        """The sign of 2 scale size - (2 low + 1)."""
        first = F.floor(x * 2.0**30)
        rest = x * 2.0**30 - first
        second = F.floor(rest * 2.0**30)
        rest = rest * 2.0**30 - second
        third = F.floor(rest * 2.0**30)
        ahead = 2 * scale * first - (2 * low + 1) * 2**30
        # a piece is under 2^30, so what follows can not turn a difference of over 2 scale
        for piece in (second, third):
            ahead = F.when(F.abs(ahead) > 2 * scale, ahead).otherwise(ahead * 2**30 + 2 * scale * piece)
        return F.signum(ahead)

    sign = compare(size)
    up = F.when(sign > 0, 1).when(sign < 0, 0).otherwise(low % 2)
    near = F.signum(value) * ((low + up) / scale)
    return F.when(value.isNull() | F.isnan(value), value).when(size < 2.0**20, near).otherwise(F.bround(value.cast("decimal(38,18)"), digits).cast("double"))


def _authority(url: Column) -> tuple[Column, Column]:
    """Host in lower case with its port, and the path, of scheme://[user@]host[:port]/path."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(rest, r"([^@]*)$", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return host, path


def sanitize_remote_url(value: Column) -> Column:
    """A remote without credentials, query, fragment or local path; the short form becomes ssh."""
    remote = F.trim(value)
    host, path = _authority(remote)
    scheme = F.lower(F.regexp_extract(remote, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    short = F.concat(F.lit("ssh://"), F.regexp_extract(F.regexp_extract(remote, r"^([^:]*):", 1), r"([^@]*)$", 1), F.lit("/"), F.regexp_extract(remote, r"^[^:]*:/*(.*)$", 1))
    return (
        F.when(value.isNull() | (value == ""), F.lit(None))
        .when(remote.startswith("/") | remote.startswith("file:"), F.lit(None))
        .when(~remote.contains("://") & remote.contains(":"), short)
        .when(~remote.contains("://"), F.lit(None))
        .otherwise(F.concat(scheme, F.lit("://"), host, path))
    )


def sanitize_bundle_url(value: Column) -> Column:
    """The stricter form of bundles: http, https and git@ only."""
    host, path = _authority(value)
    web = value.rlike("^(?i)https?://") & (host != "")
    return F.when(web, F.concat(F.lower(F.regexp_extract(value, "^([A-Za-z]+):", 1)), F.lit("://"), host, path)).when(
        value.startswith("git@") & value.contains(":"), F.regexp_extract(value, r"^([^?#]*)", 1)
    )


def repository_name(remote: Column, folder: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(F.regexp_replace(_authority(remote)[1], "/+$", ""), "/"), -1), r"\.git$", "")
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(folder)


def describe_delta(metric: str, before: Column, after: Column) -> Column:
    delta = after - before
    word = F.when(delta > 0, F.lit("increases")).otherwise(F.lit("decreases"))
    return F.when(F.abs(delta) < 1e-12, F.lit(f"{metric} is unchanged")).otherwise(F.format_string(f"{metric} %s by %.3f", word, F.abs(delta)))


def html_escape(value: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(plain), F.lit(safe))
    return value


def strength_bucket(strength: Column) -> Column:
    return F.least(F.lit(4), F.floor(strength * 4)).cast("int")


def node_size(direct: Column, relationship: Column) -> Column:
    return 14 + 24 * F.greatest(direct, relationship)


def overview_node_size(degree: Column) -> Column:
    return 15 + 2.5 * F.log1p(degree)


def short_label(value: Column) -> Column:
    return F.when(F.length(value) <= 28, value).otherwise(F.concat(F.substring(value, 1, 25), F.lit("...")))


def title_label(identifier: Column) -> Column:
    return F.initcap(F.replace(identifier, F.lit("-"), F.lit(" ")))
