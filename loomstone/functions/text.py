"""Text functions as Column expressions: tokens, slugs, categories, answer metrics, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.config import STOP_WORDS


def tokens(text: Column) -> Column:
    """Word tokens of the lower-cased text, letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def content_tokens(text: Column) -> Column:
    """Tokens of two letters or more without stop words."""
    return F.filter(tokens(text), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def slug_of_url(url: Column) -> Column:
    """Last path segment, else host; other signs than letters, digits, _ . - become _."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://", ""), r"[?#].*$", "")
    host, path = F.substring_index(rest, "/", 1), F.rtrim(F.regexp_replace(F.regexp_replace(rest, r"^[^/]*", ""), "/+$", ""))
    last = F.substring_index(path, "/", -1)
    return F.regexp_replace(F.when(last == "", host).otherwise(last), r"[^A-Za-z0-9_.-]", "_")


def raw_slug(url: Column) -> Column:
    """All after the last slash, as it stands."""
    return F.substring_index(url, "/", -1)


def title_slug(title: Column) -> Column:
    return F.replace(title, F.lit(" "), F.lit("_"))


def wiki_slug(url: Column) -> Column:
    """After /wiki/, decoded, without the fragment; + stays +."""
    tail = F.replace(F.substring_index(url, "/wiki/", -1), F.lit("+"), F.lit("%2B"))
    return F.when(F.contains(url, F.lit("/wiki/")), F.substring_index(F.try_url_decode(tail), "#", 1))


def article_root(slug: Column) -> Column:
    return F.substring_index(slug, "__sec", 1)


def heading_level(tag: Column) -> Column:
    """1 to 4 by the first part of a joined tag, else null."""
    first = F.substring_index(tag, "+", 1)
    return F.when(first.rlike("^h[1-4]$"), F.substring(first, 2, 1).cast("int"))


def _category(tag: Column) -> Column:
    return (
        F.when(tag.isin("h1", "h2", "h3", "h4"), "heading").when(tag.isin("p", "merged"), "text").when(tag == "table", "table")
        .when(tag.isin("ul", "ol"), "list").when(tag.isin("img", "figure"), "media").when(tag.isin("blockquote", "pre"), "quote_code").otherwise("other")
    )


def category_of_last(tag: Column) -> Column:
    """By the last part of a joined tag: what follows the heading."""
    return _category(F.substring_index(tag, "+", -1))


def category_of_first(tag: Column) -> Column:
    """By the first part of a joined tag."""
    return _category(F.substring_index(tag, "+", 1))


def contains_answer(answer: Column, text: Column, trim: bool = True) -> Column:
    a = F.lower(F.trim(answer) if trim else answer)
    return (a != "") & F.contains(F.lower(text), a)


def normalized_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles (words of any script are told apart), single spaces."""
    x = F.regexp_replace(F.lower(text), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(a: Column, b: Column) -> Column:
    return (normalized_answer(a) == normalized_answer(b)).cast("double")


def token_f1(a: Column, b: Column) -> Column:
    """Bag overlap F1 of the normalised answers; if either is empty, whether both are."""
    x, y = (F.filter(F.split(normalized_answer(c), " "), lambda t: t != "") for c in (a, b))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(x, lambda u: u == t)), F.size(F.filter(y, lambda u: u == t))))
    p, r = common / F.size(x), common / F.size(y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), (F.size(x) == F.size(y)).cast("double")).when(common == 0, 0.0).otherwise(2 * p * r / (p + r))


def anls(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """1 - edit distance / longer length, 0 below the threshold, 1 for two empty answers."""
    x, y = (F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")) for c in (a, b))
    longer = F.greatest(F.length(x), F.length(y))
    s = 1 - F.levenshtein(x, y) / longer
    return F.when(longer == 0, 1.0).when(s < threshold, 0.0).otherwise(s)


def parsed_qa(raw: Column) -> Column:
    """struct(question, answer) of a model's reply, or null: SKIP, strict JSON, fenced JSON, then the first object with a question."""
    t = F.trim(raw)
    tries = [t, F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.regexp_extract(t, r'(?s)(\{[^{}]*"question"[^{}]*\})', 1)]
    out = []
    for c in tries:
        q, a = F.trim(F.get_json_object(c, "$.question")), F.trim(F.get_json_object(c, "$.answer"))
        out.append(F.when((q != "") & (a != ""), F.struct(q.alias("question"), a.alias("answer"))))
    return F.when(~F.upper(t).startswith("SKIP"), F.coalesce(*out))


def cache_key(*parts: Column) -> Column:
    """Digest of the parts, each followed by a zero byte."""
    return F.sha2(F.concat(*[x for p in parts for x in (p.cast("binary"), F.lit(bytearray(b"\0")))]), 256)


def scaled_side(side: Column, scale: float) -> Column:
    if not 0 < scale < 1:
        raise ValueError("scale must lie between 0 and 1")
    return F.greatest(F.lit(1), F.bround(side * scale).cast("int"))


def short_label(label: Column, most: int = 20) -> Column:
    """For drawings: the tail of a URL, _ as space, clipped."""
    return F.substring(F.replace(F.substring_index(F.regexp_replace(label, "/+$", ""), "/", -1), F.lit("_"), F.lit(" ")), 1, most)
