"""Scalar expressions: paths, digests, text clean-up, signed years, intervals, boxes, text distances. All stay in the JVM unless they say otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(*conditions: tuple[Column, str | Column]) -> Column:
    """Array of the messages whose conditions hold; a null condition does not hold."""
    items = [F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in conditions]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# -- paths, digests, text -------------------------------------------------------------------------


def path_problems(path: Column) -> Column:
    """backslash, absolute and traversal, each by itself; no path has no problem."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return present(
        (path.contains("\\"), "backslash"),
        (path.startswith("/") | ((F.length(path) > 1) & (F.substring(path, 2, 1) == ":")), "absolute"),
        (F.array_contains(F.split(slashed, "/"), ".."), "traversal"),
    )


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def stable_uint64(*parts: Column) -> Column:
    """The first 64 bits of the parts' digest as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))


def url_host(c: Column) -> Column:
    """Lower-cased host without user and port; empty for what has none."""
    rest = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(rest)


def safe_cell(c: Column) -> Column:
    """A spreadsheet cell that cannot be read as a formula. A minus before a digit is a number's and stays."""
    return F.when(c.rlike(r"^(?:[=+@\t\r]|-(?![0-9]))"), F.concat(F.lit("'"), c)).otherwise(c)


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC with white space collapsed; Spark has no normaliser."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


@F.pandas_udf(T.StringType())
def normalise_reading(texts: pd.Series) -> pd.Series:
    """NFC, white space collapsed, case-folded."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()).casefold())


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length, in code points; null for an empty reference."""
    return F.try_divide(F.levenshtein(reference, hypothesis).cast("double"), F.length(reference).cast("double"))


def char_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, all cells of a column at a time in the bits of whole numbers: time len(a) * len(b) / word size, exact at any length."""
    if len(a) < len(b):
        a, b = b, a
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    ones, last = (1 << len(b)) - 1, 1 << max(len(b) - 1, 0)
    up, down, score = ones, 0, len(b)  # where a cell is one more, or one less, than that above it
    if not b:
        return len(a)
    for x in a:
        same = places.get(x, 0)
        across = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(across | up) & ones, up & across
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & ones, less << 1 & ones
        up, down = less | ~((same | down) | more) & ones, more & (same | down)
    return score


def _words(text: str) -> list[str]:
    return unicodedata.normalize("NFC", text).split()


@F.pandas_udf(T.IntegerType())
def word_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Edit distance in words (NFC, split at white space), of texts of any number of them; null if one is null."""
    return pd.Series([None if r is None or h is None else edit_distance(_words(r), _words(h)) for r, h in zip(reference, hypothesis, strict=True)], dtype="Int32")


@F.pandas_udf(T.IntegerType())
def word_count(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else len(_words(t)) for t in texts], dtype="Int32")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.try_divide(word_distance(reference, hypothesis).cast("double"), word_count(reference).cast("double"))


# -- signed years without a year 0 ------------------------------------------------------------------

# The words in which years and ranges are written.
BEFORE, SINCE, UNTIL_YEAR, FROM_YEAR, BETWEEN, OPEN = " BCE", " CE", "no later than ", "no earlier than ", " \u2013 ", "unconstrained"
CENTURY, ORDINALS, ORDINAL = " century", ("st", "nd", "rd"), "th"


def valid_year(y: Column, low: int = -3000, high: int = 2100) -> Column:
    return (y != 0) & y.between(low, high)


def year_span(start: Column, end: Column) -> Column:
    """Years from start to end, on a line without a year 0: years before it move up by one."""
    on_line = lambda y: y + (y < 0).cast("int")
    return on_line(end) - on_line(start)


def _with_era(number: Column, y: Column) -> Column:
    return F.concat(number.cast("string"), F.element_at(F.array(F.lit(BEFORE), F.lit(SINCE)), F.when(y < 0, 1).otherwise(2)))


def year_label(y: Column) -> Column:
    return _with_era(F.abs(y), y)


def century_label(y: Column) -> Column:
    """Centuries count from 1 on either side; 11th to 13th are no exception to be listed: their tens digit is 1."""
    n = ((F.abs(y) + 99) / 100).cast("int")
    unit = F.when((n / 10).cast("int") % 10 == 1, 0).otherwise(n % 10)
    ending = F.coalesce(F.get(F.array(*map(F.lit, ORDINALS)), unit - 1), F.lit(ORDINAL))
    return _with_era(F.concat(n.cast("string"), ending, F.lit(CENTURY)), y)


def span_label(start: Column, end: Column) -> Column:
    """Both bounds' labels, once if they are equal; a word stands for an open one, or for both."""
    open_side = F.when(start.isNull(), UNTIL_YEAR).when(end.isNull(), FROM_YEAR).otherwise("")
    both = F.concat(open_side, F.concat_ws(BETWEEN, year_label(start), year_label(end)))
    return F.when(start.eqNullSafe(end), F.coalesce(year_label(start), F.lit(OPEN))).otherwise(both)


def centuries_label(start: Column, end: Column) -> Column:
    return F.array_join(F.array_distinct(F.array(century_label(start), century_label(end))), BETWEEN)


def parse_range(c: Column) -> Column:
    """'-300..-100' or '-300 to -100' as struct(start, end); an empty side is open."""
    pattern = r"^\s*(-?\d+)?\s*(?:\.\.|to)\s*(-?\d+)?\s*$"
    part = lambda i: F.when(c.rlike(pattern), F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).cast("int"))
    return F.struct(part(1).alias("start"), part(2).alias("end"))


def common_range(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """struct(start, end) of two ranges with open (null) bounds, or null if they are apart."""
    low, high = F.array_max(F.array(a_start, b_start)), F.array_min(F.array(a_end, b_end))
    return F.when(F.coalesce(high - low, F.lit(0)) >= 0, F.struct(low.alias("start"), high.alias("end")))


def enclosing_range(start: Column, end: Column) -> Column:
    """Aggregate: the smallest range around all; a bound that is open anywhere stays open."""
    closed = lambda bound, at: F.when(F.count(bound) == F.count(F.lit(1)), at(bound))
    return F.struct(closed(start, F.min).alias("start"), closed(end, F.max).alias("end"))


def range_relation(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """none, one_sided, open, identical, disjoint or overlapping."""
    a_none, b_none = a_start.isNull() & a_end.isNull(), b_start.isNull() & b_end.isNull()
    any_open = a_start.isNull() | a_end.isNull() | b_start.isNull() | b_end.isNull()
    return (
        F.when(a_none & b_none, "none").when(a_none | b_none, "one_sided").when(any_open, "open")
        .when((a_start == b_start) & (a_end == b_end), "identical").when((a_start > b_end) | (b_start > a_end), "disjoint").otherwise("overlapping")
    )


def min_confidence(values: Column, order: list[str]) -> Column:
    """The lowest of an ordered scale's words in an array; words off the scale do not count."""
    ranks = F.filter(F.transform(values, lambda v: F.nullif(F.array_position(F.array(*map(F.lit, order)), v), F.lit(0))), lambda r: r.isNotNull())
    return F.try_element_at(F.array(*map(F.lit, order)), F.array_min(ranks).cast("int"))


# -- boxes and vectors ---------------------------------------------------------------------------------


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two struct(x, y, w, h); 0 without area."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(zero, F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union > 0, w * h / union).otherwise(zero)


def to_normalised(region: Column, width: Column, height: Column) -> Column:
    return F.struct((region["x"] / width).alias("x"), (region["y"] / height).alias("y"), (region["w"] / width).alias("w"), (region["h"] / height).alias("h"))


def to_pixels(region: Column, width: Column, height: Column) -> Column:
    """Rounded half to even, at least one pixel, kept within the image."""
    x = F.bround(region["x"] * width).cast("int")
    y = F.bround(region["y"] * height).cast("int")
    w = F.least(F.greatest(F.lit(1), F.bround(region["w"] * width).cast("int")), width - x)
    h = F.least(F.greatest(F.lit(1), F.bround(region["h"] * height).cast("int")), height - y)
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def argmax(p: Column) -> Column:
    """0-based; the lowest index among equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top_k(p: Column, k: int) -> Column:
    """0-based indices of the k largest, ties to the lower index."""
    pairs = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return F.transform(F.slice(pairs, 1, k), lambda s: s["i"])


def softmax(p: Column, temperature: float = 1.0) -> Column:
    """Softmax of log-probabilities over a temperature."""
    logs = F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(1e-12))) / temperature)
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)
