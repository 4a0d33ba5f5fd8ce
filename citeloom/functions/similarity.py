"""Similarity features: set and arithmetic features as Columns, fuzzy ratios as Arrow UDFs.

The ratios use the insert/delete similarity 2 LCS / (|a| + |b|), the longest common subsequence computed
bit-parallel on Python integers; equal inputs in a batch are computed once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions import text

# Thresholds of scoring and pooling.
TITLE_ACCEPT, TITLE_BACKFILL, AUTHOR_ACCEPT, COMPOSITE_REJECT = 0.92, 0.95, 0.80, 0.40
TAIL_JACCARD, AUTHOR_DISTINCT = 0.34, 0.60
SAME_VENUE, TOKEN_SET_GUARD = 0.8, 0.7


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


@lru_cache(100_000)
def ratio(a: str, b: str) -> float:
    """Insert/delete similarity from 0 to 1; two empty texts are equal."""
    if a == b:
        return 1.0
    return 2 * lcs(a, b) / (len(a) + len(b))


def sorted_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and either side's words."""
    x, y = set(a.split()), set(b.split())
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if not x or not y:
        return 0.0
    if both and (not left or not right):
        return 1.0
    base = " ".join(both)
    p, q = " ".join(both + left), " ".join(both + right)
    return max(ratio(p, q), ratio(base, p), ratio(base, q)) if both else ratio(p, q)


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text to a window of the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    ends = range(1 - n, len(long))
    return max(ratio(short, w) for i in ends if (w := long[max(0, i) : i + n]))


_FOLD = str.maketrans(dict(zip(text.ACCENTED, text.PLAIN, strict=True)) | {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"})


def plain_title(s: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", " ", unicodedata.normalize("NFC", s or "").translate(_FOLD).lower())).strip()


def title_similarity(a: str | None, b: str | None) -> float:
    """Best of plain and word-sorted ratio; the word-set ratio counts only for titles of like length."""
    x, y = plain_title(a), plain_title(b)
    if not x or not y:
        return 0.0
    best = max(ratio(x, y), sorted_ratio(x, y))
    m, n = len(x.split()), len(y.split())
    if min(m, n) / max(m, n) >= TOKEN_SET_GUARD:
        best = max(best, set_ratio(x, y))
    return best


def _pairwise(f):
    """Arrow UDF of a function of two values, each distinct pair once per batch."""

    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        keys = [tuple(x) if hasattr(x, "__len__") and not isinstance(x, str) else x for x in a], [tuple(x) if hasattr(x, "__len__") and not isinstance(x, str) else x for x in b]
        done: dict = {}
        out = []
        for k in zip(*keys, strict=True):
            if k not in done:
                done[k] = f(*k)
            out.append(done[k])
        return pd.Series(out)

    return udf


def _mean_best(query: tuple, item: tuple) -> float:
    if not query or not item:
        return 0.0
    return sum(max(ratio(q, i) for i in item) for q in query) / len(query)


def _venue(a: str | None, b: str | None) -> float:
    x, y = plain_title(a), plain_title(b)
    return 1.0 if not x or not y else 0.9 + 0.1 * partial_ratio(x, y)


def title_ratio(a: Column, b: Column) -> Column:
    return _pairwise(title_similarity)(a, b)


def author_overlap(query: Column, item: Column) -> Column:
    """Mean over the query's surnames of the best ratio to an item surname; 0 if either has none."""
    return _pairwise(_mean_best)(query, item)


def venue_compatible(a: Column, b: Column) -> Column:
    return _pairwise(_venue)(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def mismatched_authors(cited: Column, canonical: Column, least: float = 0.8, guard: float = 0.9) -> Column:
    """Cited authors whose surname has no like surname in the canonical list, unless that list is short."""

    @F.pandas_udf("array<string>")
    def udf(names: pd.Series, cited_last: pd.Series, canon: pd.Series) -> pd.Series:
        out = []
        for n, c, k in zip(names, cited_last, canon, strict=True):
            if len(k) == 0 or len(k) < guard * len(n):
                out.append([])
            else:
                out.append([x for x, s in zip(n, c, strict=True) if s and max(ratio(s, t) for t in k) < least])
        return pd.Series(out)

    given = text.named(cited)
    return udf(given, F.transform(given, text.last_name), text.surnames(canonical))


def prefix_length(a: Column, b: Column) -> Column:
    """Number of leading words two word arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    first_off = F.array_position(same, False)
    return F.when(first_off > 0, first_off - 1).otherwise(n).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def prefix_trap(x: Column, y: Column, tail: float = TAIL_JACCARD) -> Column:
    """Titles (as word arrays) that begin alike (three words or more) but end differently."""
    k = prefix_length(x, y)
    tx, ty = F.slice(x, k + 1, F.size(x)), F.slice(y, k + 1, F.size(y))
    return (F.size(x) >= 4) & (F.size(y) >= 4) & (k >= 3) & (F.size(tx) > 0) & (F.size(ty) > 0) & (jaccard(tx, ty) < tail)


def year_factor(a: Column, b: Column) -> Column:
    d = (a - b) / 3.0
    return F.when(a.isNull() | b.isNull(), F.lit(1.0)).otherwise(1.0 / (1.0 + d * d))


def names_jaccard(x: Column, y: Column) -> Column:
    """Jaccard of two surname arrays; 0 if either is empty."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(jaccard(x, y))


def names_subset(x: Column, y: Column) -> Column:
    """One surname array holds the other; false if either is empty."""
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def pages_disjoint(x: Column, y: Column) -> Column:
    """Both have a page range (see text.page_range) and the ranges do not meet."""
    return F.coalesce((y["hi"] < x["lo"]) | (x["hi"] < y["lo"]), F.lit(False))


def composite(title: Column, authors: Column, year: Column, venue: Column) -> Column:
    return title * (0.5 + 0.5 * authors) * year * venue
