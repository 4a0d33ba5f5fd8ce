"""DuckDB SQL for the fuzzy ratios: the longest common subsequence bit by bit on two 100-bit halves, as list folds.

``scored(base)`` gives the CTEs that end in ``sc(pid, title_ratio, author_overlap, venue)`` for a CTE ``base`` with
columns pid, tx, ty (comparable titles), nx, ny (surname lists), vx, vy (comparable venues).  Texts of up to 200
characters.
"""

from __future__ import annotations

from citeloom.functions.similarity import TAIL_JACCARD, TOKEN_SET_GUARD

_HALF = 100


def _bits(lo: str, hi: str) -> str:
    return f"coalesce(list_sum(list_transform(range({lo}, {hi}), lambda i: CASE WHEN a[i] = c THEN 1::HUGEINT << CAST(i - {lo} AS INT) ELSE 0::HUGEINT END)), 0)::HUGEINT"


def ratios(need: str, n: str = "") -> str:
    """CTE ``rat(a, b, r)``: the ratio of every pair of texts in the CTE ``need(a, b)``; ``n`` ends all names."""
    full_lo, full_hi = f"((1::HUGEINT << CAST(least(n, {_HALF}) AS INT)) - 1)", f"((1::HUGEINT << CAST(greatest(n - {_HALF}, 0) AS INT)) - 1)"
    low = f"(((s[1] + (s[1] & k[1])) & {full_lo}) | (s[1] - (s[1] & k[1])))"
    carry = f"((s[1] + (s[1] & k[1])) >> {_HALF})"
    high = f"(((s[2] + (s[2] & k[2]) + {carry}) & {full_hi}) | (s[2] - (s[2] & k[2])))"
    return f"""texts{n} AS (SELECT DISTINCT a, b FROM {need}),
    masks{n} AS (SELECT a, b, length(a) AS n, list_transform(string_split(b, ''), lambda c: [{_bits('1', f'least(length(a), {_HALF}) + 1')}, {_bits(str(_HALF + 1), 'length(a) + 1')}]) AS ms FROM texts{n} WHERE a <> b AND a <> '' AND b <> ''),
    folds{n} AS (SELECT a, b, n, list_reduce(list_prepend([{full_lo}, {full_hi}], ms), lambda s, k: [{low}, {high}]) AS s FROM masks{n}),
    rat{n} AS (SELECT a, b, 2.0 * (n - bit_count(s[1]) - bit_count(s[2])) / (length(a) + length(b)) AS r FROM folds{n} UNION ALL SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END FROM texts{n} WHERE a = b OR a = '' OR b = '')"""


def scored(base: str, n: str = "") -> str:
    words = lambda c: f"string_split({c}, ' ')"
    joined = lambda c: f"array_to_string({c}, ' ')"
    return f"""titled{n} AS (SELECT pid, tx, ty, {words('tx')} AS wx, {words('ty')} AS wy FROM {base} WHERE tx <> '' AND ty <> ''),
    sets{n} AS (SELECT pid, list_sort(list_intersect(list_distinct(wx), list_distinct(wy))) AS both_, list_sort(list_filter(list_distinct(wx), lambda w: NOT list_contains(wy, w))) AS lw,
      list_sort(list_filter(list_distinct(wy), lambda w: NOT list_contains(wx, w))) AS rw FROM titled{n} WHERE least(len(wx), len(wy)) / greatest(len(wx), len(wy)) >= {TOKEN_SET_GUARD}),
    cells{n} AS (SELECT pid, tx AS a, ty AS b FROM titled{n} UNION ALL SELECT pid, {joined('list_sort(wx)')}, {joined('list_sort(wy)')} FROM titled{n}
      UNION ALL SELECT pid, {joined('list_concat(both_, lw)')}, {joined('list_concat(both_, rw)')} FROM sets{n} WHERE len(lw) > 0 AND len(rw) > 0
      UNION ALL SELECT pid, {joined('both_')}, {joined('list_concat(both_, lw)')} FROM sets{n} WHERE len(both_) > 0 AND len(lw) > 0 AND len(rw) > 0
      UNION ALL SELECT pid, {joined('both_')}, {joined('list_concat(both_, rw)')} FROM sets{n} WHERE len(both_) > 0 AND len(lw) > 0 AND len(rw) > 0),
    named{n} AS (SELECT pid, q AS a, unnest(ny) AS b FROM (SELECT pid, unnest(nx) AS q, ny FROM {base})),
    placed{n} AS (SELECT pid, CASE WHEN length(vx) <= length(vy) THEN vx ELSE vy END AS s, CASE WHEN length(vx) <= length(vy) THEN vy ELSE vx END AS l FROM {base} WHERE vx <> '' AND vy <> ''),
    parts{n} AS (SELECT pid, s AS a, substr(l, CAST(greatest(i, 0) + 1 AS BIGINT), CAST(i + length(s) - greatest(i, 0) AS BIGINT)) AS b FROM (SELECT pid, s, l, unnest(range(1 - length(s), length(l))) AS i FROM placed{n})),
    needed{n} AS (SELECT a, b FROM cells{n} UNION SELECT a, b FROM named{n} UNION SELECT a, b FROM parts{n}), {ratios('needed' + n, n)},
    title_r{n} AS (SELECT pid, max(r) AS r FROM (SELECT pid, r FROM cells{n} JOIN rat{n} USING (a, b) UNION ALL SELECT pid, 1.0 FROM sets{n} WHERE len(both_) > 0 AND (len(lw) = 0 OR len(rw) = 0)) GROUP BY pid),
    author_r{n} AS (SELECT pid, avg(r) AS r FROM (SELECT pid, a, max(r) AS r FROM named{n} JOIN rat{n} USING (a, b) GROUP BY pid, a) GROUP BY pid),
    venue_r{n} AS (SELECT pid, max(r) AS r FROM parts{n} JOIN rat{n} USING (a, b) GROUP BY pid),
    sc{n} AS (SELECT {base}.pid, coalesce(t.r, 0) AS title_ratio, coalesce(n.r, 0) AS author_overlap, CASE WHEN v.r IS NULL THEN 1 ELSE 0.9 + 0.1 * v.r END AS venue FROM {base}
      LEFT JOIN title_r{n} t ON t.pid = {base}.pid LEFT JOIN author_r{n} n ON n.pid = {base}.pid LEFT JOIN venue_r{n} v ON v.pid = {base}.pid)"""


def trap(x: str, y: str) -> str:
    """SQL for the prefix trap of two word lists."""
    k = f"coalesce(list_position(list_transform(range(1, CAST(least(len({x}), len({y})) AS BIGINT) + 1), lambda i: {x}[i] = {y}[i]), false) - 1, least(len({x}), len({y})))"
    tx, ty = f"{x}[{k} + 1:]", f"{y}[{k} + 1:]"
    return f"(len({x}) >= 4 AND len({y}) >= 4 AND {k} >= 3 AND len({tx}) > 0 AND len({ty}) > 0 AND coalesce(len(list_intersect({tx}, {ty})) / nullif(len(list_distinct(list_concat({tx}, {ty}))), 0), 0.0) < {TAIL_JACCARD})"


def subset(x: str, y: str) -> str:
    """SQL for one surname list holding the other."""
    return f"(len({x}) > 0 AND len({y}) > 0 AND (len(list_intersect({x}, {y})) = len({x}) OR len(list_intersect({x}, {y})) = len({y})))"
