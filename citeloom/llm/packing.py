"""Filling fixed-capacity containers with items (problem 8): pattern packing by non-negative least squares.

Documents are measured in tokens of a public tokenizer.  The histogram of lengths (at most ``capacity``
numbers, whatever the corpus) goes to the driver.  There patterns of few different lengths that fill a
container are enumerated, their repeat counts fitted to the histogram by non-negative least squares,
rounded down and cut to what is there; what remains is packed by greedy patterns, largest piece first,
each repeated as often as the remaining pieces allow.  Every piece then finds its container from its
length and its rank among the pieces of that length: no document is moved for it.

A document longer than the capacity, and only such a one, is split into full pieces and a remainder.
Documents without tokens (null or empty text) take no space and are in no container; an empty table gives
an empty result.  Ranks are taken within blocks of at most about BLOCK pieces, so no length, however
frequent, gathers in one task.
"""

from __future__ import annotations

import base64
import uuid
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.runtime import cut

#: Default container size, and where the tokenizer's ranks are (a parameter; read on the driver only).
CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of one length that are ranked together, sweeps of the fit, and partner lengths tried per pattern.
BLOCK = 200_000
SWEEPS = 150
#: Fits one after the other on what is left: least share of the longest piece, share of space left open.
FITS = ((0.5, 0.0), (0.5, 0.0), (0.5, 0.005), (0.25, 0.0), (0.25, 0.005), (0.0, 0.0), (0.0, 0.0))
PARTNERS = 6

_encoders: dict[str, object] = {}


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document with an id; whole texts, special strings as plain text."""
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, under 2 MB
    token = uuid.uuid4().hex

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if token not in _encoders:
            import tiktoken

            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
            _encoders.clear()
            _encoders[token] = tiktoken.Encoding(token, pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
        encode = _encoders[token].encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0)

    return documents.filter("doc_id is not null").select("doc_id", count("text").alias("n_tokens"))


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Patterns ((length, times), ...) of up to three lengths that fill a container exactly.

    ``counts[n]`` says how many pieces of length n there are.
    """
    have = np.flatnonzero(counts)
    often = [int(n) for n in have[np.argsort(-counts[have])][:PARTNERS]]
    found: set[tuple[tuple[int, int], ...]] = set()
    for n in map(int, have):
        for times in range(1, capacity // n + 1):
            rest = capacity - n * times
            if rest == 0:
                found.add(((n, times),))
                continue
            for again in (1, 2, 3):
                if rest % again == 0 and counts[rest // again] and rest // again != n:
                    found.add(tuple(sorted(((n, times), (rest // again, again)))))
            for m in often:
                if m != n and m < rest and counts[rest - m] and rest - m not in (n, m):
                    found.add(tuple(sorted(((n, times), (m, 1), (rest - m, 1)))))
    return sorted(found)


def fit(found: list[tuple[tuple[int, int], ...]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat count of each pattern: multiplicative updates of the non-negative least squares problem, in
    which lengths weigh by their size (long pieces are hard to place later)."""
    col = np.array([i for i, p in enumerate(found) for _ in p])
    row = np.array([n for p in found for n, _ in p])
    a = np.array([t for p in found for _, t in p], dtype=float)
    b = counts.astype(float)
    w = np.arange(len(b), dtype=float) ** 2
    x = np.ones(len(found))
    target = np.bincount(col, a * (w * b)[row], len(found))
    for _ in range(sweeps):
        ax = np.bincount(row, a * x[col], len(b))
        x *= target / np.maximum(np.bincount(col, a * (w * ax)[row], len(found)), 1e-12)
    return x


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """``(pattern, repeats)`` that use up every piece of the histogram exactly."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for least, slack in FITS:
        # first patterns led by a long piece, which find partners hardest, filled exactly; then nearly
        found = [p for s in range(int(slack * capacity) + 1) for p in patterns(left, capacity - s) if p[-1][0] > least * capacity]
        if not found:
            continue
        x = np.floor(fit(found, left) + 1e-9).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            times = min(int(x[i]), *(int(left[n]) // t for n, t in found[i]))
            if times > 0:
                out.append((found[i], times))
                for n, t in found[i]:
                    left[n] -= t * times
    lengths = [int(n) for n in np.flatnonzero(left)]
    while lengths:
        space, chosen, at = capacity, [], len(lengths)
        while at > 0 and space >= lengths[0]:
            at = min(at, bisect_right(lengths, space))
            if at == 0:
                break
            n = lengths[at - 1]
            t = min(space // n, int(left[n]))
            chosen.append((n, t))
            space -= n * t
            at -= 1
        times = min(int(left[n]) // t for n, t in chosen)
        out.append((tuple(sorted(chosen)), times))
        for n, t in chosen:
            left[n] -= t * times
            if left[n] == 0:
                lengths.remove(n)
    return out


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """``(doc_id, piece, offset, n_tokens)``: whole documents, or the parts of those over the capacity."""
    cap = F.lit(capacity)
    parts = sizes.filter("n_tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / cap).cast("int"))))
    offset = F.col("piece").cast("long") * cap
    return parts.select("doc_id", "piece", offset.alias("offset"), F.least(cap.cast("long"), F.col("n_tokens") - offset).cast("int").alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, offset, n_tokens, container_id)`` of every piece of ``sizes(doc_id, n_tokens)``."""
    spark = sizes.sparkSession
    parts = cut(pieces(sizes, capacity), "pieces")
    histogram = {int(r["n_tokens"]): int(r["n"]) for r in parts.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        counts[n] = c
    start, base, every = [], [], []
    used = np.zeros(capacity + 1, dtype=np.int64)
    container = 0
    for pattern, times in plan(counts, capacity):
        for n, t in pattern:
            start.append((n << 44) + int(used[n]))
            base.append(container)
            every.append(t)
            used[n] += t * times
        container += times
    order = np.argsort(np.array(start, dtype=np.int64))
    segments = spark.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64)[order] for x in (start, base, every)))

    @F.pandas_udf("long")
    def place(n: pd.Series, rank: pd.Series) -> pd.Series:
        first, base_of, times = segments.value
        key = (n.to_numpy(dtype=np.int64) << 44) + rank.to_numpy(dtype=np.int64)
        at = np.searchsorted(first, key, side="right") - 1
        return pd.Series(base_of[at] + (key - first[at]) // times[at])

    blocks = max(1, int(counts.max()) // BLOCK)
    parts = parts.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    before = (
        parts.groupBy("n_tokens", "b").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("n_tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
        .select("n_tokens", "b", F.coalesce("before", F.lit(0)).alias("before"))
    )
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "b").orderBy("doc_id", "piece")) - 1).join(before, ["n_tokens", "b"])
    return ranked.select("doc_id", "piece", "offset", "n_tokens", place("n_tokens", F.col("r") + F.col("before")).alias("container_id"))


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(container_id, n_pieces, n_tokens, unused)`` per container."""
    return packed.groupBy("container_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", F.lit(capacity) - F.col("n_tokens"))
