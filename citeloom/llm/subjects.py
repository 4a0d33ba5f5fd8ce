"""Subject area of each document (problem 10): seeded non-negative factorisation.

The document-term matrix X (counts of words hashed to BUCKETS columns) is factored as W H with one
component per subject area and background components (one general, one per frequent language code), by
alternating multiplicative updates for the Kullback-Leibler loss.  H starts from labelled documents (at most
MAX_LABELS of them) and from anchor terms, which stay zero in every other component, so components keep their
meaning.  Anchors are learnt, not listed: terms whose labelled documents nearly all carry one label, words of one
area's name and description that the labels do not contradict, and for a language the terms that a good part of
its documents hold and the others do not.  Every update of H runs over all documents: workers solve W for their
rows and emit partial sums, which are added per term.  W of a document is its subject mixture; words that tell
nothing about the subject count little in it.

An area is assigned if it makes up at least SHARE of the document's subject matter and rests on enough
words.  Null and empty documents and those without subject words get no row; wrong or repeated labels only
blur the start; labels of unknown documents are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import cut

BUCKETS = 1 << 18
MAX_LABELS = 50_000
ROUNDS = 4
#: Updates of W in every round of H and for the final mixtures.
INNER = 8
#: Words in fewer or more documents than these shares carry no subject.
LOW_DF, HIGH_DF, LEAST_DF = 0.0002, 0.15, 3
SHARE = 0.22
#: Least informative word mass an assigned area rests on.
EVIDENCE = 1.0

#: A term is an anchor of an area if it stands in at least ANCHOR_DOCS labelled documents, ANCHOR_PURE of them of that area;
#: a word of the area's own text stays one unless fewer than OWN_PURE of at least ANCHOR_DOCS are.
ANCHOR_DOCS, ANCHOR_PURE, OWN_PURE = 2, 0.8, 0.5
#: Languages (first two letters of the code) in at least LANG_SHARE of the documents, MAX_LANGS at most, have a background
#: component; its anchors stand in LANG_TERM of the documents of the language, LANG_LIFT times as often as elsewhere.
MAX_LANGS, LANG_SHARE, LANG_TERM, LANG_LIFT = 8, 0.01, 0.3, 5

_WORD = re.compile(r"[^\W\d_]{3,}")
_codes: dict[str, int] = {}


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


def term_rows(documents: DataFrame) -> DataFrame:
    """``(doc_id, lang, terms, counts)``: sparse rows of the document-term matrix, whole texts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            terms, counts = [], []
            for text in pdf["text"]:
                seen = Counter(_WORD.findall(text.lower()))
                if len(_codes) > 1_000_000:
                    _codes.clear()
                merged: dict[int, int] = {}
                for w, n in seen.items():
                    c = _codes.get(w)
                    if c is None:
                        c = _codes[w] = bucket(w)
                    merged[c] = merged.get(c, 0) + n
                terms.append(np.fromiter(merged.keys(), np.int32, len(merged)))
                counts.append(np.fromiter(merged.values(), np.int32, len(merged)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "terms": terms, "counts": counts})

    lang = F.lower(F.left(F.trim("lang"), F.lit(2))).alias("lang")
    rows = documents.select("doc_id", lang, "text").filter("doc_id is not null and trim(text) <> ''")
    return rows.mapInPandas(scan, "doc_id long, lang string, terms array<int>, counts array<int>")


class Factor:
    """H over the chosen terms, and the solver for W; the components after ``areas`` are the background."""

    def __init__(self, chosen: np.ndarray, h: np.ndarray, areas: int):
        self.chosen, self.areas = chosen, areas  # sorted bucket numbers
        self.h = h.astype(np.float32)  # terms x components, columns sum to 1

    def sparse(self, terms, counts):
        """Concatenated rows restricted to the chosen terms: (row, column, count, rows kept)."""
        size = np.array([len(t) for t in terms])
        flat = np.concatenate(list(terms)) if len(terms) else np.zeros(0, np.int32)
        n = np.concatenate(list(counts)).astype(np.float32) if len(terms) else np.zeros(0, np.float32)
        row = np.repeat(np.arange(len(size)), size)
        at = np.minimum(np.searchsorted(self.chosen, flat), len(self.chosen) - 1)
        ok = self.chosen[at] == flat
        return row[ok], at[ok], n[ok], len(size)

    def solve(self, row, col, n, rows, weight=None):
        """W by INNER multiplicative updates, and each entry's shares over components."""
        k = self.h.shape[1]
        w = np.full((rows, k), 1.0 / k, dtype=np.float32)
        ht = self.h[col] + np.float32(1e-9)
        x = (n if weight is None else n * weight[col]).astype(np.float32)
        if not len(row):
            return w, ht
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        some, size = row[starts], np.diff(np.r_[starts, len(row)])
        mine = w[some]
        for _ in range(INNER):
            r = x / np.einsum("ij,ij->i", np.repeat(mine, size, axis=0), ht)
            mine = mine * np.add.reduceat(ht * r[:, None], starts, axis=0) + np.float32(1e-6)
            mine /= mine.sum(1, keepdims=True)
        w[some] = mine
        q = np.repeat(mine, size, axis=0) * ht
        q *= (x / q.sum(1))[:, None]
        return w, q

    def weight(self) -> np.ndarray:
        """How much a term tells about the subject: 1 minus the normalised entropy over components."""
        p = self.h[:, : self.areas] + 1e-9
        p = p / p.sum(1, keepdims=True)
        return (1 + (p * np.log(p)).sum(1) / np.log(p.shape[1])).astype(np.float32) ** 2


def languages(rows: DataFrame, n_docs: int) -> dict[str, int]:
    """Number of documents of the frequent languages."""
    got = rows.filter("lang <> ''").groupBy("lang").count().filter(F.col("count") >= LANG_SHARE * n_docs)
    return {r["lang"]: r["count"] for r in got.orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}


def start(rows: DataFrame, labels: DataFrame, areas: list[tuple[int, str, str]]) -> tuple[Factor, np.ndarray]:
    """The first H and the mask of allowed entries."""
    n_docs = rows.count()
    df = np.zeros(BUCKETS)
    freq = rows.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas()  # at most BUCKETS rows
    df[freq["t"].to_numpy()] = freq["count"].to_numpy()
    chosen = np.flatnonzero((df >= max(LEAST_DF, LOW_DF * n_docs)) & (df <= max(HIGH_DF * n_docs, LEAST_DF)))
    langs = languages(rows, n_docs)
    a, width = len(areas), len(areas) + 1 + len(langs)
    if not len(chosen):
        return Factor(np.zeros(1, np.int64), np.zeros((1, width)), a), np.ones((1, width))
    k = {s: i for i, (s, _, _) in enumerate(areas)}
    known = labels.select("doc_id", "subject_id").filter(F.col("subject_id").isin(list(k))).distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "subject_id").limit(MAX_LABELS)
    seen = (
        rows.join(known, "doc_id").select("subject_id", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
        .groupBy("subject_id", F.col("x.terms").alias("t")).agg(F.sum(F.log1p("x.counts")).alias("n"), F.count("*").alias("docs"))
        .toPandas()
    )  # at most areas x BUCKETS rows
    h, held = np.zeros((len(chosen), width)), np.zeros((len(chosen), a))
    at = np.minimum(np.searchsorted(chosen, seen["t"].to_numpy(dtype=np.int64)), len(chosen) - 1)
    ok = chosen[at] == seen["t"].to_numpy(dtype=np.int64)
    where = (at[ok], seen["subject_id"].map(k).to_numpy(dtype=np.int64)[ok])
    np.add.at(h, where, seen["n"].to_numpy(dtype=float)[ok])
    np.add.at(held, where, seen["docs"].to_numpy(dtype=float)[ok])
    share = df[chosen] / df[chosen].sum()
    h[:, :a] = h[:, :a] / np.maximum(h[:, :a].sum(0), 1e-9) + 0.02 * share[:, None]
    h[:, a:] = share[:, None]
    mask = np.ones_like(h)

    def anchor(j: int, c: int, least: float) -> None:
        mask[j], mask[j, c] = 0, 1
        h[j, c] = max(h[j, c], least)

    docs = held.sum(1)
    pure = held / np.maximum(docs, 1)[:, None]
    for j in np.flatnonzero((docs >= ANCHOR_DOCS) & (pure.max(1) >= ANCHOR_PURE)):
        anchor(j, int(pure[j].argmax()), 2 * share[j])
    texts = {s: set(_WORD.findall(f"{name} {description}".lower())) for s, name, description in areas}
    in_areas = Counter(w for ws in texts.values() for w in ws)
    for s, words in texts.items():
        for w in sorted(w for w in words if in_areas[w] == 1):
            j = np.searchsorted(chosen, bucket(w))
            if j < len(chosen) and chosen[j] == bucket(w) and (docs[j] < ANCHOR_DOCS or pure[j, k[s]] >= OWN_PURE):
                anchor(j, k[s], 2 * share[j])
    if langs:  # at most languages / LANG_TERM times the words of a document are so frequent
        spoken = rows.filter(F.col("lang").isin(list(langs))).select("lang", F.explode("terms").alias("t")).groupBy("lang", "t").count()
        least = F.element_at(F.create_map(*[F.lit(x) for lang, n in langs.items() for x in (lang, LANG_TERM * n)]), F.col("lang"))
        for r in spoken.filter(F.col("count") >= least).collect():
            j, n = np.searchsorted(chosen, r["t"]), langs[r["lang"]]
            if j < len(chosen) and chosen[j] == r["t"] and r["count"] / n >= LANG_LIFT * max(df[r["t"]] - r["count"], 0) / max(1, n_docs - n):
                anchor(j, a + 1 + list(langs).index(r["lang"]), 20 * share[j])
    h *= mask
    return Factor(chosen, h / np.maximum(h.sum(0), 1e-9), a), mask


def update(rows: DataFrame, factor: Factor, mask: np.ndarray) -> Factor:
    """One update of H over all documents."""
    shared = rows.sparkSession.sparkContext.broadcast((factor.chosen, factor.h, factor.areas))
    k = factor.h.shape[1]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Factor(*shared.value)
        total = np.zeros((len(f.chosen), k))
        for pdf in batches:
            row, col, n, size = f.sparse(pdf["terms"], pdf["counts"])
            if len(row):
                _, q = f.solve(row, col, np.log1p(n), size)
                for c in range(k):
                    total[:, c] += np.bincount(col, weights=q[:, c], minlength=len(f.chosen))
        used = np.flatnonzero(total.sum(1))
        yield pd.DataFrame({"t": used, **{f"c{c}": total[used, c] for c in range(k)}})

    schema = "t int, " + ", ".join(f"c{c} double" for c in range(k))
    few = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)  # sums per task, not per block of the table
    got = few.mapInPandas(sums, schema).groupBy("t").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(k)]).toPandas()
    h = np.zeros_like(factor.h, dtype=float)
    h[got["t"].to_numpy(dtype=np.int64)] = got[[f"c{c}" for c in range(k)]].to_numpy()
    h = h * mask + 1e-3 * (h.sum(0) / max(1, len(h))) * mask
    return Factor(factor.chosen, h / np.maximum(h.sum(0), 1e-9), factor.areas)


def fit(rows: DataFrame, labels: DataFrame, areas: list[tuple[int, str, str]], rounds: int = ROUNDS) -> Factor:
    """The factorisation of the whole matrix."""
    factor, mask = start(rows, labels, areas)
    for _ in range(rounds):
        factor = update(rows, factor, mask)
    return factor


def mixtures(rows: DataFrame, factor: Factor, areas: list[tuple[int, str, str]]) -> DataFrame:
    """``(doc_id, subject_id, share, evidence)`` of every area of every document with any subject words."""
    shared = rows.sparkSession.sparkContext.broadcast((factor.chosen, factor.h, factor.areas))
    ids = np.array([s for s, _, _ in areas])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Factor(*shared.value)
        weight = f.weight()
        for pdf in batches:
            row, col, n, size = f.sparse(pdf["terms"], pdf["counts"])
            _, q = f.solve(row, col, n, size, weight)
            mass = np.zeros((size, len(ids)))
            for c in range(len(ids)):
                mass[:, c] = np.bincount(row, weights=q[:, c], minlength=size) if len(row) else 0
            share = mass / np.maximum(mass.sum(1, keepdims=True), 1e-9)
            d, c = np.nonzero(share > 0.01)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[d], "subject_id": ids[c], "share": share[d, c], "evidence": mass[d, c]})

    return rows.mapInPandas(label, "doc_id long, subject_id int, share double, evidence double")


def subject_mixtures(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame) -> DataFrame:
    """Mixtures of all documents."""
    areas = sorted(tuple(r) for r in subject_areas.select("subject_id", "name", "description").filter("subject_id is not null").distinct().collect())
    rows = cut(term_rows(documents), "terms")
    return mixtures(rows, fit(rows, labels, areas), areas)


def assign(mix: DataFrame) -> DataFrame:
    """``(doc_id, subject_id)`` of the areas a document is about."""
    return mix.filter((F.col("share") >= SHARE) & (F.col("evidence") >= EVIDENCE)).select("doc_id", "subject_id").distinct()
