"""Evaluation texts leaking into training text (problem 9): suffix arrays over the training corpus.

Training documents are taken in shards of about SHARD_CHARS characters.  Their texts become token ids (markup,
citation marks, line-end hyphens, look-alike letters, case and punctuation removed first; scripts without blanks by
the letter), and their suffixes are sorted.  Every suffix of the test items is binary-searched in that array; the
neighbours of the hit give all locations.  Only positions that start a specific word triple enter the array: one that
at most SPECIFIC different test sentences hold, however many items repeat those.  Sentences with too few of them are
looked up whole, by their first triple.

Exact check: a test sentence is present where at least SHARE of its specific word triples are matched close together,
which typos, inserted marks and changed words survive and shared phrases do not reach.  A sentence with fewer than
LEAST specific triples (made of shared wording) is present where all its tokens stand in a row right before or after
its neighbour's.  An item leaks if two consecutive sentences of it are present (where one of them stands in more than
SPECIFIC items, they must be neighbours in the document too); a one-sentence item if that sentence is at ALONE, or
whole if it has too few specific triples.  The longest verbatim match is measured on every diagonal of hits over the
whole item.  Longer test sets than MAX_TOKENS are searched in blocks, with the same result.

Null and empty texts match nothing, nor do items of one or two tokens; repeated documents are reported each; the
result has distinct rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import cut

#: Tokens of test text that are broadcast at once.
MAX_TOKENS = 2_000_000
#: A triple is specific if at most so many different test sentences hold it; a sentence in more items than that is stock.
SPECIFIC = 2
SHARE = 0.35
ALONE = 0.6
#: Tokens (page numbers, marks) that may stand between a sentence and the exact one beside it.
SLACK = 3
#: Tokens, besides a quarter of its length, that a stock sentence may be away from where its neighbour puts it.
DRIFT = 6
#: Least number of specific triples that can prove a sentence, and tokens compared when suffixes are sorted.
LEAST = 4
DEPTH = 64
#: Characters of training text per suffix array; a longer document is one shard.
SHARD_CHARS = 4_000_000

# Letters of other alphabets that look like Latin ones.
_LOOKALIKE = str.maketrans(
    "аеорсухіјѕԁһӏвнкмтАЕОРСУХІЈЅВНКМТαονρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhlbhkmtAEOPCYXIJSBHKMTaovptuikABEZHIKMNOPTYX",
)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_HYPHEN = re.compile(r"(\w)-[ \t]*\n[>\s]*(\w)")
_INLINE = re.compile(r"</?(?:i|b|em|strong|span|u|a|sub|sup|mark|code|font|scp|jats:\w+|mml:\w+)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"<[!/]?[A-Za-z][^<>]{0,200}>|&(?:nbsp|#160);|\[\d{1,4}(?:[,–-]\s*\d{1,4})*\]|\\[A-Za-z]+\*?")
_UNSPACED = "\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"  # Thai, Lao, Khmer, kana, Han
_TOKEN = re.compile(f"[{_UNSPACED}]|[^\\W_{_UNSPACED}]+")
_SENTENCE = re.compile(r"(?<=[.?!])[\"')\]]*\s+(?=\S)|(?<=[。！？])\s*(?=\S)")


def tokens(text: str) -> list[str]:
    """Tokens of a text in a form that alterations of layout, markup and script do not change."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        text = unicodedata.normalize("NFKD", text).translate(_LOOKALIKE)
        text = "".join(c for c in text if not unicodedata.combining(c))
    if "-" in text:
        text = _HYPHEN.sub(r"\1\2", text)
    if "<" in text:
        text = _INLINE.sub("", text)
    if "<" in text or "[" in text or "&" in text or "\\" in text:
        text = _TAG.sub(" ", text)
    return _TOKEN.findall(text.lower())


@dataclass
class TestSet:
    """The test side: token ids, item and sentence of every position, and which triples are specific."""

    vocabulary: dict[str, int]
    ids: np.ndarray
    item: np.ndarray
    sentence: np.ndarray  # running number over all items
    specific: np.ndarray  # bool per position
    keys: np.ndarray  # sorted distinct triple keys that are specific
    n_specific: np.ndarray  # per sentence
    length: np.ndarray  # tokens per sentence
    item_of: np.ndarray  # item row per sentence
    item_ids: list[int]
    start: np.ndarray  # first position of each sentence, and the end
    blind: dict[int, list[int]]  # first triple -> sentences that specific triples can't prove
    stock: np.ndarray  # whether a sentence stands in more than SPECIFIC items


def prepare(items: list[tuple[int, str]], shared: set[tuple[str, str, str]] | None = None, stock: set[str] | None = None) -> TestSet:
    """Index the test items ``(item_id, text)``; ``shared``: triples that are not specific, and ``stock``: sentences in
    many items (as joined tokens), if counted elsewhere."""
    vocabulary: dict[str, int] = {}
    ids, item, sentence, length, item_of, wording = [], [], [], [], [], []
    for row, (_, text) in enumerate(items):
        for part in _SENTENCE.split(text or ""):
            words = tokens(part)
            if not words:
                continue
            ids.extend(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words)
            item.extend([row] * len(words))
            sentence.extend([len(length)] * len(words))
            length.append(len(words))
            item_of.append(row)
            wording.append(" ".join(words))
    n = len(ids)
    a, it, se = np.array(ids, dtype=np.int64), np.array(item, dtype=np.int64), np.array(sentence, dtype=np.int64)
    keys = np.full(n, -1, dtype=np.int64)
    if n > 2:
        same = se[2:] == se[:-2]
        keys[:-2] = np.where(same, _triples(a), -1)
    which = {w: k for k, w in enumerate(dict.fromkeys(wording))}
    holders = pd.DataFrame({"k": keys, "i": np.array([which[w] for w in wording], dtype=np.int64)[se] if n else se}).query("k >= 0").drop_duplicates().groupby("k").size()
    if stock is None:
        in_items = pd.DataFrame({"w": wording, "i": item_of}).drop_duplicates().groupby("w").size()
        stock = set(in_items[in_items > SPECIFIC].index)
    rare = np.sort(holders[holders <= SPECIFIC].index.to_numpy(dtype=np.int64))
    if shared is not None:
        known = [[vocabulary.get(w, 0) for w in t] for t in shared]
        rare = np.setdiff1d(rare, [(x << 42) | (y << 21) | z for x, y, z in known if x and y and z])
    specific = np.isin(keys, rare)
    n_specific = np.bincount(se[specific], minlength=len(length))
    start = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    blind: dict[int, list[int]] = {}
    for s in np.flatnonzero((n_specific < LEAST) & (np.array(length, dtype=np.int64) >= 3)):
        blind.setdefault(int(keys[start[s]]), []).append(int(s))
    return TestSet(
        vocabulary, a, it, se, specific, rare, n_specific,
        np.array(length, dtype=np.int64), np.array(item_of, dtype=np.int64), [i for i, _ in items], start, blind,
        np.array([w in stock for w in wording], dtype=bool),
    )


def sentences_of(text: str) -> list[str]:
    """Sentences of a test item as joined tokens, those without any left out."""
    return [" ".join(w) for part in _SENTENCE.split(text or "") if (w := tokens(part))]


def _triples(ids: np.ndarray) -> np.ndarray:
    """Key of the three ids from each position on; negative where a token is no word of the test set."""
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    return np.where((a > 0) & (b > 0) & (c > 0), (a << 42) | (b << 21) | c, -1)


class SuffixArray:
    """Sorted suffixes (to DEPTH tokens) of chosen positions of a token sequence."""

    def __init__(self, ids: np.ndarray, positions: np.ndarray):
        self.windows = _windows(ids, positions)
        text = np.ascontiguousarray(self.windows.astype(">u4")).view(f"S{4 * DEPTH}").ravel()
        self.order = np.argsort(text, kind="stable")
        self.sorted = text[self.order]

    def search(self, windows: np.ndarray, least: int = 3):
        """``(query, entry, match length)`` of all suffixes that share ``least`` tokens with a query."""
        low = windows.copy()
        low[:, least:] = 0
        high = low.copy()
        high[:, least:] = 0xFFFFFFFF
        lo, hi = (np.searchsorted(self.sorted, np.ascontiguousarray(w.astype(">u4")).view(self.sorted.dtype).ravel(), side=s) for w, s in ((low, "left"), (high, "right")))
        many = hi - lo
        query = np.repeat(np.arange(len(windows)), many)
        entry = self.order[np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + lo[query]]
        size = np.zeros(len(query), dtype=np.int64)
        for at in range(0, len(query), 100_000):
            q, e = windows[query[at : at + 100_000]], self.windows[entry[at : at + 100_000]]
            size[at : at + 100_000] = np.logical_and.accumulate((q == e) & (q > 0), axis=1).sum(1)
        return query, entry, size


def _windows(ids: np.ndarray, positions: np.ndarray) -> np.ndarray:
    padded = np.concatenate([np.maximum(ids, 0), np.zeros(DEPTH, dtype=np.int64)]).astype(np.uint32)
    return padded[positions[:, None] + np.arange(DEPTH)[None, :]]


def find_in_shard(texts: list[str], test: TestSet, test_windows: np.ndarray, test_positions: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(document row, item id, sentences present, longest match)`` of every leak in a shard."""
    get = test.vocabulary.get
    parts, doc_of, start = [], [], 0
    for row, text in enumerate(texts):
        words = tokens(text) if isinstance(text, str) else []
        part = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        parts.append(np.append(part, [0, 0]))  # no match runs over the end
        doc_of.append((start, row))
        start += len(part) + 2
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    if len(ids) < 3:
        return []
    keys = _triples(ids)
    starts = np.array([s for s, _ in doc_of], dtype=np.int64)
    at = np.searchsorted(test.keys, keys)
    positions = np.flatnonzero((keys >= 0) & (test.keys[np.minimum(at, len(test.keys) - 1)] == keys)) if len(test.keys) else np.zeros(0, dtype=np.int64)
    # (document, item) -> sentence -> share of specific triples, and where it stands
    present: dict[tuple[int, int], dict[int, tuple[float, list[tuple[int, int]]]]] = {}
    diagonals: dict[tuple[int, int], np.ndarray] = {}
    if len(positions):
        query, entry, _ = SuffixArray(ids, positions).search(test_windows)
        tpos, dpos = test_positions[query], positions[entry]
        doc = np.searchsorted(starts, dpos, side="right") - 1
        sentence = test.sentence[tpos]
        need = np.maximum(LEAST, np.ceil(SHARE * test.n_specific)).astype(np.int64)
        hits = pd.DataFrame({"doc": doc, "sentence": sentence, "tpos": tpos, "dpos": dpos})
        enough = hits.groupby(["doc", "sentence"])["tpos"].nunique()
        enough = enough[enough.to_numpy() >= need[enough.index.get_level_values("sentence")]]
        hits = hits.merge(enough.rename("n").reset_index(), on=["doc", "sentence"]).sort_values(["doc", "sentence", "dpos"])
        for (d, s), g in hits.groupby(["doc", "sentence"], sort=False):
            dp, tp = g["dpos"].to_numpy(), g["tpos"].to_numpy()
            n = _densest(dp, tp, int(test.length[s] * 3 // 2 + 10))
            if n >= need[s]:
                lined = np.unique(dp - tp)
                found = present.setdefault((d, int(test.item_of[s])), {})
                found[s] = (n / test.n_specific[s], [(int(x + test.start[s]), int(x + test.start[s + 1])) for x in lined])
                key = (d, int(test.item_of[s]))
                diagonals[key] = np.union1d(diagonals.get(key, lined), lined)
    blind: dict[tuple[int, int], dict[int, list[int]]] = {}
    if test.blind:
        for p in np.flatnonzero(np.isin(keys, np.fromiter(test.blind, dtype=np.int64))):
            d = int(np.searchsorted(starts, p, side="right") - 1)
            for s in test.blind[int(keys[p])]:
                if np.array_equal(ids[p : p + test.length[s]], test.ids[test.start[s] : test.start[s + 1]]):
                    blind.setdefault((d, int(test.item_of[s])), {}).setdefault(s, []).append(int(p))
    sentences = np.bincount(test.item_of, minlength=len(test.item_ids))
    usable = np.bincount(test.item_of[(test.n_specific >= LEAST) & ~test.stock], minlength=len(test.item_ids))
    first = np.searchsorted(test.item_of, np.arange(len(test.item_ids) + 1))
    out = []
    for d, i in sorted(present.keys() | blind.keys()):
        found, exact = present.get((d, i), {}), blind.get((d, i), {})
        where = {s: list(spans) for s, (_, spans) in found.items()}
        pair = any(s + 1 in found and (not (test.stock[s] or test.stock[s + 1]) or _neighbours(where[s], where[s + 1])) for s in found)
        seen, joined = set(found), set()
        end = int(starts[d + 1]) if d + 1 < len(starts) else len(ids)
        for order, step in ((range(first[i], first[i + 1]), -1), (range(first[i + 1] - 1, first[i] - 1, -1), 1)):
            for s in order:
                if test.n_specific[s] >= LEAST or not first[i] <= s + step < first[i + 1]:
                    continue
                size = int(test.length[s])
                beside = where.get(s + step) or ([(p, p + int(test.length[s + step])) for p in exact.get(s + step, [])] if size >= 3 else [])
                if size >= 3:
                    spots = exact.get(s, [])
                    near = [p for p in spots for b, e in beside if (abs(p - e) if step < 0 else abs(p + size - b)) <= SLACK]
                else:  # too short for a triple or a sentence of its own: it may join its two neighbours
                    near = [p for b, e in beside for p in [e if step < 0 else b - size] if starts[d] <= p <= end - size and np.array_equal(ids[p : p + size], test.ids[test.start[s] : test.start[s + 1]])]
                if near:
                    pair |= size >= 3
                    if size < 3 and step < 0:
                        joined.add(s)
                    seen |= {s, s + step}
                    where.setdefault(s, []).extend((p, p + size) for p in near)
        pair |= any(s + 1 < first[i + 1] and s + 1 in where for s in joined)
        one = any(r >= ALONE and (sentences[i] == 1 or (usable[i] == 1 and not test.stock[s])) for s, (r, _) in found.items())
        if pair or one or (sentences[i] == 1 and exact):
            seen |= exact.keys() if sentences[i] == 1 else set()
            lined = [diagonals.get((d, i), np.zeros(0, dtype=np.int64)), *(np.array([p - test.start[s] for p in ps]) for s, ps in exact.items())]
            item = (int(test.start[first[i]]), int(test.start[first[i + 1]]))
            longest = max(_longest(ids[starts[d] : end], int(x - starts[d]), test.ids, *item) for x in np.unique(np.concatenate(lined)).astype(np.int64))
            out.append((doc_of[d][1], test.item_ids[i], len(seen), longest))
    return out


def _neighbours(first: list[tuple[int, int]], second: list[tuple[int, int]]) -> bool:
    """Whether some place of a sentence ends about where one of the next begins."""
    return any(abs(begin - end) <= DRIFT + max(end - start, stop - begin) // 4 for start, end in first for begin, stop in second)


def _longest(ids: np.ndarray, shift: int, test_ids: np.ndarray, begin: int, end: int) -> int:
    """Longest run of equal tokens of a document and of test positions ``begin`` to ``end``, laid ``shift`` apart."""
    begin, end = max(begin, -shift), min(end, len(ids) - shift)
    same = np.concatenate([[False], ids[begin + shift : end + shift] == test_ids[begin:end], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _densest(dpos: np.ndarray, tpos: np.ndarray, width: int) -> int:
    """Most distinct test positions matched within ``width`` tokens of a document."""
    best, left, count = 0, 0, {}
    for right in range(len(dpos)):
        count[tpos[right]] = count.get(tpos[right], 0) + 1
        while dpos[right] - dpos[left] > width:
            t = tpos[left]
            count[t] -= 1
            if not count[t]:
                del count[t]
            left += 1
        best = max(best, len(count))
    return best


_ready: dict[str, tuple] = {}


def find_leaks(documents: DataFrame, items: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``(doc_id, item_id, n_sentences, longest)`` of every document that holds a passage of an item."""
    rows = items.select("item_id", "text").filter("item_id is not null and trim(text) <> ''").distinct()
    total = rows.agg(F.sum(F.length("text") / 5)).first()[0] or 0
    blocks = max(1, int(-(-total // max_tokens)))
    found, shared, stock = None, None, None
    if blocks > 1:  # triples and sentences are counted over all items, not in each block
        said = cut(_sentence_rows(rows), "leak-sentences")
        shared = cut(_triple_rows(said).groupBy("triple").agg(F.countDistinct("sentence").alias("n")).filter(F.col("n") > SPECIFIC).select("triple"), "leak-triples")
        stock = cut(said.groupBy("sentence").agg(F.countDistinct("item").alias("n")).filter(F.col("n") > SPECIFIC).select("sentence"), "leak-stock")
    for b in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        common, often = None, None
        if shared is not None:  # no more of either than the block has
            mine = _sentence_rows(part)
            common = {tuple(r.triple) for r in shared.join(_triple_rows(mine).select("triple").distinct(), "triple", "left_semi").collect()}
            often = {r.sentence for r in stock.join(mine.select("sentence").distinct(), "sentence", "left_semi").collect()}
        one = _find_block(documents, sorted(map(tuple, part.collect())), common, often)
        found = one if found is None else found.union(one)
    return found.distinct()


def _sentence_rows(items: DataFrame) -> DataFrame:
    """``(item, sentence)`` of every sentence of every item, as joined tokens."""
    udf = F.udf(sentences_of, "array<string>")
    return items.select(F.xxhash64("item_id", "text").alias("item"), F.explode(udf("text")).alias("sentence"))


def _triple_rows(sentences: DataFrame) -> DataFrame:
    """``(sentence, triple)`` of every word triple of the different sentences."""
    words = F.split("sentence", " ")
    triples = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.slice(words, i, F.lit(3)))
    return sentences.select("sentence").distinct().filter(F.size(words) > 2).select("sentence", F.explode(triples).alias("triple"))


def _find_block(documents: DataFrame, items: list[tuple[int, str]], common: set[tuple[str, str, str]] | None = None, stock: set[str] | None = None) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((items, common, stock))
    token = uuid.uuid4().hex

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _ready:
            _ready.clear()
            test = prepare(*shared.value)
            positions = np.flatnonzero(test.specific)
            _ready[token] = (test, _windows(test.ids, positions), positions)
        test, windows, positions = _ready[token]
        for pdf in batches:
            shard = pdf["text"].str.len().cumsum() // SHARD_CHARS
            for _, part in pdf.groupby(shard, sort=False):
                doc_ids = part["doc_id"].tolist()
                got = find_in_shard(part["text"].tolist(), test, windows, positions)
                yield pd.DataFrame([(doc_ids[r], i, n, m) for r, i, n, m in got], columns=["doc_id", "item_id", "n_sentences", "longest"])

    rows = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    return rows.mapInPandas(search, "doc_id long, item_id long, n_sentences int, longest int")


def remove_leaked(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents without those that leak."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
