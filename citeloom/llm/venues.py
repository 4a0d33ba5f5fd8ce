"""Mapping free-entered values to a canonical list (problem 3): BK-tree under the edit metric.

A value is cleaned (entities, accents, case, wrappers such as "Proceedings of the 9th", volume and
medium suffixes), its known abbreviations are expanded, and a few spellings of it are looked up in
a BK-tree holding the spellings of all reference entries (names, expanded and abbreviated, and acronyms);
the tree returns every entry within the threshold and the nearest one whose words agree wins.  Every lookup,
exact ones included, goes through the tree.  Words that are known to the reference list must occur in the
entry as they stand, so a listed neighbour is no match for an unlisted venue; words of fewer than five
letters must agree up to one edit or swap.

What the list says about words (abbreviations, vocabulary) is learnt over the whole list.  The list is broadcast
while it has at most MAX_BROADCAST entries; a larger one is split into shards that hold a tree each, each value
visits every shard with what is known of its words, and the shard winners merge by minimum: the result is the
same.  Null and blank values get no row, placeholders and unlisted values the id -1; ties go to the smallest id.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.editdistance import BKTree, distance
from citeloom.runtime import cut

#: Largest reference list that is broadcast whole, and the size of a shard beyond it.
MAX_BROADCAST = 50_000
SHARD = 20_000
#: Edits a spelling may be away from its entry, and letters that may be cut off its end.
MAX_EDITS = 2
MAX_CUT = 6
#: Words of fewer letters may hold one edit or swap only.
SHORT_WORD = 5
CACHE = 200_000

STOP = {"of", "on", "in", "and", "the", "de", "for", "an", "a"}
# Common abbreviations of words in venue names, besides those learnt from the list.
SHORT = {
    "int": "international", "intl": "international", "conf": "conference", "eur": "european", "symp": "symposium",
    "proc": "proceedings", "j": "journal", "jnl": "journal", "trans": "transactions", "ann": "annals",
    "adv": "advances", "lett": "letters", "appl": "applied", "rev": "review", "bull": "bulletin",
}

_WRAP = [
    (re.compile(r"^\s*in\s*:\s*"), ""),
    (re.compile(r"^\s*proc(?:eedings|\.)?\s+(?:of\s+)?(?:the\s+)?(?:\d+\s*(?:st|nd|rd|th)\s+)?(?=\w)"), ""),
    (re.compile(r"^\s*the\s+"), ""),
    (re.compile(r"[,;]?\s*\bvol(?:ume|\.)?\s*\d+.*$"), ""),
    (re.compile(r"\s*[\(\[][^\)\]]*[\)\]]\s*$"), ""),
]
_ACRONYM = re.compile(r"^\s*([a-z]{3,10})\s*(?:[-'’ ,]*\s*(?:19|20)?\d\d)?\s*$")


def fold(text: str) -> str:
    """Lower case without entities, accents and markup, wrappers removed."""
    t = html.unescape(text).replace("\\&", " and ").replace("&", " and ")
    t = re.sub(r"\\[a-zA-Z]+|[{}$\\]", "", t)
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    for pattern, by in _WRAP:
        t = pattern.sub(by, t)
    return t


def split(text: str) -> list[str]:
    """Words of a folded text."""
    return [w for w in re.findall(r"\w+", fold(text)) if w not in STOP]


def told(entries) -> list[tuple[str, str, int, int]]:
    """``(abbreviation, word, entry, position)`` of what names and abbreviations of the same number of words say."""
    out = []
    for vid, name, abbrev in entries:
        words, parts = split(name), split(abbrev or "")
        if len(words) == len(parts):
            out += [(p, w, vid, i) for i, (w, p) in enumerate(zip(words, parts, strict=True)) if w.startswith(p[:1]) and w != p]
    return out


#: What the list says of a word: its full form, the short form of that, and whether any name holds the full form.
Lexicon = dict[str, tuple[str, str, bool]]


def learn(entries, words) -> Lexicon:
    """The lexicon of the given words from the whole list; the first entry that tells an abbreviation counts."""
    full = dict(SHORT)
    for p, w, _, _ in sorted(told(entries), key=lambda t: t[2:]):
        full.setdefault(p, w)
    brief: dict[str, str] = {}
    for p, w in full.items():
        brief.setdefault(w, p)
    names = {full.get(w, w) for _, name, _ in entries for w in split(name)}
    return {w: (e, brief.get(e, e), e in names) for w in words for e in [full.get(w, w)]}


def lexicon(ref: DataFrame, words: DataFrame) -> DataFrame:
    """The same as a table ``(word, full, short, known)``, for lists and values of any size."""
    spark = ref.sparkSession
    rows = ref.select("venue_id", "name", "abbrev")
    tell = lambda batches: (pd.DataFrame(told(pdf.itertuples(index=False)), columns=["p", "w", "vid", "pos"]) for pdf in batches)
    fixed = spark.createDataFrame([(p, w, -1, i) for i, (p, w) in enumerate(SHORT.items())], "p string, w string, vid long, pos int").withColumn("learnt", F.lit(1))
    said = fixed.withColumn("learnt", F.lit(0)).union(rows.mapInPandas(tell, "p string, w string, vid long, pos int").withColumn("learnt", F.lit(1)))
    full = said.groupBy("p").agg(F.min(F.struct("learnt", "vid", "pos", "w")).alias("t"))
    brief = full.groupBy(F.col("t.w").alias("w")).agg(F.min(F.struct("t.learnt", "t.vid", "t.pos", "p"))["p"].alias("short"))
    full = full.select(F.col("p").alias("word"), F.col("t.w").alias("full"))
    names = rows.select(F.explode(_words_udf()("name")).alias("word")).distinct().join(full, "word", "left").select(F.coalesce("full", "word").alias("w")).distinct()
    known = words.join(full, "word", "left").select("word", F.coalesce("full", "word").alias("w"))
    known = known.join(brief, "w", "left").join(names.withColumn("known", F.lit(True)), "w", "left")
    return known.select("word", F.col("w").alias("full"), F.coalesce("short", "w").alias("short"), F.coalesce("known", F.lit(False)).alias("known"))


def _words_udf():
    return F.pandas_udf(lambda s: s.map(lambda t: sorted(set(split(t or "")))), "array<string>")


class VenueIndex:
    """The reference entries ``(venue_id, name, abbrev)`` with their spellings in a BK-tree."""

    def __init__(self, entries: list[tuple[int, str, str | None]], lex: Lexicon):
        self.lex = lex
        self.words: dict[int, set[str]] = {}
        self.names: dict[str, list[int]] = {}  # spellings of several words
        self.acronyms: dict[str, list[int]] = {}
        for vid, name, abbrev in sorted(entries, key=lambda e: e[0]):
            known = [self._of(w) for w in split(name)]
            self.words[vid] = {full for full, _, _ in known}
            spellings = {" ".join(full for full, _, _ in known), " ".join(short for _, short, _ in known)}
            got = split(abbrev or "")
            if len(got) == 1:
                self.acronyms.setdefault(got[0], []).append(vid)
            elif got:
                spellings.add(" ".join(self._of(w)[0] for w in got))
            for key in spellings:
                if key:
                    self.names.setdefault(key, []).append(vid)
        self.tree = BKTree([*self.names, *(a for a in self.acronyms if a not in self.names)])

    def _of(self, word: str) -> tuple[str, str, bool]:
        return self.lex.get(word, (word, word, False))

    def find(self, values: list[str]) -> list[tuple[int, int, int]]:
        """``(grade, distance, venue_id)`` of the entry meant by each value, ``(99, 99, -1)`` if none is.

        Grade: 0 an acronym or the whole name, up to MAX_EDITS edits, then a name cut off.
        """
        keys: list[str] = []
        within: list[int] = []
        owner: list[tuple[int, str, list[tuple[str, str, bool]]]] = []  # value, kind of spelling, its words
        for k, value in enumerate(values):
            folded = fold(value)
            if m := _ACRONYM.match(folded):
                keys.append(m[1])
                within.append(0)
                owner.append((k, "acronym", []))
            raw = [w for w in re.findall(r"\w+", folded) if w not in STOP]
            words = [self._of(w) for w in raw]
            inner = range(1, len(words) - 1)
            slim = [w for i, w in enumerate(words) if i not in inner or len(w[0]) > 3 or w[2]]
            plain = " ".join(full for full, _, _ in words)
            others = [" ".join(raw), " ".join(full for full, _, _ in slim), *(" ".join(short for _, short, _ in ws) for ws in (words, slim))]
            for key in dict.fromkeys((plain, *others)):
                if len(key) > 3:
                    keys.append(key)
                    within.append(min(max(MAX_CUT, MAX_EDITS), len(key) // 3))
                    owner.append((k, "plain" if key == plain else "other", words))
        best: dict[int, tuple[int, int, int]] = {}
        for i, name, d in self.tree.search(keys, np.array(within, dtype=np.int64)):
            k, kind, words = owner[i]
            if kind == "acronym":
                for vid in self.acronyms.get(name, []):
                    best[k] = min(best.get(k, (99, 99, 0)), (-1, 0, vid))
                continue
            cut_off = name.startswith(keys[i])
            grade = d if d <= MAX_EDITS and name.count(" ") == keys[i].count(" ") and _like(keys[i], name) else MAX_EDITS + 1 if cut_off else None
            if grade is None:
                continue
            must = [] if d == 0 and kind == "plain" else [full for full, _, known in (words[:-1] if cut_off else words) if known]
            for vid in self.names.get(name, []):
                if all(w in self.words[vid] for w in must):
                    best[k] = min(best.get(k, (99, 99, 0)), (grade, d, vid))
        return [best.get(k, (99, 99, -1)) for k in range(len(values))]


def _like(a: str, b: str) -> bool:
    """Whether the words of two spellings agree in turn: short ones up to one edit or swap, long ones as the whole allows."""
    return all(x == y or min(len(x), len(y)) >= SHORT_WORD or sorted(x) == sorted(y) or distance(x, y) <= 1 for x, y in zip(a.split(), b.split(), strict=True))


_index: dict[str, tuple[VenueIndex, dict[str, int]]] = {}


def _mapper(entries):
    """A pandas UDF value -> venue_id over the broadcast reference list; one index per worker."""
    token = uuid.uuid4().hex

    @F.pandas_udf("int")
    def venue_id(values: pd.Series) -> pd.Series:
        if token not in _index:
            _index.clear()
            rows = entries.value
            words = {w for _, name, abbrev in rows for w in [*split(name), *split(abbrev or "")]}
            _index[token] = (VenueIndex(rows, learn(rows, words | set(SHORT))), {})
        index, seen = _index[token]
        new = [v for v in values.unique() if v not in seen]
        if len(seen) + len(new) > CACHE:
            seen.clear()
            new = list(values.unique())
        for v, (_, _, vid) in zip(new, index.find(new), strict=True):
            seen[v] = vid
        return values.map(seen)

    return venue_id


def map_values(rows: DataFrame, reference: DataFrame, column: str = "venue", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``rows`` with ``venue_id``; rows whose value is null or blank are left out."""
    rows = rows.filter(F.trim(column) != "")
    ref = reference.select("venue_id", "name", "abbrev").filter("venue_id is not null and name is not null")
    if ref.limit(max_broadcast + 1).count() <= max_broadcast:
        entries = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in ref.collect()])
        return rows.withColumn("venue_id", _mapper(entries)(column))
    return _map_sharded(rows, ref, column)


def _with_words(rows: DataFrame, key: str, texts: list[str], lex: DataFrame) -> DataFrame:
    """``rows`` with ``lex``: what is known of the words in their text columns, no more than the texts hold."""
    words = rows.select(key, F.explode(F.array_distinct(F.concat(*[_words_udf()(t) for t in texts]))).alias("word"))
    mine = words.join(lex, "word").groupBy(key).agg(F.collect_list(F.struct("word", "full", "short", "known")).alias("lex"))
    return rows.join(mine, key, "left")


def _map_sharded(rows: DataFrame, ref: DataFrame, column: str) -> DataFrame:
    """The same for a list of any size: values x shards, each pair of a value block and a shard in one group."""
    shards = max(1, -(-ref.count() // SHARD))
    values = cut(rows.select(F.col(column).alias("value")).distinct(), "venue-values")
    blocks = max(1, -(-values.count() // SHARD))
    texts = values.select(F.col("value").alias("text")).union(ref.select("name")).union(ref.select("abbrev"))
    words = texts.select(F.explode(_words_udf()("text")).alias("word")).distinct()
    lex = cut(lexicon(ref, words), "venue-words")

    def search(key, block: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        known = {r["word"]: (r["full"], r["short"], r["known"]) for side in (block, shard) for rs in side["lex"] if rs is not None for r in rs}
        index = VenueIndex([tuple(x) for x in shard[["venue_id", "name", "abbrev"]].itertuples(index=False)], known)
        found = index.find(list(block["value"]))
        return pd.DataFrame({"value": block["value"], **{c: [f[i] for f in found] for i, c in enumerate(("grade", "d", "venue_id"))}})

    left = _with_words(values, "value", ["value"], lex).withColumn("b", F.pmod(F.xxhash64("value"), F.lit(blocks).cast("bigint"))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = _with_words(ref, "venue_id", ["name", "abbrev"], lex).withColumn("s", F.pmod(F.xxhash64("venue_id"), F.lit(shards)).cast("int"))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    won = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(search, "value string, grade int, d int, venue_id int")
    best = won.groupBy("value").agg(F.min(F.struct("grade", "d", "venue_id")).alias("m"))
    best = best.select(F.col("value").alias("_value"), F.col("m.venue_id").alias("venue_id"))
    return rows.join(best, rows[column] == best["_value"]).drop("_value")
