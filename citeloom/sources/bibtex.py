"""BibTeX: a tolerant scanner, a table reader, and a Python data source named ``bibtex``.

A file is one text; commented-out entries (a percent sign before the at sign on every header line of the
key) become twins.  Broken entries are read as far as they go; text without entries gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from citeloom.functions import identifiers as ids
from citeloom.functions import text
from citeloom.operators.entries import venue_first

ROW = "bib_file string, key string, raw_type string, fields map<string,string>, is_commented boolean"
_HEADER = re.compile(r"@\s*([A-Za-z]+)\s*[{(]\s*([^,\s{}()]+)\s*,", re.S)
_SKIP = {"comment", "preamble", "string"}
_MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "H": "\u030b", "u": "\u0306", "k": "\u0328"}
_ACCENT = re.compile(r"\\([\"'`^~=.]|[cvHuk](?=[\s{]))\s*\{?\\?([A-Za-z])\}?")
_LETTERS = {"o": "ø", "O": "Ø", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "ss": "ß", "l": "ł", "L": "Ł", "i": "i", "j": "j"}
_LETTER = re.compile(r"\\(" + "|".join(sorted(_LETTERS, key=len, reverse=True)) + r")(?![A-Za-z])\s*(?:\{\})?")


def decode_accents(s: str) -> str:
    """LaTeX accent commands as letters."""
    s = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", m[2] + _MARKS[m[1]]), s)
    s = _LETTER.sub(lambda m: _LETTERS[m[1]], s)
    return re.sub(r"\\([&%$#_])", r"\1", s)


def _value(s: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """A field value from position ``at``: braced, quoted or bare parts joined by #."""
    out = []
    while at < len(s):
        while at < len(s) and s[at].isspace():
            at += 1
        if at >= len(s):
            break
        if s[at] in '{"':
            quote, depth, start = s[at] == '"', 0 if s[at] == '"' else 1, at + 1
            at += 1
            while at < len(s):
                c = s[at]
                if c == "\\":
                    at += 1
                elif c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if not quote and depth == 0:
                        break
                elif c == '"' and quote and depth == 0:
                    break
                at += 1
            out.append(s[start:at])
            at += 1
        else:
            m = re.compile(r"[^\s,#{}()]+").match(s, at)
            if not m:
                break
            out.append(strings.get(m[0].lower(), m[0]))
            at = m.end()
        while at < len(s) and s[at].isspace():
            at += 1
        if at < len(s) and s[at] == "#":
            at += 1
            continue
        break
    return "".join(out), at


def scan(source: str) -> list[tuple[str, str, dict[str, str], bool]]:
    """``(key, type, fields, commented)`` of every entry; twins only for keys without a live entry."""
    strings: dict[str, str] = {}
    for m in re.finditer(r"@\s*string\s*[{(]\s*([^\s={}]+)\s*=", source, re.I):
        strings[m[1].lower()] = _value(source, m.end(), {})[0]
    found = []
    for m in _HEADER.finditer(source):
        kind = m[1].lower()
        if kind in _SKIP:
            continue
        line = source[source.rfind("\n", 0, m.start()) + 1 : m.start()]
        commented = re.search(r"(?<!\\)%", line) is not None
        body = source[m.end() :]
        nxt = _HEADER.search(body)
        if commented:
            body = "\n".join(x.lstrip().lstrip("%") for x in (body[: nxt.start()] if nxt else body).split("\n"))
        fields, at = {}, 0
        while True:
            f = re.compile(r"\s*,?\s*([A-Za-z][\w:+-]*)\s*=", re.S).match(body, at)
            if not f:
                break
            value, at = _value(body, f.end(), strings)
            fields.setdefault(f[1].lower(), decode_accents(value))
        found.append((m[2], kind, fields, commented))
    live = {k for k, _, _, c in found if not c}
    return [e for e in found if not e[3] or e[0] not in live]


def parse_texts(files: DataFrame) -> DataFrame:
    """Rows of ROW from ``files(bib_file, text)``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, k, t, d, c) for f, s in zip(pdf["bib_file"], pdf["text"], strict=True) for k, t, d, c in scan(s or "")]
            yield pd.DataFrame(rows, columns=["bib_file", "key", "raw_type", "fields", "is_commented"])

    return files.select("bib_file", "text").mapInPandas(parse, ROW)


def to_entries(raw: DataFrame) -> DataFrame:
    """Bibliography entries from scanned fields."""
    get = lambda k: F.element_at("fields", k)
    rows = raw.select(
        "bib_file", "key", ids.entry_type(F.col("raw_type")).alias("entry_type"), text.clean(get("title")).alias("title"), text.split_authors(get("author")).alias("authors"),
        text.year(get("year")).alias("year"), venue_first(F.col("fields")).alias("venue"), text.clean(get("publisher")).alias("publisher"), text.clean(get("pages")).alias("pages"),
        ids.from_fields(F.col("fields")).alias("ids"), F.col("fields").alias("raw_fields"), "is_commented",
    )
    return rows.withColumn("content_hash", ids.content_hash(F.col("title"), F.col("authors"), F.col("year"), F.col("venue"), F.col("ids")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all .bib files below a path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.bib", recursiveFileLookup=True)
    return to_entries(parse_texts(files.select(F.input_file_name().alias("bib_file"), F.col("value").alias("text"))))


class BibtexSource(DataSource):
    """``spark.read.format("bibtex").load(path)`` once registered; one partition per file."""

    @classmethod
    def name(cls) -> str:
        return "bibtex"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return BibtexReader(self.options["path"])


class BibtexReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pathlib import Path

        p = Path(self.path)
        return [InputPartition(str(f)) for f in (sorted(p.rglob("*.bib")) if p.is_dir() else [p])]

    def read(self, partition):
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            for key, kind, fields, commented in scan(f.read()):
                yield partition.value, key, kind, fields, commented
