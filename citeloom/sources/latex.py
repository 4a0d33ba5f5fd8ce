"""LaTeX manuscripts: include closure, cited keys, and the citing sentence of every occurrence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CONTEXT = 15
# Environments whose text is no running text.
VERBATIM = ["verbatim", "lstlisting", "minted", "Verbatim", "comment"]
CITE = r"\\((?:[Cc]ite|[Pp]arencite|[Tt]extcite|[Aa]utocite|[Ff]ootcite|nocite)[A-Za-z]*)\*?\s*(?:\[[^\]]*\]\s*)*\{([^}]*)\}"
_CITE = re.compile(CITE)
_INCLUDE = re.compile(r"\\(?:input|include|subfile)\s*\{([^}]+)\}")
_END = re.compile(r"(?<=[.!?])[\"')\]}]*\s+|\n\s*\n")


def strip_comments(tex: Column) -> Column:
    """Every line cut at its first unescaped percent sign."""
    return F.regexp_replace(tex, r"(?m)(?<!\\)%.*$", "")


def strip_verbatim(tex: Column) -> Column:
    out = tex
    for e in VERBATIM:
        out = F.regexp_replace(out, r"(?s)\\begin\{" + e + r"\*?\}.*?\\end\{" + e + r"\*?\}", "\n")
    return F.regexp_replace(out, r"\\verb\*?([^A-Za-z\s]).*?\1", "")


def plain_strip(tex: str) -> str:
    """The same two steps on one text in a worker."""
    out = re.sub(r"(?m)(?<!\\)%.*$", "", tex)
    for e in VERBATIM:
        out = re.sub(r"\\begin\{" + e + r"\*?\}.*?\\end\{" + e + r"\*?\}", "\n", out, flags=re.S)
    return re.sub(r"\\verb\*?([^A-Za-z\s]).*?\1", "", out)


def closure(root: str, files: dict[str, str]) -> tuple[str, list[str]]:
    """A file with its includes in place, each once, and the includes that cannot be found."""
    missing: list[str] = []
    seen: set[str] = set()

    def load(name: str) -> str:
        path = name if name in files else f"{name}.tex"
        if path not in files:
            missing.append(name)
            return ""
        if path in seen:
            return ""
        seen.add(path)
        return _INCLUDE.sub(lambda m: load(m[1].strip()), plain_strip(files[path]))

    return load(root), missing


def cited_keys(files: DataFrame) -> DataFrame:
    """``(tex_file, key)`` of all cite and nocite commands of ``files(tex_file, text)``; ``*`` cites all."""
    body = strip_verbatim(strip_comments(F.col("text")))
    lists = F.regexp_extract_all(body, F.lit(CITE), F.lit(2))
    keys = F.explode(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda k: F.trim(k)))
    return files.select("tex_file", keys.alias("key")).filter("key <> ''").distinct()


def clean_context(sentence: str) -> str:
    s = _CITE.sub("", sentence)
    s = re.sub(r"\\[A-Za-z]+\*?", "", s)
    s = re.sub(r"[{}~\\]", " ", s)
    return re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r"\s+", " ", s)).strip()


def contexts_of(tex: str) -> list[tuple[str, str, str, int]]:
    """``(key, sentence, command, position)`` per citing occurrence; nocite has no sentence.

    A sentence that is next to nothing once cleaned takes the one before it along.
    """
    body = plain_strip(tex)
    masked = _CITE.sub(lambda m: "x" * len(m[0]), body)  # page references inside a command end no sentence
    cuts = [0] + [m.end() for m in _END.finditer(masked)] + [len(body)]
    out = []
    at = 0
    for m in _CITE.finditer(body):
        if m[1].lower().startswith("nocite"):
            continue
        while at + 1 < len(cuts) - 1 and cuts[at + 1] <= m.start():
            at += 1
        sentence = clean_context(body[cuts[at] : cuts[at + 1]])
        if len(sentence) < MIN_CONTEXT and at > 0:
            sentence = clean_context(body[cuts[at - 1] : cuts[at + 1]])
        for key in (k.strip() for k in m[2].split(",")):
            if key:
                out.append((key, sentence, m[1], m.start()))
    return out


def contexts(files: DataFrame) -> DataFrame:
    """``(tex_file, key, text, command, ordinal)``; ordinal counts a key's occurrences in document order."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *c) for f, t in zip(pdf["tex_file"], pdf["text"], strict=True) for c in contexts_of(t or "")]
            yield pd.DataFrame(rows, columns=["tex_file", "key", "text", "command", "position"])

    found = files.select("tex_file", "text").mapInPandas(find, "tex_file string, key string, text string, command string, position int")
    w = Window.partitionBy("tex_file", "key").orderBy("position")
    return found.withColumn("ordinal", F.row_number().over(w) - 1).drop("position")


def strip_cites(tex: Column) -> Column:
    """Citing sentence without cite commands, control words and braces (pure SQL form)."""
    s = F.regexp_replace(tex, CITE, "")
    s = F.regexp_replace(s, r"\\[A-Za-z]+\*?", "")
    s = F.regexp_replace(s, r"[{}~\\]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"\s+([.,;:!?])", "$1"))
