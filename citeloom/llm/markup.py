"""Markup residue in text documents (problem 7): a recurrent block labeller.

A text is cut into neutral leaves: line breaks, runs of plain words, and runs of one and the same sign.  No leaf
knows a construct of any markup language.  A leaf is described by its hashed words (WORDS buckets, embedded),
its tag path (the elements, environments, braces and paired signs open around it, embedded) and a few flags; a
bidirectional LSTM (numpy) reads the whole sequence of leaves and labels each as text, heading, list mark,
code, formula, markup or ordinary sign.  The labels decide both results: a text holds markup if a run of leaves
is labelled other than text or ordinary sign (exact check: the run holds a sign that markup needs), and the clean
text keeps text as it stands, headings (``# ``), list marks (``- ``), code (fenced) and formulas (``$...$``),
and decodes or drops what is labelled markup.

The labeller is trained on texts composed from random words, constructs of the four markup languages and
look-alikes in plain text (no corpus rows).  ``python -m citeloom.llm.markup`` trains it again from its seed and
writes the weights stored beside this module, so every driver and worker reads the same ones.

Null texts stay null, empty ones empty; long texts are read whole.
"""

from __future__ import annotations

import html
import random
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.lstm import Batch, BiLSTM, Steps

TEXT, HEADING, LIST, CODE, FORMULA, MARKUP, SIGN = range(7)
#: Batches of BATCH composed texts the labeller is trained on; seed of the texts and of the first weights.
TRAIN_STEPS, BATCH, SEED = 2000, 64, 11
HIDDEN = 32
WORDS, PATHS, N_FLAGS = 2048, 256, 18
WEIGHTS = Path(__file__).with_name("markup_weights.npz")

#: Whether a text holds any sign that markup needs; the others are passed through.
CANDIDATE = re.compile(r"[<{\\`\[*_$~]|&[#A-Za-z]|''|(?m:^[ \t]*(?:[-+•>|=#]))")
_NEEDED = re.compile(r"[<>{}\\`\[\]*_$~&|=#'+•^-]")
_LEAF = re.compile(r"[ \t]*\n\s*|(?:[^\W_]|[ \t.,?])+|(.)\1*", re.S)
_WORD = re.compile(r"[^\W_]+")


# ---- leaves -------------------------------------------------------------------------------------


def leaves(text: str) -> list[str]:
    """The text in pieces, nothing lost; a word that touches a sign is a piece of its own."""
    out: list[str] = []
    touching = False
    for m in _LEAF.finditer(text):
        s = m[0]
        if m[1] is None and "\n" not in s:  # a run of words
            if touching and (w := _WORD.match(s)) and w.end() < len(s):
                out.append(w[0])
                s = s[w.end() :]
            out.append(s)
            touching = False
            continue
        if m[1] is not None and out and out[-1][-1].isalnum():
            last, at = out[-1], len(out[-1])
            while at and last[at - 1].isalnum():
                at -= 1
            if at:
                out[-1:] = [last[:at], last[at:]]
        out.append(s)
        touching = m[1] is not None
    return out


def _code(text: str, size: int) -> int:
    return zlib.crc32(text.lower().encode("utf-8", "replace")) % size


def describe(parts: list[str]) -> Steps:
    """Hashed words, changes of the tag path and flags of every leaf."""
    n = len(parts)
    flags = np.zeros((n, N_FLAGS), dtype=np.float32)
    words: list[int] = []
    word_at: list[int] = []
    turns: list[tuple[int, int, int]] = []  # path element, step, +1 or -1
    total, seen = Counter(parts), Counter()
    closers = {parts[i + 2].lower() for i in range(n - 2) if parts[i] == "<" and parts[i + 1] == "/"}
    opened: dict[str, int] = {}

    def turn(name: str, i: int, sign: int) -> None:
        if sign > 0 or opened.get(name):
            opened[name] = opened.get(name, 0) + sign
            turns.append((_code(name, PATHS), i, sign))

    before = "\n"
    for i, s in enumerate(parts):
        is_break, plain = "\n" in s, s[0].isalnum() or s[0] in " \t.,?"
        after = parts[i + 1] if i + 1 < n else "\n"
        mine = _WORD.findall(s) if plain else [s]
        words += [_code(w, WORDS) for w in mine]
        word_at += [i] * len(mine)
        seen[s] += 1
        closed = False
        if s == "<":
            name = parts[i + 2].lower() if after == "/" and i + 2 < n else after.lower()
            if closed := name in closers:
                turn("<" + name, i, -1 if after == "/" else 1)
        elif s == "\\" and after in ("begin", "end") and i + 3 < n:
            turn("\\" + parts[i + 3], i, 1 if after == "begin" else -1)
        elif s[0] in "{[":
            turn(s[0], i, 1)
        elif s[0] in "}]":
            turn("{" if s[0] == "}" else "[", i, -1)
        elif s[0] in "$`" or s[0] in "*_'=" and len(s) > 1:
            turn(s, i, -1 if opened.get(s) else 1)
        flags[i] = (
            is_break, is_break and s.count("\n") > 1, "\n" in before, "\n" in after, before[-1].isspace(), after[0].isspace(), before[-1].isalnum(), after[0].isalnum(),
            plain, s.isdigit(), s[0].isupper(), np.log1p(len(s)) / 4, 0 if plain else min(len(s), 4) / 4, total[s] > seen[s], seen[s] > 1, closed, s.isalnum(), s.isascii(),
        )
        before = s
    path = np.array(turns, dtype=np.int64).reshape(-1, 3)
    return Steps(flags, np.array(words, dtype=np.int64), np.array(word_at, dtype=np.int64), path[:, 0], path[:, 1], path[:, 2])


# ---- training texts -----------------------------------------------------------------------------

_TAGS = ["i", "b", "em", "strong", "p", "sub", "sup", "span", "scp", "jats:p", "jats:italic", "jats:sup", "inf", "u", "div", "a", "SUP", "small", "td", "font", "sc"]
_ATTRIBUTES = ["", "", "", ' class="hl"', " id='x1'", ' href="https://a.example/b"', " n=3"]
_ENTITIES = ["amp", "nbsp", "lt", "gt", "mdash", "#8211", "#x2019", "eacute", "quot", "ndash", "#233", "ouml", "apos", "alpha", "hellip", "copy", "times"]
_COMMANDS = ["textit", "textbf", "emph", "mbox", "textsc", "texttt", "uppercase", "mathrm", "footnote", "url", "underline", "textrm", "text", "enquote", "caption", "textsuperscript"]
_GREEK = ["alpha", "beta", "lambda", "sigma", "infty", "epsilon", "mu", "theta"]
_LETTERS = ["o", "O", "l", "L", "ss", "ae", "AE", "aa", "AA", "i", "oe"]
_LINKING = ["the", "of", "and", "in", "on", "for", "a", "to", "with", "is", "by", "from", "der", "und", "les", "des", "los", "por"]
_SIGNS = [
    "(p < 0.05, n > 30)", "in C++ and C#", "with snake_case_name", "A* search", "at US$40 million", "x^2 + y^2 = 1", "on [0, 1]", "a_max = 3 * 4",
    "(item #3 of 5)", "R&D policy", "under <5 cases", "theory & practice", "--", "–", "'quoted' here", '"quoted"', "~40 percent", "50% of", "a > b",
    "[12]", "$5 or $6", "2*3*4", "|", "<= 7", "AT&T", "[sic]", "f_1", "n=30", "—", "---", "[print ed.]", "{0, 1}", "P(A|B)", "a == b", "-> here", "* p < 0.01", "A & B; C & D",
    "<name@host.example>", "C:\\temp\\file", "10.1000/abc_12-3", "https://site.example/~user/a_b?x=1&y=2#top", "1--10", "+/- 3", "$100", "5$ each", "!", "a/b", "(a) x; (b) y", "o'clock",
    "x <y and z> w", "^", "#1", "no. #7", "<3", "[a, b)", "e.g. [3, 4]", "key=value", "w_i", "~", "¿", "§ 3", "''", "`",
]


class _Writer:
    """Composes one text with a label for every character."""

    def __init__(self, rng: random.Random):
        self.rng, self.text, self.labels, self.markup = rng, [], [], True

    def add(self, s: str, label: int = TEXT) -> None:
        self.text.append(s)
        self.labels.extend([label] * len(s))

    def pick(self, options):
        return options[int(self.rng.random() * len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def number(self, most: int) -> int:
        return self.rng.randrange(1, most)

    def word(self) -> str:
        r = self.rng.random()
        if r < 0.2:
            return self.pick(_LINKING)
        if r < 0.26:
            return str(self.number(2100))
        w = "".join(self.pick("bcdfghjklmnprstvwz") + self.pick("aeiouaeiouéü") + self.pick(["", "", "n", "r", "s", "l"]) for _ in range(self.number(5)))
        return w.title() if r < 0.45 else w.upper() if r < 0.5 else w[:1] if r < 0.52 else w

    def words(self, lo: int, hi: int) -> str:
        out = ""
        for k in range(self.rng.randrange(lo, hi)):
            out += (self.pick([" ", " ", " ", " ", " ", " ", ", ", ". ", ": ", "; ", "-", " (", ") ", "? "]) if k else "") + self.word()
        return out

    def plain(self, lo: int, hi: int) -> None:
        self.add(self.words(lo, hi))

    def inside(self, depth: int, lo: int = 1, hi: int = 5) -> None:
        """Words, seldom with a construct among them."""
        self.plain(lo, hi)
        if depth and self.chance(0.15):
            self.add(" ")
            self.inline(depth - 1)
            if self.chance(0.5):
                self.add(" ")
                self.plain(1, 3)

    def formula(self) -> str:
        """A formula, seldom a long one."""
        return " + ".join(self.term() for _ in range(self.number(14) if self.chance(0.12) else 1))

    def term(self) -> str:
        v, w, g = self.pick("abcdefgkmnpqrstxyz"), self.pick(["i", "n", "k", "max", "0", "t"]), self.pick(_GREEK)
        return self.pick([
            v, f"{v}_{w}", f"{v}^2", f"{v}_{{{w}}}", f"{v} = {w}", f"\\{g}", f"O({v}^2)", f"\\mathbb{{R}}^{v}", f"\\frac{{{v}}}{{{w}}}", f"{v} + {w} < {self.number(99)}",
            f"\\sum_{{{v}=1}}^{{{w}}} {v}_{w}", f"{v}({w}) \\leq \\{g}", f"\\{g} = 0.{self.number(99)}", f"{v}'", f"E = m{v}^2",
        ])

    def inline(self, depth: int = 2) -> None:
        c = self.rng.randrange(21)
        if c <= 2:
            t = self.pick(_TAGS)
            self.add(f"<{t}{self.pick(_ATTRIBUTES)}>", MARKUP)
            self.inside(depth)
            self.add(f"</{t}>", MARKUP)
        elif c == 3:
            self.add(self.pick(["<br/>", "<br>", "<!-- " + self.words(1, 4) + " -->", "<hr />", "<br />", "<p/>"]), MARKUP)
        elif c == 4:
            self.add("&" + self.pick(_ENTITIES) + ";", MARKUP)
            if self.chance(0.3):
                self.plain(1, 2)
                self.add("&" + self.pick(_ENTITIES) + ";", MARKUP)
        elif c == 5:
            w = self.words(1, 4) if self.chance(0.6) else self.pick(["f(x)", "a_b", "x[0] = 1", "i++", "run(i, j)", "<b>", "$HOME", "a == b", "git push", "*p", "x.y()"])
            self.add(self.pick(["`" + w + "`", "`" + w + "`", "`" + w + "`", "<code>" + w + "</code>", "``" + w + "``", "<pre>" + w + "</pre>"]), CODE)
        elif c <= 7:
            f = self.formula()
            self.add(self.pick([
                f"${f}$", f"${f}$", f"${f}$", f"\\({f}\\)", f"$${f}$$", f"\\[ {f} \\]", f"<tex-math>{f}</tex-math>", f"<tex-math>${f}$</tex-math>",
                f"<mml:math><mml:mi>{f[:1]}</mml:mi></mml:math>", f"\\begin{{equation}}\n{f}\n\\end{{equation}}", f"\\begin{{align*}}{f}\\end{{align*}}",
                f"<math><mi>{f[:1]}</mi><mo>=</mo><mn>3</mn></math>",
            ]), FORMULA)
        elif c <= 9:
            letter, stroke = self.pick("aeiouncsyzAEOUC"), "\\" + self.pick(_LETTERS)
            accent = self.pick(["{}{{{}}}", "{}{}", "{{{}{}}}", "{{{}{{{}}}}}"]).format("\\" + self.pick("\"'`^~=."), letter)
            named = "\\" + self.pick("cHvuk") + "{" + letter + "}"
            self.add(self.word()[:4])
            self.add(self.pick([accent, accent, accent, named, "{\\c " + letter + "}", self.pick(["{" + stroke + "}", stroke + "{}", stroke + " "])]), MARKUP)
            self.add(self.word().lower()[: self.rng.randrange(5)])
        elif c <= 11:
            self.add("\\" + self.pick(_COMMANDS) + "{", MARKUP)
            self.inside(depth)
            self.add("}", MARKUP)
        elif c == 12 and self.chance(0.6):
            before, after = self.pick([("R", "D policy"), ("5", " level"), ("no. ", "1"), (self.word() + " ", " " + self.word()), (self.word(), self.word()), ("(" + self.word() + " = ", "7)")])
            self.add(before)
            self.add("\\" + self.pick("&%_#$"), MARKUP)
            self.add(after)
        elif c == 12:
            self.add(self.pick(["\\&", "\\%", "\\_", "\\#", "\\$", "\\\\", "\\,", "\\LaTeX{}", "\\ldots", "\\noindent "]), MARKUP)
        elif c == 13:
            self.add(self.pick(["[", "[", "!["]), MARKUP)
            self.inside(depth)
            self.add("](https://" + self.word().lower() + ".example/" + self.word().lower() + ")", MARKUP)
        elif c == 14:
            o, e = self.pick([("[[", "]]"), ("[[" + self.words(1, 3) + "|", "]]"), ("[https://a.example/" + self.word().lower() + " ", "]")])
            self.add(o, MARKUP)
            self.plain(1, 4)
            self.add(e, MARKUP)
        elif c == 15:
            w = self.words(1, 3)
            self.add(self.pick(["{{cite book|last=" + w + "|year=1970}}", "{{cite web |url=https://a.example |title=" + w + "}}", "{{" + w + "|" + self.word() + "}}", "{{reflist}}", "<ref>" + w + "</ref>"]), MARKUP)
        elif c <= 17:
            o, e = self.pick([("{", "}"), ("{", "}"), ("{", "}"), ("{{", "}}"), ("{\\em ", "}"), ("{\\bf ", "}"), ("{\\it ", "}")])
            self.add(o, MARKUP)
            if letters := self.chance(0.4):
                self.add(self.word()[: self.number(8)])
            else:
                self.inside(depth)
            self.add(e, MARKUP)
            if letters and self.chance(0.5):
                self.add(self.word().lower())
        elif c <= 19:
            q = self.pick(["''", "'''", "**", "**", "*", "*", "__", "_", "~~", "'" * 5])
            self.add(q, MARKUP)
            self.plain(1, 5)
            self.add(q, MARKUP)
        elif self.chance(0.25):
            self.add("~\\" + self.pick(["cite", "citep", "ref", "citet"]) + "{" + self.word().lower() + "}", MARKUP)
        elif self.chance(0.33):
            self.add("\\href{https://a.example/" + self.word().lower() + "}{", MARKUP)
            self.plain(1, 4)
            self.add("}", MARKUP)
        elif self.chance(0.5):
            self.plain(1, 2)
            self.add("~", MARKUP)
            self.plain(1, 2)
            if self.chance(0.6):
                self.add(" ")
                self.add("\\" + self.pick(["cite", "ref"]) + "{" + self.word().lower() + "}", MARKUP)
        else:
            self.add("``", MARKUP)
            self.plain(1, 5)
            self.add("''", MARKUP)

    def block(self) -> None:
        c = self.rng.randrange(12)
        if c == 0:
            fence = self.pick(["```", "```", "~~~"])
            code = self.pick(["  run(i)", "for i in range(9):", "x = f(y)[0]", "return a * b_1", "SELECT *"])
            self.add("\n")
            self.add(fence + self.pick(["", "python", "c", "sql"]) + "\n" + self.words(2, 6) + "\n" + code + "\n" + fence, CODE)
            self.add("\n")
        elif c <= 2:
            e = self.pick(["itemize", "enumerate", "description"])
            self.add("\\begin{" + e + "}", MARKUP)
            for _ in range(self.number(4)):
                self.add("\n")
                self.add("\\item ", LIST)
                self.inside(1)
            self.add("\n")
            self.add("\\end{" + e + "}", MARKUP)
        elif c == 3:
            e, gap = self.pick(["abstract", "quote", "center", "theorem", "table"]), self.pick(["\n", " ", ""])
            self.add("\\begin{" + e + "}", MARKUP)
            self.add(gap)
            self.inside(2, 2, 9)
            self.add(gap)
            self.add("\\end{" + e + "}", MARKUP)
        elif c <= 5:
            w, k = self.words(1, 5), self.number(5)
            marks = "=" * (k + 1)
            self.add("\n" if self.text else "")
            self.add(self.pick([
                "#" * k + " " + w, "#" * k + " " + w, f"{marks} {w} {marks}", f"{marks}{w}{marks}", f"<h{k}>{w}</h{k}>", f"<jats:title>{w}</jats:title>", f"<jats:title>{w}</jats:title>", f"<title>{w}</title>",
                "\\section{" + w + "}", "\\section*{" + w + "}", "\\subsection{" + w + "}", "\\paragraph{" + w + "}",
            ]), HEADING)
            self.add("\n")
        elif c <= 8:
            b = self.pick("-*+•*-")
            self.add(self.pick(["\n", "\n\n"]))
            for _ in range(self.rng.randrange(2, 5)):
                self.add(b + " ", LIST)
                self.inside(1)
                self.add("\n")
        elif c == 9:
            t = self.pick(["ul", "ol"])
            self.add("<" + t + ">", MARKUP)
            for _ in range(self.number(4)):
                self.add(self.pick(["", "\n"]))
                self.add("<li>", LIST)
                self.inside(1)
                self.add("</li>", MARKUP)
            self.add("</" + t + ">", MARKUP)
        elif c == 10:
            self.add("\n")
            for r in range(self.rng.randrange(2, 4)):
                for bar in ("| ", " | "):
                    self.add(bar, MARKUP)
                    self.plain(1, 3)
                self.add(" |" + ("\n|---|---|" if r == 0 else ""), MARKUP)
                self.add("\n")
        else:
            t = self.pick(["p", "div", "jats:p", "jats:sec", "abstract"])
            self.add("<" + t + ">", MARKUP)
            self.inside(2, 2, 12)
            if self.chance(0.7):
                self.add("</" + t + ">", MARKUP)

    def sign(self) -> None:
        a, b, n, m = self.word(), self.word(), self.number(999), self.number(99)
        s = self.pick(_SIGNS) if self.chance(0.6) else self.pick([
            f"({a.lower()} < 0.{m:02d}, n = {n})", f"{a}_{b}", f"{a}* {b}", f"${n}", f"${n} and ${m}", f"[{n}]", f"[{n}, {m}]", f"{a} & {b}", f"{a[:1]}&{b[:1]}", f"{a} -- {b}", f"{n}--{m}", f"'{a} {b}'", f'"{a} {b}"',
            f"({a}, {n})", f"{a} et al. ({n}) > {m}", f"~{n}", f"{n} * {m}", f"{a}^{m}", f"{a} = {m}", f"<{n}", f">{n}", f"#{n}", f"{n}%", f"[{a}]", f"[{a} {b}]", f"{a}|{b}", f"https://{a.lower()}.example/{b.lower()}_{n}",
            f"{a.lower()}@{b.lower()}.example", f"10.{n + 1000}/{a.lower()}.{m}", f"{a}'s", f"{a.lower()}_{b.lower()}({a[:1]})", f"{a}/{b}", f"{a} + {b}", f"{{{m}, {n}}}", f"(r = 0.{n}, n = {m})", f"{a} < {b} and {b} > {a}", f"* {a}",
            f"\n- {a} {b}\n", f"{a}-{b}-{n}", f"${a}", f"_{a}", f"{a}__{n}", f"\\{a}" if m < 10 else f"{a}...",
        ])
        spots = list(_WORD.finditer(s))
        if self.markup and spots and self.chance(0.4):  # markup in the midst of ordinary signs
            spot = self.pick(spots)
            o, e = self.pick([("{", "}"), ("{", "}"), ("<i>", "</i>"), ("*", "*"), ("''", "''"), ("\\emph{", "}"), ("**", "**")])
            for piece, label in ((s[: spot.start()], SIGN), (o, MARKUP), (spot[0], TEXT), (e, MARKUP), (s[spot.end() :], SIGN)):
                self.add(piece, label)
        else:
            self.add(s, SIGN)


def _compose(rng: random.Random) -> tuple[str, list[int]]:
    """A text with a label for every character: a third without markup, some of nothing but constructs."""
    w, kind = _Writer(rng), rng.random()
    w.markup = kind <= 0.65

    def construct() -> None:
        w.inline() if w.chance(0.75) else w.block()

    if kind < 0.1:  # nothing but a construct or two
        for _ in range(w.number(3)):
            construct()
        return "".join(w.text), w.labels
    around = w.pick(["p", "jats:p", "div", "abstract", "i"]) if kind < 0.2 else ""
    if around:
        w.add(f"<{around}>", MARKUP)
    for _ in range(w.number(6)):
        w.plain(0, 14)
        if kind > 0.65 or w.chance(0.45):
            if w.chance(0.8):
                w.add(" ")
                w.sign()
                w.add(" ")
        else:
            w.add(w.pick([" ", " ", " ", "\n", ""]))
            construct()
            w.add(w.pick([" ", " ", " ", "\n", ""]))
    w.plain(0, 10)
    if around:
        w.add(f"</{around}>", MARKUP)
    return "".join(w.text), w.labels


def composed(rng: random.Random, longest: int = 300) -> tuple[list[str], np.ndarray]:
    """Leaves of a composed text and their labels."""
    parts: list[str] = []
    while not 0 < len(parts) <= longest:
        text, labels = _compose(rng)
        parts = leaves(text)
    at, y = 0, []
    for s in parts:
        mine = labels[at : at + len(s)]
        at += len(s)
        y.append(max(sorted(set(mine)), key=mine.count))
    return parts, np.array(y)


def train(steps: int = TRAIN_STEPS, seed: int = SEED) -> tuple[BiLSTM, float]:
    """A new labeller and its accuracy on composed texts it had not seen."""
    rng = random.Random(seed)

    def batches() -> Iterator[tuple[Batch, np.ndarray]]:
        pool: list = []
        for _ in range(steps):
            if not pool:  # sequences of like length share a batch
                some = sorted((composed(rng) for _ in range(BATCH * 16)), key=lambda p: len(p[0]))
                pool = [some[k * BATCH : (k + 1) * BATCH] for k in range(16)]
                rng.shuffle(pool)
            part = pool.pop()
            batch = Batch([describe(p) for p, _ in part])
            target = np.zeros((batch.t, batch.b), dtype=np.int64)
            for b, (_, y) in enumerate(part):
                target[: len(y), b] = y
            yield batch, target

    model = BiLSTM(WORDS, PATHS, N_FLAGS, 7, HIDDEN, seed=seed)
    return model, model.train(batches(), steps)


def labeller() -> BiLSTM:
    """The stored labeller."""
    with np.load(WEIGHTS) as stored:
        return BiLSTM.of(dict(stored))


# ---- use ----------------------------------------------------------------------------------------


def runs(parts: list[str], labels: np.ndarray) -> list[tuple[int, str]]:
    """Neighbouring leaves of one label together; text and ordinary signs count as one."""
    out: list[tuple[int, list[str]]] = []
    for s, y in zip(parts, labels.tolist(), strict=True):
        y = TEXT if y == SIGN else y
        if out and out[-1][0] == y:
            out[-1][1].append(s)
        else:
            out.append((y, [s]))
    return [(y, "".join(ss)) for y, ss in out]


def holds_markup(parts: list[str], labels: np.ndarray) -> bool:
    """Whether a run is labelled markup or structure and (exact check) holds a sign that those need."""
    return any(y != TEXT and _NEEDED.search(s) for y, s in runs(parts, labels))


# Accent commands and letters of LaTeX.
_ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "H": "\u030b", "v": "\u030c", "u": "\u0306", "k": "\u0328"}
_STROKES = {"o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ss": "ß", "ae": "æ", "AE": "Æ", "aa": "å", "AA": "Å", "oe": "œ", "OE": "Œ", "i": "ı", "j": "ȷ"}
_DROP = re.compile(r"<!--.*?-->|\{\{.*?\}\}|<ref\b.*?</ref>|\]\([^()]*\)|\[\[[^\[\]|]*\||\[?https?://[^\s{}]+|\\(?:cite\w*|ref|label)\{[^{}]*\}", re.S)
_PIECE = re.compile(
    r"(?P<entity>&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)"
    r"|\\(?P<mark>[\"'`^~=.])\s*\{?\s*\\?(?P<on>[A-Za-z])\s*\}?|\\(?P<named>[cHvuk])(?:\s*\{(?P<under>[A-Za-z])\}|\s+(?P<bare>[A-Za-z]))"
    r"|\\(?P<stroke>ss|ae|AE|aa|AA|oe|OE|[oOlLij])(?![A-Za-z])(?:\{\}|\s)?|\\(?P<kept>[&%$#_{}])|(?P<quote>``|'')"
    r"|(?P<block></?(?:\w+:)?(?:p|div|br|ul|ol|table|tr|title|sec|section|blockquote|h[1-6])\b[^<>]*>|\\(?:begin|end)\s*\{[^{}]*\}|\\\\)|(?P<tie>~|\\[,;: ])|\\[A-Za-z]+\*?[ \t]*|</?[A-Za-z][^<>]*>|(?P<word>[^\W_]+)|.",
    re.S,
)


def decode(run: str, quotes: bool = False) -> str:
    """What a run labelled markup stands for: letters, signs, line breaks, mostly nothing.  Words of no tag or command stay.

    ``quotes``: two single quotes are quotation marks, as the text holds their counterpart.
    """

    def one(m: re.Match) -> str:
        if m["mark"]:
            return unicodedata.normalize("NFC", m["on"] + _ACCENTS[m["mark"]])
        if m["named"]:
            return unicodedata.normalize("NFC", (m["under"] or m["bare"]) + _ACCENTS[m["named"]])
        if m["stroke"]:
            return _STROKES[m["stroke"]]
        if m["entity"]:
            return html.unescape(m[0])
        if m["quote"]:
            return '"' if quotes else ""
        return m["kept"] or m["word"] or ("\n" if m["block"] else " " if m["tie"] else "")

    return _PIECE.sub(one, _DROP.sub("", run))


_OPENING = re.compile(r"^(?:\$\$?|\\[(\[]|\\begin\{[^{}]*\}|<[^<>]*>|\s)+")
_CLOSING = re.compile(r"(?:\$\$?|\\[)\]]|\\end\{[^{}]*\}?|<[^<>]*>|\s)+$")
_BULLET = re.compile(r"(^|\n)[ \t]*(?:[-*+•]|\\item\b|<li\b[^<>]*>)[ \t]*")
_HEAD = re.compile(r"^\s*(?:#+|=+|\\\w+\*?\{|<[^<>]*>)\s*|\s*(?:#+|=+|\}|</[^<>]*>)\s*$")


def clean(parts: list[str], labels: np.ndarray) -> str:
    """Clean text of a labelled sequence, keeping headings, list marks, code and formulas."""
    out: list[str] = []
    quotes = any(s == "``" for s in parts)
    owed, after_list = "", False
    for y, s in runs(parts, labels):
        line = "\n" if out and not out[-1].endswith("\n") else ""
        if y == TEXT:
            if owed and s[0].isalpha():  # an accent whose letter is labelled text
                s = unicodedata.normalize("NFC", s[0] + owed) + s[1:]
            out.append(s.lstrip(" \t") if after_list else s)
        elif y == MARKUP:
            out.append(decode(s, quotes))
        elif y == FORMULA:
            inner = re.sub(r"</?(?:mml:)?[a-z]+>", "", _CLOSING.sub("", _OPENING.sub("", s)))
            out.append(f"${inner}$" if inner else "")
        elif y == CODE:
            out.append(re.sub(r"^\s*<(?:code|pre)\b[^<>]*>|</(?:code|pre)>\s*$", "`", s))
        elif y == LIST:
            out.append(_BULLET.sub(lambda m, line=line: (m[1] or line) + "- ", s))
        else:
            out.append(line + "# " + _HEAD.sub("", s).strip() + "\n")
        lone = re.search(r"\\([\"'`^~=.])\s*$", s) if y == MARKUP else None
        owed, after_list = (_ACCENTS[lone[1]] if lone else ""), y == LIST
    text = re.sub(r"[ \t]+\n", "\n", "".join(x for x in out if x))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def label_texts(texts: list[str], model: BiLSTM) -> list[tuple[list[str], np.ndarray]]:
    """Leaves and labels of each text."""
    parts = [leaves(t) for t in texts]
    return list(zip(parts, model.label([describe(p) for p in parts]), strict=True))


_models: dict[str, BiLSTM] = {}


def convert(rows: DataFrame, column: str = "text", with_clean: bool = True) -> DataFrame:
    """``rows`` with ``has_markup`` and, on request, ``clean`` for its text column.

    Texts without any sign that markup needs are passed through as they are, by the same rule always.
    """
    weights = rows.sparkSession.sparkContext.broadcast(labeller().p)  # of fixed size
    token = uuid.uuid4().hex

    def apply(texts: pd.Series) -> pd.DataFrame:
        if token not in _models:
            _models.clear()
            _models[token] = BiLSTM.of(weights.value)
        values = texts.tolist()
        hot = [i for i, t in enumerate(values) if isinstance(t, str) and CANDIDATE.search(t)]
        found, out = [False] * len(values), list(values)
        distinct = list(dict.fromkeys(values[i] for i in hot))
        got = dict(zip(distinct, label_texts(distinct, _models[token]), strict=True))
        for i in hot:
            found[i] = holds_markup(*got[values[i]])
            if with_clean and found[i]:
                out[i] = clean(*got[values[i]])
        return pd.DataFrame({"has_markup": found, "clean": out if with_clean else None})

    apply_udf = F.pandas_udf(apply, "has_markup boolean, clean string")
    kept = [c for c in rows.columns if c not in ("_m", "has_markup", "clean")]  # results replace columns of these names
    got = rows.select(*kept).withColumn("_m", apply_udf(column))
    return got.select(*kept, "_m.has_markup", *(["_m.clean"] if with_clean else []))


def texts(bib: DataFrame, records: DataFrame) -> DataFrame:
    """``(table_name, row_id, field, text)`` of the titles, raw fields and abstracts with any text."""
    one = bib.select(F.lit("bib_entries").alias("table_name"), F.col("entry_id").alias("row_id"), F.lit("title").alias("field"), F.col("title").alias("text"))
    raw = bib.select(F.col("entry_id"), F.explode("raw_fields").alias("k", "text")).select(
        F.lit("bib_entries").alias("table_name"), F.col("entry_id").alias("row_id"), F.concat(F.lit("raw_fields."), "k").alias("field"), "text"
    )
    abstract = records.select(
        F.lit("source_records").alias("table_name"), F.col("record_id").cast("string").alias("row_id"), F.lit("abstract").alias("field"), F.col("abstract").alias("text")
    )
    return one.union(raw).union(abstract).filter("row_id is not null and trim(text) <> ''")


if __name__ == "__main__":
    made, share = train()
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in made.p.items()})
    print(f"right labels on unseen composed texts: {share:.4f}")
