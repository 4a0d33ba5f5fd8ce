"""Variant spellings of names typed by people (problem 6).

Names are cleaned (LaTeX accents, braces, homonym numbers, titles, case) and parsed into surname and given
names; which words are given names is learnt from all names written "Surname, Given".  Spellings with the
same parse form one node.  Nodes are blocked by the phonetic codes of their sorted tokens: surname and first name,
nicknames written out, both codes whole and with any one sign left out (of an organisation its two rarest words).
Names that give initials only are blocked by surname and initial, against all names; as few of them differ within a
block, no block is quadratic in full names.  Pairs of a block that a bounded edit distance leaves are compared by
Jaro-Winkler and edit distance on surnames and words, a nickname table and initials.
Accepted pairs of equally complete nodes are clustered by connected components.  A less complete node
(no middle initial, a nickname, initials only) joins a cluster only if it fits exactly one, so that "J. Smith" never
fuses two people.  The result pairs all spellings of a cluster.

Null, blank and placeholder names and markers for omitted authors are no names; a surname alone is paired only with
other spellings of it; repeated names count once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.components import connected_components
from citeloom.runtime import cut, drop

#: Least Jaro-Winkler similarity of two surnames or organisation words taken for one with a typing error.
MIN_JARO_WINKLER = 0.85
#: A word taken for a typing error of another is in at most RARE nodes or a fifth as many as the other.
RARE = 2
OFTEN = 5

NICKNAMES = {
    "alexander": "alex sasha sandy xander", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny",
    "catherine": "cathy kate cat", "charles": "charlie chuck", "christina": "tina chris", "christopher": "chris kit topher",
    "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "dorothea": "dora dot thea", "dorothy": "dot dolly",
    "edward": "ed eddie ned ted", "eleanor": "ellie nell", "elizabeth": "liz beth betty eliza lisa libby", "frances": "fran",
    "francesca": "chicca fran franca", "francis": "frank", "frederick": "fred freddie", "gabriel": "gabe", "george": "geo",
    "giuseppe": "beppe peppe pino", "gregory": "greg", "henry": "harry hank", "ignacio": "nacho", "isabella": "bella", "jacob": "jake",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hans jo", "john": "jack johnny", "jonathan": "jon",
    "joseph": "joe joey", "katherine": "kate kathy kit katie", "lawrence": "larry", "leonard": "len leo", "margaret": "maggie peg meg peggy",
    "matthew": "matt", "matthias": "matti matt", "michael": "mike mick", "nathaniel": "nat nate", "nicholas": "nick", "patricia": "pat patty",
    "patrick": "pat", "penelope": "penny", "peter": "pete", "philip": "phil", "rebecca": "becky", "ricardo": "rico", "richard": "dick rick",
    "robert": "bob rob bobby robin", "ronald": "ron", "samuel": "sam", "stephen": "steve", "steven": "steve", "susanna": "sue susie",
    "susan": "sue", "tadeusz": "tadek", "theodore": "ted theo", "thomas": "tom tommy", "timothy": "tim", "umberto": "berto",
    "victoria": "vicky tori", "vincent": "vince", "walter": "walt", "william": "bill will willy", "zachary": "zach",
}
_FULL: dict[str, set[str]] = {}
for _name, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL.setdefault(_s, set()).add(_name)

# Markers for omitted authors and placeholders.
NOT_NAMES = {"others", "and others", "et al", "et al.", "al", "anonymous", "anon", "unknown", "n/a", "none", "null", "-", "--", "?", "??", "...", "tbd", "various"}
PARTICLES = {"de", "der", "den", "von", "van", "da", "di", "del", "della", "du", "la", "le", "el", "al", "bin", "ibn", "ben", "st", "dos", "das", "do", "ter", "ten", "zu", "zur", "af", "av"}
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "jr", "sr", "ii", "iii", "iv", "phd", "md"}
ORG_WORDS = {
    "institute": "inst", "centre": "ctr cent centr cen", "center": "ctr cent", "laboratory": "lab labs laboratories", "consortium": "consort cons",
    "university": "univ", "department": "dept dep", "society": "soc", "association": "assoc", "group": "grp", "network": "netw", "school": "sch",
    "college": "coll", "academy": "acad", "hospital": "hosp", "foundation": "found", "agency": "", "council": "", "committee": "comm",
    "collaboration": "collab", "team": "", "project": "proj", "observatory": "obs", "museum": "mus", "library": "libr", "ministry": "min", "organization": "org",
}
_ORG_SHORT = {s: w for w, many in ORG_WORDS.items() for s in many.split()} | {"center": "centre"}
_ORG_STOP = {"the", "of", "for", "and", "in", "on", "at", "de", "la", "du"}

LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "’": "'", "ʼ": "'"})
_TEX_LETTER = re.compile(r"\\(aa|AA|ae|AE|oe|OE|ss|o|O|l|L|i|j)(?![A-Za-z])\s*(?:\{\})?")
_TEX_ACCENT = re.compile(r"\\(?:[\"'`^~=.]|[A-Za-z](?=\s*\{))\s*")
_WORDS = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*\.?")


def fold(name: str) -> str:
    """Name without LaTeX, braces, accents and homonym number; case is kept."""
    s = _TEX_LETTER.sub(lambda m: {"aa": "a", "AA": "A"}.get(m[1], m[1]), name)
    s = _TEX_ACCENT.sub("", s).replace("{", "").replace("}", "").replace("~", " ").replace("\\", "")
    s = unicodedata.normalize("NFKD", s.translate(LETTERS))
    s = "".join(c for c in s if not unicodedata.combining(c)).translate(LETTERS)
    return re.sub(r"\s+\d{1,4}\s*$", "", s).strip()


def _given(word: str, shouting: bool) -> list[str]:
    """A given-name word as tokens: initials as single letters."""
    bare = word.rstrip(".").replace("'", "")
    if len(bare) <= 1:
        return [bare.lower()]
    if not shouting and bare.isupper() and len(bare) <= 3:
        return list(bare.lower())
    return [_german(p.lower()) for p in bare.split("-") if p]


def _german(word: str) -> str:
    return re.sub(r"^(j)ue|^(s)oe", lambda m: (m[1] or m[2]) + ("u" if m[1] else "o"), word)


def surname(words: list[str]) -> str:
    """Comparable form of the words of a surname: particles, hyphens and case left out."""
    kept = [w for w in words if w.lower().rstrip(".") not in PARTICLES] or words
    s = "".join(kept).lower().replace("'", "").replace(".", "")
    return re.sub(r"^(?:al|el)-", "", s).replace("-", "")


def split(name: str) -> tuple[str, list[str], list[str], bool]:
    """``(kind, words before the comma, words after it, all in capitals)``; kind p, o or '' (no name)."""
    text = fold(name or "")
    if text.lower().strip(" .") in {n.strip(" .") for n in NOT_NAMES} or not _WORDS.search(text):
        return "", [], [], False
    lower = [w.lower().rstrip(".") for w in _WORDS.findall(text)]
    if any(w in ORG_WORDS or w in _ORG_SHORT and len(w) > 3 or w in ("lab", "ctr", "inst", "univ") for w in lower):
        return "o", [w for w in _WORDS.findall(text) if w.lower() not in _ORG_STOP], [], False
    before, comma, after = text.partition(",")
    words = [w for w in _WORDS.findall(before) if w.lower().rstrip(".") not in TITLES]
    rest = [w for w in _WORDS.findall(after) if w.lower().rstrip(".") not in TITLES]
    shouting = text.isupper() and any(len(w) > 3 for w in words + rest)
    return "p", words, rest if comma else [], shouting


def parse(name: str, known_given: set[str]) -> tuple[str, str, list[str]]:
    """``(kind, surname or organisation words, given-name tokens)`` of a name."""
    kind, words, rest, shouting = split(name)
    if kind == "o":
        full = [_ORG_SHORT.get(w.lower().rstrip("."), w.lower()) for w in words]
        return "o", " ".join(sorted({w.replace("'", "") for w in full})), []
    if not words:
        return "", "", []
    if rest:
        return "p", surname(words), [g for w in rest for g in _given(w, shouting)]

    def initial(w: str) -> bool:
        bare = w.rstrip(".")
        return len(bare) == 1 or (bare.isupper() and len(bare) <= 3 and not shouting)

    full = [i for i, w in enumerate(words) if not initial(w)]
    if not full:
        return "", "", []
    if initial(words[-1]):  # Smith J
        cut_at = next((i for i, w in enumerate(words) if initial(w)), len(words))
        if cut_at > 0:
            return "p", surname(words[:cut_at]), [g for w in words[cut_at:] for g in _given(w, shouting)]
    last = words[-1].lower()
    if len(full) > 1 and last in known_given and words[0].lower() not in known_given and not initial(words[0]):
        return "p", surname(words[:-1]), _given(words[-1], shouting)  # Smith John
    at = 1 if len(words) > 1 else 0
    while at < len(words) - 1 and (initial(words[at]) or words[at].lower() in known_given):
        at += 1
    return "p", surname(words[at:]), [g for w in words[:at] for g in _given(w, shouting)]


_CLASS = {c: k for k, group in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in group}


def phonetic(word: str) -> str:
    """Consonant classes of a word without repeats; vowels and h, w, y do not count."""
    out = ""
    for c in word:
        k = _CLASS.get(c, "" if c.isascii() else c)
        if k and out[-1:] != k:
            out += k
    return out or word[:2]


def code_keys(word: str, least: int = 3) -> set[str]:
    """The phonetic code and, if it has ``least`` signs, the code with any one sign left out."""
    code = phonetic(word)
    return {code} | ({re.sub(r"(.)\1+", r"\1", code[:i] + code[i + 1 :]) for i in range(len(code))} if len(code) >= least else set())


def first_names(token: str) -> set[str]:
    """Full forms a first-name token can stand for."""
    return {token} | _FULL.get(token, set())


def osa(a: str, b: str, most: int = 2) -> int:
    """Edit distance with neighbouring swaps, at most ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, cb in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def same_word(a: str, b: str) -> bool:
    """Equal, or one typing error apart."""
    if a == b:
        return True
    return min(len(a), len(b)) >= 4 and osa(a, b, 1) <= 1 and jaro_winkler(a, b) >= MIN_JARO_WINKLER - (0.06 if min(len(a), len(b)) < 7 else 0)


#: Completeness of a parse: one initial, initials with a middle one, a nickname, a first name, first and middle.
INITIAL, INITIALS, NICKNAME, FIRST, FULL, ORG = range(6)


def level(given: list[str]) -> int:
    """Completeness of a list of given names; -1 for none."""
    if not given:
        return -1
    if len(given[0]) == 1:
        return INITIALS if len(given) > 1 else INITIAL
    if given[0] in _FULL and given[0] not in NICKNAMES:
        return NICKNAME
    return FULL if len(given) > 1 else FIRST


def can_be_error(n: int, m: int) -> bool:
    """Whether words in n and m nodes can be one word and its misspelling."""
    return min(n, m) <= RARE or min(n, m) * OFTEN <= max(n, m)


def given_agree(a: list[str], b: list[str], error: bool = True) -> bool:
    """Whether two lists of given names can be the same person's; ``error``: the first may be misspelt."""
    if not a or not b:
        return False
    x, y = a[0], b[0]
    if len(x) > 1 and len(y) > 1:
        if not (first_names(x) & first_names(y) or (error and any(same_word(p, q) for p in first_names(x) for q in first_names(y)))):
            return False
    elif not {n[0] for n in first_names(x)} & {n[0] for n in first_names(y)}:
        return False
    m, n = [t[0] for t in a[1:]], [t[0] for t in b[1:]]
    k = min(len(m), len(n))
    return m[:k] == n[:k]


def org_agree(a: str, b: str) -> bool:
    """Whether two organisations' words agree, abbreviations and one typing error per word allowed."""
    x, y = sorted((a.split(), b.split()), key=len)
    short = any(w.endswith(".") for w in x)
    left = list(y)
    exact = 0
    for w in x:
        bare = w.rstrip(".")
        hit = next((v for v in left if v.rstrip(".") == bare), None)
        exact += hit is not None and len(bare) > 3
        hit = hit or next((v for v in left if (w.endswith(".") and v.startswith(bare)) or (v.endswith(".") and bare.startswith(v.rstrip(".")))), None)
        hit = hit or next((v for v in left if same_word(bare, v.rstrip("."))), None)
        if hit is None:
            return False
        left.remove(hit)
    return exact >= 1 and (not left or (short and len(left) <= 1))


def author_names(bib: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct author strings of both tables, as they stand."""
    both = bib.select(F.explode("authors").alias("name")).union(records.select(F.explode("authors").alias("name")))
    return both.filter(F.trim("name") != "").distinct()


def _learn_given(names: DataFrame) -> DataFrame:
    """``(token)`` of words that stand mostly after the comma in "Surname, Given"."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in pdf["name"]:
                if "," in name:
                    kind, words, rest, _ = split(name)
                    if kind == "p":
                        rows += [(w.lower(), 0, 1) for w in words] + [(w.lower(), 1, 0) for w in rest if len(w.rstrip(".")) > 1]
            yield pd.DataFrame(rows, columns=["token", "g", "s"]).groupby("token", as_index=False).sum() if rows else pd.DataFrame(columns=["token", "g", "s"])

    told = names.mapInPandas(count, "token string, g long, s long").groupBy("token").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    return told.filter("g > s").select("token")


def nodes(names: DataFrame) -> DataFrame:
    """``(name, node, kind, core, given, level)``: every name with its parse; equal parses share a node."""
    given = cut(_learn_given(names), "given")
    tokens = F.pandas_udf(lambda s: s.map(lambda t: [w.lower() for w in _WORDS.findall(fold(t))]), "array<string>")
    words = names.select("name", F.explode(tokens("name")).alias("token"))
    known = words.filter("length(token) > 1").join(given, "token").groupBy("name").agg(F.collect_set("token").alias("known"))
    rows = names.join(known, "name", "left")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, known_tokens in zip(pdf["name"], pdf["known"], strict=True):
                kind, core, g = parse(name, set(known_tokens) if known_tokens is not None else set())
                if kind and core:
                    out.append((name, f"{kind}|{core}|{' '.join(g)}", kind, core, g, level(g) if kind == "p" else ORG))
            yield pd.DataFrame(out, columns=["name", "node", "kind", "core", "given", "level"])

    return rows.mapInPandas(make, "name string, node string, kind string, core string, given array<string>, level int")


def _hash(key: str) -> int:
    return xxhash.xxh64_intdigest(key) - (1 << 63)


def _people_keys(core: str, first: str) -> list[tuple[int, bool]]:
    """``(key, typo)`` of a person with a full first name: the surname as it stands with the codes of the first name, and
    (typo) the codes of the surname with the first name's full forms as they stand; the parts are sorted."""
    forms = first_names(first)
    same = {" ".join(sorted((core, "/" + k))) for n in forms for k in code_keys(n, 1)}  # first names have short codes
    typo = {" ".join(sorted((k, n))) for n in forms for k in code_keys(core)}
    return [(_hash("f" + k), False) for k in sorted(same)] + [(_hash("t" + k), True) for k in sorted(typo)]


def _initial_keys(core: str, first: str) -> list[tuple[int, bool]]:
    """``(key, typo)`` by initial: the surname as it stands, and (typo) its codes."""
    initials = sorted({n[0] for n in first_names(first)})
    return [(_hash(f"s{core}/{i}"), False) for i in initials] + [(_hash(f"c{k}/{i}"), True) for k in sorted(code_keys(core)) for i in initials]


KEYS = "array<struct<key:bigint,typo:boolean>>"


def _pairs(people: DataFrame, rare: DataFrame) -> DataFrame:
    """``(a, b)`` of the pairs that share a key; ``people(id, core, given, n_core)``.

    Full names are paired by their keys, names with initials only with all names of their surname and initial.  A key
    by codes pairs surnames that can be one word and its misspelling, a bounded number of edits apart.
    """
    made = lambda f: F.pandas_udf(lambda core, given: pd.Series([f(c, g[0]) for c, g in zip(core, given, strict=True)]), KEYS)
    words = F.pandas_udf(lambda ws: ws.map(lambda x: [(_hash(k), False) for k in sorted({f"o/{k}" for w in x for k in code_keys(w.rstrip("."))})]), KEYS)
    short = F.length(F.get("given", F.lit(0))) == 1
    row = ["id", "core", "n_core"]
    full = people.filter(~short).select(*row, F.explode(made(_people_keys)("core", "given")).alias("k"))
    full = full.union(rare.select("id", F.lit("").alias("core"), F.lit(0).cast("bigint").alias("n_core"), F.explode(words("words")).alias("k")))
    full = cut(full.select(*row, "k.key", "k.typo"), "names-full")
    some = cut(people.select(*row, short.alias("lone"), F.explode(made(_initial_keys)("core", "given")).alias("k")).select(*row, "lone", "k.key", "k.typo"), "names-initials")
    side = lambda df, s: df.select(F.col("id").alias(s), "key", *([F.col("typo")] if s == "a" else []), *[F.col(c).alias(f"{c}_{s}") for c in ("core", "n_core", "lone") if c in df.columns])
    less, more = F.least("n_core_a", "n_core_b"), F.greatest("n_core_a", "n_core_b")
    # one edit or swap is at most two edits
    near = ~F.col("typo") | ((F.col("core_a") != F.col("core_b")) & ((less <= RARE) | (less * OFTEN <= more)) & (F.levenshtein("core_a", "core_b", 2) >= 0))
    both = side(full, "a").join(side(full, "b"), "key").filter("a < b").filter(near).select("a", "b")
    half = side(some.filter("lone"), "a").join(side(some, "b"), "key").filter("a < b or (not lone_b and a <> b)").filter(near)
    out = cut(both.union(half.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "names-pairs")
    drop(full, some)
    return out


def clusters(names: DataFrame) -> DataFrame:
    """``(name, cluster)`` of every name that shares a cluster with another."""
    all_names = cut(nodes(names), "names")
    forms = cut(all_names.select("node", "kind", "core", "given", "level").dropDuplicates(["node"]).withColumn("id", F.xxhash64("node")), "forms")
    orgs = forms.filter("kind = 'o'").select("id", F.explode(F.split("core", " ")).alias("word"))
    df = orgs.groupBy("word").agg(F.count("*").alias("n"))
    rare = orgs.join(df, "word").groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "word"))), 1, 2)["word"].alias("words"))
    often = forms.filter("level >= 0").groupBy("kind", "core").agg(F.count("*").alias("n_core"))
    firsts = forms.filter("level >= 0").groupBy(F.get("given", F.lit(0)).alias("first")).agg(F.count("*").alias("n_first"))
    known = cut(forms.filter("level >= 0").withColumn("first", F.get("given", F.lit(0))).join(often, ["kind", "core"]).join(firsts, "first", "left"), "known")
    pairs = _pairs(known.filter("kind = 'p'"), rare)

    @F.pandas_udf("boolean")
    def agree(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        cols = ["kind", "core", "given", "n_core", "n_first"]
        for (k, x, g, n, f), (_, y, h, m, e) in zip(a[cols].itertuples(index=False), b[cols].itertuples(index=False), strict=True):
            if k == "o":
                out.append(org_agree(x, y))
            else:
                out.append((x == y or (can_be_error(n, m) and same_word(x, y))) and given_agree(list(g), list(h), can_be_error(f, e)))
        return pd.Series(out)

    def side(s: str) -> DataFrame:
        row = F.struct("kind", "core", "given", "n_core", F.coalesce("n_first", F.lit(0)).alias("n_first"))
        return known.select(F.col("id").alias(s), F.col("node").alias(f"node_{s}"), F.col("level").alias(f"level_{s}"), row.alias(f"row_{s}"))

    full = pairs.join(side("a"), "a").join(side("b"), "b").filter("row_a.kind = row_b.kind")
    accepted = cut(
        full.filter(agree("row_a", "row_b")).select("node_a", "node_b", "level_a", "level_b", F.expr("get(row_a.given, 0) <=> get(row_b.given, 0)").alias("same_first")),
        "accepted",
    )
    drop(pairs, known)
    # two nicknames may stand for different names
    level_edges = accepted.filter((F.col("level_a") == F.col("level_b")) & ((F.col("level_a") != NICKNAME) | F.col("same_first")))
    found = connected_components(level_edges, "node_a", "node_b")
    labels = cut(
        forms.select("node", "level").join(found, "node", "left").select("node", "level", F.coalesce("component", "node").alias("label")), "labels"
    )
    both = accepted.filter("level_a <> level_b").select(
        F.when(F.col("level_a") < F.col("level_b"), F.col("node_a")).otherwise(F.col("node_b")).alias("low"),
        F.when(F.col("level_a") < F.col("level_b"), F.col("node_b")).otherwise(F.col("node_a")).alias("high"),
        F.least("level_a", "level_b").alias("from_level"),
        F.greatest("level_a", "level_b").alias("to_level"),
    )
    for lower, uppers in ((FIRST, [FULL]), (NICKNAME, [FIRST, FULL]), (INITIALS, [FULL]), (INITIALS, [NICKNAME, FIRST]), (INITIAL, [INITIALS, NICKNAME, FIRST, FULL])):
        labels = _attach(labels, both.filter((F.col("from_level") == lower) & F.col("to_level").isin(uppers)))
    drop(accepted, forms)
    members = all_names.join(labels.select("node", "label"), "node").select("name", F.col("label").alias("cluster"))
    return members


def _attach(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after every lower cluster that fits exactly one higher cluster has joined it."""
    at = labels.select("node", "label")
    ends = edges.join(at.select(F.col("node").alias("low"), F.col("label").alias("mine")), "low").join(
        at.select(F.col("node").alias("high"), F.col("label").alias("theirs")), "high"
    ).filter("mine <> theirs")
    one = ends.groupBy("mine").agg(F.min("theirs").alias("least"), F.max("theirs").alias("most")).filter("least = most")
    moved = labels.join(one.select(F.col("mine").alias("label"), F.col("least").alias("new")), "label", "left")
    out = cut(moved.select("node", "level", F.coalesce("new", "label").alias("label")), "labels")
    drop(labels)
    return out


def variant_pairs(members: DataFrame) -> DataFrame:
    """``(name_a, name_b)``, name_a < name_b by code point, of all spellings of each cluster."""
    a, b = members.select("cluster", F.col("name").alias("name_a")), members.select("cluster", F.col("name").alias("name_b"))
    return a.join(b, "cluster").filter("name_a < name_b").select("name_a", "name_b").distinct()
