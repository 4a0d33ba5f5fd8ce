"""String, number and year normalisers as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.identifiers import first_match, token_text

__all__ = ["token_text"]

# Texts that stand for "no value".
PLACEHOLDERS = ["", "-", "--", "–", "—", "n/a", "n.a.", "na", "none", "null", "tbd", "?", "..."]
# Ordinal words of editions.
ORDINALS = {w: i + 1 for i, w in enumerate(["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"])}
# Fixed value: venues that are preprint servers, repositories or aggregators.
REPOSITORY = (
    r"(?i)arxiv|bio\s*rxiv|med\s*rxiv|chem\s*rxiv|preprint|repositor|researchgate|\bssrn\b|zenodo|figshare|\bosf\b|hal[-\s]"
    r"|scholarworks|dspace|eprints|research\s+square|technical reports server|\bscholar \(|\(.*\buniversit"
)
DASHES = r"\s*[-–—‐]+\s*"


def _letters() -> tuple[str, str]:
    """Latin letters with marks and their plain letters, from the Unicode tables."""
    special = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i"}
    frm, to = list(special), list(special.values())
    for code in range(0xC0, 0x250):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isascii():
            frm.append(c)
            to.append(base)
    return "".join(frm), "".join(to)


ACCENTED, PLAIN = _letters()


def transliterate(text: Column) -> Column:
    """Latin letters without marks; ligatures written out."""
    out = F.translate(text, ACCENTED, PLAIN)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title(text: Column) -> Column:
    """Comparable title: transliterated, lower case, letters, digits and single blanks."""
    return collapse(F.regexp_replace(F.lower(transliterate(F.coalesce(text, F.lit("")))), r"[^a-z0-9 ]", " "))


def name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(transliterate(F.coalesce(text, F.lit("")))), r"[^a-z\s,.-]", ""))


def fold(text: Column) -> Column:
    """Comparable field value: braces out, transliterated, everything else but letters and digits one blank."""
    return collapse(F.regexp_replace(F.lower(transliterate(F.translate(F.coalesce(text, F.lit("")), "{}", ""))), r"[^a-z0-9]+", " "))


def clean(text: Column) -> Column:
    """Braces deleted, blanks collapsed."""
    return collapse(F.translate(F.coalesce(text, F.lit("")), "{}", ""))


def split_authors(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+and\s+"), clean), lambda x: x != "")


def year(text: Column) -> Column:
    """First four digits in a row."""
    return first_match(text, r"[0-9]{4}").cast("int")


def edition_year(text: Column) -> Column:
    """First year from 1500 to 2099 that stands alone."""
    return first_match(text, r"\b(1[5-9][0-9]{2}|20[0-9]{2})\b", 1).cast("int")


def page_year(text: Column) -> Column:
    """First year from 1500 to 2199 in a date of a web page."""
    return first_match(text, r"(1[5-9][0-9]{2}|20[0-9]{2}|21[0-9]{2})", 1).cast("int")


def last_name(author: Column) -> Column:
    """Surname: before the comma, else the last word."""
    n = name(author)
    words = F.filter(F.split(F.replace(n, F.lit("."), F.lit(" ")), r"\s+"), lambda x: x != "")
    return F.coalesce(F.when(n.contains(","), F.trim(F.split_part(n, F.lit(","), F.lit(1)))).otherwise(F.get(words, F.size(words) - 1)), F.lit(""))


def is_etal(author: Column) -> Column:
    return F.rtrim(name(author)).isin("others", "et al", "et al.", "and others")


def named(authors: Column) -> Column:
    """Authors without markers for omitted ones."""
    return F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: ~is_etal(a))


def surnames(authors: Column) -> Column:
    """Distinct surnames of the named authors, in order."""
    return F.array_distinct(F.filter(F.transform(named(authors), last_name), lambda x: x != ""))


def number(text: Column) -> Column:
    """Digits without leading zeros, anything else folded."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(r"^[0-9]+$"), F.regexp_replace(t, r"^0+(?=[0-9])", "")).otherwise(fold(t))


def pages(text: Column) -> Column:
    """Pages with every run of dashes as one hyphen."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), DASHES, "-"))


def clean_range(text: Column) -> Column:
    """Written the way the typesetter wants: two hyphens, no other dash."""
    return text.rlike(r"\w--\w") & ~text.rlike("[–—]")


def page_range(text: Column) -> Column:
    """``struct(lo, hi)`` of the first page range, null if there is none."""
    pattern = r"([0-9]{1,9})\s*[-–—]+\s*([0-9]{1,9})"
    a, b = first_match(text, pattern, 1).cast("int"), first_match(text, pattern, 2).cast("int")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))


def is_placeholder(text: Column) -> Column:
    return F.lower(clean(text)).isin(PLACEHOLDERS)


def edition_number(text: Column) -> Column:
    """Leading number, else the number of an ordinal word."""
    table = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])
    t = F.trim(text)
    return F.coalesce(first_match(t, r"^([0-9]{1,9})", 1).cast("int"), table[F.lower(first_match(t, r"^(\S+)", 1))])


def compatible(a: Column, b: Column) -> Column:
    """One text within the other after plain folding, both non-empty."""
    x, y = token_text(a), token_text(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def is_repository(venue: Column) -> Column:
    return F.coalesce(venue.rlike(REPOSITORY), F.lit(False))


def tokens(text: Column) -> Column:
    return F.filter(F.split(title(text), " "), lambda x: x != "")


def query_surname(authors: Column) -> Column:
    """Surname of the first author as it stands, for search queries."""
    a = F.get(authors, F.lit(0))
    return F.when(a.contains(","), F.trim(F.split_part(a, F.lit(","), F.lit(1)))).otherwise(first_match(F.trim(a), r"(\S+)$", 1))
