"""Field checks: every field of a matched entry against the best source, in long format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.functions import text

# Which source a canonical field value is taken from first.
SOURCE_RANK = {"publisher": 0, "crossref": 1, "openalex": 2, "openlibrary": 3, "semantic_scholar": 4, "arxiv": 5}
OTHER_RANK = 9
FIELDS = ["title", "venue", "year", "volume", "number", "pages", "publisher"]
STATUSES = ["ok", "formatting", "error", "uncertain", "unverifiable", "needs_llm"]


def rank(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])
    return F.coalesce(table[source], F.lit(OTHER_RANK))


def canonical_values(records: DataFrame, entry: str = "entry_id") -> DataFrame:
    """``(entry, field, value, sources)``: the first non-empty value of each field over an entry's records,
    published ones first, then by source rank and order, with the sources that give the same value."""
    s = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), s("issue" if f == "number" else f).alias("value")) for f in FIELDS])
    rows = records.select(
        entry, "source", F.struct(F.coalesce("is_preprint", F.lit(False)).alias("p"), rank(F.col("source")).alias("k"), "ord").alias("o"), F.explode(cells).alias("c")
    ).filter("c.value <> ''")
    per_value = rows.groupBy(entry, "c.field", "c.value").agg(F.min("o").alias("o"), F.array_sort(F.collect_set("source")).alias("sources"))
    return per_value.groupBy(entry, "field").agg(F.min_by("value", "o").alias("value"), F.min_by("sources", "o").alias("sources"))


def prepare(df: DataFrame, b: str, c: str) -> DataFrame:
    """Adds the comparable forms of a cited and a canonical value: folded, as number and as pages."""
    for s, v in (("b", F.col(b)), ("c", F.col(c))):
        df = df.withColumn(f"fold_{s}", text.fold(v)).withColumn(f"page_{s}", text.pages(v)).withColumn(f"digits_{s}", text.clean(v))
    number = lambda s: F.when(F.col(f"digits_{s}").rlike(r"^[0-9]+$"), F.regexp_replace(f"digits_{s}", r"^0+(?=[0-9])", "")).otherwise(F.col(f"fold_{s}"))
    return df.withColumn("num_b", number("b")).withColumn("num_c", number("c"))


def title_check(b: Column, c: Column) -> Column:
    return F.when(F.trim(c) == "", "unverifiable").when(F.col("fold_b") == F.col("fold_c"), "ok").otherwise("needs_llm")


def string_check(b: Column, c: Column) -> Column:
    return F.when(F.trim(c) == "", "unverifiable").when(b == c, "ok").when(F.col("fold_b") == F.col("fold_c"), "formatting").otherwise("needs_llm")


def venue_check(b: Column, c: Column) -> Column:
    return F.when(text.is_repository(c), "unverifiable").otherwise(string_check(b, c))


def year_check(b: Column, c: Column, submitted: Column, is_book: Column) -> Column:
    """ok if equal or the cited year is that of the preprint's submission; one year off is uncertain."""
    d = F.abs(b - c)
    return (
        F.when(c.isNull() | b.isNull(), "unverifiable")
        .when(d == 0, "ok")
        .when((c > b) & (b == submitted), "ok")
        .when(is_book | (d == 1), "uncertain")
        .otherwise("error")
    )


def number_check(b: Column, c: Column) -> Column:
    """A placeholder is an error of its own."""
    return (
        F.when(F.lower("digits_b").isin(text.PLACEHOLDERS), "error")
        .when(F.trim(c) == "", "unverifiable")
        .when(F.col("num_b") != F.col("num_c"), "error")
        .otherwise("ok")
    )


def pages_check(b: Column, c: Column) -> Column:
    return (
        F.when(F.trim(c) == "", "unverifiable")
        .when(F.col("page_b") != F.col("page_c"), "error")
        .when(F.col("page_b").contains("-") & ~text.clean_range(b), "formatting")
        .otherwise("ok")
    )


def publisher_check(b: Column, c: Column, is_book: Column) -> Column:
    plain = string_check(b, c)
    within = F.col("fold_b").contains(F.col("fold_c")) | F.col("fold_c").contains(F.col("fold_b"))
    return F.when(is_book & (plain == "needs_llm") & within, "formatting").otherwise(plain)


def field_findings(entries: DataFrame, canonical: DataFrame, skip_book_fields: bool = False) -> DataFrame:
    """``(entry_id, pos, field, bib_value, canonical_value, sources, status)`` for matched entries.

    Absent cited fields give no row; ``skip_book_fields`` leaves year and publisher of books to the edition
    check.
    """
    raw = lambda k: F.nullif(F.trim(F.element_at("raw_fields", k)), F.lit(""))
    blank = lambda c: F.coalesce(c, F.lit(""))
    cited = {
        "title": F.nullif(F.trim("title"), F.lit("")), "venue": F.nullif(F.trim("venue"), F.lit("")), "year": F.col("year").cast("string"),
        "volume": F.element_at("raw_fields", "volume"), "number": F.coalesce(F.element_at("raw_fields", "number"), F.element_at("raw_fields", "issue")),
        "pages": F.coalesce(F.nullif(F.trim("pages"), F.lit("")), raw("pages")), "publisher": F.nullif(F.trim("publisher"), F.lit("")),
    }
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), cited[f].alias("bib_value")) for i, f in enumerate(FIELDS)])
    is_book = F.col("entry_type").isin("book", "incollection")
    rows = entries.select("entry_id", is_book.alias("is_book"), ids.arxiv_year(ids.cited_arxiv_id(F.col("ids"))).alias("submitted"), F.explode(cells).alias("c"))
    rows = rows.select("entry_id", "is_book", "submitted", "c.*").filter("bib_value is not null")
    if skip_book_fields:
        rows = rows.filter(~(F.col("is_book") & F.col("field").isin("year", "publisher")))
    both = rows.join(canonical.select("entry_id", "field", F.col("value").alias("canonical_value"), "sources"), ["entry_id", "field"], "left")
    both = prepare(both.withColumn("_c", blank(F.col("canonical_value"))), "bib_value", "_c")
    b, c = F.col("bib_value"), F.col("_c")
    same_field = lambda f, check: F.when(F.col("field") == f, check)
    status = F.coalesce(
        same_field("title", title_check(b, c)), same_field("venue", venue_check(b, c)), same_field("volume", number_check(b, c)), same_field("number", number_check(b, c)),
        same_field("year", year_check(F.col("year_b"), F.col("year_c"), F.col("submitted"), F.col("is_book"))), same_field("pages", pages_check(b, c)),
        same_field("publisher", publisher_check(b, c, F.col("is_book"))),
    )
    both = both.withColumn("year_b", text.year(b)).withColumn("year_c", text.year(c))
    return both.select("entry_id", "pos", "field", "bib_value", "canonical_value", "sources", status.alias("status"))


def edition_findings(entries: DataFrame, matched: DataFrame) -> DataFrame:
    """``(entry_id, field, bib_value, canonical_value, status)``: year and publisher of a book against the edition
    it cites, so that a later reprint is no error.  matched(entry_id, edition_year, edition_publisher)."""
    books = entries.filter(F.col("entry_type").isin("book", "incollection")).select("entry_id", "year", "publisher").join(matched, "entry_id")
    blank = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    rows = books.select("entry_id", F.explode(F.array(
        F.struct(F.lit("year").alias("field"), blank(F.col("year")).alias("bib_value"), blank(F.col("edition_year")).alias("canonical_value")),
        F.struct(F.lit("publisher").alias("field"), blank(F.col("publisher")).alias("bib_value"), blank(F.col("edition_publisher")).alias("canonical_value")),
    )).alias("c")).select("entry_id", "c.*").filter("bib_value <> ''")
    rows = prepare(rows, "bib_value", "canonical_value")
    b, c = F.col("bib_value"), F.col("canonical_value")
    by_year = year_check(b.try_cast("int"), c.try_cast("int"), F.lit(None).cast("int"), F.lit(True))
    status = F.when(F.col("field") == "year", by_year).otherwise(publisher_check(b, c, F.lit(True)))
    return rows.select("entry_id", "field", "bib_value", "canonical_value", status.alias("status"))


def apply_judgments(findings: DataFrame, judgments: DataFrame | None = None) -> DataFrame:
    """Findings with ``needs_llm`` ruled: a confident variant is formatting, a confident error an error;
    anything else, and everything without a ruling, is uncertain.

    judgments(entry_id, field, kind in variant/error/uncertain, confidence in high/medium/low).
    """
    if judgments is None:
        return findings.withColumn("status", F.when(F.col("status") == "needs_llm", "uncertain").otherwise(F.col("status"))).withColumn("via_llm", F.lit(False))
    j = judgments.select("entry_id", "field", F.col("kind").alias("_k"), F.col("confidence").alias("_c"))
    ruled = F.when(F.col("_k") == "variant", "formatting").when((F.col("_k") == "error") & F.col("_c").isin("high", "medium"), "error").otherwise("uncertain")
    out = findings.join(j, ["entry_id", "field"], "left")
    asked = F.col("status") == "needs_llm"
    return out.withColumn("via_llm", asked & F.col("_k").isNotNull()).withColumn("status", F.when(asked, ruled).otherwise(F.col("status"))).drop("_k", "_c")


def unverifiable_line(findings: DataFrame) -> DataFrame:
    """``(entry_id, fields)``: the fields nothing could be said about, in order, as one text."""
    rows = findings.filter("status = 'unverifiable'").groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("pos", "field"))).alias("f"))
    return rows.select("entry_id", F.array_join(F.col("f")["field"], ", ").alias("fields"))


def notes(findings: DataFrame) -> DataFrame:
    """Findings with a readable note."""
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(c, F.lit("")), F.lit("'"))
    note = F.concat_ws(" ", F.col("field"), quoted(F.col("bib_value")), F.concat(F.lit("vs "), quoted(F.col("canonical_value"))), F.concat(F.lit("("), F.array_join("sources", ", "), F.lit(")")))
    return findings.withColumn("note", note)


def consulted_sources(records: DataFrame, entry: str = "entry_id") -> DataFrame:
    return records.groupBy(entry).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def status_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("field", "status").agg(F.count("*").alias("n"))


def first_finding(findings: DataFrame) -> DataFrame:
    """The first error of each entry in field order."""
    w = Window.partitionBy("entry_id").orderBy("pos")
    return findings.filter("status = 'error'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
