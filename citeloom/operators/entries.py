"""Operators on bibliography entries: citation joins, routing, deterministic issues, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.functions import text

# Which sources are asked for an identifier kind and, failing that, for an entry type.
SOURCES = ["crossref", "openalex", "semantic_scholar", "dblp", "arxiv", "openlibrary", "google_books", "publisher", "web"]
BY_ID = [
    ("doi", ["crossref", "openalex", "semantic_scholar"]),
    ("arxiv_id", ["arxiv", "openalex", "semantic_scholar"]),
    ("isbn13", ["openlibrary", "google_books"]),
    ("google_books", ["google_books"]),
    ("openalex", ["openalex"]),
]
BY_TYPE = {
    "book": ["openlibrary", "google_books", "crossref"],
    "incollection": ["openlibrary", "google_books", "crossref"],
    "misc": ["arxiv", "openalex", "crossref", "semantic_scholar", "dblp"],
}
BY_DEFAULT = ["crossref", "openalex", "semantic_scholar", "dblp"]


def latest_delivery(df: DataFrame, key: str) -> DataFrame:
    """One row per key, without ``loaded_at``, in which alone redelivered rows differ; only the columns a plan
    reads are shuffled."""
    return df.drop("loaded_at").dropDuplicates([key])


def mark_cited(entries: DataFrame, keys: DataFrame, on: list[str], star: bool = False) -> DataFrame:
    """Entries with ``is_cited``: the key occurs among the cited keys, or everything is cited."""
    known = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    return entries.join(known, on, "left").withColumn("is_cited", F.lit(star) | F.col("_hit").isNotNull()).drop("_hit")


def dangling(keys: DataFrame, entries: DataFrame, on: list[str]) -> DataFrame:
    """Cited keys without an entry."""
    return keys.select(*on).distinct().join(entries.select(*on), on, "left_anti")


def uncited(entries: DataFrame, keys: DataFrame, on: list[str], star: bool = False) -> DataFrame:
    """Entries that no text cites; none if everything is cited."""
    return entries.filter(F.lit(not star)).join(keys.select(*on).distinct(), on, "left_anti")


def split_commented(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live entries, and commented-out twins whose key has no live entry."""
    live = entries.filter(~F.coalesce("is_commented", F.lit(False)))
    twins = entries.filter(F.coalesce("is_commented", F.lit(False))).join(live.select("bib_file", "key"), ["bib_file", "key"], "left_anti")
    return live, twins


def route(entries: DataFrame) -> DataFrame:
    """``(entry_id, query_kind, source, ord)``: the sources to ask, in order, distinct per kind."""
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    by_id = F.array_distinct(F.concat(*[F.when(F.col("ids")[k].isNotNull(), names(v)).otherwise(none) for k, v in BY_ID]))
    by_meta = F.lit(None)
    for kind, v in BY_TYPE.items():
        by_meta = F.when(F.col("entry_type") == kind, names(v)).otherwise(by_meta)
    by_meta = F.coalesce(by_meta, names(BY_DEFAULT))
    both = F.array(F.struct(F.lit("id").alias("query_kind"), by_id.alias("s")), F.struct(F.lit("metadata").alias("query_kind"), by_meta.alias("s")))
    wide = entries.select("entry_id", F.explode(both).alias("r"))
    return wide.select("entry_id", "r.query_kind", F.posexplode("r.s").alias("ord", "source"))


def is_web_only(entry_type: Column, i: Column) -> Column:
    """A page cited by address alone."""
    return (entry_type == "misc") & i["url"].isNotNull() & i["doi"].isNull() & i["arxiv_id"].isNull() & i["isbn13"].isNull()


def issues(entries: DataFrame) -> DataFrame:
    """``(entry_id, pos, issue)``: what is wrong with an entry on its face."""
    i, kind = F.col("ids"), F.col("entry_type")
    raw = F.trim(F.coalesce(F.element_at("raw_fields", "doi"), F.lit("")))
    as_url = i["doi"].isNotNull() & (F.lower(raw).contains("doi.org") | F.lower(raw).startswith("http"))
    books = kind.isin("book", "incollection")
    found = F.array_compact(
        F.array(
            F.when(as_url, "doi_as_url"),
            F.when(books & i["isbn13"].isNull(), "book_without_isbn"),
            F.when(kind.isin("article", "inproceedings") & i["doi"].isNull() & i["arxiv_id"].isNull(), "no_doi_or_arxiv"),
            F.when((kind == "misc") & ~ids.any_id(i), "no_identifier_or_url"),
            F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "missing_title"),
            F.when(F.coalesce(F.size(F.col("authors")), F.lit(0)) < 1, "missing_authors"),
        )
    )
    return entries.select("entry_id", F.posexplode(found).alias("pos", "issue"))


def type_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("entry_type").agg(F.count("*").alias("n"))


def summary(entries: DataFrame, issue_rows: DataFrame, dangling_keys: DataFrame) -> DataFrame:
    """One row of figures: entries, cited, uncited, twins, with issues, issues, by identifiers, dangling keys."""
    per_entry = issue_rows.groupBy("entry_id").agg(F.count("*").alias("n_issues"))
    live = ~F.coalesce(F.col("is_commented"), F.lit(False))
    rows = entries.join(per_entry, "entry_id", "left")
    one = rows.agg(
        F.count_if(live).alias("entries"),
        F.count_if(live & F.col("cited")).alias("cited"),
        F.count_if(live & ~F.col("cited")).alias("uncited"),
        F.count_if(~live).alias("commented"),
        F.count_if(live & F.col("n_issues").isNotNull()).alias("with_issues"),
        F.coalesce(F.sum(F.when(live, F.col("n_issues"))), F.lit(0)).alias("issues"),
        F.count_if(live & ids.has_strong_id(F.col("ids"))).alias("with_strong_id"),
    )
    return one.crossJoin(dangling_keys.agg(F.count("*").alias("dangling")))  # one row each


def venue_first(fields: Column) -> Column:
    """Venue of raw fields: journal, then book title, then how it was published."""
    parts = [F.nullif(text.clean(F.element_at(fields, k)), F.lit("")) for k in ("journal", "booktitle", "howpublished")]
    return F.coalesce(*parts, F.lit(""))
