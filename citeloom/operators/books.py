"""Editions of books and better versions of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.functions import text

WORKS, EDITIONS = 6, 50


def dedup_editions(editions: DataFrame, order: str = "ord") -> DataFrame:
    """One edition per first of ISBN, native id, year and publisher."""
    key = F.coalesce(F.col("ids")["isbn13"], F.nullif("source_native_id", F.lit("")), F.concat_ws("|", F.col("year").cast("string"), "publisher"))
    first = editions.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("entry_id", "_k").orderBy(order))).filter("_n = 1")
    return first.drop("_k", "_n")


def within_limits(rows: DataFrame, k: int, by: list[str], order: str = "ord") -> DataFrame:
    """The first k rows of every group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_n") <= k).drop("_n")


def title_compatible(a: Column, b: Column) -> Column:
    """Whether a work found by title can be the cited book: one folded title holds the other."""
    x, y = text.fold(a), text.fold(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def works_of(entries: DataFrame, works: DataFrame) -> DataFrame:
    """``(entry_id, work, ord)``: the works of every book, those found by ISBN first, then those found by title
    that pass the title gate; each once, WORKS at most.  works(entry_id, work, title, by_isbn, ord)."""
    books = entries.filter(F.col("entry_type").isin("book", "incollection")).select("entry_id", F.col("title").alias("_t"))
    ok = books.join(works, "entry_id").filter((F.trim("work") != "") & (F.col("by_isbn") | title_compatible(F.col("_t"), F.col("title"))))
    one = ok.groupBy("entry_id", "work").agg(F.min(F.struct((~F.col("by_isbn")).alias("s"), "ord")).alias("ord"))
    kept = within_limits(one, WORKS, ["entry_id"])
    return kept.select("entry_id", "work", F.col("ord.ord").alias("ord"))


def editions_of(works: DataFrame, editions: DataFrame) -> DataFrame:
    """Editions of the works of every book, EDITIONS per work at most, each edition once per entry.

    editions(work, ids, source_native_id, year, publisher, ord)."""
    few = within_limits(editions, EDITIONS, ["work"])
    joined = works.select("entry_id", "work", F.col("ord").alias("work_ord")).join(few, "work")
    return dedup_editions(joined.withColumn("ord", F.col("work_ord") * (EDITIONS + 1) + F.col("ord")).drop("work_ord"))


def match_cited_edition(entries: DataFrame, editions: DataFrame) -> DataFrame:
    """``(entry_id, ord, priority)`` of the edition an entry cites: by ISBN, then year and publisher, then year."""
    e = entries.filter(F.col("entry_type").isin("book", "incollection")).select(
        "entry_id", ids.all_isbn13(F.col("ids")).alias("e_isbn"), F.col("year").alias("e_year"), F.col("publisher").alias("e_pub")
    )
    r = editions.select("entry_id", "ord", ids.all_isbn13(F.col("ids")).alias("r_isbn"), F.col("year").alias("r_year"), F.col("publisher").alias("r_pub"))
    priority = (
        F.when(F.arrays_overlap("e_isbn", "r_isbn"), 0)
        .when((F.col("e_year") == F.col("r_year")) & text.compatible(F.col("e_pub"), F.col("r_pub")), 1)
        .when(F.col("e_year") == F.col("r_year"), 2)
    )
    hits = e.join(r, "entry_id").withColumn("priority", priority).filter("priority is not null")
    best = hits.groupBy("entry_id").agg(F.min(F.struct("priority", "ord")).alias("m"))
    return best.select("entry_id", "m.ord", "m.priority")


def latest_edition(editions: DataFrame) -> DataFrame:
    """``(entry_id, ord, year)`` of the newest dated edition, the first on ties."""
    dated = editions.filter("year is not null")
    best = dated.groupBy("entry_id").agg(F.max(F.struct("year", (-F.col("ord")).alias("o"))).alias("m"))
    return best.select("entry_id", (-F.col("m.o")).alias("ord"), F.col("m.year").alias("year"))


def backfilled_isbn(entries: DataFrame, records: DataFrame) -> DataFrame:
    """ISBN of a book cited without one: from the first record of the same published DOI, or of a book source."""
    e = entries.filter(F.col("entry_type").isin("book", "incollection") & F.col("ids")["isbn13"].isNull()).select("entry_id", ids.published_doi(F.col("ids")["doi"]).alias("doi"))
    r = records.select("entry_id", "ord", "source", ids.published_doi(F.col("ids")["doi"]).alias("r_doi"), F.col("ids")["isbn13"].alias("isbn13")).filter("isbn13 is not null")
    hit = e.join(r, "entry_id").filter((F.col("doi") == F.col("r_doi")) | (F.col("source") == "openlibrary"))
    return hit.groupBy("entry_id").agg(F.min_by("isbn13", "ord").alias("isbn13"))


def newer_edition(matched: DataFrame, latest: DataFrame, editions: DataFrame) -> DataFrame:
    """``(entry_id, cited_year, latest_year, note)`` where a later edition than the cited one exists."""
    cited = matched.join(editions.select("entry_id", "ord", F.col("year").alias("cited_year")), ["entry_id", "ord"])
    both = cited.join(latest.select("entry_id", F.col("year").alias("latest_year")), "entry_id").filter("latest_year > cited_year")
    note = F.format_string("cited edition is of %d; the latest is of %d", "cited_year", "latest_year")
    return both.select("entry_id", "cited_year", "latest_year", note.alias("note"))


def cites_preprint(i: Column) -> Column:
    return F.when(i["doi"].isNotNull(), i["doi"].startswith(ids.PREPRINT_DOI)).otherwise(i["arxiv_id"].isNotNull())


def better_versions(entries: DataFrame, best: DataFrame) -> DataFrame:
    """``(entry_id, kind, detail)``: a published version of a cited preprint, a newer preprint version, or a
    later edition of a book.  best(entry_id, published_doi, year, edition) describes the matched work."""
    i = F.col("ids")
    rows = entries.join(best.select("entry_id", "published_doi", F.col("year").alias("best_year"), F.col("edition").alias("n_editions")), "entry_id")
    paper = F.col("entry_type").isin("article", "inproceedings", "misc") & cites_preprint(i)
    submitted = ids.arxiv_year(ids.cited_arxiv_id(i))
    newer = F.col("published_doi").isNull() & (F.col("year") == submitted) & (F.col("best_year") > F.col("year"))
    book = F.col("entry_type").isin("book", "incollection") & (F.col("n_editions") > 1)
    said = F.trim(F.coalesce(F.element_at("raw_fields", "edition"), F.lit("")))
    number = text.edition_number(said)
    n = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    found = F.array_compact(
        F.array(
            F.when(paper & F.col("published_doi").isNotNull(), n("published_version", F.col("published_doi"))),
            F.when(paper & newer, n("newer_preprint", F.col("best_year"))),
            F.when(book & (said == ""), n("edition_not_given", F.col("n_editions"))),
            F.when(book & (F.col("n_editions") > number), n("later_edition", F.col("n_editions"))),
        )
    )
    return rows.select("entry_id", F.explode(found).alias("v")).select("entry_id", "v.kind", "v.detail")


def find_published_doi(records: DataFrame, entry: str = "entry_id") -> DataFrame:
    """First published DOI over the versions of an entry's work."""
    d = ids.published_doi(F.col("ids")["doi"])
    return records.withColumn("_d", d).filter("_d is not null").groupBy(entry).agg(F.min_by("_d", "ord").alias("published_doi"))


def resolve_books(entries: DataFrame, editions: DataFrame, isbn: DataFrame, errors: DataFrame) -> DataFrame:
    """Per book: number of editions, the matched one (by the entry, else by the backfilled ISBN), the latest,
    and whether the look-up failed."""
    books = entries.filter(F.col("entry_type").isin("book", "incollection"))
    direct = match_cited_edition(books, editions)
    known = editions.select("entry_id", "ord", F.explode(ids.all_isbn13(F.col("ids"))).alias("isbn13"))
    again = isbn.join(known, ["entry_id", "isbn13"]).groupBy("entry_id").agg(F.min("ord").alias("back_ord"))
    counts = editions.groupBy("entry_id").agg(F.count("*").alias("n_editions"))
    out = books.select("entry_id").join(counts, "entry_id", "left").join(direct.select("entry_id", F.col("ord").alias("own_ord")), "entry_id", "left")
    out = out.join(again, "entry_id", "left").join(latest_edition(editions).select("entry_id", F.col("year").alias("latest_year")), "entry_id", "left").join(errors, "entry_id", "left")
    return out.select(
        "entry_id", F.coalesce("n_editions", F.lit(0)).alias("n_editions"), F.coalesce("own_ord", "back_ord").alias("matched_ord"), "latest_year",
        F.coalesce("errored", F.lit(False)).alias("errored"),
    )


def book_report(resolved: DataFrame) -> DataFrame:
    """``(entry_id, issue)`` rows of the book check."""
    issue = (
        F.when(F.col("matched_ord").isNotNull(), None)
        .when(F.col("errored"), "edition look-up failed")
        .when(F.col("n_editions") == 0, "no editions found")
        .otherwise(F.format_string("not among the %d known editions", "n_editions"))
    )
    return resolved.select("entry_id", issue.alias("issue")).filter("issue is not null")
