"""The audit: entries, candidate records and failures in, verdicts and reports out.

Every stage is a DataFrame of its own; large intermediate results are cut once and read by the stages that
follow.  The only UDFs are the fuzzy ratios, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.operators import adjudicate, books, entries, fields, pool, resolve, score
from citeloom.runtime import cut, table

Judge = Callable[[list[str]], list[str]]


def load_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, one row each however often delivered."""
    return entries.latest_delivery(table(spark, sf_dir, "bib_entries"), "entry_id")


def load_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, one row each, without their payload."""
    return entries.latest_delivery(table(spark, sf_dir, "source_records").drop("raw"), "record_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records fetched for an entry, with their place ``ord`` among its candidates: answers to an identifier
    before answers to a search, then by record_id; no numbering, so an entry with very many records is no hot group."""
    fetched = entries.latest_delivery(table(spark, sf_dir, "source_records").drop("raw", "ord").filter("entry_id is not null"), "record_id")
    return fetched.withColumn("ord", F.col("record_id") + F.when(F.col("query_kind") == "id", 0).otherwise(pool.SEARCHED))


def pooled(spark: SparkSession, sf_dir: str, records: DataFrame | None = None) -> DataFrame:
    """Representatives of the candidates of every entry; ``records``: the candidates, if they are cut already."""
    records = cut(candidates(spark, sf_dir), "candidates") if records is None else records
    return pool.representatives(records, pool.pool(records))


def assess(entry_rows: DataFrame, representatives: DataFrame) -> DataFrame:
    """Every entry-representative pair with features and bucket; ``r`` is the representative."""
    e = entry_rows.select("entry_id", F.struct("title", "authors", "year", "venue", "pages", "ids").alias("e"))
    cols = [c for c in representatives.columns if c not in ("entry", "ord")]
    r = representatives.select(F.col("entry").alias("entry_id"), "ord", F.struct(*cols).alias("r"))
    both = e.select("*", *score.prepare(F.col("e"), "e")).join(r.select("*", *score.prepare(F.col("r"), "r")), "entry_id")
    scored = score.features(both).withColumn("bucket", score.bucket(ids.has_strong_id(F.col("e.ids"))))
    return scored.select("entry_id", "ord", "e", "r", *FEATURES, "bucket")


FEATURES = [
    "title_ratio", "prefix_trap", "author_overlap", "author_set_jaccard", "author_subset", "year_factor", "venue_compatible", "id_agreement", "pages_conflict", "composite",
]


def errors(spark: SparkSession, sf_dir: str, entry_rows: DataFrame) -> DataFrame:
    """``(entry_id, errored)`` from the log of source queries."""
    failed = score.errored(table(spark, sf_dir, "source_results"))
    return entry_rows.select("entry_id", F.col("content_hash").alias("entry_hash")).join(failed, "entry_hash").select("entry_id", "errored")


def stages(spark: SparkSession, sf_dir: str, judge: Judge | None = None, model: str = "", cache: DataFrame | None = None) -> dict[str, DataFrame]:
    """``entries``, ``records`` fetched for them, ``assessed`` candidates, ``errors`` and ``generic`` verdicts.

    With a judge, unsure candidates (the best eight per entry) and ambiguous pairs of accepted ones are ruled.
    """
    entry_rows = cut(load_entries(spark, sf_dir), "entries")
    records = cut(candidates(spark, sf_dir), "candidates")
    assessed = cut(assess(entry_rows, pooled(spark, sf_dir, records)), "assessed")
    confirmed = None
    if judge is not None:
        asked = adjudicate.candidate_questions(score.top_candidates(assessed))
        answers = cut(adjudicate.ask(asked, "can_correspond", model, judge, cache), "rulings")
        assessed = cut(resolve.apply_rulings(assessed, adjudicate.rulings(answers, ["entry_id", "ord"])).drop("errored"), "ruled")
    accepted = assessed.filter("bucket = 'auto_accept'").select("entry_id", "ord", "r")
    if judge is not None:
        side = lambda x: accepted.select(F.col("entry_id"), F.col("ord").alias(x), F.col("r").alias(f"r{x}"))
        open_pairs = score.relations(accepted).filter("relation = 'ambiguous'").withColumnRenamed("entry", "entry_id").drop("relation")
        asked = adjudicate.relation_questions(open_pairs.join(side("a"), ["entry_id", "a"]).join(side("b"), ["entry_id", "b"]))
        confirmed = adjudicate.confirmed_pairs(cut(adjudicate.ask(asked, "same_work", model, judge, cache), "relations"))
    arts = score.artifacts(accepted, score.cluster_accepted(accepted, confirmed))
    failed = errors(spark, sf_dir, entry_rows)
    return {"entries": entry_rows, "records": records, "assessed": assessed, "errors": failed, "generic": score.verdicts(entry_rows, assessed, arts, failed)}


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entry_id, kind, confidence, n_artifacts)`` of every entry from its candidates alone."""
    return stages(spark, sf_dir)["generic"]


def book_editions(records: DataFrame, entry_rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Editions known of every book, the cited one and the latest, from the records fetched for it."""
    editions = books.dedup_editions(records.filter(F.col("source").isin("openlibrary", "google_books")))
    return books.resolve_books(entry_rows, editions, books.backfilled_isbn(entry_rows, records), failed)


def override_all(s: dict[str, DataFrame], editions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``(entry_id, kind)`` after web evidence ``pages(entry_id, web)``, pinned ids and book editions."""
    e, i = s["entries"], F.col("ids")
    rows = e.select("entry_id", F.coalesce(entries.is_web_only(F.col("entry_type"), i), F.lit(False)).alias("web_only"))
    rows = rows.join(s["generic"].select("entry_id", F.col("kind").alias("generic")), "entry_id", "left")
    for field, name in (("openalex", "work_pin"), ("google_books", "volume_pin")):
        rows = rows.join(resolve.pinned(e, s["assessed"], field).withColumnRenamed("accepted", name), "entry_id", "left")
    rows = rows.join(editions.select("entry_id", F.col("matched_ord").isNotNull().alias("edition_matched"), F.col("errored").alias("edition_errored")), "entry_id", "left")
    rows = rows.join(pages, "entry_id", "left") if pages is not None else rows.withColumn("web", F.lit(None).cast("string"))
    return resolve.override(rows)


def final_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entry_id, kind)`` of every entry with all evidence at hand."""
    s = stages(spark, sf_dir)
    return override_all(s, book_editions(s["records"], s["entries"], s["errors"]))


def judged_findings(findings: DataFrame, judge: Judge | None, model: str = "", cache: DataFrame | None = None) -> DataFrame:
    """Field findings after the judge, if there is one, has ruled on those that need it."""
    if judge is None:
        return fields.apply_judgments(findings)
    answers = adjudicate.ask(adjudicate.field_questions(findings), "field_check", model, judge, cache)
    return fields.apply_judgments(findings, adjudicate.judgments(cut(answers, "judgments")))


def advisories(entry_rows: DataFrame, assessed: DataFrame, editions: DataFrame) -> DataFrame:
    """``(entry_id, kind, detail)``: better versions of what is cited, and later editions than the cited one."""
    better = books.better_versions(entry_rows, best_records(assessed))
    later = entry_rows.select("entry_id", "year").join(editions.filter("matched_ord is not null"), "entry_id").filter("latest_year > year")
    return better.union(later.select("entry_id", F.lit("newer_edition").alias("kind"), F.col("latest_year").cast("string").alias("detail")))


def report(spark: SparkSession, sf_dir: str, judge: Judge | None = None, model: str = "", cache: DataFrame | None = None) -> DataFrame:
    """One row per entry: verdict, numbers of issues, formatting nits and advisories, report category."""
    st = stages(spark, sf_dir, judge, model, cache)
    entry_rows = st["entries"]
    editions = cut(book_editions(st["records"], entry_rows, st["errors"]), "editions")
    v = override_all(st, editions)
    found = entries.issues(entry_rows).select("entry_id", "issue").union(books.book_report(editions))
    n_issues = found.groupBy("entry_id").agg(F.count("*").alias("n_issues"))
    findings = judged_findings(fields.field_findings(entry_rows, fields.canonical_values(st["records"])), judge, model, cache)
    nits = findings.groupBy("entry_id").agg(F.count_if(F.col("status") == "formatting").alias("n_formatting"))
    advice = advisories(entry_rows, st["assessed"], editions).groupBy("entry_id").agg(F.count("*").alias("n_advisories"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = entry_rows.select("entry_id", "entry_type").join(v, "entry_id")
    for more in (n_issues, nits, advice):
        rows = rows.join(more, "entry_id", "left")
    return resolve.categories(rows.select("entry_id", "entry_type", "kind", zero("n_issues"), zero("n_formatting"), zero("n_advisories")))


def best_records(assessed: DataFrame) -> DataFrame:
    """The best accepted representative per entry, and the first published DOI among the accepted."""
    ok = assessed.filter("bucket = 'auto_accept'").select("entry_id", "ord", "r.*")
    best = F.struct((~F.col("is_preprint")).alias("p"), F.col("ids")["doi"].isNotNull().alias("d"), "citation_count", (-F.col("ord")).alias("o"))
    top = ok.groupBy("entry_id").agg(F.max_by(F.struct("ids", "year", "edition", "venue", "source"), best).alias("b"))
    return top.select("entry_id", "b.*").join(books.find_published_doi(ok), "entry_id", "left")
