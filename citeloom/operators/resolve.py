"""Verdict overrides, web evidence, backfilled identifiers, enrichment, citation alignment, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids

WEB_TITLE = 0.85
PIPELINE_VERSION = "1"


# ---- adjudication -------------------------------------------------------------------------------


def apply_rulings(assessed: DataFrame, rulings: DataFrame) -> DataFrame:
    """Buckets after external rulings (entry_id, ord, answer, confidence, error): a confident answer moves a
    candidate to accept or reject, an unsure one changes nothing, a failure marks the row errored."""
    r = rulings.select("entry_id", "ord", F.col("answer").alias("_a"), F.col("confidence").alias("_c"), F.col("error").alias("_e"))
    out = assessed.join(r, ["entry_id", "ord"], "left")
    sure = (F.col("bucket") == "adjudicate") & F.col("_c").isin("high", "medium")
    new = F.when(sure & F.col("_a"), "auto_accept").when(sure & ~F.col("_a"), "auto_reject").otherwise(F.col("bucket"))
    return out.withColumn("errored", F.col("_e").isNotNull()).withColumn("bucket", new).drop("_a", "_c", "_e")


# ---- verdict overrides --------------------------------------------------------------------------


def web_verdict(page: Column) -> Column:
    """Verdict of a cited page from its evidence struct (error, dead, rendered_empty, title_ratio, ruling,
    confidence): only a confirmed page counts; anything that could not be read leaves it open."""
    v = lambda k: F.lit(k).cast("string")
    return (
        F.when(page["error"].isNotNull() | page["dead"] | page["rendered_empty"], v(None))
        .when(page["title_ratio"] >= WEB_TITLE, v("exactly_one"))
        .when(page["ruling"] & page["confidence"].isin("high", "medium"), v("exactly_one"))
        .when(~page["ruling"] & (page["confidence"] == "high"), v("none"))
    )


def page_artifacts(pages: DataFrame) -> DataFrame:
    """``(entry_id, kind, n_artifacts, source, title, url)``: a confirmed page is the one artifact of its entry.

    pages(entry_id, web, title, url), ``web`` as given by :func:`web_verdict`."""
    return pages.filter("web = 'exactly_one'").select("entry_id", F.col("web").alias("kind"), F.lit(1).alias("n_artifacts"), F.lit("web").alias("source"), "title", "url")


def override(rows: DataFrame) -> DataFrame:
    """Final verdict from generic, web, pinned and book evidence; later evidence wins.

    rows(entry_id, generic, web_only, web, work_pin, volume_pin, edition_matched, edition_errored): pins
    are true where the record of the cited id was accepted.
    """
    first = F.when(F.col("web_only") & (F.col("generic").isNull() | (F.col("generic") == "none")), F.col("web")).otherwise(F.col("generic"))
    second = F.when(F.coalesce("volume_pin", F.lit(False)) | F.coalesce("work_pin", F.lit(False)), "exactly_one").otherwise(first)
    third = (
        F.when(F.coalesce("edition_matched", F.lit(False)), "exactly_one")
        .when(F.coalesce("edition_errored", F.lit(False)) & (second == "none"), F.lit(None).cast("string"))
        .otherwise(second)
    )
    return rows.select("entry_id", third.alias("kind"))


def pinned(entries: DataFrame, assessed: DataFrame, field: str) -> DataFrame:
    """Entries whose cited id (openalex or google_books) is carried by a record; ``accepted`` tells whether
    the first such record was accepted."""
    e = entries.select("entry_id", F.col("ids")[field].alias("_id")).filter("_id is not null")
    r = assessed.select("entry_id", "ord", "bucket", F.col("r.ids")[field].alias("_rid"))
    hit = e.join(r, "entry_id").filter("_id = _rid").groupBy("entry_id").agg(F.min_by("bucket", "ord").alias("b"))
    return hit.select("entry_id", (F.col("b") == "auto_accept").alias("accepted"))


# ---- identifiers found on the way ---------------------------------------------------------------


def backfill_notes(entries: DataFrame, best: DataFrame, resolution: DataFrame) -> DataFrame:
    """``(entry_id, kind, value)``: identifiers a matched record adds; a found DOI is told apart by whether
    it resolves (true, false, not determined)."""
    r = best.select("entry_id", F.col("ids").alias("b"), F.col("venue").alias("b_venue"))
    look = resolution.select(F.lower("doi").alias("_doi"), "resolves", F.lit(True).alias("_seen"))
    rows = entries.select("entry_id", "ids", "venue").join(r, "entry_id").join(look, F.col("b")["doi"] == F.col("_doi"), "left")
    i, b = F.col("ids"), F.col("b")
    n = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    no_doi = i["doi"].isNull() & b["doi"].isNotNull()
    found = F.array_compact(
        F.array(
            F.when(no_doi & F.col("resolves"), n("doi_found", b["doi"])),
            F.when(no_doi & (F.col("resolves") == F.lit(False)), n("doi_does_not_resolve", b["doi"])),
            F.when(no_doi & F.col("resolves").isNull(), n("doi_unconfirmed", b["doi"])),
            F.when(i["isbn13"].isNull() & b["isbn13"].isNotNull(), n("isbn_found", b["isbn13"])),
            F.when(i["doi"].isNull() & b["doi"].isNull() & ids.venue_needs_no_doi(F.col("venue")), n("no_doi_expected", F.col("venue"))),
        )
    )
    return rows.select("entry_id", F.explode(found).alias("n")).select("entry_id", "n.kind", "n.value")


def doi_resolution(rows: DataFrame) -> DataFrame:
    """``(doi, resolves)``: the latest definite answer for each DOI, null if there is none."""
    return rows.groupBy(F.lower("doi").alias("doi")).agg(F.max_by("resolves", F.when(F.col("resolves").isNotNull(), F.col("checked_at"))).alias("resolves"))


def enrich(artifact_records: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Records of a snapshot that carry the DOI or an ISBN of a matched work: ``(entry_id, record_id)``."""
    want = artifact_records.select("entry_id", F.explode(F.array_compact(F.array(F.col("ids")["doi"], F.col("ids")["isbn13"]))).alias("k")).distinct()
    have = snapshot.select("record_id", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(F.col("ids")["doi"]), ids.all_isbn13(F.col("ids")))))).alias("k"))
    return want.join(have, "k").select("entry_id", "record_id").distinct()


# ---- alignment of citing sentences --------------------------------------------------------------


def best_abstract(records: DataFrame, entry: str = "entry_id") -> DataFrame:
    """The longest abstract of an entry's records, the first on ties."""
    a = F.trim(F.coalesce("abstract", F.lit("")))
    return records.withColumn("_a", a).filter("_a <> ''").groupBy(entry).agg(F.max_by("_a", F.struct(F.length("_a").alias("l"), (-F.col("ord")).alias("o"))).alias("abstract"))


def align(contexts: DataFrame, entries: DataFrame, abstracts: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """``(entry_id, ordinal, status)`` per citing sentence; without abstract or judgment unverifiable.

    judged(entry_id, ordinal, status, error) carries external rulings; a failed one is unverifiable too.
    """
    rows = contexts.join(entries.select("entry_id", "bib_file", "key"), ["bib_file", "key"]).join(abstracts, "entry_id", "left")
    base = rows.select("entry_id", "ordinal", "text", F.col("abstract").isNotNull().alias("has_abstract"))
    if judged is None:
        return base.withColumn("status", F.lit("unverifiable"))
    j = judged.select("entry_id", "ordinal", F.when(F.col("error").isNull(), F.col("status")).alias("_s"))
    out = base.join(j, ["entry_id", "ordinal"], "left")
    return out.withColumn("status", F.when(F.col("has_abstract"), F.coalesce("_s", F.lit("unverifiable"))).otherwise("unverifiable")).drop("_s")


def alignment_summary(findings: DataFrame) -> DataFrame:
    """Sentences by status per entry, and the number that could not be judged as one figure."""
    return findings.groupBy("entry_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("supported", "contradicted", "not_in_abstract", "unverifiable")]
    )


# ---- caches -------------------------------------------------------------------------------------


def split_cache(queries: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)`` of wanted queries against a cache."""
    return queries.join(cache, keys), queries.join(cache.select(*keys), keys, "left_anti")


def cacheable(results: DataFrame) -> DataFrame:
    """Results worth keeping: successes, the latest per key; failures are asked again."""
    names = [c for c in results.columns if c not in ("entry_hash", "source", "query_kind")]
    ok = results.filter("error is null").groupBy("entry_hash", "source", "query_kind").agg(F.max_by(F.struct(*names), "fetched_at").alias("r"))
    return ok.select("entry_hash", "source", "query_kind", *[F.col("r")[n].alias(n) for n in names])


def valid_verdicts(cache: DataFrame, version: str = PIPELINE_VERSION, model: str = "") -> DataFrame:
    """Cached verdicts made by the same pipeline version and model."""
    return cache.filter((F.col("pipeline_version") == version) & (F.col("model") == model))


def stale_pages(cache: DataFrame) -> DataFrame:
    """Cached live pages fetched before pages were rendered: they are fetched again."""
    return cache.filter((F.col("source") == "web") & ~F.coalesce(F.get_json_object("payload", "$.dead").cast("boolean"), F.lit(False)) & F.get_json_object("payload", "$.render").isNull())


def cleared(cache: DataFrame, sources: list[str] | None = None, before=None) -> DataFrame:
    """The cache without the answers of the given sources (all if None) fetched before a time (any if None)."""
    gone = F.lit(True) if sources is None else F.coalesce(F.col("source").isin(sources), F.lit(False))
    if before is not None:
        gone = gone & F.coalesce(F.col("fetched_at") < F.lit(before), F.lit(True))
    return cache.filter(~gone)


def merge_cache(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


# ---- report -------------------------------------------------------------------------------------


def categories(rows: DataFrame) -> DataFrame:
    """Report category of each entry from (kind, n_issues, n_formatting, n_advisories)."""
    c = (
        F.when(F.col("kind") == "none", "CAPITAL OFFENCES")
        .when(F.col("kind").isNull(), "UNABLE TO VERIFY")
        .when((F.col("n_issues") > 0) | (F.col("kind") == "multiple"), "ISSUES")
        .when((F.col("n_formatting") > 0) | (F.col("n_advisories") > 0), "NITS")
        .otherwise("NO ISSUES")
    )
    return rows.withColumn("category", c)


def report_lines(rows: DataFrame) -> DataFrame:
    """``(category, line)`` of the text report."""
    return rows.select("category", F.format_string("%s [%s]: %s, %d issue(s)", "entry_id", "entry_type", F.coalesce("kind", F.lit("unresolved")), F.col("n_issues")).alias("line"))


def report_json(rows: DataFrame) -> DataFrame:
    """One JSON text per entry."""
    return rows.select("entry_id", F.to_json(F.struct(*[c for c in rows.columns if c != "entry_id"])).alias("json"))


def gate(rows: DataFrame, fail_on: str) -> int:
    """Exit code of a run: 1 if any entry has the given verdict (hallucinated: none; multiple)."""
    kind = {"hallucinated": "none", "multiple": "multiple"}[fail_on]
    return 0 if rows.filter(F.col("kind") == kind).isEmpty() else 1
