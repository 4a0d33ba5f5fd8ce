"""Queries of the training-data problems 2 to 10; every one runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import components, leakage, linkage, markup, names, packing, subjects, survivorship, venues
from citeloom.runtime import cut, table


def p2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accepted pair of an entry and a record with its confidence."""
    return linkage.matches(linkage.scored_pairs(table(spark, sf_dir, "bib_entries"), table(spark, sf_dir, "source_records")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with the records that describe the work it cites."""
    return p2_scored(spark, sf_dir).select("entry_id", "record_id")


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(table_name, row_id, venue)`` of both tables."""
    bib = table(spark, sf_dir, "bib_entries").select(F.lit("bib_entries").alias("table_name"), F.col("entry_id").alias("row_id"), "venue")
    rec = table(spark, sf_dir, "source_records").select(
        F.lit("source_records").alias("table_name"), F.col("record_id").cast("string").alias("row_id"), "venue"
    )
    return bib.union(rec).filter("row_id is not null")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank venue with the listed venue it means, or -1."""
    got = venues.map_values(p3_rows(spark, sf_dir), table(spark, sf_dir, "venue_ref"))
    return got.select("table_name", "row_id", "venue_id").distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of values that mean no listed venue, with the number of rows holding them."""
    got = venues.map_values(p3_rows(spark, sf_dir), table(spark, sf_dir, "venue_ref")).filter("venue_id = -1")
    return got.groupBy("venue").agg(F.countDistinct("table_name", "row_id").alias("n_rows"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record in a group of two or more, with the smallest record_id of the group."""
    return components.record_groups(table(spark, sf_dir, "source_records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose value survives for each group and field with differing values."""
    records = table(spark, sf_dir, "source_records")
    groups = cut(components.record_groups(records), "groups")
    return survivorship.survivors(records, groups).select("group_id", "field", "record_id")


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every author string with the cluster of spellings it belongs to."""
    return names.clusters(names.author_names(table(spark, sf_dir, "bib_entries"), table(spark, sf_dir, "source_records")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two different strings that mean the same author."""
    return names.variant_pairs(p6_clusters(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title, raw field and abstract that holds markup."""
    rows = markup.texts(table(spark, sf_dir, "bib_entries"), table(spark, sf_dir, "source_records"))
    return markup.convert(rows, with_clean=False).filter("has_markup").select("table_name", "row_id", "field").distinct()


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every text that holds markup."""
    rows = markup.texts(table(spark, sf_dir, "bib_entries"), table(spark, sf_dir, "source_records"))
    return markup.convert(rows).filter("has_markup").select("table_name", "row_id", "field", "clean").distinct()


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container."""
    return packing.pack(cut(packing.token_counts(table(spark, sf_dir, "documents")), "sizes"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every container with its pieces, tokens and unused space."""
    return packing.containers(p8_packed(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the items whose passages it contains."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item: documents that leak it and the longest verbatim match in tokens."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("longest").alias("longest"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay after all affected ones are removed."""
    documents = table(spark, sf_dir, "documents")
    leaks = cut(leakage.find_leaks(documents, table(spark, sf_dir, "eval_items")), "leaks")
    return leakage.remove_leaked(documents, leaks).select("doc_id", "source", "doc_kind")


def p10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_mixtures(*(table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subject_areas")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the subject areas it is about."""
    return subjects.assign(p10_mix(spark, sf_dir))


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of the corpus: documents per subject area, and the sum of their shares."""
    mix = p10_mix(spark, sf_dir).filter(F.col("evidence") >= subjects.EVIDENCE)
    return mix.groupBy("subject_id").agg(F.count_if(F.col("share") >= subjects.SHARE).alias("n_docs"), F.round(F.sum("share"), 3).alias("weight"))


QUERIES = {
    "p2_found": p2_found,
    "p2_scored": p2_scored,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_clusters": p6_clusters,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p8_packed": p8_packed,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_kept": p9_kept,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}
_KEY = """CASE WHEN regexp_extract(t, '(?:^|arxiv[.:]|/(?:abs|pdf)/)\\s*(\\d{4}\\.\\d{4,5}|[a-z-]+(?:\\.[a-z]{2})?/\\d{7})(?:v\\d+)?(?:\\.pdf)?[.,;)\\s]*$', 1) <> ''
      THEN 'arxiv:' || regexp_extract(t, '(?:^|arxiv[.:]|/(?:abs|pdf)/)\\s*(\\d{4}\\.\\d{4,5}|[a-z-]+(?:\\.[a-z]{2})?/\\d{7})(?:v\\d+)?(?:\\.pdf)?[.,;)\\s]*$', 1)
    WHEN regexp_extract(t, '(10\\.\\d{4,9}/[-._;()/:a-z0-9]+)', 1) <> '' THEN 'doi:' || regexp_replace(regexp_extract(t, '(10\\.\\d{4,9}/[-._;()/:a-z0-9]+)', 1), '[.,;)]+$', '')
    WHEN regexp_extract(t, '(?:^|openalex\\.[a-z]+/(?:works/)?)(w\\d+)/?$', 1) <> '' THEN 'work:' || regexp_extract(t, '(?:^|openalex\\.[a-z]+/(?:works/)?)(w\\d+)/?$', 1)
    WHEN t <> '' THEN t END"""

_GROUPS = f"""x AS (SELECT record_id, lower(trim(source_native_id)) AS t, true AS held FROM source_records UNION SELECT record_id, lower(trim(openalex_work_id)), true FROM source_records
      UNION SELECT record_id, lower(trim(unnest(version_links))), false FROM source_records),
    said AS (SELECT DISTINCT record_id, {_KEY} AS key, held FROM x),
    holder AS (SELECT key, min(record_id) AS holder FROM said WHERE held AND key IS NOT NULL GROUP BY key),
    e AS (SELECT DISTINCT s.record_id AS a, h.holder AS b FROM said s JOIN holder h ON h.key = s.key WHERE s.record_id <> h.holder),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT DISTINCT a AS n, a AS m FROM both_ways UNION SELECT reach.n, w.b FROM reach JOIN both_ways w ON w.a = reach.m),
    g AS (SELECT n AS record_id, min(m) AS group_id FROM reach GROUP BY n)"""

_EMPTY = ", ".join("'" + p + "'" for p in survivorship.PLACEHOLDERS)


def _rank(field: str) -> str:
    order = survivorship.SOURCE_PRIORITY[field]
    cases = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(order))
    return f"list_min(list_transform(list_concat([source], coalesce(merged_from, [])), lambda s: CASE s {cases} ELSE {len(order)} END))"


SQL: dict[str, str] = {
    "p4_found": f"WITH RECURSIVE {_GROUPS} SELECT record_id, group_id FROM g",
    "p5_found": f"""WITH RECURSIVE {_GROUPS},
    cells AS (SELECT record_id, fetched_at, unnest([{{'field': 'venue', 'value': venue, 'rank': {_rank('venue')}}}, {{'field': 'pages', 'value': pages, 'rank': {_rank('pages')}}},
      {{'field': 'publisher', 'value': publisher, 'rank': {_rank('publisher')}}}], recursive := true) FROM source_records),
    often AS (SELECT field, value, count(*) AS n FROM cells WHERE field <> 'pages' AND lower(trim(value)) NOT IN ({_EMPTY}) GROUP BY ALL),
    cut_off AS (SELECT field, value, EXISTS (SELECT 1 FROM often w WHERE w.field = v.field AND w.n >= v.n AND w.value <> v.value AND starts_with(w.value, v.value) AND length(w.value) > {survivorship.MIN_PREFIX})
      AND length(value) >= {survivorship.MIN_PREFIX} AS cut FROM often v),
    vals AS (SELECT group_id, field, value, min(c.record_id) AS record_id, max({{'trust': -rank, 'fetched_at': fetched_at}}) AS best FROM cells c JOIN g ON g.record_id = c.record_id WHERE trim(value) <> '' GROUP BY ALL),
    graded AS (SELECT vals.*, CASE WHEN lower(trim(vals.value)) IN ({_EMPTY}) THEN -1 WHEN vals.field = 'pages' THEN CASE WHEN regexp_matches(vals.value, '\\w\\s*[-‐–—]+\\s*\\w') THEN 3 ELSE 2 END
      WHEN vals.field = 'venue' AND regexp_matches(vals.value, '{survivorship.REPOSITORY}') THEN 0 WHEN regexp_matches(vals.value, '\\p{{L}}\\.(\\s|$)') THEN 2 WHEN coalesce(cut, false) THEN 1 ELSE 3 END AS quality
      FROM vals LEFT JOIN cut_off USING (field, value)),
    chosen AS (SELECT group_id, field, count(*) AS k, max({{'q': quality, 't': best.trust, 'f': best.fetched_at, 'v': value, 'r': record_id}}) AS b FROM graded GROUP BY ALL)
    SELECT group_id, field, b.r AS record_id FROM chosen WHERE k > 1 AND b.q >= 0""",
}
