"""Queries for the smaller operators, each over whole tables, with DuckDB SQL.

Where the tables hold no input of the needed kind (addresses of book search, features of candidates, evidence of
pages), it is derived from a table's numbers by the same arithmetic on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.functions import similarity as sim
from citeloom.functions import text
from citeloom.operators import adjudicate, books, fields, pool, resolve, score
from citeloom.plans import audit, fuzzy_sql
from citeloom.plans.reference import _CAND, _ISBN, _SURNAMES, _TITLE, _TOKENS, HOST, SQL, E, R, _best, _named_arxiv, query
from citeloom.runtime import cut, table
from citeloom.sources import payloads

_DOI = "lower(rtrim(nullif(regexp_extract({}, '10\\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+', 0, 'i'), ''), '.,;)'))"
_PUBLISHED = "CASE WHEN NOT starts_with({0}, '10.48550/arxiv') THEN {0} END"


# ---- identifiers --------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'Vol_' || p_partkey || '-x' END AS volume FROM part"""
)
def id_volume(spark, d):
    """Volume id of made-up addresses, two thirds of them of the book search."""
    k = F.col("p_partkey")
    host = F.when(k % 3 == 0, "https://books.google.com/books?hl=en&id=").when(k % 3 == 1, "https://play.google.com/books/reader?id=").otherwise("https://books.example/books?id=")
    return table(spark, d, "part").select("p_partkey", ids.volume_id(F.concat(host, F.lit("Vol_"), k, F.lit("-x&pg=1"))).alias("volume"))


@query(
    f"""WITH {E}, f AS (SELECT entry_id, nullif(trim(raw_fields['doi']), '') AS d, nullif(trim(raw_fields['url']), '') AS u, nullif(trim(raw_fields['isbn']), '') AS i FROM e)
    SELECT entry_id, coalesce({_DOI.format('d')}, {_DOI.format('u')}) AS doi, CASE WHEN contains(lower(u), '{HOST}') THEN upper(nullif(regexp_extract(u, '\\bW[0-9]+\\b', 0, 'i'), '')) END AS openalex,
      CASE WHEN CASE WHEN contains(lower(u), '{HOST}') THEN nullif(regexp_extract(u, '\\bW[0-9]+\\b', 0, 'i'), '') END IS NULL THEN u END AS url,
      CASE WHEN regexp_matches(regexp_replace(i, '[\\s-]', '', 'g'), '^97[89][0-9]{{10}}$') THEN regexp_replace(i, '[\\s-]', '', 'g') END AS isbn FROM f"""
)
def id_from_fields(spark, d):
    """Identifiers of every entry from its raw fields."""
    i = ids.from_fields(F.col("raw_fields"), HOST)
    got = audit.load_entries(spark, d).select("entry_id", i.alias("i"), F.element_at("raw_fields", "isbn").alias("given"))
    whole = F.regexp_replace("given", r"[\s-]", "").rlike(r"^97[89][0-9]{10}$")
    return got.select("entry_id", "i.doi", "i.openalex", "i.url", F.when(whole, F.col("i.isbn13")).alias("isbn"))


@query(f"WITH {R} SELECT record_id, array_to_string(list_sort({_ISBN.format('r')}), ' ') AS isbns FROM r")
def id_isbn_sets(spark, d):
    """ISBN sets of records, written with labels and hyphens, each twice, and read again."""
    r = audit.load_records(spark, d).select("record_id", ids.all_isbn13(F.col("ids")).alias("known"))
    given = F.transform("known", lambda x: F.concat(F.lit("isbn "), F.substring(x, 1, 3), F.lit("-"), x.substr(F.lit(4), F.lit(10))))
    return r.select("record_id", F.array_join(F.array_sort(ids.isbn13_set(F.concat(given, given))), " ").alias("isbns"))


@query(
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://direct.mit.edu/books/oa/' || p_partkey WHEN 1 THEN 'https://direct.mit.edu/books' WHEN 2 THEN 'https://journals.sagepub.com/doi/' || p_partkey
        ELSE 'https://press.example/' || p_partkey END AS landing, '10.9999/a.' || p_partkey AS doi FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://direct.mit.edu/Citation/Download?resourceId=' || p_partkey || '&resourceType=3&citationFormat=2'
      WHEN 2 THEN 'https://journals.sagepub.com/action/downloadCitation?doi=' || replace(doi, '/', '%2F') || '&format=bibtex&include=cit' END AS export FROM p"""
)
def id_export(spark, d):
    """Export address of made-up landing pages, by number, by DOI, or none."""
    k = F.col("p_partkey")
    landing = (
        F.when(k % 4 == 0, F.concat(F.lit("https://direct.mit.edu/books/oa/"), k)).when(k % 4 == 1, "https://direct.mit.edu/books")
        .when(k % 4 == 2, F.concat(F.lit("https://journals.sagepub.com/doi/"), k)).otherwise(F.concat(F.lit("https://press.example/"), k))
    )
    return table(spark, d, "part").select("p_partkey", ids.export_url(landing, F.concat(F.lit("10.9999/a."), k)).alias("export"))


_TYPES = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ids.ENTRY_TYPES.items()) + " ELSE 'unknown' END"


@query(f"WITH t AS (SELECT p_partkey, lower(CASE p_partkey % 5 WHEN 0 THEN 'InBook' WHEN 1 THEN 'conference' WHEN 2 THEN 'PhdThesis' WHEN 3 THEN ' online ' ELSE 'Article' END) AS y FROM part), u AS (SELECT p_partkey, trim(y) AS x FROM t) SELECT p_partkey, {_TYPES} AS entry_type FROM u")
def entry_type_map(spark, d):
    """Entry type of bibliography types as people write them."""
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "InBook").when(k == 1, "conference").when(k == 2, "PhdThesis").when(k == 3, " online ").otherwise("Article")
    return table(spark, d, "part").select("p_partkey", ids.entry_type(raw).alias("entry_type"))


@query(
    f"""WITH {E} SELECT entry_id, coalesce({" OR ".join(f"contains(lower(venue), '{v}')" for v in ids.NO_DOI_VENUES)}, false) AS no_doi,
      coalesce(ids.arxiv_id, CASE WHEN starts_with(ids.doi, '{ids.PREPRINT_DOI}') THEN {_named_arxiv('ids.doi')} END) AS arxiv FROM e"""
)
def id_entry_hints(spark, d):
    """Whether an entry's venue mints no DOI, and the preprint it cites."""
    return audit.load_entries(spark, d).select("entry_id", ids.venue_needs_no_doi(F.col("venue")).alias("no_doi"), ids.cited_arxiv_id(F.col("ids")).alias("arxiv"))


@query(
    f"""WITH {R}, k AS (SELECT record_id, list_filter([CASE WHEN NOT starts_with(ids.doi, '10.48550/arxiv') THEN 'doi:' || lower(ids.doi) END,
        'arxiv:' || lower(coalesce(ids.arxiv_id, {_named_arxiv('ids.doi')})), 'isbn:' || lower(ids.isbn13), 'oa:' || lower(coalesce(nullif(regexp_extract(openalex_work_id, '(?i)W[0-9]+', 0), ''), ids.openalex))], lambda x: x IS NOT NULL) AS own,
      coalesce(list_distinct(flatten(list_transform(version_links, lambda x: list_filter(['doi:' || {_PUBLISHED.format(_DOI.format('x'))}, 'arxiv:' || lower({_named_arxiv('x')})], lambda y: y IS NOT NULL)))), []) AS named FROM r)
    SELECT record_id, array_to_string(list_sort(own), ' ') AS own, array_to_string(list_sort(named), ' ') AS named FROM k"""
)
def id_record_keys(spark, d):
    """Own keys and linked keys of every record, sorted."""
    r = audit.load_records(spark, d)
    own, named = ids.own_keys(F.col("ids"), F.col("openalex_work_id")), ids.link_keys(F.col("version_links"))
    return r.select("record_id", F.array_join(F.array_sort(own), " ").alias("own"), F.array_join(F.array_sort(named), " ").alias("named"))


# ---- strings ------------------------------------------------------------------------------------

_FOLDED = "trim(regexp_replace(translate(strip_accents(replace(replace(replace(lower(translate(coalesce({}, ''), '{{}}', '')), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')), 'øłđı', 'oldi'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH {E} SELECT entry_id, {_FOLDED.format('publisher')} AS publisher, {_FOLDED.format('venue')} AS venue FROM e")
def text_fold(spark, d):
    """Comparable form of publisher and venue of every entry."""
    return audit.load_entries(spark, d).select("entry_id", text.fold(F.col("publisher")).alias("publisher"), text.fold(F.col("venue")).alias("venue"))


_CLEANED = "trim(regexp_replace(translate({}, '{{}}', ''), '\\s+', ' ', 'g'))"


@query(
    f"""WITH {E}, a AS (SELECT entry_id, list_filter(list_transform(regexp_split_to_array(coalesce(raw_fields['author'], ''), '\\s+and\\s+'), lambda x: {_CLEANED.format('x')}), lambda x: x <> '') AS n FROM e)
    SELECT entry_id, len(n) AS n_authors, array_to_string(n, ' | ') AS authors FROM a"""
)
def text_authors(spark, d):
    """Authors of every entry's raw field, split and cleaned."""
    names = text.split_authors(F.element_at("raw_fields", "author"))
    return audit.load_entries(spark, d).select("entry_id", F.size(names).cast("bigint").alias("n_authors"), F.array_join(names, " | ").alias("authors"))


@query(f"WITH {R}, v AS (SELECT record_id, trim(coalesce(volume, '')) AS v, trim(coalesce(issue, '')) AS i FROM r) SELECT record_id, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN regexp_replace(v, '^0+([0-9])', '\\1') ELSE {_FOLDED.format('v')} END AS volume, CASE WHEN regexp_matches(i, '^[0-9]+$') THEN regexp_replace(i, '^0+([0-9])', '\\1') ELSE {_FOLDED.format('i')} END AS issue FROM v")
def text_numbers(spark, d):
    """Volume and issue of every record without leading zeros."""
    return audit.load_records(spark, d).select("record_id", text.number(F.col("volume")).alias("volume"), text.number(F.col("issue")).alias("issue"))


# ---- payloads -----------------------------------------------------------------------------------


def _written(spark, d):
    """One row per record with the fields that payloads of any kind are written from."""
    return audit.load_records(spark, d).select("record_id", text.collapse(F.col("title")).alias("title"), "authors", "year", F.trim(F.coalesce("publisher", F.lit(""))).alias("publisher"), "ids", "version_links", "edition")


@query(f"WITH {R} SELECT record_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS text FROM r")
def payload_abstract(spark, d):
    """Titles written as inverted index and read again."""
    w = _written(spark, d).select("record_id", F.posexplode(F.split("title", " ")).alias("i", "w"))
    index = w.groupBy("record_id", "w").agg(F.sort_array(F.collect_list("i")).alias("at")).groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("m"))
    raw = F.to_json(F.struct(F.col("m").alias("abstract_inverted_index")))
    return index.select("record_id", payloads.inverted_abstract(raw).alias("text"))


@query(f"WITH {R} SELECT record_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) || ': a view' AS title, len(authors) AS n_authors, year, trim(coalesce(publisher, '')) AS publisher, ids.isbn13 AS isbn13 FROM r WHERE ids.isbn13 IS NOT NULL")
def payload_volumes(spark, d):
    """Book records written as volumes of the book search and read again."""
    r = _written(spark, d).filter("ids.isbn13 is not null")
    info = F.struct(
        "title", F.lit("a view").alias("subtitle"), F.transform("authors", lambda a: F.coalesce(F.nullif(F.trim(a), F.lit("")), F.lit("-"))).alias("authors"), F.concat(F.col("year").cast("string"), F.lit("-05-01")).alias("publishedDate"),
        "publisher", F.array(F.struct(F.lit("OTHER").alias("type"), F.lit("x").alias("identifier")), F.struct(F.lit("ISBN_13").alias("type"), F.col("ids.isbn13").alias("identifier"))).alias("industryIdentifiers"),
    )
    rec = r.select("record_id", payloads.google_books(F.to_json(F.struct(F.col("record_id").cast("string").alias("id"), info.alias("volumeInfo")))).alias("v"))
    return rec.select("record_id", "v.title", F.size("v.authors").cast("bigint").alias("n_authors"), "v.year", "v.publisher", "v.isbn13")


@query(f"WITH {R} SELECT record_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, year, trim(coalesce(publisher, '')) AS publisher FROM r")
def payload_editions(spark, d):
    """Records written as editions of a work and read again; a missing title is the work's."""
    r = _written(spark, d)
    own = F.when(F.col("record_id") % 2 == 0, F.col("title"))
    raw = F.to_json(F.struct(own.alias("title"), F.concat(F.lit("May "), F.col("year").cast("string")).alias("publish_date"), F.array("publisher").alias("publishers")))
    return r.select("record_id", payloads.openlibrary_edition(raw, F.col("title")).alias("v")).select("record_id", "v.title", "v.year", "v.publisher")


@query(f"WITH {R} SELECT record_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, year, '2101.' || lpad(CAST(record_id % 100000 AS VARCHAR), 5, '0') AS arxiv_id, true AS is_preprint FROM r WHERE year BETWEEN 1000 AND 9999 AND trim(title) <> ''")
def payload_atom(spark, d):
    """Records written as entries of the preprint server's feed and read again; entries without a title are left out."""
    safe = F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    ident = F.concat(F.lit("2101."), F.lpad((F.col("record_id") % 100000).cast("string"), 5, "0"))
    xml = F.concat(
        F.lit('<entry xmlns="http://www.w3.org/2005/Atom"><id>http://arxiv.org/abs/'), ident, F.lit("v3</id><title>\n "), safe, F.lit(" </title><published>"), F.col("year").cast("string"), F.lit("-01-02T00:00:00Z</published><summary>s</summary></entry>"),
    )
    feeds = _written(spark, d).filter("year between 1000 and 9999").select("record_id", xml.alias("entry"))
    return payloads.arxiv_records(feeds).select("record_id", "rec.title", "rec.year", "rec.arxiv_id", "rec.is_preprint")


@query(f"WITH {R}, l AS (SELECT record_id, list_filter(list_transform(coalesce(version_links, []), lambda x: trim(x)), lambda x: x <> '') AS v FROM r) SELECT record_id, array_to_string(list_sort(v), ' ') AS links, len(v) AS n FROM l")
def payload_links(spark, d):
    """Version links written as relations of the registrant and as locations of the catalogue, and read again."""
    r = _written(spark, d).withColumn("v", F.filter(F.coalesce("version_links", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    rel = F.to_json(F.struct(F.create_map(F.lit(payloads.VERSION_RELATIONS[0]), F.transform("v", lambda x: F.struct(x.alias("id")))).alias("relation")))
    loc = F.to_json(F.struct(F.transform("v", lambda x: F.struct(x.alias("landing_page_url"))).alias("locations")))
    same = r.select("record_id", payloads.crossref_links(rel).alias("a"), payloads.openalex_links(loc).alias("b"))
    return same.select("record_id", F.array_join(F.array_sort("a"), " ").alias("links"), F.size("b").cast("bigint").alias("n"))


# ---- decisions on given figures -----------------------------------------------------------------

_FIG = """f AS (SELECT l_orderkey, l_linenumber, 1 - l_discount * 3 AS title_ratio, (l_quantity * 2) / 100.0 AS author_overlap, l_tax * 12 AS author_set_jaccard, l_linenumber % 5 = 0 AS author_subset,
    CASE l_suppkey % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'absent' ELSE 'conflict' END AS id_agreement, l_partkey % 7 = 0 AS prefix_trap, l_partkey % 5 = 0 AS pages_conflict, l_partkey % 2 = 0 AS has_id FROM lineitem),
    c AS (SELECT *, title_ratio * author_overlap AS composite FROM f)"""
_OK = f"(author_overlap >= {sim.AUTHOR_ACCEPT} OR author_subset)"
_FORCED = f"(prefix_trap OR (pages_conflict AND NOT (title_ratio >= {sim.TITLE_BACKFILL} AND {_OK})) OR (author_set_jaccard < {sim.AUTHOR_DISTINCT} AND NOT author_subset))"
_BUCKET = f"""CASE WHEN id_agreement = 'match' AND title_ratio >= {sim.TITLE_ACCEPT} AND {_OK} AND NOT {_FORCED} THEN 'auto_accept'
    WHEN NOT has_id AND id_agreement <> 'conflict' AND title_ratio >= {sim.TITLE_BACKFILL} AND author_overlap >= {sim.AUTHOR_ACCEPT} AND NOT {_FORCED} THEN 'auto_accept'
    WHEN id_agreement <> 'match' AND composite < {sim.COMPOSITE_REJECT} THEN 'auto_reject' ELSE 'adjudicate' END"""


def _figures(spark, d):
    """Candidates with features from the numbers of line items."""
    i = table(spark, d, "lineitem")
    k = lambda c, n: F.col(c) % n == 0
    rows = i.select(
        "l_orderkey", "l_linenumber", (1 - F.col("l_discount") * 3).alias("title_ratio"), (F.col("l_quantity") * 2 / 100.0).alias("author_overlap"), (F.col("l_tax") * 12).alias("author_set_jaccard"), k("l_linenumber", 5).alias("author_subset"),
        F.when(k("l_suppkey", 3), "match").when(F.col("l_suppkey") % 3 == 1, "absent").otherwise("conflict").alias("id_agreement"), k("l_partkey", 7).alias("prefix_trap"), k("l_partkey", 5).alias("pages_conflict"), k("l_partkey", 2).alias("has_id"),
    )
    rows = rows.withColumn("composite", F.col("title_ratio") * F.col("author_overlap"))
    return rows.withColumn("bucket", score.bucket(F.col("has_id")))


@query(f"WITH {_FIG} SELECT l_orderkey, l_linenumber, {_BUCKET} AS bucket FROM c")
def decide_buckets(spark, d):
    """Bucket of every candidate from its features."""
    return _figures(spark, d).select("l_orderkey", "l_linenumber", "bucket")


@query(f"WITH {_FIG}, b AS (SELECT *, {_BUCKET} AS bucket FROM c), n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY composite DESC, l_linenumber) AS rank FROM b WHERE bucket = 'adjudicate') SELECT l_orderkey, l_linenumber, CAST(rank AS INT) AS rank FROM n WHERE rank <= 2")
def decide_top(spark, d):
    """The two best unsure candidates of every order."""
    rows = _figures(spark, d).select(F.col("l_orderkey").alias("entry_id"), F.col("l_linenumber").alias("ord"), "composite", "bucket")
    return score.top_candidates(rows, k=2).select(F.col("entry_id").alias("l_orderkey"), F.col("ord").alias("l_linenumber"), "rank")


_RULED = f"""{_FIG}, b AS (SELECT *, {_BUCKET} AS bucket FROM c), u AS (SELECT l_orderkey, l_linenumber, CASE WHEN bucket = 'adjudicate' AND l_linenumber % 3 < 2
    THEN CASE WHEN l_linenumber % 2 = 0 THEN 'auto_accept' ELSE 'auto_reject' END ELSE bucket END AS bucket FROM b)"""


def _ruled(spark, d):
    rows = _figures(spark, d).select(F.col("l_orderkey").alias("entry_id"), F.col("l_linenumber").alias("ord"), "bucket")
    sure = F.when(F.col("ord") % 3 == 0, "high").when(F.col("ord") % 3 == 1, "medium").otherwise("low")
    rulings = rows.select("entry_id", "ord").distinct().select("entry_id", "ord", (F.col("ord") % 2 == 0).alias("answer"), sure.alias("confidence"), F.lit(None).cast("string").alias("error"))
    return resolve.apply_rulings(rows, rulings)


@query(f"WITH {_RULED} SELECT l_orderkey, l_linenumber, bucket FROM u")
def decide_rulings(spark, d):
    """Buckets after rulings; an unsure ruling changes nothing."""
    return _ruled(spark, d).select(F.col("entry_id").alias("l_orderkey"), F.col("ord").alias("l_linenumber"), "bucket")


@query(
    f"""WITH {_RULED}, g AS (SELECT l_orderkey, count(*) FILTER (bucket = 'auto_accept') AS n, bool_and(bucket = 'auto_reject') AS rejected FROM u GROUP BY l_orderkey),
    o AS (SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(rejected, false) AS rejected, n IS NULL AS no_candidates, o_orderkey % 11 = 0 AS errored FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)
    SELECT o_orderkey, CASE WHEN n = 1 THEN 'exactly_one' WHEN n > 1 THEN 'multiple' WHEN errored THEN NULL WHEN no_candidates OR rejected THEN 'none' END AS kind,
      CASE WHEN n = 1 THEN 'high' WHEN n > 1 THEN 'medium' WHEN errored THEN NULL WHEN no_candidates THEN 'high' WHEN rejected THEN 'medium' END AS confidence FROM o"""
)
def decide_verdicts(spark, d):
    """Verdict of every order from its ruled candidates, each accepted one a work of its own."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("entry_id"))
    ruled = cut(_ruled(spark, d), "ruled")
    arts = ruled.filter("bucket = 'auto_accept'").select(F.col("entry_id").alias("entry"))
    failed = orders.filter("entry_id % 11 = 0").withColumn("errored", F.lit(True))
    return score.verdicts(orders, ruled, arts, failed).select(F.col("entry_id").alias("o_orderkey"), "kind", "confidence")


_PAGE = """p AS (SELECT p_partkey, p_partkey % 7 = 0 AS failed, p_partkey % 11 = 0 AS dead, p_partkey % 13 = 0 AS empty, (p_partkey % 100) / 100.0 AS ratio, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 2 = 0 END AS ruling,
    CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM part),
    w AS (SELECT p_partkey, CASE WHEN failed OR dead OR empty THEN NULL WHEN ratio >= 0.85 THEN 'exactly_one' WHEN ruling AND confidence IN ('high', 'medium') THEN 'exactly_one' WHEN NOT ruling AND confidence = 'high' THEN 'none' END AS web FROM p)"""


def _pages(spark, d):
    k = F.col("p_partkey")
    sure = F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").otherwise("low")
    page = F.struct(
        F.when(k % 7 == 0, "down").alias("error"), (k % 11 == 0).alias("dead"), (k % 13 == 0).alias("rendered_empty"), ((k % 100) / 100.0).alias("title_ratio"), F.when(k % 3 > 0, k % 2 == 0).alias("ruling"), sure.alias("confidence"),
    )
    return table(spark, d, "part").select(k.alias("entry_id"), resolve.web_verdict(page).alias("web"), F.col("p_name").alias("title"), F.concat(F.lit("https://page.example/"), k).alias("url"))


@query(f"WITH {_PAGE} SELECT p_partkey, web FROM w")
def web_verdicts(spark, d):
    """Verdict of cited pages from their evidence."""
    return _pages(spark, d).select(F.col("entry_id").alias("p_partkey"), "web")


@query(f"WITH {_PAGE} SELECT w.p_partkey, web AS kind, 1 AS n_artifacts, 'web' AS source, p_name AS title, 'https://page.example/' || w.p_partkey AS url FROM w JOIN part USING (p_partkey) WHERE web = 'exactly_one'")
def web_artifacts(spark, d):
    """Confirmed pages as the one artifact of their entry."""
    return resolve.page_artifacts(_pages(spark, d)).withColumnRenamed("entry_id", "p_partkey")


@query(
    f"""WITH {_PAGE}, r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'multiple' WHEN 2 THEN 'exactly_one' END AS generic, p_partkey % 2 = 0 AS web_only, web, p_partkey % 17 = 0 AS wp, p_partkey % 19 = 0 AS vp,
      p_partkey % 6 = 0 AS em, p_partkey % 10 = 5 AS ee FROM w),
    s AS (SELECT *, CASE WHEN wp OR vp THEN 'exactly_one' WHEN web_only AND coalesce(generic, 'none') = 'none' THEN web ELSE generic END AS second FROM r)
    SELECT p_partkey, CASE WHEN em THEN 'exactly_one' WHEN ee AND second = 'none' THEN NULL ELSE second END AS kind FROM s"""
)
def override_rules(spark, d):
    """Final verdict from generic, web, pinned and book evidence."""
    k = F.col("entry_id")
    generic = F.when(k % 5 == 0, "none").when(k % 5 == 1, "multiple").when(k % 5 == 2, "exactly_one")
    rows = _pages(spark, d).select(
        "entry_id", generic.alias("generic"), (k % 2 == 0).alias("web_only"), "web", (k % 17 == 0).alias("work_pin"), (k % 19 == 0).alias("volume_pin"), (k % 6 == 0).alias("edition_matched"), (k % 10 == 5).alias("edition_errored"),
    )
    return resolve.override(rows).withColumnRenamed("entry_id", "p_partkey")


@query(
    """WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'multiple' WHEN 2 THEN 'exactly_one' END AS kind, p_size % 3 AS n_issues, p_size % 5 AS n_formatting, p_size % 7 AS n_advisories FROM part)
    SELECT p_partkey, CASE WHEN kind = 'none' THEN 'CAPITAL OFFENCES' WHEN kind IS NULL THEN 'UNABLE TO VERIFY' WHEN n_issues > 0 OR kind = 'multiple' THEN 'ISSUES' WHEN n_formatting > 0 OR n_advisories > 0 THEN 'NITS' ELSE 'NO ISSUES' END AS category FROM c"""
)
def report_categories(spark, d):
    """Report category from verdict, issues, nits and advisories."""
    k, z = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 4 == 0, "none").when(k % 4 == 1, "multiple").when(k % 4 == 2, "exactly_one")
    rows = table(spark, d, "part").select("p_partkey", kind.alias("kind"), (z % 3).alias("n_issues"), (z % 5).alias("n_formatting"), (z % 7).alias("n_advisories"))
    return resolve.categories(rows).select("p_partkey", "category")


# ---- candidates of entries ----------------------------------------------------------------------

_EDGES = f"""{_CAND}, q AS (SELECT entry_id, ord, list_filter([CASE WHEN NOT starts_with(ids.doi, '10.48550/arxiv') THEN 'doi:' || lower(ids.doi) END, 'arxiv:' || lower(coalesce(ids.arxiv_id, {_named_arxiv('ids.doi')})),
        'isbn:' || lower(ids.isbn13), 'oa:' || lower(coalesce(nullif(regexp_extract(openalex_work_id, '(?i)W[0-9]+', 0), ''), ids.openalex))], lambda x: x IS NOT NULL) AS own,
      coalesce(list_distinct(flatten(list_transform(version_links, lambda x: list_filter(['doi:' || {_PUBLISHED.format(_DOI.format('x'))}, 'arxiv:' || lower({_named_arxiv('x')})], lambda y: y IS NOT NULL)))), []) AS named FROM k),
    own AS (SELECT entry_id, ord, unnest(own) AS key FROM q WHERE len(own) > 0), said AS (SELECT * FROM own UNION SELECT entry_id, ord, unnest(named) FROM q WHERE len(own) > 0),
    holder AS (SELECT entry_id, key, min(ord) AS a FROM own GROUP BY ALL),
    edge AS (SELECT DISTINCT s.entry_id, h.a, s.ord AS b FROM said s JOIN holder h ON h.entry_id = s.entry_id AND h.key = s.key WHERE s.ord <> h.a),
    ways AS (SELECT * FROM edge UNION SELECT entry_id, b, a FROM edge)"""


@query(f"WITH {_EDGES} SELECT entry_id AS entry, a, b FROM edge")
def pool_id_edges(spark, d):
    """Records of an entry that share an identifier, as stars."""
    return pool.id_edges(cut(audit.candidates(spark, d), "candidates"))


@query(
    f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT DISTINCT entry_id, ord AS n, ord AS m FROM k UNION SELECT r.entry_id, r.n, w.b FROM reach r JOIN ways w ON w.entry_id = r.entry_id AND w.a = r.m)
    SELECT entry_id AS entry, n AS ord, min(m) AS comp FROM reach GROUP BY entry_id, n"""
)
def pool_id_components(spark, d):
    """Components of the candidates of every entry over shared identifiers alone."""
    r = cut(audit.candidates(spark, d), "candidates")
    return pool.components(r.select(F.col("entry_id").alias("entry"), "ord"), pool.id_edges(r))


@query(
    f"""WITH {E}, {R}, want AS (SELECT DISTINCT entry_id, unnest(list_filter([ids.doi, ids.isbn13], lambda x: x IS NOT NULL)) AS k FROM e),
    have AS (SELECT record_id, unnest(list_distinct(list_filter(list_concat([ids.doi], {_ISBN.format('r')}), lambda x: x IS NOT NULL))) AS k FROM r)
    SELECT DISTINCT want.entry_id, have.record_id FROM want JOIN have USING (k)"""
)
def enriched(spark, d):
    """Records of all sources that carry an entry's DOI or ISBN, whatever they were fetched for."""
    return resolve.enrich(audit.load_entries(spark, d).select("entry_id", "ids"), audit.load_records(spark, d).select("record_id", "ids"))


@query(
    f"""WITH {_CAND}, {E}, x AS (SELECT entry_id, first(has) AS has FROM (SELECT entry_id, true AS has FROM k WHERE trim(coalesce(abstract, '')) <> '') GROUP BY entry_id),
    c AS (SELECT DISTINCT bib_file, key, ordinal, text FROM contexts)
    SELECT x.has IS NOT NULL AS has_abstract, 'unverifiable' AS status, count(*) AS n FROM c JOIN e ON e.bib_file = c.bib_file AND e.key = c.key LEFT JOIN x ON x.entry_id = e.entry_id GROUP BY ALL"""
)
def alignment(spark, d):
    """Citing sentences by what can be said of them without a judge."""
    rows = table(spark, d, "contexts").select("bib_file", "key", "ordinal", "text").distinct()
    found = resolve.align(rows, audit.load_entries(spark, d), resolve.best_abstract(audit.candidates(spark, d)))
    return found.groupBy("has_abstract", "status").agg(F.count("*").alias("n"))


_JUDGED = "CASE WHEN c.ordinal % 3 = 0 THEN 'supported' WHEN c.ordinal % 3 = 1 THEN 'contradicted' ELSE 'not_in_abstract' END"


@query(
    f"""WITH {_CAND}, {E}, x AS (SELECT DISTINCT entry_id FROM k WHERE trim(coalesce(abstract, '')) <> ''), c AS (SELECT DISTINCT bib_file, key, ordinal, text FROM contexts),
    s AS (SELECT e.entry_id, CASE WHEN x.entry_id IS NOT NULL AND c.ordinal < 5 THEN {_JUDGED} ELSE 'unverifiable' END AS status FROM c JOIN e ON e.bib_file = c.bib_file AND e.key = c.key LEFT JOIN x ON x.entry_id = e.entry_id)
    SELECT entry_id, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'contradicted') AS contradicted, count(*) FILTER (status = 'not_in_abstract') AS not_in_abstract,
      count(*) FILTER (status = 'unverifiable') AS unverifiable FROM s GROUP BY entry_id"""
)
def alignment_figures(spark, d):
    """Citing sentences by status per entry, with made-up rulings of which those beyond the fifth failed."""
    rows = table(spark, d, "contexts").select("bib_file", "key", "ordinal", "text").distinct()
    e = audit.load_entries(spark, d)
    o = F.col("ordinal") % 3
    judged = rows.join(e.select("entry_id", "bib_file", "key"), ["bib_file", "key"]).select("entry_id", "ordinal").distinct()
    judged = judged.withColumn("status", F.when(o == 0, "supported").when(o == 1, "contradicted").otherwise("not_in_abstract")).withColumn("error", F.when(F.col("ordinal") >= 5, "down"))
    return resolve.alignment_summary(resolve.align(rows, e, resolve.best_abstract(audit.candidates(spark, d)), judged))


# ---- field checks -------------------------------------------------------------------------------

_RANKS = "CASE source WHEN 'publisher' THEN 0 WHEN 'crossref' THEN 1 WHEN 'openalex' THEN 2 WHEN 'openlibrary' THEN 3 WHEN 'semantic_scholar' THEN 4 WHEN 'arxiv' THEN 5 ELSE 9 END"
_CANONICAL = f"""cc AS (SELECT entry_id, {{'p': coalesce(is_preprint, false), 'k': {_RANKS}, 'o': ord}} AS o,
      unnest([{{'field': 'title', 'value': title}}, {{'field': 'venue', 'value': venue}}, {{'field': 'year', 'value': CAST(year AS VARCHAR)}}, {{'field': 'volume', 'value': volume}},
        {{'field': 'number', 'value': issue}}, {{'field': 'pages', 'value': pages}}, {{'field': 'publisher', 'value': publisher}}], recursive := true) FROM k),
    canon AS (SELECT entry_id, field, arg_min(trim(value), o) AS canonical_value FROM cc WHERE trim(coalesce(value, '')) <> '' GROUP BY entry_id, field)"""
_PG = "lower(regexp_replace(trim(coalesce({}, '')), '" + text.DASHES + "', '-', 'g'))"
_NUM = "CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN regexp_replace({0}, '^0+([0-9])', '\\1') ELSE {1} END"
_PLAIN = "CASE WHEN trim(c) = '' THEN 'unverifiable' WHEN b = c THEN 'ok' WHEN fb = fc THEN 'formatting' ELSE 'needs_llm' END"
_SUBMITTED = f"(SELECT CASE WHEN regexp_matches(z, '{ids.NEW_FORM}') THEN 2000 + CAST(substr(z, 1, 2) AS INT) END FROM (SELECT regexp_replace(trim(coalesce(e.ids.arxiv_id, CASE WHEN starts_with(e.ids.doi, '{ids.PREPRINT_DOI}') THEN {_named_arxiv('e.ids.doi')} END)), 'v[0-9]+$', '') AS z))"
_FINDINGS = f"""{_CAND}, {E}, {_CANONICAL},
    cell AS (SELECT e.entry_id, e.entry_type IN ('book', 'incollection') AS is_book, {_SUBMITTED} AS submitted, unnest([
      {{'pos': 0, 'field': 'title', 'bib_value': nullif(trim(title), '')}}, {{'pos': 1, 'field': 'venue', 'bib_value': nullif(trim(venue), '')}}, {{'pos': 2, 'field': 'year', 'bib_value': CAST(year AS VARCHAR)}},
      {{'pos': 3, 'field': 'volume', 'bib_value': raw_fields['volume']}}, {{'pos': 4, 'field': 'number', 'bib_value': coalesce(raw_fields['number'], raw_fields['issue'])}},
      {{'pos': 5, 'field': 'pages', 'bib_value': coalesce(nullif(trim(pages), ''), nullif(trim(raw_fields['pages']), ''))}}, {{'pos': 6, 'field': 'publisher', 'bib_value': nullif(trim(publisher), '')}}], recursive := true) FROM e),
    both_ AS (SELECT cell.*, canonical_value, bib_value AS b, coalesce(canonical_value, '') AS c FROM cell LEFT JOIN canon USING (entry_id, field) WHERE bib_value IS NOT NULL),
    form AS (SELECT *, {_FOLDED.format('b')} AS fb, {_FOLDED.format('c')} AS fc, {_PG.format('b')} AS pb, {_PG.format('c')} AS pc, {_CLEANED.format('b')} AS db, {_CLEANED.format('c')} AS dc,
      TRY_CAST(nullif(regexp_extract(b, '[0-9]{{4}}', 0), '') AS INT) AS yb, TRY_CAST(nullif(regexp_extract(c, '[0-9]{{4}}', 0), '') AS INT) AS yc FROM both_),
    finding AS (SELECT entry_id, CAST(pos AS INT) AS pos, field, bib_value, canonical_value, CASE
      WHEN field = 'title' THEN CASE WHEN trim(c) = '' THEN 'unverifiable' WHEN fb = fc THEN 'ok' ELSE 'needs_llm' END
      WHEN field = 'venue' THEN CASE WHEN coalesce(regexp_matches(c, '{text.REPOSITORY}'), false) THEN 'unverifiable' ELSE {_PLAIN} END
      WHEN field IN ('volume', 'number') THEN CASE WHEN lower(db) IN ({", ".join("'" + p + "'" for p in text.PLACEHOLDERS)}) THEN 'error' WHEN trim(c) = '' THEN 'unverifiable'
        WHEN {_NUM.format('db', 'fb')} <> {_NUM.format('dc', 'fc')} THEN 'error' ELSE 'ok' END
      WHEN field = 'year' THEN CASE WHEN yc IS NULL OR yb IS NULL THEN 'unverifiable' WHEN yb = yc THEN 'ok' WHEN yc > yb AND yb = submitted THEN 'ok' WHEN is_book OR abs(yb - yc) = 1 THEN 'uncertain' ELSE 'error' END
      WHEN field = 'pages' THEN CASE WHEN trim(c) = '' THEN 'unverifiable' WHEN pb <> pc THEN 'error' WHEN contains(pb, '-') AND NOT (regexp_matches(b, '\\w--\\w') AND NOT regexp_matches(b, '[–—]')) THEN 'formatting' ELSE 'ok' END
      ELSE CASE WHEN is_book AND ({_PLAIN}) = 'needs_llm' AND (contains(fb, fc) OR contains(fc, fb)) THEN 'formatting' ELSE {_PLAIN} END END AS status FROM form)"""


def _findings(spark, d):
    return fields.field_findings(audit.load_entries(spark, d), fields.canonical_values(audit.candidates(spark, d)))


@query(f"WITH {_FINDINGS} SELECT * FROM finding")
def field_findings(spark, d):
    """Status of every cited field against the canonical value."""
    return _findings(spark, d).select("entry_id", "pos", "field", "bib_value", "canonical_value", "status")


@query(f"WITH {_FINDINGS} SELECT field, CASE status WHEN 'needs_llm' THEN 'uncertain' ELSE status END AS status, count(*) AS n FROM finding GROUP BY ALL")
def field_status_counts(spark, d):
    """Findings by field and status once nothing is left to be asked."""
    return fields.status_counts(fields.apply_judgments(_findings(spark, d)))


@query(
    f"""WITH {_FINDINGS}, j AS (SELECT *, CASE length(bib_value) % 3 WHEN 0 THEN 'variant' WHEN 1 THEN 'error' ELSE 'uncertain' END AS kind, CASE length(bib_value) % 2 WHEN 0 THEN 'medium' ELSE 'low' END AS confidence FROM finding)
    SELECT entry_id, field, CASE WHEN status <> 'needs_llm' THEN status WHEN kind = 'variant' THEN 'formatting' WHEN kind = 'error' AND confidence = 'medium' THEN 'error' ELSE 'uncertain' END AS status, status = 'needs_llm' AS via_llm FROM j"""
)
def field_judged(spark, d):
    """Field findings after made-up rulings: only confident errors count as errors."""
    found = cut(_findings(spark, d), "findings")
    n = F.length("bib_value")
    j = found.filter("status = 'needs_llm'").select(
        "entry_id", "field", F.when(n % 3 == 0, "variant").when(n % 3 == 1, "error").otherwise("uncertain").alias("kind"), F.when(n % 2 == 0, "medium").otherwise("low").alias("confidence"),
    )
    return fields.apply_judgments(found, j).select("entry_id", "field", "status", "via_llm")


@query(f"WITH {_FINDINGS} SELECT entry_id, string_agg(field, ', ' ORDER BY pos) AS fields FROM finding WHERE status = 'unverifiable' GROUP BY entry_id")
def field_unverifiable(spark, d):
    """Fields of every entry about which nothing can be said."""
    return fields.unverifiable_line(_findings(spark, d))


@query(f"WITH {_FINDINGS} SELECT entry_id, arg_min(field, pos) AS field, min(pos) AS pos FROM finding WHERE status = 'error' GROUP BY entry_id")
def field_first_error(spark, d):
    """First field of every entry that is in error."""
    return fields.first_finding(_findings(spark, d)).select("entry_id", "field", "pos")


# ---- books --------------------------------------------------------------------------------------

_BOOKS = f"""{_CAND}, {E}, bk AS (SELECT *, coalesce(ids.isbn13, nullif(source_native_id, ''), concat_ws('|', CAST(year AS VARCHAR), publisher)) AS kk FROM k WHERE source IN ('openlibrary', 'google_books')),
    ed AS (SELECT * FROM bk QUALIFY row_number() OVER (PARTITION BY entry_id, kk ORDER BY ord) = 1), book AS (SELECT * FROM e WHERE entry_type IN ('book', 'incollection')),
    m AS (SELECT book.entry_id, ed.ord, CASE WHEN len(list_intersect({_ISBN.format('book')}, {_ISBN.format('ed')})) > 0 THEN 0 WHEN book.year = ed.year AND {_TOKENS.format('book.publisher')} <> '' AND {_TOKENS.format('ed.publisher')} <> ''
        AND (contains({_TOKENS.format('book.publisher')}, {_TOKENS.format('ed.publisher')}) OR contains({_TOKENS.format('ed.publisher')}, {_TOKENS.format('book.publisher')})) THEN 1 WHEN book.year = ed.year THEN 2 END AS priority
      FROM book JOIN ed ON ed.entry_id = book.entry_id),
    direct AS (SELECT entry_id, arg_min(ord, {{'p': priority, 'o': ord}}) AS ord FROM m WHERE priority IS NOT NULL GROUP BY entry_id),
    bi AS (SELECT book.entry_id, arg_min(k.ids.isbn13, k.ord) AS isbn13 FROM book JOIN k ON k.entry_id = book.entry_id WHERE book.ids.isbn13 IS NULL AND k.ids.isbn13 IS NOT NULL
      AND (coalesce({_PUBLISHED.format('book.ids.doi')} = {_PUBLISHED.format('k.ids.doi')}, false) OR k.source = 'openlibrary') GROUP BY book.entry_id),
    again AS (SELECT bi.entry_id, min(ed.ord) AS ord FROM bi JOIN (SELECT entry_id, ord, unnest({_ISBN.format('ed')}) AS i FROM ed) ed ON ed.entry_id = bi.entry_id AND ed.i = bi.isbn13 GROUP BY bi.entry_id),
    er AS (SELECT entry_hash, bool_or(error IS NOT NULL) AS errored FROM source_results GROUP BY entry_hash),
    resolved AS (SELECT book.entry_id, coalesce(n, 0) AS n_editions, coalesce(direct.ord, again.ord) AS matched_ord, latest_year, coalesce(er.errored, false) AS errored FROM book
      LEFT JOIN (SELECT entry_id, count(*) AS n, max(year) AS latest_year FROM ed GROUP BY entry_id) c ON c.entry_id = book.entry_id LEFT JOIN direct ON direct.entry_id = book.entry_id LEFT JOIN again ON again.entry_id = book.entry_id
      LEFT JOIN er ON er.entry_hash = book.content_hash)"""


def _resolved(spark, d):
    e = cut(audit.load_entries(spark, d), "entries")
    return audit.book_editions(audit.candidates(spark, d), e, audit.errors(spark, d, e))


@query(f"WITH {_BOOKS} SELECT * FROM resolved")
def book_editions(spark, d):
    """Editions known of every book, the cited one and the latest."""
    return _resolved(spark, d)


@query(f"WITH {_BOOKS} SELECT entry_id, isbn13 FROM bi")
def book_isbns(spark, d):
    """ISBN of books cited without one."""
    return books.backfilled_isbn(audit.load_entries(spark, d), audit.candidates(spark, d))


@query(f"WITH {_BOOKS} SELECT entry_id, CASE WHEN errored THEN 'edition look-up failed' WHEN n_editions = 0 THEN 'no editions found' ELSE 'not among the ' || n_editions || ' known editions' END AS issue FROM resolved WHERE matched_ord IS NULL")
def book_issues(spark, d):
    """What the book check reports."""
    return books.book_report(_resolved(spark, d))


@query(
    f"""WITH {_BOOKS}, t AS (SELECT book.entry_id, book.year, trim(coalesce(book.publisher, '')) AS publisher, ed.year AS ey, trim(coalesce(ed.publisher, '')) AS ep FROM resolved JOIN book USING (entry_id) JOIN ed ON ed.entry_id = book.entry_id AND ed.ord = matched_ord),
    f AS (SELECT *, {_FOLDED.format('publisher')} AS fb, {_FOLDED.format('ep')} AS fc FROM t)
    SELECT entry_id, 'year' AS field, CAST(year AS VARCHAR) AS bib_value, coalesce(CAST(ey AS VARCHAR), '') AS canonical_value, CASE WHEN ey IS NULL THEN 'unverifiable' WHEN ey = year THEN 'ok' ELSE 'uncertain' END AS status FROM f WHERE year IS NOT NULL
    UNION ALL SELECT entry_id, 'publisher', publisher, ep, CASE WHEN ep = '' THEN 'unverifiable' WHEN publisher = ep THEN 'ok' WHEN fb = fc OR contains(fb, fc) OR contains(fc, fb) THEN 'formatting' ELSE 'needs_llm' END FROM f WHERE publisher <> ''"""
)
def book_edition_fields(spark, d):
    """Year and publisher of books against the edition they cite."""
    r = audit.candidates(spark, d).select("entry_id", F.col("ord").alias("matched_ord"), F.col("year").alias("edition_year"), F.col("publisher").alias("edition_publisher"))
    matched = _resolved(spark, d).join(r, ["entry_id", "matched_ord"])
    return fields.edition_findings(audit.load_entries(spark, d), matched)


_WORKS = f"""{E}, {R}, wk AS (SELECT r.record_id AS o, e.entry_id, coalesce(r.openalex_work_id, r.source_native_id) AS work, r.title, coalesce(r.ids.isbn13 = e.ids.isbn13, false) AS by_isbn, e.title AS t FROM r JOIN e ON e.entry_id = r.entry_id WHERE e.entry_type IN ('book', 'incollection')),
    ok AS (SELECT entry_id, work, min({{'s': NOT by_isbn, 'o': o}}) AS o FROM wk WHERE trim(work) <> '' AND (by_isbn OR ({_FOLDED.format('t')} <> '' AND {_FOLDED.format('title')} <> ''
      AND (contains({_FOLDED.format('t')}, {_FOLDED.format('title')}) OR contains({_FOLDED.format('title')}, {_FOLDED.format('t')})))) GROUP BY entry_id, work),
    works AS (SELECT entry_id, work, o.o AS ord FROM ok QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY o) <= {books.WORKS})"""


@query(f"WITH {_WORKS} SELECT entry_id, work, ord FROM works")
def book_works(spark, d):
    """Works of every book: found by ISBN, or by title and through the title gate; six at most."""
    e = audit.load_entries(spark, d)
    own = e.select("entry_id", F.col("ids.isbn13").alias("_i"))
    r = audit.load_records(spark, d).filter("entry_id is not null").join(own, "entry_id")
    works = r.select("entry_id", F.coalesce("openalex_work_id", "source_native_id").alias("work"), "title", F.coalesce(F.col("ids.isbn13") == F.col("_i"), F.lit(False)).alias("by_isbn"), F.col("record_id").alias("ord"))
    return books.works_of(e, works)


@query(
    f"""WITH {_WORKS}, x AS (SELECT coalesce(openalex_work_id, source_native_id) AS work, ids, source_native_id, year, publisher, record_id AS ord FROM r QUALIFY row_number() OVER (PARTITION BY coalesce(openalex_work_id, source_native_id) ORDER BY record_id) <= {books.EDITIONS}),
    j AS (SELECT w.entry_id, w.work, coalesce(x.ids.isbn13, nullif(x.source_native_id, ''), concat_ws('|', CAST(x.year AS VARCHAR), x.publisher)) AS kk, x.source_native_id, w.ord * {books.EDITIONS + 1} + x.ord AS o FROM works w JOIN x USING (work))
    SELECT entry_id, work, source_native_id FROM j QUALIFY row_number() OVER (PARTITION BY entry_id, kk ORDER BY o) = 1"""
)
def book_fan_out(spark, d):
    """Editions of the works of every book, fifty per work at most, each once."""
    r = audit.load_records(spark, d)
    editions = r.select(F.coalesce("openalex_work_id", "source_native_id").alias("work"), "ids", "source_native_id", "year", "publisher", F.col("record_id").alias("ord"))
    return books.editions_of(book_works(spark, d), editions).select("entry_id", "work", "source_native_id")


# ---- caches -------------------------------------------------------------------------------------


@query("SELECT entry_hash, source, query_kind, fetched_at FROM source_results WHERE source = 'openalex' AND query_kind = 'id'")
def cache_valid(spark, d):
    """Cached verdicts of the same version and model, of a cache made from the log of queries."""
    cache = table(spark, d, "source_results").withColumn("pipeline_version", F.when(F.col("source") == "openalex", resolve.PIPELINE_VERSION).otherwise("0")).withColumn("model", F.when(F.col("query_kind") == "id", "").otherwise("other"))
    return resolve.valid_verdicts(cache).select("entry_hash", "source", "query_kind", "fetched_at")


@query("SELECT entry_hash, source, query_kind, fetched_at FROM source_results WHERE NOT (source IN ('openalex', 'dblp') AND coalesce(fetched_at < TIMESTAMP '2022-01-01', true))")
def cache_cleared(spark, d):
    """The cache without the old answers of two sources."""
    import datetime

    return resolve.cleared(table(spark, d, "source_results"), ["openalex", "dblp"], datetime.datetime(2022, 1, 1)).select("entry_hash", "source", "query_kind", "fetched_at")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def cache_stale_pages(spark, d):
    """Cached live pages that were fetched before pages were rendered, of a made-up cache."""
    k = F.col("o_orderkey")
    payload = F.to_json(F.struct(F.when(k % 3 == 0, True).alias("dead"), F.when(k % 5 == 0, "full").alias("render")))
    cache = table(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, "web").otherwise("dblp").alias("source"), payload.alias("payload"))
    return resolve.stale_pages(cache).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def cache_merged(spark, d):
    """New rows in the place of old ones."""
    o = table(spark, d, "orders").select("o_orderkey")
    old, new = o.filter("o_orderkey % 2 = 0").withColumn("v", F.lit("old")), o.filter("o_orderkey % 3 = 0").withColumn("v", F.lit("new"))
    return resolve.merge_cache(old, new, ["o_orderkey"])


@query(
    f"""WITH {E}, {_CAND}, b AS (SELECT entry_id, arg_min(k.ids, ord) AS i, arg_min(venue, ord) AS v FROM k WHERE ids.doi IS NOT NULL GROUP BY entry_id), s AS (SELECT lower(doi) AS doi, arg_max(resolves, checked_at) FILTER (resolves IS NOT NULL) AS resolves FROM doi_resolution GROUP BY lower(doi)),
    x AS (SELECT e.entry_id, e.ids.doi IS NULL AS no_doi, e.ids.isbn13 IS NULL AS no_isbn, b.i.doi AS doi, b.i.isbn13 AS isbn13, s.resolves FROM e JOIN b ON b.entry_id = e.entry_id LEFT JOIN s ON s.doi = b.i.doi)
    SELECT entry_id, CASE WHEN resolves THEN 'doi_found' WHEN NOT resolves THEN 'doi_does_not_resolve' ELSE 'doi_unconfirmed' END AS kind, doi AS value FROM x WHERE no_doi
    UNION ALL SELECT entry_id, 'isbn_found', isbn13 FROM x WHERE no_isbn AND isbn13 IS NOT NULL"""
)
def backfill_of_first(spark, d):
    """What the first candidate with a DOI would add to its entry, by whether the DOI resolves."""
    r = audit.candidates(spark, d).filter("ids.doi is not null").groupBy("entry_id").agg(F.min_by("ids", "ord").alias("ids"), F.min_by("venue", "ord").alias("venue"))
    return resolve.backfill_notes(audit.load_entries(spark, d), r, resolve.doi_resolution(table(spark, d, "doi_resolution"))).filter("kind <> 'no_doi_expected'")


# ---- SQL of the audit's fuzzy stages: every pair of an entry's records is compared ---------------

_POOLED = f"""{_EDGES}, kk AS (SELECT entry_id, ord, is_preprint AS pre, {_PUBLISHED.format('ids.doi')} AS doi, {_TITLE.format('title')} AS t, {_SURNAMES.format('authors')} AS names FROM k),
    kw AS (SELECT *, list_filter(string_split(t, ' '), lambda w: w <> '') AS w FROM kk),
    vb AS (SELECT x.entry_id || '|' || x.ord || '|' || y.ord AS pid, x.entry_id, x.ord AS a, y.ord AS b, x.t AS tx, y.t AS ty, x.names AS nx, y.names AS ny, '' AS vx, '' AS vy FROM kw x JOIN kw y ON x.entry_id = y.entry_id AND x.ord < y.ord
      WHERE (x.pre <> y.pre OR x.doi IS NULL OR y.doi IS NULL OR x.doi = y.doi) AND NOT {fuzzy_sql.trap('x.w', 'y.w')}), {fuzzy_sql.scored('vb', '_v')},
    vers AS (SELECT entry_id, a, b FROM vb JOIN sc_v USING (pid) WHERE title_ratio >= {pool.VERSION_TITLE} AND (author_overlap >= {pool.VERSION_AUTHOR} OR {fuzzy_sql.subset('nx', 'ny')})),
    all_ways AS (SELECT * FROM ways UNION SELECT entry_id, a, b FROM vers UNION SELECT entry_id, b, a FROM vers),
    reached AS (SELECT entry_id, ord AS n, ord AS m FROM k UNION SELECT r.entry_id, r.n, w.b FROM reached r JOIN all_ways w ON w.entry_id = r.entry_id AND w.a = r.m),
    comp AS (SELECT entry_id, n AS ord, min(m) AS comp FROM reached GROUP BY entry_id, n)"""
SQL["pool_components"] = f"WITH RECURSIVE {_POOLED} SELECT entry_id AS entry, ord, comp FROM comp"

_RICH = "{'d': k.ids.doi IS NOT NULL, 'c': coalesce(citation_count, 0), 'n': coalesce(len(authors), 0), 'o': -k.ord}"
_FIRST = ", ".join(f"arg_min(k.ids.{f}, k.ord) FILTER (k.ids.{f} IS NOT NULL) AS {f}" for f in pool.ID_FIELDS)
_YEAR_RANK = _best("year").split("arg_min(nullif(trim(year), ''), ")[1].split(") FILTER")[0].replace("'b': ord", "'b': k.ord")
_REPS = f"""{_POOLED}, wide AS (SELECT k.entry_id, comp, arg_max(title, {_RICH}) AS title, arg_max(authors, {_RICH}) AS authors, {', '.join(_best(f).replace("'b': ord", "'b': k.ord") for f in ('venue', 'pages', 'publisher'))},
      arg_min(year, {_YEAR_RANK}) FILTER (year IS NOT NULL) AS year, max(citation_count) AS citation_count, max(edition) AS edition, bool_and(is_preprint) AS is_preprint,
      array_to_string(list_sort(list_distinct(flatten(list(list_concat([source], coalesce(merged_from, [])))))), '+') AS merged_from, count(*) AS n_records, {_FIRST}, list_distinct(flatten(list(coalesce(k.ids.isbn13s, [])))) AS isbn13s
      FROM k JOIN comp c ON c.entry_id = k.entry_id AND c.ord = k.ord GROUP BY k.entry_id, comp),
    rep AS (SELECT entry_id, comp AS ord, title, authors, year, coalesce(venue, '') AS venue, coalesce(pages, '') AS pages, coalesce(publisher, '') AS publisher, citation_count, edition, is_preprint, merged_from, n_records,
      struct_pack(doi := doi, arxiv_id := arxiv_id, isbn13 := isbn13, isbn13s := isbn13s, pmid := pmid, openalex := openalex, google_books := google_books) AS ids FROM wide)"""
SQL["pool_representatives"] = f"WITH RECURSIVE {_REPS} SELECT entry_id AS entry, ord, title, year, venue, pages, publisher, citation_count, is_preprint, merged_from, n_records FROM rep"

_AGREE = """CASE WHEN (len(ia) > 0 AND len(ib) > 0 AND len(list_intersect(ia, ib)) > 0) OR coalesce(dx = dy, false) OR coalesce(x.arxiv_id = y.arxiv_id, false) OR coalesce(x.pmid = y.pmid, false) OR coalesce(x.openalex = y.openalex, false) THEN 'match'
    WHEN (len(ia) > 0 AND len(ib) > 0) OR (dx IS NOT NULL AND dy IS NOT NULL) OR (x.arxiv_id IS NOT NULL AND y.arxiv_id IS NOT NULL) OR (x.pmid IS NOT NULL AND y.pmid IS NOT NULL) OR (x.openalex IS NOT NULL AND y.openalex IS NOT NULL) THEN 'conflict' ELSE 'absent' END"""
_END = "TRY_CAST(nullif(regexp_extract({0}, '([0-9]{{1,9}})\\s*[-–—]+\\s*([0-9]{{1,9}})', {1}), '') AS INT)"


def _both(cte: str, source: str) -> str:
    """CTEs with everything that is compared about two rows: ``source`` gives pid and, ending in x and y, title, authors, venue, pages, ids."""
    lo, hi = (lambda s: f"least({_END.format(f'pages_{s}', 1)}, {_END.format(f'pages_{s}', 2)})"), (lambda s: f"greatest({_END.format(f'pages_{s}', 1)}, {_END.format(f'pages_{s}', 2)})")
    full = " AND ".join(f"{_END.format(f'pages_{s}', i)} IS NOT NULL" for s in "xy" for i in (1, 2))
    return f"""{cte}_t AS (SELECT *, {_TITLE.format('title_x')} AS tx, {_TITLE.format('title_y')} AS ty, {_SURNAMES.format('authors_x')} AS nx, {_SURNAMES.format('authors_y')} AS ny, {_TITLE.format('venue_x')} AS vx, {_TITLE.format('venue_y')} AS vy,
      {full} AND ({hi('y')} < {lo('x')} OR {hi('x')} < {lo('y')}) AS apart FROM ({source})), {fuzzy_sql.scored(f'{cte}_t', f'_{cte}')},
    {cte}_p AS (SELECT pid, vx AS tx, vy AS ty, []::VARCHAR[] AS nx, []::VARCHAR[] AS ny, '' AS vx, '' AS vy FROM {cte}_t WHERE trim(coalesce(venue_x, '')) <> '' AND trim(coalesce(venue_y, '')) <> ''), {fuzzy_sql.scored(f'{cte}_p', f'_{cte}p')},
    {cte}_w AS (SELECT t.*, list_filter(string_split(tx, ' '), lambda w: w <> '') AS wx, list_filter(string_split(ty, ' '), lambda w: w <> '') AS wy, ids_x AS x, ids_y AS y, {_PUBLISHED.format('ids_x.doi')} AS dx, {_PUBLISHED.format('ids_y.doi')} AS dy,
      list_distinct(list_filter(list_concat([ids_x.isbn13], coalesce(ids_x.isbn13s, [])), lambda z: z IS NOT NULL)) AS ia, list_distinct(list_filter(list_concat([ids_y.isbn13], coalesce(ids_y.isbn13s, [])), lambda z: z IS NOT NULL)) AS ib,
      s.title_ratio, s.author_overlap, s.venue AS venue_compatible, coalesce(v.title_ratio > {sim.SAME_VENUE}, true) AS same_venue FROM {cte}_t t JOIN sc_{cte} s USING (pid) LEFT JOIN sc_{cte}p v ON v.pid = t.pid),
    {cte} AS (SELECT *, {fuzzy_sql.trap('wx', 'wy')} AS prefix_trap, CASE WHEN len(nx) = 0 OR len(ny) = 0 THEN 0.0 ELSE len(list_intersect(nx, ny)) / len(list_distinct(list_concat(nx, ny))) END AS author_set_jaccard, {fuzzy_sql.subset('nx', 'ny')} AS author_subset,
      {_AGREE} AS id_agreement, same_venue AND coalesce(apart, false) AS pages_conflict FROM {cte}_w)"""


_STRONG = "coalesce(" + " OR ".join(f"e.ids.{f} IS NOT NULL" for f in ids.STRONG) + ", false)"
_CANDIDATES = (
    f"SELECT e.entry_id || '|' || rep.ord AS pid, e.entry_id, rep.ord, {_STRONG} AS has_id, e.year AS year_x, rep.year AS year_y, rep.is_preprint, rep.citation_count, rep.edition, "
    + ", ".join(f"e.{c} AS {c}_x, rep.{c} AS {c}_y" for c in ("title", "authors", "venue", "pages", "ids")) + " FROM e JOIN rep ON rep.entry_id = e.entry_id"
)
_ASSESSED = f"""{_REPS}, {E}, {_both('f', _CANDIDATES)},
    g AS (SELECT *, CASE WHEN year_x IS NULL OR year_y IS NULL THEN 1.0 ELSE 1 / (1 + pow(CAST(year_x - year_y AS DOUBLE) / 3, 2)) END AS year_factor FROM f),
    c AS (SELECT *, title_ratio * (0.5 + 0.5 * author_overlap) * year_factor * venue_compatible AS composite FROM g), assessed AS (SELECT *, {_BUCKET} AS bucket FROM c)"""
_ROUNDED = ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in ("title_ratio", "author_overlap", "author_set_jaccard", "year_factor", "venue_compatible", "composite"))
SQL["candidate_features"] = f"WITH RECURSIVE {_ASSESSED} SELECT entry_id, ord, {_ROUNDED}, prefix_trap, author_subset, id_agreement, pages_conflict, bucket FROM assessed"
SQL["candidate_top"] = f"""WITH RECURSIVE {_ASSESSED}, n AS (SELECT entry_id, ord, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY round(composite, 9) DESC, ord) AS INT) AS rank FROM assessed WHERE bucket = 'adjudicate')
    SELECT entry_id, ord, rank FROM n WHERE rank <= {score.TOP_CANDIDATES}"""

_ACCEPTED_PAIRS = "SELECT x.entry_id || '|' || x.ord || '|' || y.ord AS pid, x.entry_id, x.ord AS a, y.ord AS b, " + ", ".join(f"x.{c}_y AS {c}_x, y.{c}_y AS {c}_y" for c in ("title", "authors", "venue", "pages", "ids")) + (
    " FROM assessed x JOIN assessed y ON x.entry_id = y.entry_id AND x.ord < y.ord WHERE x.bucket = 'auto_accept' AND y.bucket = 'auto_accept'"
)
_VERDICTS = f"""{_ASSESSED}, {_both('h', _ACCEPTED_PAIRS)},
    joined AS (SELECT entry_id, a, b FROM h WHERE id_agreement = 'match' UNION SELECT entry_id, b, a FROM h WHERE id_agreement = 'match'),
    works AS (SELECT entry_id, ord AS n, ord AS m FROM assessed WHERE bucket = 'auto_accept' UNION SELECT w.entry_id, w.n, j.b FROM works w JOIN joined j ON j.entry_id = w.entry_id AND j.a = w.m),
    work AS (SELECT entry_id, n, min(m) AS comp FROM works GROUP BY entry_id, n), arts AS (SELECT entry_id, count(DISTINCT comp) AS n_artifacts FROM work GROUP BY entry_id),
    seen AS (SELECT entry_id, bool_and(bucket = 'auto_reject') AS rejected FROM assessed GROUP BY entry_id), er AS (SELECT entry_hash, bool_or(error IS NOT NULL) AS errored FROM source_results GROUP BY entry_hash),
    v AS (SELECT e.*, coalesce(n_artifacts, 0) AS n, seen.entry_id IS NULL AS no_candidates, coalesce(rejected, false) AS rejected, coalesce(errored, false) AS errored FROM e LEFT JOIN arts ON arts.entry_id = e.entry_id LEFT JOIN seen ON seen.entry_id = e.entry_id LEFT JOIN er ON er.entry_hash = e.content_hash),
    verdict AS (SELECT *, CASE WHEN n = 1 THEN 'exactly_one' WHEN n > 1 THEN 'multiple' WHEN errored THEN NULL WHEN no_candidates OR rejected THEN 'none' END AS kind,
      CASE WHEN n = 1 THEN 'high' WHEN n > 1 THEN 'medium' WHEN errored THEN NULL WHEN no_candidates THEN 'high' WHEN rejected THEN 'medium' END AS confidence FROM v)"""
SQL["verdicts"] = f"WITH RECURSIVE {_VERDICTS} SELECT entry_id, kind, confidence, n AS n_artifacts FROM verdict"

_ER = "er AS (SELECT entry_hash, bool_or(error IS NOT NULL) AS errored FROM source_results GROUP BY entry_hash)"
_BOOK_CTES = _BOOKS.removeprefix(f"{_CAND}, {E}, ").replace(_ER + ",\n    ", "")
_FINAL = f"""{_VERDICTS}, {_BOOK_CTES},
    pin AS (SELECT entry_id, arg_min(bucket, ord) FILTER (ids_x.openalex = ids_y.openalex) = 'auto_accept' AS wp, arg_min(bucket, ord) FILTER (ids_x.google_books = ids_y.google_books) = 'auto_accept' AS vp FROM assessed GROUP BY entry_id),
    ruled AS (SELECT v.*, coalesce(entry_type = 'misc' AND ids.url IS NOT NULL AND ids.doi IS NULL AND ids.arxiv_id IS NULL AND ids.isbn13 IS NULL, false) AS web_only, coalesce(wp, false) OR coalesce(vp, false) AS pinned,
      r.entry_id IS NOT NULL AND r.matched_ord IS NOT NULL AS matched, coalesce(r.errored, false) AS look_up_failed FROM verdict v LEFT JOIN pin ON pin.entry_id = v.entry_id LEFT JOIN resolved r ON r.entry_id = v.entry_id),
    second AS (SELECT *, CASE WHEN pinned THEN 'exactly_one' WHEN web_only AND coalesce(kind, 'none') = 'none' THEN NULL ELSE kind END AS kind2 FROM ruled),
    final AS (SELECT * EXCLUDE (kind), CASE WHEN matched THEN 'exactly_one' WHEN look_up_failed AND kind2 = 'none' THEN NULL ELSE kind2 END AS kind FROM second)"""
SQL["final_verdicts"] = f"WITH RECURSIVE {_FINAL} SELECT entry_id, kind FROM final"
SQL["verdict_counts"] = f"""WITH RECURSIVE {_FINAL}, names AS (SELECT unnest(['exactly_one', 'multiple', 'none', 'unresolved']) AS verdict), counted AS (SELECT coalesce(kind, 'unresolved') AS verdict, count(*) AS n FROM final GROUP BY ALL)
    SELECT verdict, coalesce(n, 0) AS n FROM names LEFT JOIN counted USING (verdict)"""

_BEST = f"""okay AS (SELECT * FROM assessed WHERE bucket = 'auto_accept'),
    best AS (SELECT entry_id, arg_max({{'ids': ids_y, 'year': year_y, 'edition': edition, 'venue': venue_y}}, {{'p': NOT is_preprint, 'd': ids_y.doi IS NOT NULL, 'c': citation_count, 'o': -ord}}) AS b,
      arg_min({_PUBLISHED.format('ids_y.doi')}, ord) FILTER ({_PUBLISHED.format('ids_y.doi')} IS NOT NULL) AS published_doi FROM okay GROUP BY entry_id)"""
_ORDINAL = "CASE lower(regexp_extract(said, '^(\\S+)', 1)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.ORDINALS.items()) + " END"
_BETTER = f"""{_BEST}, bb AS (SELECT e.entry_id, e.entry_type, e.year, published_doi, b.year AS best_year, b.edition AS n_editions, {_SUBMITTED} AS submitted, CASE WHEN e.ids.doi IS NOT NULL THEN starts_with(e.ids.doi, '{ids.PREPRINT_DOI}') ELSE e.ids.arxiv_id IS NOT NULL END AS preprint,
      trim(coalesce(raw_fields['edition'], '')) AS said FROM e JOIN best ON best.entry_id = e.entry_id),
    bc AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(said, '^([0-9]{{1,9}})', 1), '') AS INT), {_ORDINAL}) AS number, entry_type IN ('article', 'inproceedings', 'misc') AND preprint AS paper, entry_type IN ('book', 'incollection') AS book FROM bb),
    better AS (SELECT entry_id, 'published_version' AS kind, published_doi AS detail FROM bc WHERE paper AND published_doi IS NOT NULL
      UNION ALL SELECT entry_id, 'newer_preprint', CAST(best_year AS VARCHAR) FROM bc WHERE paper AND published_doi IS NULL AND year = submitted AND best_year > year
      UNION ALL SELECT entry_id, 'edition_not_given', CAST(n_editions AS VARCHAR) FROM bc WHERE book AND n_editions > 1 AND said = ''
      UNION ALL SELECT entry_id, 'later_edition', CAST(n_editions AS VARCHAR) FROM bc WHERE book AND n_editions > 1 AND n_editions > number)"""
SQL["better_versions"] = f"WITH RECURSIVE {_ASSESSED}, {_BETTER} SELECT * FROM better"
SQL["backfilled"] = f"""WITH RECURSIVE {_ASSESSED}, {_BEST}, s AS (SELECT lower(doi) AS doi, arg_max(resolves, checked_at) FILTER (resolves IS NOT NULL) AS resolves FROM doi_resolution GROUP BY lower(doi)),
    x AS (SELECT e.entry_id, e.ids.doi IS NULL AS no_doi, e.ids.isbn13 IS NULL AS no_isbn, b.ids.doi AS doi, b.ids.isbn13 AS isbn13, e.venue, s.resolves FROM e JOIN best ON best.entry_id = e.entry_id LEFT JOIN s ON s.doi = b.ids.doi)
    SELECT entry_id, CASE WHEN resolves THEN 'doi_found' WHEN NOT resolves THEN 'doi_does_not_resolve' ELSE 'doi_unconfirmed' END AS kind, doi AS value FROM x WHERE no_doi AND doi IS NOT NULL
    UNION ALL SELECT entry_id, 'isbn_found', isbn13 FROM x WHERE no_isbn AND isbn13 IS NOT NULL
    UNION ALL SELECT entry_id, 'no_doi_expected', venue FROM x WHERE no_doi AND doi IS NULL AND ({" OR ".join(f"contains(lower(venue), '{v}')" for v in ids.NO_DOI_VENUES)})"""
_REPORT = f"""{_FINAL}, {_BETTER}, later AS (SELECT f.entry_id FROM final f JOIN resolved r ON r.entry_id = f.entry_id WHERE r.matched_ord IS NOT NULL AND r.latest_year > f.year),
    per_issue AS (SELECT entry_id, count(*) AS n FROM (SELECT entry_id FROM ({SQL['entry_issues']}) UNION ALL SELECT entry_id FROM resolved WHERE matched_ord IS NULL) GROUP BY entry_id),
    per_nit AS (SELECT entry_id, count(*) AS n FROM ({SQL['field_findings']}) WHERE status = 'formatting' GROUP BY entry_id),
    per_advice AS (SELECT entry_id, count(*) AS n FROM (SELECT entry_id FROM better UNION ALL SELECT entry_id FROM later) GROUP BY entry_id),
    figures AS (SELECT f.entry_id, f.entry_type, f.kind, coalesce(i.n, 0) AS n_issues, coalesce(t.n, 0) AS n_formatting, coalesce(a.n, 0) AS n_advisories FROM final f LEFT JOIN per_issue i ON i.entry_id = f.entry_id
      LEFT JOIN per_nit t ON t.entry_id = f.entry_id LEFT JOIN per_advice a ON a.entry_id = f.entry_id),
    reported AS (SELECT *, CASE WHEN kind = 'none' THEN 'CAPITAL OFFENCES' WHEN kind IS NULL THEN 'UNABLE TO VERIFY' WHEN n_issues > 0 OR kind = 'multiple' THEN 'ISSUES' WHEN n_formatting > 0 OR n_advisories > 0 THEN 'NITS' ELSE 'NO ISSUES' END AS category FROM figures)"""
SQL["report"] = f"WITH RECURSIVE {_REPORT} SELECT * FROM reported"
SQL["report_lines"] = f"WITH RECURSIVE {_REPORT} SELECT category, entry_id || ' [' || entry_type || ']: ' || coalesce(kind, 'unresolved') || ', ' || n_issues || ' issue(s)' AS line FROM reported"

_PARTS = [("cited_title", "title_x"), ("cited_authors", "array_to_string(authors_x, '; ')"), ("cited_year", "CAST(year_x AS VARCHAR)"), ("cited_venue", "venue_x"), ("title", "title_y"), ("authors", "array_to_string(authors_y, '; ')"), ("year", "CAST(year_y AS VARCHAR)"), ("venue", "venue_y")]
_ASKED = ", ".join(f"'{k}: ' || coalesce(left({v}, {adjudicate.TEXT_CAP}), '(none)')" for k, v in _PARTS)
_FORM = "; ".join(f"{f} in {'/'.join(v)}" for f, v in adjudicate.ANSWERS["can_correspond"].items())
SQL["questions"] = f"""WITH RECURSIVE {_ASSESSED}, n AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY round(composite, 9) DESC, ord) AS rank FROM assessed WHERE bucket = 'adjudicate')
    SELECT entry_id, ord, sha256(concat_ws(chr(10), '{adjudicate.INSTRUCTION['can_correspond']}', 'Answer in JSON: {_FORM}.', {_ASKED})) AS prompt_hash FROM n WHERE rank <= {score.TOP_CANDIDATES}"""
