"""Queries for the audit's own operators, and DuckDB SQL for those that SQL can express.

Every query runs over its whole tables.  Queries without SQL rest on fuzzy ratios, iteration or parsers; the
tests compare them with brute force on small fixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.functions import similarity as sim
from citeloom.functions import text
from citeloom.operators import books, entries, fields, pool, resolve, score
from citeloom.plans import audit, fuzzy_sql
from citeloom.runtime import cut, table
from citeloom.sources import bibtex, connectors, html, latex, payloads

HOST = "openalex.example"  # the host the test tables use

QUERIES: dict = {}
SQL: dict[str, str] = {}

E = "e AS (SELECT * FROM bib_entries QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY loaded_at DESC) = 1)"
R = "r AS (SELECT * EXCLUDE (ord) FROM source_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) = 1)"
FOLD = "trim(regexp_replace(translate(strip_accents(lower({})), 'øłđı', 'oldi'), '[^a-z0-9 ]', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_records").select("record_id", F.explode("version_links").alias("link")).distinct()


LINKS = "l AS (SELECT DISTINCT record_id, unnest(version_links) AS link FROM source_records)"


# ---- identifiers --------------------------------------------------------------------------------


@query(f"WITH {LINKS} SELECT record_id, link, lower(rtrim(nullif(regexp_extract(link, '10\\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+', 0, 'i'), ''), '.,;)')) AS doi FROM l")
def id_doi(spark, d):
    """DOI of every version link."""
    return links(spark, d).select("record_id", "link", ids.doi("link").alias("doi"))


def _found_arxiv(x: str) -> str:
    """SQL for the first preprint id in a text."""
    bare = "regexp_replace(regexp_replace(regexp_replace(p, '(?i)^arxiv\\.', ''), '^\\.+|(\\.pdf)?\\.*$', '', 'g'), 'v[0-9]+$', '')"
    pieces = f"list_transform(regexp_split_to_array({x}, '{ids.BETWEEN_IDS}'), lambda p: {bare})"
    pairs = f"list_transform(list_zip({pieces}, list_slice({pieces}, 2, NULL)), lambda z: CASE WHEN regexp_matches(z[1], '{ids.OLD_ARCHIVE}') AND regexp_matches(z[2], '{ids.OLD_NUMBER}') THEN z[1] || '/' || z[2] END)"
    return f"coalesce(list_filter({pieces}, lambda p: regexp_matches(p, '{ids.NEW_FORM}'))[1], list_filter({pairs}, lambda p: p IS NOT NULL)[1])"


def _named_arxiv(x: str) -> str:
    """SQL for the preprint id of a text that names the server."""
    after = f"CASE WHEN regexp_matches({x}, '{ids.SERVER}') THEN regexp_replace({x}, '{ids.SERVER}', '') END"
    return f"CASE WHEN regexp_matches({x}, '(?i)arxiv|48550') THEN {_found_arxiv(f"concat_ws(' ', {after}, {x})")} END"


@query(
    f"""WITH {LINKS}, a AS (SELECT record_id, link, {_named_arxiv('link')} AS arxiv FROM l)
    SELECT record_id, link, arxiv, '{ids.PREPRINT_DOI}.' || lower(arxiv) AS arxiv_doi,
      CASE WHEN regexp_matches(arxiv, '{ids.NEW_FORM}') THEN 2000 + CAST(substr(arxiv, 1, 2) AS INT) END AS submitted FROM a"""
)
def id_arxiv(spark, d):
    """arXiv id of every version link that names the server, its DOI and year of submission."""
    none = F.lit(None).cast("string")
    rows = links(spark, d).withColumn("arxiv", ids.arxiv_id(none, none, F.col("link")))
    return rows.select("record_id", "link", "arxiv", ids.arxiv_doi(F.col("arxiv")).alias("arxiv_doi"), ids.arxiv_year(F.col("arxiv")).alias("submitted"))


@query(
    f"""WITH {LINKS} SELECT record_id, link, CASE WHEN contains(lower(link), '{HOST}') THEN upper(nullif(regexp_extract(link, '\\bW[0-9]+\\b', 0, 'i'), '')) END AS work,
    nullif(trim(link), '') AS url FROM l"""
)
def id_work(spark, d):
    """Work id of links to the catalogue's host, and the cleaned address."""
    return links(spark, d).select("record_id", "link", ids.work_id("link", HOST).alias("work"), ids.url("link").alias("url"))


@query(
    """WITH s AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS b, CAST(p_partkey % 2 AS INT) AS odd FROM part),
    t AS (SELECT p_partkey, CASE WHEN odd = 1 THEN substr(b, 1, 1) || '-' || substr(b, 2) || '-X' ELSE 'ISBN 978' || b || '0' END AS given, '978' || b AS body, odd FROM s)
    SELECT p_partkey, given, CASE WHEN odd = 0 THEN body || '0' ELSE body || CAST((10 - list_sum(list_transform(range(1, 13),
      lambda i: CAST(substr(body, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR) END AS isbn13 FROM t"""
)
def id_isbn(spark, d):
    """ISBN-13 of made-up ten-sign and embedded thirteen-sign ISBNs of all parts."""
    b = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    given = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.substring(b, 1, 1), F.lit("-"), b.substr(F.lit(2), F.lit(8)), F.lit("-X"))).otherwise(F.concat(F.lit("ISBN 978"), b, F.lit("0")))
    return table(spark, d, "part").select("p_partkey", given.alias("given"), ids.isbn13(given).alias("isbn13"))


@query(
    f"""WITH {E} SELECT entry_id, CASE WHEN ids.doi IS NOT NULL THEN 'doi' WHEN ids.isbn13 IS NOT NULL THEN 'isbn' WHEN ids.arxiv_id IS NOT NULL THEN 'arxiv'
      WHEN ids.openalex IS NOT NULL THEN 'openalex' WHEN ids.google_books IS NOT NULL THEN 'google_books' WHEN ids.url IS NOT NULL THEN 'url' END AS kind,
    coalesce(ids.doi IS NOT NULL OR ids.arxiv_id IS NOT NULL OR ids.isbn13 IS NOT NULL OR ids.pmid IS NOT NULL OR ids.bibcode IS NOT NULL OR ids.openalex IS NOT NULL
      OR ids.google_books IS NOT NULL, false) AS strong FROM e"""
)
def id_kinds(spark, d):
    """Strongest identifier kind of every entry."""
    i = F.col("ids")
    return audit.load_entries(spark, d).select("entry_id", ids.primary_kind(i).alias("kind"), ids.has_strong_id(i).alias("strong"))


@query(
    f"""WITH {E}, t AS (SELECT entry_id, title, authors, year, venue, ids FROM e)
    SELECT entry_id, sha256(concat_ws('␟', trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')),
      array_to_string(list_sort(list_transform(coalesce(authors, []), lambda x: trim(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]+', ' ', 'g')))), '|'),
      coalesce(CAST(year AS VARCHAR), ''), trim(regexp_replace(lower(coalesce(venue, '')), '[^a-z0-9]+', ' ', 'g')),
      coalesce(ids.doi, ''), coalesce(ids.arxiv_id, ''), coalesce(ids.isbn13, ''), coalesce(ids.openalex, ''))) AS content_hash FROM t"""
)
def id_content_hash(spark, d):
    """Identity hash of every entry."""
    return audit.load_entries(spark, d).select("entry_id", ids.content_hash(F.col("title"), F.col("authors"), F.col("year"), F.col("venue"), F.col("ids")).alias("content_hash"))


PAIRS = f"{E}, {R}, p AS (SELECT e.entry_id, r.record_id, e AS e, r AS r FROM e JOIN r ON r.entry_id = e.entry_id)"
_ISBN = "list_distinct(list_filter(list_concat([{0}.ids.isbn13], coalesce({0}.ids.isbn13s, [])), lambda x: x IS NOT NULL))"


def pairs(spark, d):
    """Entries with the records fetched for them, as structs e and r."""
    e = audit.load_entries(spark, d).select("entry_id", F.struct("title", "authors", "year", "venue", "pages", "ids").alias("e"))
    r = audit.load_records(spark, d).filter("entry_id is not null")
    return e.join(r.select("entry_id", "record_id", F.struct("title", "authors", "year", "venue", "pages", "ids").alias("r")), "entry_id")


@query(
    f"""WITH {PAIRS}, k AS (SELECT entry_id, record_id, {_ISBN.format('e')} AS a, {_ISBN.format('r')} AS b, e.ids AS x, r.ids AS y FROM p),
    q AS (SELECT *, CASE WHEN NOT starts_with(x.doi, '10.48550/arxiv') THEN x.doi END AS dx, CASE WHEN NOT starts_with(y.doi, '10.48550/arxiv') THEN y.doi END AS dy FROM k)
    SELECT entry_id, record_id, CASE WHEN (len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) > 0) OR coalesce(dx = dy, false) OR coalesce(x.arxiv_id = y.arxiv_id, false)
      OR coalesce(x.pmid = y.pmid, false) OR coalesce(x.openalex = y.openalex, false) THEN 'match'
    WHEN (len(a) > 0 AND len(b) > 0) OR (dx IS NOT NULL AND dy IS NOT NULL) OR (x.arxiv_id IS NOT NULL AND y.arxiv_id IS NOT NULL) OR (x.pmid IS NOT NULL AND y.pmid IS NOT NULL)
      OR (x.openalex IS NOT NULL AND y.openalex IS NOT NULL) THEN 'conflict' ELSE 'absent' END AS agreement FROM q"""
)
def id_agreement(spark, d):
    """Whether an entry's and a fetched record's identifiers agree."""
    return pairs(spark, d).select("entry_id", "record_id", ids.agreement(F.col("e.ids"), F.col("r.ids")).alias("agreement"))


# ---- strings ------------------------------------------------------------------------------------


@query(f"""WITH {E} SELECT entry_id, regexp_replace({FOLD.format("coalesce(title, '')")}, '\\s+', ' ', 'g') AS title_key,
    trim(regexp_replace(regexp_replace(coalesce(title, ''), '[{{}}]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM e""")
def text_title(spark, d):
    """Comparable title and brace-free title of every entry."""
    return audit.load_entries(spark, d).select("entry_id", text.title(F.col("title")).alias("title_key"), text.clean(F.col("title")).alias("cleaned"))


_PAGES = "regexp_replace(trim(coalesce(pages, '')), '\\s*[-–—‐]+\\s*', '-', 'g')"
_RANGE = "'([0-9]{1,9})\\s*[-–—]+\\s*([0-9]{1,9})'"


@query(
    f"""WITH {R}, x AS (SELECT record_id, lower({_PAGES}) AS pages_key, regexp_matches(coalesce(pages, ''), '\\w--\\w') AND NOT regexp_matches(coalesce(pages, ''), '[–—]') AS clean,
      TRY_CAST(nullif(regexp_extract(pages, {_RANGE}, 1), '') AS INT) AS a, TRY_CAST(nullif(regexp_extract(pages, {_RANGE}, 2), '') AS INT) AS b FROM r)
    SELECT record_id, pages_key, clean, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END AS lo, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS hi FROM x"""
)
def text_pages(spark, d):
    """Comparable pages, whether cleanly written, and the page range of every record."""
    p = F.col("pages")
    rng = text.page_range(p)
    return audit.load_records(spark, d).select("record_id", text.pages(p).alias("pages_key"), text.clean_range(F.coalesce(p, F.lit(""))).alias("clean"), rng["lo"].alias("lo"), rng["hi"].alias("hi"))


@query(
    f"""WITH {E} SELECT entry_id, TRY_CAST(nullif(regexp_extract(raw_fields['year'], '[0-9]{{4}}'), '') AS INT) AS year,
      TRY_CAST(nullif(regexp_extract(raw_fields['note'], '\\b(1[5-9][0-9]{{2}}|20[0-9]{{2}})\\b', 1), '') AS INT) AS note_year,
      lower(trim(regexp_replace(regexp_replace(coalesce(raw_fields['number'], ''), '[{{}}]', '', 'g'), '\\s+', ' ', 'g')))
        IN ('', '-', '--', '–', '—', 'n/a', 'n.a.', 'na', 'none', 'null', 'tbd', '?', '...') AS no_number,
      TRY_CAST(nullif(regexp_extract(trim(raw_fields['number']), '^([0-9]{{1,9}})', 1), '') AS INT) AS number_as_edition FROM e"""
)
def text_years(spark, d):
    """Years, placeholders and leading numbers in raw fields."""
    f = lambda k: F.element_at("raw_fields", k)
    return audit.load_entries(spark, d).select(
        "entry_id", text.year(f("year")).alias("year"), text.edition_year(f("note")).alias("note_year"), text.is_placeholder(F.coalesce(f("number"), F.lit(""))).alias("no_number"),
        text.edition_number(f("number")).alias("number_as_edition"),
    )


_NAME = "trim(regexp_replace(translate(strip_accents(lower({})), 'øłđı', 'oldi'), '[^a-z\\s,.-]', '', 'g'))"
_LAST = f"""CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 1))
      ELSE coalesce(list_filter(regexp_split_to_array(replace(n, '.', ' '), '\\s+'), lambda w: w <> '')[-1], '') END"""


@query(
    f"""WITH {R}, a AS (SELECT record_id, generate_subscripts(authors, 1) AS i, unnest(authors) AS a FROM r),
    n AS (SELECT record_id, i, {_NAME.format('a')} AS n FROM a), k AS (SELECT record_id, i, {_LAST} AS last FROM n WHERE rtrim(n) NOT IN ('others', 'et al', 'et al.', 'and others'))
    SELECT record_id, string_agg(last, ' | ' ORDER BY i) AS surnames, count(*) AS n FROM k GROUP BY record_id"""
)
def text_surnames(spark, d):
    """Surnames of the named authors of every record, in order."""
    r = audit.load_records(spark, d).select("record_id", F.transform(text.named(F.col("authors")), text.last_name).alias("s")).filter(F.size("s") > 0)
    return r.select("record_id", F.array_join("s", " | ").alias("surnames"), F.size("s").cast("bigint").alias("n"))


@query(
    f"""WITH {R} SELECT record_id, regexp_matches(venue, '(?i)arxiv|bio\\s*rxiv|med\\s*rxiv|chem\\s*rxiv|preprint|repositor|researchgate|\\bssrn\\b|zenodo|figshare|\\bosf\\b|hal[-\\s]|scholarworks|dspace|eprints|research\\s+square|technical reports server|\\bscholar \\(|\\(.*\\buniversit') AS repository
    FROM r WHERE venue IS NOT NULL"""
)
def text_repository(spark, d):
    """Whether a record's venue is a repository or preprint server."""
    return audit.load_records(spark, d).filter("venue is not null").select("record_id", text.is_repository(F.col("venue")).alias("repository"))


# ---- entries ------------------------------------------------------------------------------------


@query(f"WITH {E} SELECT entry_type, count(*) AS n FROM e GROUP BY entry_type")
def entry_types(spark, d):
    """Entries by type."""
    return entries.type_counts(audit.load_entries(spark, d))


@query(f"WITH {E}, k AS (SELECT DISTINCT bib_file, key FROM contexts) SELECT e.entry_id, k.key IS NOT NULL AS is_cited FROM e LEFT JOIN k ON k.bib_file = e.bib_file AND k.key = e.key")
def entry_cited(spark, d):
    """Entries with whether any citing sentence names them."""
    return entries.mark_cited(audit.load_entries(spark, d), table(spark, d, "contexts"), ["bib_file", "key"]).select("entry_id", "is_cited")


@query(f"WITH {E} SELECT e.entry_id FROM e ANTI JOIN contexts c ON c.bib_file = e.bib_file AND c.key = e.key")
def entry_uncited(spark, d):
    """Entries that no citing sentence names."""
    return entries.uncited(audit.load_entries(spark, d), table(spark, d, "contexts"), ["bib_file", "key"]).select("entry_id")


@query(f"WITH {E} SELECT DISTINCT c.bib_file, c.key FROM contexts c ANTI JOIN e ON e.bib_file = c.bib_file AND e.key = c.key")
def entry_dangling(spark, d):
    """Cited keys without an entry."""
    return entries.dangling(table(spark, d, "contexts"), audit.load_entries(spark, d), ["bib_file", "key"])


_BY_ID = "list_concat(CASE WHEN ids.doi IS NOT NULL THEN ['crossref','openalex','semantic_scholar'] ELSE [] END, CASE WHEN ids.arxiv_id IS NOT NULL THEN ['arxiv','openalex','semantic_scholar'] ELSE [] END, CASE WHEN ids.isbn13 IS NOT NULL THEN ['openlibrary','google_books'] ELSE [] END, CASE WHEN ids.google_books IS NOT NULL THEN ['google_books'] ELSE [] END, CASE WHEN ids.openalex IS NOT NULL THEN ['openalex'] ELSE [] END)"
_BY_META = "CASE WHEN entry_type IN ('book','incollection') THEN ['openlibrary','google_books','crossref'] WHEN entry_type = 'misc' THEN ['arxiv','openalex','crossref','semantic_scholar','dblp'] ELSE ['crossref','openalex','semantic_scholar','dblp'] END"


@query(
    f"""WITH {E}, x AS (SELECT entry_id, 'id' AS query_kind, {_BY_ID} AS s FROM e UNION ALL SELECT entry_id, 'metadata', {_BY_META} FROM e),
    y AS (SELECT entry_id, query_kind, generate_subscripts(s, 1) AS i, unnest(s) AS source FROM x),
    z AS (SELECT entry_id, query_kind, source, min(i) AS i FROM y GROUP BY ALL)
    SELECT entry_id, query_kind, source, CAST(row_number() OVER (PARTITION BY entry_id, query_kind ORDER BY i) - 1 AS INT) AS ord FROM z"""
)
def entry_routes(spark, d):
    """Sources to ask for every entry, in order."""
    return entries.route(audit.load_entries(spark, d)).select("entry_id", "query_kind", "source", "ord")


_ISSUES = """list_filter([CASE WHEN ids.doi IS NOT NULL AND (contains(lower(trim(coalesce(raw_fields['doi'], ''))), 'doi.org') OR starts_with(lower(trim(coalesce(raw_fields['doi'], ''))), 'http')) THEN 'doi_as_url' END,
      CASE WHEN entry_type IN ('book', 'incollection') AND ids.isbn13 IS NULL THEN 'book_without_isbn' END,
      CASE WHEN entry_type IN ('article', 'inproceedings') AND ids.doi IS NULL AND ids.arxiv_id IS NULL THEN 'no_doi_or_arxiv' END,
      CASE WHEN entry_type = 'misc' AND ids.doi IS NULL AND ids.arxiv_id IS NULL AND ids.isbn13 IS NULL AND ids.pmid IS NULL AND ids.bibcode IS NULL AND ids.openalex IS NULL AND ids.google_books IS NULL AND ids.url IS NULL THEN 'no_identifier_or_url' END,
      CASE WHEN trim(coalesce(title, '')) = '' THEN 'missing_title' END,
      CASE WHEN coalesce(len(authors), 0) < 1 THEN 'missing_authors' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {E}, x AS (SELECT entry_id, {_ISSUES} AS f FROM e) SELECT entry_id, CAST(generate_subscripts(f, 1) - 1 AS INT) AS pos, unnest(f) AS issue FROM x")
def entry_issues(spark, d):
    """What is wrong with entries on their face."""
    return entries.issues(audit.load_entries(spark, d))


@query(
    f"""WITH {E}, x AS (SELECT *, len({_ISSUES}) AS n FROM e), dg AS (SELECT DISTINCT c.bib_file, c.key FROM contexts c ANTI JOIN e ON e.bib_file = c.bib_file AND e.key = c.key)
    SELECT count(*) FILTER (NOT is_commented) AS entries, count(*) FILTER (NOT is_commented AND cited) AS cited, count(*) FILTER (NOT is_commented AND NOT cited) AS uncited,
      count(*) FILTER (is_commented) AS commented, count(*) FILTER (NOT is_commented AND n > 0) AS with_issues, CAST(coalesce(sum(n) FILTER (NOT is_commented), 0) AS BIGINT) AS issues,
      count(*) FILTER (NOT is_commented AND coalesce(ids.doi IS NOT NULL OR ids.arxiv_id IS NOT NULL OR ids.isbn13 IS NOT NULL OR ids.pmid IS NOT NULL OR ids.bibcode IS NOT NULL
        OR ids.openalex IS NOT NULL OR ids.google_books IS NOT NULL, false)) AS with_strong_id, (SELECT count(*) FROM dg) AS dangling FROM x"""
)
def entry_summary(spark, d):
    """Figures of the whole bibliography."""
    e = audit.load_entries(spark, d)
    return entries.summary(e, entries.issues(e), entries.dangling(table(spark, d, "contexts"), e, ["bib_file", "key"]))


@query(f"""WITH {E} SELECT entry_id, coalesce(nullif(trim(regexp_replace(regexp_replace(coalesce(raw_fields['journal'], ''), '[{{}}]', '', 'g'), '\\s+', ' ', 'g')), ''),
    nullif(trim(regexp_replace(regexp_replace(coalesce(raw_fields['booktitle'], ''), '[{{}}]', '', 'g'), '\\s+', ' ', 'g')), ''), '') AS venue,
    coalesce(entry_type = 'misc' AND ids.url IS NOT NULL AND ids.doi IS NULL AND ids.arxiv_id IS NULL AND ids.isbn13 IS NULL, false) AS web_only FROM e""")
def entry_venue(spark, d):
    """Venue from raw fields by preference, and whether only an address is cited."""
    return audit.load_entries(spark, d).select("entry_id", entries.venue_first(F.col("raw_fields")).alias("venue"), F.coalesce(entries.is_web_only(F.col("entry_type"), F.col("ids")), F.lit(False)).alias("web_only"))


@query(f"""WITH {E}, live AS (SELECT bib_file, key FROM e WHERE NOT coalesce(is_commented, false))
    SELECT entry_id FROM e ANTI JOIN live ON live.bib_file = e.bib_file AND live.key = e.key WHERE coalesce(e.is_commented, false)""")
def entry_twins(spark, d):
    """Commented-out entries whose key has no live entry."""
    return entries.split_commented(audit.load_entries(spark, d))[1].select("entry_id")


# ---- similarity ---------------------------------------------------------------------------------


@query(
    f"""WITH {PAIRS}, t AS (SELECT entry_id, record_id, e.year AS ey, r.year AS ry,
      list_filter(string_split({FOLD.format("coalesce(e.title, '')")}, ' '), lambda w: w <> '') AS x, list_filter(string_split({FOLD.format("coalesce(r.title, '')")}, ' '), lambda w: w <> '') AS y FROM p),
    k AS (SELECT *, coalesce(list_position(list_transform(range(1, CAST(least(len(x), len(y)) AS BIGINT) + 1), lambda i: x[i] = y[i]), false) - 1, least(len(x), len(y))) AS k FROM t),
    u AS (SELECT *, x[k + 1:] AS tx, y[k + 1:] AS ty FROM k),
    v AS (SELECT *, coalesce(len(list_intersect(tx, ty)) / nullif(len(list_distinct(list_concat(tx, ty))), 0), 0.0) AS j FROM u)
    SELECT entry_id, record_id, round(CAST(CASE WHEN ey IS NULL OR ry IS NULL THEN 1 ELSE 1 / (1 + pow(CAST(ey - ry AS DOUBLE) / 3, 2)) END AS DOUBLE), 6) AS year_factor,
      len(x) >= 4 AND len(y) >= 4 AND k >= 3 AND len(tx) > 0 AND len(ty) > 0 AND j < 0.34 AS prefix_trap FROM v"""
)
def sim_year_and_prefix(spark, d):
    """Year factor and prefix trap of entries and the records fetched for them."""
    x, y = F.col("e"), F.col("r")
    rows = pairs(spark, d).withColumn("a", text.tokens(x["title"])).withColumn("b", text.tokens(y["title"]))
    return rows.select("entry_id", "record_id", F.round(sim.year_factor(x["year"], y["year"]), 6).alias("year_factor"), sim.prefix_trap(F.col("a"), F.col("b")).alias("prefix_trap"))


_SETS = f"""WITH {PAIRS}, a AS (SELECT entry_id, record_id, 'e' AS s, unnest(e.authors) AS a FROM p UNION ALL SELECT entry_id, record_id, 'r', unnest(r.authors) FROM p),
    n AS (SELECT entry_id, record_id, s, {_NAME.format('a')} AS n FROM a), l AS (SELECT entry_id, record_id, s, {_LAST} AS l FROM n WHERE rtrim(n) NOT IN ('others', 'et al', 'et al.', 'and others')),
    g AS (SELECT entry_id, record_id, coalesce(list(DISTINCT l) FILTER (s = 'e'), []) AS x, coalesce(list(DISTINCT l) FILTER (s = 'r'), []) AS y FROM l WHERE l <> '' GROUP BY entry_id, record_id)"""


@query(
    f"""{_SETS} SELECT entry_id, record_id, round(CAST(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS DOUBLE), 6) AS author_jaccard,
      len(x) > 0 AND len(y) > 0 AND (len(list_intersect(x, y)) = len(x) OR len(list_intersect(x, y)) = len(y)) AS author_subset FROM g"""
)
def sim_author_sets(spark, d):
    """Jaccard and containment of surname sets of entries and the records fetched for them."""
    rows = pairs(spark, d).withColumn("a", text.surnames(F.col("e.authors"))).withColumn("b", text.surnames(F.col("r.authors")))
    out = rows.filter((F.size("a") > 0) | (F.size("b") > 0))
    return out.select("entry_id", "record_id", F.round(sim.names_jaccard(F.col("a"), F.col("b")), 6).alias("author_jaccard"), sim.names_subset(F.col("a"), F.col("b")).alias("author_subset"))


_LOHI = "least(TRY_CAST(nullif(regexp_extract({0}, {1}, 1), '') AS INT), TRY_CAST(nullif(regexp_extract({0}, {1}, 2), '') AS INT))"


@query(
    f"""WITH {PAIRS}, t AS (SELECT entry_id, record_id, TRY_CAST(nullif(regexp_extract(e.pages, {_RANGE}, 1), '') AS INT) AS a, TRY_CAST(nullif(regexp_extract(e.pages, {_RANGE}, 2), '') AS INT) AS b,
      TRY_CAST(nullif(regexp_extract(r.pages, {_RANGE}, 1), '') AS INT) AS c, TRY_CAST(nullif(regexp_extract(r.pages, {_RANGE}, 2), '') AS INT) AS dd FROM p)
    SELECT entry_id, record_id, coalesce(a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND dd IS NOT NULL AND (greatest(c, dd) < least(a, b) OR greatest(a, b) < least(c, dd)), false) AS disjoint FROM t"""
)
def sim_pages(spark, d):
    """Whether the page ranges of an entry and a fetched record do not meet."""
    return pairs(spark, d).select("entry_id", "record_id", sim.pages_disjoint(text.page_range(F.col("e.pages")), text.page_range(F.col("r.pages"))).alias("disjoint"))


_ETAL = "('others', 'et al', 'et al.', 'and others')"
_SURNAMES = f"list_distinct(list_filter(list_transform(list_filter(list_transform(coalesce({{}}, []), lambda a: {_NAME.format("coalesce(a, '')")}), lambda n: rtrim(n) NOT IN {_ETAL}), lambda n: {_LAST}), lambda l: l <> ''))"
_TITLE = f"""regexp_replace({FOLD.format("coalesce({}, '')")}, '\\s+', ' ', 'g')"""


@query(
    f"""WITH {PAIRS}, base AS (SELECT entry_id || '|' || record_id AS pid, entry_id, record_id, {_TITLE.format('e.title')} AS tx, {_TITLE.format('r.title')} AS ty, {_SURNAMES.format('e.authors')} AS nx, {_SURNAMES.format('r.authors')} AS ny,
      {_TITLE.format('e.venue')} AS vx, {_TITLE.format('r.venue')} AS vy FROM p), {fuzzy_sql.scored('base')}
    SELECT entry_id, record_id, round(CAST(title_ratio AS DOUBLE), 6) AS title_ratio, round(CAST(author_overlap AS DOUBLE), 6) AS author_overlap, round(CAST(venue AS DOUBLE), 6) AS venue FROM sc JOIN base USING (pid)"""
)
def sim_fuzzy(spark, d):
    """Title ratio, author overlap and venue compatibility of entries and fetched records."""
    rows = pairs(spark, d)
    both = rows.select("entry_id", "record_id", "e", "r", *score.prepare(F.col("e"), "e"), *score.prepare(F.col("r"), "r"))
    out = score.ratios(both, F.col("e"), F.col("r"), "e", "r").withColumn("venue", sim.venue_compatible(F.col("e.venue"), F.col("r.venue")))
    return out.select("entry_id", "record_id", *[F.round(c, 6).alias(c) for c in ("title_ratio", "author_overlap", "venue")])


@query()
def sim_mismatched_authors(spark, d):
    """Cited authors without a like surname in a fetched record."""
    rows = pairs(spark, d).withColumn("m", sim.mismatched_authors(F.col("e.authors"), F.col("r.authors")))
    return rows.filter(F.size("m") > 0).select("entry_id", "record_id", F.array_join("m", " | ").alias("authors"))


# ---- source queries and caches ------------------------------------------------------------------


@query("SELECT entry_hash, bool_or(error IS NOT NULL) AS errored FROM source_results GROUP BY entry_hash")
def source_errors(spark, d):
    """Whether any query of an entry failed."""
    return score.errored(table(spark, d, "source_results"))


@query(
    """SELECT entry_hash, source, query_kind, arg_max(payload, fetched_at) AS payload, max(fetched_at) AS fetched_at FROM source_results WHERE error IS NULL GROUP BY ALL"""
)
def cache_kept(spark, d):
    """Answers worth keeping: the latest success of every query."""
    return resolve.cacheable(table(spark, d, "source_results")).select("entry_hash", "source", "query_kind", "payload", "fetched_at")


_WANTED = f"""w AS (SELECT DISTINCT e.content_hash AS entry_hash, q.source, q.query_kind FROM e JOIN (SELECT entry_id, unnest(s) AS source, k AS query_kind FROM
      (SELECT entry_id, {_BY_ID} AS s, 'id' AS k FROM e UNION ALL SELECT entry_id, {_BY_META}, 'metadata' FROM e)) q ON q.entry_id = e.entry_id)"""


def wanted(spark, d):
    e = audit.load_entries(spark, d)
    return entries.route(e).join(e.select("entry_id", F.col("content_hash").alias("entry_hash")), "entry_id").select("entry_hash", "source", "query_kind").distinct()


@query(f"WITH {E}, {_WANTED} SELECT w.* FROM w ANTI JOIN (SELECT * FROM source_results WHERE error IS NULL) c ON c.entry_hash = w.entry_hash AND c.source = w.source AND c.query_kind = w.query_kind")
def cache_misses(spark, d):
    """Routed queries that no cached success answers."""
    return resolve.split_cache(wanted(spark, d), resolve.cacheable(table(spark, d, "source_results")), ["entry_hash", "source", "query_kind"])[1]


@query(f"WITH {E}, {_WANTED} SELECT w.* FROM w SEMI JOIN (SELECT * FROM source_results WHERE error IS NULL) c ON c.entry_hash = w.entry_hash AND c.source = w.source AND c.query_kind = w.query_kind")
def cache_hits(spark, d):
    """Routed queries that a cached success answers."""
    hits = resolve.split_cache(wanted(spark, d), resolve.cacheable(table(spark, d, "source_results")), ["entry_hash", "source", "query_kind"])[0]
    return hits.select("entry_hash", "source", "query_kind")


@query("SELECT lower(doi) AS doi, arg_max(resolves, checked_at) FILTER (resolves IS NOT NULL) AS resolves FROM doi_resolution GROUP BY lower(doi)")
def doi_status(spark, d):
    """Latest definite answer on whether a DOI resolves."""
    return resolve.doi_resolution(table(spark, d, "doi_resolution"))


@query()
def query_addresses(spark, d):
    """The address every routed query would ask."""
    e = audit.load_entries(spark, d).select("entry_id", "entry_type", "ids", "title", "authors")
    return connectors.query_urls(entries.route(e).join(e, "entry_id")).select("entry_id", "source", "query_kind", "address")


# ---- payloads -----------------------------------------------------------------------------------

_JSON = "json_extract_string(p, '{}')"
_UNWRAP = "coalesce(json_extract(raw, '$.message'), json_extract(raw, '$.entry'), json_extract(raw, '$.info'), json_extract(raw, '$.data[0]'), json_extract(raw, '$.docs[0]'), raw::JSON)"


def _payload(source: str) -> str:
    return f"{R}, q AS (SELECT record_id, raw FROM r WHERE source = '{source}' AND json_valid(raw) AND regexp_matches(raw, '^\\s*[\\[{{]')), x AS (SELECT record_id, {_UNWRAP} AS p FROM q)"


def projected(spark, d, source):
    r = table(spark, d, "source_records").filter(F.col("source") == source).select("record_id", "source", "raw")
    return payloads.project(r.dropDuplicates(["record_id"]), source)


@query(
    f"""WITH {_payload('crossref')} SELECT record_id, coalesce(trim(json_extract_string(p, '$.title[0]')), '') AS title,
      TRY_CAST(json_extract_string(p, '$.issued."date-parts"[0][0]') AS INT) AS year, coalesce(trim(json_extract_string(p, '$."container-title"[0]')), '') AS venue,
      coalesce(trim({_JSON.format('$.page')}), '') AS pages, coalesce(trim({_JSON.format('$.publisher')}), '') AS publisher,
      lower(rtrim(nullif(regexp_extract({_JSON.format('$.DOI')}, '10\\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+', 0, 'i'), ''), '.,;)')) AS doi,
      coalesce({_JSON.format('$.type')} = 'posted-content', false) AS is_preprint, coalesce(TRY_CAST(json_extract_string(p, '$."is-referenced-by-count"') AS INT), 0) AS citation_count FROM x"""
)
def payload_crossref(spark, d):
    """Records from the registrant's payloads."""
    return projected(spark, d, "crossref").select("record_id", *[F.col(f"rec.{c}").alias(c) for c in ("title", "year", "venue", "pages", "publisher", "doi", "is_preprint", "citation_count")])


@query(
    f"""WITH {_payload('openalex')}, y AS (SELECT record_id, p, trim(coalesce({_JSON.format('$.biblio.first_page')}, '')) AS a, trim(coalesce({_JSON.format('$.biblio.last_page')}, '')) AS b FROM x)
    SELECT record_id, coalesce(nullif(trim({_JSON.format('$.title')}), ''), trim({_JSON.format('$.display_name')}), '') AS title, TRY_CAST({_JSON.format('$.publication_year')} AS INT) AS year,
      CASE WHEN a <> '' AND b <> '' AND a <> b THEN a || '--' || b ELSE coalesce(nullif(a, ''), b) END AS pages,
      CASE WHEN contains(lower({_JSON.format('$.id')}), '{HOST}') THEN upper(nullif(regexp_extract({_JSON.format('$.id')}, '\\bW[0-9]+\\b', 0, 'i'), '')) END AS work,
      coalesce(TRY_CAST({_JSON.format('$.cited_by_count')} AS INT), 0) AS citation_count FROM y"""
)
def payload_openalex(spark, d):
    """Records from the catalogue's payloads."""
    r = table(spark, d, "source_records").filter((F.col("source") == "openalex") & F.try_parse_json("raw").isNotNull() & F.col("raw").rlike(r"^\s*[\[{]")).dropDuplicates(["record_id"])
    rec = payloads.openalex(payloads.unwrap(F.col("raw")), HOST)
    return r.withColumn("rec", rec).select("record_id", "rec.title", "rec.year", "rec.pages", F.col("rec.openalex").alias("work"), "rec.citation_count")


@query(
    f"""WITH {_payload('semantic_scholar')} SELECT record_id, coalesce(trim({_JSON.format('$.title')}), '') AS title, TRY_CAST({_JSON.format('$.year')} AS INT) AS year,
      coalesce(trim({_JSON.format('$.venue')}), '') AS venue, coalesce(trim({_JSON.format('$.paperId')}), '') AS native, coalesce(TRY_CAST({_JSON.format('$.citationCount')} AS INT), 0) AS citation_count FROM x"""
)
def payload_semantic_scholar(spark, d):
    """Records from paper-graph payloads."""
    return projected(spark, d, "semantic_scholar").select("record_id", "rec.title", "rec.year", "rec.venue", F.col("rec.source_native_id").alias("native"), "rec.citation_count")


_ITEMS = "CASE json_type(p, '{0}') WHEN 'ARRAY' THEN json_extract(p, '{0}[*]') WHEN 'OBJECT' THEN [json_extract(p, '{0}')] WHEN 'VARCHAR' THEN [json_extract(p, '{0}')] ELSE [] END"


def _authors_sql(source: str) -> str:
    """SQL for the authors of one kind of payload, as an array."""
    path = {"dblp": "$.authors.author", "crossref": "$.author", "openalex": "$.authorships", "openlibrary": "$.author_name", "google_books": "$.volumeInfo.authors"}.get(source, "$.authors")
    one = {
        "crossref": "coalesce(nullif(trim(concat_ws(' ', a ->> 'given', a ->> 'family')), ''), trim(a ->> 'name'))", "openalex": "trim(a ->> '$.author.display_name')", "semantic_scholar": "trim(a ->> 'name')",
        "dblp": "regexp_replace(trim(CASE WHEN json_type(a) = 'OBJECT' THEN coalesce(a ->> 'text', '') ELSE a ->> '$' END), '\\s+[0-9]{4}$', '')",
    }.get(source, "trim(a ->> '$')")
    return f"""SELECT record_id, '{source}' AS source, array_to_string(list_filter(list_transform({_ITEMS.format(path)}, lambda a: coalesce({one}, '')), lambda x: x <> ''), ' | ') AS authors
      FROM (SELECT record_id, {_UNWRAP} AS p FROM r WHERE source = '{source}' AND json_valid(raw) AND regexp_matches(raw, '^\\s*[\\[{{]'))"""


@query(f"WITH {R} " + " UNION ALL ".join(_authors_sql(s) for s in payloads.BY_SOURCE))
def payload_authors(spark, d):
    """Authors as written in every kind of payload."""
    out = None
    for source in payloads.BY_SOURCE:
        one = projected(spark, d, source).select("record_id", F.lit(source).alias("source"), F.array_join("rec.authors", " | ").alias("authors"))
        out = one if out is None else out.union(one)
    return out


# ---- manuscripts --------------------------------------------------------------------------------

_CTX = "c AS (SELECT DISTINCT bib_file, key, ordinal, text, command FROM contexts)"
_CITE_RE = latex.CITE.replace("'", "''")


@query(
    f"""WITH {_CTX}, s AS (SELECT bib_file, key, ordinal, regexp_replace(text, '{_CITE_RE}', '', 'g') AS t FROM c)
    SELECT bib_file, key, ordinal, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\\\[A-Za-z]+\\*?', '', 'g'), '[{{}}~\\\\]', ' ', 'g'), '\\s+', ' ', 'g'), '\\s+([.,;:!?])', '\\1', 'g')) AS clean FROM s"""
)
def context_clean(spark, d):
    """Citing sentences without commands."""
    c = table(spark, d, "contexts").select("bib_file", "key", "ordinal", "text", "command").distinct()
    return c.select("bib_file", "key", "ordinal", latex.strip_cites(F.col("text")).alias("clean"))


@query(f"WITH {_CTX}, {E} SELECT e.entry_id, c.ordinal, c.command FROM c JOIN e ON e.bib_file = c.bib_file AND e.key = c.key")
def context_entries(spark, d):
    """Citing sentences joined to their entries."""
    c = table(spark, d, "contexts").select("bib_file", "key", "ordinal", "text", "command").distinct()
    return c.join(audit.load_entries(spark, d).select("entry_id", "bib_file", "key"), ["bib_file", "key"]).select("entry_id", "ordinal", "command")


@query(
    f"""WITH {_CTX} SELECT bib_file, key, text, CAST(row_number() OVER (PARTITION BY bib_file, key ORDER BY ordinal, text) - 1 AS INT) AS place FROM c"""
)
def context_order(spark, d):
    """Occurrences of every key counted anew."""
    from pyspark.sql import Window

    c = table(spark, d, "contexts").select("bib_file", "key", "ordinal", "text", "command").distinct()
    return c.select("bib_file", "key", "text", (F.row_number().over(Window.partitionBy("bib_file", "key").orderBy("ordinal", "text")) - 1).alias("place"))


@query(
    f"""WITH t AS (SELECT DISTINCT bib_file, regexp_replace(text, '(^|[^\\\\])%[^\n]*', '\\1', 'g') AS body FROM contexts), c AS (SELECT bib_file, unnest(regexp_extract_all(body, '{_CITE_RE}', 2)) AS ks FROM t),
    k AS (SELECT bib_file, trim(unnest(string_split(ks, ','))) AS key FROM c) SELECT DISTINCT bib_file AS tex_file, key FROM k WHERE key <> ''"""
)
def context_keys(spark, d):
    """Keys named by the cite commands inside the citing sentences."""
    return latex.cited_keys(table(spark, d, "contexts").select(F.col("bib_file").alias("tex_file"), "text"))


@query(
    f"""WITH {E} SELECT bib_file, key, entry_type AS raw_type, is_commented, CAST(cardinality(raw_fields) AS INT) AS n_fields, trim(raw_fields['year']) AS year FROM e WHERE NOT is_commented"""
)
def bib_parsed(spark, d):
    """Entries written out as BibTeX and read again, with their number of fields."""
    e = audit.load_entries(spark, d).filter("not is_commented")
    balanced = F.length(F.regexp_replace("v", "[^{]", "")) == F.length(F.regexp_replace("v", "[^}]", ""))
    cell = e.select("entry_id", F.explode("raw_fields").alias("k", "v")).withColumn("v", F.when(balanced, F.col("v")).otherwise(F.translate("v", "{}", "")))
    cell = cell.withColumn("v", F.regexp_replace("v", r"\\+$", ""))
    body = cell.groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("k", F.lit(" = {"), "v", F.lit("}")))), ",\n  ").alias("b"))
    # one file per entry, as keys repeat between files
    text_of = F.concat(F.lit("@"), "entry_type", F.lit("{"), "key", F.lit(",\n  "), "b", F.lit("\n}\n"))
    files = e.join(body, "entry_id").select(F.concat_ws("|", "bib_file", "entry_id").alias("bib_file"), text_of.alias("text"))
    got = bibtex.parse_texts(files)
    return got.select(F.split_part("bib_file", F.lit("|"), F.lit(1)).alias("bib_file"), "key", "raw_type", "is_commented", F.size("fields").alias("n_fields"), F.trim(F.element_at("fields", "year")).alias("year"))


@query(
    f"""WITH {R} SELECT record_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, year, len(list_distinct(authors)) AS n_authors FROM r"""
)
def web_metadata(spark, d):
    """Records written out as pages that declare their metadata and read again."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    meta = lambda k, v: F.concat(F.lit(f'<meta name="{k}" content="'), safe(v), F.lit('">'))
    r = audit.load_records(spark, d)
    head = F.concat(
        F.lit("<html><head><title>x</title>"), meta("citation_title", text.collapse(F.col("title"))), F.array_join(F.transform("authors", lambda a: meta("citation_author", a)), ""),
        F.coalesce(meta("citation_date", F.col("year").cast("string")), F.lit("")), F.lit("</head><body>text</body></html>"),
    )
    pages = r.select(F.col("record_id").cast("string").alias("url"), F.lit(200).alias("status"), head.alias("html"))
    return html.metadata(pages).select(F.col("url").cast("bigint").alias("record_id"), "title", "year", F.size("authors").cast("bigint").alias("n_authors"))


@query()
def tex_contexts(spark, d):
    """Manuscripts put together from their citing sentences and read again: occurrences per key."""
    c = table(spark, d, "contexts").select("bib_file", "key", "ordinal", "text").distinct()
    docs = c.groupBy("bib_file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", "key", "text")))["text"], "\n\n").alias("text"))
    return latex.contexts(docs.select(F.col("bib_file").alias("tex_file"), "text")).groupBy("tex_file", "key").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_payload('dblp')} SELECT record_id, regexp_replace(coalesce(trim({_JSON.format('$.title')}), ''), '\\.$', '') AS title,
      CASE WHEN regexp_matches({_JSON.format('$.year')}, '^[0-9]+$') THEN TRY_CAST({_JSON.format('$.year')} AS INT) END AS year, coalesce(trim({_JSON.format('$.key')}), '') AS native FROM x"""
)
def payload_dblp(spark, d):
    """Records from computer-science bibliography hits."""
    return projected(spark, d, "dblp").select("record_id", "rec.title", "rec.year", F.col("rec.source_native_id").alias("native"))


# ---- pooling, scoring, verdicts -----------------------------------------------------------------

_CAND = f"{R}, k AS (SELECT *, record_id + CASE WHEN query_kind = 'id' THEN 0 ELSE {pool.SEARCHED} END AS ord FROM r WHERE entry_id IS NOT NULL)"


@query()
def pool_components(spark, d):
    """Components of the candidates of every entry, with their sizes."""
    return pool.pool(cut(audit.candidates(spark, d), "candidates"))


@query()
def pool_representatives(spark, d):
    """Merged records: where each came from and its best fields."""
    return audit.pooled(spark, d).select("entry", "ord", "title", "year", "venue", "pages", "publisher", "citation_count", "is_preprint", F.array_join("merged_from", "+").alias("merged_from"), "n_records")


def _best(field: str) -> str:
    rank = "list_min(list_transform(list_filter(list_concat([source], coalesce(merged_from, [])), lambda s: s IS NOT NULL), lambda s: CASE s " + " ".join(
        f"WHEN '{s}' THEN {i}" for i, s in enumerate(pool.FIELD_PRIORITY[field])
    ) + f" ELSE {len(pool.FIELD_PRIORITY[field])} END))"
    return f"arg_min(nullif(trim({field}), ''), {{'a': {rank}, 'b': ord}}) FILTER (trim(coalesce({field}, '')) <> '') AS {field}"


@query(f"WITH {_CAND} SELECT entry_id, {', '.join(_best(f) for f in ('venue', 'volume', 'issue', 'pages', 'publisher'))}, CAST(max(citation_count) AS INT) AS citation_count, bool_and(is_preprint) AS is_preprint FROM k GROUP BY entry_id")
def pool_best_fields(spark, d):
    """Best-source fields over all candidates of an entry."""
    rows = audit.candidates(spark, d).withColumnRenamed("entry_id", "entry")
    want = {"venue", "volume", "issue", "pages", "publisher", "citation_count", "is_preprint"}
    got = rows.groupBy(F.col("entry").alias("entry_id")).agg(*pool.representative_columns())
    return got.select("entry_id", *[c for c in ("venue", "volume", "issue", "pages", "publisher", "citation_count", "is_preprint") if c in want])


@query(
    f"""WITH {_CAND} SELECT entry_id, arg_max(trim(abstract), {{'l': length(trim(abstract)), 'o': -ord}}) AS abstract FROM k WHERE trim(coalesce(abstract, '')) <> '' GROUP BY entry_id"""
)
def best_abstracts(spark, d):
    """Longest abstract of every entry's candidates."""
    return resolve.best_abstract(audit.candidates(spark, d))


_RANKS = "CASE source WHEN 'publisher' THEN 0 WHEN 'crossref' THEN 1 WHEN 'openalex' THEN 2 WHEN 'openlibrary' THEN 3 WHEN 'semantic_scholar' THEN 4 WHEN 'arxiv' THEN 5 ELSE 9 END"


@query(
    f"""WITH {_CAND}, c AS (SELECT entry_id, source, {{'p': coalesce(is_preprint, false), 'k': {_RANKS}, 'o': ord}} AS o,
      unnest([{{'field': 'title', 'value': title}}, {{'field': 'venue', 'value': venue}}, {{'field': 'year', 'value': CAST(year AS VARCHAR)}}, {{'field': 'volume', 'value': volume}},
        {{'field': 'number', 'value': issue}}, {{'field': 'pages', 'value': pages}}, {{'field': 'publisher', 'value': publisher}}], recursive := true) FROM k),
    v AS (SELECT entry_id, field, trim(value) AS value, min(o) AS o, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources FROM c WHERE trim(coalesce(value, '')) <> '' GROUP BY entry_id, field, trim(value))
    SELECT entry_id, field, arg_min(value, o) AS value, arg_min(sources, o) AS sources FROM v GROUP BY entry_id, field"""
)
def field_canonical(spark, d):
    """Canonical value of every field of every entry's candidates."""
    return fields.canonical_values(audit.candidates(spark, d)).select("entry_id", "field", "value", F.array_join("sources", "+").alias("sources"))


@query()
def candidate_features(spark, d):
    """Features and bucket of every entry and representative."""
    a = audit.assess(audit.load_entries(spark, d), audit.pooled(spark, d))
    return a.select("entry_id", "ord", *[F.round(c, 6).alias(c) if c in ("title_ratio", "author_overlap", "venue_compatible", "year_factor", "author_set_jaccard", "composite") else F.col(c) for c in audit.FEATURES], "bucket")


@query()
def candidate_top(spark, d):
    """The candidates that would be adjudicated, best eight per entry."""
    a = audit.assess(audit.load_entries(spark, d), audit.pooled(spark, d))
    return score.top_candidates(a).select("entry_id", "ord", "rank")


@query()
def verdicts(spark, d):
    """Verdict of every entry."""
    return audit.verdicts(spark, d)


@query()
def final_verdicts(spark, d):
    """Verdict of every entry after pinned ids and book editions."""
    return audit.final_verdicts(spark, d)


@query()
def verdict_counts(spark, d):
    """Entries by final verdict, zero-filled."""
    return score.verdict_counts(spark, audit.final_verdicts(spark, d))


@query()
def backfilled(spark, d):
    """Identifiers that matched records add to entries."""
    e = cut(audit.load_entries(spark, d), "entries")
    a = audit.assess(e, audit.pooled(spark, d))
    return resolve.backfill_notes(e, audit.best_records(a), resolve.doi_resolution(table(spark, d, "doi_resolution")))


@query()
def better_versions(spark, d):
    """Published versions, newer preprints and later editions of what is cited."""
    e = cut(audit.load_entries(spark, d), "entries")
    return books.better_versions(e, audit.best_records(audit.assess(e, audit.pooled(spark, d))))


@query(
    f"""WITH {_CAND}, x AS (SELECT entry_id, ord, year FROM k WHERE year IS NOT NULL) SELECT entry_id, arg_max(ord, {{'y': year, 'o': -ord}}) AS ord, max(year) AS year FROM x GROUP BY entry_id"""
)
def latest_editions(spark, d):
    """Newest dated candidate of every entry, the first on ties."""
    return books.latest_edition(audit.candidates(spark, d))


@query()
def report(spark, d):
    """Verdict, issues and category of every entry."""
    return audit.report(spark, d)


@query()
def report_lines(spark, d):
    """Lines of the text report."""
    return resolve.report_lines(audit.report(spark, d))


# ---- smaller joins and aggregates ---------------------------------------------------------------


@query(
    f"""WITH {PAIRS}, k AS (SELECT entry_id, record_id, {_ISBN.format('e')} AS a, {_ISBN.format('r')} AS b, e.ids AS x, r.ids AS y FROM p)
    SELECT entry_id, record_id, coalesce(x.doi = y.doi, false) OR coalesce(x.arxiv_id = y.arxiv_id, false) OR len(list_intersect(a, b)) > 0 AS shared FROM k"""
)
def id_shared(spark, d):
    """Whether an entry and a fetched record share a strong identifier."""
    return pairs(spark, d).select("entry_id", "record_id", ids.shares_strong_id(F.col("e.ids"), F.col("r.ids")).alias("shared"))


_TOKENS = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH {E}, {R}, t AS (SELECT e.entry_id, r.record_id, {_TOKENS.format('e.publisher')} AS x, {_TOKENS.format('r.publisher')} AS y FROM e JOIN r ON r.entry_id = e.entry_id)
    SELECT entry_id, record_id, x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) AS compatible FROM t"""
)
def text_publishers(spark, d):
    """Whether the publishers of an entry and a fetched record agree or hold one another."""
    e = audit.load_entries(spark, d).select("entry_id", F.col("publisher").alias("p"))
    r = audit.load_records(spark, d).filter("entry_id is not null").select("entry_id", "record_id", F.col("publisher").alias("q"))
    return e.join(r, "entry_id").select("entry_id", "record_id", text.compatible(F.col("p"), F.col("q")).alias("compatible"))


@query(
    f"""WITH {_CAND}, x AS (SELECT entry_id, ord, ids.doi AS doi FROM k WHERE ids.doi IS NOT NULL AND NOT starts_with(ids.doi, '10.48550/arxiv'))
    SELECT entry_id, arg_min(doi, ord) AS published_doi FROM x GROUP BY entry_id"""
)
def published_dois(spark, d):
    """First published DOI among the candidates of every entry."""
    return books.find_published_doi(audit.candidates(spark, d))


@query(f"WITH {_CAND} SELECT entry_id, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources FROM k GROUP BY entry_id")
def consulted_sources(spark, d):
    """Sources that gave candidates for every entry."""
    return fields.consulted_sources(audit.candidates(spark, d)).select("entry_id", F.array_join("sources", "+").alias("sources"))


_EDITIONS = f"""{_CAND}, b AS (SELECT *, coalesce(ids.isbn13, nullif(source_native_id, ''), concat_ws('|', CAST(year AS VARCHAR), publisher)) AS kk FROM k WHERE source IN ('openlibrary', 'google_books')),
    ed AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY entry_id, kk ORDER BY ord) = 1)"""


@query(f"WITH {_EDITIONS} SELECT entry_id, ord, source_native_id FROM ed")
def edition_rows(spark, d):
    """Book records of every entry, each edition once."""
    return books.dedup_editions(audit.candidates(spark, d).filter(F.col("source").isin("openlibrary", "google_books"))).select("entry_id", "ord", "source_native_id")


@query(
    f"""WITH {_EDITIONS}, {E}, m AS (SELECT e.entry_id, ed.ord, CASE WHEN len(list_intersect({_ISBN.format('e')}, {_ISBN.format('ed')})) > 0 THEN 0
      WHEN e.year = ed.year AND {_TOKENS.format('e.publisher')} <> '' AND {_TOKENS.format('ed.publisher')} <> '' AND (contains({_TOKENS.format('e.publisher')}, {_TOKENS.format('ed.publisher')})
        OR contains({_TOKENS.format('ed.publisher')}, {_TOKENS.format('e.publisher')})) THEN 1 WHEN e.year = ed.year THEN 2 END AS priority
      FROM e JOIN ed ON ed.entry_id = e.entry_id WHERE e.entry_type IN ('book', 'incollection'))
    SELECT entry_id, arg_min(ord, {{'p': priority, 'o': ord}}) AS ord, min(priority) AS priority FROM m WHERE priority IS NOT NULL GROUP BY entry_id"""
)
def edition_cited(spark, d):
    """The edition every book entry cites: by ISBN, then year and publisher, then year."""
    editions = books.dedup_editions(audit.candidates(spark, d).filter(F.col("source").isin("openlibrary", "google_books")))
    return books.match_cited_edition(audit.load_entries(spark, d), editions)


@query(f"WITH {R} SELECT record_id, ids.doi AS doi, CASE WHEN NOT starts_with(ids.doi, '10.48550/arxiv') THEN ids.doi END AS published FROM r WHERE ids.doi IS NOT NULL")
def record_dois(spark, d):
    """DOIs of records, and those that name a published artifact."""
    r = audit.load_records(spark, d).filter("ids.doi is not null")
    return r.select("record_id", F.col("ids.doi").alias("doi"), ids.published_doi(F.col("ids.doi")).alias("published"))


@query("SELECT source, query_kind, count(*) AS n, count(*) FILTER (error IS NOT NULL) AS n_errors, max(fetched_at) AS latest FROM source_results GROUP BY ALL")
def source_health(spark, d):
    """Queries, failures and last contact per source and kind."""
    return table(spark, d, "source_results").groupBy("source", "query_kind").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.max("fetched_at").alias("latest"))


@query()
def questions(spark, d):
    """The questions an adjudicator would be asked about candidates, best eight per entry."""
    from citeloom.operators import adjudicate

    a = audit.assess(audit.load_entries(spark, d), audit.pooled(spark, d))
    return adjudicate.with_hash(adjudicate.candidate_questions(score.top_candidates(a))).select("entry_id", "ord", "prompt_hash")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return verdict_counts(spark, d)
