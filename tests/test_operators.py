from pyspark.sql import functions as F

from citeloom.operators import books, fields, pool, resolve, score

IDS = "struct<doi:string,arxiv_id:string,isbn13:string,isbn13s:array<string>,pmid:string,bibcode:string,openalex:string,google_books:string,url:string>"
REC = f"entry_id string, ord int, source string, title string, authors array<string>, year int, venue string, volume string, issue string, pages string, publisher string, abstract string, ids {IDS}, is_preprint boolean, edition int, citation_count int, version_links array<string>, openalex_work_id string, merged_from array<string>, source_native_id string"


def rec(entry, ord, title="A study of complex dynamical things", authors=("Ann Lee",), source="crossref", doi=None, arxiv=None, isbn=None, year=2000, pre=False, links=(), venue="", pages="", cites=0, abstract=""):
    return (entry, ord, source, title, list(authors), year, venue, "", "", pages, "", abstract, (doi, arxiv, isbn, [], None, None, None, None, None), pre, None, cites, list(links), None, [], f"n{ord}")


def components(spark, rows):
    df = spark.createDataFrame(rows, REC)
    return {r.ord: r.comp for r in pool.pool(df).collect()}


def test_pool_rules(spark):
    assert components(spark, [rec("e", 0, doi="10.1000/a"), rec("e", 1, doi="10.1000/a", title="Other words entirely")]) == {0: 0, 1: 0}
    assert components(spark, [rec("e", 0, doi="10.1000/a", links=["https://arxiv.org/abs/1234.56789"]), rec("e", 1, arxiv="1234.56789", title="Quite another name")]) == {0: 0, 1: 0}
    assert components(spark, [rec("e", 0, doi="10.1000/a"), rec("e", 1, doi="10.1000/b")]) == {0: 0, 1: 1}  # two published DOIs stay apart
    assert components(spark, [rec("e", 0, doi="10.1000/a"), rec("e", 1, arxiv="1234.56789", pre=True)]) == {0: 0, 1: 0}  # preprint and published
    assert components(spark, [rec("e", 0, doi="10.1000/a"), rec("f", 1, doi="10.1000/a")]) == {0: 0, 1: 1}  # never across entries
    chain = [rec("e", i, doi=f"10.1000/{i}", title=f"title number {i} of many", links=[f"10.1000/{i + 1}"]) for i in range(12)]
    assert set(components(spark, chain).values()) == {0}


def test_representative(spark):
    rows = [rec("e", 0, source="semantic_scholar", doi="10.1000/a", venue="Complex", cites=50, abstract="short"), rec("e", 1, source="publisher", doi="10.1000/a", venue="Complexity", year=2001, abstract="a longer one")]
    df = spark.createDataFrame(rows, REC)
    r = pool.representatives(df, pool.pool(df)).first()
    assert (r.source, r.venue, r.year, r.abstract, r.citation_count, r.n_records) == ("semantic_scholar", "Complexity", 2001, "a longer one", 50, 2)
    assert r.merged_from == ["publisher", "semantic_scholar"]


def test_buckets(spark):
    cols = "title_ratio double, author_overlap double, author_subset boolean, author_set_jaccard double, prefix_trap boolean, pages_conflict boolean, id_agreement string, composite double, has boolean"
    rows = [
        (1.0, 1.0, True, 1.0, False, False, "match", 1.0, True), (0.93, 0.5, True, 0.5, False, False, "match", 0.6, True), (1.0, 1.0, True, 1.0, False, False, "absent", 1.0, True),
        (1.0, 1.0, True, 1.0, False, False, "absent", 1.0, False), (1.0, 1.0, True, 1.0, True, False, "match", 1.0, True), (0.93, 1.0, True, 1.0, False, True, "match", 1.0, True),
        (0.3, 0.0, False, 0.0, False, False, "absent", 0.2, False), (1.0, 0.0, False, 0.0, False, False, "match", 0.5, True),
    ]
    got = [r.b for r in spark.createDataFrame(rows, cols).select(score.bucket(F.col("has")).alias("b")).collect()]
    assert got == ["auto_accept", "auto_accept", "adjudicate", "auto_accept", "adjudicate", "adjudicate", "auto_reject", "adjudicate"]


def test_verdict(spark):
    rows = [(1, False, 3, False), (2, True, 3, False), (0, True, 0, False), (0, False, 0, False), (0, False, 2, True), (0, False, 2, False)]
    df = spark.createDataFrame(rows, "a int, e boolean, n int, r boolean").select(score.verdict(F.col("a"), F.col("e"), F.col("n"), F.col("r")).alias("v"))
    assert [(r.v.kind, r.v.confidence) for r in df.collect()] == [("exactly_one", "high"), ("multiple", "medium"), (None, None), ("none", "high"), ("none", "medium"), (None, None)]


def test_same_object_clusters(spark):
    rows = [rec("e", 0, doi="10.1000/a", pages="1-5"), rec("e", 1, doi="10.1000/a", pages="1-5"), rec("e", 2, doi="10.1000/b", pages="20-30")]
    df = spark.createDataFrame(rows, REC).select("entry_id", "ord", F.struct("title", "authors", "year", "venue", "pages", "ids", "is_preprint", "citation_count").alias("r"))
    assert {r.ord: r.comp for r in score.cluster_accepted(df).collect()} == {0: 0, 1: 0, 2: 2}
    rel = {(r.a, r.b): r.relation for r in score.relations(df).collect()}
    assert rel[(0, 1)] == "same" and rel[(0, 2)] == "distinct"


def test_field_checks(spark):
    canon = spark.createDataFrame([("e", "title", "Same Title", ["crossref"]), ("e", "venue", "arXiv", ["arxiv"]), ("e", "year", "2001", ["x"]), ("e", "pages", "1--10", ["x"]), ("e", "volume", "8", ["x"])], "entry_id string, field string, value string, sources array<string>")
    e = spark.createDataFrame([("e", "article", "same {title}", "J", 1999, "1-10", "", {"volume": "7", "number": "{}"}, (None,) * 9)], f"entry_id string, entry_type string, title string, venue string, year int, pages string, publisher string, raw_fields map<string,string>, ids {IDS}")
    got = {r.field: r.status for r in fields.field_findings(e, canon).collect()}
    assert got == {"title": "ok", "venue": "unverifiable", "year": "error", "pages": "formatting", "volume": "error", "number": "error"}


def test_editions(spark):
    e = spark.createDataFrame([("a", "book", 1976, "MIT Press", (None, None, "1", [], None, None, None, None, None)), ("b", "book", 1976, "MIT", (None,) * 9), ("c", "article", 1976, "", (None,) * 9)], f"entry_id string, entry_type string, year int, publisher string, ids {IDS}")
    eds = [("a", 0, 2018, "Other", (None, None, "1", [], None, None, None, None, None)), ("a", 1, 1976, "The MIT Press", (None,) * 9), ("b", 0, 1976, "Wiley", (None,) * 9), ("b", 1, 1976, "MIT Press", (None,) * 9)]
    ed = spark.createDataFrame(eds, f"entry_id string, ord int, year int, publisher string, ids {IDS}")
    assert {r.entry_id: (r.ord, r.priority) for r in books.match_cited_edition(e, ed).collect()} == {"a": (0, 0), "b": (1, 1)}
    assert {r.entry_id: (r.ord, r.year) for r in books.latest_edition(ed).collect()} == {"a": (0, 2018), "b": (0, 1976)}


def test_overrides(spark):
    rows = [("g", "none", False, None, False, False, False, True), ("m", "none", False, None, False, False, True, False), ("w", None, True, "exactly_one", False, False, False, False), ("p", "multiple", False, None, True, False, False, False)]
    df = spark.createDataFrame(rows, "entry_id string, generic string, web_only boolean, web string, work_pin boolean, volume_pin boolean, edition_matched boolean, edition_errored boolean")
    assert {r.entry_id: r.kind for r in resolve.override(df).collect()} == {"g": None, "m": "exactly_one", "w": "exactly_one", "p": "exactly_one"}


def test_web_verdict(spark):
    kind = "p struct<error:string,dead:boolean,rendered_empty:boolean,title_ratio:double,ruling:boolean,confidence:string>"
    rows = [(("x", False, False, 1.0, None, None),), ((None, True, False, 1.0, None, None),), ((None, False, False, 0.9, None, None),), ((None, False, False, 0.1, False, "high"),), ((None, False, False, 0.1, False, "low"),), ((None, False, False, 0.1, True, "medium"),)]
    assert [r.v for r in spark.createDataFrame(rows, kind).select(resolve.web_verdict(F.col("p")).alias("v")).collect()] == [None, None, "exactly_one", "none", None, "exactly_one"]


def test_caches(spark):
    rows = spark.createDataFrame([("h", "crossref", "id", None, "old", 1), ("h", "crossref", "id", None, "new", 2), ("h", "crossref", "id", "HTTP 503", None, 3), ("k", "dblp", "id", "x", None, 1)], "entry_hash string, source string, query_kind string, error string, payload string, fetched_at int")
    kept = resolve.cacheable(rows).collect()
    assert [(r.entry_hash, r.payload) for r in kept] == [("h", "new")]
    want = spark.createDataFrame([("h", "crossref", "id"), ("k", "dblp", "id")], "entry_hash string, source string, query_kind string")
    hits, misses = resolve.split_cache(want, resolve.cacheable(rows), ["entry_hash", "source", "query_kind"])
    assert hits.count() == 1 and [r.entry_hash for r in misses.collect()] == ["k"]


def test_alignment_never_contradicts_without_abstract(spark):
    c = spark.createDataFrame([("f", "k", 0, "s"), ("f", "k", 1, "t")], "bib_file string, key string, ordinal int, text string")
    e = spark.createDataFrame([("e", "f", "k")], "entry_id string, bib_file string, key string")
    none = spark.createDataFrame([], "entry_id string, abstract string")
    j = spark.createDataFrame([("e", 0, "contradicted", None)], "entry_id string, ordinal int, status string, error string")
    assert {r.status for r in resolve.align(c, e, none, j).collect()} == {"unverifiable"}
    a = spark.createDataFrame([("e", "text")], "entry_id string, abstract string")
    assert {r.ordinal: r.status for r in resolve.align(c, e, a, j).collect()} == {0: "contradicted", 1: "unverifiable"}


def test_gate_and_report(spark):
    rows = spark.createDataFrame([("a", "misc", "none", 1, 0, 0), ("b", "misc", None, 0, 0, 0), ("c", "misc", "exactly_one", 0, 1, 0), ("d", "misc", "exactly_one", 0, 0, 0)], "entry_id string, entry_type string, kind string, n_issues int, n_formatting int, n_advisories int")
    assert {r.entry_id: r.category for r in resolve.categories(rows).collect()} == {"a": "CAPITAL OFFENCES", "b": "UNABLE TO VERIFY", "c": "NITS", "d": "NO ISSUES"}
    assert resolve.gate(rows, "hallucinated") == 1 and resolve.gate(rows, "multiple") == 0
    assert resolve.report_json(rows).count() == 4
