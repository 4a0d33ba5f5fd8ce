from pyspark.sql import functions as F

from citeloom.operators import fields, resolve


def test_verdict_cache_is_bound_to_version_and_model(spark):
    rows = spark.createDataFrame([("h", "1", "m", "none"), ("h", "0", "m", "none"), ("k", "1", "x", "none")], "entry_hash string, pipeline_version string, model string, kind string")
    assert [r.entry_hash for r in resolve.valid_verdicts(rows, "1", "m").collect()] == ["h"]


def test_stale_pages(spark):
    rows = spark.createDataFrame([("a", "web", '{"dead": true}'), ("b", "web", '{"render": "ok"}'), ("c", "web", '{"title": "t"}'), ("d", "dblp", "{}")], "entry_hash string, source string, payload string")
    assert [r.entry_hash for r in resolve.stale_pages(rows).collect()] == ["c"]


def test_merge_replaces_by_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, resolve.merge_cache(old, new, ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_judgments(spark):
    f = spark.createDataFrame([("e", 0, "title", "a", "b", ["x"], "needs_llm"), ("e", 1, "venue", "a", "b", ["x"], "needs_llm"), ("e", 2, "publisher", "a", "b", ["x"], "needs_llm"), ("e", 3, "year", "1", "2", ["x"], "error"), ("e", 4, "pages", "", "", ["x"], "unverifiable")],
                              "entry_id string, pos int, field string, bib_value string, canonical_value string, sources array<string>, status string")
    j = spark.createDataFrame([("e", "title", "variant", "low"), ("e", "venue", "error", "high"), ("e", "publisher", "error", "low")], "entry_id string, field string, kind string, confidence string")
    assert {r.field: r.status for r in fields.apply_judgments(f, j).collect()} == {"title": "formatting", "venue": "error", "publisher": "uncertain", "year": "error", "pages": "unverifiable"}
    assert {r.status for r in fields.apply_judgments(f).collect()} == {"uncertain", "error", "unverifiable"}
    assert fields.unverifiable_line(f).first().fields == "pages"
    assert fields.first_finding(f).first().field == "year"
    assert "vs" in fields.notes(f).first().note


def test_rulings(spark):
    a = spark.createDataFrame([("e", 0, "adjudicate"), ("e", 1, "adjudicate"), ("e", 2, "adjudicate"), ("e", 3, "auto_accept"), ("e", 4, "adjudicate")], "entry_id string, ord int, bucket string")
    r = spark.createDataFrame([("e", 0, True, "high", None), ("e", 1, False, "medium", None), ("e", 2, True, "low", None), ("e", 3, False, "high", None), ("e", 4, None, None, "down")], "entry_id string, ord int, answer boolean, confidence string, error string")
    got = {x.ord: (x.bucket, x.errored) for x in resolve.apply_rulings(a, r).collect()}
    assert got == {0: ("auto_accept", False), 1: ("auto_reject", False), 2: ("adjudicate", False), 3: ("auto_accept", False), 4: ("adjudicate", True)}


def test_backfill_tells_resolution_apart(spark):
    ids = "struct<doi:string,arxiv_id:string,isbn13:string,isbn13s:array<string>,pmid:string,bibcode:string,openalex:string,google_books:string,url:string>"
    none = (None,) * 9
    e = spark.createDataFrame([(k, none, "Transactions on Machine Learning Research") for k in "abcd"], f"entry_id string, ids {ids}, venue string")
    d = lambda x: (x, *([None] * 8))
    best = spark.createDataFrame([("a", d("10.1000/a"), "V"), ("b", d("10.1000/b"), "V"), ("c", d("10.1000/c"), "V"), ("d", none, "V")], f"entry_id string, ids {ids}, venue string")
    res = spark.createDataFrame([("10.1000/A", True), ("10.1000/b", False), ("10.1000/c", None)], "doi string, resolves boolean").withColumn("checked_at", F.current_timestamp())
    got = {r.entry_id: r.kind for r in resolve.backfill_notes(e, best, resolve.doi_resolution(res)).collect()}
    assert got == {"a": "doi_found", "b": "doi_does_not_resolve", "c": "doi_unconfirmed", "d": "no_doi_expected"}
