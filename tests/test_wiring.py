"""The audit with a judge, the editions fan-out and the web evidence, on planted rows."""

import pytest
from pyspark.sql import functions as F

from citeloom.operators import adjudicate, books, resolve
from citeloom.plans import audit


def test_answers_become_rulings(spark):
    def judge(prompts):
        return ['{"answer": "%s", "confidence": "%s"}' % (("yes", "high") if "alpha" in p else ("no", "medium") if "beta" in p else ("yes", "low")) for p in prompts]

    rows = [("e1", 0, "adjudicate", "alpha"), ("e2", 0, "adjudicate", "beta"), ("e3", 0, "adjudicate", "gamma"), ("e4", 0, "auto_reject", "alpha")]
    assessed = spark.createDataFrame(rows, "entry_id string, ord int, bucket string, t string")
    asked = assessed.select("entry_id", "ord", adjudicate.prompt("can_correspond", title=F.col("t")).alias("prompt"))
    answers = adjudicate.ask(asked, "can_correspond", "m", judge)
    got = {r.entry_id: r.bucket for r in resolve.apply_rulings(assessed, adjudicate.rulings(answers, ["entry_id", "ord"])).collect()}
    assert got == {"e1": "auto_accept", "e2": "auto_reject", "e3": "adjudicate", "e4": "auto_reject"}
    none = adjudicate.rulings(adjudicate.ask(asked, "can_correspond", "m", None), ["entry_id", "ord"])
    failed = {r.entry_id: (r.bucket, r.errored) for r in resolve.apply_rulings(assessed, none).collect()}
    assert failed["e1"] == ("adjudicate", True)


def test_questions_about_pairs_and_pages(spark):
    rec = "struct<title:string,authors:array<string>,year:int,venue:string,pages:string>"
    pairs = spark.createDataFrame([("e", 1, 2, ("T one", ["A"], 2000, None, ""), ("T two", ["B"], None, "V", ""))], f"entry_id string, a int, b int, ra {rec}, rb {rec}")
    asked = adjudicate.relation_questions(pairs)
    assert "title_a: T one" in asked.first().prompt and "venue_a: (none)" in asked.first().prompt
    judged = adjudicate.ask(asked, "same_work", "m", lambda ps: ['{"relation": "version", "confidence": "medium"}'] * len(ps))
    assert [tuple(r) for r in adjudicate.confirmed_pairs(judged).collect()] == [("e", 1, 2)]
    pages = spark.createDataFrame([("e", "T", ["A"], "Page T", "x" * 9000)], "entry_id string, title string, authors array<string>, page_title string, page_text string")
    assert len(adjudicate.page_questions(pages).first().prompt) < adjudicate.TEXT_CAP + 500


def test_works_and_editions(spark):
    entries = spark.createDataFrame([("b", "book", "Modern Theory of Things"), ("a", "article", "Modern Theory of Things")], "entry_id string, entry_type string, title string")
    works = [("b", f"w{i}", "Modern theory of things (Series, No. 4)", False, i) for i in range(9)] + [("b", "x", "Another book", False, 0), ("b", "y", "Quite another", True, 50), ("b", "y", "Quite another", False, 1)]
    found = books.works_of(entries, spark.createDataFrame(works, "entry_id string, work string, title string, by_isbn boolean, ord long"))
    assert [r.work for r in found.orderBy("ord").collect()] == ["w0", "w1", "w2", "w3", "w4", "y"]  # six at most, by ISBN first
    ids = "struct<isbn13:string>"
    rows = [("y", ("9780000000001",), "n1", 2000, "P", 0), ("y", ("9780000000001",), "n2", 2001, "P", 1), ("w0", (None,), "n3", 2002, "P", 2)] + [("w1", (None,), f"m{i}", 1990, "P", i) for i in range(60)]
    got = books.editions_of(found, spark.createDataFrame(rows, f"work string, ids {ids}, source_native_id string, year int, publisher string, ord long")).collect()
    assert sum(r.work == "w1" for r in got) == books.EDITIONS and {r.source_native_id for r in got if r.work != "w1"} == {"n1", "n3"}


@pytest.mark.parametrize("answer", ["yes", "no"])
def test_report_with_a_judge(spark, sf, answer):
    def judge(prompts):
        kinds = {"Does this record": f'{{"answer": "{answer}", "confidence": "high"}}', "How are these": '{"relation": "different", "confidence": "high"}', "Is the cited": '{"kind": "variant", "confidence": "high"}'}
        return [next((a for k, a in kinds.items() if p.startswith(k)), "no json") for p in prompts]

    plain = {r.entry_id: r for r in audit.report(spark, sf).collect()}
    ruled = {r.entry_id: r for r in audit.report(spark, sf, judge, "m").collect()}
    assert set(plain) == set(ruled)
    settled = lambda rows: sum(r.kind is not None for r in rows.values())
    assert settled(ruled) >= settled(plain)
    assert sum(r.n_formatting for r in ruled.values()) > sum(r.n_formatting for r in plain.values())  # variants become nits
