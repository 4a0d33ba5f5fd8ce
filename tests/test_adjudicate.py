from pyspark.sql import functions as F

from citeloom import cli
from citeloom.operators import adjudicate
from citeloom.plans import parse_report


def test_answers_and_cache(spark):
    def judge(prompts):
        return ['{"answer": "yes", "confidence": "high"}' if "alpha" in p else "not json" if "beta" in p else '{"answer": "maybe", "confidence": "high"}' for p in prompts]

    def broken(prompts):
        raise RuntimeError("down")

    q = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gamma")], "i int, t string").select("i", adjudicate.prompt("can_correspond", title=F.col("t")).alias("prompt"))
    got = {r.i: r for r in adjudicate.ask(q, "can_correspond", "m", judge).collect()}
    assert got[1].answer.answer == "yes" and got[1].error is None
    assert got[2].error == got[3].error == "malformed answer" and got[2].answer is None
    cache = adjudicate.cacheable(adjudicate.ask(q, "can_correspond", "m", judge), "can_correspond", "m")
    assert cache.count() == 1
    again = {r.i: r for r in adjudicate.ask(q, "can_correspond", "m", broken, cache).collect()}
    assert again[1].answer.answer == "yes" and "down" in again[2].error
    other = {r.i: r for r in adjudicate.ask(q, "can_correspond", "other", None, cache).collect()}
    assert {r.error for r in other.values()} == {"no adjudicator"}


def test_parse_report(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@article{x, title={T}, author={A B}, year=2001}\n@misc{y, title={U}, author={C}}\n% @misc{z, title={V}}\n", encoding="utf-8")
    (tmp_path / "m.tex").write_text("See \\cite{x} and \\citep{gone}. \\input{nowhere}", encoding="utf-8")
    r = parse_report.parse_report(spark, str(tmp_path / "a.bib"), str(tmp_path / "m.tex"))
    assert [x.key for x in r["dangling"].collect()] == ["gone"] and [x.key for x in r["uncited"].collect()] == ["y"]
    assert [x.name for x in r["missing"].collect()] == ["nowhere"] and r["twins"].count() == 1
    s = r["summary"].first()
    assert (s.entries, s.cited, s.uncited, s.commented, s.dangling) == (2, 1, 1, 1, 1)
    assert "2 entries" in parse_report.text_report(r)
    (tmp_path / "empty.bib").write_text("nothing", encoding="utf-8")
    assert cli.main(["parse", str(tmp_path / "empty.bib")]) == 2
