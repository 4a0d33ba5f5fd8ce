import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.functions import similarity as sim
from citeloom.functions import text


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_doi(spark):
    got = values(spark, ids.doi, ["https://doi.org/10.1002/CPLX.20165", "doi:10.1000/abc).", "no id", "", None])
    assert got == ["10.1002/cplx.20165", "10.1000/abc", None, None, None]


def test_isbn(spark):
    got = values(spark, ids.isbn13, ["0-262-03384-4", "978 0 262 03384 8", "ISBN: 0262033844 (pbk)", "not-an-isbn", None, "080442957X"])
    assert got == ["9780262033848", "9780262033848", "9780262033848", None, None, "9780804429573"]


def test_arxiv(spark):
    none = F.lit(None).cast("string")
    assert values(spark, lambda x: ids.arxiv_id(x, none, none), ["2408.04076v2", "hep-th/9901001v1", "nothing"]) == ["2408.04076", "hep-th/9901001", None]
    named = values(spark, lambda x: ids.arxiv_id(none, none, x), ["10.3389/frobt.2016.00040", "https://arxiv.org/abs/1234.56789v3", "10.48550/arXiv.2401.00001", None])
    assert named == [None, "1234.56789", "2401.00001", None]
    assert values(spark, ids.arxiv_year, ["2408.04076", "hep-th/9901001", "math.AG/0501001", "x"]) == [2024, 1999, 2005, None]


def test_hosts(spark):
    assert values(spark, ids.work_id, ["https://openalex.org/w123", "W123", "https://x.org/W1"]) == ["W123", None, None]
    assert values(spark, ids.volume_id, ["https://books.google.com/books?id=aB_c-1&hl=en", "https://x.org/?id=1"]) == ["aB_c-1", None]


def test_agreement(spark):
    kind = "struct<a:struct<doi:string,arxiv_id:string,isbn13:string,isbn13s:array<string>,pmid:string,openalex:string>,b:struct<doi:string,arxiv_id:string,isbn13:string,isbn13s:array<string>,pmid:string,openalex:string>>"
    none = (None,) * 6
    i = lambda **k: tuple(k.get(n) for n in ("doi", "arxiv_id", "isbn13", "isbn13s", "pmid", "openalex"))
    rows = [
        (none, none), (i(doi="10.48550/arxiv.1"), i(doi="10.1000/x")), (i(isbn13="1", isbn13s=["2"]), i(isbn13="2")), (i(isbn13="1"), i(isbn13="2")),
        (i(openalex="W1"), i(openalex="W2")), (i(doi="10.1000/x"), i(doi="10.1000/x")),
    ]
    got = values(spark, lambda x: ids.agreement(x["a"], x["b"]), rows, kind)
    assert got == ["absent", "absent", "match", "conflict", "conflict", "match"]


def test_entry_type_and_export(spark):
    assert values(spark, ids.entry_type, ["InBook", " online ", "weird", None]) == ["incollection", "misc", "unknown", "unknown"]
    got = values(spark, lambda x: ids.export_url(x, F.lit("10.1/a b")), ["https://direct.mit.edu/isal/35/131/116921", "https://journals.sagepub.com/doi/x", "https://x.org/1"])
    assert got[0].endswith("resourceId=116921&resourceType=3&citationFormat=2") and "doi=10.1%2Fa" in got[1] and got[2] is None


def test_folding(spark):
    assert len(set(values(spark, text.fold, ["{Erdős} Number", "ERDOS   number", "Erdo{s} number."]))) == 1
    assert values(spark, text.title, ["  Straße — Œuvre:  №1 ", None]) == ["strasse oeuvre 1", ""]
    assert values(spark, text.last_name, ["van Gogh, Vincent", "Ada M. Lovelace", "J.R.R. Tolkien", "", None]) == ["van gogh", "lovelace", "tolkien", "", ""]


def test_pages_and_numbers(spark):
    assert values(spark, text.pages, ["1–10", "1 -- 10", " A1-A9 ", None]) == ["1-10", "1-10", "a1-a9", ""]
    assert values(spark, text.clean_range, ["1--10", "1-10", "1–10", "7"]) == [True, False, False, False]
    assert values(spark, text.number, ["007", "12a", "0", None]) == ["7", "12a", "0", ""]
    assert values(spark, text.edition_number, ["2nd", "Third edition", "x", ""]) == [2, 3, None, None]
    assert values(spark, text.is_placeholder, ["{}", "-", "N/A", "3"]) == [True, True, True, False]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert sim.lcs(a, b) == brute_lcs(a, b)


def test_title_similarity():
    assert sim.title_similarity("Alpha beta", "beta ALPHA") == 1.0
    assert sim.title_similarity("Deep learning", "Deep learning for the automatic detection of everything") < 0.95
    assert sim.title_similarity("", "x") == 0.0
    assert sim.partial_ratio("complex", "complexity") == 1.0
    assert SequenceMatcher(None, "abcd", "abce").ratio() == pytest.approx(sim.ratio("abcd", "abce"))


def test_sets_and_traps(spark):
    df = spark.createDataFrame([(["Smith, J.", "others"], ["John Smith", "Ann Lee"]), ([], ["A B"]), (None, None)], "a array<string>, b array<string>")
    rows = df.select(sim.names_jaccard(text.surnames(F.col("a")), text.surnames(F.col("b"))).alias("j"), sim.names_subset(text.surnames(F.col("a")), text.surnames(F.col("b"))).alias("s")).collect()
    assert [(r.j, r.s) for r in rows] == [(0.5, True), (0.0, False), (0.0, False)]
    t = spark.createDataFrame([("a b c d e", "a b c x y"), ("a b c d", "a b c d"), ("a b c", "a b d")], "a string, b string")
    assert [r.t for r in t.select(sim.prefix_trap(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("t")).collect()] == [True, False, False]
