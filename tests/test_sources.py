from pyspark.sql import functions as F

from citeloom.sources import bibtex, connectors, html, latex, payloads

BIB = r"""
@string{jx = "Journal of X"}
% @misc{twin2000, author = {A One and B Two and C Three and D Four},
%   title = {A commented twin}, year = {2000}}
@article{smith2020,
  title = {On the {Nature} of {\"U}bung},
  author = "Smith, John and Caf{\'e}, Ana and others",
  journal = jx # { Letters}, year = 2020, pages = {1--10}, number={}, doi = {https://doi.org/10.1000/XYZ.},
}
@book{b1, title={Unfinished, author={X}, year={1999}}
@comment{ignored, x = {y}}
"""


def test_bibtex(spark):
    found = {k: (t, f, c) for k, t, f, c in bibtex.scan(BIB)}
    assert set(found) == {"twin2000", "smith2020", "b1"}
    assert found["twin2000"][2] and not found["smith2020"][2]
    assert found["smith2020"][1]["journal"] == "Journal of X Letters"
    files = spark.createDataFrame([("a.bib", BIB), ("b.bib", None), ("c.bib", "<html>no entries</html>")], "bib_file string, text string")
    rows = {r.key: r for r in bibtex.to_entries(bibtex.parse_texts(files)).collect()}
    e = rows["smith2020"]
    assert e.title == "On the Nature of Übung" and e.authors == ["Smith, John", "Café, Ana", "others"] and e.year == 2020
    assert e.ids.doi == "10.1000/xyz" and e.venue == "Journal of X Letters" and e.entry_type == "article" and len(e.content_hash) == 64
    assert len(rows["twin2000"].authors) == 4


def test_bibtex_source(spark, tmp_path):
    (tmp_path / "x.bib").write_text(BIB, encoding="utf-8")
    spark.dataSource.register(bibtex.BibtexSource)
    assert spark.read.format("bibtex").load(str(tmp_path)).count() == 3
    assert bibtex.read(spark, str(tmp_path)).count() == 3


TEX = r"""
First things first. As shown by \citep[see][p. 3]{a, b}, it holds. % \cite{hidden}
Yes~\citet{a}. \nocite{c}
\begin{verbatim} \cite{no} \end{verbatim}
\verb|\cite{nono}| 5\% of \cite{d}
"""


def test_latex(spark):
    files = spark.createDataFrame([("m.tex", TEX)], "tex_file string, text string")
    assert {r.key for r in latex.cited_keys(files).collect()} == {"a", "b", "c", "d"}
    rows = {(r.key, r.ordinal): r for r in latex.contexts(files).collect()}
    assert set(rows) == {("a", 0), ("a", 1), ("b", 0), ("d", 0)}
    assert rows[("a", 0)].text == rows[("b", 0)].text == "As shown by, it holds."
    assert rows[("a", 1)].text.startswith("As shown by")  # a short sentence takes the one before along


def test_includes():
    text, missing = latex.closure("main", {"main.tex": r"A \input{b} \include{gone} % \input{c}", "b.tex": r"B \input{main}", "c.tex": "C"})
    assert "B" in text and "C" not in text and missing == ["gone"]


def test_pages(spark):
    full = "<html><head><title>T &amp; U</title><meta property='og:title' content='Real'><meta name='citation_author' content='A B'><meta name='citation_author' content='C D'><meta name='citation_date' content='2019/05/01'></head><body><script>x</script>" + "word " * 60 + "</body></html>"
    shell = "<html><body><div id=\"app\"></div><script type=\"module\"></script></body></html>"
    rows = spark.createDataFrame([("a", 200, full), ("b", 200, shell), ("c", 404, ""), ("d", 200, None)], "url string, status int, html string")
    got = {r.url: r for r in html.metadata(rows).collect()}
    assert got["a"].title == "Real" and got["a"].authors == ["A B", "C D"] and got["a"].year == 2019 and not got["a"].unrendered
    assert got["b"].unrendered and got["c"].dead and got["c"].title is None and not got["d"].dead


def one(spark, f, payload):
    return spark.createDataFrame([(payload,)], "p string").select(f(F.col("p")).alias("r")).first().r


def test_payloads(spark):
    r = one(spark, payloads.crossref, '{"DOI":"10.1000/AB","title":["T"],"author":[{"given":"A","family":"B"},{"name":"Group"}],"issued":{"date-parts":[[2011,2]]},"article-number":"e7","type":"posted-content","relation":{"is-preprint-of":[{"id":"10.48550/arXiv.1234.56789"}]}}')
    assert (r.doi, r.title, r.authors, r.year, r.pages, r.is_preprint, r.arxiv_id) == ("10.1000/ab", "T", ["A B", "Group"], 2011, "e7", True, "1234.56789")
    r = one(spark, payloads.openalex, '{"id":"https://openalex.org/W5","title":null,"display_name":"D","authorships":[{"author":{"display_name":"A"}},{"author":{}}],"biblio":{"first_page":"3","last_page":"9"},"abstract_inverted_index":{"b":[1],"a":[0,2]},"ids":{"pmid":"https://x/123/"},"locations":[{"landing_page_url":"u"}]}')
    assert (r.title, r.authors, r.pages, r.abstract, r.openalex, r.pmid, r.version_links) == ("D", ["A"], "3--9", "a b a", "W5", "123", ["u"])
    r = one(spark, payloads.dblp, '{"authors":{"author":{"@pid":"1","text":"Jo Do 0003"}},"title":"T.","venue":["V","W"],"year":"2001","type":"Informal","ee":"https://doi.org/10.2000/x"}')
    assert (r.authors, r.title, r.venue, r.year, r.is_preprint, r.doi) == (["Jo Do"], "T", "V", 2001, True, "10.2000/x")
    r = one(spark, payloads.semantic_scholar, '{"paperId":"p","title":"T","authors":[{"name":"A"}],"externalIds":{"ArXiv":"1"}}')
    assert r.is_preprint and r.authors == ["A"]
    r = one(spark, payloads.google_books, '{"id":"v","volumeInfo":{"title":"A","subtitle":"B","publishedDate":"2012-03","industryIdentifiers":[{"type":"ISBN_10","identifier":"0262033844"},{"type":"ISBN_13","identifier":"9780000000002"}]}}')
    assert (r.title, r.year, r.isbn13s) == ("A: B", 2012, ["9780000000002", "9780262033848"])
    r = one(spark, payloads.openlibrary, '{"key":"/works/1","title":"T","author_name":["A"],"first_publish_year":1976,"edition_count":3,"publisher":["P","Q"]}')
    assert (r.year, r.edition, r.publisher) == (1976, 3, "P")
    r = one(spark, payloads.arxiv_atom, '<entry xmlns="http://www.w3.org/2005/Atom"><id>http://arxiv.org/abs/1234.56789v2</id><title>A\n  B</title><author><name>X Y</name></author><published>2012-01-01</published></entry>')
    assert (r.source_native_id, r.title, r.authors, r.year, r.doi) == ("1234.56789", "A B", ["X Y"], 2012, "10.48550/arxiv.1234.56789")


def test_export(spark):
    rows = spark.createDataFrame([("10.1000/a", "@article{x, title={T}, pages={131}, volume={A long proceedings title}}"), ("10.1000/b", "<html>challenge</html>")], "doi string, text string")
    got = {r.doi: r for r in payloads.publisher_bibtex(rows).collect()}
    assert got["10.1000/a"].pages == "131" and got["10.1000/a"].volume == "" and got["10.1000/a"].error is None and got["10.1000/b"].error


def test_fetch_reports_errors_as_values():
    calls = []

    def down(request, timeout):
        calls.append(request.full_url)
        raise OSError("down")

    limiter = connectors.Limiter(1e9)
    status, body, error = connectors.fetch("http://x.example/", limiter, down, attempts=1)
    assert status is None and body is None and "down" in error and len(calls) == 1
