"""Web pages: declared metadata, visible text, and whether a page was served unrendered."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text

# Metadata keys by preference, and signs of a page that is built by scripts.
TITLE_KEYS = ["og:title", "twitter:title", "citation_title", "dc.title", "dcterms.title"]
AUTHOR_KEYS = ["citation_author", "article:author", "author", "dc.creator", "dcterms.creator"]
DATE_KEYS = ["citation_publication_date", "citation_date", "article:published_time", "dc.date", "dcterms.date", "og:updated_time"]
SITE_KEYS = ["og:site_name", "application-name"]
SHELL_MARKERS = ['id="app"', "id='app'", 'id="root"', "id='root'", "<app-root", "ng-version", "data-reactroot", "__nuxt__", 'type="module"', "enable javascript", "requires javascript"]
TEXT_LIMIT, SHELL_TEXT = 8000, 200
_HIDDEN = {"script", "style", "noscript", "template"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, list[str]] = {}
        self.title, self.text, self.hidden, self.in_title = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta":
            a = {k: v or "" for k, v in attrs}
            key, content = (a.get("property") or a.get("name") or "").strip().lower(), a.get("content", "").strip()
            if key and content:
                self.meta.setdefault(key, []).append(content)

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.text.append(data)


PAGE = "meta map<string,array<string>>, head_title string, text string"


def parse_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``page``: the metadata multimap, the title element and the visible text."""

    @F.pandas_udf(PAGE)
    def udf(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            p = _Page()
            try:
                p.feed(v or "")
                p.close()
            except (AssertionError, ValueError):  # a broken page keeps what was read
                pass
            rows.append((p.meta, " ".join("".join(p.title).split()), " ".join(" ".join(p.text).split())))
        return pd.DataFrame(rows, columns=["meta", "head_title", "text"])

    return pages.withColumn("page", udf(column))


def first(meta: Column, keys: list[str]) -> Column:
    """First value of the first key present."""
    return F.coalesce(*[F.get(F.element_at(meta, k), F.lit(0)) for k in keys])


def every(meta: Column, keys: list[str]) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(F.element_at(meta, k), none) for k in keys])))


def unrendered(html: Column, visible: Column) -> Column:
    """Hardly any text, and a sign that scripts were to build the page."""
    marks = F.lit(False)
    for m in SHELL_MARKERS:
        marks = marks | F.lower(html).contains(m)
    return (F.length(F.coalesce(visible, F.lit(""))) < SHELL_TEXT) & marks


def metadata(pages: DataFrame) -> DataFrame:
    """``(url, title, authors, year, site, text, dead, unrendered)`` of ``pages(url, status, html)``.

    Pages gone for good (404, 410) are dead records without title, not errors.
    """
    p = parse_pages(pages)
    meta, dead = F.col("page.meta"), F.col("status").isin(404, 410)
    live = lambda c: F.when(~dead, c)
    return p.select(
        "url", live(F.coalesce(first(meta, TITLE_KEYS), F.nullif("page.head_title", F.lit("")))).alias("title"), live(every(meta, AUTHOR_KEYS)).alias("authors"),
        live(text.page_year(first(meta, DATE_KEYS))).alias("year"), live(first(meta, SITE_KEYS)).alias("site"), live(F.left("page.text", F.lit(TEXT_LIMIT))).alias("text"),
        dead.alias("dead"), (~dead & unrendered(F.col("html"), F.col("page.text"))).alias("unrendered"),
    )
