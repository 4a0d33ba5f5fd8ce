"""Connectors to scholarly sources: snapshot tables by default, live fetching only where asked for.

A query is (entry_id, source, query_kind, ord).  Offline it is answered by a join with a snapshot or cache
table.  Live, each source is fetched in one partition, so that its rate limit holds for the whole cluster;
a failure is a value in ``error``, never an empty answer and never an exception.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.functions import text

# Requests per second, records per search.
RATES = {
    "crossref": 10, "openalex": 10, "openlibrary": 5, "google_books": 5, "arxiv": 3, "dblp": 2, "publisher": 2, "web": 2, "semantic_scholar": 1,
}
LIMIT, ATTEMPTS, TIMEOUT = 10, 3, 30
BACKOFF = (0.5, 8.0)


@dataclass
class Limiter:
    """At least 1 / rate seconds between two calls."""

    rate: float
    last: float = 0.0

    def wait(self) -> None:
        pause = self.last + 1 / self.rate - time.monotonic()
        if pause > 0:
            time.sleep(pause)
        self.last = time.monotonic()


def fetch(url: str, limiter: Limiter, opener: Callable | None = None, attempts: int = ATTEMPTS) -> tuple[int | None, str | None, str | None]:
    """``(status, body, error)``: retries transport failures, 429 and 5xx; 404 and 410 are answers."""
    pause = BACKOFF[0]
    for k in range(attempts):
        limiter.wait()
        try:
            with (opener or urllib.request.urlopen)(urllib.request.Request(url, headers={"User-Agent": "citeloom"}), timeout=TIMEOUT) as r:
                return r.status, r.read().decode("utf-8", "replace"), None
        except urllib.error.HTTPError as e:
            if e.code in (404, 410):
                return e.code, None, None
            if e.code != 429 and e.code < 500:
                return e.code, None, f"HTTP {e.code}"
            error = f"HTTP {e.code}"
        except OSError as e:
            error = f"transport: {e}"
        if k + 1 < attempts:
            time.sleep(pause)
            pause = min(BACKOFF[1], pause * 2)
    return None, None, error


def query_urls(queries: DataFrame) -> DataFrame:
    """Routed queries with the address to ask; entries' ids, title and authors must be present."""
    i, title = F.col("ids"), F.url_encode(text.clean(F.col("title")))
    who = F.url_encode(F.coalesce(text.query_surname(F.col("authors")), F.lit("")))
    arxiv = F.coalesce(i["arxiv_id"], F.lit(""))
    c = F.concat
    by_id = {
        "crossref": c(F.lit("https://api.crossref.org/works/"), F.url_encode(i["doi"])),
        "openalex": c(F.lit("https://api.openalex.org/works/"), F.coalesce(c(F.lit("doi:"), i["doi"]), c(F.lit("doi:"), ids.arxiv_doi(i["arxiv_id"])), i["openalex"])),
        "semantic_scholar": c(F.lit("https://api.semanticscholar.org/graph/v1/paper/"), F.coalesce(c(F.lit("DOI:"), i["doi"]), c(F.lit("ARXIV:"), i["arxiv_id"]), c(F.lit("PMID:"), i["pmid"]))),
        "arxiv": c(F.lit("http://export.arxiv.org/api/query?id_list="), arxiv),
        "openlibrary": c(F.lit("https://openlibrary.org/search.json?isbn="), i["isbn13"]),
        "google_books": F.coalesce(c(F.lit("https://www.googleapis.com/books/v1/volumes/"), i["google_books"]), c(F.lit("https://www.googleapis.com/books/v1/volumes?q=isbn:"), i["isbn13"])),
    }
    by_title = {
        "crossref": c(F.lit(f"https://api.crossref.org/works?rows={LIMIT}&query.bibliographic="), title, F.lit("&query.author="), who),
        "openalex": c(F.lit(f"https://api.openalex.org/works?per-page={LIMIT}&search="), title),
        "semantic_scholar": c(F.lit(f"https://api.semanticscholar.org/graph/v1/paper/search?limit={LIMIT}&query="), title),
        "dblp": c(F.lit(f"https://dblp.org/search/publ/api?format=json&h={LIMIT}&q="), title),
        "arxiv": c(F.lit(f"http://export.arxiv.org/api/query?max_results={LIMIT}&search_query=ti:%22"), title, F.lit("%22")),
        "openlibrary": c(F.lit(f"https://openlibrary.org/search.json?limit={LIMIT}&title="), title, F.lit("&author="), who),
        "google_books": c(F.lit(f"https://www.googleapis.com/books/v1/volumes?maxResults={LIMIT}&q=intitle:"), title, F.lit("+inauthor:"), who),
    }
    address = F.lit(None).cast("string")
    for kind, table in (("id", by_id), ("metadata", by_title)):
        for source, u in table.items():
            address = F.when((F.col("query_kind") == kind) & (F.col("source") == source), u).otherwise(address)
    return queries.withColumn("address", address)


ANSWER = "entry_id string, source string, query_kind string, status int, payload string, error string"


def fetch_live(queries: DataFrame, opener: Callable | None = None) -> DataFrame:
    """Answers of routed queries with addresses, one task per source."""

    def ask(key, pdf: pd.DataFrame) -> pd.DataFrame:
        limiter = Limiter(RATES.get(key[0], 1))
        rows = [(r.entry_id, r.source, r.query_kind, *fetch(r.address, limiter, opener)) for r in pdf.itertuples()]
        return pd.DataFrame(rows, columns=["entry_id", "source", "query_kind", "status", "payload", "error"])

    return queries.filter("address is not null").select("entry_id", "source", "query_kind", "address").groupBy("source").applyInPandas(ask, ANSWER)


def from_snapshot(queries: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Offline answers: every query with its snapshot row, or with neither payload nor error (no hit)."""
    return queries.join(snapshot, keys, "left")


def resolution_status(status: Column) -> Column:
    """Whether a DOI is registered, from the resolver's answer: redirect or success true, 404 false, else null."""
    return F.when(status.between(200, 399), True).when(status == 404, False)


def apply_over(frame: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """An injected fetcher, renderer or adjudicator over Arrow batches; it must return errors as values."""
    return frame.mapInPandas(f, schema)
