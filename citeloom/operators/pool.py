"""Pooling: records of one work fetched for one entry are merged into a representative.

Records are linked by shared identifier keys (a record's own key, or a version link that names it) and by
the version rule (same title and authors, one of them a preprint or no two published DOIs).  Components
are found per entry by minimum labels; the representative takes its fields from the best source.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.functions import similarity as sim
from citeloom.functions import text
from citeloom.runtime import cut, drop, spread

VERSION_TITLE, VERSION_AUTHOR = 0.93, 0.80
# Sources by trust for each field; a record counts as the best source behind it.
FIELD_PRIORITY = {
    "venue": ["publisher", "crossref", "openalex", "openlibrary"],
    "volume": ["publisher", "crossref", "openalex"],
    "issue": ["publisher", "crossref", "openalex"],
    "pages": ["publisher", "crossref", "openalex"],
    "publisher": ["publisher", "crossref", "openlibrary", "openalex"],
    "year": ["publisher", "crossref", "openalex"],
}
ID_FIELDS = ["doi", "arxiv_id", "isbn13", "pmid", "bibcode", "openalex", "google_books", "url"]


#: Added to the place of a record that answers a search, so that answers to an identifier come first.
SEARCHED = 1 << 62


def id_edges(records: DataFrame, entry: str = "entry_id") -> DataFrame:
    """``(entry, a, b)`` of records that share a key; links count only between records with keys.

    Every key links its holders and namers to its first holder: a star, not all pairs.
    """
    keyed = records.select(
        F.col(entry).alias("entry"), "ord", ids.own_keys(F.col("ids"), F.col("openalex_work_id")).alias("own"), ids.link_keys(F.col("version_links")).alias("links")
    ).filter(F.size("own") > 0)
    own = keyed.select("entry", "ord", F.explode("own").alias("key"), F.lit(True).alias("held"))
    named = keyed.select("entry", "ord", F.explode("links").alias("key"), F.lit(False).alias("held"))
    said = own.union(named)
    holder = said.filter("held").groupBy("entry", "key").agg(F.min("ord").alias("a"))
    return said.join(holder, ["entry", "key"]).filter("ord <> a").select("entry", F.col("a"), F.col("ord").alias("b")).distinct()


def version_edges(records: DataFrame, entry: str = "entry_id") -> DataFrame:
    """``(entry, a, b)`` of records that are versions of one work although they share no key.

    Candidate pairs within an entry share two of their four longest title words, so unlike titles are never
    compared, however many records an entry has.
    """
    words = F.array_distinct(F.filter(F.split(text.title(F.col("title")), " "), lambda w: F.length(w) > 2))
    lead = F.slice(F.array_sort(words, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)), 1, 4)
    r = records.select(
        F.col(entry).alias("entry"), "ord", "title", "authors", F.col("is_preprint").alias("pre"), ids.published_doi(F.col("ids")["doi"]).alias("doi"), F.array_sort(lead).alias("lead"),
    )
    word = lambda i: F.get("lead", F.lit(i))
    two = F.array_compact(F.array(*[F.when(word(b).isNotNull(), F.concat_ws(" ", word(a), word(b))) for a, b in combinations(range(4), 2)]))
    keys = r.select("entry", "ord", F.explode(F.when(F.size("lead") < 2, F.col("lead")).otherwise(two)).alias("key"))
    pairs = keys.alias("x").join(keys.alias("y"), ["entry", "key"]).filter("x.ord < y.ord").select("entry", F.col("x.ord").alias("a"), F.col("y.ord").alias("b")).distinct()
    mine = r.drop("lead").withColumn("words", text.tokens(F.col("title"))).withColumn("names", text.surnames(F.col("authors")))
    mine = mine.withColumn("plain", F.array_join("words", " ")).withColumn("sorted", F.array_join(F.array_sort("words"), " "))
    side = lambda s: mine.select("entry", F.col("ord").alias(s), F.struct("title", "words", "names", "pre", "doi", "plain", "sorted").alias(f"r{s}"))
    both = pairs.join(side("a"), ["entry", "a"]).join(side("b"), ["entry", "b"])
    x, y = F.col("ra"), F.col("rb")
    versions = (x["pre"] != y["pre"]) | x["doi"].isNull() | y["doi"].isNull() | (x["doi"] == y["doi"])
    near = both.filter(versions & _can_be_alike(x, y) & ~sim.prefix_trap(x["words"], y["words"]))
    near = spread(near, "a", "b")  # few bytes but much work: the ratios must not end up in one task
    good = near.withColumn("t", sim.title_ratio(x["title"], y["title"])).filter(F.col("t") >= VERSION_TITLE)
    same = (sim.author_overlap(x["names"], y["names"]) >= VERSION_AUTHOR) | sim.names_subset(x["names"], y["names"])
    return good.filter(same).select("entry", "a", "b")


def _can_be_alike(x, y):
    """Whether two titles can reach VERSION_TITLE at all: the edit distance is at most the insert/delete
    distance that ratio allows, plain or sorted, or most words of the shorter title are shared."""
    room = ((1 - VERSION_TITLE) * (F.length(x["plain"]) + F.length(y["plain"]))).cast("int") + 1
    close = (F.levenshtein(x["plain"], y["plain"]) <= room) | (F.levenshtein(x["sorted"], y["sorted"]) <= room)
    return (F.size(F.array_intersect(x["words"], y["words"])) >= 0.6 * F.least(F.size(F.array_distinct(x["words"])), F.size(F.array_distinct(y["words"])))) | close


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(entry, ord, comp)``: smallest ord of each component, by minimum labels; a label moves to all
    neighbours and is replaced by the label of its own node, so long chains halve each round."""
    both = cut(edges.select("entry", "a", "b").union(edges.select("entry", F.col("b"), F.col("a"))).distinct(), "pool-edges")
    labels = cut(nodes.select("entry", "ord", F.col("ord").alias("comp")), "pool-labels")
    while True:
        lowest = both.join(labels.select("entry", F.col("ord").alias("b"), F.col("comp").alias("c")), ["entry", "b"]).groupBy("entry", "a").agg(F.min("c").alias("c"))
        step = labels.join(lowest.withColumnRenamed("a", "ord"), ["entry", "ord"], "left").select(
            "entry", "ord", F.least("comp", F.coalesce("c", "comp")).alias("comp"), F.col("comp").alias("old")
        )
        jump = step.select("entry", F.col("ord").alias("comp"), F.col("comp").alias("root"))
        new = cut(step.join(jump, ["entry", "comp"]).select("entry", "ord", F.least("comp", "root").alias("comp"), "old"), "pool-labels")
        changed = new.filter("comp <> old").limit(1).count()
        drop(labels)
        labels = new.select("entry", "ord", "comp")
        if not changed:
            return labels


def pool(records: DataFrame, entry: str = "entry_id") -> DataFrame:
    """``(entry, ord, comp)`` of all records of all entries."""
    nodes = records.select(F.col(entry).alias("entry"), "ord")
    return components(nodes, id_edges(records, entry).union(version_edges(records, entry)).distinct())


def source_rank(field: str):
    """Rank of the best source behind a record, 0 best."""
    order = FIELD_PRIORITY[field]
    table = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    sources = F.array_compact(F.concat(F.array("source"), F.coalesce("merged_from", F.array().cast("array<string>"))))
    return F.coalesce(F.array_min(F.transform(sources, lambda s: F.coalesce(table[s], F.lit(len(order))))), F.lit(len(order)))


def representative_columns(order: str = "ord") -> list:
    """Aggregates that make one record of a group: the richest record's own fields, and best-source fields."""
    o = F.col(order)
    rich = F.struct(F.col("ids")["doi"].isNotNull().alias("d"), F.coalesce("citation_count", F.lit(0)).alias("c"), F.coalesce(F.size("authors"), F.lit(0)).alias("n"), (-o).alias("o"))
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))

    def best(field: str):
        v = filled(field) if field != "year" else F.col("year")
        return F.min_by(v, F.when(v.isNotNull(), F.struct(source_rank(field).alias("r"), o.alias("o")))).alias(field)

    abstract = filled("abstract")
    lists = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"])))
    merged = [F.min_by(F.col("ids")[k], F.when(F.col("ids")[k].isNotNull(), o)).alias(k) for k in ID_FIELDS]
    return [
        F.max_by("source", rich).alias("source"),
        F.max_by("source_native_id", rich).alias("source_native_id"),
        F.max_by("title", rich).alias("title"),
        F.max_by("authors", rich).alias("authors"),
        *[best(f) for f in FIELD_PRIORITY],
        F.max_by(abstract, F.when(abstract.isNotNull(), F.struct(F.length(abstract).alias("l"), (-o).alias("o")))).alias("abstract"),
        F.max("citation_count").alias("citation_count"),
        F.max("edition").alias("edition"),
        F.every("is_preprint").alias("is_preprint"),
        *merged,
        lists(F.col("ids")["isbn13s"]).alias("isbn13s"),
        lists(F.col("version_links")).alias("version_links"),
        F.min_by("openalex_work_id", F.when(F.col("openalex_work_id").isNotNull(), o)).alias("openalex_work_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.concat(F.array("source"), F.coalesce("merged_from", F.array().cast("array<string>"))))))).alias("merged_from"),
        F.count("*").alias("n_records"),
    ]


def representatives(records: DataFrame, pooled: DataFrame, entry: str = "entry_id") -> DataFrame:
    """One merged record per (entry, component); ``ids`` is a struct again."""
    rows = records.withColumnRenamed(entry, "entry").join(pooled, ["entry", "ord"])
    wide = rows.groupBy("entry", F.col("comp").alias("ord")).agg(*representative_columns())
    pack = F.struct(*[F.col(k) for k in ("doi", "arxiv_id", "isbn13", "isbn13s", "pmid", "bibcode", "openalex", "google_books", "url")]).alias("ids")
    text_cols = [F.coalesce(c, F.lit("")).alias(c) for c in ("venue", "volume", "issue", "pages", "publisher", "abstract")]
    rest = ["entry", "ord", "source", "source_native_id", "title", "authors", "year", "citation_count", "edition", "is_preprint", "version_links", "openalex_work_id", "merged_from", "n_records"]
    return wide.select(*rest, *text_cols, pack)
