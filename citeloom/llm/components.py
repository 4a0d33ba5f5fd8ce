"""Consolidating pairwise matches into groups (problem 4): seed-tree pruning.

Every round each vertex looks for the smallest vertex of its neighbourhood and announces it to the
whole neighbourhood.  A vertex that nobody (itself included) considers a minimum drops out of the
graph and hangs below its smallest announced minimum in a propagation forest; the rest is joined by
edges between competing minima.  When no edge is left, the vertices still standing are the seeds, and
their identifiers flow down the forest, latest round first.  The number of vertices shrinks
geometrically, so rounds are logarithmic even for long chains.

Edge inputs: null ends and self loops are ignored, repeated edges count once, an empty table gives an
empty result, and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import cut, drop, lookup


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node with at least one edge; component = smallest member.

    Works for any orderable id type.  No step collects ids to the driver: only row counts return.
    """
    plain = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    graph = cut(plain.union(plain.select("v", "u")).distinct(), "cc-graph")
    forest: list[DataFrame] = []
    first = graph
    while graph.limit(1).count():
        near = cut(
            graph.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n_rows"))
            .select("u", F.least("u", "w").alias("low"), "n_rows"),
            "cc-min",
        )
        told = lookup(graph, near, "u").select("v", "low").union(near.select(F.col("u").alias("v"), "low"))
        told = cut(told.distinct(), "cc-told")
        best = cut(
            told.groupBy("v").agg(
                F.min("low").alias("top"), F.count("*").alias("n_rows"), F.max(F.col("low") == F.col("v")).alias("stays")
            ),
            "cc-best",
        )
        forest.append(cut(best.filter(~F.col("stays")).select(F.col("v").alias("node"), F.col("top").alias("parent")), "cc-tree"))
        rivals = lookup(told, best.filter("n_rows > 1").select("v", "top", "n_rows"), "v").filter("low <> top")
        links = rivals.select(F.col("top").alias("u"), F.col("low").alias("v"))
        following = cut(links.union(links.select("v", "u")).distinct(), "cc-graph")
        drop(near, told, best, *([] if graph is first else [graph]))
        graph = following
    drop(graph)
    labels: DataFrame | None = None
    for tree in reversed(forest):
        if labels is None:
            now = tree.select("node", F.col("parent").alias("component"))
        else:
            up = labels.select(F.col("node").alias("parent"), "component")
            now = labels.unionByName(
                tree.join(up, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
            )
        done = labels
        labels = cut(now, "cc-labels")
        drop(tree, done)
    if labels is not None:
        drop(first)
    else:
        return first.select(F.col("u").alias("node"), F.col("u").alias("component")).filter(F.lit(False))
    roots = labels.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return labels.unionByName(roots)


def identifier_key(text):
    """Column: one spelling for an identifier, whatever its case, URL form or preprint version.

    DOI (any resolver or landing URL, ``doi:`` prefix, closing full stop) -> ``doi:10...``; a preprint
    identifier, bare, as URL, PDF or registered DOI -> ``arxiv:...`` without version; work ids of the
    catalogue (``W123``) -> ``work:w123``; anything else -> trimmed lower case.  Blank or null -> null.
    """
    t = F.lower(F.trim(text))
    arxiv = F.regexp_extract(t, r"(?:^|arxiv[.:]|/(?:abs|pdf)/)\s*(\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?[.,;)\s]*$", 1)
    doi = F.regexp_replace(F.regexp_extract(t, r"(10\.\d{4,9}/[-._;()/:a-z0-9]+)", 1), r"[.,;)]+$", "")
    work = F.regexp_extract(t, r"(?:^|openalex\.[a-z]+/(?:works/)?)(w\d+)/?$", 1)
    return (
        F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv))
        .when(doi != "", F.concat(F.lit("doi:"), doi))
        .when(work != "", F.concat(F.lit("work:"), work))
        .when(t != "", t)
    )


def record_links(records: DataFrame) -> DataFrame:
    """Star-shaped edges ``(src, dst)`` between records of one identifier.

    A record holds the identifiers in ``source_native_id`` and ``openalex_work_id`` and names those in
    ``version_links``.  Every holder and every namer of an identifier that somebody holds is linked to
    its smallest holder: as many edges as mentions, never all pairs.
    """
    r = records.select("record_id", "source_native_id", "openalex_work_id", "version_links").filter("record_id is not null")
    said = r.select(
        "record_id",
        F.explode(
            F.concat(
                F.array(
                    F.struct(identifier_key(F.col("source_native_id")).alias("key"), F.lit(True).alias("held")),
                    F.struct(identifier_key(F.col("openalex_work_id")).alias("key"), F.lit(True).alias("held")),
                ),
                F.transform(
                    F.coalesce("version_links", F.array().cast("array<string>")),
                    lambda x: F.struct(identifier_key(x).alias("key"), F.lit(False).alias("held")),
                ),
            )
        ).alias("i"),
    ).select("record_id", "i.key", "i.held").filter("key is not null")
    said = cut(said.groupBy("record_id", "key").agg(F.max("held").alias("held")), "link-said")
    holders = cut(
        said.groupBy("key").agg(F.min(F.when(F.col("held"), F.col("record_id"))).alias("holder"), F.count("*").alias("n_rows"))
        .filter("holder is not null and n_rows > 1"),
        "link-holder",
    )
    return lookup(said, holders, "key").filter("record_id <> holder").select(
        F.col("record_id").alias("src"), F.col("holder").alias("dst")
    )


def record_groups(records: DataFrame) -> DataFrame:
    """``(record_id, group_id)`` of every record in a group of two or more; group_id is the smallest."""
    return connected_components(record_links(records)).select(
        F.col("node").alias("record_id"), F.col("component").alias("group_id")
    )
