"""Scoring of candidates, buckets, clustering of accepted records, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import identifiers as ids
from citeloom.functions import similarity as sim
from citeloom.functions import text
from citeloom.operators.pool import ID_FIELDS, components

SAME_TITLE, SAME_AUTHOR = 0.90, 0.70
TOP_CANDIDATES = 8


def prepare(row: Column, s: str) -> list[Column]:
    """Comparable forms of a row's title, authors, venue and pages, made once per row."""
    return [
        text.tokens(row["title"]).alias(f"words_{s}"), text.surnames(row["authors"]).alias(f"names_{s}"), text.page_range(row["pages"]).alias(f"range_{s}"),
        (F.trim(F.coalesce(row["venue"], F.lit(""))) != "").alias(f"placed_{s}"),
    ]


def ratios(pairs: DataFrame, x: Column, y: Column, s: str, r: str) -> DataFrame:
    """Pairs with title_ratio, author_overlap and same_venue from prepared rows ``s`` and ``r``."""
    out = pairs.withColumn("title_ratio", sim.title_ratio(x["title"], y["title"])).withColumn("author_overlap", sim.author_overlap(F.col(f"names_{s}"), F.col(f"names_{r}")))
    both = F.col(f"placed_{s}") & F.col(f"placed_{r}")
    return out.withColumn("same_venue", F.when(both, sim.title_ratio(x["venue"], y["venue"]) > sim.SAME_VENUE).otherwise(True))


def features(pairs: DataFrame) -> DataFrame:
    """Pairs of ``e`` and ``r`` (structs of entry and record), prepared as _e and _r, with the ten features."""
    x, y = F.col("e"), F.col("r")
    out = ratios(pairs, x, y, "e", "r").withColumn("venue_compatible", sim.venue_compatible(x["venue"], y["venue"]))
    names = F.col("names_e"), F.col("names_r")
    out = (
        out.withColumn("prefix_trap", sim.prefix_trap(F.col("words_e"), F.col("words_r")))
        .withColumn("author_set_jaccard", sim.names_jaccard(*names))
        .withColumn("author_subset", sim.names_subset(*names))
        .withColumn("year_factor", sim.year_factor(x["year"], y["year"]))
        .withColumn("id_agreement", ids.agreement(x["ids"], y["ids"]))
        .withColumn("pages_conflict", F.col("same_venue") & sim.pages_disjoint(F.col("range_e"), F.col("range_r")))
    )
    return out.withColumn("composite", sim.composite(F.col("title_ratio"), F.col("author_overlap"), F.col("year_factor"), F.col("venue_compatible")))


def bucket(entry_has_id: Column) -> Column:
    """auto_accept, auto_reject or adjudicate from the feature columns."""
    t, o = F.col("title_ratio"), F.col("author_overlap")
    subset, agree = F.col("author_subset"), F.col("id_agreement")
    authors_ok = (o >= sim.AUTHOR_ACCEPT) | subset
    distinct = (F.col("author_set_jaccard") < sim.AUTHOR_DISTINCT) & ~subset
    lock = (t >= sim.TITLE_BACKFILL) & authors_ok
    forced = F.col("prefix_trap") | (F.col("pages_conflict") & ~lock) | distinct
    return (
        F.when((agree == "match") & (t >= sim.TITLE_ACCEPT) & authors_ok & ~forced, "auto_accept")
        .when(~entry_has_id & (agree != "conflict") & (t >= sim.TITLE_BACKFILL) & (o >= sim.AUTHOR_ACCEPT) & ~forced, "auto_accept")
        .when((agree != "match") & (F.col("composite") < sim.COMPOSITE_REJECT), "auto_reject")
        .otherwise("adjudicate")
    )


def top_candidates(assessed: DataFrame, entry: str = "entry_id", k: int = TOP_CANDIDATES) -> DataFrame:
    """The k best candidates to adjudicate per entry, by composite, ties in candidate order."""
    w = Window.partitionBy(entry).orderBy(F.col("composite").desc(), "ord")
    return assessed.filter("bucket = 'adjudicate'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def relations(accepted: DataFrame, entry: str = "entry_id") -> DataFrame:
    """``(entry, a, b, relation)`` of the accepted records of an entry: same, distinct or ambiguous by the
    first rule that holds.  They are few: representatives of different works with the cited title."""
    mine = accepted.select(F.col(entry).alias("entry"), "ord", "r")
    side = lambda s: mine.select("entry", F.col("ord").alias(s), F.col("r").alias(f"r{s}"), *prepare(F.col("r"), s))
    x, y = F.col("ra"), F.col("rb")
    both = ratios(side("a").join(side("b"), "entry").filter("a < b"), x, y, "a", "b")
    names = F.col("names_a"), F.col("names_b")
    both = both.withColumn("subset", sim.names_subset(*names)).withColumn("agree", ids.agreement(x["ids"], y["ids"]))
    apart = (sim.names_jaccard(*names) < sim.AUTHOR_DISTINCT) & ~F.col("subset")
    rule = (
        F.when(F.col("agree") == "match", "same")
        .when(F.col("same_venue") & sim.pages_disjoint(F.col("range_a"), F.col("range_b")), "distinct")
        .when(sim.prefix_trap(F.col("words_a"), F.col("words_b")) | apart, "distinct")
        .when((F.col("title_ratio") >= SAME_TITLE) & ((F.col("author_overlap") >= SAME_AUTHOR) | F.col("subset")), "ambiguous")
        .otherwise("distinct")
    )
    return both.select("entry", "a", "b", rule.alias("relation"))


def cluster_accepted(accepted: DataFrame, confirmed: DataFrame | None = None, entry: str = "entry_id") -> DataFrame:
    """``(entry, ord, comp)``: same-object clusters; ``confirmed(entry, a, b)`` adds ruled pairs."""
    edges = relations(accepted, entry).filter("relation = 'same'").select("entry", "a", "b")
    if confirmed is not None:
        edges = edges.union(confirmed.select("entry", "a", "b"))
    return components(accepted.select(F.col(entry).alias("entry"), "ord"), edges)


def artifacts(accepted: DataFrame, clusters: DataFrame, entry: str = "entry_id") -> DataFrame:
    """Per cluster: merged identifiers, number of records, and the best record's place."""
    r = F.col("r")
    rows = accepted.withColumnRenamed(entry, "entry").join(clusters, ["entry", "ord"])
    best = F.struct((~F.coalesce(r["is_preprint"], F.lit(False))).alias("p"), r["ids"]["doi"].isNotNull().alias("d"), F.coalesce(r["citation_count"], F.lit(0)).alias("c"), (-F.col("ord")).alias("o"))
    merged = [F.min_by(r["ids"][k], F.when(r["ids"][k].isNotNull(), F.col("ord"))).alias(k) for k in ID_FIELDS]
    return rows.groupBy("entry", "comp").agg(F.count("*").alias("n_versions"), F.max_by("ord", best).alias("best_ord"), *merged)


def verdict(n_artifacts: Column, errored: Column, n_candidates: Column, all_rejected: Column) -> Column:
    """``struct(kind, confidence)``: none, exactly_one, multiple, or null where nothing can be said."""
    v = lambda kind, how: F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(how).cast("string").alias("confidence"))
    return (
        F.when(n_artifacts == 1, v("exactly_one", "high"))
        .when(n_artifacts > 1, v("multiple", "medium"))
        .when(errored, v(None, None))
        .when(n_candidates == 0, v("none", "high"))
        .when(all_rejected, v("none", "medium"))
        .otherwise(v(None, None))
    )


def verdicts(entries: DataFrame, assessed: DataFrame, arts: DataFrame, errors: DataFrame) -> DataFrame:
    """``(entry_id, kind, confidence, n_artifacts)`` of every entry; an error never becomes "none"."""
    seen = assessed.groupBy("entry_id").agg(F.count("*").alias("n_candidates"), F.every(F.col("bucket") == "auto_reject").alias("all_rejected"))
    works = arts.groupBy(F.col("entry").alias("entry_id")).agg(F.count("*").alias("n_artifacts"))
    rows = entries.select("entry_id").join(seen, "entry_id", "left").join(works, "entry_id", "left").join(errors.select("entry_id", "errored"), "entry_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    v = verdict(zero("n_artifacts"), F.coalesce("errored", F.lit(False)), zero("n_candidates"), F.coalesce("all_rejected", F.lit(False)))
    return rows.select("entry_id", zero("n_artifacts").alias("n_artifacts"), v.alias("v")).select("entry_id", "v.kind", "v.confidence", "n_artifacts")


def errored(results: DataFrame) -> DataFrame:
    """``(entry_hash, errored)``: whether any source failed for an entry; an error is not an empty result."""
    return results.groupBy("entry_hash").agg(F.bool_or(F.col("error").isNotNull()).alias("errored"))


def verdict_counts(spark, rows: DataFrame) -> DataFrame:
    """Number of entries by verdict, zero-filled, unresolved included."""
    kinds = spark.createDataFrame([("exactly_one",), ("multiple",), ("none",), ("unresolved",)], "verdict string")
    n = rows.groupBy(F.coalesce("kind", F.lit("unresolved")).alias("verdict")).agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(n, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))
