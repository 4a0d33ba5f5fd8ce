"""Best representative of each duplicate group (problem 5): field-by-field survivorship.

Each attribute is decided alone, by one aggregation that takes the maximum of a composite struct
(quality of the value, source priority, fetch time, value).  Quality is 3 for a real complete value,
2 for an abbreviated one, 1 for a cut-off one, 0 for the name of a repository instead of a venue;
placeholders and blanks take no part.  Whether a value is cut off is learnt from the whole column: it
is a proper prefix of a value that occurs at least as often.

Nulls in any column are allowed (unknown sources rank last, a null fetch time is oldest); repeated
rows change nothing; an empty table or groups without usable values give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import cut, lookup

# Which sources are trusted for a field, best first; all others rank equal, last.
SOURCE_PRIORITY = {
    "venue": ["publisher", "crossref", "openalex", "openlibrary"],
    "pages": ["publisher", "crossref", "openalex"],
    "publisher": ["publisher", "crossref", "openlibrary", "openalex"],
}
# Texts that mean "no value", compared trimmed and in lower case.
PLACEHOLDERS = [
    "", "-", "--", "–", "—", "n/a", "n.a.", "na", "none", "null", "tbd", "?", "??", "???", "...",
    "unknown", "in press", "to appear", "forthcoming", "submitted", "tba",
]
#: Names of preprint servers and repositories, which are no venue.
REPOSITORY = r"(?i)preprint|\brepository\b|\barxiv\b|\bbiorxiv\b|\bmedrxiv\b|\bssrn\b|\bzenodo\b|\beprints?\b"
#: A cut-off value keeps at least this many characters.
MIN_PREFIX = 2


def is_placeholder(text: Column) -> Column:
    """True for null, blank and placeholder texts."""
    return F.coalesce(F.lower(F.trim(text)).isin(PLACEHOLDERS), F.lit(True))


def _rank(field: str) -> Column:
    """Priority (smaller is better) of the best source behind a record."""
    order = SOURCE_PRIORITY[field]
    sources = F.array_compact(F.concat(F.array("source"), F.coalesce("merged_from", F.array().cast("array<string>"))))
    table = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    return F.coalesce(F.array_min(F.transform(sources, lambda s: F.coalesce(table[s], F.lit(len(order))))), F.lit(len(order)))


def field_values(records: DataFrame, groups: DataFrame, fields=("venue", "pages", "publisher")) -> DataFrame:
    """``(group_id, field, value, record_id, fetched_at, rank)``: one row per distinct non-blank value.

    record_id is the smallest one holding the value; rank and fetch time are those of its best record.
    """
    keep = records.select("record_id", "source", "merged_from", "fetched_at", *fields).filter("record_id is not null")
    one = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), _rank(f).alias("rank")) for f in fields])
    rows = keep.select("record_id", "fetched_at", F.explode(one).alias("x")).select("record_id", "fetched_at", "x.*")
    rows = rows.filter(F.trim("value") != "").join(groups.select("record_id", "group_id"), "record_id")
    return rows.groupBy("group_id", "field", "value").agg(
        F.min("record_id").alias("record_id"),
        F.max(F.struct((-F.col("rank")).alias("trust"), F.col("fetched_at"))).alias("best"),
    )


def value_quality(values: DataFrame, records: DataFrame, fields=("venue", "publisher")) -> DataFrame:
    """``(field, value, n_rows, cut_off)`` for every distinct value of the given column pair.

    ``values`` says how many of its rows hold each value (n_rows); how often a value occurs is counted
    over all rows of ``records``.
    """
    one = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    often = (
        records.select(F.explode(one).alias("x")).select("x.*").filter(~is_placeholder(F.col("value")))
        .groupBy("field", "value").agg(F.count("*").alias("n"))
    )
    often = cut(often, "often")
    heads = often.filter(F.length("value") > MIN_PREFIX).select(
        "field", "n", F.explode(F.expr(f"transform(sequence({MIN_PREFIX}, length(value) - 1), i -> left(value, i))")).alias("value")
    )
    longest = heads.groupBy("field", "value").agg(F.max("n").alias("longer"))
    flagged = often.join(longest, ["field", "value"], "left").select(
        "field", "value", (F.coalesce(F.col("longer"), F.lit(0)) >= F.col("n")).alias("cut_off")
    )
    counts = values.groupBy("field", "value").agg(F.count("*").alias("n_rows"))
    return counts.join(flagged, ["field", "value"], "left").withColumn("cut_off", F.coalesce("cut_off", F.lit(False)))


def survivors(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_id, field, record_id, value)`` for every group holding two or more different values.

    A group whose values are all placeholders has no row.
    """
    values = cut(field_values(records, groups), "survivor-values")
    known = lookup(values, cut(value_quality(values, records), "survivor-quality"), ["field", "value"])
    v = F.col("value")
    quality = (
        F.when(is_placeholder(v), F.lit(-1))
        .when(F.col("field") == "pages", F.when(v.rlike(r"\w\s*[-‐–—]+\s*\w"), 3).otherwise(2))
        .when((F.col("field") == "venue") & v.rlike(REPOSITORY), 0)
        .when(v.rlike(r"\p{L}\.(\s|$)"), 2)
        .when(F.col("cut_off"), 1)
        .otherwise(3)
    )
    best = known.groupBy("group_id", "field").agg(
        F.count("*").alias("n_values"),
        F.max(F.struct(quality.alias("quality"), F.col("best.trust"), F.col("best.fetched_at"), v, F.col("record_id"))).alias("b"),
    )
    return best.filter("n_values > 1 and b.quality >= 0").select("group_id", "field", "b.record_id", "b.value")
