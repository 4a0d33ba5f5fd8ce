"""Queries for the general training-data problems (problem 1)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import nested
from citeloom.runtime import cut, kept, table, work_dir


def _flat(spark: SparkSession, sf_dir: str, values: bool = False) -> DataFrame:
    return nested.flatten_objects(table(spark, sf_dir, "source_records"), values)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an array element in raw, with its path and parent path: the keys of all variants' tables."""
    return _flat(spark, sf_dir).select("record_id", "path", "parent_path").distinct()


def p1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of structural variants over all payloads, with counts of distinct element objects."""
    return nested.variants(_flat(spark, sf_dir).select("record_id", "source", "field", "path", "variant", "shape").distinct())


def p1_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and parents per source and field: size of each related table."""
    flat = _flat(spark, sf_dir).select("record_id", "source", "field", "path", "parent_path").distinct()
    return flat.groupBy("source", "field").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("parent_path") != "").alias("n_with_parent")
    )


def p1_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema of every supertype table: the keys that all variants of a field have, with rows and filled cells."""
    rows = nested.supertypes(cut(_flat(spark, sf_dir, True).distinct(), "flat"))
    cells = rows.select("source", "field", F.explode("common").alias("key", "value"))
    return cells.groupBy("source", "field", "key").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_filled"))


def p1_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant's own table, written by one job and read again: rows and records it holds."""
    folder = f"{work_dir(spark)}/citeloom-variants-{uuid.uuid4().hex}"
    nested.route(_flat(spark, sf_dir, True).distinct(), folder)
    rows = kept(spark, nested.routed(spark, folder), folder)
    return rows.groupBy("source", "field", "variant").agg(F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_records"))


def p1_crossref_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of all variants of one field, with the link to their parent."""
    flat = cut(_flat(spark, sf_dir, True).filter("source = 'crossref' and field = 'author'").distinct(), "flat")
    shapes = flat.select("variant", "shape").distinct().collect()  # as many as the field has shapes
    out = None
    for variant, shape in sorted(map(tuple, shapes)):
        typed = nested.subtype(flat, "crossref", "author", variant, shape)
        have = set(typed.schema["data"].dataType.names) if hasattr(typed.schema["data"].dataType, "names") else set()
        one = typed.select("record_id", "path", "parent_path", *[(F.col(f"data.{c}") if c in have else F.lit(None)).cast("string").alias(c) for c in ("family", "given", "sequence")])
        out = one if out is None else out.union(one)
    empty = spark.createDataFrame([], "record_id long, path string, parent_path string, family string, given string, sequence string")
    return empty if out is None else out.distinct()


QUERIES = {
    "p1_found": p1_found, "p1_variants": p1_variants, "p1_levels": p1_levels, "p1_common": p1_common, "p1_routed": p1_routed,
    "p1_crossref_authors": p1_crossref_authors,
}
# A string that holds a JSON object or array counts as what it encodes.
_DECODED = "CASE WHEN json_type({0}) = 'VARCHAR' AND regexp_matches({0} ->> '$', '^\\s*[\\[{{]') AND json_valid({0} ->> '$') THEN json({0} ->> '$') ELSE {0} END"

_WALK = f"""RECURSIVE raws AS (SELECT DISTINCT record_id, source, json(raw) AS v FROM source_records WHERE json_valid(raw) AND regexp_matches(raw, '^\\s*[\\[{{]')),
    scan AS (SELECT source, v AS val, '' AS above, '' AS name, '' AS p_above, '' AS p_name, '' AS p_type FROM raws
      UNION ALL SELECT source, x, CASE WHEN arr THEN name ELSE above END, CASE WHEN arr THEN name ELSE key END, above, name, CASE WHEN arr THEN 'ARRAY' ELSE 'OBJECT' END
      FROM (SELECT s.source, s.above, s.name, c.key, json_type(s.val) = 'ARRAY' AS arr, {_DECODED.format('c.value')} AS x FROM scan s, json_each(s.val) c)
      WHERE json_type(x) IN ('OBJECT', 'ARRAY')),
    fields AS (SELECT DISTINCT source, p_above, p_name FROM scan WHERE p_type = 'ARRAY' AND json_type(val) = 'OBJECT'),
    walk AS (SELECT record_id, source, v AS val, '' AS path, '' AS enclosing, '' AS parent_path, '' AS above, '' AS name, false AS elem FROM raws
      UNION ALL SELECT record_id, source, x, loc, CASE WHEN el THEN loc ELSE enclosing END, enclosing,
        CASE WHEN el AND NOT arr THEN key WHEN arr THEN name ELSE above END, CASE WHEN arr THEN name ELSE key END, el
      FROM (SELECT *, CASE WHEN arr THEN path || '[' || key || ']'
          ELSE path || CASE WHEN path = '' THEN '' ELSE '.' END || key || CASE WHEN el THEN '[0]' ELSE '' END END AS loc
        FROM (SELECT y.*, json_type(x) = 'OBJECT' AND (arr OR f.p_name IS NOT NULL) AS el
          FROM (SELECT s.record_id, s.source, s.path, s.enclosing, s.above, s.name, c.key, json_type(s.val) = 'ARRAY' AS arr, {_DECODED.format('c.value')} AS x
            FROM walk s, json_each(s.val) c) y
          LEFT JOIN fields f ON f.source = y.source AND f.p_above = y.above AND f.p_name = y.key AND NOT y.arr
          WHERE json_type(x) IN ('OBJECT', 'ARRAY')))),
    elements AS (SELECT DISTINCT record_id, source, name AS field, path, parent_path FROM walk WHERE elem)"""

#: Levels of nesting the SQL of the variants looks at (the operator has no limit).
_LEVELS = 14
_REF = "CASE WHEN elem AND in_array THEN '@' || left(md5(shape), 16) WHEN elem THEN '[@' || left(md5(shape), 16) || ']' ELSE shape END"


def _level(d: int) -> str:
    kids = "" if d == _LEVELS else f"""LEFT JOIN (SELECT record_id, source, pid, string_agg(to_json(key)::VARCHAR || ':' || ref, ',' ORDER BY key) AS pairs, string_agg(DISTINCT ref, '|' ORDER BY ref) AS refs
      FROM (SELECT *, {_REF} AS ref FROM s{d + 1}) GROUP BY ALL) k ON k.record_id = t.record_id AND k.source = t.source AND k.pid = t.nid"""
    pairs, refs = ("''", "''") if d == _LEVELS else ("coalesce(k.pairs, '')", "coalesce(k.refs, '')")
    return f"""s{d} AS (SELECT t.*, CASE json_type(t.val) WHEN 'OBJECT' THEN '{{{{' || {pairs} || '}}}}' WHEN 'ARRAY' THEN '[' || {refs} || ']' WHEN 'VARCHAR' THEN 's' WHEN 'BOOLEAN' THEN 'b' WHEN 'NULL' THEN 'n'
      WHEN 'DOUBLE' THEN 'f' ELSE 'i' END AS shape FROM tree t {kids} WHERE t.depth = {d})""".replace("{{", "{").replace("}}", "}")


_TREE = f"""{_WALK},
    tree AS (SELECT record_id, source, v AS val, '' AS nid, NULL::VARCHAR AS pid, '' AS key, '' AS path, '' AS above, '' AS name, false AS elem, false AS in_array, 0 AS depth FROM raws
      UNION ALL SELECT record_id, source, x, nid || '/' || key, nid, key, loc, CASE WHEN el AND NOT arr THEN key WHEN arr THEN name ELSE above END, CASE WHEN arr THEN name ELSE key END, el, arr, depth + 1
      FROM (SELECT *, CASE WHEN arr THEN path || '[' || key || ']'
          ELSE path || CASE WHEN path = '' THEN '' ELSE '.' END || key || CASE WHEN el THEN '[0]' ELSE '' END END AS loc
        FROM (SELECT y.*, json_type(x) = 'OBJECT' AND (arr OR f.p_name IS NOT NULL) AS el
          FROM (SELECT s.record_id, s.source, s.path, s.nid, s.depth, s.above, s.name, c.key, json_type(s.val) = 'ARRAY' AS arr, {_DECODED.format('c.value')} AS x
            FROM tree s, json_each(s.val) c WHERE json_type(s.val) IN ('OBJECT', 'ARRAY')) y
          LEFT JOIN fields f ON f.source = y.source AND f.p_above = y.above AND f.p_name = y.key AND NOT y.arr))),
    {", ".join(_level(d) for d in range(_LEVELS, -1, -1))},
    shapes AS ({" UNION ALL ".join(f"SELECT record_id, source, nid, path, name AS field, val, shape FROM s{d} WHERE elem" for d in range(_LEVELS + 1))}),
    shaped AS (SELECT DISTINCT record_id, source, field, path, left(md5(shape), 16) AS variant, shape FROM shapes)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_WALK} SELECT DISTINCT record_id, path, parent_path FROM elements",
    "p1_levels": f"WITH {_WALK} SELECT source, field, count(*) AS n_rows, count(*) FILTER (parent_path <> '') AS n_with_parent FROM elements GROUP BY source, field",
    "p1_variants": f"WITH {_TREE} SELECT source, field, variant, any_value(shape) AS shape, count(*) AS n FROM shaped GROUP BY source, field, variant",
    "p1_routed": f"WITH {_TREE} SELECT source, field, variant, count(*) AS n_rows, count(DISTINCT record_id) AS n_records FROM shaped GROUP BY source, field, variant",
    "p1_common": f"""WITH {_TREE},
    cells AS (SELECT s.source, s.field, s.variant, s.record_id, s.path, t.key, json_type(t.val) <> 'NULL' AS filled FROM (SELECT DISTINCT record_id, source, field, path, nid, left(md5(shape), 16) AS variant FROM shapes) s
      JOIN (SELECT DISTINCT record_id, source, pid, key, val FROM tree) t ON t.record_id = s.record_id AND t.source = s.source AND t.pid = s.nid),
    held AS (SELECT source, field, key, count(DISTINCT variant) AS n FROM cells GROUP BY source, field, key),
    kinds AS (SELECT source, field, count(DISTINCT variant) AS n FROM shaped GROUP BY source, field),
    common AS (SELECT h.source, h.field, h.key FROM held h JOIN kinds k ON k.source = h.source AND k.field = h.field AND k.n = h.n)
    SELECT source, field, key, count(*) AS n_rows, count(*) FILTER (filled) AS n_filled FROM cells JOIN common USING (source, field, key) GROUP BY ALL""",
    "p1_crossref_authors": f"""WITH {_TREE} SELECT DISTINCT e.record_id, e.path, e.parent_path, s.val ->> 'family' AS family, s.val ->> 'given' AS given, s.val ->> 'sequence' AS sequence
    FROM elements e JOIN shapes s ON s.record_id = e.record_id AND s.source = e.source AND s.path = e.path WHERE e.source = 'crossref' AND e.field = 'author'""",
}
