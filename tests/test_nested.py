import json
import random

from pyspark.sql import functions as F

from citeloom.operators import nested

ROWS = [
    (1, "s", json.dumps({"a": [{"b": [{"c": 1}, {"c": 2}]}, {"b": {"c": 3}}], "t": "x"})),
    (2, "s", json.dumps({"wrap": {"a": {"d": '[{"e": 1}]'}}})),
    (3, "s", "{broken"), (4, "s", None), (5, "s", ""), (6, "t", json.dumps({"a": {"b": 1}})), (7, "s", json.dumps([{"x": [[{"y": 1}]]}])), (8, "s", "NaN"),
]


def test_paths(spark):
    df = spark.createDataFrame(ROWS, "record_id long, source string, raw string")
    got = {(r.record_id, r.path): r.parent_path for r in nested.flatten_objects(df, values=False).collect()}
    assert got == {
        (1, "a[0]"): "", (1, "a[0].b[0]"): "a[0]", (1, "a[0].b[1]"): "a[0]", (1, "a[1]"): "", (1, "a[1].b[0]"): "a[1]",
        (2, "wrap.a[0]"): "", (2, "wrap.a[0].d[0]"): "wrap.a[0]", (7, "[0]"): "", (7, "[0].x[0][0]"): "[0]",
    }


def test_tables_and_variants(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "record_id long, source string, raw string").withColumn("path", F.lit("clash")).withColumn("field", F.lit(1))
    flat = nested.flatten_objects(df).cache()
    cat = {(r.field, r.shape): r for r in nested.variants(flat).collect()}
    v = cat[("b", '{"c":i}')]
    nested.route(flat, str(tmp_path / "variants"))
    for place in (flat, nested.routed(spark, str(tmp_path / "variants"))):
        typed = nested.subtype(place, "s", "b", v.variant, v.shape)
        assert sorted((r.record_id, r.path, r.parent_path, r.data.c) for r in typed.collect()) == [(1, "a[0].b[0]", "a[0]", 1), (1, "a[0].b[1]", "a[0]", 2), (1, "a[1].b[0]", "a[1]", 3)]
    assert len({s for (f, s) in cat if f == "a"}) == 2  # b as array or as single object, d as text
    common = {(r.field, r.path): r.common for r in nested.supertypes(flat).collect() if r.record_id == 1}
    assert common[("b", "a[0].b[0]")] == {"c": "1"} and common[("a", "a[0]")] == {}  # one variant has b, the other d


def test_own_part_has_no_child_rows(spark):
    raw = json.dumps({"a": [{"n": 1, "p": {"q": [{"r": 1}], "s": "x"}, "m": [1, {"t": 2}], "e": '{"u": 5}'}]})
    df = spark.createDataFrame([(1, "s", raw)], "record_id long, source string, raw string")
    rows = {r.path: r for r in nested.flatten_objects(df).collect()}
    assert set(rows) == {"a[0]", "a[0].p.q[0]", "a[0].m[1]"}
    assert json.loads(rows["a[0]"].value) == {"n": 1, "p": {"q": [], "s": "x"}, "m": [1], "e": {"u": 5}}
    assert nested.spark_type(rows["a[0]"].shape).simpleString() == "struct<e:struct<u:bigint>,m:array<bigint>,n:bigint,p:struct<s:string>>"


def test_too_many_fields_to_send_out(spark):
    df = spark.createDataFrame(ROWS + ROWS[:2], "record_id long, source string, raw string")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(nested.flatten_objects(df, max_fields=1)) == rows(nested.flatten_objects(df))


def test_empty_and_deep(spark):
    empty = spark.createDataFrame([], "record_id long, source string, raw string")
    assert nested.flatten_objects(empty).count() == 0
    n = 3000
    deep = "[" * 30000 + "]" * 30000
    long = json.dumps({"a": [{"t": "x" * 300_000}] * 20})
    chain = '{"a":[{"p":' * n + "1" + "}]}" * n
    df = spark.createDataFrame([(1, "s", deep), (2, "s", long), (3, "s", chain), (4, "s", chain[:-1])], "record_id long, source string, raw string")
    flat = nested.flatten_objects(df).cache()
    assert {r.record_id: r.n for r in flat.groupBy("record_id").agg(F.count("*").alias("n")).collect()} == {2: 20, 3: n}
    assert flat.filter("record_id = 3").agg(F.max(F.length("value"))).first()[0] < 30
    nest = {"k": 1}
    for _ in range(60_000):
        nest = [nest]
    assert json.loads(nested.dump({"a": [1, {"b": None}], "c": "é"})) == {"a": [1, {"b": None}], "c": "é"} and nested.dump(nest).count("[") == 60_000


def test_deep_parser_agrees_with_json():
    rng = random.Random(1)

    def make(depth):
        r = rng.random()
        if depth == 0 or r < 0.4:
            return rng.choice([None, True, 1, -2.5, 'a"bé', 1e30, "", [], {}])
        return [make(depth - 1) for _ in range(rng.randrange(4))] if r < 0.7 else {rng.choice("abé") * rng.randrange(1, 3): make(depth - 1) for _ in range(rng.randrange(4))}

    def read(parse, text):
        try:
            return parse(text)
        except ValueError:
            return "invalid"

    for _ in range(500):
        text = json.dumps(make(5), indent=rng.choice([None, 1]))
        i = rng.randrange(len(text) + 1)
        for t in (text, text[:i] + rng.choice('{}[],:"1 tx') + text[i + rng.randrange(2) :]):
            assert read(nested.parse_deep, t) == read(lambda x: json.loads(x, parse_constant=nested._refuse), t)
