"""Deeply nested records to related flat tables (problem 1): structural-variant tables.

Each payload is read once as a tree.  A bottom-up tree automaton gives every value a state: an atom type, an
array of a set of states, or an object as a set of key/state pairs.  The state of an object is its structural
variant; its id is a digest of its shape, in which nested element objects stand by their own variant, so all
workers agree without a shared table.  Every object that is an element of an array becomes a row of one flat
table that keeps the path, the path of the nearest enclosing such object (the parent link), the field
(supertype), the variant (subtype) and its own part, without the elements below it, which have rows of their own.
``route`` writes the rows of every variant to a table of its own, ``subtype`` reads one with typed columns,
``supertype`` keeps the keys common to all variants of a field.

Rules.  A single object in a field that holds an array of objects in other payloads of the same source
is element 0; which fields do is learnt in a first pass over all payloads (field = the name together
with the name of the enclosing array field, so plain wrappers do not matter).  JSON text inside a string
is the value it encodes.  Null, empty and invalid payloads give no rows; nesting may have any depth; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most (source, field) pairs sent to the workers at once; more are joined to the payloads instead.
MAX_FIELDS = 200_000

FLAT = "record_id long, source string, field string, path string, parent_path string, variant string, shape string, value string"


def _refuse(text: str):
    raise ValueError(text)


def _load(text):
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        try:
            return parse_deep(text)
        except ValueError:
            return None
    except (ValueError, TypeError):
        return None


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?|(true|false|null))')
_NAMED = {"true": True, "false": False, "null": None}


def parse_deep(text: str):
    """JSON of any depth, read with a stack instead of recursion; ValueError if it is not valid."""
    stack: list = []  # open containers
    keys: list = []  # pending key of each open object, None for arrays
    at, state = 0, "value"  # value, first (value or end), key, first_key, colon, after
    done = None
    while True:
        if state == "after" and not stack:
            if text[at:].strip(" \t\n\r"):
                raise ValueError("text after the value")
            return done
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at, sign = m.end(), m[1]
        if sign in ("}", "]"):
            if not stack or state not in ("after", "first_key" if sign == "}" else "first") or isinstance(stack[-1], dict) != (sign == "}"):
                raise ValueError(f"stray end at {at}")
            done = stack.pop()
            keys.pop()
        elif sign == ",":
            if state != "after":
                raise ValueError(f"stray comma at {at}")
            state = "key" if isinstance(stack[-1], dict) else "value"
            continue
        elif sign == ":":
            if state != "colon":
                raise ValueError(f"stray colon at {at}")
            state = "value"
            continue
        elif state in ("key", "first_key"):
            if not m[2]:
                raise ValueError(f"no key at {at}")
            keys[-1], at = json.decoder.scanstring(text, at)
            state = "colon"
            continue
        elif state not in ("value", "first"):
            raise ValueError(f"stray value at {at}")
        elif sign:
            stack.append({} if sign == "{" else [])
            keys.append(None)
            state = "first_key" if sign == "{" else "first"
            continue
        elif m[2]:
            done, at = json.decoder.scanstring(text, at)
        elif m[6]:
            done = _NAMED[m[6]]
        else:
            done = float(m[3] + (m[4] or "") + (m[5] or "")) if m[4] or m[5] else int(m[3])
        if stack:
            if isinstance(stack[-1], dict):
                stack[-1][keys[-1]] = done
            else:
                stack[-1].append(done)
        state = "after"


def decode(value):
    """The value itself, or what it encodes if it is a string holding a JSON object or array."""
    while isinstance(value, str):
        s = value.lstrip()
        if s[:1] not in ("{", "["):
            return value
        inner = _load(s)
        if not isinstance(inner, dict | list):
            return value
        value = inner
    return value


def root(raw):
    """The decoded payload, or None if it is no valid JSON object or array."""
    if not isinstance(raw, str):
        return None
    value = decode(_load(raw))
    return value if isinstance(value, dict | list) else None


def plain_and_array_fields(payload) -> tuple[set[tuple[str, str]], set[tuple[str, str]]]:
    """``(enclosing array field, field)`` of the fields that hold a single object, and of those that hold
    an array with an object in it."""
    plain, found, todo = set(), set(), [(payload, "", "")]
    for value, above, name in todo:  # grows while it is read
        if type(value) is dict:
            for k, v in value.items():
                kind = type(v)
                if kind is str and (v[:1] in "{[" or v[:1].isspace()):
                    v = decode(v)
                    kind = type(v)
                if kind is dict:
                    plain.add((above, k))
                    todo.append((v, above, k))
                elif kind is list:
                    todo.append((v, above, k))
        else:
            for v in value:
                v = decode(v) if type(v) is str else v
                if type(v) is dict:
                    found.add((above, name))
                    todo.append((v, name, name))
                elif type(v) is list:
                    todo.append((v, name, name))
    return plain, found


_ATOM = {bool: "b", int: "i", float: "f", str: "s", type(None): "n"}


class Automaton:
    """States of the tree automaton, numbered as they are met; equal states share shape text and variant id.

    Shapes: an atom is a letter, an array ``[a|b]``, an object ``{"key":shape,...}``; an element object below
    stands as ``@variant`` (a single object that counts as element 0 as ``[@variant]``).
    """

    def __init__(self):
        self.met: dict[tuple, int] = {}
        self.number: dict[str, int] = {}
        self.shape: list[str] = []
        self.variant: list[str] = []

    def _ref(self, child, in_array: bool) -> str:
        if isinstance(child, str):
            return child
        n, is_element = divmod(child, 2)
        return self.shape[n] if not is_element else f"@{self.variant[n]}" if in_array else f"[@{self.variant[n]}]"

    def state(self, keys: tuple | None, children: tuple | frozenset) -> int:
        """Number of the state of an object (or array, without keys) from the atoms and states of its children;
        a child state is twice its number, plus one if the child is an element."""
        n = self.met.get((keys, children))
        if n is None:
            refs = [self._ref(c, keys is None) for c in children]
            if keys is None:
                text = "[" + "|".join(sorted(set(refs))) + "]"
            else:
                text = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{r}" for k, r in sorted(zip(keys, refs, strict=True))) + "}"
            n = self.number.get(text)
            if n is None:
                n = self.number[text] = len(self.shape)
                self.shape.append(text)
                self.variant.append(hashlib.md5(text.encode("utf-8", "replace"), usedforsecurity=False).hexdigest()[:16])
            self.met[keys, children] = n
        return n


def elements(payload, single: set[tuple[str, str]], automaton: Automaton, values: bool = True) -> list[tuple[str, str, str, str, str, str | None]]:
    """``(field, path, parent path, variant, shape, own value)`` of every element object of a payload."""
    # nodes, parents before children: value, path, enclosing element, enclosing array field, own field, is an element
    nodes: list[tuple] = [(payload, "", "", "", "", False)]
    below: list[list] = []  # of each node: atoms by letter, containers by number
    for value, path, parent, above, name, is_element in nodes:  # grows while it is read
        mine: list = []
        inside = path if is_element else parent
        if type(value) is dict:
            here = name if is_element else above
            for k, v in value.items():
                kind = type(v)
                if kind is str and (v[:1] in "{[" or v[:1].isspace()):
                    v = decode(v)
                    kind = type(v)
                if kind is dict or kind is list:
                    alone = kind is dict and (here, k) in single
                    loc = f"{path}.{k}" if path else k
                    mine.append(len(nodes))
                    nodes.append((v, loc + "[0]" if alone else loc, inside, here, k, alone))
                else:
                    mine.append(_ATOM[kind])
        else:
            for i, v in enumerate(value):
                kind = type(v)
                if kind is str and (v[:1] in "{[" or v[:1].isspace()):
                    v = decode(v)
                    kind = type(v)
                if kind is dict or kind is list:
                    mine.append(len(nodes))
                    nodes.append((v, f"{path}[{i}]", inside, name, name, kind is dict))
                else:
                    mine.append(_ATOM[kind])
        below.append(mine)
    states, own = [0] * len(nodes), [None] * len(nodes)
    rows = []
    for n in range(len(nodes) - 1, -1, -1):
        value, path, parent, _, name, is_element = nodes[n]
        children = [c if type(c) is str else 2 * states[c] + nodes[c][5] for c in below[n]]
        s = states[n] = automaton.state(None, frozenset(children)) if type(value) is list else automaton.state(tuple(value), tuple(children))
        if values:
            own[n] = _own_part(value, below[n], nodes, own)
        if is_element:
            rows.append((name, path, parent, automaton.variant[s], automaton.shape[s], dump(own[n]) if values else None))
    rows.reverse()
    return rows


def _own_part(value, below: list, nodes: list[tuple], own: list):
    """A container without the element objects in it (their field stays as an array), text that encodes JSON decoded."""
    if all(type(c) is str for c in below):
        return value
    if type(value) is dict:
        return {k: v if type(c) is str else [] if nodes[c][5] else own[c] for (k, v), c in zip(value.items(), below, strict=True)}
    return [v if type(c) is str else own[c] for v, c in zip(value, below, strict=True) if type(c) is str or not nodes[c][5]]


def dump(value) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(value)
    except RecursionError:
        out, todo = [], [(False, value)]  # text to write, or a value
        while todo:
            is_text, x = todo.pop()
            if is_text or not isinstance(x, dict | list):
                out.append(x if is_text else json.dumps(x))
                continue
            parts: list = [(True, "{" if isinstance(x, dict) else "[")]
            for i, y in enumerate(x):
                parts.append((True, (", " if i else "") + (json.dumps(y) + ": " if isinstance(x, dict) else "")))
                parts.append((False, x[y] if isinstance(x, dict) else y))
            todo.extend(reversed([*parts, (True, "}" if isinstance(x, dict) else "]")]))
        return "".join(out)


def _utf8(text):
    return text.encode("utf-8", "replace").decode("utf-8")


def _scan_fields(which: int):
    """mapInPandas function: the plain (0) or array (1) fields of all payloads of a batch."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = set()
            for source, raw in zip(pdf["source"], pdf["raw"], strict=True):
                if (payload := root(raw)) is not None:
                    seen.update((source, _utf8(a), _utf8(k)) for a, k in plain_and_array_fields(payload)[which])
            yield pd.DataFrame(sorted(seen, key=str), columns=["source", "above", "field"])

    return scan


def learn_array_fields(records: DataFrame) -> DataFrame:
    """``(source, above, field)`` of all fields that hold arrays of objects anywhere, distinct."""
    return records.select("source", "raw").filter("raw is not null").mapInPandas(_scan_fields(1), "source string, above string, field string").distinct()


def flatten_objects(records: DataFrame, values: bool = True, max_fields: int = MAX_FIELDS) -> DataFrame:
    """The flat table of all element objects of ``records(record_id, source, raw)``; columns of FLAT.

    ``values``: whether ``value`` holds the object's own part as JSON (else null).  Redelivered payloads are repeated.
    """
    rows = records.select("record_id", "source", "raw").filter("record_id is not null and raw is not null")
    fields = learn_array_fields(rows)
    known = fields.limit(max_fields + 1).collect()  # schemas, not rows, decide how many there are
    if len(known) > max_fields:
        return _flatten_joined(rows, fields, values)
    single: dict = {}
    for source, above, field in known:
        single.setdefault(source, set()).add((above, field))
    shared = records.sparkSession.sparkContext.broadcast(single)
    return rows.mapInPandas(_flat(lambda pdf: (shared.value.get(s, set()) for s in pdf["source"]), values), FLAT)


def _flat(single_of, values: bool):
    """mapInPandas function: the flat rows of a batch; ``single_of`` gives the array fields that matter to each row."""

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton()
        for pdf in batches:
            if len(automaton.shape) > 1_000_000:  # states are numbered anew, ids stay the same
                automaton = Automaton()
            rows = []
            for rid, source, raw, single in zip(pdf["record_id"], pdf["source"], pdf["raw"], single_of(pdf), strict=True):
                if (payload := root(raw)) is not None:
                    rows += [(int(rid), source, *(x if x is None or x.isascii() else _utf8(x) for x in e)) for e in elements(payload, single, automaton, values)]
            yield pd.DataFrame(rows, columns=["record_id", "source", "field", "path", "parent_path", "variant", "shape", "value"])

    return flat


def _flatten_joined(rows: DataFrame, fields: DataFrame, values: bool) -> DataFrame:
    """The same where the fields are too many to send out: each distinct payload is joined with those of its own
    plain fields that hold arrays elsewhere."""
    keyed = rows.withColumn("_payload", F.sha2(F.concat_ws("|", F.coalesce("source", F.lit("")), "raw"), 256))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, source, raw in zip(pdf["_payload"], pdf["source"], pdf["raw"], strict=True):
                if (payload := root(raw)) is not None:
                    out += [(key, source, _utf8(a), _utf8(k)) for a, k in plain_and_array_fields(payload)[0]]
            yield pd.DataFrame(out, columns=["_payload", "source", "above", "field"])

    plain = keyed.select("_payload", "source", "raw").mapInPandas(scan, "_payload string, source string, above string, field string").distinct()
    both = fields.withColumnRenamed("source", "_s")
    mine = plain.join(both, (plain["source"].eqNullSafe(both["_s"])) & (plain["above"] == both["above"]) & (plain["field"] == both["field"]), "left_semi")
    singles = mine.groupBy("_payload").agg(F.collect_set(F.struct("above", "field")).alias("_single"))  # as many as the payload has fields
    told = keyed.join(singles, "_payload", "left").select("record_id", "source", "raw", "_single")
    return told.mapInPandas(_flat(lambda pdf: (set() if x is None else {(r["above"], r["field"]) for r in x} for x in pdf["_single"]), values), FLAT)


def variants(flat: DataFrame) -> DataFrame:
    """Catalogue of the automaton's object states: ``(source, field, variant, shape, n)``."""
    return flat.groupBy("source", "field", "variant").agg(F.first("shape").alias("shape"), F.count("*").alias("n"))


def spark_type(shape: str) -> T.DataType:
    """Spark type of the own part of a state; a mixed array becomes an array of text, as does an empty one."""
    # a stack instead of recursion: each open container with its parts so far
    stack: list[list] = [[]]
    at, decoder = 0, json.JSONDecoder()
    keys: list = []
    while at < len(shape):
        c = shape[at]
        at += 1
        if c in "{[":
            stack.append([c])
        elif c == '"':
            key, at = decoder.raw_decode(shape, at - 1)
            keys.append((len(stack), key))
            at += 1  # the colon
            continue
        elif c == "@":
            at += 16
            continue
        elif c in ",|":
            continue
        elif c == "}":
            fields = stack.pop()[1:]
            kind: T.DataType | None = T.StructType(fields) if fields else T.StringType()
            _close(stack, keys, kind)
        elif c == "]":
            kinds = stack.pop()[1:]
            only_elements = not kinds and shape[at - 2] != "["
            _close(stack, keys, None if only_elements else T.ArrayType(kinds[0] if len({str(k) for k in kinds}) == 1 else T.StringType()))
        else:
            _close(stack, keys, {"b": T.BooleanType(), "i": T.LongType(), "f": T.DoubleType(), "s": T.StringType(), "n": T.StringType()}[c])
    return stack[0][0]


def _close(stack: list[list], keys: list, kind: T.DataType | None) -> None:
    """Put a finished type into the container it belongs to; None (nothing but element objects) is left out."""
    key = keys.pop()[1] if keys and keys[-1][0] == len(stack) else None
    if kind is not None:
        stack[-1].append(kind if key is None else T.StructField(key, kind))


def route(flat: DataFrame, folder: str) -> None:
    """Write the rows of every variant to a table of its own below ``folder``, in one job."""
    rows = flat.select("record_id", "path", "parent_path", "value", "source", "field", "variant").repartition("source", "field", "variant", F.pmod(F.xxhash64("record_id"), F.lit(16)))
    rows.write.mode("overwrite").partitionBy("source", "field", "variant").parquet(folder)


def routed(spark: SparkSession, folder: str) -> DataFrame:
    """All routed rows; a filter on source, field or variant reads just those tables."""
    kinds = "record_id long, path string, parent_path string, value string, source string, field string, variant string"
    return spark.read.schema(kinds).parquet(folder)


def subtype(flat: DataFrame, source: str, field: str, variant: str, shape: str) -> DataFrame:
    """Typed table of one structural variant: keys, parent link and the typed columns in ``data``."""
    rows = flat.filter((F.col("source") == source) & (F.col("field") == field) & (F.col("variant") == variant))
    return rows.select("record_id", "path", "parent_path", F.from_json("value", spark_type(shape)).alias("data"))


def supertypes(flat: DataFrame) -> DataFrame:
    """``(record_id, source, field, path, parent_path, variant, common)``: every row with the keys that all variants
    of its field have, as a map to JSON text."""
    rows = flat.withColumn("own", F.from_json("value", "map<string,string>"))
    kinds = rows.groupBy("source", "field", "variant").agg(F.first(F.map_keys("own")).alias("keys"))
    n = kinds.groupBy("source", "field").agg(F.count("*").alias("n_variants"))
    held = kinds.select("source", "field", F.explode("keys").alias("key")).groupBy("source", "field", "key").agg(F.count("*").alias("n"))
    common = held.join(n, ["source", "field"]).filter("n = n_variants").groupBy("source", "field").agg(F.collect_set("key").alias("keys"))
    kept = F.map_filter("own", lambda k, v: F.array_contains(F.coalesce("keys", F.array().cast("array<string>")), k))
    return rows.join(common, ["source", "field"], "left").select("record_id", "source", "field", "path", "parent_path", "variant", kept.alias("common"))
