"""Deeply nested semi-structured records to related flat tables (problem 1)."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerline.functions.bitmap import maybe_in
from ledgerline.functions.ids import norm_id
from ledgerline.sources.shared import counted, materialize, new_path

#: List fields whose object elements become rows. Fixed values.
LIST_FIELDS = ["channels", "attempts", "candidates", "repositories", "pages", "signals", "categories", "columns", "members"]
TABLES = 2000  #: the most frequent variants get typed columns; all others share one folder with their fields as a map
FLUSH = 8 << 20  #: characters of rows that are held before they go on

NODES = T.StructType([T.StructField(n, T.StringType()) for n in ("record_ref", "node_kind", "parent_kind", "parent_path", "node_path", "variant", "shape")] + [T.StructField("own", T.MapType(T.StringType(), T.StringType()))])
_ARROW = pa.schema([(n, pa.string()) for n in NODES.names[:-1]] + [("own", pa.map_(pa.string(), pa.string()))])
#: First character of a value in `own`, by its automaton state, and the type of its column. Nested values stay JSON text.
CODES = {"bool": ("b", "boolean"), "int": ("i", "bigint"), "float": ("f", "double"), "number": ("x", "string"), "text": ("t", "string")}


class Number(str):
    """The text of a number that neither bigint nor double holds."""


def _reject(name: str):
    raise ValueError(name)


def _float(text: str):
    value = float(text)
    return value if math.isfinite(value) else Number(text)


_DECODER = json.JSONDecoder(parse_constant=_reject, parse_float=_float)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(")|(-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def parse(text):
    """The value of a JSON text of any depth, or raise ValueError; NaN and Infinity are not JSON."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)
    except json.JSONDecodeError:
        raise
    except ValueError as e:
        if "digits" in str(e):  # Python's own limit for integers, not one of JSON
            return _parse_deep(text)
        raise


def _parse_deep(text: str):
    """parse() with a stack of its own: `expect` tells what may come next in the innermost open list or object."""
    stack, keys, root, expect, at = [], [], None, "value", 0
    while m := _TOKEN.match(text, at):
        at, sign = m.end(), m[1]
        if sign == ",":
            if expect != "next":
                raise ValueError("comma")
            expect = "value" if isinstance(stack[-1], list) else "key"
        elif sign == ":":
            if expect != "colon":
                raise ValueError("colon")
            expect = "value"
        elif sign in ("]", "}"):
            if not stack or isinstance(stack[-1], list) != (sign == "]") or expect not in ("next", "open"):
                raise ValueError("bracket")
            stack.pop()
            keys.pop()
            expect = "next" if stack else "end"
        else:
            if m[2]:
                value, at = scanstring(text, at)
                if expect == "key" or expect == "open" and isinstance(stack[-1], dict):
                    keys[-1], expect = value, "colon"
                    continue
            elif m[3]:
                value = _float(m[3]) if m[4] or m[5] else int(m[3]) if len(m[3]) < 4000 else Number(m[3])
            else:
                value = _WORDS[m[6]] if m[6] else [] if sign == "[" else {}
            if expect != "value" and not (expect == "open" and isinstance(stack[-1], list)):
                raise ValueError("value")
            if not stack:
                root = value
            elif isinstance(stack[-1], list):
                stack[-1].append(value)
            else:
                stack[-1][keys[-1]] = value
            if sign:
                stack.append(value)
                keys.append(None)
                expect = "open"
            else:
                expect = "next" if stack else "end"
    if expect != "end" or text[at:].strip(" \t\n\r"):
        raise ValueError("not JSON")
    return root


@lru_cache(maxsize=100_000)
def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _scalar(value) -> str:
    return str(value) if isinstance(value, Number) else json.dumps(value, ensure_ascii=False)


def dumps(value) -> str:
    """JSON text of a value of any depth, without blanks."""
    out, todo = [], [(None, value)]
    while todo:
        text, value = todo.pop()
        if text is not None:
            out.append(text)
        elif isinstance(value, dict):
            todo.append(("}", None))
            items = list(value.items())
            for i in range(len(items) - 1, -1, -1):
                todo.append((None, items[i][1]))
                todo.append(("," * (i > 0) + _quoted(items[i][0]) + ":", None))
            out.append("{")
        elif isinstance(value, list):
            todo.append(("]", None))
            for i in range(len(value) - 1, -1, -1):
                todo.append((None, value[i]))
                if i:
                    todo.append((",", None))
            out.append("[")
        else:
            out.append(_scalar(value))
    return "".join(out)


def opened(value):
    """Text that itself holds a JSON object or list counts as that object or list."""
    while isinstance(value, str):
        head = value.lstrip()[:1]
        if head not in ("{", "["):
            return value
        try:
            inner = parse(value)
        except ValueError:
            return value
        if not isinstance(inner, (dict, list)):
            return value
        value = inner
    return value


class ShapeAutomaton:
    """Bottom-up tree automaton over JSON values: the state of a node follows from its children's states.

    Leaves have the states null, bool, int, float, number (too large for a column type) and text; a list has the set of
    its elements' states; an object has the sorted (field, state) pairs. A list field that is routed to tables of its
    own contributes one state `table`, whatever its elements, so the number of object states does not multiply along
    the nesting. An inner state of more than 500 characters goes by its digest. Values may be nested to any depth.
    """

    def __init__(self, list_fields):
        self.list_fields = frozenset(list_fields)

    @staticmethod
    def leaf(value) -> str | None:
        """State of a value that is no list or object; text must be opened before."""
        if value is None:
            return "null"
        kind = type(value)
        if kind is bool:
            return "bool"
        if kind is int:
            return "int" if -(1 << 63) <= value < 1 << 63 else "number"
        if kind is float:
            return "float"
        if kind is Number:
            return "number"
        return "text" if kind is str else None

    def field(self, key, value) -> str:
        """State of an object's field; value: opened."""
        if key in self.list_fields and isinstance(value, (list, dict)):
            return "table"
        return self.leaf(value) or self.state(value)

    def state(self, value) -> str:
        value = opened(value)
        if known := self.leaf(value):
            return known
        frames = [self._frame(value)]
        while True:
            keys, children, states = frames[-1]
            for child in children:
                at = len(states)
                child = opened(child)
                if keys is not None and keys[at] in self.list_fields and isinstance(child, (list, dict)):
                    states.append("table")
                elif known := self.leaf(child):
                    states.append(known)
                else:
                    frames.append(self._frame(child))
                    break
            else:
                frames.pop()
                done = "[" + "|".join(sorted(set(states))) + "]" if keys is None else self.named(keys, states)
                if not frames:
                    return done
                if len(done) > 500:
                    done = f"{done[0]}#{hashlib.md5(done.encode('utf-8', 'replace')).hexdigest()}{done[-1]}"
                frames[-1][2].append(done)

    @staticmethod
    def _frame(value):
        if isinstance(value, list):
            return None, iter(value), []
        keys = sorted(value)
        return keys, iter([value[k] for k in keys]), []

    @staticmethod
    def named(keys, states) -> str:
        return "{" + ",".join(f"{_quoted(k)}:{s}" for k, s in zip(keys, states)) + "}"

    def describe(self, obj: dict) -> tuple[str, list[tuple[str, str | None]]]:
        """State of an object, and its fields that are no tables of their own: (name, code and text; null for null)."""
        keys, states, own = sorted(obj), [], []
        for key in keys:
            raw = obj[key]
            value = opened(raw)
            state = self.field(key, value)
            states.append(state)
            if state == "table":
                continue
            code = CODES.get(state, ("j",))[0]
            own.append((key, None if state == "null" else code + (raw if isinstance(raw, str) else dumps(value))))
        return self.named(keys, states), own


def elements(root, list_fields) -> Iterator[tuple[str, str, str, str, dict]]:
    """(kind, parent kind, parent path, path, object) of each element, without recursion."""
    stack = [(opened(root), "", "", "", None)]  # value, its path, nearest element's path and kind, list field it is in
    while stack:
        value, path, parent, parent_kind, kind = stack.pop()
        if isinstance(value, dict):
            if kind is not None:
                yield kind, parent_kind, parent, path, value
                parent, parent_kind = path, kind
            for key, child in value.items():
                child, at = opened(child), f"{path}.{key}" if path else key
                if key in list_fields and isinstance(child, dict):
                    stack.append((child, f"{at}[0]", parent, parent_kind, key))
                elif key in list_fields and isinstance(child, list):
                    stack.extend((opened(x), f"{at}[{i}]", parent, parent_kind, key) for i, x in enumerate(child))
                elif isinstance(child, (dict, list)):
                    stack.append((child, at, parent, parent_kind, None))
        elif isinstance(value, list):
            stack.extend((opened(x), f"{path}[{i}]", parent, parent_kind, None) for i, x in enumerate(value))


_HALF = re.compile("[\ud800-\udfff]")  # halves of surrogate pairs, which no UTF-8 text holds


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ARROW)
    try:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
    except (UnicodeEncodeError, pa.ArrowInvalid):
        whole = lambda x: _HALF.sub("�", x) if isinstance(x, str) else x
        columns = [[whole(x) for x in c] for c in columns[:-1]] + [[list({whole(k): whole(v) for k, v in own or ()}.items()) for own in columns[-1]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _walk(bodies: DataFrame, list_fields) -> DataFrame:
    """The elements of each body; one row without a kind for a body that is not valid JSON. Each body is parsed once."""
    wanted = frozenset(list_fields)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, digests, rows, held = ShapeAutomaton(wanted), {}, [], 0
        for batch in batches:
            for ref, body in zip(batch.column("record_ref").to_pylist(), batch.column("body").to_pylist()):
                try:
                    root = parse(body)
                except ValueError:
                    rows.append((ref, *[None] * 7))
                    continue
                for kind, parent_kind, parent, path, obj in elements(root, wanted):
                    shape, own = automaton.describe(obj)
                    if len(digests) > 10_000:
                        digests.clear()
                    variant = digests.get(shape) or digests.setdefault(shape, "v" + hashlib.md5(shape.encode("utf-8", "replace")).hexdigest()[:16])
                    rows.append((ref, kind, parent_kind, parent, path, variant, shape, own))
                    held += 200 + len(parent) + len(path) + len(shape) + sum(len(v or "") for _, v in own)
                    if held > FLUSH:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)

    return bodies.mapInArrow(walk, NODES)


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sound(body) -> bool:
        try:
            parse(body)
        except ValueError:
            return False
        return True

    for batch in batches:
        yield batch.filter(pa.array([sound(b) for b in batch.column("body").to_pylist()], pa.bool_()))


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("record_ref").agg(F.max(F.struct("received_at", "body")).alias("b")).select("record_ref", "b.body")


def flatten(records: DataFrame, list_fields: list[str] = LIST_FIELDS) -> DataFrame:
    """One row per object that is an element of one of the list fields, at any depth, of each record's latest valid body.

    records: record_ref, received_at, body (JSON text). Every row keeps its parent link (parent_kind, parent_path), its
    variant (digest of its automaton state), the readable state (shape) and its own fields (`own`: name to code and
    text, see CODES; a field set to null has a null value).

    Null or blank record_refs, null bodies and bodies that are not JSON yield nothing; equal times take the greater
    text; repeated rows change nothing; empty input gives no rows; extra columns are ignored. The newest body is found
    by a map-side combined maximum, so a record received very often is no hot key, and is parsed once, while it is
    walked. Only records whose newest body is broken are looked at again, for their newest sound one.
    """
    rows = records.select(norm_id("record_ref").alias("record_ref"), "received_at", "body").where("record_ref is not null and body is not null")
    first = materialize(_walk(_newest(rows), list_fields), "node_kind", n="count_if(node_kind is null)")
    broken = first.where("node_kind is null").select("record_ref")
    nodes = first.where("node_kind is not null")
    if not counted(first)["n"]:
        return nodes
    again = maybe_in(rows, "record_ref", broken, "record_ref", counted(first)["n"]).join(broken, "record_ref", "left_semi")
    sound = again.mapInArrow(_valid, again.schema)
    return nodes.unionByName(materialize(_walk(_newest(sound), list_fields), "node_kind").where("node_kind is not null"))


def variants(nodes: DataFrame) -> DataFrame:
    """Catalogue of the variants: how many elements of each kind have each shape, in how many records."""
    return nodes.groupBy("node_kind", "variant").agg(F.first("shape").alias("shape"), F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("record_ref").alias("n_records"))


def shape_columns(shape: str) -> dict[str, str]:
    """The fields of an object's automaton state, and their states; fields that are tables of their own are left out."""
    out, at, decoder = {}, 1, json.JSONDecoder()
    while at < len(shape) - 1:
        key, at = decoder.raw_decode(shape, at)
        start, depth, at = at + 1, 0, at + 1
        while at < len(shape) - 1 and (depth or shape[at] != ","):
            if shape[at] == '"':
                at = decoder.raw_decode(shape, at)[1]
                continue
            depth += (shape[at] in "[{") - (shape[at] in "]}")
            at += 1
        if shape[start:at] != "table":
            out[key] = shape[start:at]
        at += 1
    return out


def column_type(state: str) -> str | None:
    """Spark type of a field's column; nested values and numbers out of range are text, null has no column."""
    return None if state == "null" else CODES.get(state, ("j", "string"))[1]


#: First letter of the columns of each type in the files.
LETTERS = {"string": "s", "bigint": "i", "double": "f", "boolean": "b"}


class SubtypeTables:
    """Typed tables of all variants: a folder for each kind, in it one for each variant, with keys and parent link.

    Each (field, type) that occurs among a kind's variants has a column of its own, so no value is cast to a type that
    isn't its own; in a variant's folder only the columns of its state hold values. In the files the columns are numbered
    by type, so all kinds are written by one job; `fields` tells what they are. What is not among the typed variants lies
    in a folder `rest` of its kind, with its fields as a map.
    """

    def __init__(self, spark: SparkSession, folder: str, shapes: dict[tuple[str, str], str], rest: bool):
        self.spark, self.folder, self.shapes, self.rest = spark, folder, shapes, rest
        self.fields: dict[str, dict[tuple[str, str], str]] = {}  # by kind: (field, type) and its column in the files
        self.width = dict.fromkeys(LETTERS, 0)
        for (kind, _), shape in sorted(shapes.items()):
            own = self.fields.setdefault(kind, {})
            for field, state in shape_columns(shape).items():
                if (type_ := column_type(state)) and (field, type_) not in own:
                    n = sum(t == type_ for _, t in own)
                    own[field, type_] = f"{LETTERS[type_]}{n}"
                    self.width[type_] = max(self.width[type_], n + 1)

    def write(self, nodes: DataFrame) -> None:
        """Route every row to its variant's folder; partitions of a frequent variant are split, small ones put together."""
        named = [(kind, *[[f for f, t in own if t == type_] for type_ in LETTERS]) for kind, own in self.fields.items()]
        names = self.spark.createDataFrame(named, "t_kind string, " + ", ".join(f"n_{x} array<string>" for x in LETTERS.values()))
        rows = nodes.join(F.broadcast(names), F.col("node_kind") == F.col("t_kind"), "left")
        known = F.lit(True)
        if self.rest:
            typed = self.spark.createDataFrame(list(self.shapes), "v_kind string, v_variant string")
            rows = rows.join(F.broadcast(typed), (F.col("node_kind") == F.col("v_kind")) & (F.col("variant") == F.col("v_variant")), "left")
            known = F.col("v_variant").isNotNull()
        values = [F.when(known, _coded(F.col("own")[F.get(f"n_{x}", F.lit(n))], t)).alias(f"{x}{n}") for t, x in LETTERS.items() for n in range(self.width[t])]
        out = rows.select("record_ref", F.col("variant").alias("variant_id"), "parent_kind", "parent_path", "node_path", *values, F.when(~known, F.col("own")).alias("own"), "node_kind", F.when(known, F.col("variant")).otherwise("rest").alias("variant"))
        out.hint("rebalance", "node_kind", "variant").write.partitionBy("node_kind", "variant").parquet(self.folder)

    def read(self) -> DataFrame:
        values = [f"{x}{n} {t}" for t, x in LETTERS.items() for n in range(self.width[t])]
        return self.spark.read.schema(", ".join(["record_ref string, variant_id string, parent_kind string, parent_path string, node_path string", *values, "own map<string,string>, node_kind string, variant string"])).parquet(self.folder)

    def supertype(self) -> DataFrame:
        """The keys and parent links of all elements, from all subtype tables."""
        return self.read().select("record_ref", "node_kind", F.col("variant_id").alias("variant"), "parent_kind", "parent_path", "node_path")

    def columns(self, node_kind: str) -> dict[str, tuple[str, str]]:
        """Output columns of a kind: name to (field, type). A field with several types has one column for each."""
        kinds: dict[str, set] = {}
        for (kind, _), shape in self.shapes.items():
            if kind == node_kind:
                for field, state in shape_columns(shape).items():
                    kinds.setdefault(field, set()).update({t} if (t := column_type(state)) else set())
        return named_columns({f: sorted(t) for f, t in sorted(kinds.items())})

    def _select(self, rows: DataFrame, node_kind: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
        fields = self.fields.get(node_kind, {})

        def column(field: str, kind: str) -> Column:
            typed = F.col(fields[field, kind]) if (field, kind) in fields else F.lit(None).cast(kind)
            return F.coalesce(typed, _coded(F.col("own")[F.lit(field)], kind)) if self.rest else typed

        keys = ["record_ref", "node_path", "parent_kind", "parent_path", F.col("variant_id").alias("variant")]
        return rows.where(F.col("node_kind") == node_kind).select(*keys, *[column(*w).alias(n) for n, w in wanted.items()])

    def kind(self, node_kind: str, columns: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """All elements of a kind with typed columns: those that occur among typed variants, or the given ones."""
        return self._select(self.read(), node_kind, self.columns(node_kind) if columns is None else columns)

    def variant(self, node_kind: str, variant: str) -> DataFrame:
        """The table of one typed variant, with exactly the fields of its state."""
        fields = {f: [t] for f, s in sorted(shape_columns(self.shapes[node_kind, variant]).items()) if (t := column_type(s))}
        return self._select(self.read().where(F.col("variant") == variant), node_kind, named_columns(fields))


def _coded(value: Column, kind: str) -> Column:
    """A value of `own` if its code is one of this type's, else null."""
    codes = [c for c, k in CODES.values() if k == kind] + ["j"] * (kind == "string")
    return F.when(F.substring(value, 1, 1).isin(codes), F.substring(value, 2, (1 << 31) - 1)).cast(kind)


def named_columns(fields: dict[str, list[str]]) -> dict[str, tuple[str, str]]:
    """Column names of (field, type): the field, `field_type` where it has several types; what clashes gets a prefix."""
    out, used = {}, {"record_ref", "node_path", "parent_kind", "parent_path", "variant"}
    for field, kinds in fields.items():
        for kind in kinds:
            name = field if len(kinds) == 1 else f"{field}_{kind}"
            while name.lower() in used or not name:
                name = "f_" + name
            used.add(name.lower())
            out[name] = (field, kind)
    return out


def route(nodes: DataFrame, tables: int = TABLES) -> SubtypeTables:
    """Write every variant to its table in the shared folder: the `tables` most frequent ones typed, the others as maps.

    Only states and their counts reach the driver, of at most `tables` variants.
    """
    most = nodes.groupBy("node_kind", "variant", "shape").count().orderBy(F.desc("count"), "node_kind", "variant").limit(tables + 1).collect()
    out = SubtypeTables(nodes.sparkSession, new_path(nodes.sparkSession), {(r[0], r[1]): r[2] for r in most[:tables]}, len(most) > tables)
    out.write(nodes)
    return out


def audit_records(imports: DataFrame, results: DataFrame) -> DataFrame:
    """Both sources of nested bodies as record_ref, received_at, body."""
    a = imports.select("record_ref", "received_at", F.col("body_json").alias("body"))
    return a.unionByName(results.select(F.col("result_ref").alias("record_ref"), F.col("ingested_at").alias("received_at"), F.col("report_json").alias("body")))
