"""JSON Schema as column expressions: the first error of a document, by place, with what is wrong there.

A schema is compiled once into expressions over a VARIANT: types, enum, const,
required, additionalProperties, oneOf of plain alternatives, pattern, minLength,
minimum, maximum, minItems, maxItems, format uuid, properties and items. All of
it is native: no Python runs on rows.

``with_first_error`` and ``with_event_error`` lay a document's places out as
columns, so that each is worked out once and Spark makes Java of what is asked
of it. ``first_error`` is one expression and binds each place in a lambda, which
Spark interprets: the same result, slower.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

# The contracts of events and facts.
_ID = {"type": "string", "format": "uuid"}
_OPEN = {"type": ["string", "null"]}
_PAGE = {"type": ["integer", "null"], "minimum": 1}
_STAGES = ["PD", "RD", "ID"]


def _envelope(kind: str, required: list[str], properties: dict) -> dict:
    return {
        "type": "object",
        "required": ["event_id", "event_type", "schema_version", "occurred_at", "process_id", "object_id", "data"],
        "additionalProperties": False,
        "properties": {
            "event_id": _ID, "event_type": {"const": kind}, "schema_version": {"const": 1}, "occurred_at": {"type": "string"}, "correlation_id": {"type": "string"},
            "object_id": _ID, "process_id": _ID, "data": {"type": "object", "required": required, "properties": properties},
        },
    }


EVENTS = {
    "doc.parse.requested": _envelope("doc.parse.requested", ["job_id", "file_id", "storage_key"], {
        "job_id": _ID, "file_id": _ID, "doc_stage": {"oneOf": [{"enum": _STAGES}, {"type": "null"}]}, "discipline": _OPEN, "sha256": {"type": ["string", "null"], "pattern": "^[0-9a-f]{64}$"},
        "storage_key": {"type": "string", "minLength": 1}, "content_type": _OPEN, "page_from": _PAGE, "page_to": _PAGE,
    }),
    "doc.parse.completed": _envelope("doc.parse.completed", ["job_id", "file_id", "quality"], {
        "job_id": _ID, "file_id": _ID, "quality": {"enum": ["OK", "LOW_QUALITY", "ABSTAIN", "FAILED"]}, "layout_key": _OPEN,
        "page_from": {"type": ["integer", "null"]}, "page_to": {"type": ["integer", "null"]}, "stats": {"type": "object"}, "error": _OPEN,
    }),
    "doc.extract.requested": _envelope("doc.extract.requested", ["job_id", "files"], {
        "job_id": _ID,
        "files": {"type": "array", "items": {"type": "object", "required": ["file_id", "stage"], "properties": {
            "file_id": _ID, "stage": {"oneOf": [{"enum": _STAGES}, {"type": "string", "const": ""}]}, "discipline": {"type": "string"}, "layout_keys": {"type": ["array", "null"], "items": {"type": "string"}},
        }}},
        "params": {"type": "array", "items": {"type": "string", "pattern": r"^M-\d{3}$"}},
    }),
    "doc.extract.completed": _envelope("doc.extract.completed", ["job_id", "facts_key"], {"job_id": _ID, "facts_key": {"type": "string"}, "suspicions_key": _OPEN, "model_version": _OPEN}),
}
_SHARE = {"type": "number", "minimum": 0, "maximum": 1}
FACT = {
    "type": "object",
    "required": ["fact_id", "file_id", "stage", "param_code", "value_raw", "page", "quote", "confidence", "method", "quality", "extractor_version"],
    "additionalProperties": False,
    "properties": {
        "fact_id": _ID, "process_id": _ID, "file_id": _ID, "file_sha256": {"type": ["string", "null"], "pattern": "^[0-9a-f]{64}$"}, "stage": {"enum": _STAGES},
        "param_code": {"type": "string", "pattern": r"^M-\d{3}$"}, "rule_code": _OPEN, "element_key": _OPEN, "value_raw": {"type": "string"},
        "value_norm": {"type": ["object", "null"], "properties": {"kind": {"enum": ["number", "ordinal", "string", "set", "bool", "tolerance"]}}, "required": ["kind"]},
        "unit": _OPEN, "page": {"type": "integer", "minimum": 1}, "bbox": {"type": "array", "items": _SHARE, "minItems": 4, "maxItems": 4}, "quote": {"type": "string", "minLength": 1}, "confidence": _SHARE,
        "method": {"enum": ["vector_text", "ocr", "llm", "vlm", "regex", "mock"]}, "quality": {"enum": ["OK", "LOW_QUALITY", "ABSTAIN"]}, "has_change_notice": {"type": "boolean"}, "extractor_version": {"type": "string"},
    },
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body``, a string, of a value that is worked out once, however often ``body`` names it.

    The empty string keeps the type of what is inside: Spark asks for it on
    each row, and would otherwise ask all the way down.
    """
    return F.get(F.transform(F.array(value), lambda x: F.concat(body(x), F.lit(""))), 0)


class _Node:
    """A place in a document: its value, that as JSON, what it is and its path; of objects also the names and the values of their fields."""

    def __init__(self, value: Column, json: Column, kind: Column, path: str | Column, keys: Column | None = None, fields: dict[str, Column] | None = None):
        self.value, self.json, self.kind, self.path, self.keys, self.fields = value, json, kind, path, keys, fields or {}

    def extra(self, known: list[str]) -> Column:
        """Whether an object has fields of other names."""
        return F.size(F.array_except(self.keys, F.array(*map(F.lit, known)))) > 0

    def items(self) -> Column:
        return F.try_variant_get(self.value, "$", "array<variant>")

    def there(self, name: str) -> Column:
        return self.fields[name].isNotNull()

    def field_error(self, name: str, schema: dict) -> Column:
        return F.when(self.there(name), _met(self.fields[name], self.below(name), schema, lambda n: _error(n, schema)))

    def item_error(self, x: Column, i: Column, schema: dict) -> Column:
        return _met(x, self.below(i.cast("string")), schema, lambda n: _error(n, schema))

    def below(self, name: str | Column) -> str | Column:
        if isinstance(self.path, str) and isinstance(name, str):
            return f"{self.path}/{name}" if self.path else name
        if isinstance(self.path, str) and not self.path:
            return name
        part = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.concat(part(self.path), F.lit("/"), part(name))

    def error(self, rule: str) -> Column:
        return F.lit(f"{self.path or '<root>'}: {rule}") if isinstance(self.path, str) else F.concat(self.path, F.lit(f": {rule}"))

    def text(self) -> Column:
        """A string's text: what is between the quotes, where nothing is escaped."""
        return F.when(self.json.contains("\\"), F.try_variant_get(self.value, "$", "string")).otherwise(F.substring(self.json, F.lit(2), F.length(self.json) - 2))

    def number(self) -> Column:
        return F.translate(self.json, '"', "").try_cast("double")  # infinite ones are quoted

    def is_(self, kind: str) -> Column:
        if kind == "integer":
            return self.is_("number") & (self.number() == F.floor(self.number()))
        return self.kind == kind

    def equals(self, wanted) -> Column:
        if isinstance(wanted, str):
            return self.is_("string") & (self.text() == wanted)
        if isinstance(wanted, bool):
            return self.is_("boolean") & (self.json == str(wanted).lower())
        return self.is_("null") if wanted is None else self.is_("number") & (self.number() == float(wanted))


def _kind(value: Column, json: Column) -> Column:
    """What a value is, told by its JSON's first sign. Infinite numbers are in quotes there, as strings are."""
    first = F.substring(json, 1, 1)
    quoted = F.when(json.isin('"Infinity"', '"-Infinity"', '"NaN"') & (F.schema_of_variant(value) != "STRING"), "number").otherwise("string")
    return F.when(first == '"', quoted).when(first == "{", "object").when(first == "[", "array").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(first.isNotNull(), "number")


def _met(value: Column, path: str | Column, schema: dict, body: Callable[[_Node], Column]) -> Column:
    """``body`` of the node of a value, which must be cheap to name: kinds, names and fields are looked up once.

    A cast of a variant to a number or a string makes a new session
    configuration on each row, so these are taken from its JSON.
    """
    names = sorted({*schema.get("properties", {}), *schema.get("required", [])})
    if not names and "additionalProperties" not in schema:
        return _let(F.to_json(value), lambda j: _let(_kind(value, j), lambda k: body(_Node(value, j, k, path))))
    held = lambda m: F.struct(F.map_keys(m).alias("keys"), *(F.try_element_at(m, F.lit(n)).alias(f"f{i}") for i, n in enumerate(names)))
    kind = lambda b: F.when(b["keys"].isNotNull(), "object").otherwise(_kind(value, F.to_json(value)))
    node = lambda b, k: body(_Node(value, F.to_json(value), k, path, b["keys"], {n: b[f"f{i}"] for i, n in enumerate(names)}))
    return _let(F.try_variant_get(value, "$", "map<string,variant>"), lambda m: _let(held(m), lambda b: _let(kind(b), lambda k: node(b, k))))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _fits(node: _Node, schema: dict) -> Column:
    """Whether a plain alternative (type, enum, const) holds."""
    kinds = schema.get("type", [])
    tests = [_any([node.is_(k) for k in ([kinds] if isinstance(kinds, str) else kinds)])] if kinds else []
    tests += [_any([node.equals(v) for v in schema["enum"]])] if "enum" in schema else []
    tests += [node.equals(schema["const"])] if "const" in schema else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _own(node: _Node, schema: dict) -> list[Column]:
    """Errors at the node itself, in the order of the schema's words; null where there is none."""
    sized = lambda _: F.size(node.items())
    words: dict[str, Callable] = {
        "type": lambda v: [F.when(~_fits(node, {"type": v}), node.error("type"))],
        "enum": lambda v: [F.when(~_any([node.equals(x) for x in v]), node.error("enum"))],
        "const": lambda v: [F.when(~node.equals(v), node.error("const"))],
        "oneOf": lambda v: [F.when(reduce(lambda a, b: a + b, (_fits(node, x).cast("int") for x in v)) != 1, node.error("oneOf"))],
        "required": lambda v: [F.when(node.is_("object") & ~node.there(x), node.error(f"required {x}")) for x in v],
        "additionalProperties": lambda v: [] if v else [F.when(node.is_("object") & node.extra(list(schema.get("properties", {}))), node.error("additionalProperties"))],
        "pattern": lambda v: [F.when(node.is_("string") & ~node.text().rlike(v), node.error("pattern"))],
        "minLength": lambda v: [F.when(node.is_("string") & (F.length(node.text()) < v), node.error("minLength"))],
        "minimum": lambda v: [F.when(node.is_("number") & (node.number() < v), node.error("minimum"))],
        "maximum": lambda v: [F.when(node.is_("number") & (node.number() > v), node.error("maximum"))],
        "minItems": lambda v: [F.when(node.is_("array") & (sized(v) < v), node.error("minItems"))],
        "maxItems": lambda v: [F.when(node.is_("array") & (sized(v) > v), node.error("maxItems"))],
        "format": lambda v: [F.when(node.is_("string") & ~node.text().rlike(_UUID), node.error("format"))] if v == "uuid" else [],
    }
    return [e for word, v in schema.items() if word in words for e in words[word](v)]


def _error(node: _Node, schema: dict) -> Column:
    """The first error at or below a node, by place: its own, then those of its properties by name or of its items by number."""
    out = _own(node, schema)
    out += [node.field_error(name, schema["properties"][name]) for name in sorted(schema.get("properties", {}))]
    if "items" in schema:
        found = F.transform(F.when(node.is_("array"), node.items()), lambda x, i: node.item_error(x, i, schema["items"]))
        out.append(F.get(F.filter(found, lambda e: e.isNotNull()), 0))
    return F.coalesce(*out, F.lit(None).cast("string"))


def first_error(document: Column, schema: dict) -> Column:
    """``path: rule`` of the first error of a VARIANT document, null if it fits; paths are sorted, the root's errors come first.

    A null document has no errors: it isn't there. Words that the compiler
    doesn't know are no rules.
    """
    return _let(document, lambda d: _met(d, "", schema, lambda n: _error(n, schema)))


#: What a value is, by its JSON's first sign and by the begin of its type's name; numbers and, by types, strings are the rest.
_SIGNS = {"string": '"', "object": "{", "array": "[", "true": "t", "false": "f", "null": "n"}
_TYPES = {"object": ["OBJ"], "array": ["ARR"], "boolean": ["BOO"], "null": ["VOI"], "number": ["BIG", "DEC", "DOU", "FLO"]}


def _plain(schema: dict) -> bool:
    """Whether nothing is asked of what is inside a value."""
    return not {"properties", "required", "additionalProperties", "items", "minItems", "maxItems"} & set(schema)


def _asks_text(schema: dict) -> bool:
    """Whether a value's JSON is needed, not only what kind of value it is."""
    kinds = schema.get("type", [])
    return bool({"enum", "const", "oneOf", "pattern", "minLength", "minimum", "maximum", "format"} & set(schema)) or "integer" in ([kinds] if isinstance(kinds, str) else kinds)


def _places(schemas: list[dict], at: tuple = ()) -> dict[tuple, list[dict]]:
    """Each place that ``schemas`` name, with what they ask there."""
    out = {at: schemas}
    for name in sorted({n for s in schemas for n in (*s.get("properties", {}), *s.get("required", []))}):
        out |= _places([s["properties"][name] for s in schemas if name in s.get("properties", {})], (*at, name))
    return out


def _others(held: Column, known: list[str]) -> Column:
    """Whether a map has names that aren't known."""
    return F.exists(F.map_keys(held), lambda k: ~k.isin(*known))


def _bare(value: Column) -> Column:
    """A value's JSON, with infinite numbers out of their quotes."""
    return F.btrim(F.to_json(value), F.when(F.schema_of_variant(value).isin("DOUBLE", "FLOAT"), '"').otherwise(""))


class _Json(_Node):
    """A place of which only its JSON is known, as ``_bare`` gives it."""

    def __init__(self, json: Column, path: str | Column):
        super().__init__(json, json, json, path)

    def text(self) -> Column:
        between = F.substring(self.json, F.lit(2), F.length(self.json) - 2)
        return F.when(self.json.contains("\\"), F.get_json_object(F.concat(F.lit("["), self.json, F.lit("]")), "$[0]")).otherwise(between)

    def number(self) -> Column:
        return self.json.try_cast("double")

    def is_(self, kind: str) -> Column:
        first = F.ascii(self.json)
        if kind == "integer":
            return super().is_(kind)
        if kind == "number":
            return ~first.isin(*map(ord, _SIGNS.values()))
        return first.isin(ord("t"), ord("f")) if kind == "boolean" else first == ord(_SIGNS[kind])


class _Laid(_Json):
    """A place that is laid out as columns of a frame."""

    def __init__(self, at: tuple, name: Callable[[str, tuple], str], places: dict[tuple, list[dict]]):
        self.at, self.name, self.places = at, name, places
        super().__init__(F.col(name("json", at)), "/".join(at))
        self.texts, self.plain = any(map(_asks_text, places[at])), all(map(_plain, places[at]))
        self.below_it = [p for p in places if p[:-1] == at and p]
        self.values = any(not _plain(s["items"]) for s in places[at] if "items" in s)

    def col(self, part: str) -> Column:
        return F.col(self.name(part, self.at))

    def node(self, name: str) -> _Laid:
        return _Laid((*self.at, name), self.name, self.places)

    def is_(self, kind: str) -> Column:
        if self.texts:
            return super().is_(kind)
        known = [t for types in _TYPES.values() for t in types]
        return ~self.col("type").isin(*known) if kind == "string" else self.col("type").isin(*_TYPES[kind])

    def extra(self, known: list[str]) -> Column:
        return self.col(f"extra{self.closed().index(known)}")

    def closed(self) -> list[list[str]]:
        """The names that schemas without other fields know here."""
        return [list(s.get("properties", {})) for s in self.places[self.at] if not s.get("additionalProperties", True)]

    def items(self) -> Column:
        return self.col("items")

    def there(self, name: str) -> Column:
        below = self.node(name)
        return below.col("json" if below.texts else "type").isNotNull()

    def field_error(self, name: str, schema: dict) -> Column:
        return F.when(self.there(name), _error(self.node(name), schema))

    def item_error(self, x: Column, i: Column, schema: dict) -> Column:
        return super().item_error(x, i, schema) if self.values else _error(_Json(x, self.below(i.cast("string"))), schema)

    def told(self, value: Column, kind: Column | None = None) -> Column:
        """The column that tells what the value is."""
        if self.texts:
            return _bare(value).alias(self.name("json", self.at))
        kind_alone = F.substring(F.schema_of_variant(value), 1, 3)
        return (kind_alone if kind is None else F.coalesce(kind, kind_alone)).alias(self.name("type", self.at))


def _laid_out(df: DataFrame, document: Column, schemas: list[dict]) -> tuple[DataFrame, _Laid]:
    """``df`` with columns for the places of a document that ``schemas`` name, and the root over them.

    Level by level: values that have something inside are opened, then what is
    in them is told, so that values themselves go no further than a step.
    """
    places = _places(schemas)
    number = {at: i for i, at in enumerate(places)}
    name = lambda part, at: f"_contract_{part}{number[at]}"
    df, level = df.select("*", document.alias(name("value", ()))), [_Laid((), name, places)]
    while level:
        opened = [F.try_variant_get(n.col("value"), "$", "map<string,variant>").alias(name("map", n.at)) for n in level] + [F.try_variant_get(n.col("value"), "$", "array<variant>").alias(name("array", n.at)) for n in level]
        df, told, deeper = df.select("*", *opened), [], []
        for n in level:
            held, array = n.col("map"), n.col("array")
            told += [n.told(n.col("value"), F.when(held.isNotNull(), "OBJ").when(array.isNotNull(), "ARR"))]
            told += [_others(held, known).alias(name(f"extra{i}", n.at)) for i, known in enumerate(n.closed())]
            told += [(array if n.values else F.transform(array, _bare)).alias(name("items", n.at))]
            for below in (n.node(p[-1]) for p in n.below_it):
                value = F.try_element_at(held, F.lit(below.at[-1]))
                told += [below.told(value)] if below.plain else [value.alias(name("value", below.at))]
                deeper += [] if below.plain else [below]
        df, level = df.select("*", *told), deeper
    return df, _Laid((), name, places)


def with_first_error(df: DataFrame, document: Column, schema: dict, name: str) -> DataFrame:
    """``df`` with ``name``: the document's ``first_error``."""
    laid, root = _laid_out(df, document, [schema])
    return laid.select(*df.columns, _error(root, schema).alias(name))


def with_event_error(df: DataFrame, document: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the first error of an event by its own contract; ``foreign`` for event types without one."""
    laid, root = _laid_out(df, document, list(EVENTS.values()))
    kind, out = F.col("_contract_event"), F.lit("foreign")
    for event, schema in EVENTS.items():
        out = F.when(kind == event, _error(root, schema)).otherwise(out)
    laid = laid.select("*", F.try_variant_get(root.col("value"), "$['event_type']", "string").alias("_contract_event"))
    return laid.select(*df.columns, F.when(F.coalesce(kind, F.lit("")) == "", F.lit("<root>: required event_type")).otherwise(out).alias(name))
