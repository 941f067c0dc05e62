"""Events as tables: checked columns, and decoders of JSON objects and `name=value;...` lines."""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RuleError, Status
from ..functions.columns import balanced, named
from ..plans.expr import INT_MAX, INT_MIN
from ..schema import AttrType, Schema
from ..workers import importable

_WIDENED = {AttrType.INT: (T.ByteType, T.ShortType, T.IntegerType, T.LongType), AttrType.FLOAT: (T.FloatType, T.DoubleType), AttrType.STRING: (T.StringType,), AttrType.BOOL: (T.BooleanType,)}
_ELEMENT = {AttrType.INT_LIST: AttrType.INT, AttrType.STRING_LIST: AttrType.STRING}
_INT = re.compile(r"[+-]?[0-9]+")
#: Elements that a list in JSON may have.
LIST_MAX = 256
_VARIANT = {AttrType.BOOL: "boolean", AttrType.INT: "bigint", AttrType.FLOAT: "double", AttrType.STRING: "string", AttrType.INT_LIST: "array<bigint>", AttrType.STRING_LIST: "array<string>"}
_OWN = "__rs"
#: What Catalyst decodes: one object without inner braces, and items of a line, without white space but blanks.
_FLAT = r"^[ \t\r\n]*+\{[^{}]*+\}[ \t\r\n]*+$"
_CHAR = r"[^;'\x22\[\]\x00-\x1f\x7f-\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ITEM = rf" *+[A-Za-z_][A-Za-z0-9_-]*+ *+= *+(?:\x22[^\x22]*+\x22 *+|'[^']*+' *+|\[(?:{_CHAR}|\x22[^\x22\[\],;]*+\x22|'[^'\[\],;]*+')*+\] *+|{_CHAR}++)"
_FLOAT = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)", re.I)


def normalized(df: DataFrame, schema: Schema, event_id: str = "event_id") -> DataFrame:
    """event_id and the schema's attributes with normal values; an attribute that df lacks is undefined.

    NaN is undefined; lists are sorted and made unique; an element that is null makes the job fail, as no list can hold one.
    Types must fit: nothing is cast from text or from float to int.
    """
    own = {f.name: f.dataType for f in df.schema}
    columns = [named(event_id).alias("event_id")]
    for name, kind in schema:
        if name not in own:
            columns.append(F.lit(None).cast(kind.spark).alias(name))
            continue
        given, c = own[name], named(name)
        element = _ELEMENT.get(kind)
        fits = isinstance(given, T.ArrayType) and isinstance(given.elementType, _WIDENED[element]) if element else isinstance(given, _WIDENED[kind])
        if not fits:
            raise RuleError(Status.TYPE_MISMATCH, f"column '{name}' is {given.simpleString()}, the attribute is {kind.value}")
        if element:
            checked = F.when(F.exists(c, lambda x: x.isNull()), F.raise_error(F.lit(f"a list of attribute '{name}' holds a null")).cast(given)).otherwise(c)
            c = F.array_sort(F.array_distinct(checked)).cast(kind.spark)
        elif kind is AttrType.FLOAT:
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        else:
            c = c.cast(kind.spark)
        columns.append(c.alias(name))
    return df.select(*columns)


def _bad(name: str) -> RuleError:
    return RuleError(Status.INVALID_ARG, f"bad item '{name}': unknown attribute or a value of the wrong type")


def _listed(values: list) -> list:
    return sorted(set(values), key=lambda v: v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v)


def _from_json(name: str, kind: AttrType, value: Any, most: float = math.inf) -> Any:
    if kind in _ELEMENT:
        element = int if kind is AttrType.INT_LIST else str
        if not isinstance(value, list) or len(value) > most or not all(type(v) is element for v in value) or element is int and not all(INT_MIN <= v <= INT_MAX for v in value):
            raise _bad(name)
        return _listed(value)
    if kind is AttrType.FLOAT and type(value) in (int, float):
        return float(value)
    wanted = {AttrType.BOOL: bool, AttrType.INT: int, AttrType.STRING: str}.get(kind)
    if type(value) is not wanted or wanted is int and not INT_MIN <= value <= INT_MAX:
        raise _bad(name)
    return value


def _no_constant(name: str) -> Any:
    raise ValueError(f"'{name}' is not JSON")


def decode_json(schema: Schema, text: str) -> dict[str, Any]:
    """One flat object: scalars and arrays of one kind and LIST_MAX elements at most; null is undefined, of a repeated name the last value counts."""
    try:
        own = json.loads(text, parse_constant=_no_constant)
    except ValueError as e:
        raise RuleError(Status.SYNTAX, f"not a JSON object: {e}") from None
    if not isinstance(own, dict):
        raise RuleError(Status.SYNTAX, "not a JSON object")
    out = {}
    for name, value in own.items():
        if name not in schema.types:
            raise _bad(name)
        out[name] = None if value is None else _from_json(name, schema.types[name], value, LIST_MAX)
    return out


def _split(text: str, at: str) -> list[str]:
    """Cuts at a character that stands outside quotes; quotes have no escapes."""
    parts, quote, start = [], "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == at:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def _unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] in "'\"" and text[-1] == text[0] else text


def _from_text(name: str, kind: AttrType, text: str) -> Any:
    text = text.strip()
    if kind in _ELEMENT:
        if not (text.startswith("[") and text.endswith("]")):
            raise _bad(name)
        inner = text[1:-1].strip()
        return _listed([_from_text(name, _ELEMENT[kind], x) for x in _split(inner, ",")] if inner else [])
    if kind is AttrType.BOOL and text in ("true", "false"):
        return text == "true"
    if kind is AttrType.INT and _INT.fullmatch(text) and INT_MIN <= int(text) <= INT_MAX:
        return int(text)
    if kind is AttrType.FLOAT and _FLOAT.fullmatch(text):
        value = float(text)
        return None if math.isnan(value) else value
    if kind is AttrType.STRING and text and (text[0] not in "'\"" or len(text) > 1 and text[-1] == text[0] and text[0] not in text[1:-1]):
        return _unquoted(text)
    raise _bad(name)


def decode_line(schema: Schema, text: str) -> dict[str, Any]:
    """Items `name=value` set off by semicolons; lists in brackets; of a repeated name the last value counts."""
    out = {}
    for item in _split(text.strip(), ";"):
        if not item.strip():
            continue
        name, sign, value = item.partition("=")
        name = name.strip()
        if not sign or name not in schema.types:
            raise _bad(name)
        out[name] = _from_text(name, schema.types[name], value)
    return out


def decode(schema: Schema, text: str) -> dict[str, Any]:
    """JSON if the text starts with a brace, else a line."""
    return decode_json(schema, text) if text.lstrip(" \t\r\n").startswith("{") else decode_line(schema, text)


def event_from_pairs(schema: Schema, *args: str) -> dict[str, Any]:
    """From name, value, name, value ..."""
    if len(args) % 2:
        raise RuleError(Status.INVALID_ARG, "a name without a value")
    return {n: _from_text(n, schema.type_of(n), v) for n, v in zip(args[::2], args[1::2], strict=True)}


def _json_columns(schema: Schema) -> tuple[str, dict[str, str]]:
    """SQL of whether the variant in V is a good event, and of each attribute's value."""
    good, values = ["V IS NOT NULL", f"size(array_except(KEYS, array({', '.join(map(repr, schema.types))}))) = 0"], {}
    for name, kind in schema:
        path = f"'$[\"{name}\"]'"
        told = f"coalesce(schema_of_variant(try_variant_get(V, {path}, 'variant')), 'VOID')"
        value = f"try_variant_get(V, {path}, '{_VARIANT[kind]}')"
        if kind.is_list:
            element = "BIGINT" if kind is AttrType.INT_LIST else "STRING"
            good.append(f"CASE {told} WHEN 'VOID' THEN true WHEN 'ARRAY<{element}>' THEN NOT exists({value}, x -> x IS NULL) AND size({value}) <= {LIST_MAX} WHEN 'ARRAY<VOID>' THEN size({value}) = 0 ELSE false END")
            value = f"array_sort(array_distinct({value}))"
        elif kind is AttrType.FLOAT:
            good.append(f"rlike({told}, '^(?:VOID|BIGINT|DOUBLE|DECIMAL.*)$')")
        else:
            good.append(f"{told} IN ('VOID', '{_VARIANT[kind].upper()}')")
        values[name] = value
    return balanced([f"({g})" for g in good], "AND"), values


def _line_columns(schema: Schema) -> tuple[str, dict[str, str]]:
    """The same of a line's items, whose names are in NAMES and texts in TEXTS."""
    good, values = ["NAMES IS NOT NULL", "size(array_distinct(NAMES)) = size(NAMES)", f"size(array_except(NAMES, array({', '.join(map(repr, schema.types))}))) = 0"], {}
    number, whole = r"^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$", "^[+-]?[0-9]+$"
    plain = lambda x: f"if(rlike({x}, '^[\\\\x22\\\\x27]'), substring({x}, 2, length({x}) - 2), {x})"
    for name, kind in schema:
        x = f"get(TEXTS, cast(array_position(NAMES, '{name}') - 1 AS int))"
        inner = f"trim(substring({x}, 2, length({x}) - 2))"
        items = f"transform(if({inner} = '', cast(array() AS array<string>), split({inner}, ',')), y -> trim(y))"
        if kind is AttrType.BOOL:
            test, value = f"{x} IN ('true', 'false')", f"{x} = 'true'"
        elif kind is AttrType.INT:
            test, value = f"rlike({x}, '{whole}') AND try_cast({x} AS bigint) IS NOT NULL", f"try_cast({x} AS bigint)"
        elif kind is AttrType.FLOAT:
            test, value = f"rlike({x}, '{number}')", f"try_cast({x} AS double)"
        elif kind is AttrType.STRING:
            test, value = f"{x} <> ''", plain(x)
        elif kind is AttrType.INT_LIST:
            test, value = f"startswith({x}, '[') AND forall({items}, y -> rlike(y, '{whole}') AND try_cast(y AS bigint) IS NOT NULL)", f"array_sort(array_distinct(transform({items}, y -> try_cast(y AS bigint))))"
        else:
            test = f"startswith({x}, '[') AND forall({items}, y -> rlike(y, '^(?:\\\\x22[^\\\\x22]*\\\\x22|\\\\x27[^\\\\x27]*\\\\x27|[^\\\\x22\\\\x27].*)$'))"
            value = f"array_sort(array_distinct(transform({items}, y -> {plain('y')})))"
        good.append(f"{x} IS NULL OR ({test})")
        values[name] = value
    return balanced([f"({g})" for g in good], "AND"), values


def decoded(df: DataFrame, schema: Schema, payload: str = "payload", event_id: str = "event_id") -> DataFrame:
    """event_id, payload, error (null if it decodes) and the attributes, from a column of texts; works on streams too.

    Usual payloads are decoded by Catalyst: flat JSON objects without braces in their strings, and lines of items with plain
    or quoted values.  What is in another form, or wrong, goes through decode(), which also says what is wrong.
    """
    out = T.StructType([T.StructField("error", T.StringType()), *schema.struct().fields])

    def slowly(texts: pd.Series) -> pd.DataFrame:
        errors: list[str | None] = []
        values: dict[str, list] = {n: [] for n, _ in schema}
        for text in texts:
            own, error = {}, None
            if text is not None:
                try:
                    own = decode(schema, text)
                except RuleError as e:
                    error = e.describe()
            errors.append(error)
            for n, held in values.items():
                held.append(own.get(n))
        return pd.DataFrame({"error": pd.Series(errors, dtype=object)} | {n: pd.Series(v, dtype=object) for n, v in values.items()})

    importable(df.sparkSession)
    own = f"{_OWN}_"
    if not len(schema):
        return df.select(named(event_id).alias("event_id"), named(payload).cast("string").alias("payload"), F.pandas_udf(slowly, out)(F.coalesce(named(payload).cast("string"), F.lit("")))["error"].alias("error"))
    rows = df.select(named(event_id).alias("event_id"), named(payload).cast("string").alias("payload"))
    rows = rows.withColumn(f"{own}json", F.rlike("payload", F.lit(_FLAT))).withColumn(f"{own}line", F.rlike("payload", F.lit(f"^{_ITEM}(?:;{_ITEM})*+;?+$")))
    rows = rows.withColumns({f"{own}v": F.expr(f"if({own}json, try_parse_json(payload), null)"), f"{own}keys": F.expr(f"if({own}json, json_object_keys(payload), null)"), f"{own}items": F.when(F.col(f"{own}line"), F.regexp_extract_all("payload", F.lit(_ITEM), F.lit(0)))})
    rows = rows.withColumns({f"{own}names": F.transform(f"{own}items", lambda x: F.regexp_extract(x, "^ *+([^= ]+)", 1)), f"{own}texts": F.transform(f"{own}items", lambda x: F.trim(F.regexp_replace(x, "^[^=]*=", "")))})
    placed = lambda sql: re.sub(r"\b(V|KEYS|NAMES|TEXTS)\b(?!')", lambda m: own + m[0].lower(), sql)
    (json_good, json_values), (line_good, line_values) = _json_columns(schema), _line_columns(schema)
    rows = rows.withColumns({f"{own}json": F.expr(f"coalesce({placed(json_good)}, false)"), f"{own}line": F.expr(f"coalesce({placed(line_good)}, false)")})
    # said to be nondeterministic, so that a filter on the error isn't pushed below all this, which would be done twice then
    slow = F.pandas_udf(slowly, out).asNondeterministic()(F.when(~F.col(f"{own}json") & ~F.col(f"{own}line"), F.coalesce("payload", F.lit(""))))
    rows = rows.withColumn(f"{own}slow", slow)
    told = [F.expr(f"CASE WHEN {own}json THEN {placed(json_values[n])} WHEN {own}line THEN {placed(line_values[n])} ELSE {own}slow.`{n}` END").cast(k.spark).alias(n) for n, k in schema]
    return rows.select("event_id", "payload", F.col(f"{own}slow.error").alias("error"), *told)


def accepted(df: DataFrame) -> DataFrame:
    return df.where("error IS NULL").drop("error")


def rejected(df: DataFrame) -> DataFrame:
    return df.where("error IS NOT NULL").select("event_id", "payload", "error")


def from_rows(spark, schema: Schema, rows: list[dict[str | int, Any]]) -> DataFrame:
    """Events from Python values by attribute name or number (its place in the schema), checked one by one; event_id counts from 0."""
    out, names = [], list(schema.types)
    for i, given in enumerate(rows):
        own: list[Any] = [i]
        row = {}
        for key, value in given.items():
            if isinstance(key, int) and not 0 <= key < len(names):
                raise RuleError(Status.UNKNOWN_ATTR, f"unknown attribute {key}")
            name = names[key] if isinstance(key, int) else key
            schema.type_of(name)
            row[name] = value
        for name, kind in schema:
            value = row.get(name)
            if isinstance(value, float) and math.isnan(value) and kind is AttrType.FLOAT:
                value = None
            own.append(None if value is None else _from_json(name, kind, sorted(value) if isinstance(value, (set, tuple)) else value))
        out.append(tuple(own))
    return spark.createDataFrame(out, T.StructType([T.StructField("event_id", T.LongType()), *schema.struct().fields]))
