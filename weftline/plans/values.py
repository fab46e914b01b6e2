"""Values of a run as columns: what a workflow passes from node to node, typed as far as the plan knows.

A value is one of

- Null, known to be null;
- Scalar, a text, whole number, double or boolean column, whose SQL null is the value null;
- Arr, an array column;
- Obj, an object whose fields are values with a condition of being present, and a condition of being null;
- Dyn, a VARIANT column, for what has no one type.

Conditions are columns that are never null, or Python's True and False where the plan knows them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scalars import number_text, truthy_text

Cond = Column | bool


def col_of(c: Cond) -> Column:
    return F.lit(c) if isinstance(c, bool) else c


def both(a: Cond, b: Cond) -> Cond:
    if isinstance(a, bool):
        return b if a else False
    if isinstance(b, bool):
        return a if b else False
    return a & b


def either(a: Cond, b: Cond) -> Cond:
    if isinstance(a, bool):
        return True if a else b
    if isinstance(b, bool):
        return True if b else a
    return a | b


def no(a: Cond) -> Cond:
    return not a if isinstance(a, bool) else ~a


@dataclass
class Null:
    pass


@dataclass
class Scalar:
    col: Column
    type: str  # string, bigint, double or boolean
    const: object = None
    sure: bool = False  # never null


@dataclass
class Arr:
    col: Column
    element: T.DataType


@dataclass
class Obj:
    fields: dict[str, tuple[Cond, Value]] = field(default_factory=dict)
    null: Cond = False


@dataclass
class Dyn:
    col: Column


Value = Null | Scalar | Arr | Obj | Dyn

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def of_column(col: Column, kind: T.DataType) -> Value:
    if isinstance(kind, T.NullType):
        return Null()
    if isinstance(kind, T.StringType):
        return Scalar(col, "string")
    if isinstance(kind, T.BooleanType):
        return Scalar(col, "boolean")
    if isinstance(kind, _WHOLE):
        return Scalar(col if isinstance(kind, T.LongType) else col.cast("bigint"), "bigint")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return Scalar(col if isinstance(kind, T.DoubleType) else col.cast("double"), "double")
    if isinstance(kind, T.TimestampType):
        return Scalar(F.unix_millis(col), "bigint")
    if isinstance(kind, T.ArrayType):
        return Arr(col, kind.elementType)
    if isinstance(kind, T.StructType):
        return Obj({f.name: (True, of_column(col.getField(f.name), f.dataType)) for f in kind.fields}, col.isNull())
    if isinstance(kind, T.VariantType):
        return Dyn(col)
    if isinstance(kind, T.MapType):
        return Dyn(F.parse_json(F.to_json(col)))
    return Scalar(col.cast("string"), "string")


def of_json(value: object) -> Value:
    """A constant of a document."""
    if value is None:
        return Null()
    if isinstance(value, bool):
        return Scalar(F.lit(value), "boolean")
    if isinstance(value, int):
        return Scalar(F.lit(value).cast("bigint"), "bigint")
    if isinstance(value, float):
        return Scalar(F.lit(value), "double")
    if isinstance(value, str):
        return Scalar(F.lit(value), "string", value, True)
    if isinstance(value, dict):
        return Obj({k: (True, of_json(v)) for k, v in value.items()})
    for kind, spark in ((str, T.StringType()), (bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType())):
        if value and all(type(x) is kind for x in value):
            return Arr(F.array(*(F.lit(x).cast(spark) for x in value)), spark)
    return Dyn(F.parse_json(F.lit(json.dumps(value))))


def is_null(v: Value) -> Cond:
    if isinstance(v, Null):
        return True
    if isinstance(v, Obj):
        return v.null
    if isinstance(v, Dyn):
        return F.coalesce(F.is_variant_null(v.col), F.lit(True))
    return False if isinstance(v, Scalar) and v.sure else v.col.isNull()


def nulled(v: Value, when: Cond) -> Value:
    """v, null where the condition holds."""
    if when is False:
        return v
    if when is True or isinstance(v, Null):
        return Null()
    if isinstance(v, Obj):
        return Obj(v.fields, either(v.null, when))
    return type(v)(F.when(~when, v.col), *([v.type] if isinstance(v, Scalar) else [v.element] if isinstance(v, Arr) else []))


def choose(cond: Cond, a: Value, b: Value) -> Value:
    """a where the condition holds, else b."""
    if isinstance(cond, bool):
        return a if cond else b
    if isinstance(a, Null):
        return nulled(b, cond)
    if isinstance(b, Null):
        return nulled(a, ~cond)
    if isinstance(a, Scalar) and isinstance(b, Scalar) and a.type == b.type:
        return Scalar(F.when(cond, a.col).otherwise(b.col), a.type, sure=a.sure and b.sure)
    if isinstance(a, Arr) and isinstance(b, Arr) and a.element == b.element:
        return Arr(F.when(cond, a.col).otherwise(b.col), a.element)
    if isinstance(a, Obj) and isinstance(b, Obj):
        fields = {}
        for k in dict.fromkeys([*a.fields, *b.fields]):
            (pa, va), (pb, vb) = a.fields.get(k, (False, Null())), b.fields.get(k, (False, Null()))
            present = pa if pa is pb else either(both(cond, pa), both(~cond, pb))
            value = vb if pa is False else va if pb is False else choose(cond, va, vb)
            fields[k] = (present, value)
        null = a.null if a.null is b.null else either(both(cond, a.null), both(~cond, b.null))
        return Obj(fields, null)
    return Dyn(F.when(cond, variant(a)).otherwise(variant(b)))


def json_text(v: Value) -> Column:
    """Compact JSON, fields in their order; never null."""
    if isinstance(v, Null):
        return F.lit("null")
    if isinstance(v, Scalar):
        if v.type == "string":
            listed = F.to_json(F.array(v.col))
            out = F.substring(listed, F.lit(2), F.length(listed) - 2)
        else:
            out = number_text(v.col) if v.type == "double" else v.col.cast("string")
        return F.when(v.col.isNull(), F.lit("null")).otherwise(out)
    if isinstance(v, Arr):
        items = F.array_join(F.transform(v.col, lambda x: json_text(of_column(x, v.element))), ",")
        return F.when(v.col.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), items, F.lit("]")))
    if isinstance(v, Dyn):
        return F.coalesce(F.to_json(v.col), F.lit("null"))
    parts = [F.when(col_of(p), F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), json_text(x))) for k, (p, x) in v.fields.items()]
    body = F.concat(F.lit("{"), F.array_join(F.array(*parts), ",") if parts else F.lit(""), F.lit("}"))
    return body if v.null is False else F.when(col_of(v.null), F.lit("null")).otherwise(body)


def variant(v: Value) -> Column:
    return v.col if isinstance(v, Dyn) else F.parse_json(json_text(v))


def text(v: Value) -> Column:
    """How a value shows in a text; never null."""
    if isinstance(v, Null):
        return F.lit("")
    if isinstance(v, Scalar):
        out = number_text(v.col) if v.type == "double" else v.col.cast("string")
        return F.coalesce(out, F.lit(""))
    if isinstance(v, Dyn):
        kind = F.schema_of_variant(v.col)
        own = F.when(kind == "STRING", F.try_variant_get(v.col, "$", "string")).when(kind.isin("DOUBLE", "FLOAT"), number_text(F.try_variant_get(v.col, "$", "double"))).otherwise(F.to_json(v.col))
        return F.when(col_of(is_null(v)), F.lit("")).otherwise(own)
    return F.when(col_of(is_null(v)), F.lit("")).otherwise(json_text(v))


def truthy(v: Value) -> Cond:
    if isinstance(v, Null):
        return False
    if isinstance(v, Obj):
        some: Cond = False
        for present, _ in v.fields.values():
            some = either(some, present)
        return both(some, no(v.null))
    if isinstance(v, Arr):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    if isinstance(v, Dyn):
        kind = F.coalesce(F.schema_of_variant(v.col), F.lit("VOID"))
        number = F.try_variant_get(v.col, "$", "double") != 0
        return F.coalesce(
            F.when(kind == "VOID", F.lit(False))
            .when(kind == "BOOLEAN", F.try_variant_get(v.col, "$", "boolean"))
            .when(kind == "STRING", truthy_text(F.try_variant_get(v.col, "$", "string")))
            .when(kind.startswith("ARRAY"), F.to_json(v.col) != "[]")
            .when(kind.startswith("OBJECT"), F.to_json(v.col) != "{}")
            .otherwise(number),
            F.lit(False),
        )
    if v.type == "boolean":
        return F.coalesce(v.col, F.lit(False))
    if v.type == "string":
        return truthy_text(v.col)
    return F.coalesce(v.col != 0, F.lit(False))


def field_at(value: Column, name: str) -> Column:
    """A field of a VARIANT by its name, whatever marks that holds; null if it is not there."""
    mark = "'" if "'" not in name else '"'
    if mark in name:  # both: by way of a map
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        return F.try_element_at(fields, F.lit(name))
    return F.try_variant_get(value, f"$[{mark}{name}{mark}]", "variant")


def step(v: Value, segment: str) -> tuple[Cond, Value]:
    """A field or an element, and whether it is there."""
    if isinstance(v, Obj):
        present, value = v.fields.get(segment, (False, Null()))
        return both(present, no(v.null)), value
    index = int(segment) if re.fullmatch(r"\+?\d+", segment) and len(segment) < 10 else None
    if isinstance(v, Arr) and index is not None:
        return F.coalesce(F.size(v.col) > index, F.lit(False)), of_column(F.get(v.col, F.lit(index)), v.element)
    if isinstance(v, Dyn):
        found = field_at(v.col, segment)
        if index is not None:
            found = F.coalesce(found, F.try_variant_get(v.col, f"$[{index}]", "variant"))
        return found.isNotNull(), Dyn(found)
    return False, Null()


def resolve(path: str, context: Obj) -> tuple[Cond, Value]:
    """The value at a dotted path; $json and $input stand for the input `in`, or for all inputs if there is none."""
    path = path.strip()
    if not path:
        return False, Null()
    first, *rest = path.split(".")
    if first in ("$json", "$input"):
        there, value = context.fields.get("in", (False, Null()))
        found, at = True, choose(there, value, context)
    else:
        found, at = step(context, first)
    for segment in rest:
        more, at = step(at, segment)
        found = both(found, more)
    return found, at


def whole(template: str) -> str | None:
    """The path of a template that is one expression and nothing else."""
    t = template.strip()
    inner = t[2:-2]
    return inner if len(t) >= 4 and t.startswith("{{") and t.endswith("}}") and "{{" not in inner and "}}" not in inner else None


def interpolate(template: str, context: Obj) -> Column:
    parts, at = [], 0
    while (start := template.find("{{", at)) >= 0 and (end := template.find("}}", start + 2)) >= 0:
        if start > at:
            parts.append(F.lit(template[at:start]))
        found, value = resolve(template[start + 2 : end], context)
        parts.append(F.lit("") if found is False else text(value) if found is True else F.when(found, text(value)).otherwise(F.lit("")))
        at = end + 2
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def evaluate(template: object, context: Obj) -> Value:
    """A config value: text with expressions is filled in, an expression alone keeps its type; anything else stays."""
    if not isinstance(template, str):
        return of_json(template)
    path = whole(template)
    if path is not None:
        found, value = resolve(path, context)
        return nulled(value, no(found))
    return Scalar(interpolate(template, context), "string", sure=True)


def struct(v: Value) -> Column:
    """A typed column of the value, for arrays and results; VARIANT where presence depends on the row."""
    if isinstance(v, Null):
        return F.lit(None).cast("string")
    if isinstance(v, Obj):
        if not v.fields or any(p is not True for p, _ in v.fields.values()):
            return variant(v)
        out = F.struct(*(struct(x).alias(k) for k, (_, x) in v.fields.items()))
        return out if v.null is False else F.when(~col_of(v.null), out)
    return v.col


def leaves(v: Value, put: Callable[[Column], Column]) -> Value:
    """v with each of its columns replaced by what put gives for it."""
    if isinstance(v, Null):
        return v
    if isinstance(v, Obj):
        cond = lambda c: c if isinstance(c, bool) else put(c)
        return Obj({k: (cond(p), leaves(x, put)) for k, (p, x) in v.fields.items()}, cond(v.null))
    if isinstance(v, Scalar):
        return v if v.const is not None else Scalar(put(v.col), v.type, sure=v.sure)
    if isinstance(v, Arr):
        return Arr(put(v.col), v.element)
    return Dyn(put(v.col))
