"""Typed metadata: declared definitions, filters compiled to columns, sort and keyset paging."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

SPARK_TYPES = {"keyword": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "datetime": "timestamp"}
PATH = re.compile(r"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+){0,7}$")


@dataclass(frozen=True)
class MetadataDef:
    path: str
    kind: str
    array: bool = False
    state: str = "ready"
    sortable: bool = True

    def __post_init__(self) -> None:
        if not (PATH.match(self.path) and len(self.path) <= 200 and self.kind in SPARK_TYPES):
            raise ValueError(f"bad metadata definition {self.path} {self.kind}")

    def typed(self, json_col: str = "metadata_json") -> Column:
        raw = F.get_json_object(json_col, f"$.{self.path}")
        kind = SPARK_TYPES[self.kind]
        return F.from_json(raw, f"array<{kind}>") if self.array else raw.try_cast(kind)


def _entry(json_col: str, path: str) -> Column:
    """The value at a path as JSON text in a variant; null if nothing is there."""
    return F.try_variant_get(F.try_parse_json(F.col(json_col)), f"$.{path}", "variant")


def json_type(json_col: str, path: str) -> Column:
    """string, number, boolean, object, array or null; no value if nothing is there."""
    kind = F.schema_of_variant(_entry(json_col, path))
    return (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
        .when(kind.isNotNull(), "number")
    )


def json_has(json_col: str, path: str) -> Column:
    """Whether something, even null, is at the path."""
    return _entry(json_col, path).isNotNull()


@dataclass(frozen=True)
class MetadataFilter:
    path: str
    operator: str
    value: object = None
    min: object = None
    max: object = None


def _literal(value: object, d: MetadataDef) -> Column:
    return F.lit(None if value is None else str(value) if not isinstance(value, bool) else str(value).lower()).try_cast(SPARK_TYPES[d.kind])


def compile_filter(f: MetadataFilter, d: MetadataDef, json_col: str = "metadata_json") -> Column:
    """A boolean column, never null: values that don't convert are no match."""
    return compile_typed(f, d, d.typed(json_col), F.get_json_object(json_col, f"$.{f.path}").isNotNull())


def compile_typed(f: MetadataFilter, d: MetadataDef, x: Column, present: Column | None = None) -> Column:
    """The same over a typed value; what is there is what isn't null, or what ``present`` says."""
    if f.operator == "exists":
        return (x.isNotNull() if present is None else present) == F.lit(True if f.value is None else bool(f.value))
    if f.operator == "eq":
        want = F.array(*[_literal(v, d) for v in f.value]) if d.array else _literal(f.value, d)
        out = x == want
    elif f.operator == "in":
        values = f.value if isinstance(f.value, (list, tuple)) else []
        out = reduce(or_, [x == _literal(v, d) for v in values], F.lit(False))
    elif f.operator == "contains":
        out = F.array_contains(x, _literal(f.value, d)) if d.array else F.lit(False)
    elif f.operator == "range":
        if d.kind == "boolean":
            return F.lit(False)
        bounds = [x >= _literal(f.min, d)] * (f.min is not None) + [x <= _literal(f.max, d)] * (f.max is not None)
        out = reduce(and_, bounds, x.isNotNull())
    else:
        raise ValueError(f"unknown operator {f.operator}")
    return F.coalesce(out, F.lit(False))


def compile_filters(filters: list[MetadataFilter], definitions: list[MetadataDef], json_col: str = "metadata_json") -> Column:
    """All filters; an undeclared path or one that isn't ready is an error."""
    by_path = {d.path: d for d in definitions}
    for f in filters:
        if f.path not in by_path:
            raise ValueError(f"{f.path} isn't declared")
        if by_path[f.path].state != "ready":
            raise ValueError(f"{f.path} isn't ready")
    return reduce(and_, [compile_filter(f, by_path[f.path], json_col) for f in filters], F.lit(True))


def untyped_compare(raw: Column, operator: str, value: object) -> Column:
    """Undeclared paths: numbers compare as doubles, other values as strings, mixed kinds never."""
    number = raw.try_cast("double")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        x, want, fits = number, F.lit(float(value)), number.isNotNull()
    else:
        x, want, fits = raw, F.lit(str(value)), number.isNull()
    out = {"eq": x == want, "gte": x >= want, "lte": x <= want}[operator]
    return F.coalesce(fits & out, F.lit(False))


def extract(df: DataFrame, definitions: list[MetadataDef], id_col: str, json_col: str = "metadata_json") -> DataFrame:
    """Entity-attribute-value rows (id, path, ordinal, value) of the ready definitions; arrays give a row for each element."""
    values = [
        F.struct(F.lit(d.path).alias("path"), (d.typed(json_col).cast("array<string>") if d.array else F.array(d.typed(json_col).cast("string"))).alias("values"))
        for d in definitions if d.state == "ready"
    ]
    rows = df.select(id_col, F.explode(F.array(*values)).alias("v"))
    return rows.select(id_col, "v.path", F.posexplode("v.values").alias("ordinal", "value")).where("value is not null")


def typed_sort(keys: list[tuple[str, str]], id_col: str) -> list[Column]:
    """Nulls last in both directions; the id breaks ties."""
    order = [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last() for c, d in keys]
    return [*order, F.col(id_col).asc()]


def after_key(keys: list[tuple[str, str]], values: list, id_col: str, last_id: object) -> Column:
    """Rows behind a seek position in typed_sort's order."""
    same, parts = F.lit(True), []
    for (c, d), v in zip(keys, values):
        x = F.col(c)
        if v is not None:
            beyond = (x > F.lit(v)) if d == "asc" else (x < F.lit(v))
            parts.append(same & (beyond | x.isNull()))
        same = same & x.eqNullSafe(F.lit(v))
    parts.append(same & (F.col(id_col) > F.lit(last_id)))
    return F.coalesce(reduce(or_, parts), F.lit(False))


def page(df: DataFrame, keys: list[tuple[str, str]], id_col: str, limit: int, after: tuple[list, object] | None = None) -> DataFrame:
    """One page and, if there are more rows, one row beyond it."""
    rows = df if after is None else df.where(after_key(keys, after[0], id_col, after[1]))
    return rows.orderBy(*typed_sort(keys, id_col)).limit(limit + 1)


#: Types that JSON has no value for: how a cursor writes and reads them.
_TAGS = {
    "ts": (datetime, datetime.isoformat, datetime.fromisoformat), "date": (date, date.isoformat, date.fromisoformat), "dec": (Decimal, str, Decimal),
}


def _tagged(value: object) -> object:
    return next(({tag: write(value)} for tag, (kind, write, _) in _TAGS.items() if isinstance(value, kind)), value)


def _untagged(value: object) -> object:
    return next((_TAGS[tag][2](x) for tag, x in value.items()), None) if isinstance(value, dict) else value


def encode_cursor(request: dict, values: list, last_id: object) -> str:
    digest = hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()
    said = {"v": 2, "query": digest, "values": list(map(_tagged, values)), "id": _tagged(last_id)}
    return base64.urlsafe_b64encode(json.dumps(said).encode()).decode()


def decode_cursor(request: dict, cursor: str) -> tuple[list, object]:
    """Values and id of a cursor, of the types they had; one of another request is refused."""
    got = json.loads(base64.urlsafe_b64decode(cursor))
    if got.get("v") != 2 or got["query"] != hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest():
        raise ValueError("the cursor belongs to another query")
    return list(map(_untagged, got["values"])), _untagged(got["id"])
