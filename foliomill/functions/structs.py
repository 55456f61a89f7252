"""Nested values: paths, flattening and tagged JSON (UTL-01..04, 06, 07)."""

from __future__ import annotations

import datetime
import decimal
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_path(c: Column, path: list[str | int], default=None) -> Column:
    """A value inside structs, maps and arrays; a missing map key or index gives the default."""
    for step in path:
        c = F.get(c, step) if isinstance(step, int) else c[step]
    return c if default is None else F.coalesce(c, F.lit(default))


def json_path(c: Column, path: list[str], default: str | None = None) -> Column:
    found = F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path))
    return found if default is None else F.coalesce(found, F.lit(default))


def _search(raw: str | None, field: str) -> list[str] | None:
    if raw is None:
        return None
    out, stack = [], [json.loads(raw)]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            out += [json.dumps(v, ensure_ascii=False) for k, v in x.items() if k == field]
            stack += [v for v in reversed(list(x.values())) if isinstance(v, (dict, list))]
        elif isinstance(x, list):
            stack += [v for v in reversed(x) if isinstance(v, (dict, list))]
    return out


def values_of(c: Column, field: str) -> Column:
    """All values of a JSON field at any depth, as JSON text, in order of depth-first search."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def search(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: _search(x, field))

    return search(c)


def collapse_lists(c: Column, depth: int) -> Column:
    """Lists nested ``depth`` deep inside a list as one list, in order; null lists count as empty."""
    for _ in range(depth):
        c = F.flatten(F.filter(c, lambda x: x.isNotNull()))
    return c


def flatten_json(c: Column, separator: str = ".") -> Column:
    """A JSON object's leaves by dotted path, as a map to their JSON text; no state is kept between rows."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def flat(raw: pd.Series) -> pd.Series:
        def walk(x: dict, prefix: str) -> dict:
            out = {}
            for k, v in x.items():
                out |= walk(v, f"{prefix}{k}{separator}") if isinstance(v, dict) and v else {f"{prefix}{k}": json.dumps(v, ensure_ascii=False)}
            return out

        return raw.map(lambda x: None if x is None else walk(json.loads(x), ""))

    return flat(c)


def flat_columns(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of all leaves of a schema."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += flat_columns(f.dataType, f"{name}.") if isinstance(f.dataType, T.StructType) else [name]
    return out


def flatten_structs(df: DataFrame, separator: str = "_") -> DataFrame:
    """One column for each leaf."""
    return df.select(*[F.col(".".join(f"`{p}`" for p in name.split("."))).alias(name.replace(".", separator)) for name in flat_columns(df.schema)])


def cache_key(context: str, *columns: str) -> Column:
    """Digest of a context and a row's values."""
    return F.sha2(F.concat(F.lit(context + "\x01"), F.to_json(F.struct(*columns))), 256)


_TAGS = {
    "datetime.datetime": (datetime.datetime, ("year", "month", "day", "hour", "minute", "second", "microsecond")),
    "datetime.date": (datetime.date, ("year", "month", "day")),
    "datetime.time": (datetime.time, ("hour", "minute", "second", "microsecond")),
    "datetime.timedelta": (datetime.timedelta, ("days", "seconds", "microseconds")),
}


def encode(value) -> str:
    """JSON in which dates, times and decimals carry their type."""

    def tagged(x):
        if isinstance(x, decimal.Decimal):
            return {"__type__": "decimal.Decimal", "args": [str(x)]}
        for tag, (kind, names) in _TAGS.items():
            if type(x) is kind:
                return {"__type__": tag, "args": [getattr(x, n) for n in names]}
        raise TypeError(f"can't encode {type(x).__name__}")

    return json.dumps(value, default=tagged, ensure_ascii=False)


def decode(raw: str):
    """The inverse of :func:`encode`; only its own tags are built."""

    def build(d: dict):
        if d.get("__type__") == "decimal.Decimal":
            return decimal.Decimal(d["args"][0])
        return _TAGS[d["__type__"]][0](*d["args"]) if d.get("__type__") in _TAGS else d

    return json.loads(raw, object_hook=build)
