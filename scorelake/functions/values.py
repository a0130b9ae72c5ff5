"""Maps, JSON, conversions, dates, statistics and enumerations."""

from __future__ import annotations

import enum
import json
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def get_or(m: Column, key: str, default: str | None = None) -> Column:
    """Value of a map's key, or the default if the key is missing."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def put(m: Column, key: str, value: Column) -> Column:
    """The map with the key set."""
    rest = F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), value.cast("string")))


def json_at(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def as_json(value: Column) -> Column:
    """JSON that keeps null fields."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def flat(value: object, joiner: str = "_", prefix: str = "") -> dict[str, object]:
    """Nested objects and lists as one object; keys are joined, elements of lists have their index."""
    if not isinstance(value, dict | list):
        return {prefix: value}
    pairs = value.items() if isinstance(value, dict) else ((str(i), v) for i, v in enumerate(value))
    out: dict[str, object] = {}
    for k, v in pairs:
        out |= flat(v, joiner, f"{prefix}{joiner}{k}" if prefix else str(k))
    return out


def nested(flat_map: dict[str, object], joiner: str = "_") -> dict:
    """The reverse of flat for objects; the joiner is a regular expression."""
    out: dict = {}
    for key, value in flat_map.items():
        *path, last = re.split(joiner, key)
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def map_flatten(text: Column, joiner: str = "_") -> Column:
    """JSON text as a flat map of strings; null for what is no JSON object or list."""

    @F.pandas_udf("map<string,string>")
    def flatten(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = json.loads(t)
            except (TypeError, ValueError):
                return None
            if not isinstance(value, dict | list):
                return None
            return {k: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False) for k, v in flat(value, joiner).items()}

        return texts.map(one)

    return flatten(text)


def to_long(text: Column) -> Column:
    return F.trim(text).cast("bigint")


def to_double(text: Column) -> Column:
    return F.trim(text).cast("double")


def to_boolean(text: Column) -> Column:
    return F.lower(F.trim(text)) == "true"


def format_millis(ms: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_millis(ms), pattern)


def parse_millis(text: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    return F.unix_millis(F.to_timestamp(text, pattern))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def add_days(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(days=F.lit(days))


def is_date_pattern(pattern: str) -> bool:
    """Whether a pattern has letters of dates or times only, and balanced quotes."""
    plain = re.sub(r"'[^']*'", "", pattern)
    return bool(plain) and "'" not in plain and not re.search(r"[^GyuMLdQqEaHhKkmsSVzOXxn\W\d_]|[{}#]", plain)


def nearest_rank(x: str, percent: float, where: str | None = None) -> Column:
    """Aggregate: the value of the SQL expression x at place ceil(n * percent / 100) of its sorted values.

    Partial sums hold a count per different value, so use it for values of a limited number, such as milliseconds.
    """
    kept = f" FILTER (WHERE {where})" if where else ""
    return F.expr(f"percentile_disc({percent / 100!r}) WITHIN GROUP (ORDER BY {x}){kept}")


@cache
def _codes(kind: type[enum.Enum], attribute: str) -> dict:
    return {getattr(m, attribute): m for m in kind}


def by_code(kind: type[enum.Enum], code: object, attribute: str = "value") -> enum.Enum | None:
    """The member with this code, or None."""
    return _codes(kind, attribute).get(code)
