"""Dotted paths and flattening of nested JSON."""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import col

# the function below travels with its code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FLAT = "map<string,string>"


def json_path(c: Column | str, path: str) -> Column:
    """Value under a dotted path, where a number picks a list element; null when missing."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(col(c), "$" + steps)


class _Number(str):
    """A number as it is written."""


def _written(value) -> str | None:
    """JSON text of a value; a string as itself, null as null."""
    if value is None or isinstance(value, str):
        return value
    return _json_text(value)


def _json_text(value) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_json_text, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json_text(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def _flat(text: str | None, lists: bool) -> dict[str, str | None] | None:
    """Dotted keys of one JSON text; null for null, broken text and what is neither an object nor (with lists) a list."""
    try:
        value = json.loads(text, parse_float=_Number, parse_int=_Number)
    except (TypeError, ValueError):
        return None
    if not isinstance(value, dict) and not (lists and isinstance(value, list)):
        return None
    out, open_ = {}, [("", value)]
    while open_:
        key, value = open_.pop()
        items = value.items() if isinstance(value, dict) else enumerate(value) if lists and isinstance(value, list) else None
        if items is None:
            out[key[1:]] = _written(value)
        else:
            open_ += [(f"{key}.{k}", v) for k, v in reversed(list(items))]
    return out


def flatten_json(c: Column | str, lists: bool = False) -> Column:
    """JSON object to ``map<dotted key, value text>`` down to its last level (an Arrow function: depth has no bound)."""
    return F.udf(lambda text: _flat(text, lists), FLAT, useArrow=True)(col(c))


def flatten_metrics(c: Column | str) -> Column:
    """``map<metric, map<sub, value>>`` to ``map<metric.sub, value>``."""
    pairs = F.transform(
        F.map_entries(col(c)),
        lambda m: F.transform(
            F.map_entries(m["value"]),
            lambda s: F.struct(F.concat(m["key"], F.lit("."), s["key"]).alias("key"), s["value"].alias("value")),
        ),
    )
    return F.map_from_entries(F.flatten(pairs))
