"""JSON documents kept as text: relations (key, doc). Paths: ``$``, ``$.a.b``, ``$.a.[0]``."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs


def spark_path(path: str) -> str:
    """The path as Spark writes it; a step such as ``a[0]`` is a member of that name."""
    out = "$"
    for step in [s for s in path.removeprefix("$").split(".") if s]:
        out += step if re.fullmatch(r"\[\d+\]", step) else f"['{step}']"
    return out


def _value(doc: Column, path: str) -> Column:
    return F.variant_get(F.try_parse_json(doc), spark_path(path), "variant")


def get(doc: Column, path: str = "$") -> Column:
    """The serialised value; the whole text for the root (JSON.GET, JSON.RESP)."""
    return doc if path in ("", ".", "$") else F.to_json(_value(doc, path))


def get_many(doc: Column, paths: list[str]) -> Column:
    """One object keyed by path, with null where a path leads nowhere."""
    parts = [F.concat(F.lit(json.dumps(p) + ":"), F.coalesce(get(doc, p), F.lit("null"))) for p in paths]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def mget(docs: DataFrame, requests: DataFrame, path: str) -> DataFrame:
    return requests.join(docs, "key", "left").select("req", "key", get(F.col("doc"), path).alias("value"))


def type_of(doc: Column, path: str = "$") -> Column:
    """null, boolean, number, string, array or object."""
    found = F.schema_of_variant(_value(doc, path))
    return (
        F.when(found.startswith("OBJECT"), "object").when(found.startswith("ARRAY"), "array").when(found == "STRING", "string")
        .when(found == "BOOLEAN", "boolean").when(found == "VOID", "null").when(found.isNotNull(), "number")
    )


def number(doc: Column, path: str) -> Column:
    return F.when(type_of(doc, path) == "number", F.try_variant_get(F.try_parse_json(doc), spark_path(path), "double"))


def text(doc: Column, path: str) -> Column:
    return F.when(type_of(doc, path) == "string", F.try_variant_get(F.try_parse_json(doc), spark_path(path), "string"))


def strlen(doc: Column, path: str) -> Column:
    return F.octet_length(text(doc, path)).cast("bigint")


def arrlen(doc: Column, path: str) -> Column:
    return F.json_array_length(get(doc, path)).cast("bigint")


def objkeys(doc: Column, path: str = "$") -> Column:
    """The member names, in document order at the root."""
    return F.json_object_keys(get(doc, path))


def _items(doc: Column, path: str) -> Column:
    return F.from_json(get(doc, path), "array<string>")


def arrindex(doc: Column, path: str, scalar, start: int = 0, stop: int = 0) -> Column:
    """The first index of a scalar in [start, stop); stop 0 is the end; -1 if there is none."""
    items = _items(doc, path)
    size = F.size(items)
    low = F.greatest(F.lit(start) if start >= 0 else size + start, F.lit(0))
    high = F.lit(stop) if stop > 0 else size + stop if stop < 0 else size
    wanted = scalar if isinstance(scalar, str) else json.dumps(scalar)
    at = F.array_position(F.slice(items, low + 1, F.greatest(high - low, F.lit(0))), wanted)
    return F.when(items.isNotNull(), F.when(at > 0, at - 1 + low).otherwise(-1)).cast("bigint")


def element(doc: Column, path: str, index: int = -1) -> Column:
    """What JSON.ARRPOP returns; the index is held inside the array."""
    items = F.from_json(get(doc, path), "array<variant>")
    size = F.size(items)
    at = F.least(F.greatest(F.lit(index) if index >= 0 else size + index, F.lit(0)), size - 1)
    return F.to_json(F.try_element_at(items, at + 1))


def _edit(function, doc: Column, path: str, argument) -> Column:
    return function(doc, F.lit(path), F.lit(argument))


def set_path(doc: Column, path: str, value: str) -> Column:
    """JSON.SET below the root: null if the parent isn't there. At the root the text is simply replaced."""
    return F.lit(value) if path in ("", ".", "$") else _edit(udfs.json_set, doc, path, value)


def delete_path(doc: Column, path: str) -> Column:
    return _edit(udfs.json_del, doc, path, "")


def increase(doc: Column, path: str, by: float) -> Column:
    return _edit(udfs.json_add, doc, path, str(by))


def multiply(doc: Column, path: str, by: float) -> Column:
    return _edit(udfs.json_times, doc, path, str(by))


def append_text(doc: Column, path: str, more: str) -> Column:
    return _edit(udfs.json_append_text, doc, path, more)


def array_append(doc: Column, path: str, item) -> Column:
    return _edit(udfs.json_append, doc, path, json.dumps(item))


def array_insert(doc: Column, path: str, index: int, item) -> Column:
    return _edit(udfs.json_insert, doc, path, json.dumps([index, item]))


def array_pop(doc: Column, path: str, index: int = -1) -> Column:
    return _edit(udfs.json_pop, doc, path, str(index))


def array_trim(doc: Column, path: str, start: int, stop: int) -> Column:
    return _edit(udfs.json_trim, doc, path, json.dumps([start, stop]))


def toggle(doc: Column, path: str) -> Column:
    return _edit(udfs.json_toggle, doc, path, "")


def clear(doc: Column, path: str) -> Column:
    return _edit(udfs.json_clear, doc, path, "")
