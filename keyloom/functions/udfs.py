"""Arrow functions for what Spark's own expressions can't say."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# these functions travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def _float_text(value: float) -> str:
    return f"{value:.17f}".rstrip("0").rstrip(".")


@F.pandas_udf(T.StringType())
def float_text(values: pd.Series) -> pd.Series:
    """A number with 17 decimals, without the trailing zeros."""
    return values.map(lambda v: None if v is None or math.isnan(v) else _float_text(v))


def _lcs_rows(a: bytes, b: bytes, first: int, start: int) -> Iterator[int]:
    """Row by row of the table of common lengths, from row ``first`` of which ``start`` is the state: bits that are 0 where a row rises."""
    every = (1 << len(b)) - 1
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    state = start
    for x in a[first:]:
        same = state & places.get(x, 0)
        state = (state + same | state - same) & every
        yield state


def _lcs_length(a: bytes, b: bytes) -> int:
    state = every = (1 << len(b)) - 1
    for state in _lcs_rows(a, b, 0, every):
        pass
    return len(b) - state.bit_count()


def _lcs(a: bytes, b: bytes) -> bytes:
    """Every step-th row is kept and the rows between are made again on the way back, so memory grows with the square root of a."""
    every, step = (1 << len(b)) - 1, math.isqrt(len(a)) + 1
    kept, state = [every], every
    for i, state in enumerate(_lcs_rows(a, b, 0, every), 1):
        if i % step == 0:
            kept.append(state)
    out, i, j = bytearray(), len(a), len(b)
    rows, base = [], len(a) + 1
    while i and j:
        if i <= base:
            base = (i - 1) // step * step
            rows = [kept[base // step], *islice(_lcs_rows(a, b, base, kept[base // step]), step)]
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i - base] >> (j - 1) & 1:  # the row doesn't rise here: as much is common without b's last byte
            j -= 1
        else:
            i -= 1
    return bytes(reversed(out))


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return ""


@F.pandas_udf(T.StringType())
def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
    """The longest common subsequence of the bytes; empty if it is no UTF-8."""
    return pd.Series([None if a is None or b is None else _utf8(_lcs(a.encode(), b.encode())) for a, b in zip(left, right, strict=True)], dtype=object)


@F.pandas_udf(T.LongType())
def lcs_bytes(left: pd.Series, right: pd.Series) -> pd.Series:
    """How many bytes the longest common subsequence has."""
    return pd.Series([None if a is None or b is None else _lcs_length(a.encode(), b.encode()) for a, b in zip(left, right, strict=True)], dtype="Int64")


def counter_steps(table: pa.Table) -> pa.Table:
    """One counter's steps (seq, key, n, _start) in order: seq, key, value, status."""
    table = table.sort_by("seq")
    values, states = [], []
    held = None
    for n, start in zip(table.column("n").to_pylist(), table.column("_start").to_pylist(), strict=True):
        held = start if held is None else held
        ok = -(1 << 63) <= held + n < 1 << 63
        held += n * ok
        values.append(held if ok else None)
        states.append("ok" if ok else "overflow")
    return pa.table({"seq": table.column("seq"), "key": table.column("key"), "value": pa.array(values, pa.int64()), "status": pa.array(states, pa.string())})


def _steps(path: str) -> list[str]:
    path = path.removeprefix("$")
    return [s for s in path.split(".") if s]


def _index(step: str) -> int | None:
    return int(step[1:-1]) if step.startswith("[") and step.endswith("]") and step[1:-1].isdigit() else None


def _child(node, step: str):
    """The member or element that a step names: (found, value)."""
    at = _index(step)
    if isinstance(node, list) and at is not None and at < len(node):
        return True, node[at]
    if isinstance(node, dict) and step in node:
        return True, node[step]
    return False, None


def _written(doc) -> str:
    def number(value):
        if isinstance(value, dict):
            return {k: number(v) for k, v in value.items()}
        if isinstance(value, list):
            return [number(v) for v in value]
        return int(value) if isinstance(value, float) and value.is_integer() and abs(value) < 1e15 else value

    return json.dumps(number(doc), ensure_ascii=False, separators=(",", ":"))


def _edited(doc: str | None, path: str, change) -> str | None:
    """The document with ``change(holder, step, found, value)`` applied where the path ends; null if it can't be."""
    try:
        root = json.loads(doc)
    except (TypeError, ValueError):
        return None
    steps = _steps(path)
    holder = [root]
    if not steps:
        return _written(holder[0]) if change(holder, 0, True, root) else None
    node = root
    for step in steps[:-1]:
        found, node = _child(node, step)
        if not found:
            return None
    found, value = _child(node, steps[-1])
    at = _index(steps[-1])
    if isinstance(node, list) and at is None or not isinstance(node, dict | list):
        return None
    return _written(root) if change(node, steps[-1] if isinstance(node, dict) else at, found, value) else None


def json_edit(change):
    """An Arrow function (documents, paths, arguments) to edited documents; ``change`` returns whether it applied."""

    @F.pandas_udf(T.StringType())
    def edit(docs: pd.Series, paths: pd.Series, arguments: pd.Series) -> pd.Series:
        return pd.Series([_edited(d, p, lambda *at, a=a: change(*at, a)) for d, p, a in zip(docs, paths, arguments, strict=True)], dtype=object)

    return edit


def _set(holder, step, found, value, argument):
    if isinstance(holder, list) and not found:
        return False
    holder[step] = json.loads(argument)
    return True


def _delete(holder, step, found, value, argument):
    if found:
        del holder[step]
    return found


def _add(holder, step, found, value, argument):
    ok = found and isinstance(value, int | float) and not isinstance(value, bool)
    if ok:
        holder[step] = value + float(argument)
    return ok


def _times(holder, step, found, value, argument):
    ok = found and isinstance(value, int | float) and not isinstance(value, bool)
    if ok:
        holder[step] = value * float(argument)
    return ok


def _append_text(holder, step, found, value, argument):
    ok = found and isinstance(value, str)
    if ok:
        holder[step] = value + (argument[1:-1] if len(argument) > 1 and argument[0] == argument[-1] == '"' else argument)
    return ok


def _append(holder, step, found, value, argument):
    ok = found and isinstance(value, list)
    if ok:
        value.append(json.loads(argument))
    return ok


def _insert(holder, step, found, value, argument):
    at, item = json.loads(argument)
    ok = found and isinstance(value, list)
    if ok:
        at = max(0, len(value) + at) if at < 0 else min(at, len(value))
        value.insert(at, item)
    return ok


def _pop(holder, step, found, value, argument):
    ok = found and isinstance(value, list)
    if ok and value:
        at = int(argument)
        value.pop(max(0, len(value) + at) if at < 0 else min(at, len(value) - 1))
    return ok


def _trim(holder, step, found, value, argument):
    start, stop = json.loads(argument)
    ok = found and isinstance(value, list)
    if ok:
        n = len(value)
        low, high = (max(0, n + x) if x < 0 else x for x in (start, stop))
        value[:] = value[low : min(high, n - 1) + 1] if low <= min(high, n - 1) else []
    return ok


def _toggle(holder, step, found, value, argument):
    ok = found and isinstance(value, bool)
    if ok:
        holder[step] = not value
    return ok


def _clear(holder, step, found, value, argument):
    if found and isinstance(value, list | dict):
        value.clear()
    elif found and isinstance(value, int | float) and not isinstance(value, bool):
        holder[step] = 0
    else:
        return False
    return True


json_set, json_del, json_add, json_times = json_edit(_set), json_edit(_delete), json_edit(_add), json_edit(_times)
json_append_text, json_append, json_insert = json_edit(_append_text), json_edit(_append), json_edit(_insert)
json_pop, json_trim, json_toggle, json_clear = json_edit(_pop), json_edit(_trim), json_edit(_toggle), json_edit(_clear)

REQUESTS = "path string, n bigint, words array<string>"


def _requests(data: bytes) -> Iterator[list[str]]:
    at = 0

    def line() -> bytes:
        nonlocal at
        end = data.index(b"\n", at)
        found, at = data[at:end].rstrip(b"\r"), end + 1
        return found

    try:
        while at < len(data):
            head = line()
            if not head:
                continue
            if head[:1] != b"*":
                raise ValueError(head)
            words = []
            for _ in range(int(head[1:])):
                size = line()
                if size[:1] != b"$":
                    raise ValueError(size)
                stop = at + int(size[1:])
                if not at <= stop <= len(data) or data[stop : stop + 1] not in (b"\r", b"\n"):
                    raise ValueError("a wrong length")
                words.append(data[at:stop].decode("utf-8", "replace"))
                at = stop
                line()
            yield words
    except ValueError:
        yield ["ERROR"]


def parsed_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) to the requests of each file, numbered, in batches."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found, first = _requests(content.as_py()), 0
            while words := list(islice(found, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(words)), pa.array(range(first, first + len(words)), pa.int64()), pa.array(words, pa.list_(pa.string()))], ["path", "n", "words"])
                first += len(words)
