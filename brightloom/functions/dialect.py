"""Functions whose meaning in the supported dialect differs from Spark's."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ci(value: Column) -> Column:
    """For comparing text without regard to case."""
    return F.lower(value)


def like_ci(value: Column, pattern: str) -> Column:
    return value.ilike(pattern)


def length_bytes(value: Column) -> Column:
    return F.octet_length(value)


def flag(condition: Column) -> Column:
    """A condition as 0 or 1; null stays null."""
    return condition.cast("int")


def group_concat(value: Column, separator: str = ",", order: Column | None = None, descending: bool = False, distinct: bool = False) -> Column:
    """The group's values joined; nulls are left out. They are sorted by themselves, or by ``order`` and then by
    themselves; ``descending`` turns the order, ``distinct`` keeps one of equals (of equal values and orders)."""
    pairs = F.when(value.isNotNull(), F.struct((order if order is not None else value).alias("o"), value.cast("string").alias("v")))
    gathered = F.sort_array(F.collect_set(pairs) if distinct else F.collect_list(pairs), asc=not descending)
    return F.array_join(F.transform(gathered, lambda x: x["v"]), separator)


def unsigned_big(value: Column) -> Column:
    """Unsigned 64-bit integers need 20 digits."""
    return value.cast("decimal(20,0)")


def json_value(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def json_length(doc: Column) -> Column:
    """Elements of an array, keys of an object, 1 for a scalar, null for no document."""
    head = F.substring(F.ltrim(doc), 1, 1)
    return F.when(head == "[", F.json_array_length(doc)).when(head == "{", F.size(F.json_object_keys(doc))).when(doc.isNotNull(), 1)


def json_type(doc: Column) -> Column:
    head = F.substring(F.ltrim(doc), 1, 1)
    return (
        F.when(head == "{", "OBJECT").when(head == "[", "ARRAY").when(head == '"', "STRING").when(F.trim(doc).isin("true", "false"), "BOOLEAN")
        .when(F.trim(doc) == "null", "NULL").when(F.trim(doc).rlike("^-?[0-9]+$"), "INTEGER").when(doc.isNotNull(), "DOUBLE"))


_STEP = re.compile(r'\.([A-Za-z_][A-Za-z0-9_]*)|\."((?:[^"\\]|\\.)*)"|\[([0-9]+)\]')


def _path(path: str) -> list[str | int]:
    """The steps of a path like $.a[0]."b c"; ValueError for anything else."""
    at, out = 1, []
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"invalid path {path}")
        out.append(int(m.group(3)) if m.group(3) else m.group(1) or m.group(2))
        at = m.end()
    if not path.startswith("$"):
        raise ValueError(f"invalid path {path}")
    return out


def _by_document(change) -> Callable[..., Column]:
    """A function of parsed documents as a pandas UDF: JSON text in, JSON text out. Spark has no typed JSON that could do it."""
    @F.pandas_udf("string")
    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        def one(d, v):
            try:
                return change(json.loads(d), v) if d is not None else None
            except ValueError:
                return None
        return pd.Series([one(d, v) for d, v in zip(docs, values, strict=True)], dtype=object)

    return run


def _find(doc, steps: list[str | int]):
    """The value at a path, in a list; empty where there is none. A scalar is its own first element."""
    for s in steps:
        if isinstance(s, int):
            if isinstance(doc, list):
                if s >= len(doc):
                    return []
                doc = doc[s]
            elif s:
                return []
        elif isinstance(doc, dict) and s in doc:
            doc = doc[s]
        else:
            return []
    return [doc]


def json_extract(doc: Column, *paths: str) -> Column:
    """The JSON at a path (text keeps its quotes), or the array of those found at several; null where there is none."""
    steps = [_path(p) for p in paths]

    def one(d, _):
        found = [x for s in steps for x in _find(d, s)]
        return (json.dumps(found[0] if len(paths) == 1 else found, ensure_ascii=False)) if found else None

    return _by_document(one)(doc, F.lit(""))


def _holds(target, wanted) -> bool:
    """JSON containment: scalars equal in type and value, an array holds all of another's elements or one value, an
    object holds another's keys with values that hold theirs."""
    if isinstance(target, list):
        return all(any(_holds(x, w) for x in target) for w in wanted) if isinstance(wanted, list) else any(_holds(x, wanted) for x in target)
    if isinstance(target, dict):
        return isinstance(wanted, dict) and all(k in target and _holds(target[k], w) for k, w in wanted.items())
    same = isinstance(target, bool) == isinstance(wanted, bool) and isinstance(target, str) == isinstance(wanted, str) and not isinstance(wanted, (list, dict))
    return same and target == wanted


def json_contains(doc: Column, value: str, path: str = "$") -> Column:
    """Whether the document at ``path`` holds ``value`` (JSON text), typed: ["2"] does not hold 2. Null for no document,
    no such path, or text that is no JSON."""
    steps, wanted = _path(path), json.loads(value)

    def one(d, _):
        found = _find(d, steps)
        return str(_holds(found[0], wanted)).lower() if found else None

    return _by_document(one)(doc, F.lit("")).cast("boolean")


def json_set(doc: Column, path: str, value: Column) -> Column:
    """The document with the value at ``path`` replaced, or added where its parent is there (after an array's end: appended);
    else as it is. ``value`` is an SQL value: text becomes a JSON string, numbers and booleans stay such. Null for no JSON."""
    steps = _path(path)

    def one(d, v):
        new = json.loads(v).get("v")  # a null is left out
        if not steps:
            return json.dumps(new, ensure_ascii=False)
        for parent in _find(d, steps[:-1]):
            last = steps[-1]
            if isinstance(last, int) and isinstance(parent, list):
                parent[last : last + 1] = [new]
            elif isinstance(last, str) and isinstance(parent, dict):
                parent[last] = new
        return json.dumps(d, ensure_ascii=False)

    return _by_document(one)(doc, F.to_json(F.struct(value.alias("v"))))


def fixed_binary(value: Column, n: int) -> Column:
    """BINARY(n): padded with zero bytes on the right."""
    return F.rpad(value, n, F.lit(bytearray(b"\x00")))


def enum_rank(value: Column, allowed: list[str]) -> Column:
    """The place of a value in its enumeration, for ordering; null outside it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, allowed)), value), F.lit(0))
