"""JSON texts as rows: every value with its path, place and what it stands in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Containers deeper than this are not gone into.
DEEPEST = 50
_COLUMNS = [("path", pa.string()), ("place", pa.int32()), ("depth", pa.int32()), ("key", pa.string()), ("kind", pa.string()), ("value", pa.string()), ("parent", pa.int32()), ("keys", pa.list_(pa.string())), ("types", pa.list_(pa.string()))]
_SCHEMA = "path string, place int, depth int, key string, kind string, value string, parent int, keys array<string>, types array<string>"
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def _rows(root: object, deepest: int) -> list[tuple]:
    """In the order of the text. keys are those above the value, types the @types of the objects around it, both outermost first."""
    out: list[tuple] = []
    # (value, path, key, depth, place of the container, keys above, types above)
    todo = [(root, "$", None, 0, None, [], [])]
    while todo:
        value, path, key, depth, parent, keys, types = todo.pop()
        if isinstance(value, dict) and (own := value.get("@type")):
            types = [*types, " ".join(map(str, own)) if isinstance(own, list) else str(own)]
        text = None if value is None or isinstance(value, (dict, list)) else value if isinstance(value, str) else json.dumps(value)
        out.append((path, len(out), depth, key, _KINDS[type(value)], text, parent, keys, types))
        if isinstance(value, (dict, list)) and depth < deepest:
            place, below = len(out) - 1, keys if key is None else [*keys, key]
            named = [(v, f"{path}.{k}" if k.isidentifier() else f"{path}.{json.dumps(k, ensure_ascii=False)}", k) for k, v in value.items()] if isinstance(value, dict) else [(v, f"{path}[{n}]", None) for n, v in enumerate(value)]
            todo += [(v, p, k, depth + 1, place, below, types) for v, p, k in reversed(named)]
    return out


def values(df: DataFrame, json_col: str, keep: list[str], deepest: int = DEEPEST) -> DataFrame:
    """The columns `keep`, and for every value of the JSON text: path ($.a[0].b), place (in the order of the text), depth, key
    (null in lists), kind, value (text; null for objects, lists and null), parent (the container's place), keys (those above),
    and types (the @types of the objects around it, outermost first). Containers at depth `deepest` are rows, what they hold is not. Texts that
    are no JSON, and null ones, have no rows. Linear in the text; a walk without recursion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column("_json")):
                try:
                    found = _rows(json.loads(text.as_py().lstrip("﻿")), deepest) if text.is_valid else []
                except (ValueError, RecursionError):
                    continue
                at += [k] * len(found)
                rows += found
                if len(rows) > 50_000:
                    yield _batch(batch, at, rows)
                    at, rows = [], []
            if rows:
                yield _batch(batch, at, rows)

    def _batch(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kept = batch.select(keep).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _COLUMNS, strict=True))], [*keep, *(name for name, _ in _COLUMNS)])

    schema = T.StructType([*(df.schema[c] for c in keep), *T._parse_datatype_string(_SCHEMA).fields])
    return df.select(*keep, F.col(json_col).cast("string").alias("_json")).mapInArrow(run, schema)


def leaves(df: DataFrame, json_col: str, keep: list[str], deepest: int = DEEPEST) -> DataFrame:
    """The values that are no containers."""
    return values(df, json_col, keep, deepest).where(~F.col("kind").isin("object", "array"))
