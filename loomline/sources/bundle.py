"""All structured data of a page from one parse: rows of (page, kind, place, name, payload).

Kinds, and their payloads as JSON text:
  jsonld      a node of JSON-LD; graphs laid out, references by @id resolved once, own keys first
  open_graph  the og: and twitter: properties with a content, the first of each
  property    {property, value} of an element with itemprop: its content attribute, else the text below it
  item        an outermost item of microdata: {type, properties}, items within it as values
  script      a script of a JSON type; name is its id
  state       what scripts assign to a name, each assignment of a script, with packed payloads unpacked; name is the name
  table       {table, row, cells} of tables with a header, two columns and three rows or more

A packed payload is a list whose objects and lists hold places in that list. It is unpacked from place 0; a reference to
what is being unpacked is null, and a payload that would unpack to over MOST_VALUES values stays packed. JSON that does not
parse is passed over. Pages are parsed once each, whole; null pages have no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom

MOST_VALUES, MOST_DEPTH = 200_000, 200
#: Fixed values of the format: ids of scripts with packed payloads, and tags before the place of what they wrap.
PACKED_IDS = ["__NUXT_DATA__"]
WRAPPERS = ["Reactive", "ShallowReactive", "Ref", "ShallowRef", "NuxtError"]
#: Attributes that hold a property's address.
_ADDRESS = {"a": "href", "area": "href", "link": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "iframe": "src", "embed": "src", "object": "data"}
_ASSIGNED = re.compile(r"""(?:\b(?:window|self|globalThis)\s*(?:\.\s*([\w$]+)|\[\s*["']([\w$.-]+)["']\s*\])|\b(?:var|let|const)\s+([\w$]+))\s*=\s*(JSON\s*\.\s*parse\s*\(\s*)?(?=["'{\[])""")
_PUSHED = re.compile(r"\bself\s*\.\s*__next_f\s*\.\s*push\s*\(\s*(?=\[)")
_DECODER = json.JSONDecoder()


# --- scripts -----------------------------------------------------------------------------------------------------


def graph_nodes(value: object) -> list[dict]:
    """The nodes of a JSON-LD block, references resolved."""
    listed = value if isinstance(value, list) else value.get("@graph", [value]) if isinstance(value, dict) else []
    found = [v for v in listed if isinstance(v, dict)]
    index = {v["@id"]: v for v in found if isinstance(v.get("@id"), str)}

    def resolved(value: object, seen: tuple) -> object:
        if isinstance(value, list):
            return [resolved(v, seen) for v in value]
        if not isinstance(value, dict):
            return value
        key = value.get("@id")
        if isinstance(key, str) and key in index and key not in seen and index[key] is not value:
            value = index[key] | value
        return {k: resolved(v, (*seen, key)) if k != "@id" else v for k, v in value.items()}

    return [resolved(v, ()) for v in found]


class _TooLarge(Exception):
    pass


def unpacked(slots: object) -> object:
    """What a packed list stands for; anything else, and what is too large, as it is."""
    if not isinstance(slots, list) or not slots:
        return slots
    left, open_slots = [MOST_VALUES], set()

    def at(place: object) -> object:
        if not isinstance(place, int) or isinstance(place, bool):
            return place
        left[0] -= 1
        if left[0] < 0 or len(open_slots) > MOST_DEPTH:
            raise _TooLarge
        if not 0 <= place < len(slots) or place in open_slots:
            return None
        value = slots[place]
        if not isinstance(value, (list, dict)):
            return value
        open_slots.add(place)
        if isinstance(value, dict):
            out = {k: at(v) for k, v in value.items()}
        elif len(value) == 2 and value[0] in WRAPPERS:
            out = at(value[1])
        else:
            out = [at(v) for v in value]
        open_slots.discard(place)
        return out

    try:
        return at(0)
    except _TooLarge:
        return slots


def assigned(script: str) -> Iterator[tuple[str, object]]:
    """(name, value) of the JSON lists and objects that a script assigns, in order. The scan goes on behind each value."""
    at = 0
    while m := _ASSIGNED.search(script, at):
        at = m.end()
        try:
            if script[at] in "{[":
                value, at = _DECODER.raw_decode(script, at)
            elif m[4] and script[at] == '"':
                text, at = _DECODER.raw_decode(script, at)
                value = json.loads(text)
            else:
                continue
        except (ValueError, RecursionError):
            continue
        if isinstance(value, (list, dict)) and value:
            yield m[1] or m[2] or m[3], value
    at = 0
    while m := _PUSHED.search(script, at):
        at = m.end()
        try:
            pushed, at = _DECODER.raw_decode(script, at)
            value = json.loads(pushed[1].partition(":")[2])
        except (ValueError, IndexError, AttributeError, TypeError, RecursionError):
            continue
        if isinstance(value, (list, dict)) and value:
            yield "__NEXT_F__", value


# --- a page ------------------------------------------------------------------------------------------------------


class _Page:
    def __init__(self, html: str):
        self.rows = dom._Parser(shapes=False).page(html)
        self.attrs = [dict(r["attrs"]) for r in self.rows]
        self.flow = self.rows[0]["flow"] if self.rows else ""

    def text(self, row: dict) -> str:
        return self.flow[row["start"] : row["end"]].strip()

    def found(self) -> Iterator[tuple[str, str | None, object]]:
        """(kind, name, payload) in the order of kinds within elements."""
        meta: dict[str, str] = {}
        for row, attrs in zip(self.rows, self.attrs, strict=True):
            if row["tag"] == "script":
                yield from self._script(row, attrs)
            elif row["tag"] == "meta":
                name = attrs.get("property") or attrs.get("name") or ""
                if name.lower().startswith(("og:", "twitter:")) and attrs.get("content"):
                    meta.setdefault(name, attrs["content"])
        if meta:
            yield "open_graph", None, meta
        yield from self._microdata()
        yield from self._tables()

    def _script(self, row: dict, attrs: dict[str, str]) -> Iterator[tuple[str, str | None, object]]:
        kind, name, body = attrs.get("type", "").split(";")[0].strip().lower(), attrs.get("id") or None, row["text"]
        if not kind.endswith("json"):
            for name, value in assigned(body):
                yield "state", name, value
            return
        try:
            value, _ = _DECODER.raw_decode(body.strip())
        except (ValueError, RecursionError):
            return
        if kind == "application/ld+json":
            for node in graph_nodes(value):
                yield "jsonld", None, node
        elif name in PACKED_IDS:
            yield "state", name, unpacked(value)
        else:
            yield "script", name, value

    def _microdata(self) -> Iterator[tuple[str, str | None, object]]:
        items: dict[int, dict] = {}
        outer: list[dict] = []
        within: list[int | None] = []  # the item that each node stands in
        for row, attrs in zip(self.rows, self.attrs, strict=True):
            owner = None if row["parent"] is None else row["parent"] if row["parent"] in items else within[row["parent"]]
            within.append(owner)
            names = attrs.get("itemprop", "").split()
            if "itemscope" in attrs:
                items[row["pre"]] = {"type": attrs.get("itemtype", ""), "properties": {}}
                if not (names and owner is not None):
                    outer.append(items[row["pre"]])
            if not names:
                continue
            text = attrs.get("content") or self.text(row)
            value = items.get(row["pre"]) or attrs.get("content") or attrs.get(_ADDRESS.get(row["tag"], "")) or text
            for name in names:
                if owner is not None and value:
                    items[owner]["properties"].setdefault(name, []).append(value)
                if row["pre"] not in items and text:
                    yield "property", name, {"property": name, "value": text}
        for item in outer:
            yield "item", item["type"] or None, item

    def _tables(self) -> Iterator[tuple[str, str | None, object]]:
        # a node's nearest table, row and cell; a table within a cell is none of the cell's text
        table, line, cell = [], [], []
        grids: dict[int, dict[int, dict[int, list[str]]]] = {}
        for row in self.rows:
            up = row["parent"]
            t, r, c = (table[up], line[up], cell[up]) if up is not None else (None, None, None)
            if row["tag"] == "table":
                t, r, c = row["pre"], None, None
                grids[t] = {}
            elif row["tag"] == "tr" and t is not None:
                r, c = row["pre"], None
                grids[t].setdefault(r, {})
            elif row["tag"] in ("td", "th") and t is not None:
                r, c = r if r is not None else t, row["pre"]
                grids[t].setdefault(r, {})[c] = []
            elif row["tag"] == "#text" and c is not None and not row["silent"]:
                grids[t][r][c].append(" ".join(row["text"].split()))
            table.append(t)
            line.append(r)
            cell.append(c)
        for n, grid in enumerate(grids.values()):
            lines = [cells for cells in grid.values() if cells]
            if len(lines) < 4 or len(lines[0]) < 2 or not any(self.rows[c]["tag"] == "th" for c in lines[0]):
                continue
            heads = [" ".join(filter(None, text)) or f"column_{k}" for k, text in enumerate(lines[0].values(), 1)]
            for k, cells in enumerate(lines[1:], 1):
                yield "table", None, {"table": n, "row": k, "cells": {h: " ".join(filter(None, text)) for h, text in zip(heads, cells.values(), strict=False)}}


def bundle(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col, kind, place (from 0 within the page), name and payload."""

    def read(html: str) -> list[tuple]:
        # keys keep their order but for nodes and states, whose text is the same however they were written
        return [(kind, k, name, json.dumps(p, sort_keys=kind in ("jsonld", "script", "state"), ensure_ascii=False)) for k, (kind, name, p) in enumerate(_Page(html).found())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, rows in dom.in_batches(batch.column("_html"), read):
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(places, pa.int32())), *columns], [id_col, "kind", "place", "name", "payload"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, f"{id_col} {kind}, kind string, place int, name string, payload string")
