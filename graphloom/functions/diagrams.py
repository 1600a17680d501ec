"""Reading diagram XML and description JSON into nested records of one fixed shape.

Both documents have no fixed depth and no fixed element names, so no schema for
``from_xml``/``from_json`` fits them. One Arrow stage per table turns a document
into arrays of structs; every projection after it is Spark SQL.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_START = re.compile(r"<(mxfile|mxGraphModel)")

_POINT = pa.struct([("x", pa.string()), ("y", pa.string())])
CELL_FIELDS = ("id", "parent", "label", "style", "vertex", "edge", "source", "target")

CELLS_DDL = "array<struct<" + ",".join(f"{f}:string" for f in CELL_FIELDS) + ",points:array<struct<x:string,y:string>>>>"


def parse_diagram(text: str | None) -> ElementTree.Element | None:
    """The root element, or None if there is none or it is not well-formed.

    What stands before the first ``<mxfile`` or ``<mxGraphModel`` and after its
    end tag is ignored. An end tag inside a comment does not count: then the
    next one is tried.
    """
    start = _START.search(text) if text else None
    if not start:
        return None
    end_tag, at, end = f"</{start[1]}", start.start(), start.end()
    while True:
        end = text.find(end_tag, end)
        stop = text.find(">", end) + 1 if end >= 0 else 0
        try:
            return ElementTree.fromstring(text[at : stop or len(text)])
        except (ElementTree.ParseError, ValueError, UnicodeError):
            if end < 0 or not stop:
                return None
            end = stop


def cell_rows(root: ElementTree.Element) -> Iterator[tuple[str, ElementTree.Element, ElementTree.Element | None]]:
    """(id, cell, the element around it if the cell has no id of its own)."""
    around = None
    for cell in root.iter("mxCell"):
        own = cell.get("id")
        if own is not None:
            yield own, cell, None
            continue
        if around is None:
            around = {child: element for element in root.iter() for child in element}
        outer = around.get(cell)
        yield (outer.get("id") or "" if outer is not None else ""), cell, outer


def _points(cell: ElementTree.Element) -> list[ElementTree.Element]:
    return [p for g in cell if g.tag == "mxGeometry" for a in g if a.tag == "Array" and a.get("as") == "points" for p in a if p.tag == "mxPoint"]


def _cells_batch(ids: pa.Array, texts: pa.Array, full: bool) -> pa.RecordBatch:
    offsets, columns = [0], [[] for _ in CELL_FIELDS]
    point_at, xs, ys = [0], [], []
    id_, parent_, label_ = columns[:3]
    for text in texts.to_pylist():
        root = parse_diagram(text)
        if root is not None:
            for own, cell, outer in cell_rows(root):
                id_.append(own)
                parent_.append(cell.get("parent") or "")
                label_.append(((outer.get("label") if outer is not None else None) or cell.get("value")) if full else None)
                if full:
                    for k in range(3, len(CELL_FIELDS)):
                        columns[k].append(cell.get(CELL_FIELDS[k]))
                if len(cell):
                    for p in _points(cell):
                        xs.append(p.get("x"))
                        ys.append(p.get("y"))
                point_at.append(len(xs))
        offsets.append(len(id_))
    n = len(id_)
    points = pa.ListArray.from_arrays(pa.array(point_at, pa.int32()), pa.StructArray.from_arrays([pa.array(xs, pa.string()), pa.array(ys, pa.string())], fields=list(_POINT)))
    arrays = [pa.array(c, pa.string()) if len(c) == n else pa.nulls(n, pa.string()) for c in columns]
    cells = pa.StructArray.from_arrays([*arrays, points], names=[*CELL_FIELDS, "points"])
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)], names=["doc_key", "cells"])


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: bounds the memory of a Python stage over long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def nested_cells(df: DataFrame, key: str, xml: str, full: bool = False) -> DataFrame:
    """One row per diagram: ``doc_key`` and its ``cells`` (array, empty if the XML cannot be read).

    ``full`` adds label, style, vertex, edge, source and target; without it they are NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield _cells_batch(batch.column(0), batch.column(1), full)

    source = df.select(df[key].cast("bigint").alias("doc_key"), df[xml].cast("string").alias("xml"))
    return source.mapInArrow(run, f"doc_key bigint, cells {CELLS_DDL}")


# --- descriptions ---------------------------------------------------------

#: The keys that tell a component, a relationship or a wrapped list.
COMPONENT_KEYS = frozenset(["id", "name", "label", "type", "description", "text_content", "attributes", "ports", "children", "parts", "relationships", "links"])
RELATION_KEYS = frozenset(["source", "target", "from", "to"])
PORT_KEYS = frozenset(["name", "side"])
WRAPPER_KEYS = frozenset(["components", "relationships", "items", "details", "list", "data", "values", "elements", "nodes", "edges", "children", "parts", "links", "ports"])

RELATION_DDL = "struct<sources:array<string>,targets:array<string>,type:string,label:string>"
COMPONENT_DDL = f"struct<id:string,up:int,label:string,type:string,ports:array<struct<name:string,side:string>>,relations:array<{RELATION_DDL}>>"
DESCRIPTION_DDL = f"doc_key bigint, components array<{COMPONENT_DDL}>, relations array<{RELATION_DDL}>"

_RELATION = pa.struct([("sources", pa.list_(pa.string())), ("targets", pa.list_(pa.string())), ("type", pa.string()), ("label", pa.string())])
_COMPONENT = pa.struct([
    ("id", pa.string()), ("up", pa.int32()), ("label", pa.string()), ("type", pa.string()),
    ("ports", pa.list_(pa.struct([("name", pa.string()), ("side", pa.string())]))), ("relations", pa.list_(_RELATION)),
])


def text_of(value: object) -> str:
    """A JSON scalar as text; '' for null."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def read_json(text: str | None) -> object:
    """A JSON document; a document that is itself a string of JSON is read again. None if broken."""
    value: object = text
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def members(value: object, own: frozenset[str]) -> Iterator[tuple[str | None, dict | str]]:
    """(key it stands under or None, item) of a value that should be a list.

    A list gives its items, an object with one of the keys ``own`` is a list of
    one, an object around a list gives that list, and any other object is a map
    from ids to items. Works through an explicit stack, so depth is no limit.
    """
    stack: list[tuple[str | None, object]] = [(None, value)]
    while stack:
        key, x = stack.pop()
        if isinstance(x, list):
            stack.extend((key, y) for y in reversed(x))
        elif isinstance(x, str):
            inner = read_json(x) if x[:1] in "[{\"" and x else None
            if isinstance(inner, (list, dict)):
                stack.append((key, inner))
            else:
                yield key, x
        elif isinstance(x, dict):
            if key is not None or own & x.keys() and not (len(x) == 1 and WRAPPER_KEYS & x.keys() - {"ports"}):
                yield key, x
            else:
                lists = [(None, y) for k, y in x.items() if isinstance(y, list) or isinstance(y, dict) and k in WRAPPER_KEYS]
                stack.extend(reversed(lists or [(k, y) for k, y in x.items() if isinstance(y, dict)]))


def _ends(relation: dict, *names: str) -> list[str]:
    value = next((relation[n] for n in names if relation.get(n) is not None), None)
    out = []
    for end in value if isinstance(value, list) else [value]:
        if isinstance(end, dict):
            end = next((end[k] for k in ("id", "name") if end.get(k) is not None), None)
        out.append(text_of(end))
    return out


def _relations(value: object) -> list[dict]:
    return [
        {"sources": _ends(r, "source", "from"), "targets": _ends(r, "target", "to"), "type": text_of(r.get("type")) or None, "label": text_of(r.get("label")) or None}
        for _, r in members(value, RELATION_KEYS)
        if isinstance(r, dict)
    ]


def describe_components(value: object) -> list[dict]:
    """All components at any depth; ``up`` is the position of the one around it, or -1."""
    out: list[dict] = []
    stack = [(key, x, -1) for key, x in members(value, COMPONENT_KEYS)][::-1]
    while stack:
        key, x, up = stack.pop()
        if not isinstance(x, dict):
            continue
        own = next((text_of(v) for v in (x.get("id"), key, x.get("name")) if v is not None and v != ""), "")
        ports = [
            {"name": text_of(p.get("name")) or k or "", "side": text_of(p.get("side")) or None} if isinstance(p, dict) else {"name": p, "side": None}
            for k, p in members(x.get("ports"), PORT_KEYS)
        ]
        here = len(out)
        out.append({
            "id": own, "up": up, "label": text_of(x.get("label")) or None, "type": text_of(x.get("type")) or None,
            "ports": ports, "relations": _relations(x.get("relationships")) + _relations(x.get("links")),
        })
        stack.extend([(k, c, here) for field in ("children", "parts") for k, c in members(x.get(field), COMPONENT_KEYS)][::-1])
    return out


def nested_descriptions(df: DataFrame, key: str, components: str, relationships: str) -> DataFrame:
    """One row per description: its components at any depth, and its own relationships."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            comp = pa.array([describe_components(read_json(t)) for t in batch.column(1).to_pylist()], pa.list_(_COMPONENT))
            rel = pa.array([_relations(read_json(t)) for t in batch.column(2).to_pylist()], pa.list_(_RELATION))
            yield pa.RecordBatch.from_arrays([batch.column(0), comp, rel], names=["doc_key", "components", "relations"])

    source = df.select(df[key].cast("bigint").alias("doc_key"), df[components].cast("string").alias("c"), df[relationships].cast("string").alias("r"))
    return source.mapInArrow(run, DESCRIPTION_DDL)
