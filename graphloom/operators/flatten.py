"""Deeply nested records as related flat tables.

Each document is one row with nested arrays of structs. The flat tables come
from one SQL projection each: nested ``transform`` calls attach the key of the
container and the index within it, ``flatten`` joins the arrays of one level,
and a single ``inline`` per target table emits the rows. No join and no shuffle
is needed to keep the parent-child links.

The only thing SQL cannot do is follow containers of unknown depth; so the
reader numbers the components of a document and gives each the number ``up`` of
its container, and the projection resolves that number to the container's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.diagrams import nested_cells, nested_descriptions
from ..staging import Stage

KEYS = ["doc_kind", "doc_key", "record_kind", "record_id", "parent_id"]

#: One projection per target table; each yields an array of structs for ``inline``.
PROJECTIONS = {
    "cell": "transform(cells, c -> struct(c.id AS record_id, c.parent AS parent_id, c.label AS label, c.style AS style, c.vertex AS vertex, c.edge AS edge, c.source AS source, c.target AS target))",
    "point": "flatten(transform(cells, c -> transform(c.points, (p, i) -> struct(string(i + 1) AS record_id, c.id AS parent_id, p.x AS x, p.y AS y))))",
    "component": "transform(components, c -> struct(c.id AS record_id, if(c.up < 0, '', components[c.up].id) AS parent_id, c.label AS label, c.type AS type))",
    "port": "flatten(transform(components, c -> transform(c.ports, p -> struct(p.name AS record_id, c.id AS parent_id, p.side AS side))))",
    "relationship": """flatten(flatten(transform(
        concat(transform(components, c -> struct(c.id AS holder, c.relations AS relations)), array(struct('' AS holder, relations AS relations))),
        h -> transform(h.relations, r -> flatten(transform(r.sources, s -> transform(r.targets, t ->
            struct(concat(s, '->', t) AS record_id, h.holder AS parent_id, r.type AS type, r.label AS label))))))))""",
}
DIAGRAM_TABLES = ("cell", "point")
DESCRIPTION_TABLES = ("component", "port", "relationship")


def project(nested: DataFrame, record_kind: str) -> DataFrame:
    """The flat table ``record_kind`` of nested documents; missing keys are ''."""
    rows = nested.select("doc_key", F.expr(f"inline({PROJECTIONS[record_kind]})"))
    kind = "diagram" if record_kind in DIAGRAM_TABLES else "description"
    return rows.select(
        F.lit(kind).alias("doc_kind"), "doc_key", F.lit(record_kind).alias("record_kind"),
        F.coalesce("record_id", F.lit("")).alias("record_id"), F.coalesce("parent_id", F.lit("")).alias("parent_id"),
        *[c for c in rows.columns if c not in ("doc_key", "record_id", "parent_id")],
    )


def flat_tables(spark: SparkSession, diagrams: DataFrame | None, descriptions: DataFrame | None, full: bool = True) -> dict[str, DataFrame]:
    """``{record_kind: table}`` of both kinds of documents.

    Rows repeated in the input give repeated rows; a NULL key stays NULL; a NULL,
    empty or broken document gives no rows. Other input columns are not read.
    """
    stage, out = Stage(spark, "flatten"), {}
    if diagrams is not None:
        nested = stage.put(nested_cells(diagrams, "diagram_id", "xml_content", full))
        out |= {k: project(nested, k) for k in DIAGRAM_TABLES}
    if descriptions is not None:
        nested = stage.put(nested_descriptions(descriptions, "description_id", "components", "relationships"))
        out |= {k: project(nested, k) for k in DESCRIPTION_TABLES}
    return out


def links(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys and parent keys of all tables as one table of distinct rows."""
    parts = [t.select(KEYS) for t in tables.values()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.distinct()
