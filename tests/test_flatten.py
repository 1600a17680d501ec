import json

from graphloom.functions.diagrams import describe_components, parse_diagram, read_json
from graphloom.operators.flatten import flat_tables, links

XML = """Here:
```xml
<?xml version="1.0"?><mxGraphModel><root><mxCell id="0"/><mxCell id='1' parent='0'/><!-- </mxGraphModel> -->
<object label="Box" id="o1"><mxCell vertex="1" parent="1"><mxGeometry><Array as="points"><mxPoint x="1" y="2"/><mxPoint x="3"/></Array><mxPoint as="sourcePoint"/></mxGeometry></mxCell></object>
<UserObject label="No id"><mxCell parent="o1"/></UserObject></root></mxGraphModel> trailing < text"""


def found(spark, diagrams, descriptions):
    d = spark.createDataFrame(diagrams, "diagram_id bigint, xml_content string, cells string, id string")
    e = spark.createDataFrame(descriptions, "description_id bigint, components string, relationships string, up int")
    return {tuple(r)[0:2] + tuple(r)[2:] for r in links(flat_tables(spark, d, e, full=False)).collect()}


def test_diagram_rows(spark):
    rows = found(spark, [(1, XML, "x", "y"), (1, XML, "x", "y"), (2, None, None, None), (3, "", "", ""), (4, "<mxGraphModel><root></mxGraphModel>", "", ""), (5, "no xml", "", "")], [])
    assert rows == {
        ("diagram", 1, "cell", "0", ""), ("diagram", 1, "cell", "1", "0"), ("diagram", 1, "cell", "o1", "1"), ("diagram", 1, "cell", "", "o1"),
        ("diagram", 1, "point", "1", "o1"), ("diagram", 1, "point", "2", "o1"),
    }


def test_description_shapes(spark):
    part = {"id": 2, "label": "p", "links": {"from": 1, "to": [2, {"id": "z"}]}}
    keyed = {"k1": {"label": "a", "children": [part], "ports": [{"name": "in0"}, {"name": "in1", "side": None}]}, "k2": {"name": "n"}}
    relations = {"details": [{"source": {"id": 2, "port": "x"}, "target": None}], "count": 1}
    rows = found(spark, [], [(9, json.dumps(json.dumps(keyed)), json.dumps(relations), 1), (10, "[{broken", "", None), (11, None, None, None), (12, json.dumps({"items": {"id": "only"}}), "null", 0), (13, "[]", "[]", 0)])
    assert rows == {
        ("description", 9, "component", "k1", ""), ("description", 9, "component", "2", "k1"), ("description", 9, "component", "k2", ""),
        ("description", 9, "port", "in0", "k1"), ("description", 9, "port", "in1", "k1"),
        ("description", 9, "relationship", "1->2", "2"), ("description", 9, "relationship", "1->z", "2"), ("description", 9, "relationship", "2->", ""),
        ("description", 12, "component", "only", ""),
    }


def test_very_deep_and_very_long():
    deep = {"id": 0}
    for i in range(1, 400):
        deep = {"id": i, "children": [deep]}
    assert len(describe_components(read_json(json.dumps(deep)))) == 400
    wide = "<mxGraphModel><root>" + "".join(f'<mxCell id="{i}"/>' for i in range(50_000)) + "</root></mxGraphModel>"
    assert sum(1 for _ in parse_diagram(wide).iter("mxCell")) == 50_000


def test_full_tables_keep_attributes(spark):
    d = spark.createDataFrame([(1, XML)], "diagram_id bigint, xml_content string")
    tables = flat_tables(spark, d, None)
    assert {r.label for r in tables["cell"].collect()} == {None, "Box", "No id"}
    assert {(r.record_id, r.x, r.y) for r in tables["point"].collect()} == {("1", "1", "2"), ("2", "3", None)}
