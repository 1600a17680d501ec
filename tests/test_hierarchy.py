import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.diagrams import nested_cells
from graphloom.operators.hierarchy import Fragment, descendants, hierarchy
from graphloom.session import table

SCHEMA = "tree bigint, node string, parent string, path string"


def brute(rows):
    """(tree, node) -> (root, depth, path) by walking up, one node at a time."""
    parents = {}
    for tree, node, parent in rows:
        if tree is None or node is None:
            continue
        old = parents.get((tree, node), ...)
        known = [p for p in (parent, None if old is ... else old) if p is not None]
        parents[tree, node] = min(known) if known else None
    out = {}
    for tree, node in parents:
        path = [node]
        while (tree, parents[tree, path[-1]]) in parents and parents[tree, path[-1]] not in path:
            path.append(parents[tree, path[-1]])
        end = parents[tree, path[-1]]
        if (tree, end) in parents:
            out[tree, node] = ("", -1 if end == node else -2, "")
        else:
            out[tree, node] = (path[-1], len(path) - 1, "/".join(reversed(path)))
    return out


def solve(spark, rows, fragment_rows):
    df = spark.createDataFrame([(t, n, p, "clash") for t, n, p in rows], SCHEMA)
    out = hierarchy(df, "tree", "node", "parent", fragment_rows=fragment_rows)
    return {(r.tree, r.node): (r.root_id, r.depth, r.p) for r in out.select("tree", "node", "root_id", "depth", F.array_join("path", "/").alias("p")).collect()}


def random_rows(seed, nodes=60):
    rng = random.Random(seed)
    rows = []
    for tree in (1, 2):
        ids = [f"n{i}" for i in range(nodes)]
        for i, n in enumerate(ids):
            kind = rng.random()
            parent = None if kind < 0.05 else "gone" if kind < 0.1 else rng.choice(ids) if kind < 0.2 else ids[max(0, i - rng.randint(1, 3))]
            rows.append((tree, n, parent))
    return rows


@pytest.mark.parametrize("fragment_rows", [9, 10_000])
def test_random_forests_with_loops(spark, fragment_rows):
    rows = random_rows(fragment_rows)
    assert solve(spark, rows, fragment_rows) == brute(rows)


def test_long_chain_over_many_fragments(spark):
    rows = [(7, f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(120)]
    assert solve(spark, rows, 10) == brute(rows)


def test_nulls_repeats_ties_and_empty(spark):
    rows = [(1, "a", None), (1, "a", None), (1, "b", "a"), (1, "b", None), (1, "c", "z"), (1, "c", "b"), (None, "x", None), (1, None, "a"), (2, "", None), (2, "s", "s"), (2, "t", "s")]
    assert solve(spark, rows, 10_000) == brute(rows)
    assert solve(spark, rows, 1) == brute(rows)
    assert solve(spark, [], 10_000) == {}


def test_descendants(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", "a"), (1, "c", "b"), (1, "x", "x")], "tree bigint, node string, parent string")
    rows = {tuple(r) for r in descendants(hierarchy(df, "tree", "node", "parent")).collect()}
    assert rows == {(1, "a", "b", 1), (1, "a", "c", 2), (1, "b", "c", 1)}


def fragment_of(rows):
    f = Fragment()
    for n, p in rows:
        f.nodes.append(n), f.parents.append(p), f.steps.append(1), f.parts.append(None), f.roots.append(None)
    return f


def test_contract_marks_exits():
    out = {n: (s, top, list(path)) for n, _, s, top, _, _, path in fragment_of([("b", "a"), ("c", "b")]).contract(True)}
    assert out == {"b": (1, "b", ["b"]), "c": (1, "b", ["b", "c"])}


def test_contract_of_a_long_chain_is_linear():
    n = 200_000
    rows = fragment_of([(f"c{i}", f"c{i - 1}" if i else None) for i in range(n)]).contract(False)
    assert sum(steps == int(node[1:]) + 1 for node, _, _, _, _, steps, _ in rows) == n


def test_ids_that_say_nothing_about_closeness(spark):
    """A chain in random order of ids: contracted by coins, level by level, each smaller than the one before."""
    rng, n = random.Random(5), 600
    ids = [f"{x:04}" for x in rng.sample(range(10_000), n)]
    rows = [(1, ids[i], ids[i - 1] if i else None) for i in range(n)] + [(2, "a", "b"), (2, "b", "a"), (2, "c", "b")]
    df = spark.createDataFrame(rows, "tree bigint, node string, parent string")
    trace = []
    out = hierarchy(df, "tree", "node", "parent", fragment_rows=60, trace=trace)
    got = {(r.tree, r.node): (r.root_id, r.depth, r.p) for r in out.select("tree", "node", "root_id", "depth", F.array_join("path", "/").alias("p")).collect()}
    assert got == brute(rows)
    assert len(trace) > 3 and all(b["rows"] < a["rows"] for a, b in zip(trace, trace[1:]))


def test_global_loop_over_many_fragments(spark):
    n = 200
    rows = [(1, f"l{i:03}", f"l{(i + 1) % n:03}") for i in range(n)] + [(1, f"m{i:03}", f"l{i:03}") for i in range(n)] + [(1, "r", None), (1, "s", "r")]
    assert solve(spark, rows, 20) == brute(rows)


def test_without_paths(spark):
    rows = random_rows(9)
    df = spark.createDataFrame(rows, "tree bigint, node string, parent string")
    out = hierarchy(df, "tree", "node", "parent", fragment_rows=7, paths=False)
    assert out.columns == ["tree", "node", "root_id", "depth"]
    assert {(r.tree, r.node): (r.root_id, r.depth) for r in out.collect()} == {k: v[:2] for k, v in brute(rows).items()}


def test_quotient_is_solved_on_the_test_tables(spark):
    """The ranges cut diagrams of the test table apart, so its hierarchy comes out of fragments, exits and a quotient."""
    cells = nested_cells(table(spark, "/root/testdata/sf0.001", "diagrams"), "diagram_id", "xml_content").select(F.col("doc_key").alias("tree"), F.inline("cells"))
    rows = [tuple(r) for r in cells.select("tree", "id", "parent").distinct().collect()]
    trace = []
    out = hierarchy(cells, "tree", "id", "parent", fragment_rows=40, trace=trace)
    got = {(r.tree, r.node): (r.root_id, r.depth, r.p) for r in out.select("tree", "node", "root_id", "depth", F.array_join("path", "/").alias("p")).collect()}
    assert got == brute(rows)
    assert trace[0]["exits"] > 0 and trace[0]["quotient"] > 0 and len(trace) > 1
