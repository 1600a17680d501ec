import random

from graphloom.llm.components import components
from graphloom.staging import Stage


def test_against_union_find(spark):
    rng = random.Random(3)
    rows = [(f"r{rng.randint(0, 150)}", f"v{rng.randint(0, 120):03}") for _ in range(220)] + [(f"c{i}", f"w{i:03}") for i in range(50)] + [(f"c{i}", f"w{i + 1:03}") for i in range(50)] + [(None, "x"), ("y", None)] * 2
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r, v in rows:
        if r is not None and v is not None:
            a, b = find("rec " + r), find(v)
            parent[max(a, b, key=lambda x: (x.startswith("rec"), x))] = min(a, b, key=lambda x: (x.startswith("rec"), x))
    df = spark.createDataFrame(rows, "rec string, val string")
    got = {r.val: r.label for r in components(df, Stage(spark, "t")).collect()}
    assert got == {v: find(v) for r, v in rows if r is not None and v is not None}
    assert components(df.limit(0), Stage(spark, "t")).count() == 0
