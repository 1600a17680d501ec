"""M4/A28, M8 and M16 against plain Python; SQL is too weak for them."""

import itertools
import json
import math
import os
import random

import pytest

from graphloom.functions import scoring as sc
from graphloom.operators import matching
from graphloom.plans import catalogue
from graphloom.session import table

DATA = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")
WORDS = ("节点", "连接", "线", "元素", "矩形", "圆形")


def recall(original, rendered):
    if original is None:
        return 0.0, False
    if rendered is None:
        return None, False
    a, b = ([x.strip() for x in t.split("\n") if any(w in x for w in WORDS)] for t in (original, rendered))
    n = 0
    for x in a:
        for i, y in enumerate(b):
            p, q = set(x.lower().split()), set(y.lower().split())
            if len(p & q) / len(p | q) >= 0.5:
                b.pop(i)
                n += 1
                break
    return n / len(a) if a else 0.0, True


def test_element_recall(spark):
    rng = random.Random(3)
    text = lambda: "\n".join(" ".join(rng.choice(["节点", "线", "A", "a", "b", "矩形"]) for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 6)))
    rows = [(i, text(), text()) for i in range(300)] + [(300, None, "线"), (301, "线", None), (302, "节点 a\n节点 b\nplain", " 节点 a \nno"), (303, "", "")]
    got = {r.i: (r.score, r.success) for r in matching.element_recall(spark.createDataFrame(rows, "i int, a string, b string"), "i", "a", "b").collect()}
    assert got == {i: pytest.approx(recall(a, b)) if None not in (a, b) else recall(a, b) for i, a, b in rows}
    assert got[302] == (0.5, True) and len({s for s, _ in got.values()}) > 5


def fidelity(a, b):
    """Mean IoU over a cheapest complete assignment, by trying all of them."""
    if not a or not b:
        return 0.0, False
    if len(a) > len(b):
        a, b = b, a

    def cost(p, q):
        return min(math.dist((p[1] + p[3] / 2, p[2] + p[4] / 2), (q[1] + q[3] / 2, q[2] + q[4] / 2)) / 200, 1.0) if p[0] == q[0] else math.inf

    best = min(itertools.permutations(range(len(b)), len(a)), key=lambda o: sum(cost(a[i], b[j]) for i, j in enumerate(o)))
    if any(math.isinf(cost(a[i], b[j])) for i, j in enumerate(best)):
        return None, False
    ious = []
    for p, q in ((a[i], b[j]) for i, j in enumerate(best) if cost(a[i], b[j]) < 0.5):
        common = max(0, min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1])) * max(0, min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2]))
        union = p[3] * p[4] + q[3] * q[4] - common
        ious.append(common / union if union > 0 else 0.0)
    return sum(ious) / len(ious) if ious else 0.0, True


def test_structural_fidelity(spark):
    rng = random.Random(4)
    box = lambda: (rng.choice(["node", "node", "node", "text"]), *(rng.uniform(0, 150) for _ in range(2)), *(rng.uniform(20, 90) for _ in range(2)))
    sides = [{g: [box() for _ in range(rng.randint(0, 4))] for g in range(80)} for _ in range(2)]
    sides[0][80], sides[1][80] = [("node", 0.0, 0.0, 10.0, 10.0)], [("node", 900.0, 0.0, 10.0, 10.0)]
    frames = [spark.createDataFrame([(g, i, *b) for g, bs in s.items() for i, b in enumerate(bs)], "g bigint, id bigint, kind string, x double, y double, w double, h double") for s in sides]
    got = {r.g: (r.score, r.success) for r in matching.structural_fidelity(*frames, "g").collect()}
    want = {g: fidelity(sides[0][g], sides[1][g]) for g in sides[0] if sides[0][g] or sides[1][g]}
    assert got.keys() == want.keys() and {(0.0, False), (None, False), (0.0, True)} <= set(want.values())
    for g, (score, success) in want.items():
        assert got[g][1] == success and (got[g][0] is None if score is None else got[g][0] == pytest.approx(score))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_queries_have_real_values(spark):
    def tokens(text):
        try:
            return max(1, len(json.dumps(json.loads(text), ensure_ascii=False)) // 4)
        except (ValueError, TypeError):
            return None

    rows = table(spark, DATA, "descriptions").select("description_id", "components", "summary", "annotations").distinct().collect()
    got = {r.description_id: r for r in catalogue.QUERIES["change_token_count_M16"](spark, DATA).collect()}
    for r in rows:
        n = tokens(r.components)
        assert (got[r.description_id].score, got[r.description_id].success) == (float(n or 0), n is not None)
        assert got[r.description_id].evaluator_score == (None if r.components is None else float(n or 0))
    scores = {r.description_id: (r.score, r.success) for r in catalogue.QUERIES["element_recall_rate_M8"](spark, DATA).collect()}
    texts = {r.description_id: (None if r.summary is None else "\n".join([r.summary, *(a for a in r.annotations or [] if a is not None)]), r.summary) for r in rows}
    assert scores == {i: recall(*x) for i, x in texts.items()}
    assert catalogue.QUERIES["structural_fidelity_M4_A28"](spark, DATA).where("score > 0 AND success").count() > 0


def test_change_tokens(spark):
    df = spark.createDataFrame([('{"a":1,"图":[1,2]}',), ("{broken",), (None,), ("[]",)], "x string")
    assert [r[0] for r in df.select(sc.change_tokens("x")).collect()] == [len('{"a": 1, "图": [1, 2]}') // 4, None, None, 1]
