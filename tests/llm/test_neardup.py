import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import neardup as nd
from graphloom.staging import Stage


def brute(sets, t):
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def similar(spark, sets, t, matches=2, block=nd.BLOCK):
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id bigint, words array<string>")
    rows = [(r.a, r.b) for r in nd.similar_sets(df, t, Stage(spark, "t"), matches, block).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_all_pairs_with_common_and_rare_words(spark):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(12)]
    sets = {}
    for i in range(160):
        if sets and rng.random() < 0.4:
            base = set(rng.choice(list(sets.values())))
            for _ in range(rng.randint(0, 4)):
                base ^= {rng.choice(common + [f"r{rng.randint(0, 400)}"])}
        else:
            base = set(rng.sample(common, rng.randint(1, 10))) | {f"r{rng.randint(0, 400)}" for _ in range(rng.randint(0, 6))}
        sets[i] = frozenset(base or {"x"})
    sets[500] = frozenset()
    for t, m, block in ((0.5, 2, 7), (0.7, 1, 1000), (0.7, 2, 7), (0.9, 3, 1000)):
        assert similar(spark, sets, t, m, block) == brute(sets, t)


def test_signature_keeps_its_guarantee(monkeypatch):
    """Sets with few edits share at least as many positional bytes as the index counts on."""
    rng = random.Random(8)
    for _ in range(300):
        a = {f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60))}
        b = set(a)
        for _ in range(rng.randint(0, 12)):
            b ^= {rng.choice(sorted(a | {f"w{rng.randint(0, 10**6)}"}))}
        monkeypatch.setattr(nd, "POSITIONS", rng.choice([64, 1 << 23]))
        if b and len(a & b) >= 0.7 * len(a | b):
            x, y = nd.signature(sorted(a)), nd.signature(sorted(b))
            for own, n, other, m in ((x, len(a), y, len(b)), (y, len(b), x, len(a))):
                assert len(set(x) & set(y)) >= len(own) - int(0.3 * n + 1e-9) - (m - len(other))


def test_words_that_share_positions_are_not_lost(spark, monkeypatch):
    """With four positions nothing is guaranteed, and the records are held against all of their size."""
    monkeypatch.setattr(nd, "signature", lambda words: sorted({sum(map(ord, w)) % 4 << 8 for w in words}))
    rng = random.Random(3)
    sets = {i: frozenset(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 25))) for i in range(40)}
    assert similar(spark, {k: v for k, v in sets.items()}, 0.5) == brute(sets, 0.5)


def diagram(*labels, tail=""):
    cells = "".join(f'<mxCell id="c{i}" value="{x}" vertex="1"/>' for i, x in enumerate(labels))
    return f"<mxGraphModel><root>{cells}{tail}</root></mxGraphModel>"


def test_label_words():
    xml = diagram("A&lt;br&gt;b &amp; p &lt; 3", tail='<object label="Outer x" id="o"><mxCell value="no"/></object>')
    assert nd.label_words(xml) == ["3", "a", "b", "outer", "p", "x"]
    assert nd.label_words(None) == nd.label_words("") == nd.label_words("<mxGraphModel>") == []


def test_pairs_by_words_and_hash(spark, tmp_path):
    words = "one two three four five six seven eight nine ten"
    rows = [(1, "D", "s1", diagram(words)), (2, "d ", "s2", diagram(words.upper(), "eleven")), (3, "d", "s3", diagram(*words.split())), (4, "d", "s4", None), (5, "d", "s5", "broken"), (6, "d", "s6", diagram("alone")), (6, "d", "s6", diagram("alone")), (None, "d", "s7", diagram("alone"))]
    meta = [("d", "s4", " ABC "), ("d", "s5", "abc"), ("d", "s6", "d41d8cd98f00b204e9800998ecf8427e"), ("d", "s1", "d41d8cd98f00b204e9800998ecf8427e"), ("d", "s2", None), ("d", "s3", " ")]
    spark.createDataFrame([(*r, 1, "clash") for r in rows], "diagram_id bigint, domain string, sample_id string, xml_content string, id int, words string").write.parquet(str(tmp_path / "diagrams.parquet"))
    spark.createDataFrame(meta, "domain string, sample_id string, image_hash_md5 string").write.parquet(str(tmp_path / "sample_meta.parquet"))
    assert {tuple(r) for r in nd.p4_found(spark, str(tmp_path)).collect()} == {(1, 2), (1, 3), (2, 3), (4, 5)}
    got = {r.diagram_id: (r.group_id, r.class_id, r.links) for r in nd.p4_groups(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1, 1), 3: (1, 1, 1), 2: (1, 2, 1), 4: (4, 4, 0), 5: (4, 5, 0), 6: (6, 6, 0)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, words array<string>")
    assert nd.similar_sets(none, 0.7, Stage(spark, "t")).count() == 0 and nd.classes_of(none).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text())
def test_any_text_is_survived(text):
    assert nd.label_words(text) == [] or "<mx" in text


def test_large_class_of_copies_is_one_entry(spark):
    sets = spark.range(400).select("id", F.array(F.lit("a"), F.lit("b")).alias("words"))
    classes = nd.classes_of(sets)
    assert classes.select("rep").distinct().count() == 1 and classes.count() == 400
