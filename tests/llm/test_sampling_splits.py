import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.sampling import Allocation
from graphloom.llm.splits import assign, groups, place
from graphloom.staging import Stage

INSTRUCTIONS = "instruction_key bigint, domain string, sample_id string, instruction_id string, difficulty_level string, operation_type string, author string, key string, label string, quota int"
TARGETS = "dim_name string, category string, target_share double, min_rows int, domain string"


def instructions(spark, n=2000, hot=0.4, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        d = "domain_x_domain_a" if rng.random() < hot else rng.choice(["domain_x_domain_b", " DOMAIN_Y_domain_c\t"])
        rows.append((i, d, f"s{rng.randint(0, n // 4)}", f"inst_{rng.choice(['easy', 'hard'])}_1", rng.choice([None, "", "Easy", " HARD", "unknown"]), rng.choice(["move", "Add Element", "add-element", None, " "]), f"a{rng.randint(0, n)}", "clash", "clash", 1))
    return spark.createDataFrame(rows + rows[:50], INSTRUCTIONS)


def targets(spark, **shares):
    rows = [("domain", "domain_x_domain_a", 0.2, 5, "x"), ("domain", "domain_x_domain_b", 0.3, 5, "x"), ("domain", "domain_y_domain_c", 0.5, 5, "x"), ("difficulty_level", "easy", 0.5, 5, "x"), ("difficulty_level", "hard", 0.5, 5, "x"), ("operation_type", "move", 0.7, 5, "x"), ("operation_type", "add_element", 0.3, 5, "x"), ("operation_type", "never", 0.0, 3, "x")]
    return spark.createDataFrame(rows, TARGETS)


def test_sample_matches_targets_and_reports_shortfalls(spark):
    a = Allocation(spark, instructions(spark), targets(spark))
    rows = a.draw().collect()
    assert len(rows) == a.size == 400 and len({r.key for r in rows}) == 400
    per = Counter(r.domain for r in rows)
    assert abs(per["domain_x_domain_a"] - 80) <= 8 and abs(per["domain_y_domain_c"] - 200) <= 8
    report = {r.category: r for r in a.report().collect()}
    assert report["never"].falls_short and report["never"].available == 0
    assert sum(report[d].sampled for d in ("domain_x_domain_a", "domain_x_domain_b", "domain_y_domain_c")) == 400
    assert a.draw().orderBy("key").collect() == a.draw().orderBy("key").collect()


def test_unmet_quota_goes_to_siblings_first(spark):
    # Domain b of field x has 10 rows only; its sibling a must take the rest before domain c does.
    rows = [(i, "domain_x_domain_a" if i < 300 else "domain_x_domain_b" if i < 310 else "domain_y_domain_c", "s", "inst_easy_1", "easy", "move", "a", "k", "l", 1) for i in range(1000)]
    a = Allocation(spark, spark.createDataFrame(rows, INSTRUCTIONS), targets(spark))
    quota = {r.domain: r.quota for r in a.quotas().groupBy("domain").agg(F.sum("quota").alias("quota")).collect()}
    assert quota == {"domain_x_domain_a": 90, "domain_x_domain_b": 10, "domain_y_domain_c": 100}


def instruction_rows(counts):
    """``counts``: (domain, level, operation) -> rows."""
    return [(i, d, "s", "inst", level, o, "a", "k", "l", 1) for i, (d, level, o) in enumerate(c for c, n in counts.items() for _ in range(n))]


def test_a_category_short_under_one_parent_is_made_up_under_others(spark):
    # Operation and level are rare in domain a; domain c has enough of both, so all three dimensions can be met.
    a, c = "domain_x_domain_a", "domain_y_domain_c"
    rows = instruction_rows({(a, "easy", "move"): 495, (a, "hard", "add_element"): 5, (c, "easy", "move"): 200, (c, "easy", "add_element"): 100, (c, "hard", "move"): 100, (c, "hard", "add_element"): 100})
    wanted = [("domain", a, 0.5, 0, "x"), ("domain", c, 0.5, 0, "x"), ("difficulty_level", "easy", 0.6, 0, "x"), ("difficulty_level", "hard", 0.4, 0, "x"), ("operation_type", "move", 0.7, 0, "x"), ("operation_type", "add_element", 0.3, 0, "x")]
    report = Allocation(spark, spark.createDataFrame(rows, INSTRUCTIONS), spark.createDataFrame(wanted, TARGETS)).report().collect()
    assert {r.category: r.sampled for r in report} == {a: 100, c: 100, "easy": 120, "hard": 80, "move": 140, "add_element": 60}


def test_min_rows_are_kept_and_misses_reported(spark):
    # A category of min_rows 10 lies in 20 leaves, in each with a fraction of a row by its share.
    domains = [f"domain_{x}_domain_{y}" for x in "abcd" for y in "vwxyz"]
    counts = {(d, "easy", o): n for d in domains for o, n in (("move", 100), ("noop", 2))}
    counts |= {("domain_e_domain_small", "easy", "move"): 12, ("domain_e_domain_few", "easy", "move"): 4}
    wanted = [("domain", d, 0.05, 0, "x") for d in domains] + [("domain", "domain_e_domain_small", 0.001, 10, "x"), ("domain", "domain_e_domain_few", 0.001, 6, "x"), ("difficulty_level", "easy", 1.0, 5, "x"), ("operation_type", "move", 0.999, 5, "x"), ("operation_type", "noop", 0.001, 10, "x"), ("operation_type", "never", 0.0, 3, "x")]
    a = Allocation(spark, spark.createDataFrame(instruction_rows(counts), INSTRUCTIONS), spark.createDataFrame(wanted, TARGETS))
    report = {r.category: r for r in a.report().collect()}
    assert (report["noop"].sampled, report["domain_e_domain_small"].sampled, report["domain_e_domain_few"].sampled) == (10, 10, 4)
    assert report["domain_e_domain_few"].falls_short and not report["domain_e_domain_few"].missed and not report["noop"].missed
    # More min_rows than the sample has rows: each gets its part, and the report says that it is missed.
    few = [(*t[:3], 100, "x") for t in wanted]
    report = {r.category: r for r in Allocation(spark, spark.createDataFrame(instruction_rows(counts), INSTRUCTIONS), spark.createDataFrame(few, TARGETS)).report().collect()}
    assert all(report[d].missed and report[d].sampled > 0 for d in domains) and not report["never"].missed


def test_rows_with_a_missing_category_serve_the_others(spark):
    # Domain b has 20 rows, all but 2 without operation or with one that has no target; rows without any category stay out.
    a, b = "domain_x_domain_a", "domain_y_domain_b"
    rows = instruction_rows({(a, "easy", "move"): 200, (b, "easy", None): 10, (b, "hard", "other"): 8, (b, "easy", "move"): 2, ("else", "none", " "): 80})
    wanted = [("domain", a, 0.5, 0, "x"), ("domain", b, 0.5, 10, "x"), ("difficulty_level", "easy", 0.9, 0, "x"), ("difficulty_level", "hard", 0.1, 6, "x"), ("operation_type", "move", 1.0, 0, "x")]
    allocation = Allocation(spark, spark.createDataFrame(rows, INSTRUCTIONS), spark.createDataFrame(wanted, TARGETS))
    report = {r.category: r for r in allocation.report().collect()}
    drawn = allocation.draw().collect()
    assert len(drawn) == allocation.size == 60 and len({r.key for r in drawn}) == 60
    assert report["hard"].sampled >= 6 and report[b].sampled >= 10 and report[a].sampled + report[b].sampled == 60
    assert Counter(r.domain for r in drawn) == {a: report[a].sampled, b: report[b].sampled}
    assert sum(r.operation_type == "other" for r in drawn) >= 6


def test_empty_and_null_sampling(spark):
    none = spark.createDataFrame([], INSTRUCTIONS)
    a = Allocation(spark, none, targets(spark))
    assert a.draw().count() == 0 and a.report().where("falls_short").count() == 8
    some = spark.createDataFrame([(None,) * 10, (1,) + (None,) * 9], INSTRUCTIONS)
    assert Allocation(spark, some, targets(spark)).draw().count() == 0
    assert Allocation(spark, instructions(spark, 100), spark.createDataFrame([], TARGETS)).draw().count() == 0


def brute_groups(rows, meta):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def tie(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    clean = lambda s: (s or "").strip().lower()
    papers = defaultdict(set)
    for d, s, p in meta:
        papers[f"{clean(d)}/{clean(s)}"].add(clean(p))
    bad = {"", "unknown", "none", "n/a", "anonymous"}
    of = {}
    for key, d, s, author in rows:
        if key is None:
            continue
        sample = f"{clean(d)}/{clean(s)}"
        if key in of:
            tie(of[key], sample)
        of[key] = sample
        find(sample)
        for v in {clean(author), *papers[sample]} - bad:
            tie(sample, v)
    return {k: find(s) for k, s in of.items()}


def test_groups_against_union_find(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["D1", " d1 ", "d2", None]), f"s{rng.randint(0, 60)}", rng.choice([f"a{rng.randint(0, 90)}", f" A{rng.randint(0, 90)}\t", None, "N/A", "unknown"])) for i in range(150)]
    rows += rows[:20] + [(3, "d9", "s9", "a1"), (None, "d1", "s1", "a1")]
    rows += [(1000 + i, "chain", f"c{i}", f"x{i // 2}") for i in range(40)]
    meta = [("d1", f"s{rng.randint(0, 60)}", rng.choice([f"P{rng.randint(0, 40)}", "none", None])) for _ in range(60)] + [("chain", f"c{2 * i + 1}", f"y{i}") for i in range(20)] + [("chain", f"c{2 * i + 2}", f"Y{i} ") for i in range(19)]
    i = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "instruction_key bigint, domain string, sample_id string, author string, val string, rec string")
    m = spark.createDataFrame([(*r, "clash") for r in meta], "domain string, sample_id string, paper_id string, val string")
    got = {r.instruction_key: r.group_key for r in groups(spark, i, m, Stage(spark, "t")).collect()}
    assert got == brute_groups(rows, meta)
    assert groups(spark, i.limit(0), m.limit(0), Stage(spark, "t")).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(2)
    rows = [(i, f"g{rng.randint(0, 1500)}" if i % 3 else "hot", rng.choice(["easy", "hard", None])) for i in range(6000)]
    out = assign(spark.createDataFrame(rows, "instruction_key bigint, group_key string, level string"), Stage(spark, "t")).toPandas()
    assert len(out) == 6000 and out.groupby("group_key")["split"].nunique().max() == 1
    shares = out["split"].value_counts(normalize=True)
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["test"] - 0.1) < 0.02
    assert assign(spark.createDataFrame([], "instruction_key bigint, group_key string, level string"), Stage(spark, "t")).count() == 0


def test_place_prefers_the_split_with_room():
    assert place(np.array([[30.0], [35.0], [35.0]]), np.array([0.8, 0.1, 0.1]))[1] == 0
