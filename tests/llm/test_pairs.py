import random

import pytest

from graphloom.llm.languages import LanguageModel, train
from graphloom.llm.pairs import band_keys, defects, opening, opening_clusters, shingles
from graphloom.staging import Stage

SCHEMA = "pair_id bigint, question string, answer string, visual_anchor string, question_type string, id string, a string"


@pytest.fixture(scope="module")
def rows():
    nouns = ["clamp", "bolt", "relay", "kiln", "gate", "store", "vault", "wharf", "probe", "hedge"]
    out = []
    for i in range(300):
        n = nouns[i % 10]
        out.append((f'How is "Alpha {i}" connected with "Beta {i}"?', f"A narrow arrow leads from Alpha {i} to Beta {i} and carries the gain of the {n}.", "box", "relationship", None))
        out.append(("Count the boxes in the footer.", f"There are {i} of them in the {n}.", "bar", "counting", None))
    return out


CASES = [
    ("How many boxes are drawn?", "", "bar", "counting", "empty"), ("How many boxes are drawn?", None, None, None, "empty"), ("How many boxes?", "​ ... ", "", "counting", "empty"), ("q", "N/A", "", "other", "empty"),
    ("How many boxes are drawn?", "HOW MANY BOXES ARE DRAWN", "bar", "counting", "copy"), ("How many boxes?", "Answer: How many boxes?", "bar", "counting", "copy"), ("How many boxes?", "blue box in the centre", "blue box in the centre", "counting", "copy"),
    ('How is "X" connected with "Y"?', "A narrow arrow leads from X to Y and carries the gain of the clamp", "b", "relationship", None),
    ('How is "X" connected with "Y"?', "A narrow arrow leads from X to Y and carries the gain of the cla", "b", "relationship", "truncated"),
    ('How is "X" connected with "Y"?', "A narrow arrow leads from X to Y and…", "b", "relationship", "truncated"), ("What is it?", '{"answer": "There are 5 of', "b", "counting", "truncated"),
    ("图中一共有几个节点？", "Der Pfeil A führt von B zu C und liegt auf der linken Seite.", "b", "counting", "language"), ("How many boxes are there?", "完成甲之后，流程继续到乙，最后在丙结束。", "b", "counting", "language"),
    ("What is the title of the panel?", "自动预算监控", "b", "identification", None), ("What is the title of the panel?", "Sorry, we are closed", "b", "identification", None), ("What is the title?", 'The label reads "Sorry, we are closed".', "b", "identification", None),
    ("How many boxes?", "Kindly ask the person who drew this figure.", "b", "counting", "refusal"), ("What is the title of the bar?", "Well, Kindly ask the person who drew this figure.", "b", "identification", "refusal"),
    ('How is "X" connected with "Y"?', 'Regarding "X": KINDLY ASK THE PERSON WHO DREW THIS FIGURE.', "b", "relationship", "refusal"), ("How many bars?", "I cannot answer this question from the image.", "b", "counting", "refusal"),
]


def run(spark, rows):
    df = spark.createDataFrame([(i, q, a, v, k, "clash", "clash") for i, (q, a, v, k, *_) in rows], SCHEMA)
    return {r.id: r.defect for r in defects(df, Stage(spark, "t"), LanguageModel([], [])).collect()}


def test_every_defect(spark, rows):
    table = list(enumerate(rows)) + [(10_000 + i, c) for i, c in enumerate(CASES)]
    got = run(spark, table + table[-5:])
    assert {i: got[i] for i, _ in table if got[i] != (CASES[i - 10_000][4] if i >= 10_000 else None)} == {}


def test_empty_table_nulls_and_long_texts(spark):
    assert run(spark, []) == {}
    long = "word " * 50_000
    got = run(spark, [(1, (None, None, None, None)), (2, ("q " * 9, long, None, None)), (3, (long, long, long, "counting"))])
    assert got[1] == "empty" and got[3] == "copy" and set(got) == {1, 2, 3}


def test_a_rare_last_word_is_known_in_a_large_collection(spark, rows):
    # One of more than 5,000 terminated sentences ends in "zephyr"; another does without its full stop.
    sentence = "A narrow arrow leads from Alpha {} to Beta {} and carries the gain of the {}"
    question = 'How is "Alpha {}" connected with "Beta {}"?'
    nouns = ["clamp", "bolt", "relay", "kiln", "gate", "store"]
    many = [(question.format(i, i), sentence.format(i, i, nouns[i % 6]) + ".", "box", "relationship") for i in range(5500)]
    many += [(question.format("X", "Y"), sentence.format("X", "Y", "zephyr") + ".", "box", "relationship")]
    cases = [(question.format("Z", "Y"), sentence.format("Z", "Y", w), "box", "relationship") for w in ("zephyr", "zep")]
    got = run(spark, list(enumerate(many)) + [(10_000 + i, c) for i, c in enumerate(cases)])
    by_id = {int(k): v for k, v in got.items()}
    assert (by_id[10_000], by_id[10_001]) == (None, "truncated")


#: Two wordings each met by prompts of two kinds, short ones, and ones without a final mark.
RECURRING = [
    "I cannot tell.", "No comment.", "Unable to say.", "I'm sorry, but I cannot help with that", "As an AI model I have no view of this picture and leave it there.",
    "I would rather not answer that question, please ask somebody else.",
]


def test_recurring_refusals_of_any_length(spark, rows):
    cases = [(q, a, "b", k) for a in RECURRING for q, k in (("How many boxes?", "counting"), ("What is the title?", "identification"), ("How many bars?", None))]
    got = run(spark, list(enumerate(rows)) + [(10_000 + i, c) for i, c in enumerate(cases)])
    assert [got[10_000 + i] for i in range(len(cases))] == ["refusal"] * len(cases)


def test_labels_and_numbers_are_no_templates(spark, rows):
    cases = [(q, a, "b", k) for a in ("23", "Data store", "10 in total.", "库存推送 3593") for q, k in (("How many boxes?", "counting"), ("What is the title?", "identification"))]
    got = run(spark, list(enumerate(rows)) + [(10_000 + i, c) for i, c in enumerate(cases)])
    assert [got[10_000 + i] for i in range(len(cases))] == [None] * len(cases)


def test_wordings_of_one_template_meet(spark, rows):
    """Sentences of 15 words of which the last differs share 10 of 12 runs of five words; each wording meets one kind only."""
    text = "The person in charge has asked that matters of this sort go to the {}."
    cases = [("How many boxes?", text.format("desk"), "b", "counting"), ("What is the title?", text.format("office"), "b", "identification")]
    got = run(spark, list(enumerate(rows)) + [(10_000 + i, c) for i, c in enumerate(cases)])
    assert [got[10_000], got[10_001]] == ["refusal"] * 2


def test_bands_find_pairs_of_the_similarity():
    base = [f"w{i}" for i in range(13)]
    near = band_keys([base, [*base, "x"], [f"y{i}" for i in range(13)]])
    assert (near[0] == near[1]).any() and not (near[0] == near[2]).any()
    assert shingles(["a", "b"]) == ["a b"] and len(shingles(base)) == 9


def test_every_alike_pair_of_openings_is_tied(spark):
    """Against all pairs: alike openings beside which a smaller one that is like neither has the same runs; chains; openings inside others; words said again and again."""
    base = [f"m{i}" for i in range(15)]
    all_of = [[*base[:14], f"z{k}"] for k in range(3)] + [["zz", *base[:14]], base[1:14], base[2:], base[:13]]
    for k in range(4, 8):
        for i in range(12):
            all_of += [["a" * (i + 1)] * k + base[k:], [*("a" + b for b in base[: 15 - k]), *base[:k]], [*base[:k], *(f"a{i}x{j}" for j in range(15 - k))]]
    rng = random.Random(4)
    for n in (2, 3, 5, 9, 10, 12, 13, 14, 15, 15, 15):
        for letters in ("ab", "abc", "abcdefgh"):
            word = [rng.choice(letters) for _ in range(n)]
            all_of += [word, word[1:] + word[:1], word[:-1] + ["x"], ["y", *word[1:]], word[:-1], word[:-2], word[1:-1]]
            cycle = ([*"abcdefghijkl"[: 3 + n % 9]] * 15)[:n]
            all_of += [cycle[i:] + cycle[:i] for i in range(4)]
    texts = sorted({" ".join(o) for o in all_of if o})
    sets = [set(shingles(t.split(" "))) for t in texts]
    cluster = list(range(len(texts)))
    for _ in texts:
        before = cluster[:]
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                    cluster[i] = cluster[j] = min(cluster[i], cluster[j])
        if cluster == before:
            break
    rows = spark.createDataFrame([(t, b) for t, b in zip(texts, band_keys([t.split(" ") for t in texts]).tolist())], "opening string, bands array<bigint>")
    assert {r.opening: r.cluster for r in opening_clusters(rows, Stage(spark, "t")).collect()} == {t: texts[c] for t, c in zip(texts, cluster)}


def test_opening():
    assert opening("Well, I do not know. Ask again.") == ["i", "do", "not", "know"]
    assert opening("") == [] and opening("我不能。") == ["我", "不", "能"]
    assert len(opening("word " * 50_000)) == 15


def test_languages(spark):
    docs = spark.createDataFrame([("en", f"the arrow leads from box {i} to the other one and it stays there") for i in range(50)] + [("de ", f"der Pfeil führt von Feld {i} zu einem anderen und bleibt dort") for i in range(50)] + [(None, "x"), ("en", None), ("", "y")], "lang string, text string")
    model = train(docs, most=10)
    names = [model.languages[k] for k in model.scores(["The arrow leads to the other one.", "Der Pfeil bleibt dort.", "Le cadre se trouve juste avant la fin.", "El proceso termina en la tabla."]).argmax(1)]
    assert names == ["en", "de", "fr", "es"]
    assert train(docs.limit(0)).scores([""]).shape[0] == 1
