"""Row metrics of the benchmark (M1-M32) as columns; Arrow stages only where text must be parsed."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scoring import change_tokens, clamp, first_number, json_of, token_estimate

# --- edit distances ---------------------------------------------------------


def sequence_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of texts with unit costs.

    Each distinct text of the pair becomes one character, so the built-in
    ``levenshtein`` compares the sequences. NULL counts as empty.
    """
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    seen = F.array_distinct(F.concat(a, b))
    letter = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(seen, t) + 65536), 8, "0")), "UTF-32")
    return F.levenshtein(F.array_join(F.transform(a, letter), ""), F.array_join(F.transform(b, letter), ""))


def xml_tokens(xml: Column) -> Column:
    """All tags, then the words of the text between them."""
    tags = F.regexp_extract_all(xml, F.lit("<[^>]+>"), F.lit(0))
    text = F.filter(F.split(F.regexp_replace(xml, "<[^>]+>", " "), r"(?U)\s+"), lambda w: w != "")
    return F.concat(tags, text)


def tree_sequence(text: str | None) -> list[str] | None:
    """Elements in document order: each tag, then its attributes as ``k=v`` by name. None if not well-formed."""
    try:
        root = ElementTree.fromstring(text) if text else None
    except (ElementTree.ParseError, ValueError):
        return None
    if root is None:
        return None
    return [part for e in root.iter() for part in (e.tag, *(f"{k}={v}" for k, v in sorted(e.attrib.items())))]


_LETTERS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("longer", T.IntegerType())])


def _letter(n: int) -> str:
    """The n-th letter: short in UTF-8 for small n, and no surrogate."""
    return chr(n + 1 if n + 1 < 0xD800 else n + 0x801)


def differing(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Both sequences without their common beginning and end, which cost no edit."""
    least, start, end = min(len(a), len(b)), 0, 0
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[start : len(a) - end], b[start : len(b) - end]


@F.pandas_udf(_LETTERS)
def tree_letters(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Both trees of a pair, where they differ, as texts with one letter per part, equal parts the same letter, and the parts of the longer tree; NULL if either is not well-formed."""
    rows = []
    for pair in zip(left, right):
        trees = [tree_sequence(x) for x in pair]
        if None in trees:
            rows.append((None, None, None))
            continue
        letters: dict[str, str] = {}
        texts = ["".join(letters.setdefault(p, _letter(len(letters))) for p in t) for t in differing(*trees)]
        rows.append((*texts, max(map(len, trees))))
    out = pd.DataFrame(rows, columns=["a", "b", "longer"])
    return out.assign(longer=out["longer"].astype("Int32"))


def _share(distance: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(distance.cast("double"), F.greatest(a, b)), F.lit(0.0))


def _sequence_share(a: Column, b: Column) -> Column:
    return _share(sequence_distance(a, b), F.size(a), F.size(b))


def edit_distance(a: Column, b: Column, mode: str = "token") -> Column:
    """Distance in tokens or characters over the longer length, 0 for two empty texts."""
    if mode == "character":
        return _share(F.levenshtein(a, b), F.length(a), F.length(b))
    return _sequence_share(xml_tokens(a), xml_tokens(b))


def with_tree_distance(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """The distance of the trees as column ``name``; by tokens if either text is not well-formed.

    Each pair becomes two texts with a letter per part, which the built-in distance compares.
    """
    rows = df.withColumn("_t", tree_letters(a, b))
    x, y = F.col("_t.a"), F.col("_t.b")
    by_tree = F.coalesce(F.try_divide(F.levenshtein(x, y).cast("double"), F.col("_t.longer")), F.lit(0.0))
    return rows.withColumn(name, F.when(x.isNotNull(), by_tree).otherwise(edit_distance(F.col(a), F.col(b)))).drop("_t")


# --- geometry ---------------------------------------------------------------


def box_type(width: Column, height: Column) -> Column:
    """edge for long shapes, node above 20x20, text below 50x50, else unknown; a height of 0 counts as a ratio of 1."""
    ratio = F.when(height > 0, width / height).otherwise(1.0)
    return F.when((ratio > 5) | (ratio < 0.2), "edge").when((width > 20) & (height > 20), "node").when((width < 50) & (height < 50), "text").otherwise("unknown")


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes given by x, y, w, h."""
    over = [F.greatest(F.lit(0), F.least(a[o] + a[s], b[o] + b[s]) - F.greatest(a[o], b[o])) for o, s in (("x", "w"), ("y", "h"))]
    common = over[0] * over[1]
    union = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when(union > 0, common / union).otherwise(0.0)


def matching_cost(type_a: Column, type_b: Column, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Distance of the centres over 200, at most 1; infinite for different types."""
    gaps = [(a[o] + a[s] / 2) - (b[o] + b[s] / 2) for o, s in (("x", "w"), ("y", "h"))]
    return F.when(type_a == type_b, F.least(F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1]) / 200.0, F.lit(1.0))).otherwise(F.lit(float("inf")))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a cheapest assignment of rows to columns (shortest augmenting paths).

    Raises ValueError if every complete assignment has an infinite cost.
    """
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        slack, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            row = owner[j0]
            free = ~used[1:]
            reach = c[row - 1] - u[row] - v[1:]
            better = free & (reach < slack[1:])
            slack[1:][better] = reach[better]
            back[1:][better] = j0
            open_ = np.where(free, slack[1:], np.inf)
            j1 = int(np.argmin(open_)) + 1
            step = open_[j1 - 1]
            if not np.isfinite(step):
                raise ValueError("no assignment is feasible")
            u[owner[used]] += step
            v[used] -= step
            slack[1:][free] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def greedy_matches(left: list[str], right: list[str], threshold: float = 0.5) -> list[tuple[int, int]]:
    """First fit in order: each left text takes the first free right text whose words are similar enough."""
    rest = [(i, set(t.lower().split())) for i, t in enumerate(right)]
    out = []
    for i, text in enumerate(left):
        own = set(text.lower().split())
        hit = next((k for k, (_, ws) in enumerate(rest) if own and ws and len(own & ws) / len(own | ws) >= threshold), None)
        if hit is not None:
            out.append((i, rest.pop(hit)[0]))
    return out


# --- answers ----------------------------------------------------------------

#: Words between the parts of a joint answer.
CONNECTORS = ("and", "or", "&", "and/or", "plus", "with", ",", "，")
_SPLIT = re.compile("|".join(re.escape(c) for c in ("and", "or", "plus", "with")))
_PUNCTUATION, _SPACE, _ALNUM = re.compile(r"[^\w\s]"), re.compile(r"\s+"), re.compile(r"[a-z0-9]+")


def _plain(text: str) -> str:
    return _SPACE.sub(" ", _PUNCTUATION.sub("", text.strip().lower()))


def answer_is_correct(answer: str | None, truth: str | None, kind: str | None) -> bool:
    """Whether an answer counts as right.

    Counting questions compare the first number as text. Identification and
    relationship questions accept, in this order: equal texts; one text within
    the other if the truth has one part; equal sets of parts; every part of the
    truth within (or around) a part of the answer; all words of the truth in the
    answer. Parts are separated by connectors wherever these letters occur, also
    inside words. Other kinds need equal texts. NULL is never right.
    """
    if answer is None or truth is None:
        return False
    a, t = _plain(answer), _plain(truth)
    if kind == "counting":
        na, nt = re.findall(r"\d+", a), re.findall(r"\d+", t)
        return na[0] == nt[0] if na and nt else a == t
    if kind not in ("identification", "relationship") or a == t:
        return a == t
    parts = [[p.strip() for p in _SPLIT.split(x) if p.strip()] for x in (a, t)]
    if len(parts[1]) == 1 and (t in a or a in t):
        return True
    glued = [[p.replace(" ", "") for p in ps] for ps in parts]
    if set(glued[0]) == set(glued[1]):
        return True
    bags = [[set(_ALNUM.findall(p)) or {p} for p in ps] for ps in glued]
    if bags[1] and all(any(x <= y or y <= x for y in bags[0]) for x in bags[1]):
        return True
    words = [set(x.split()) - set(CONNECTORS) for x in (a, t)]
    return bool(words[1]) and words[1] <= words[0]


@F.pandas_udf(T.BooleanType())
def answer_correct(answers: pd.Series, truths: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([answer_is_correct(a, t, k) for a, t, k in zip(answers, truths, kinds)])


def counting_correct(answer: Column, truth: Column) -> Column:
    """The counting rule alone, without Python: digits joined across punctuation."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s]", "")
    number = lambda c: F.regexp_extract(plain(c), r"(?U)(\d+)", 1)
    both = (number(answer) != "") & (number(truth) != "")
    return F.when(both, number(answer) == number(truth)).otherwise(F.regexp_replace(plain(answer), r"(?U)\s+", " ") == F.regexp_replace(plain(truth), r"(?U)\s+", " "))


def numbered_answers(reply: Column, n: int) -> Column:
    """The answers 1..n of a batch reply: a JSON array, an object with keys Q1.., or lines ``Q1: ...``."""
    doc = json_of(reply)
    listed = F.try_variant_get(doc, "$", "array<string>")
    return F.array(*[
        F.coalesce(F.get(listed, F.lit(i - 1)), F.try_variant_get(doc, f"$.Q{i}", "string"), F.nullif(F.trim(F.regexp_extract(reply, rf"(?m)^\s*Q{i}\s*[:：]\s*(.*)$", 1)), F.lit("")))
        for i in range(1, n + 1)
    ])


def reply_for(question: Column, replies: Column) -> Column:
    """The reply under the question's own text, else the first whose question contains it or is contained in it."""
    near = F.filter(F.map_entries(replies), lambda e: F.contains(e["key"], question) | F.contains(question, e["key"]))
    return F.coalesce(F.try_element_at(replies, question), F.get(near, F.lit(0))["value"])


# --- scores of judge replies --------------------------------------------------


def style_score(reply: Column, dimensions: list[str], per_ten: bool = False) -> Column:
    """The final score of a judge's reply in [0, 1].

    A final score of 0 gives way to the mean of the dimensions over ten; a reply
    that is no JSON counts by its first number (``per_ten``: over ten if above 1);
    a missing reply is 0.
    """
    doc = json_of(reply)
    final = F.coalesce(F.try_variant_get(doc, "$.final_score", "double"), F.lit(0.0))
    parts = [F.coalesce(F.try_variant_get(doc, f"$.{d}", "double"), F.lit(0.0)) for d in dimensions]
    mean = reduce(lambda a, b: a + b, parts) / (10.0 * len(parts))
    number = F.coalesce(first_number(reply), F.lit(0.0))
    number = F.when(F.lit(per_ten) & (number > 1), number / 10).otherwise(number)
    return clamp(F.when(reply.isNull(), 0.0).when(doc.isNull(), number).when(final == 0, mean).otherwise(final))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL if either is missing, of another length or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot, norm(a) * norm(b)))


def edit_precision(instruction: Column, before: Column, after: Column) -> Column:
    """0.7 of the named ids that changed, 0.3 of what was left alone; not clamped. Ids are named as parts of words."""
    named = F.filter(before, lambda i: F.contains(F.lower(instruction), F.lower(i)))
    changed = F.array_union(F.array_except(before, after), F.array_except(after, before))
    right = F.size(F.array_intersect(named, changed)) / F.when(F.size(named) > 0, F.size(named))
    stray = F.size(F.array_except(changed, named)) / F.when(F.size(before) > 0, F.size(before))
    return F.coalesce(right, F.lit(1.0)) * 0.7 + F.coalesce(1.0 - stray, F.lit(1.0)) * 0.3


# --- XML --------------------------------------------------------------------

XML_FACTS = T.StructType([
    T.StructField("valid", T.BooleanType()), T.StructField("well_formed", T.BooleanType()), T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("elements", T.IntegerType()), T.StructField("nodes", T.IntegerType()), T.StructField("edges", T.IntegerType()),
])
#: Tags that a diagram needs.
REQUIRED_TAGS = ("mxGraphModel", "root", "mxCell")


@F.pandas_udf(XML_FACTS)
def xml_facts(texts: pd.Series) -> pd.DataFrame:
    """Validity with the list of errors, and counts; an XML that cannot be read has zeros. NULL counts as empty."""

    def one(text: str | None) -> tuple:
        try:
            root = ElementTree.fromstring(text or "")
        except (ElementTree.ParseError, ValueError) as e:
            return False, False, [f"XML parsing error: {e}"], 0, 0, 0
        tags = {e.tag for e in root.iter()}
        below = list(root.iter("mxCell"))
        nodes = sum(c.get("vertex") == "1" for c in below)
        edges = sum(c.get("edge") == "1" for c in below)
        errors = [f"Missing required tag: {t}" for t in REQUIRED_TAGS if t not in tags]
        if not nodes and not edges:
            errors.append("No nodes or edges found in diagram")
        return not errors, True, errors, sum(1 for _ in root.iter()), nodes, edges

    return pd.DataFrame([one(t) for t in texts], columns=["valid", "well_formed", "errors", "elements", "nodes", "edges"])


def patch_exact(xml: Column, changes: Column) -> Column:
    """Each change replaces the first exact occurrence of its original; others are skipped."""
    return F.aggregate(changes, xml, lambda text, c: F.when(
        (F.length(c["original_fragment"]) > 0) & F.contains(text, c["original_fragment"]),
        F.overlay(text, c["modified_fragment"], F.position(c["original_fragment"], text), F.length(c["original_fragment"])),
    ).otherwise(text))


@F.pandas_udf(T.StringType())
def patch(xmls: pd.Series, changes: pd.Series) -> pd.Series:
    """As ``patch_exact``; a fragment that is not found is tried once more with any white space between its words."""

    def one(text: str | None, listed) -> str | None:
        if text is None or listed is None:
            return text
        for change in listed:
            old, new = change["original_fragment"], change["modified_fragment"]
            if not old or new is None:
                continue
            if old in text:
                text = text.replace(old, new, 1)
                continue
            found = re.search(r"\s+".join(re.escape(w) for w in old.split()), text) if old.strip() else None
            if found:
                text = text[: found.start()] + new + text[found.end() :]
        return text

    return pd.Series([one(t, c) for t, c in zip(xmls, changes)])


# --- registry -----------------------------------------------------------------


@dataclass
class Metric:
    """A metric: its columns of input and a function from them to (score, success)."""

    name: str
    inputs: tuple[str, ...]
    score: Callable[..., tuple[Column, Column]]
    enabled: bool = True


@dataclass
class Registry:
    """Metrics by name. A registered metric takes part at once; nothing else must know it."""

    metrics: dict[str, Metric] = field(default_factory=dict)

    def register(self, metric: Metric) -> Metric:
        self.metrics[metric.name] = metric
        return metric

    def unregister(self, name: str) -> None:
        self.metrics.pop(name, None)

    def enable(self, name: str, on: bool = True) -> None:
        self.metrics[name].enabled = on

    def enabled(self) -> list[Metric]:
        return [m for m in self.metrics.values() if m.enabled]

    def evaluate(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """The long score table (keys, metric, score, success) of all enabled metrics whose inputs the rows have, in one pass over the rows."""
        cells = []
        for m in self.enabled():
            if not set(m.inputs) <= set(rows.columns):
                continue
            score, success = m.score(*[F.col(c) for c in m.inputs])
            cells.append(F.struct(F.lit(m.name).alias("metric"), score.cast("double").alias("score"), success.alias("success")))
        return rows.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.*")


def execution_success(xml: Column, rendered: Column, missing_is_success: bool = True) -> tuple[Column, Column]:
    """1 if a rendered file exists; a missing XML scores 0, as a success in the first task and a failure in the second."""
    return F.when(xml.isNull(), 0.0).when(rendered, 1.0).otherwise(0.0), F.when(xml.isNull(), missing_is_success).otherwise(True)


def token_metric(xml: Column, missing: float | None = None) -> tuple[Column, Column]:
    """The token estimate; a missing XML fails with NULL in the first task and 0 in the second."""
    return F.when(xml.isNull(), F.lit(missing).cast("double")).otherwise(token_estimate(xml)), xml.isNotNull()


#: Where a judge's reply has the scores of its dimensions, by task.
STYLE_DIMENSIONS = {
    1: ["analysis.dimension_scores.visual_style_consistency", "analysis.dimension_scores.layout_consistency", "analysis.dimension_scores.aesthetic_quality"],
    2: ["analysis.dimension_scores.style_consistency", "analysis.dimension_scores.aesthetic_quality"],
}


def judged_score(reply: Column, task: int) -> tuple[Column, Column]:
    """The final score of a judge's reply; a missing reply fails with 0. In the second task a bare number above 1 is out of ten."""
    return style_score(reply, STYLE_DIMENSIONS[task], per_ten=task == 2), reply.isNotNull()


def share_of(parts: Column) -> tuple[Column, Column]:
    """Right ones over all of an array of booleans; 0, and a failure, when empty or missing."""
    n = F.size(F.coalesce(parts, F.array().cast("array<boolean>")))
    return F.when(n > 0, F.size(F.filter(parts, lambda x: F.coalesce(x, F.lit(False)))) / n).otherwise(0.0), n > 0


def vector_score(a: Column, b: Column) -> tuple[Column, Column]:
    """Cosine of two image vectors; fails with NULL where there is none."""
    return cosine(a, b), cosine(a, b).isNotNull()


def json_token_metric(changes: Column) -> tuple[Column, Column]:
    """Tokens of the canonical text of a change list; a missing or broken one fails with 0."""
    n = change_tokens(changes)
    return F.coalesce(n, F.lit(0)), n.isNotNull()


def edit_metric(before: Column, after: Column) -> tuple[Column, Column]:
    """Token edit distance over the longer sequence; fails with NULL if either is missing."""
    return F.when(before.isNotNull() & after.isNotNull(), edit_distance(before, after)), before.isNotNull() & after.isNotNull()


def default_registry() -> Registry:
    """The eleven metrics of both tasks. Judges, answers, checks and image vectors come from outside and are inputs."""
    r = Registry()
    r.register(Metric("execution_success_rate", ("xml", "rendered"), execution_success))
    r.register(Metric("xml_token_count", ("xml",), token_metric))
    r.register(Metric("style_consistency_score", ("style_reply",), lambda reply: judged_score(reply, 1)))
    r.register(Metric("codevqa", ("answers_right",), share_of))
    r.register(Metric("siglip_score", ("image_vector", "render_vector"), vector_score))
    r.register(Metric("modified_xml_execution_success_rate", ("modified_xml", "modified_rendered"), lambda xml, ok: execution_success(xml, ok, False)))
    r.register(Metric("modified_xml_token_count", ("modified_xml",), lambda xml: token_metric(xml, 0.0)))
    r.register(Metric("modification_json_token_count", ("changes_json",), json_token_metric))
    r.register(Metric("style_consistency_score_task2", ("style_reply_task2",), lambda reply: judged_score(reply, 2)))
    r.register(Metric("xdrfr", ("satisfied",), share_of))
    r.register(Metric("xml_edit_distance", ("xml_before", "xml_after"), edit_metric))
    return r
