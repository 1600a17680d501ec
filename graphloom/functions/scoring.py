"""Scalar rules on texts, levels, scores and statuses."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
MODEL_FAMILIES = (("gpt", "GPT"), ("claude", "Claude"), ("gemini", "Gemini"), ("qwen", "Qwen"))
LEVELS = ("easy", "medium", "hard")
OPERATION_RANGES = {"Easy": (1, 2), "Medium": (3, 4), "Hard": (5, 7)}
TIER_CUT = 14000
CANDIDATE_SCORE = 0.6
SCREEN_WORDS = (
    "flowchart", "flow chart", "workflow", "pipeline", "architecture", "system diagram", "block diagram", "network diagram", "topology",
    "process flow", "data flow", "sequence diagram", "state machine",
)
SUBJECTIVE_WORDS = (
    "compact", "loose", "tight", "spacious", "align", "arrange", "spacing", "layout", "evenly", "uniform", "light", "dark", "pale", "bright", "vivid",
    "color scheme", "color", "coordinate", "harmonious", "modern", "traditional", "minimalist", "simple", "complex", "professional", "elegant", "style",
    "aesthetic", "layered", "contrast", "balanced", "unified", "visual", "clear", "clearer", "more", "slightly", "a bit", "very", "much", "less", "better", "improved",
)
TIMEOUT_MARKS = ("524", "error 524", "cloudflare", "timeout occurred")
#: Error types (lower case) and parts of messages (lower case) that make a call worth another try.
RETRY_TYPES = (
    "timeouterror", "connecttimeout", "readtimeout", "connectionerror", "connecterror", "networkerror", "httperror", "httpstatuserror", "requestexception",
    "connectionrefusederror", "connectionreseterror", "connectionabortederror", "httpxrequesterror", "permissiondeniederror", "notfounderror", "badrequesterror",
)
RETRY_MARKS = (
    "timeout", "timed out", "connection", "network", "502 bad gateway", "503", "504 gateway timeout", "524", "cloudflare", "api returned html", "500", "ssl handshake",
    "temporary failure", "403", "404", "400", "429", "too many requests", "rate limit", "负载已饱和", "请稍后再试", "permission denied", "quota", "account balance",
    "insufficient", "does not exist", "context length", "maximum context", "reduce the length", "无可用渠道", "model_not_found",
)
RESPONSE_MARKS = ("has no attribute 'choices'", "has no attribute 'usage'", "response.choices", "response.usage")
YES_MARKS = ("yes", "true", "correct", "satisfies", "meets", "✓", "√", "1", "是", "正确", "满足", "符合")
NO_MARKS = ("no", "false", "incorrect", "does not satisfy", "does not meet", "×", "✗", "0", "否", "错误", "不满足", "不符合")
ELEMENT_WORDS = ("节点", "连接", "线", "元素", "矩形", "圆形")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def word_count(text: Column) -> Column:
    """Words between white space; a blank text has none."""
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def content_hash(content: Column, algorithm: str = "md5") -> Column:
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}[algorithm](content)


def _level_part(instruction_id: Column) -> Column:
    return F.get(F.split(instruction_id, "_"), F.lit(1))


def level_from_id(instruction_id: Column) -> Column:
    """``inst_<x>_n`` gives x capitalised; other ids NULL."""
    return F.when(instruction_id.startswith("inst_"), F.initcap(_level_part(instruction_id)))


def strict_level_from_id(instruction_id: Column) -> Column:
    """As ``level_from_id`` for the three known levels only."""
    part = F.lower(_level_part(instruction_id))
    return F.when(instruction_id.startswith("inst_") & part.isin(*LEVELS), F.initcap(part))


def level_stored_first(stored: Column, instruction_id: Column) -> Column:
    return F.coalesce(stored, level_from_id(instruction_id), F.lit("unknown"))


def level_id_first(stored: Column, instruction_id: Column) -> Column:
    kept = F.when(~F.lower(F.trim(stored)).isin("unknown", "none", ""), stored)
    return F.coalesce(strict_level_from_id(instruction_id), kept)


def token_tier(tokens: Column, low: Column, cut: int = TIER_CUT) -> Column:
    """Easy below the first third, Medium below a constant, else Hard; NULL stays NULL."""
    return F.when(tokens < low, "Easy").when(tokens < cut, "Medium").when(tokens.isNotNull(), "Hard")


def tier_of_dimensions(score: Column) -> Column:
    """The sum of five dimension scores as a tier."""
    return F.when(score.between(5, 8), "Easy").when(score.between(9, 12), "Medium").when(score.between(13, 18), "Hard")


def operations_fit(level: Column, count: Column) -> Column:
    """Whether the number of operations fits the level; NULL if either is unknown."""
    cases = [(F.lower(F.trim(level)) == name.lower(), count.between(*r)) for name, r in OPERATION_RANGES.items()]
    return reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0]))


def metric_score(score: Column, success: Column) -> Column:
    """The score of a cell that did not fail."""
    return F.when(F.coalesce(success, F.lit(True)), score)


def coerce_success(value: Column) -> Column:
    """A success flag given as text: missing is true; true, 1 and yes are true; other texts are false."""
    return F.when(value.isNull(), True).otherwise(F.lower(F.trim(value)).isin("true", "1", "yes"))


def model_family(model: Column) -> Column:
    """The first family whose name occurs in the model name."""
    low = F.lower(model)
    first, *rest = MODEL_FAMILIES
    return reduce(lambda acc, f: acc.when(low.contains(f[0]), f[1]), rest, F.when(low.contains(first[0]), first[1])).otherwise("Other")


def strip_fence(text: Column) -> Column:
    """The inside of a fenced block; a text without fence as it is."""
    inside = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*$", 1)
    return F.when(inside != "", inside).otherwise(text)


def extract_xml(reply: Column, strict_compat: bool = False) -> Column:
    """XML in a reply: an ```xml block, any block, a bare model element, else the reply.

    A block that is never closed runs to the end; ``strict_compat`` drops its last character as the rule it follows does.
    """
    out = F.trim(reply)
    bare = F.regexp_extract(reply, r"(?s)(<mxGraphModel.*</mxGraphModel>)", 1)
    out = F.when(bare != "", bare).otherwise(out)
    for fence in ("```", "```xml"):
        at = F.locate(fence, reply)
        rest = F.substring(reply, at + len(fence), F.length(reply))
        stop = F.locate("```", rest)
        to_end = F.substring(rest, F.lit(1), F.greatest(F.lit(0), F.length(rest) - 1)) if strict_compat else rest
        block = F.trim(F.regexp_replace(F.when(stop > 0, F.substring(rest, F.lit(1), stop - 1)).otherwise(to_end), r"(?U)^\s+|\s+$", ""))
        out = F.when(at > 0, block).otherwise(out)
    return out


def first_number(text: Column) -> Column:
    """The first number in a text, NULL if there is none."""
    return F.nullif(F.regexp_extract(text, r"\d+\.?\d*", 0), F.lit("")).try_cast("double")


def json_of(text: Column) -> Column:
    """A JSON object in noisy text as a variant: the text itself, a fenced block, or the widest ``{...}``."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    widest = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    # The parser accepts a text that merely begins with a number, so a document must begin with a bracket.
    begun = [F.when(c.rlike(r"^\s*[\[{]"), c) for c in (text, fenced, widest)]
    return F.coalesce(*[F.try_parse_json(c) for c in begun])


CHANGE = "array<struct<original_fragment:string,modified_fragment:string>>"


def changes_of(text: Column) -> Column:
    """A change list: the ``changes`` of an object or a bare list; items need both keys."""
    doc = json_of(text)
    listed = F.coalesce(F.try_variant_get(doc, "$.changes", CHANGE), F.try_variant_get(doc, "$", CHANGE), F.from_json(strip_fence(text), CHANGE))
    return F.filter(listed, lambda c: c["original_fragment"].isNotNull() & c["modified_fragment"].isNotNull())


def looks_truncated(text: Column) -> Column:
    """A JSON text that stops before its end: no closing bracket in its tail, or an odd number of quotes."""
    tail = F.trim(F.right(text, F.lit(100)))
    return ~tail.rlike(r"[}\]]\s*(```)?\s*$") | (F.regexp_count(text, F.lit('"')) % 2 == 1)


def context_text(caption: Column, label: Column, near: Column) -> Column:
    """The known parts as lines, NULL if there is none."""
    lines = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in (("Caption", caption), ("Label", label), ("Context", near))]
    return F.nullif(F.concat_ws("\n", *lines), F.lit(""))


def render(template: Column, **values: Column) -> Column:
    """``{{ key }}`` and ``{{key}}`` replaced by their values."""
    for key, value in values.items():
        for mark in (f"{{{{ {key} }}}}", f"{{{{{key}}}}}"):
            template = F.replace(template, F.lit(mark), F.coalesce(value.cast("string"), F.lit("")))
    return template


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with ``", "`` and ``": "`` between parts and letters as they are; a text that is no JSON unchanged."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False)
        except (ValueError, RecursionError):
            return text

    return texts.map(one)


@F.pandas_udf(T.LongType())
def change_tokens(texts: pd.Series) -> pd.Series:
    """The token estimate of the canonical JSON; NULL for a text that is no JSON."""

    def one(text: str | None) -> int | None:
        try:
            return None if text is None else max(1, len(json.dumps(json.loads(text), ensure_ascii=False)) // 4)
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in texts], dtype="Int64")


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def data_url(content: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def clean_questions(questions: Column, default: str) -> Column:
    """Questions trimmed, empty ones dropped, a question mark added; a default if none is left."""
    kept = F.filter(F.transform(questions, lambda q: F.trim(q)), lambda q: F.coalesce(q, F.lit("")) != "")
    marked = F.transform(kept, lambda q: F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?"))))
    return F.when(F.size(marked) > 0, marked).otherwise(F.array(F.lit(default)))


def complete_types(types: Column, wanted: list[str], first: int) -> Column:
    """A placeholder for each wanted type that is missing, then the first ``first``."""
    return F.slice(F.concat(types, F.array_except(F.array(*[F.lit(w) for w in wanted]), types)), 1, first)


def keyword_score(text: Column, keywords: tuple[str, ...] = SCREEN_WORDS) -> Column:
    """0.3 for each keyword that occurs, at most 1."""
    hits = F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(text), k)))
    return F.least(hits * F.lit(0.3), F.lit(1.0))


def any_word(text: Column, listed: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(k) for k in listed]), lambda k: F.contains(F.lower(text), k))


def _any_of(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])


def retryable(error_type: Column, message: Column) -> Column:
    """Whether a failed call may be tried again.

    An answer of the wrong shape comes first, then the type, then the message; what no rule knows is not tried again.
    """
    kind, text = F.lower(F.coalesce(error_type, F.lit(""))), F.coalesce(message, F.lit(""))
    return (
        F.when((kind == "attributeerror") & _any_of(text, RESPONSE_MARKS), True)
        .when(_any_of(kind, RETRY_TYPES), True)
        .otherwise(_any_of(F.lower(text), RETRY_MARKS))
    )


def is_timeout(message: Column) -> Column:
    return _any_of(F.lower(message), TIMEOUT_MARKS)


def is_gemini(model: Column) -> Column:
    return F.contains(F.lower(model), F.lit("gemini"))


def yes_no(answer: Column) -> Column:
    """Yes for yes, true, 1 and 是; everything else No."""
    return F.when(F.lower(F.trim(answer)).isin("yes", "true", "1", "是"), "Yes").otherwise("No")


def yes_no_of_text(answer: Column) -> Column:
    """Yes or No of a free text: the side of which more marks occur; a tie of a short text by its letters; else No."""
    low = F.lower(answer)
    hits = [F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(low, m))) for marks in (YES_MARKS, NO_MARKS)]
    short = F.length(F.trim(answer)) <= 5
    return F.when(hits[0] > hits[1], "Yes").when(hits[1] > hits[0], "No").when(short & (F.contains(low, F.lit("y")) | F.contains(low, F.lit("是"))), "Yes").otherwise("No")


def looks_like_element(line: Column) -> Column:
    return _any_of(line, ELEMENT_WORDS)


def word_jaccard(a: Column, b: Column) -> Column:
    """Similarity of the lower-cased white-space words; 0 if either has none."""
    sets = [F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")) for c in (a, b)]
    return F.when((F.size(sets[0]) > 0) & (F.size(sets[1]) > 0), F.size(F.array_intersect(*sets)) / F.size(F.array_union(*sets))).otherwise(0.0)
