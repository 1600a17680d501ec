"""Broken prompt and response pairs.

Refusals are found by their openings. The openings of a response are its first
sentence, up to ``OPENING_WORDS`` words, and the first ``STEM_WORDS`` words of
it, for templates that go on differently, after a short lead-in ("Well," /
'Regarding "X":') and quoted labels are taken off. They may be as short as two
words and need not be terminated. Equal openings are counted first, so that a
template is one row however often it occurs; the distinct openings are then
clustered by their shingles of five words: all with a similarity of at least
``SIMILARITY`` are tied, through others too (``opening_clusters``). A cluster that answers prompts of unrelated kinds
(how many / what label / how related) does not depend on the prompt: it is a
refusal. An answer that belongs to a kind, such as "There are 7 of them", stays
within it. A prompt that names no kind has that of the prompts that begin like
it. Because a rare template may meet only one kind, a cluster of sentences that
speak of inability counts too.

All other defects are checks of one row: no content; the question or the anchor
over again; a sentence in another language, by character models trained on
labelled documents; a text that stops before its end. How sentences of this
collection end is learned from those that do end: the words around the last word
of terminated answers.

One Arrow stage makes all checks of a row; it reads whole texts. What depends on
the collection (openings, endings, kinds) is counted by Spark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.diagrams import small_batches
from ..functions.text import folded, stripped
from .components import components
from ..session import table
from ..staging import Stage
from .languages import LanguageModel
from .languages import train as train_languages

# Word lists and patterns.
NO_CONTENT = frozenset(["", "null", "none", "na", "nil", "nan", "tbd", "tba", "undefined"])
SENTENCE_WORDS = frozenset("the a an to from of its is are by with has have at after through above them there which one ones near before in into".split())
CHINESE_SENTENCE = r"从|之后|位于|正上方|接收|来自|连接到|出发|经过|流程|继续|完成|最后|结束|我|请|无法|不能|是|一共有"
INABILITY = (
    r"\b(cannot|can ?not|can't|unable|not able|not possible|won't be able|must decline|decline to|beyond my|not have access|don't have access|apologies|apologi[sz]e|sorry|"
    r"too blurry|did not load|no image was|language model)\b|抱歉|对不起|无法|不能回答|不能查看"
)
SPEAKER = r"\b(i|i'm|i've|me|my)\b|我"
NO_KIND = ("", "other", "unknown", "none")

OPENING_WORDS, STEM_WORDS, SHINGLE, SIMILARITY = 15, 6, 5, 0.8
#: Shape of ``band_keys``.
BANDS, PER_BAND = 16, 2
#: Log-likelihood by which another language must be ahead of that of the question.
MARGIN = 0.5

_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r'"[^"]*"|“[^”]*”|„[^“]*“|«[^»]*»')
_NAMED = re.compile(r'"([^"]+)"|“([^”]+)”')
_HAN = re.compile(r"[一-鿿]")
_TERMINAL = re.compile(r"[.!?。！？][\"”'’)\]}]*$")
_CHINESE = re.compile(CHINESE_SENTENCE)
_CHINESE_MARK = re.compile("[，。！？]")
_INABILITY, _SPEAKER = re.compile(INABILITY), re.compile(SPEAKER)
_CUT = re.compile(r"(…|\.\.\.|[,，、;；:：\-–—(&/]|\(see)$")
_CUT_ITEM = re.compile(r"\n\s*\d+[.)]$")
_WRAPPED = re.compile(r'^\{\s*"answer"\s*:\s*"(.*)"\s*\}$', re.DOTALL)
_UNCLOSED = re.compile(r'^\{\s*"[^}]*$', re.DOTALL)
_LEAD = re.compile(r"^\s*([^,:.，：。!！]*)[,:.，：。!！](?=.*[^\W_])", re.DOTALL)
_STOP = re.compile(r"[.!?](?=\s|$)|[。！？]")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bare_answer(answer: str, question: str) -> str:
    """The answer without quoted labels and without the labels that the question names."""
    bare = _QUOTED.sub(" ", answer)
    for a, b in _NAMED.findall(question):
        bare = re.sub(r"(?<![A-Za-z0-9])" + re.escape(a or b) + r"(?![A-Za-z0-9])", " ", bare)
    return bare


def opening(bare: str) -> list[str]:
    """The words of the first sentence after the lead-ins; each Chinese character is a word."""
    for _ in range(2):
        lead = _LEAD.match(bare)
        if lead and len(words(lead[1])) <= 2:
            bare = bare[lead.end() :]
    stop = next((s for s in _STOP.finditer(bare) if _WORD.search(bare, 0, s.start())), None)
    first = bare[: stop.start()] if stop else bare
    return words(_HAN.sub(lambda m: f" {m[0]} ", first.replace("'", "").replace("’", "")))[:OPENING_WORDS]


def is_chinese(text: str, tokens: list[str]) -> bool:
    n = len(_HAN.findall(text))
    return n >= 2 and 2 * n >= sum(w in SENTENCE_WORDS for w in tokens)


def repeats(answer: list[str], source: list[str]) -> bool:
    """The answer's words are those of the source, with at most three words before them."""
    n, m = len(answer), len(source)
    return 0 < m <= n <= m + 3 and answer[n - m :] == source


def shingles(tokens: list[str]) -> list[str]:
    """Runs of five words; a shorter opening is one run."""
    return [" ".join(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))]


_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(1, 1 << 61, BANDS * PER_BAND, dtype=np.uint64) | np.uint64(1)


def band_keys(openings: list[list[str]]) -> np.ndarray:
    """(openings, bands): the hash of each band of the MinHash signature. Openings must not be empty.

    An estimate, which misses 1 of 12 million pairs of similarity 0.8; ``opening_clusters`` does without.
    """
    runs = [shingles(o) for o in openings]
    flat = np.array([zlib.crc32(s.encode("utf-8", "surrogatepass")) | len(s) << 32 for r in runs for s in r], np.uint64)
    starts = np.cumsum([0] + [len(r) for r in runs[:-1]])
    hashed = (flat[:, None] + np.uint64(0x9E3779B9)) * _FACTORS
    hashed = (hashed ^ hashed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    least = np.minimum.reduceat(hashed ^ hashed >> np.uint64(29), starts, axis=0)
    pairs = least.reshape(len(runs), BANDS, PER_BAND)
    mixed = pairs[:, :, 0] * np.uint64(0xD6E8FEB86659FD93) ^ pairs[:, :, 1]
    return (mixed * np.uint64(0x9E3779B97F4A7C15) ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_FIELDS = [
    ("id", pa.int64()), ("kind", pa.string()), ("begins", pa.string()), ("defect", pa.string()), ("ends", pa.bool_()), ("sentence", pa.bool_()), ("learn", pa.bool_()),
    ("near", pa.string()), ("far", pa.string()), ("fixed", pa.string()), ("last", pa.string()), ("opening", pa.string()), ("unable", pa.bool_()), ("stem", pa.string()),
]
_DDL = "id bigint, kind string, begins string, defect string, ends boolean, sentence boolean, learn boolean, near string, far string, fixed string, last string, opening string, unable boolean, stem string"


def check_rows(rows: list[tuple], model: LanguageModel) -> pa.RecordBatch:
    """Rows (id, question, answer, anchor, kind), texts stripped, to the checks of each."""
    bare_questions = [_QUOTED.sub(" ", q) for _, q, _, _, _ in rows]
    answers = [m[1] if (m := _WRAPPED.match(raw)) and m[1] else raw for _, _, raw, _, _ in rows]
    bares = [bare_answer(a, r[1]) for a, r in zip(answers, rows)]
    of_q, of_a = model.scores(bare_questions), model.scores(bares)
    out: list[list] = [[] for _ in _FIELDS]
    for i, (id_, q, _, v, kind) in enumerate(rows):
        a, bare = answers[i], bares[i]
        aw, bw, qw = words(a), words(bare), words(bare_questions[i])
        ends = bool(_TERMINAL.search(a))
        chinese = len(_CHINESE.findall(bare))
        common = sum(w in SENTENCE_WORDS for w in bw)
        sentence = common >= 2 or chinese >= 2 or chinese == 1 and bool(_CHINESE_MARK.search(bare))
        asked = int(of_q[i].argmax())
        han = is_chinese(bare, bw)
        # Chinese is told by its script, all others by the models.
        other = han != is_chinese(bare_questions[i], qw) or not han and of_a[i].max() - of_a[i][asked] >= MARGIN
        same = not qw or not other
        defect = None
        if "".join(aw) in NO_CONTENT:
            defect = "empty"
        elif repeats(aw, words(q)) or repeats(aw, words(v)):
            defect = "copy"
        elif _CUT.search(a) or _CUT_ITEM.search(a) or a.count("(") + a.count("（") > a.count(")") + a.count("）") or a.count('"') % 2 or _UNCLOSED.match(a):
            defect = "truncated"
        elif not same and ends and (sentence if han else len(bw) >= 5):
            defect = "language"
        n = len(bw)
        lower = bare.lower().replace("’", "'")
        unable = bool(_INABILITY.search(lower)) and (ends or bool(_SPEAKER.search(lower)))
        begin = None
        if defect is None:
            begin = opening(bare)
            # Labels and numbers are no openings: without a final mark only sentences are, and short ones only without digits.
            if len(begin) < 2 or not (ends or sentence or unable) or len(begin) < SHINGLE and (not ends or any(c.isdigit() for w in begin for c in w)):
                begin = None
        pair = lambda k: f"{bw[n - k]} {bw[n - k + 1]}" if n >= k else None
        learn = ends and common >= 2 and n >= 5 and same and not han
        row = (id_, kind, " ".join(qw[:2]), defect, ends, sentence, learn, pair(3), pair(4), pair(2), bw[-1] if bw else None, " ".join(begin) if begin else None, unable, " ".join(begin[:STEM_WORDS]) if begin and len(begin) > STEM_WORDS else None)
        for column, value in zip(out, row):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(out, _FIELDS)], names=[n for n, _ in _FIELDS])


def prepared(pairs: DataFrame, model: LanguageModel) -> DataFrame:
    """The distinct pairs with their checks; texts whole, NULL as ''."""
    text = lambda c: stripped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    base = pairs.select(
        F.col("pair_id").cast("bigint").alias("id"), text("question").alias("q"), text("answer").alias("a"), text("visual_anchor").alias("v"), F.coalesce(folded(F.col("question_type")), F.lit("")).alias("kind")
    ).where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("q", "a", "v", "kind")).alias("r")).select("id", "r.*")
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield check_rows(list(zip(*(c.to_pylist() for c in batch.columns))), shared.value)

    return base.mapInArrow(run, _DDL)


def endings(rows: DataFrame, stage: Stage, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """How terminated sentences end: (what, text) of the word pairs that end at least a 200th of them, and (last) all last words that follow such pairs.

    ``near``: the two words before the last; ``far``: the two before the last two, both before at least four different last
    words; ``fixed``: the last two themselves. The share is a rate, so the contexts are at most 200 of each kind and are the
    same ones in a collection ten times as large; the last words are as many as the collection has.
    """
    done = rows.where("learn")
    parts = done.select(F.explode(F.array(
        F.struct(F.lit("near").alias("what"), F.col("near").alias("text"), F.col("last")),
        F.struct(F.lit("far").alias("what"), F.col("far").alias("text"), F.col("last")),
        F.struct(F.lit("fixed").alias("what"), F.col("fixed").alias("text"), F.lit("").alias("last")),
    )).alias("e")).select("e.*")
    total = done.count()
    per = stage.put(parts.groupBy("what", "text", "last").agg(F.count("*").alias("n")))
    context = per.groupBy("what", "text").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    kept = stage.put(context.where((F.col("n") >= max(least, total / 200)) & ((F.col("what") == "fixed") | (F.col("kinds") >= 4))).select("what", "text"))
    lasts = per.where("what != 'fixed'").join(F.broadcast(kept), ["what", "text"]).select("last").distinct()  # at most 600 contexts
    return kept, stage.put(lasts)


def unfinished(rows: DataFrame, stage: Stage) -> DataFrame:
    """(id) of the sentences that have no final mark and do not end as terminated ones do."""
    context, lasts = endings(rows, stage)
    asks = rows.where("defect IS NULL AND sentence AND NOT ends").select("id", "near", "far", "fixed", "last")
    known = lasts.withColumn("last_known", F.lit(True))
    out = asks.join(known, "last", "left")
    for what in ("near", "far", "fixed"):
        of = context.where(F.col("what") == what).select(F.col("text").alias(what), F.lit(True).alias(f"{what}_known"))
        out = out.join(F.broadcast(of), what, "left")  # at most 200 rows
    return out.where("NOT coalesce(fixed_known OR last_known AND (near_known OR far_known), false) AND NOT coalesce(fixed_known, false)").select("id")


def opening_clusters(distinct: DataFrame, stage: Stage) -> DataFrame:
    """(opening, cluster) of rows with an opening, every opening once: the connected components of all pairs with the similarity.

    Two sets of at most eleven runs with |common| >= 0.8 |union| are either one inside the other, which has a quarter of
    the common ones more at most (one or two), or have one run each that the other lacks, beside eight common ones at least.
    So each set is put under itself and under what is left of it without one or two runs. Under a set that is an opening's
    own all others are tied to that opening; under one that is not, those without one run and with eight left are all alike
    and tied to the smallest. No pair is lost, none is enumerated, and every tie is verified on the runs.

    If no three words of an opening come twice in it, its runs follow each other in one way only, and all that an alike
    opening can lack are runs at its ends; only these are left out. Of the others every run is.
    """
    split = distinct.select("opening", F.split("opening", " ").alias("w"))
    of = lambda k: f"transform(sequence(1, greatest(1, size(w) - {k - 1})), i -> array_join(slice(w, i, {k}), ' '))"
    runs = split.select("opening", F.expr(f"array_distinct({of(SHINGLE)})").alias("runs"), F.expr(f"size(w) < 3 OR size(array_distinct({of(3)})) = size(w) - 2").alias("plain"))
    sets = stage.put(runs.withColumn("h", F.expr("transform(runs, x -> xxhash64(x))")).withColumn("n", F.size("runs")))
    lacks = F.expr(f"int(floor({1 - SIMILARITY}D * n + 1e-9D))")
    summed = sets.select("opening", "h", "n", "plain", lacks.alias("lacks"), F.expr("aggregate(h, 0L, (a, x) -> a ^ x)").alias("all"))
    less = "filter(transform(h, (x, i) -> struct(if(NOT plain OR i IN (0, n - 1), all ^ x, NULL) AS bucket, 1 AS lost)), x -> x.bucket IS NOT NULL)"
    lesser = (
        "filter(flatten(transform(h, (x, i) -> transform(h, (y, j) -> struct(if(i < j AND (NOT plain OR i IN (0, n - 2) AND j IN (1, n - 1)), all ^ x ^ y, NULL) AS bucket, 2 AS lost)))), x -> x.bucket IS NOT NULL)"
    )
    keys = F.expr(f"concat(array(struct(all AS bucket, 0 AS lost)), if(lacks > 0, {less}, array()), if(lacks > 1, {lesser}, array()))")
    index = stage.put(summed.select("opening", "n", F.explode(keys).alias("k")).select("opening", "k.*", F.expr(f"k.lost = 1 AND {1 - SIMILARITY}D * (n - 1) + 1e-9D >= {2 * SIMILARITY}D").alias("alike")))
    centre = index.groupBy("bucket").agg(F.min(F.when(F.col("lost") == 0, F.col("opening"))).alias("own"), F.min(F.when(F.col("alike"), F.col("opening"))).alias("least"), F.count("*").alias("rows"))
    centre = centre.where("rows > 1 AND (own IS NOT NULL OR least IS NOT NULL)").drop("rows")
    near = index.join(centre, "bucket").where("own IS NOT NULL OR alike").select("opening", F.coalesce("own", "least").alias("centre")).where("opening != centre").distinct()
    sides = near.join(sets.select("opening", F.col("runs").alias("x")), "opening").join(sets.select(F.col("opening").alias("centre"), F.col("runs").alias("y")), "centre")
    verified = sides.where(F.size(F.array_intersect("x", "y")) >= F.lit(SIMILARITY) * F.size(F.array_union("x", "y")) - 1e-9).select("opening", "centre")
    ties = verified.select(F.concat_ws("\x00", "opening", "centre").alias("rec"), F.explode(F.array("opening", "centre")).alias("val"))
    label = components(ties, stage)
    return distinct.select("opening").join(label, distinct["opening"] == label["val"], "left").select("opening", F.coalesce("label", "opening").alias("cluster"))


def kinds_of(rows: DataFrame) -> DataFrame:
    """rows with ``kind`` filled in: a prompt without kind has that of at least four fifths of the prompts with the same first two words, else none."""
    named = ~F.col("kind").isin(*NO_KIND)
    per = rows.where(named).groupBy("begins", "kind").agg(F.count("*").alias("n"))
    most = per.groupBy("begins").agg(F.max_by("kind", F.struct("n", "kind")).alias("like"), F.max("n").alias("top"), F.sum("n").alias("all")).where(F.col("top") * 5 >= F.col("all") * 4)
    rest = rows.where(~named).join(most.select("begins", "like"), "begins", "left").withColumn("kind", F.coalesce("like", F.lit(""))).drop("like")
    return rows.where(named).unionByName(rest)


def refusals(rows: DataFrame, stage: Stage) -> DataFrame:
    """(opening, cluster) of the openings that are refusals; ``rows`` (opening, kind, unable)."""
    per = stage.put(rows.groupBy("opening", "kind").agg(F.count("*").alias("n"), F.count_if("unable").alias("unable")))
    clusters = stage.put(opening_clusters(per.select("opening").distinct(), stage))
    met = per.join(clusters, "opening").groupBy("cluster", "kind").agg(F.sum("n").alias("n"), F.sum("unable").alias("unable"))
    all_of = met.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("unable").alias("unable"), F.collect_list(F.when(F.col("kind") != "", F.col("n"))).alias("of_kinds"))
    unrelated = F.size(F.filter("of_kinds", lambda k: k * 20 >= F.col("n"))) >= 2
    return clusters.join(all_of.where(unrelated | (F.col("unable") * 2 > F.col("n"))).select("cluster"), "cluster").select("opening", "cluster")


def defects(pairs: DataFrame, stage: Stage, model: LanguageModel) -> DataFrame:
    """(id, defect, cluster) of every distinct pair; ``defect`` is NULL for sound ones.

    A NULL answer is empty. A NULL question or anchor is copied by nothing and has no language.
    Of several rows of a pair_id the smallest counts. Extra columns are not read.
    """
    rows = stage.put(prepared(pairs, model))
    cut = stage.put(unfinished(rows, stage))
    cut = cut.withColumn("cut", F.lit("truncated"))
    sound = rows.where("defect IS NULL AND opening IS NOT NULL").join(cut, "id", "left")
    told = kinds_of(sound.where("cut IS NULL").select("kind", "begins", "unable", "opening", "stem"))
    stems = told.where("stem IS NOT NULL").select(F.col("stem").alias("opening"), "kind", "unable")
    found = stage.put(refusals(told.select("opening", "kind", "unable").unionByName(stems), stage))
    # Only answers with an opening meet the templates; all others pass by, so no key stands for many of them.
    # What breaks off is a refusal only if it is one as a whole.
    open_ = sound.select("id", "cut", "opening", F.when(F.col("cut").isNull(), F.coalesce("stem", F.concat(F.lit("\x00"), F.col("id").cast("string")))).alias("stem"))
    by_stem = found.select(F.col("opening").alias("stem"), F.col("cluster").alias("of_stem"))
    open_ = open_.join(found, "opening", "left").join(by_stem, "stem", "left").withColumn("cluster", F.coalesce("cluster", "of_stem"))
    out = open_.select("id", F.when(F.col("cluster").isNotNull(), "refusal").otherwise(F.col("cut")).alias("defect"), "cluster")
    rest = rows.where("defect IS NOT NULL OR opening IS NULL").select("id", "defect").join(cut, "id", "left")
    return out.unionByName(rest.select("id", F.coalesce("defect", "cut").alias("defect"), F.lit(None).cast("string").alias("cluster")))


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "qa_pairs"), Stage(spark, "pairs"), train_languages(table(spark, sf_dir, "documents")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken pairs and their defect."""
    return _defects(spark, sf_dir).where("defect IS NOT NULL").select(F.col("id").alias("pair_id"), "defect")


def p3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refusal templates and how many answers open with them."""
    return _defects(spark, sf_dir).where("defect = 'refusal'").groupBy(F.col("cluster").alias("template")).agg(F.count("*").alias("answers"))


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs per defect; sound ones as 'none'."""
    return _defects(spark, sf_dir).groupBy(F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("pairs"))


QUERIES = {"p3_found": p3_found, "p3_templates": p3_templates, "p3_summary": p3_summary}
SQL: dict[str, str] = {}
