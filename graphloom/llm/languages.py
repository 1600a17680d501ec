"""The language of short texts: models of character trigrams and words trained on labelled documents.

Every model is mixed with the mean of all, so that a trigram that no language
has (an invented name) speaks for none. Languages without labelled documents
are known by their most common words only.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the labelled sample for training, per language.
MAX_DOCUMENTS = 200
#: A label counts as a language if it has at least this share of the labelled documents; so there are at most 100 models.
LEAST_SHARE = 0.01
#: Share of the mean of all languages in each.
MIXED = 0.3
#: The most common words of languages for which there may be no labelled documents.
COMMON_WORDS = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch",
    "en": "the of and to in is it you that he was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use how said an each she",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son les aux d'un cette d'une ou être fait ses mais comme on tout nous sa fois était deux avant après au-dessus",
    "it": "di e il la che in un a per è una sono con non del si da come le dei nel alla più anche al della i lo ha se ma gli questo o delle dopo prima sua nella essere tra suo fra",
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até",
}
_BUCKETS = 1 << 16
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def plain(text: str) -> str:
    """The words that a language is told by: those without a capital, which names have, if there are three, else all."""
    tokens = _TOKEN.findall(text)
    small = [t for t in tokens if not t[0].isupper()]
    return " ".join(small if len(small) >= 3 else tokens).lower()


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character trigrams and of all words of the texts, one text after another, and where each text starts."""
    joined = [f"  {plain(t)} " for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    keys = np.zeros(len(codes), np.uint64)
    keys[:-2] = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    keys = ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    of_words = [[zlib.crc32(w.encode("utf-8", "surrogatepass")) % _BUCKETS + _BUCKETS for w in t.split()] for t in joined]
    ends = np.cumsum([len(t) for t in joined])
    at = np.repeat(ends, [len(w) for w in of_words])
    sizes = np.array([len(t) + len(w) for t, w in zip(joined, of_words)], np.int64)
    return np.insert(keys, at, np.array([k for w in of_words for k in w], np.int64)), np.cumsum(sizes) - sizes


class LanguageModel:
    """Log-probabilities of character trigrams and of words in each language.

    Half of a language is what its labelled documents have, half its most common words: the documents may speak of few things.
    """

    def __init__(self, texts: list[str], labels: list[str]):
        self.languages = sorted(set(labels) | set(COMMON_WORDS))
        shares = np.zeros((2 * _BUCKETS, len(self.languages)))
        for k, language in enumerate(self.languages):
            sources = [s for s in ([t for t, own in zip(texts, labels) if own == language], [COMMON_WORDS.get(language, "")]) if any(map(plain, s))]
            for source in sources:
                counts = np.bincount(_grams(source)[0], minlength=2 * _BUCKETS)
                shares[:, k] += counts / counts.sum() / len(sources)
        self.table = np.log((1 - MIXED) * shares + MIXED * shares.mean(1, keepdims=True) + 1e-9).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): log-likelihood of each text."""
        if not texts:
            return np.zeros((0, self.table.shape[1]), np.float32)
        keys, starts = _grams(texts)
        return np.add.reduceat(self.table[keys], starts, axis=0)


def train(documents: DataFrame, text: str = "text", language: str = "lang", most: int = MAX_DOCUMENTS) -> LanguageModel:
    """A model of every language that labels a share of the documents, from at most ``most`` documents of each, the first by a hash of the text.

    Labels are compared trimmed and lower-cased; NULL and blank labels and texts are left out. Of an empty table comes a model of the common words.
    """
    rows = documents.select(F.lower(F.trim(F.col(language).cast("string"))).alias("label"), F.col(text).cast("string").alias("text")).where("label != '' AND text IS NOT NULL")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    chosen = [r.label for r in counts.where(F.col("n") >= total * LEAST_SHARE).collect()]  # at most 1 / LEAST_SHARE
    hashed = rows.where(F.col("label").isin(chosen)).withColumn("h", F.xxhash64("text"))
    # A range of hashes that holds about four times what is wanted of the rarest, so few texts are ranked.
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    least = counts.where(F.col("label").isin(chosen))
    share = F.least(F.lit(1.0), F.lit(4.0 * most + 200) / F.col("n"))
    near = hashed.join(F.broadcast(least), "label").where(F.pmod(F.col("h"), F.lit(1_000_003)) < share * 1_000_003)
    found = near.withColumn("rank", rank).where(F.col("rank") <= most).select("label", "text").orderBy("label", "text").collect()  # at most most * 1 / LEAST_SHARE
    return LanguageModel([r.text for r in found], [r.label for r in found])
