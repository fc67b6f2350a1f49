"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

Features are densities of lexicons, how near second-person words are to their hits, capitals, punctuation and
obfuscation rates. Besides the fixed lexicon there are two learned ones, of words and of word beginnings that are much more
frequent in labelled toxic documents. At most ``MAX_SAMPLE`` labelled documents take part: a hash of the id gives each to
the lexicons, the trees or the calibration, so no part sees the rows of another.

Edge cases: a null text counts as empty and gets the score of empty features; labels that are null or without a document are
ignored; with one class only, all documents get the same score; repeated rows score alike; an empty table gives
an empty result. Columns named like the results are replaced, others kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.llm import boosting
from signalbox.llm.common import row_batches, stored

#: Bounds on the labelled rows of the fit and on the words of a learned lexicon.
MAX_SAMPLE, MAX_LEXICON = 20_000, 1000
#: A learned entry is in so many toxic documents, and so many times as likely there.
MIN_DOCUMENTS, MIN_RATIO, BEGINNINGS = 5, 6.0, (4, 5)

# Fixed word lists.
INSULTS = frozenset(
    "idiot moron loser scum trash clown stupid worthless pathetic disgusting dumb fool jerk imbecile filth vermin garbage "
    "ugly hate kill die freak creep coward liar pig rat parasite".split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tus ti vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
MIXED = regex.compile(r"\p{L}[\d@$*!#%]+\p{L}")
STRETCHED = regex.compile(r"(\p{L})\1\1")

NAMES = (
    "insults", "insult_count", "disguised_insults", "learned_words", "learned_word_count", "learned_beginnings", "learned_beginning_count",
    "near_you", "you", "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "stretched", "words",
)


@dataclass(frozen=True)
class Lexicons:
    words: frozenset[str]
    beginnings: frozenset[str]


def plain(word: str) -> str:
    """Lower case without marks at the ends."""
    return word.lower().strip(".,;:!?\"'()[]{}*#$%&|-_~^=<>/\\")


def undisguised(word: str) -> str:
    """Digits and signs read as the letters they stand for, marks inside dropped, stretched letters shortened."""
    return STRETCHED.sub(r"\1", regex.sub(r"\P{L}", "", word.lower().translate(LEET)))


def dense(text: str | None, lexicons: Lexicons) -> list[float]:
    text = text or ""
    words = WORD.findall(text)
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(NAMES)
    bare = [plain(w) for w in words]
    insults = learned = begun = 0
    hits, you = [], []
    for at, w in enumerate(bare):
        insult, known, start = w in INSULTS, w in lexicons.words, not lexicons.beginnings.isdisjoint(w[:k] for k in BEGINNINGS)
        insults += insult
        learned += known
        begun += start
        if insult or known or start:
            hits.append(at)
        if w in YOU:
            you.append(at)
    mixed = [w for w in words if MIXED.search(w)]
    disguised = sum(1 for w in mixed if (u := undisguised(w)) in INSULTS or u in lexicons.words)
    near = 0.0
    if hits and you:
        gaps = np.abs(np.array(hits)[:, None] - np.array(you)[np.clip(np.searchsorted(you, hits)[:, None] + [-1, 0], 0, len(you) - 1)]).min(1)
        near = float((1 / (1 + gaps)).max())
    return [
        insults / n, min(insults, 20), disguised, learned / n, min(learned, 20), begun / n, min(begun, 20), near, len(you) / n,
        sum(1 for c in text if c.isupper()) / size, sum(map(str.isupper, words)) / n, text.count("!") / size, text.count("?") / size,
        sum(map(text.count, ".,;:!?-\"'")) / size, len(mixed) / n, len(STRETCHED.findall(text)) / n, np.log1p(n),
    ]


def entries(text: str | None) -> set[str]:
    """Distinct words of a text, and their beginnings marked with a dash."""
    bare = {plain(w) for w in WORD.findall(text or "")}
    return bare | {w[:k] + "-" for w in bare for k in BEGINNINGS if len(w) > k}


def learned_lexicons(sampled: DataFrame) -> Lexicons:
    """Words and beginnings that mark toxic documents in a bounded sample (``text``, ``label``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for part in row_batches([batch]):
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    (toxic if label else clean).update(entries(text))
            keys = list(toxic | clean)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["entry", "toxic", "clean"])

    totals = sampled.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n_toxic, n_clean = totals[0] or 0, totals[1] or 0
    if not n_toxic or not n_clean:
        return Lexicons(frozenset(), frozenset())
    counts = sampled.select("text", F.col("label").cast("int")).mapInArrow(count, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    marked = counts.filter((F.col("toxic") >= MIN_DOCUMENTS) & (ratio >= MIN_RATIO)).orderBy(F.desc("toxic"), "entry").limit(MAX_LEXICON)
    found = [r["entry"] for r in marked.collect()]
    return Lexicons(frozenset(e for e in found if not e.endswith("-")), frozenset(e[:-1] for e in found if e.endswith("-")))


@dataclass(frozen=True)
class Model:
    lexicons: Lexicons
    trees: boosting.Trees
    knots: np.ndarray
    values: np.ndarray

    def features(self, texts: list[str | None]) -> np.ndarray:
        return np.array([dense(t, self.lexicons) for t in texts], float).reshape(len(texts), len(NAMES))

    def score(self, x: np.ndarray) -> np.ndarray:
        p = self.trees.probability(x)
        if not len(self.knots):
            return p
        # a trace of the uncalibrated score keeps the order inside flat pieces
        return 0.999 * np.interp(p, self.knots, self.values) + 0.001 * p


def fitted(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, max_rows: int = MAX_SAMPLE) -> Model:
    """Model for ``labels.toxic``; ``eligible`` says which label rows may be learned from."""
    sampled = stored(boosting.sample(docs, labels, "toxic", F.lit(True) if eligible is None else eligible, max_rows), "toxic-sample")
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(10))
    lexicons = learned_lexicons(sampled.filter(part < 4))
    blank = Model(lexicons, boosting.fit(np.zeros((0, len(NAMES))), np.zeros(0)), np.zeros(0), np.zeros(0))
    trees = boosting.fit(*boosting.vectors(sampled.filter((part >= 4) & (part < 8)), blank.features))
    x, y = boosting.vectors(sampled.filter(part >= 8), blank.features)
    if len(y) == 0 or y.min() == y.max():
        return Model(lexicons, trees, np.zeros(0), np.zeros(0))
    return Model(lexicons, trees, *boosting.isotonic(trees.probability(x), y))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` with ``score`` (0 to 1, higher: more toxic) and ``predicted``."""
    return boosting.scored(docs.drop("predicted"), model.features, model.score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
