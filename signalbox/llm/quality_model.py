"""Quality classifier: boosted trees over statistics of a document's text.

Scores depend on the text alone. The fit uses at most ``MAX_SAMPLE`` labelled documents, picked by a hash
of their ids; all documents are scored.

Edge cases: a null text counts as empty and gets the score of empty statistics; labels that are null or without a
document are ignored; without labels, or with one class only, all documents get the same score; repeated rows score alike;
an empty table gives an empty result. Columns named like the results are replaced, others kept.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.llm import boosting

#: Bound on the labelled rows of the fit.
MAX_SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>~^="
TERMINAL = (b".", b"!", b"?", b'"', "”".encode(), "…".encode())
# Frequent function words of the four languages.
STOP_WORDS = frozenset(w.encode() for w in (
    "a and are as be by for from in is it of on that the this to was what with "
    "als auf das dem den der die ein eine im ist mit nicht sich und von zu "
    "al con de del el en es la las lo los no para por que se su un una y "
    "au avec dans des du elle est et le les ou par pas pour qui sur une"
).split())

NAMES = (
    "words", "characters", "word_length", "long_words", "distinct_words", "top_word", "same_as_before", "repeated_windows", "stop_words",
    "symbols", "symbol_ends", "separators", "capitals", "capital_words", "exclamations", "punctuation", "digits", "beyond_ascii",
    "lines", "line_words", "line_ends", "repeated_lines", "initial_capitals", "sentence_words",
)


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(NAMES)
    counts = Counter(words)
    windows = list(zip(*(words[k:] for k in range(5)), strict=False))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = sum(map(raw.count, (bytes([b]) for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    punctuation = sum(map(raw.count, (b".", b",", b";", b":", b"!", b"?", b"-", b"(", b")", b'"', b"'")))
    sentences = sum(1 for w in words if w[-1:] in b".!?")
    long_words = sum(1 for w in words if len(w) > 12)
    return [
        np.log1p(n), np.log1p(len(text)), sum(map(len, words)) / n, long_words / n, len(counts) / n, max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(windows)) / len(windows) if windows else 0.0,
        sum(counts[w] for w in counts.keys() & STOP_WORDS) / n,
        sum(map(raw.count, (bytes([b]) for b in SYMBOLS))) / size, sum(1 for w in words if w[-1:] in SYMBOLS) / n,
        (counts.get(b"|", 0) + counts.get(b">", 0)) / n, letters / size, sum(map(bytes.isupper, words)) / n, raw.count(b"!") / size,
        punctuation / size, sum(map(raw.count, (bytes([b]) for b in b"0123456789"))) / size, (len(raw) - len(text)) / size,
        np.log1p(len(lines)), n / len(lines), sum(1 for line in lines if line.rstrip().endswith(TERMINAL)) / len(lines),
        1 - len(set(lines)) / len(lines), sum(map(bytes.istitle, words)) / n, n / (1 + sentences),
    ]


def features(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(NAMES))


def fitted(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, max_rows: int = MAX_SAMPLE) -> boosting.Trees:
    """Trees for ``labels.quality``; ``eligible`` says which label rows may be learned from."""
    sampled = boosting.sample(docs, labels, "quality", F.lit(True) if eligible is None else eligible, max_rows)
    return boosting.fit(*boosting.vectors(sampled, features))


def scored(docs: DataFrame, trees: boosting.Trees) -> DataFrame:
    """Rows of ``docs`` with ``score`` (0 to 1, higher: better) and ``predicted``."""
    return boosting.scored(docs.drop("predicted"), features, trees.probability).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
