"""Quality rules, line first.

Each line of a document is judged alone; lines that fail are removed, and a document that loses
too much of its text with them is rejected. Word statistics of the whole text reject it as well.

A line fails if one of these holds (words as in the word rule, a line needs one):

- punctuation: at least ``SYMBOL_SHARE`` percent of its words end in a symbol of ``#*$%&|<>~^=``,
  or at least ``SHOUT_SHARE`` percent end in ``!!``;
- navigation: at least ``NAVIGATION`` words are a lone separator (``|``, ``>``, ``»``, ``·``) and they
  are at least ``SEPARATOR_SHARE`` percent of its words;
- boilerplate: it has one of the phrases in ``BOILERPLATE``, and at most ``BOILERPLATE_WORDS`` words.

Lines without a word are neither kept nor lost. A document is rejected if its statistics fail, or if
the lines that stay have less than ``KEEP_SHARE`` percent of its words.

Edge cases: a null or empty text has zero counts and fails (fewer than ten words). Repeated rows are
judged alike; null ids and further columns go through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import row_batches

# Fixed values of the rules.
SYMBOL_SHARE, SHOUT_SHARE, SEPARATOR_SHARE, NAVIGATION, BOILERPLATE_WORDS, KEEP_SHARE = 50, 50, 30, 2, 30, 50
MIN_WORDS, REPEAT_SHARE, WINDOW = 10, 20, 5
BOILERPLATE = (
    "accept all cookies", "cookie policy", "enable javascript", "javascript is disabled", "lorem ipsum",
    "privacy policy", "sign up for our newsletter", "skip to content", "terms of use", "terms of service",
)
SEPARATORS = frozenset({b"|", b">", "»".encode(), "·".encode()})
SYMBOLS = re.compile(r"[#*$%&|<>]")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")


def line_fails(words: list[bytes]) -> bool:
    n = len(words)
    symbols = sum(1 for w in words if w[-1:] in b"#*$%&|<>~^=")
    if 100 * symbols >= SYMBOL_SHARE * n:
        return True
    if 100 * sum(1 for w in words if w[-2:] == b"!!") >= SHOUT_SHARE * n:
        return True
    separators = sum(1 for w in words if w in SEPARATORS)
    if separators >= NAVIGATION and 100 * separators >= SEPARATOR_SHARE * n:
        return True
    if n <= BOILERPLATE_WORDS:
        line = b" ".join(words).lower().decode("utf-8", "replace")
        return any(phrase in line for phrase in BOILERPLATE)
    return False


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = end = 0
    for at, w in enumerate(windows):
        if w in twice:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines, duplicates, lost = set(), 0, 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            duplicates += line in lines
            lines.add(line)
            lost += len(own) * line_fails(own)
    return (len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), len(SYMBOLS.findall(text)), duplicates, repeated_words(words), lost)


def cleaned(text: str | None) -> str | None:
    """The text without the lines that fail."""
    if text is None:
        return None
    return "\n".join(line for line in text.split("\n") if not ((own := line.encode("utf-8", "surrogatepass").split()) and line_fails(own)))


def _measured(batches: Iterator[pa.RecordBatch], clean: bool) -> Iterator[pa.RecordBatch]:
    for batch in row_batches(batches):
        at = batch.schema.get_field_index("text")
        texts = batch.column(at).to_pylist()
        counts = list(zip(*map(measure, texts), strict=True)) or [()] * len(COUNTS)
        columns = [*batch.columns, *(pa.array(c, pa.int64()) for c in counts)]
        if clean:
            columns[at] = pa.array(list(map(cleaned, texts)), pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *COUNTS])


def judge(docs: DataFrame, clean: bool = False) -> DataFrame:
    """Rows of ``docs`` (which has ``text``) with the counts, ``base_failed`` and ``kept``; a column of
    such a name is replaced. ``clean`` also removes the failing lines from ``text``."""
    docs = docs.drop(*COUNTS, "base_failed", "kept")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} bigint" for c in COUNTS)])
    out = docs.mapInArrow(lambda batches: _measured(batches, clean), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    enough = 100 * (F.col("n_words") - F.col("lost_words")) >= KEEP_SHARE * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)
