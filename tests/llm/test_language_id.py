"""Language identification: n-grams and filter against plain sets, held-out accuracy, awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox.llm import language_id as li

SYLLABLES = {"aa": ["ta", "ki", "mo", "re"], "bb": ["schn", "ü", "ung", "ei"], "cc": ["ção", "lh", "é", "um"], "dd": ["да", "не", "ть", "ой"]}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def plain_grams(text):
    """N-grams as strings, from words between two blanks."""
    words, word = [], ""
    for c in [*(text or "").lower(), " "]:
        if c.isalpha():
            word += c
        elif word:
            words.append(f" {word} ")
            word = ""
    return [w[i : i + n] for n in li.ORDERS for w in words for i in range(len(w) - n + 1)]


def test_grams_are_those_of_words():
    rng = random.Random(3)
    texts = ["", "a", "...", "Ab, c", "naïve 日本語 x1y", "İstanbul ΟΔΟΣ ß", " ".join(text_of(rng, v, 40) for v in SYLLABLES)]
    seen = {}
    for text in texts:
        found, want = np.concatenate([*li.grams_of(li.letters_of(text)), np.zeros(0, np.uint64)]), plain_grams(text)
        assert len(found) == len(want)
        by_hash = sorted(np.unique(found, return_counts=True)[1].tolist())
        assert by_hash == sorted(np.unique(want, return_counts=True)[1].tolist() if want else [])
        seen |= {t: None for t in want}
    assert len(seen) > 100


def test_windows_do_not_matter(monkeypatch):
    letters = li.letters_of(text_of(random.Random(1), "aa", 300))
    whole = np.sort(np.concatenate(list(li.grams_of(letters))))
    monkeypatch.setattr(li, "WINDOW", 17)
    assert (np.sort(np.concatenate(list(li.grams_of(letters)))) == whole).all()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, text_of(rng, v, rng.randint(3, 60)), v) for i, v in enumerate(rng.choices(list(SYLLABLES), k=800))]
    rows = [(i, t, "aa" if i % 25 == 0 else v) for i, t, v in rows]  # some wrong labels
    return rows


def test_filter_against_sets(spark, corpus):
    """Membership and popcounts equal those of plain sets, but for the filter's mistakes."""
    model = li.fitted(spark.createDataFrame(corpus, "doc_id long, text string, lang string").repartition(7))
    counts, sizes = {}, {}
    for _, text, lang in corpus:
        sizes[lang] = sizes.get(lang, 0) + 1
        for g in set(plain_grams(text)):
            counts.setdefault(g, {}).setdefault(lang, 0)
            counts[g][lang] += 1
    sets = {v: set() for v in sizes}
    for g, own in counts.items():
        shares = {v: n / sizes[v] for v, n in own.items() if n * li.COMMON >= sizes[v]}
        for v, share in shares.items():
            if share >= li.RIVAL * max(shares.values()):
                sets[v].add(g)
    assert model.languages == tuple(sorted(sizes)) and (model.false_share < 0.02).all()
    for _, text, _ in corpus[:200]:
        grams = plain_grams(text)
        n, found = model.counts(text)
        want = np.array([sum(g in sets[v] for g in grams) for v in model.languages])
        assert n == len(grams) and (found >= want).all() and (found - want <= 3 + 0.05 * n).all()


def test_held_out_accuracy(spark, corpus):
    data = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    out = li.predicted(data.withColumn("score", F.lit("taken")), li.fitted(data, F.col("doc_id") % 3 != 1)).filter("doc_id % 3 = 1 AND doc_id % 25 <> 0").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_awkward_rows(spark, docs, nothing, corpus):
    data = spark.createDataFrame([*corpus, (None, "ta ta ta", None), (7, None, "aa"), (8, "", "bb")], "doc_id long, text string, lang string")
    model = li.fitted(data)
    out = li.predicted(docs.withColumn("lang_pred", F.lit(1)), model).collect()
    assert len(out) == docs.count()
    by_text = {}
    for r in out:
        none = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und" and r.score == 0) if none else r.lang_pred in model.languages
        by_text.setdefault(r.text, set()).add((r.lang_pred, r.score))
    assert all(len(s) == 1 for s in by_text.values())
    assert li.predicted(nothing, model).count() == 0
    assert [r.lang_pred for r in li.predicted(data.limit(2), li.fitted(nothing)).collect()] == ["und", "und"]
    assert model.predict("漢字") == (model.fallback, 0.0)


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(9)
    rows = [(100 * k + i, " ".join(chr(0x4E00 + 7 * k + rng.randrange(7)) * 2 for _ in range(30)), f"l{k:03d}") for k in range(70) for i in range(3)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fitted(data)
    assert model.rows.shape[1] == 2
    assert all(r.lang_pred == r.lang for r in li.predicted(data, model).collect())
