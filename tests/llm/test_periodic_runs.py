"""Runs against brute force over all periods, trees against plain comparison."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from signalbox.llm import periodic_runs as pr
from signalbox.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, exponent=3):
    """Maximal stretches for each period, the smallest one kept where several fit."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                if not any(p < q and q % p == 0 and s <= i and i + (j - i + q) <= s + size for s, size, p in found):
                    found.append((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sample(rng, kind):
    size = rng.randint(0, 140)
    if kind == 0:
        return [rng.choice("ab") for _ in range(size)]
    if kind == 1:  # periodic parts of random texts
        out = []
        while len(out) < size:
            root = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
            out += (root * 30)[: rng.randint(1, 60)] + [f"x{rng.randrange(99)}" for _ in range(rng.randint(0, 3))]
        return out
    if kind == 2:  # Fibonacci words have very many runs
        a, b = ["a"], ["a", "b"]
        while len(b) < size:
            a, b = b, b + a
        return b[: size + 1]
    out = ["a"] * size
    if size:
        out[rng.randrange(size)] = "b"
    return out


@pytest.mark.parametrize("kind", range(4))
def test_runs_against_brute_force(kind):
    rng = random.Random(kind)
    for least, exponent in ((24, 3), (4, 2), (1, 2), (6, 3)):
        for _ in range(60):
            words = sample(rng, kind)
            found = [tuple(r) for r in pr.runs_of([w.encode() for w in words], least, exponent).tolist()]
            assert found == plain_runs(words, least, exponent), (words, least, exponent)


def test_tree_extensions():
    rng = random.Random(7)
    for _ in range(30):
        s = [rng.randrange(3) for _ in range(rng.randint(1, 200))] + [9]
        tree = pr.SuffixTree(s)
        assert np.argsort(tree.place).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j][:4000]
        i, j = np.array(pairs or [(0, 0)]).T
        if pairs:
            want = [next(k for k in range(len(s)) if s[a + k] != s[b + k]) for a, b in pairs]
            assert tree.common(i, j).tolist() == want


def test_range_minimum():
    values = np.random.default_rng(1).integers(0, 1000, 1000)
    minimum = pr.RangeMinimum(values)
    a = np.repeat(np.arange(0, 1000, 7), 50)
    b = np.minimum(999, a + np.tile(np.arange(50) ** 2 // 2, len(a) // 50))
    assert minimum(a, b).tolist() == [values[x : y + 1].min() for x, y in zip(a, b, strict=True)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    figures = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *figures, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_against_brute_force(spark, docs, texts, tmp_path):
    rng = random.Random(6)
    more = [(1000 + i, " ".join(sample(rng, i % 4)), None, None, 1, 1, 0.0, True) for i in range(400)]
    more += [(2000 + i, rng.choice([t for t in texts if t]), None, None, 1, 1, 0.0, True) for i in range(100)]
    table = docs.union(spark.createDataFrame(more, docs.schema))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = [plain_row(r.doc_id, r.text) for r in table.collect()]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert sum(w[1] for w in want) > 100


def test_operator_on_awkward_rows(docs, nothing):
    out = pr.with_runs(docs).collect()
    assert len(out) == docs.count() and {"source", "n_chars", "kept"} <= out[0].asDict().keys()
    by_text = {r.text: r for r in out}
    assert by_text["word " * 60].collapsed == "word" and by_text[None].runs == [] and by_text[None].collapsed == ""
    assert pr.with_runs(nothing).count() == 0


def test_very_long_text():
    words = [b"%d" % (k % 7) for k in range(100_000)] + [b"end"] + [b"x", b"y"] * 50_000
    assert pr.runs_of(words).tolist() == [[0, 100_000, 7], [100_001, 100_000, 2]]
    assert len(pr.collapsed(words, pr.runs_of(words)).split()) == 10
