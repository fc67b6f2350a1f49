"""Operators against brute force on a small table of awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbox.llm import boosting, common, fingerprints, jaccard_join, lm_scoring, mixing, packing, quality_model, quality_rules, toxicity, url_filter, web_archive
from signalbox.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_shingles(text):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


# --- quality rules ---

def test_quality_rules(docs, nothing):
    found = quality_rules.judge(docs).collect()
    assert len(found) == docs.count()
    for r in found:
        words = WORD.findall(r.text or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = collections.Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(5)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or "")) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)
    kept = {r.text for r in found if r.kept}
    assert not any("%%%" in t or t.startswith(("word word", "a | b")) for t in kept)
    assert quality_rules.judge(nothing).count() == 0


@pytest.mark.parametrize("line,fails", [
    ("A plain line ends here.", False), ("no mark at the end of this one", False), ("a## b%% c here", True), ("BUY!! NOW!! please", True),
    ("home | news | about us", True), ("a | b and a good many further words in one line", False), ("Read our Privacy Policy first.", True),
])
def test_line_rules(line, fails):
    assert quality_rules.line_fails(line.encode().split()) is fails
    assert quality_rules.cleaned(f"Good text.\n{line}\n") == ("Good text.\n" if fails else f"Good text.\n{line}\n")


# --- boosting, quality, toxicity ---

def test_boosting_learns_and_orders():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(int)
    trees = boosting.fit(x[:1500], y[:1500])
    assert ((trees.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert len(set(boosting.fit(x, np.ones(len(x))).probability(x))) == 1
    assert boosting.fit(np.zeros((0, 5)), np.zeros(0)).probability(x[:2]).tolist() == [0.5, 0.5]


def test_isotonic_is_the_best_rising_fit():
    x, y = np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1])
    knots, values = boosting.isotonic(x, y)
    assert (np.diff(values) > 0).all() and abs(np.interp(1, knots, values)) < 1e-9
    assert np.interp(5, knots, values) == 1


def test_quality_scores(docs, nothing, labels):
    out = quality_model.scored(docs, quality_model.fitted(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    by_text = collections.defaultdict(set)
    for r in out:
        by_text[r.text or ""].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert quality_model.scored(nothing, quality_model.fitted(nothing, labels)).count() == 0


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(2)
    plain = ["the", "tree", "house", "river", "you", "walk", "stone", "green", "cloud", "your"]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "Idiot!", "grumf", "grumfling", "grumfed"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    rows += [(1000, None, 0), (1001, "", 0), (None, "you idiot", 1), (1002, "x" * 100_000, 0)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0
    out = toxicity.scored(data.withColumn("score", F.lit("taken")), toxicity.fitted(data.drop("toxic"), data.select("doc_id", "toxic"), train)).filter("doc_id % 3 = 0").collect()
    assert sum(r.predicted == r.toxic for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.undisguised("1d10-t") == "idiot"


# --- fingerprints ---

def test_fingerprints(docs, nothing):
    found = fingerprints.edited_likeness(docs).collect()
    rows = sorted(((-(2**63) if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()))
    assert len(found) == len(rows)
    want = collections.Counter()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        want[None if i < 0 else i, len(text), hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert fingerprints.edited_likeness(nothing).count() == 0


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    whole, half = " ".join(words), " ".join(words[:4500])
    a, b = fingerprints.sketch(whole), fingerprints.sketch(half)
    one, two = plain_shingles(whole), plain_shingles(half)
    assert abs(fingerprints.resemblance(a, b) - len(one & two) / len(one | two)) < 0.12
    assert abs(fingerprints.distinct(a) / len(one) - 1) < 0.25 and fingerprints.containment(b, a) > 0.95
    assert fingerprints.decoded(fingerprints.encoded(a)).tolist() == a.tolist()
    parts = spark.createDataFrame([("k", whole[: len(whole) // 2]), ("k", whole[len(whole) // 2 :]), ("empty", ""), (None, "a b")], "key string, text string")
    merged = {r.key: r.fingerprint for r in fingerprints.merged(fingerprints.fingerprinted(parts), "key").collect()}
    halves = [fingerprints.sketch(t) for t in (whole[: len(whole) // 2], whole[len(whole) // 2 :])]
    assert merged["k"] == fingerprints.encoded(fingerprints.merge(*halves))
    short = "a b c d e f g"
    assert fingerprints.resemblance(fingerprints.sketch(short), fingerprints.sketch("a b c d e f x")) == pytest.approx(2 / 4)
    assert fingerprints.resemblance(fingerprints.sketch(""), fingerprints.sketch(None)) == 1


# --- language model ---

def test_lm_base_score_and_gain(docs, nothing):
    crc = common.crc_of_id()
    got = lm_scoring.scored(docs, crc % 7 == 2, F.floor(crc / 7) % 3 == 0).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = lambda t: [*(t or "").encode().translate(common.LOWER).split(), "end"]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
        want[i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got) and sum(r.score - r.base_score for r in got) > 0
    assert lm_scoring.scored(nothing, F.lit(False), F.lit(True)).count() == 0


def test_lm_without_training_is_uniform(docs):
    assert all(abs(r.score) < 1e-9 and r.n_known == 0 for r in lm_scoring.scored(docs, F.lit(True), F.lit(True)).collect())


def test_integers_survive_squeezing():
    values = np.array([0, 1, 2**63, 5, 2**64 - 1], np.uint64)
    assert lm_scoring.unsqueezed(lm_scoring.squeezed(values), np.uint64).tolist() == values.tolist()


# --- url filter ---

@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://x.net/es/2#top", "x.net", "/es/2", "net/es/", "block"),
    ("http://com", "com", "", None, None), (None, "", "", None, None), ("no scheme.com/", "", "", None, None), ("a://b?c://d", "b", "", None, None),
])
def test_url_rules(spark, url, host, path, rule, verdict):
    row = url_filter.with_rule(url_filter.with_parts(spark.createDataFrame([(1, url)], "page_id long, url string"))).first()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_url_model_separates(spark):
    rng = random.Random(3)
    rows = [(i, f"http://{rng.choice(['alpha', 'beta', 'gamma'])}{i}.com/page-{i}") for i in range(120)]
    rows += [(200 + i, f"http://q{i}.net/es/zzxq{i % 7}/qzx") for i in range(120)]
    rows += [(500, "http://betagamma.org/page-9"), (501, "http://w.org/es/zzxq3/qzx"), (502, None), (503, None)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    assert len(got) == len(rows) and got[500] == "allow" and got[501] == "block" and got[502] == got[503]
    assert url_filter.judge(pages.limit(0)).count() == 0
    one_kind = url_filter.judge(pages.filter("page_id < 100")).collect()
    assert len(one_kind) == 100 and {r.verdict for r in one_kind} == {"allow"}


# --- packing ---

def test_packing_round_trip(docs, nothing):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    real, want = Tokenizer.from_file(path("word_bpe_49k.json")), collections.Counter()
    for r in docs.collect():
        ids = [*real.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want[r.doc_id, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.packed(docs, sequence=64).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by_sequence) <= 1.06 * sum(r.length for r in got) / 64 + 1
    assert packing.packed(nothing).count() == 0


def test_word_tokens_equal_the_tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    real, mine = Tokenizer.from_file(path("word_bpe_49k.json")), packing.WordTokens(path("word_bpe_49k.json"))
    texts = [f"one a{chr(c)}b two" for c in range(1, 0x3100)] + ["a\x1cb", "\x1f", "J\u030c", "some J\u030c words", "T\u0308 W\u030a Y\u030a H\u0331", "\u0130\u0307 \u01c5"]
    texts += [f"{chr(c)}{m}x" for c in range(65, 0x250) for m in "\u0300\u0301\u0308\u030a\u030c\u0331"]
    wrong = [t for t in texts if np.frombuffer(mine.ids(t), "<u4").tolist() != real.encode(t, add_special_tokens=False).ids]
    assert not wrong


def test_word_cache_stays_bounded_and_exact(monkeypatch):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    real, mine = Tokenizer.from_file(path("word_bpe_49k.json")), packing.WordTokens(path("word_bpe_49k.json"))
    heads = ["and", "it's", "naïve", "x1", "12", "don't", "a_b", "\xaa\xb5", "Σας", "...", "日本", "e\x07", "soft\xadly"]
    for text in [" ".join(f"{h}{chr(97 + k % 26)}{m}" for h in heads for m in ["", ",", ".", "'", "'s", "7", "!?", "é", "\xad", "\x7f"] for k in range(30)), ", .,. ' 's 're' ''s"]:
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids
        assert len(mine.words) <= 20


def test_pattern_cuts_few_words(monkeypatch):
    from public_tokenizers import path

    class Pattern:
        cut = []

        def findall(self, word, real=packing.PARTS):
            self.cut.append(word)
            return real.findall(word)

    monkeypatch.setattr(packing, "PARTS", Pattern())
    assert packing.WordTokens(path("word_bpe_49k.json")).ids("Plain words, naïve ones. And some, more: (these) here")
    assert not [w for w in Pattern.cut if w.isalpha() or w[:-1].isalpha()] and "(these)" in Pattern.cut


def test_workers_hold_no_tokens_after_packing(docs):
    import gc

    def held(batches):
        for b in batches:
            yield b.assign(id=sum(isinstance(x, packing.WordTokens) for x in gc.get_objects()))

    assert packing.pieces(docs).count() > 0
    spark = docs.sparkSession
    assert {r.id for r in spark.range(0, 64, 1, 16).mapInPandas(held, "id long").collect()} == {0}


def test_sum_of_squares_step():
    numbers, offsets = packing.place(np.array([6, 6, 4, 4, 10, 3]), 10)
    assert numbers.tolist()[:2] == [0, 1] and sorted(numbers.tolist()[2:4]) == [0, 1] and offsets.tolist()[2:4] == [6, 6]
    assert numbers[4] == 2 and numbers[5] == 3


# --- web archives ---

def test_archive_round_trip(spark):
    long = "<p>été 日本</p>" * 120
    rows = [(1, "http://a/ b\n", long), (2, None, long), (2, "http://x", long), (3, "http://c", "WARC/1.0\r\n\r\nfiledesc://x 1\n\n"), (4, "http://d", None), (None, "http://e", ""), (5, "http://f", "small"), (6, "http://g", "small"), (7, "-", "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload string").repartition(3)
    back = web_archive.converted(spark, pages).collect()
    assert len(back) == len(rows)
    for r in back:
        texts = {(p or "").encode() for i, _, p in rows if i == r.page_id}
        assert r.payload_digest in {hashlib.sha1(t).hexdigest() for t in texts} and r.payload_bytes in set(map(len, texts))
        if r.record_type == "response":
            assert bytes(r.payload) in texts and r.refers_to is None
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in back)
    assert kinds[1, "revisit", 2] == 1 and kinds[2, "response", None] == 2 and kinds[5, "response", None] == kinds[6, "response", None] == 1
    assert web_archive.converted(spark, pages.limit(0)).count() == 0


def test_arc_versions():
    for version in (1, 2):
        data = web_archive.arc_version_block(version).encode() + b"\n" + web_archive.arc_record(version, 7, "http://a b/", "é\n").encode() + b"\n"
        (record,) = web_archive.arc_records(data)
        assert (record[0], record[1], record[2], record[8]) == (7, version, "http://a%20b/", "é\n".encode())
    with pytest.raises(ValueError):
        list(web_archive.arc_records(b"http://a 0.0.0.0 20000101000000 text/html 99\nshort\n"))
    with pytest.raises(ValueError):
        list(web_archive.arc_records(b"http://a too few\n\n"))


# --- Jaccard join ---

def plain_groups(rows):
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return collections.Counter((doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


def test_join_matches_brute_force(docs, nothing):
    got = jaccard_join.joined(docs).collect()
    assert collections.Counter(map(tuple, got)) == plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard_join.joined(nothing).count() == 0


def hot_pair(rng, big):
    """Texts of which the first two are similar, while just the segments that both of them list are hot."""
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    small = rng.randint(16, 20)
    large = rng.randint(21, min(26, 4 * small // 3))
    words = fill(large + 4)
    texts = [" ".join(words[: small + 4]), " ".join(words)]
    sets = [common.shingles_of(t) for t in texts]
    (sig_a, _), (sig_b, _) = map(jaccard_join.signatures, sets)
    for sig in np.intersect1d(sig_a, sig_b):
        # the windows of words that make up the segment, each in a text of its own kind
        single = [common.shingles_of(" ".join(words[k : k + 5]))[0] for k in range(small)]
        parts = [k for k in range(small) if sig not in jaccard_join.signatures(np.array(sorted(set(sets[0].tolist()) - {int(single[k])}), np.uint64))[0]]
        made = 0
        for _ in range(400):
            text = []
            for k in parts:
                text += fill(rng.randint(1, 3)) + words[k : k + 5]
            text += fill(max(0, rng.randint(20, 30) - len(text)))
            h = common.shingles_of(" ".join(text))
            if 16 <= len(h) < 32 and sig in jaccard_join.signatures(h)[0]:
                texts.append(" ".join(text))
                made += 1
                if made > big:
                    break
    return texts


def test_join_when_just_the_shared_segments_are_hot(spark):
    rows = []
    # some of any shape, and seeds whose shared segments exceed the spare ones of just one of the two
    for seed in [1, 2, 3, 4, 118, 281, 581, 672, 722, 867, 2111, 2604]:
        rows += hot_pair(random.Random(seed), jaccard_join.HOT + 1)
    rows = [(i, t) for i, t in enumerate(rows)]
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert collections.Counter(map(tuple, got)) == plain_groups(rows)


def test_join_of_many_rows_without_an_id(spark):
    """Rows without an id, and rows of one id, are compared by their texts alone."""
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(3000)]
    rows = [(None if i % 3 else 7, t) for i, t in enumerate(texts)] + [(None, t + " more") for t in texts[:300]]
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    named = collections.Counter((r.doc_id, r.component_id) for r in got)
    assert len(got) == 3300 and named == {(7, 7): 1000, (None, 7): 100, (None, None): 2200}


def test_join_with_hot_groups(spark):
    """Many copies of one text, a passage in many texts, chains of similar texts: more sets than a hot segment has."""
    rng = random.Random(6)
    fresh = lambda n: [f"v{rng.randrange(10**5)}" for _ in range(n)]
    root, passage, rows = fresh(80), fresh(50), []
    for _ in range(30):
        copy = list(root)
        copy[rng.randrange(80)] = fresh(1)[0]
        rows.append(copy)
    for n in [*range(8, 38), *range(60, 70)]:
        rows.append(fresh(n // 2) + passage + fresh(n - n // 2))
    rows += [[*passage, *fresh(6)] for _ in range(15)]
    chain = fresh(120)
    for _ in range(8):
        chain = chain[6:] + fresh(6)
        rows.append(chain)
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9):
        base = fresh(size + 4)
        rows += [base, [*base[:-1], *fresh(1)], base + fresh(1)]
    rng.shuffle(rows)
    pairs = [(i, " ".join(r)) for i, r in enumerate(rows)]
    got = jaccard_join.joined(spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)).collect()
    assert collections.Counter(map(tuple, got)) == plain_groups(pairs)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        x = np.unique(rng.integers(0, 2**64, int(np.exp(rng.uniform(0, 6))), dtype=np.uint64))
        gone = int(rng.integers(0, len(x) // 4 + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**64, int(rng.integers(0, len(x) // 4 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            (a, beyond_a), (b, beyond_b) = jaccard_join.signatures(x), jaccard_join.signatures(y)
            shared = np.intersect1d(a, b)
            assert len(shared) >= 1
            if min(*beyond_a, *beyond_b) > 0:
                assert max(np.bincount((shared & np.uint64(63)).astype(int))) >= 1 + min(*beyond_a, *beyond_b)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (9, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing ---

def test_mix_hits_targets(docs, nothing, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count() and all(r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 2 * r.size for r in got)
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, capped, budget = {}, set(), 1.5 * sum(sizes.values())
    while True:
        left = budget - sum(2 * sizes[s] for s in capped)
        want = {s: 2 * sizes[s] if s in capped else left * weights[s] / sum(w for o, w in weights.items() if o not in capped) for s in order}
        over = {s for s in order if want[s] > 2 * sizes[s] + 1e-9} - capped
        if not over:
            break
        capped |= over
    for s in order:
        assert targets[s] == pytest.approx(want[s], abs=1e-5) and taken[s] == math.floor(targets[s] + 1e-9)
    again = collections.Counter((r.doc_id, r.size, r.taken) for r in mixing.mixed(docs.repartition(2)).collect())
    assert again == collections.Counter((r.doc_id, r.size, r.taken) for r in got)
    words = sum(len(WORD.findall(r.text)) for r in mixing.copies(docs).collect())
    assert words == sum(taken.values()) and mixing.copies(docs).columns == docs.columns
    assert mixing.mixed(nothing).count() == 0
