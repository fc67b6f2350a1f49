"""Fill-in-the-middle against a plain rewrite with string slices."""

import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from signalbox.llm import fill_in_middle as fim

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_rewrite(doc_id, text):
    text = text or ""
    key = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(key[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_slices(spark, docs, nothing):
    rng = random.Random(4)
    tricky = ["<P>", "x<S>y", "<M", "<", "<P", ">", "P>", "<P<S<M", "S>M>P>" * 5, "a", " ", "é", "\x00\n\r", "🙂a🙂b", "ſKÅ", "[`{@", "áb"]
    rows = [(1000 + 40 * k + i, t) for k, t in enumerate(tricky) for i in range(40)]
    rows += [(5000 + i, "".join(rng.choice("<PSM> aZ\n9é") for _ in range(rng.randint(0, 30)))) for i in range(2000)]
    rows += [(9000 + i, "".join(rng.choice("ab c") for _ in range(200_000))) for i in range(3)]
    table = docs.select("doc_id", "text", "n_chars").union(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(1)))
    given = [(r.doc_id, r.text) for r in table.collect()]
    found = fim.transformed(table.withColumn("form", F.lit("taken"))).collect()
    want = collections.Counter((i, *plain_rewrite(i, t)) for i, t in given)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found) == want
    assert all(r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(r.text or "") for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"} and found[0].asDict().keys() >= {"n_chars"}
    assert fim.transformed(nothing).count() == 0


def test_piece_table_shares_its_text():
    table = fim.PieceTable("one two three")
    parts = fim.cut(table, 3, 7)
    assert [p.length for p in parts] == [3, 4, 6]
    for form in fim.ARRANGEMENTS:
        made = fim.arrange(table, parts, form)
        assert made.buffers[fim.TEXT] is table.buffers[fim.TEXT] and len(made.pieces) == 6
        assert made.sha256() == sha(made.text()) and "".join(made.chunks(2)) == made.text()
        assert fim.restore(made.text(), form).text() == "one two three"
    assert fim.unit_starts("ab1 cé").tolist() == [0, 2, 3, 4, 5, 6] and fim.unit_starts("").tolist() == [0]
