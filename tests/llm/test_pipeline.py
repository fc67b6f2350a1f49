"""The pipeline on a small table, and the registered queries against their SQL."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import plain_shingles
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(docs, labels, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("corpus"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{out}/documents.parquet")
    labels.write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], folder)
        assert out.columns == docs.columns
        kept.append(out.cache())
    start, clean, good, single, mixed = ([(r.doc_id, r.text) for r in df.collect()] for df in kept)
    assert set(clean) < set(start) and set(good) <= set(clean) and set(single) <= set(good)
    assert not any("%%%" in t for _, t in clean)
    assert sorted(map(repr, single)) == sorted(map(repr, plain_single(good)))
    taken, sizes = collections.Counter(mixed), collections.Counter(single)
    assert set(taken) <= set(single) and all(taken[k] <= 2 * sizes[k] for k in taken)  # whole texts only
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in mixed}


def plain_single(rows):
    """One row of each component of similar texts, by brute force over rows, with or without ids."""
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    groups = collections.defaultdict(list)
    for k, row in enumerate(rows):
        groups[root[k]].append(row)
    # among rows of the least id the operator takes any one text; the fixtures have one only
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_near_duplicates_by_row(spark, texts):
    """Ids that repeat with other texts, copies without an id, copies that share one: a row of each component stays."""
    words = texts[0].split(" ")
    near = " ".join(words[:-1] + ["otherwise."])
    rows = [(1, texts[2]), (5, texts[0]), (5, texts[3]), (3, texts[3] + " again"), (None, texts[6]), (None, texts[6]), (None, texts[7]), (9, near), (9, texts[0]), (12, texts[2]), (12, texts[8])]
    data = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, data.repartition(3), "")
    assert got.columns == data.columns
    assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == sorted(map(repr, plain_single(rows)))


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


@pytest.mark.parametrize("name", ["op5_url_filter", "op7_web_archive", "op8_quality_rules", "op9_ngram_jaccard_join", "op10_source_mixing", "op13_fill_in_middle"])
def test_query_matches_sql(spark, name):
    good, message = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SF, connect(SF))
    assert good, message


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
