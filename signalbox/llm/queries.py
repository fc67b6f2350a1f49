"""The registered queries over the dealt operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm import common, fill_in_middle, fingerprints, jaccard_join, language_id, lm_scoring, mixing, packing, periodic_runs, quality_model, quality_rules, toxicity, url_filter, web_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@registered
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


SQL["op8_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), windows AS (
  SELECT r, p, words[p] || chr(10) || words[p + 1] || chr(10) || words[p + 2] || chr(10) || words[p + 3] || chr(10) || words[p + 4] AS win
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 1))) AS p FROM w)
), repeated AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM repeated) GROUP BY r
), lines AS (
  SELECT r, p, ls[p] AS line, regexp_extract_all(ls[p], '[^\x20\x09-\x0D]+') AS own
  FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT r, string_split(text, chr(10)) AS ls FROM w))
), judged AS (
  SELECT r, line, len(own) AS n, row_number() OVER (PARTITION BY r, line ORDER BY p) > 1 AS dup,
         100 * len(list_filter(own, lambda x: regexp_matches(x, '[#*$%&|<>~^=]$'))) >= 50 * len(own)
         OR 100 * len(list_filter(own, lambda x: suffix(x, '!!'))) >= 50 * len(own)
         OR (len(list_filter(own, lambda x: x IN ('|', '>', '»', '·'))) >= 2
             AND 100 * len(list_filter(own, lambda x: x IN ('|', '>', '»', '·'))) >= 30 * len(own))
         OR (len(own) <= 30 AND regexp_matches(lower(array_to_string(own, ' ')),
             'accept all cookies|cookie policy|enable javascript|javascript is disabled|lorem ipsum|privacy policy|sign up for our newsletter|skip to content|terms of use|terms of service')) AS fails
  FROM lines WHERE len(own) > 0
), by_doc AS (
  SELECT r, count(*) FILTER (WHERE dup) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE fails), 0)::BIGINT AS lost_words FROM judged GROUP BY r
), stats AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM w LEFT JOIN covered USING (r) LEFT JOIN by_doc USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - lost_words) >= 50 * n_words AS kept
FROM stats
"""


@registered
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", *mixing.RESULTS)


SQL["op10_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s, md5('mix-' || coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), src AS (
  SELECT s, sum(size)::DOUBLE AS source_size, ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY s) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY s
), ranked AS (
  SELECT *, 2 * source_size AS cap, sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, s ROWS UNBOUNDED PRECEDING) AS used,
         sum(w) OVER () - sum(w) OVER (ORDER BY 2 * source_size / w, s ROWS UNBOUNDED PRECEDING) AS rest,
         1.5 * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w
  FROM src
), level AS (
  SELECT greatest(max(CASE WHEN rest > 0 THEN (budget - used) / rest END), max(budget / all_w)) AS lam FROM ranked
), t AS (
  SELECT s, source_size, round(least(cap, w * lam), 6) AS target FROM ranked CROSS JOIN level
), p AS (
  SELECT doc_id, size, source_size::BIGINT AS source_size, target, floor(target)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY s ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t USING (s)
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""


@registered
def op7_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))
    back = web_archive.converted(spark, pages)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op7_web_archive"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), s AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM s
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""


@registered
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _url_sql() -> str:
    level = "SELECT gram, 1.0::DOUBLE / 37 AS pg, 1.0::DOUBLE / 37 AS pb FROM seen"
    tables = []
    for k in range(url_filter.ORDER + 1):
        tables.append(f"c{k} AS (SELECT substr(gram, {url_filter.ORDER - k + 1}) AS tail, sum(good) AS g, sum(bad) AS b FROM seen GROUP BY 1)")
        tables.append(f"s{k} AS (SELECT substr(tail, 1, {k}) AS ctx, sum(g) AS sg, sum(b) AS sb, count(*) FILTER (WHERE g > 0) AS tg, count(*) FILTER (WHERE b > 0) AS tb FROM c{k} GROUP BY 1)")
        tables.append(f"""p{k} AS (SELECT gram, CASE WHEN sg > 0 THEN (g + tg * pg) / (sg + tg) ELSE pg END AS pg, CASE WHEN sb > 0 THEN (b + tb * pb) / (sb + tb) ELSE pb END AS pb
          FROM ({level}) q JOIN c{k} ON tail = substr(gram, {url_filter.ORDER - k + 1}) JOIN s{k} ON ctx = substr(tail, 1, {k}))""")
        level = f"SELECT * FROM p{k}"
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), q AS (
  SELECT page_id, rest, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(kind, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), parts AS (
  SELECT page_id, host, path, max_by(rules.h || rules.p, length(rules.h || rules.p)) AS rule, max_by(kind, length(rules.h || rules.p)) AS kind,
         any_value(regexp_replace(regexp_replace(translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^a-z0./\-_?=&#]', '~', 'g')) AS t
  FROM q LEFT JOIN rules ON (host = rules.h OR suffix(host, '.' || rules.h)) AND starts_with(path, rules.p) GROUP BY page_id, host, path
), strings AS (
  SELECT t, count(*) FILTER (WHERE kind = 'allow') AS good, count(*) FILTER (WHERE kind = 'block') AS bad FROM parts GROUP BY t
), held AS (
  SELECT t, good, bad, substr(md5(t), 1, 1) IN ('0', '1', '2') AS held FROM strings
), grams AS (
  SELECT t, good, bad, held, substr('^^^' || t || '$', i, 4) AS gram FROM (SELECT *, unnest(range(1, length(t) + 2)) AS i FROM held)
), seen AS (
  SELECT gram, coalesce(sum(good) FILTER (WHERE NOT held), 0)::DOUBLE AS good, coalesce(sum(bad) FILTER (WHERE NOT held), 0)::DOUBLE AS bad FROM grams GROUP BY gram
), {", ".join(tables)}, scores AS (
  SELECT t, any_value(good) AS good, any_value(bad) AS bad, any_value(held) AS held, sum(ln(pg) - ln(pb)) / count(*) AS score
  FROM grams JOIN p{url_filter.ORDER} USING (gram) GROUP BY t
), bins AS (
  SELECT floor(greatest(-20.0, least(20.0, score)) * 100) AS bin, sum(good) AS good, sum(bad) AS bad FROM scores WHERE held GROUP BY 1
), errors AS (
  SELECT bin, coalesce(sum(good) OVER w, 0) / nullif(sum(good) OVER (), 0) + 1 - coalesce(sum(bad) OVER w, 0) / nullif(sum(bad) OVER (), 0) AS error
  FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT coalesce((SELECT bin FROM errors WHERE error IS NOT NULL ORDER BY error, abs(bin), bin LIMIT 1) / 100, 0) AS cut
)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict
FROM parts JOIN scores USING (t) CROSS JOIN cut
"""


SQL["op5_url_filter"] = _url_sql()


@registered
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


@registered
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


@registered
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    held = common.crc_of_id() % 3 == 1
    out = quality_model.scored(docs, quality_model.fitted(docs, labels, ~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


@registered
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    held = common.crc_of_id() % 4 == 2
    out = toxicity.scored(docs, toxicity.fitted(docs, labels, ~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


@registered
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT r, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[p:p + 4], ' ') END AS shingle
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), links AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.r <> y.r GROUP BY ALL) JOIN n na ON na.r = a JOIN n nb ON nb.r = b
  WHERE 100 * shared >= 75 * (na.n + nb.n - shared)
), reach AS (
  SELECT r, r AS other FROM w UNION SELECT reach.r, b FROM reach JOIN links ON a = other
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN reach USING (r) JOIN w o ON o.r = other LEFT JOIN n ON n.r = w.r GROUP BY w.r, w.doc_id
"""


@registered
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = common.crc_of_id()
    return lm_scoring.scored(docs, crc % 7 == 2, F.floor(crc / 7) % lm_scoring.SLICE == 0)


@registered
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle.transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), h AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || substr(k, 1, 8))::BIGINT AS h1, ('0x' || substr(k, 9, 8))::BIGINT AS h2,
         ('0x' || substr(k, 17, 8))::BIGINT AS h3, ('0x' || substr(k, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), s AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
"""


@registered
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = common.crc_of_id() % 3 == 1
    out = language_id.predicted(docs.select("doc_id", "text"), language_id.fitted(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Texts of which one in ten repeats its words from some word on; the others are as they are."""
    h = common.crc_of_id()
    g, n = F.floor(F.col("_h") / 10), F.size("_words").cast("long")
    # the words of chosen texts only; a text is split once, as later columns use what this one made
    split = docs.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all(common.text_of(), F.lit(f"({common.WORD})"), F.lit(1))))
    cut = split.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    rest = (n - F.col("_a")).cast("int")
    root = F.slice("_words", F.col("_a").cast("int") + 1, F.col("_p").cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(root, (F.floor(rest / F.col("_p")) + 1).cast("int"))), F.lit(1), rest)
    head = F.slice("_words", F.lit(1), F.col("_a").cast("int"))
    return cut.select("doc_id", F.when(n > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


@registered
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return periodic_runs.with_runs(docs).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
