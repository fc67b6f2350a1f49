"""URL filter by rules and, where no rule fits, by a character language-model ratio.

Two smoothed variable-order Markov models over characters, one of accepted and one of rejected URLs
(those that a rule decides), give each URL a log-likelihood difference per character. A threshold
calibrated on labelled URLs that the models have not seen turns it into a verdict.

Smoothing: from the uniform distribution up to contexts of ``ORDER`` characters, each order mixes its
relative frequency with the order below, by the number of different characters seen after the context.
URLs are reduced to a small alphabet first (A-Z lower-cased, runs of digits one ``0``, other characters
``~``), so the model tables cannot exceed ``len(ALPHABET) ** (ORDER + 1)`` rows whatever the input, and
equal reduced URLs are scored once. All of it is DataFrame operations.

Edge cases: a null url or one without ``://`` has empty host and path, fits no rule and is judged as the
empty string; without labelled URLs of both kinds the threshold is 0 and equal likelihoods are allowed;
repeated rows are judged alike; further columns are kept, except those named like a result, which are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.llm.common import LOWER_LETTERS, UPPER_LETTERS, stored

# Fixed rules: verdict, host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_?=&#~"
ORDER, BINS = 3, 100
#: First hexadecimal digits of the md5 of reduced URLs that calibrate the threshold instead of training.
CALIBRATION = ("0", "1", "2")
RESULTS = ("host", "path", "rule", "verdict", "score")


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER_LETTERS, LOWER_LETTERS)


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host``, ``path`` and ``_rest``, the url after the first ``://``."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(F.col("url"), at + 3)).otherwise("")
    raw = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(F.col("_rest"), F.length(raw) + 1), r"^[^?#]*", 0)
    return pages.withColumn("_rest", rest).withColumns({"host": _lower(raw), "path": path})


def with_rule(parts: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` (host and path, null where none fits) and ``verdict`` of the longest rule that fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return parts.withColumns({"rule": rule, "verdict": verdict})


def _reduced() -> Column:
    text = F.regexp_replace(_lower(F.col("_rest")), r"[0-9]+", "0")
    return F.regexp_replace(text, r"[^a-z0./\-_?=&#]", "~")


def _grams(strings: DataFrame) -> DataFrame:
    """A row per string and distinct (context of ORDER characters, next character), ``_n`` times."""
    padded = F.concat(F.lit("^" * ORDER), F.col("_text"), F.lit("$"))
    at = F.explode(F.sequence(F.lit(1), F.length("_text") + 1))
    gram = F.substr(F.col("_padded"), F.col("_at"), F.lit(ORDER + 1))
    return strings.withColumn("_padded", padded).withColumn("_at", at).withColumn("_gram", gram).groupBy("_text", "_gram").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_good").alias("_good"), F.first("_bad").alias("_bad"))


def _ratios(grams: DataFrame, train: Column) -> DataFrame:
    """``_gram`` and ``_llr``, log probability ratio of its last character after the others."""
    seen = grams.groupBy("_gram").agg(*(F.coalesce(F.sum(F.when(train, F.col(c) * F.col("_n"))), F.lit(0)).alias(c) for c in ("_good", "_bad")))
    out = seen.select("_gram", *(F.lit(1.0 / (len(ALPHABET) + 1)).alias(p) for p in ("_p_good", "_p_bad")))
    for k in range(ORDER + 1):
        tail = F.substr(F.col("_gram"), F.lit(ORDER - k + 1))
        counts = seen.groupBy(tail.alias("_tail")).agg(F.sum("_good").alias("_c_good"), F.sum("_bad").alias("_c_bad"))
        context = F.expr(f"substr(_tail, 1, {k})")
        after = counts.groupBy(context.alias("_context")).agg(
            *(F.sum(f"_c_{c}").alias(f"_s_{c}") for c in ("good", "bad")), *(F.count_if(F.col(f"_c_{c}") > 0).alias(f"_t_{c}") for c in ("good", "bad")))
        level = counts.withColumn("_context", context).join(after, "_context").drop("_context")
        out = out.withColumn("_tail", tail).join(level, "_tail")
        for c in ("good", "bad"):
            mixed = (F.col(f"_c_{c}") + F.col(f"_t_{c}") * F.col(f"_p_{c}")) / (F.col(f"_s_{c}") + F.col(f"_t_{c}"))
            out = out.withColumn(f"_p_{c}", F.when(F.col(f"_s_{c}") > 0, mixed).otherwise(F.col(f"_p_{c}")))
        out = out.select("_gram", "_p_good", "_p_bad")
    return out.select("_gram", (F.log("_p_good") - F.log("_p_bad")).alias("_llr"))


def scored(strings: DataFrame) -> DataFrame:
    """``_text``, ``_good``, ``_bad``, ``_held`` and ``score``, the mean log-likelihood difference of its characters."""
    held = F.substring(F.md5("_text"), 1, 1).isin(*CALIBRATION)
    grams = _grams(strings)
    ratios = _ratios(grams, ~held)
    total = grams.join(ratios, "_gram").groupBy("_text").agg(
        F.sum(F.col("_n") * F.col("_llr")).alias("_sum"), F.sum("_n").alias("_length"), F.first("_good").alias("_good"), F.first("_bad").alias("_bad"))
    return total.select("_text", "_good", "_bad", held.alias("_held"), (F.col("_sum") / F.col("_length")).alias("score"))


def threshold(scores: DataFrame) -> float:
    """The score from which on URLs are allowed, with the least mean error rate on held-out labelled URLs."""
    # a bounded number of bins: scores are means of logarithms of smoothed probabilities, clipped to +-20
    bins = scores.filter("_held").groupBy(F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score"))) * BINS).alias("bin")).agg(
        F.sum("_good").alias("good"), F.sum("_bad").alias("bad"))
    below, everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    lost = F.try_divide(F.coalesce(F.sum("good").over(below), F.lit(0)), F.sum("good").over(everything))
    passed = 1 - F.try_divide(F.coalesce(F.sum("bad").over(below), F.lit(0)), F.sum("bad").over(everything))
    best = bins.select("bin", (lost + passed).alias("error")).filter("error IS NOT NULL").agg(F.min_by("bin", F.struct("error", F.abs("bin"), "bin"))).first()
    return 0.0 if best[0] is None else best[0] / BINS


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Rows of ``pages`` (which has ``url``) with ``host``, ``path``, ``rule``, ``verdict`` and ``score``."""
    parts = with_rule(with_parts(pages.drop(*RESULTS)), rules).withColumn("_text", _reduced())
    strings = parts.groupBy("_text").agg(F.count_if(F.col("verdict") == "allow").alias("_good"), F.count_if(F.col("verdict") == "block").alias("_bad"))
    scores = stored(scored(stored(strings, "url-strings")), "url-scores")
    limit = threshold(scores)
    by_method = F.when(F.col("score") >= limit, "allow").otherwise("block")
    out = parts.join(scores.select("_text", "score"), "_text", "left")
    return out.withColumn("verdict", F.coalesce("verdict", by_method)).drop("_rest", "_text")
