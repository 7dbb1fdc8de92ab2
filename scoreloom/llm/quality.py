"""Quality rules in SQL functions only: counts with hard limits, then a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed token n-grams (one and two tokens) are estimated: one from trusted documents
(``labels.quality = 1``, a bounded sample by a hash of the id), one from every document at hand.  A document's score is
the mean, over its n-grams, of the log of the ratio of their probabilities; it is kept if the score reaches a fixed
threshold, so every document gets the same verdict in every run.

A repeated passage inside a text is found from a hash of every 8-word window: where all differ nothing repeats, which
settles most documents; otherwise the windows are sorted by hash and equal neighbours marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import store

from .common import DOCUMENT_COLUMNS, unsigned_mod

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
TOKEN = r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}]+)"
WINDOW = 8
BUCKETS = 1 << 14
TRUSTED = 20_000
SMOOTHING = 1.0
THRESHOLD = -0.25


def _with_counts(docs: DataFrame) -> DataFrame:
    """Adds ``n_words word_chars n_symbols n_dup_lines n_repeat_words`` to rows with a non-null ``body``."""
    trimmed = F.trim("body", F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    rows = docs.withColumn("words", words).withColumn("lines", lines)
    rows = rows.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    ).drop("words", "lines")
    runs = F.transform("hashes", lambda h, i: F.xxhash64(h, *(F.get("hashes", i + k) for k in range(1, WINDOW))))
    windows = F.when(F.size("hashes") > WINDOW, F.slice(runs, 1, F.greatest(F.lit(1), F.size("hashes") - (WINDOW - 1))))
    windows = windows.otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", windows).drop("hashes")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none))
    marked = F.transform(
        "placed",
        lambda x, k: F.when(
            (x["h"] == F.get("placed", k - 1)["h"]) | (x["h"] == F.get("placed", k + 1)["h"]), x["i"]
        ),
    )
    rows = rows.withColumn("starts", F.sort_array(F.filter(marked, lambda i: i.isNotNull()))).drop("windows", "placed")
    covered = F.transform(
        "starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW))).cast("long")
    )
    return rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("starts")


def grams(body: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all single tokens and of all tokens with the next (or the end)."""
    tokens = F.regexp_extract_all(F.lower(body), F.lit(TOKEN), F.lit(1))
    return tokens, (
        lambda name: F.concat(
            F.transform(name, lambda t: unsigned_mod(F.xxhash64(t), buckets).cast("int")),
            F.transform(name, lambda t, i: unsigned_mod(F.xxhash64(t, F.coalesce(F.get(name, i + 1), F.lit(""))), buckets).cast("int")),
        )
    )


def _with_grams(rows: DataFrame, buckets: int) -> DataFrame:
    tokens, hashed = grams(F.col("body"), buckets)
    return rows.withColumn("tokens", tokens).withColumn("grams", hashed("tokens")).drop("tokens")


def _bodies(docs: DataFrame, *extra: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"), *extra)


def gram_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED) -> DataFrame:
    """``(bucket, weight)`` for every bucket: log ratio of trusted to raw probability, smoothed.

    At most ``trusted`` distinct ids with quality 1 are used, those with the smallest hash; this bounds what is broadcast.
    Ids that are null or in no document add nothing; without trusted documents every weight is 0.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted).withColumn("good", F.lit(1))
    rows = _with_grams(_bodies(docs).join(F.broadcast(good), "doc_id", "left"), buckets)
    # The outer form: for the inner one Catalyst infers a filter on the array's size and pushes it below the projections
    # that make the array, into their lambdas, where it is evaluated again for every token.
    rows = rows.select(F.explode_outer("grams").alias("bucket"), "good")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = store(every.join(counts, "bucket", "left").na.fill(0))
    totals = counts.agg(F.sum("raw"), F.sum("target")).first()
    share = lambda n, total: F.log((F.col(n) + F.lit(SMOOTHING)) / F.lit(float(total + SMOOTHING * buckets)))
    weight = share("target", totals[1]) - share("raw", totals[0]) if totals[1] else F.lit(0.0)
    return counts.select("bucket", weight.alias("weight"))


def judge_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted: int = TRUSTED, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row the counts, ``base_failed``, ``score`` (null without a token) and ``kept``.

    A null text has no words.  Base: fewer than 20 words, or over 30 % of them in repeated 8-word windows.
    """
    weights = store(gram_weights(docs, labels, buckets, trusted))
    listed = weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("weights"))
    rows = _with_counts(_bodies(docs, *extra))
    rows = _with_grams(rows, buckets).withColumn("weights", listed.scalar())
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get("weights", b))
    rows = rows.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams"))).drop("grams", "weights")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= F.lit(threshold), F.lit(False))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return rows.select(*names, kept.alias("kept"), "score", *extra)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass; columns of ``documents``."""
    rows = docs.select(*DOCUMENT_COLUMNS)
    held = rows.select("doc_id", "text", F.struct(*DOCUMENT_COLUMNS).alias("row"))
    judged = judge_documents(held, labels, threshold, extra=("row",))
    # A row number is not deterministic, so the filter stays above the projections instead of being copied into them.
    judged = judged.withColumn("number", F.monotonically_increasing_id())
    return judged.where("kept and number >= 0").select("row.*")
