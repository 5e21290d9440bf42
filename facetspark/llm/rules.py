"""Quality rules with a hashed n-gram likelihood ratio (operator 7). DataFrame functions only.

Counts of hashed word and word-pair buckets are taken over a trusted target (documents
labelled good, a bounded sample of their ids) and over the raw corpus (every document). A
document's score is the mean over its n-grams of log(target share / raw share) of their
buckets; documents below a fixed threshold go. Base rules on length and repetition come first.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .linededup import BLANKS

#: Runs of letters and digits, or of other visible characters.
TOKEN = r"[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]+"


def ngram_buckets(text: str, buckets: int) -> str:
    """SQL: the bucket of every token and every pair of neighbours. Case is kept: shouting is
    evidence. ``transform(array(x), t -> ...)[0]`` computes x once for all its uses."""
    tokens = f"regexp_extract_all({text}, '{TOKEN}', 0)"
    return (
        f"transform(array({tokens}), t -> concat(transform(t, x -> cast(pmod(xxhash64(x), {buckets}) as int)), "
        f"if(size(t) > 1, zip_with(slice(t, 1, size(t) - 1), slice(t, 2, size(t) - 1), (x, y) -> cast(pmod(xxhash64(x, y), {buckets}) as int)), array())))[0]"
    )


def repeat_words(words: str) -> str:
    """SQL: how many of an array of words lie in a 3-word window that occurs twice or more.
    Windows are hashed and sorted with their places; equal neighbours are repeats."""
    windows = f"transform(array({words}), w -> if(size(w) < 4, array(), transform(sequence(0, size(w) - 3), i -> struct(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) as h, i as i))))[0]"
    repeated = f"transform(array(sort_array({windows})), s -> filter(s, (e, k) -> coalesce(get(s, k - 1).h = e.h, false) or coalesce(get(s, k + 1).h = e.h, false)))[0]"
    places = f"transform(array(sort_array(transform({repeated}, e -> e.i))), p -> transform(p, (x, j) -> if(j = 0, 3, least(3, x - get(p, j - 1)))))[0]"
    return f"cast(aggregate({places}, 0, (a, x) -> a + x) as bigint)"


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the base counts, with ``base_failed``; the text stays as ``body``."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select("doc_id", body.alias("body"))
    trimmed = F.btrim("body", F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    out = out.select("doc_id", "body", words.alias("words"), lines.alias("lines"))
    return out.select(
        "doc_id",
        "body",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.translate("body", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.char_length("body") - F.char_length(F.translate("body", "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr(repeat_words("words")).alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def target_ids(labels: DataFrame, most: int) -> DataFrame:
    """Ids of documents labelled good: at most ``most``, those with the smallest hashes, which
    is the bound of what is broadcast."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int, most: int) -> list[float]:
    """Per bucket, log(target share / raw share), with one added to each count. The result is
    ``buckets`` numbers, whatever the corpus; the counts are over all documents."""
    flagged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(target_ids(labels, most).withColumn("good", F.lit(1))), "doc_id", "left")
    grams = flagged.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(F.expr(ngram_buckets("text", buckets))).alias("bucket"))
    got = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()
    raw, target = [1] * buckets, [1] * buckets
    for r in got:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if sum(target) == buckets:  # nothing trusted: no evidence either way
        return [0.0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, most: int = 20_000, threshold: float = -0.2) -> DataFrame:
    """Apply the base rules and the likelihood-ratio threshold to every whole text.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept``. Null, empty and blank texts have no words and fail the base
    rules; a text without tokens scores 0; a very long text is judged whole, in one task (its words
    and their windows are arrays of a row); a score equal to the threshold stays; repeated rows are
    judged each, an id labelled twice counts once; with no labels all scores are 0; an empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    w = log_ratios(docs, labels, buckets, most)
    weights = "cast(split('" + ",".join(f"{x:.6f}" for x in w) + "', ',') as array<double>)"
    score = F.expr(
        f"transform(array({ngram_buckets('body', buckets)}), g -> if(size(g) = 0, 0D, aggregate(g, 0D, (a, x) -> a + element_at({weights}, x + 1)) / size(g)))[0]"
    )
    out = base_rules(docs).withColumn("score", F.round(score, 6))
    return out.drop("body").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
