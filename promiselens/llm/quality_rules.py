"""Quality rules with cross-document line frequency (DataFrame functions only).

A document's lines are normalised (lower case, white space squeezed) and hashed. For each (host, line) the
documents with different contents that hold it are counted; exact copies of a page count once, because they
are the business of deduplication and not boilerplate. Lines above both limits are removed, and a document
left with too small a share of its words is rejected as depleted.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own;
every line with a character is counted unless the caller raises ``min_line_words``; repeated rows are each judged and
kept as rows; an empty table gives an empty result. Only the named columns are read, so extra columns of any
name do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promiselens.llm.common import WHITE, as_row, null_safe, with_text
from promiselens.session import materialise

SYMBOLS = "#*$%&|<>"
NOT_WHITE = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineLimits:
    min_line_words: int = 1  # 1 counts every line; more spares shorter lines, such as closing brackets of code
    max_documents: int = 30  # a line is boilerplate above this many different documents of its host ...
    max_share_percent: float = 0.1  # ... and above this share of the host's different documents
    min_left_percent: int = 20  # a document is depleted when fewer of its words are left


def _repeat_words(words: Column, hashes: Column, ordered: Column) -> Column:
    """Words inside 8-word windows that occur twice or more; ``ordered`` holds (hash, place) in order."""
    repeated = F.filter(
        ordered,
        lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]),
    )
    places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    covered = F.aggregate(
        places,
        start,
        lambda a, p: F.struct((p + 8).alias("upto"), (a["n"] + p + 8 - F.greatest(p, a["upto"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(ordered) > 0, covered).otherwise(0).cast("long")


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """One narrow row per document: counts of the base rules and (hash, words) of each normalised line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id",
        F.col(host).alias("host"),
        text.alias("text"),
        F.xxhash64(text, F.length(text)).alias("content"),
        F.filter(F.split(text, WHITE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_WHITE)).alias("lines"),
        F.filter(F.transform(F.split(_squeezed(text), "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("normal"),
    )
    # Hashes of 2, 4 and 8 consecutive words, each from two of the step before; past the end they are cut off.
    by_word = split.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    two = by_word.withColumn("two", _joined_hash(F.col("one"), 1))
    four = two.withColumn("four", _joined_hash(F.col("two"), 2))
    eight = four.withColumn("eight", _joined_hash(F.col("four"), 4))
    hashed = eight.withColumn("hashes", F.slice("eight", 1, F.greatest(F.size("words") - 7, F.lit(0))))
    # Only a document with a repeated window pays for ordering its windows.
    in_order = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    ordered = hashed.withColumn("ordered", in_order)
    return ordered.select(
        "doc_id",
        "host",
        "content",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), F.col("hashes"), F.col("ordered")).alias("n_repeat_words"),
        F.transform(
            "normal",
            lambda x: F.struct(
                F.xxhash64(x).alias("h"),
                (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w"),
            ),
        ).alias("lines"),
    )


def _joined_hash(hashes: Column, shift: int) -> Column:
    """Of every place the hash of its value and the one ``shift`` places on."""
    return F.zip_with(hashes, F.slice(hashes, shift + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[ \t\x0B\f\r]+", " ")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(_squeezed(line)))


def frequent_lines(found: DataFrame, limits: LineLimits) -> DataFrame:
    """(host, h) of the lines above the limits. Counts combine on the map side, so a hot line is no hot task."""
    lines = _lines(found, limits)
    per_line = lines.select("host", "h", "content").distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    per_host = found.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("of"))
    above = (F.col("n") > limits.max_documents) & (F.col("n") * 100.0 > F.col("of") * limits.max_share_percent)
    return null_safe(per_line.filter(F.col("n") > limits.max_documents), per_host, ["host"], "inner").filter(above).select("host", "h")


def _lines(found: DataFrame, limits: LineLimits) -> DataFrame:
    exploded = found.select("doc_id", "host", "content", F.explode("lines").alias("line"))
    return exploded.select("doc_id", "host", "content", F.col("line.h").alias("h"), F.col("line.w").alias("w")).filter(
        F.col("w") >= limits.min_line_words
    )


def judge(docs: DataFrame, limits: LineLimits = LineLimits(), host: str = "source") -> tuple[DataFrame, DataFrame]:
    """(verdict per document, (doc_id, host, content, drop) with the hashes of the lines to remove)."""
    verdict, drop = _judged(docs, limits, host)
    return verdict.drop("host", "content"), drop


def _judged(docs: DataFrame, limits: LineLimits, host: str) -> tuple[DataFrame, DataFrame]:
    """As ``judge``, with host and content beside the id: rows with one id, or none, may hold unlike texts."""
    found = materialise(features(docs, host))
    frequent = materialise(frequent_lines(found, limits))
    hits = null_safe(_lines(found, limits), frequent, ["host", "h"], "inner")
    removed = materialise(
        hits.groupBy("doc_id", "host", "content").agg(
            F.count("*").alias("n_lines_removed"),
            F.sum("w").cast("long").alias("n_words_removed"),
            F.collect_set("h").alias("drop"),
        )
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # Repeated rows of a document add up in ``removed``; their share is that of one row.
    sums = removed.select("doc_id", "host", "content", "n_lines_removed", "n_words_removed")
    copies = found.groupBy("doc_id", "host", "content").agg(F.count("*").alias("copies"))
    sums = null_safe(sums, copies, ["doc_id", "host", "content"], "inner").select(
        "doc_id", "host", "content",
        (F.col("n_lines_removed") / F.col("copies")).cast("long").alias("n_lines_removed"),
        (F.col("n_words_removed") / F.col("copies")).cast("long").alias("n_words_removed"),
    )
    joined = null_safe(found.drop("lines"), sums, ["doc_id", "host", "content"], "left")
    verdict = joined.select(
        "doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        F.coalesce("n_lines_removed", F.lit(0)).alias("n_lines_removed"),
        F.coalesce("n_words_removed", F.lit(0)).alias("n_words_removed"),
    )
    left = 100 * (F.col("n_words") - F.col("n_words_removed")) >= limits.min_left_percent * F.col("n_words")
    return verdict.withColumn("kept", ~F.col("base_failed") & left), removed.select("doc_id", "host", "content", "drop")


def apply(docs: DataFrame, limits: LineLimits = LineLimits(), host: str = "source") -> DataFrame:
    """The documents that pass, with the lines above the limits taken out of their texts; columns as in ``docs``."""
    verdict, drop = _judged(docs, limits, host)
    kept = verdict.filter("kept").select("doc_id", "host", "content").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.xxhash64(text, F.length(text)).alias("content")
    keyed = docs.select(as_row(docs), "doc_id", F.col(host).alias("host"), content, text.alias("text"))
    passed = null_safe(keyed, kept, ["doc_id", "host", "content"], "left_semi")
    with_drop = null_safe(passed, drop, ["doc_id", "host", "content"], "left")
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("drop"), line_hash(x)))
    return with_text(with_drop, docs, F.array_join(lines, "\n"), F.col("drop").isNotNull())
