"""Benchmark decontamination by winnowing (DataFrame functions only).

Words are lower-cased (A-Z) runs outside ASCII punctuation. Of every ``span`` consecutive words the smallest of the
hashed ``gram``-word sequences is kept as a fingerprint, in documents as in items, so a shared run of ``span`` words
always shares a fingerprint. Documents whose fingerprints join an item's are extended: their ``span``-word windows are
compared with the items' windows word by word, and the words under the matches are hit. An item shorter than ``span``
is one window of all its words; its hash is looked up among all runs of that length.

Defined cases: null and empty texts have no words, no hits and are clean; items without words have no window; items
with equal windows are all reported; repeated rows are judged alike, and rows with one id or none but unlike texts by their own texts; with an empty benchmark every document is
clean, and an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promiselens.llm.common import ascii_lower, by_content, content_of, counted, null_safe
from promiselens.session import materialise

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class SpanRule:
    span: int = 13
    gram: int = 9
    min_hit_percent: int = 5  # contaminated at this share of a document's words


def words_of(text: Column) -> Column:
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS)
    return F.filter(split, lambda w: w != "")


def _hashes(words: Column, n: int) -> Column:
    """Hash of every run of ``n`` words."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n))))


def _runs(words: Column, n: int) -> Column:
    """Structs (n, print) of every run of ``n`` words; none if there are fewer words."""
    none = F.array().cast("array<struct<n:int,print:bigint>>")
    return F.coalesce(F.transform(_hashes(words, n), lambda h: F.struct(F.lit(n).alias("n"), h.alias("print"))), none)


def _joined_hash(hashes: Column, shift: int) -> Column:
    return F.zip_with(hashes, F.slice(hashes, shift + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def _smaller(values: Column, shift: int) -> Column:
    return F.zip_with(values, F.slice(values, shift + 1, F.size(values)), lambda a, b: F.least(a, b))


def with_fingerprints(df: DataFrame, rule: SpanRule, *keep: str) -> DataFrame:
    """Adds ``prints``: distinct smallest gram hashes of the spans of ``words``; null below ``span`` words.

    A hash of 2, 4 and 8 words is made of two of half the length; a minimum over 2 and 4 grams likewise. Each step
    is a column of its own, so that it is computed once.
    """
    n, wide = rule.gram, rule.span - rule.gram + 1
    out = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    length, parts, done = 1, [], 0
    while length <= n:
        if n & length:
            parts.append((length, done))
            done += length
        if length * 2 <= n:
            out = out.withColumn(f"h{length * 2}", _joined_hash(F.col(f"h{length}"), length))
        length *= 2
    size = F.size("h1")
    gram = F.col(f"h{parts[0][0]}")
    for length, offset in parts[1:]:
        gram = F.zip_with(gram, F.slice(f"h{length}", offset + 1, size), lambda a, b: F.xxhash64(a, b))
    out = out.select(*keep, size.alias("size"), gram.alias("m1"))
    reach = 1
    while reach * 2 <= wide:
        out = out.withColumn(f"m{reach * 2}", _smaller(F.col(f"m{reach}"), reach))
        reach *= 2
    low = F.col(f"m{reach}")
    if reach < wide:
        low = _smaller(low, wide - reach)
    prints = F.array_distinct(F.slice(low, 1, F.greatest(F.col("size") - (rule.span - 1), F.lit(0))))
    return out.select(*keep, prints.alias("prints"))


def _windows(words: Column, lengths: Column) -> Column:
    """Structs (pos, text) of all runs of the given lengths."""
    runs = F.transform(
        lengths,
        lambda n: F.transform(
            F.sequence(F.lit(1), F.size(words) - n + 1),
            lambda i: F.struct(i.alias("pos"), n.alias("len"), F.array_join(F.slice(words, i, n), " ").alias("window")),
        ),
    )
    return F.flatten(runs)


def _listed(worded: DataFrame, rule: SpanRule) -> tuple[DataFrame, DataFrame]:
    """(len, window, list_id) of the items' windows, and (list_id, item_ids): windows held by the same items share their list.

    So a hit names a list, and a window that many items hold meets a document once, not once for each of them.
    """
    in_items = worded.select(
        "item_id",
        F.explode_outer(_windows(F.col("words"), F.array(F.least(F.lit(rule.span), F.size("words"))))).alias("w"),
    ).select("item_id", "w.len", "w.window")
    held = in_items.groupBy("len", "window").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    held = materialise(held.withColumn("list_id", F.sha2(F.to_json("item_ids"), 256)))
    lists = held.select("list_id", "item_ids").dropDuplicates(["list_id"])
    return counted(held.select("len", "window", "list_id")), counted(lists, weight=F.size("item_ids"))


def _spans(docs: DataFrame, items: DataFrame, rule: SpanRule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, content, n_hit, list_ids) of the documents that hold a window of an item, and (list_id, item_ids)."""
    worded = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    worded = materialise(worded.filter(F.size("words") > 0))
    windows, lists = _listed(worded, rule)
    long_items = with_fingerprints(worded, rule).select(F.explode_outer("prints").alias("print"))
    long_items = long_items.filter("print is not null").distinct()
    prints = counted(long_items)
    short = worded.filter(F.size("words") < rule.span).select(F.size("words").alias("n"), "words")
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # below ``span`` values at most

    split = docs.select("doc_id", content_of(F.col("text")), words_of(F.col("text")).alias("words"))
    # Outer, as the filter that a plain explode adds would compute the fingerprints a second time below every step.
    found = with_fingerprints(split, rule, "doc_id", "content").select("doc_id", "content", F.explode_outer("prints").alias("print"))
    candidates = found.join(prints, "print", "left_semi").select("doc_id", "content")
    if lengths:  # the runs of all these lengths in one more pass
        wanted = counted(short.select("n", F.xxhash64("words").alias("print")).distinct())
        of_length = [_runs(F.col("words"), n) for n in lengths]
        runs = split.select("doc_id", "content", F.explode_outer(F.flatten(F.array(*of_length))).alias("run"))
        runs = runs.select("doc_id", "content", "run.n", "run.print")
        candidates = candidates.union(runs.join(wanted, ["n", "print"], "left_semi").select("doc_id", "content"))
    suspects = by_content(docs.select("doc_id", "text"), counted(candidates.distinct()), "left_semi")

    sizes = F.array(*[F.lit(n) for n in [*lengths, rule.span]])
    suspects = suspects.select("doc_id", content_of(F.col("text")), words_of(F.col("text")).alias("words"))
    fitting = F.filter(sizes, lambda n: n <= F.size("words"))
    in_docs = suspects.select("doc_id", "content", F.explode_outer(_windows(F.col("words"), fitting)).alias("w"))
    in_docs = in_docs.select("doc_id", "content", "w.*")
    matched = in_docs.join(windows, ["len", "window"]).select("doc_id", "content", "pos", "len", "list_id")
    start = F.struct(F.lit(1).alias("upto"), F.lit(0).alias("n"))
    covered = F.aggregate(
        F.sort_array("spans"),
        start,
        lambda a, s: F.struct(
            F.greatest(a["upto"], s["pos"] + s["len"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(s["pos"], a["upto"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    spans = matched.groupBy("doc_id", "content").agg(
        F.collect_set(F.struct("pos", "len")).alias("spans"), F.collect_set("list_id").alias("list_ids")
    )
    return materialise(spans.select("doc_id", "content", covered.cast("long").alias("n_hit"), "list_ids")), lists


def find_hits(docs: DataFrame, items: DataFrame, rule: SpanRule = SpanRule()) -> DataFrame:
    """(doc_id, content, n_hit, n_items, item_ids) of the documents that hold a window of an item."""
    spans, lists = _spans(docs, items, rule)
    named = spans.select("doc_id", "content", "n_hit", F.explode("list_ids").alias("list_id")).join(lists, "list_id")
    named = named.select("doc_id", "content", "n_hit", F.explode("item_ids").alias("item_id"))
    hits = named.groupBy("doc_id", "content", "n_hit").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return hits.select("doc_id", "content", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def contamination(docs: DataFrame, items: DataFrame, rule: SpanRule = SpanRule()) -> DataFrame:
    """Per document: its words, hit words, items found and whether it is contaminated."""
    hits = counted(find_hits(docs, items, rule), weight=F.size("item_ids"))
    n_words = F.size(words_of(F.col("text"))).cast("long")
    sized = docs.select("doc_id", content_of(F.col("text")), n_words.alias("n_words"))
    judged = null_safe(sized, hits, ["doc_id", "content"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return judged.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * rule.min_hit_percent)).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, rule: SpanRule = SpanRule()) -> DataFrame:
    """``docs`` without the contaminated documents."""
    hits = contamination_of_hits(docs, items, rule)
    return by_content(docs, counted(hits), "left_anti")


def contamination_of_hits(docs: DataFrame, items: DataFrame, rule: SpanRule) -> DataFrame:
    """(doc_id, content) of the contaminated documents; the others are never counted."""
    hits = counted(_spans(docs, items, rule)[0].select("doc_id", "content", "n_hit"))
    n_words = F.size(words_of(F.col("text")))
    keyed = docs.select("doc_id", content_of(F.col("text")), "text")
    judged = null_safe(keyed, hits, ["doc_id", "content"], "inner").select("doc_id", "content", "n_hit", n_words.alias("n"))
    return judged.filter(F.col("n_hit") * 100 >= F.col("n") * rule.min_hit_percent).select("doc_id", "content").distinct()
