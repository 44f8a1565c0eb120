"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every version of a text is addressed by the SHA-256 of its content. The ledger is a Parquet folder of findings per
(blob, rule version); a scan reads only blobs it has not seen under the current rule version, one representative
row each, appends what it found (an empty list too), and joins the findings back to all paths that hold the blob.
A changed rule set is a new version, so it scans everything once more and leaves older findings in place.

Defined cases: a null text is the empty blob; empty texts have no findings; repeated rows and equal texts share one
scan and all get its findings; an empty table gives an empty result and leaves the ledger as it is. A scan that
fails appends nothing readable, as the ledger is written in one commit. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promiselens.llm.common import as_row, counted, null_safe, with_text
from promiselens.session import materialise, shared_folder


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1  # shortest match to report ...
    group: int = 0  # ... measured on this group of the pattern
    hint: str = ""  # cheaper pattern that every match contains


# The three base kinds in their order, then the kinds this operator adds.
# A run of 16 or more, or 18 or more, characters is what is left when shorter maximal runs are dropped.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
RULE_VERSION = "1"

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Code-point spans of the matches, from the lengths of matches and of the pieces between them."""
    none = F.array().cast(f"array<{SPAN}>")
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    parts = F.arrays_zip(pieces.alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(measured, F.length).alias("own"))
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + p["gap"]
        end = begin + F.coalesce(p["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(
            end.alias("at"),
            F.when(p["own"] >= rule.least, F.concat(a["found"], F.array(span))).otherwise(a["found"]).cast(f"array<{SPAN}>").alias("found"),
        )

    return F.when(text.rlike(rule.pattern), F.aggregate(parts, start, step, lambda a: a["found"])).otherwise(none)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``spans``: all findings of ``text``, ordered by start and then by the rules' order."""
    found = F.concat(*[_spans(F.col("text"), rule, rank) for rank, rule in enumerate(rules)])
    return blobs.withColumn("spans", F.sort_array(found))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    schema = f"blob string, rule_version string, spans array<{SPAN}>"
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:  # no scan has been written yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def update_ledger(
    docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION
) -> DataFrame:
    """Scan what the ledger in ``folder`` has not seen; return (doc_id, blob, spans) of all rows of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    paths = materialise(docs.select("doc_id", F.sha2(text, 256).alias("blob")))
    seen = _ledger(spark, folder).filter(F.col("rule_version") == rule_version).select("blob")
    chosen = paths.groupBy("blob").agg(F.min(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("path"))
    unseen = materialise(chosen.join(seen, "blob", "left_anti"))
    if not unseen.isEmpty():
        # One row per unseen blob reaches the scanner; its text moves once.
        keyed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("path"), text.alias("text"))
        texts = keyed.join(unseen, "path").filter(F.sha2("text", 256) == F.col("blob"))
        found = scan(texts, rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans")
        found.dropDuplicates(["blob"]).write.mode("append").parquet(folder)
    findings = _ledger(spark, folder).filter(F.col("rule_version") == rule_version).filter(F.size("spans") > 0)
    # Two scans at the same time may both have appended a blob; either finding is right, one is taken.
    # Stored first, so that a blob with very many paths is a plain join, which can be split.
    found_once = counted(findings.dropDuplicates(["blob"]).select("blob", "spans"), weight=F.size("spans"))
    with_findings = paths.join(found_once, "blob", "left")
    return with_findings.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def new_ledger(spark: SparkSession) -> str:
    """A folder for a ledger of one run."""
    return f"{shared_folder(spark)}/promiselens/ledger-{uuid.uuid4().hex}"


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and the list of all spans."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, folder: str, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans are replaced together."""
    # A document with secrets is small in number beside the others, but may be of any size: an equi-join by id and blob.
    found = update_ledger(docs, folder).filter(F.size("spans") > 0).select("doc_id", "blob", "spans").distinct()
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    keyed = docs.select(as_row(docs), "doc_id", blob.alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    joined = null_safe(keyed, found, ["doc_id", "blob"], "left")
    start = F.struct(F.lit(0).alias("upto"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), a["upto"] + 1, s["start"] - a["upto"])
        fresh = F.concat(a["out"], gap, F.lit(mark))
        return F.struct(
            F.greatest(a["upto"], s["end"]).alias("upto"),
            F.when(s["start"] >= a["upto"], fresh).otherwise(a["out"]).alias("out"),
        )

    cleaned = F.aggregate(
        "spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["upto"] + 1, F.length("text")))
    )
    return with_text(joined, docs, cleaned, F.col("spans").isNotNull())
