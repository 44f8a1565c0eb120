"""What several operators of this package share: table access and size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promiselens.session import materialise

# White space of the word rules: space and the five control characters tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A side of a join is broadcast only when its rows were counted and are at most this many.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(df: DataFrame, max_rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Write ``df`` (narrow rows), count it, and mark it for broadcast only if it is small.

    ``weight`` counts a row as so many more, where a column holds lists.

    Beyond the limit the join that follows is an ordinary shuffle join, which adaptive execution may split.
    """
    stored = materialise(df)
    size = stored.count() if weight is None else stored.agg(F.count("*") + F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(stored) if size <= max_rows else stored


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the key columns of ``left`` stay."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = same if condition is None else condition & same
    joined = left.join(named, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def as_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that columns added beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def content_of(text: Column) -> Column:
    """Hash that tells the texts under one id apart, as rows without an id are all under one; null and empty texts are alike."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text, F.length(text)).alias("content")


def by_content(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined on (doc_id, content) with ``found``, a null id equal to a null id; only columns of ``docs`` stay."""
    keyed = docs.select(as_row(docs), "doc_id", content_of(F.col("text")))
    joined = null_safe(keyed, found, ["doc_id", "content"], how)
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def with_text(rows: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of ``docs`` back from ``row``; where ``changed``, with the new text and its length as n_chars."""
    new = rows.withColumn("new_text", F.when(changed, text))
    old = {c: F.col("row").getField(c) for c in docs.columns}
    values = old | {"text": F.when(changed, F.col("new_text")).otherwise(old["text"])}
    if "n_chars" in old:
        length = F.length("new_text").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(changed, length).otherwise(old["n_chars"])
    return new.select(*[values[c].alias(c) for c in docs.columns])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)
