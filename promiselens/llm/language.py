"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is the vector of its hashed byte n-grams (one to four bytes, lower-cased A-Z; words with their blanks), weighted
log(1 + count) times the n-gram's inverse document frequency and scaled to unit length. Each language has several
centroids, found by spherical k-means; a text takes the language of the centroid of the highest cosine. A text farther
than ``reject`` from every centroid is marked as rejected (its nearest language is still named).

Document frequencies cover all learning rows. The centroids are fitted on a bounded sample of ``max_rows`` rows per
language (the smallest hashes of the id), one task per language. The model is ``centroids * 2**bits`` floats for each
learned language, whatever the input size. Ids, sources and languages are never inputs of a prediction.

Defined cases: a null text and a text without a letter are ``und`` with score 0; rows with a null language or id teach
nothing; without any learning row every text is ``und``; ties go to the language that sorts first; repeated rows are
predicted alike; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promiselens.llm import bytewords as bw
from promiselens.llm.common import counted
from promiselens.session import materialise


@dataclass(frozen=True)
class LanguageParams:
    bits: int = 12
    centroids: int = 3
    max_rows: int = 1_500  # per language
    slices: int = 256  # of a language's rows, ranked apart before the smallest hashes are chosen
    rounds: int = 12
    reject: float = 0.08  # cosine below which a text is near to no centroid


_RANDOM = np.random.default_rng(5)
_GRAM = _RANDOM.integers(1, 1 << 63, (4, 256), dtype=np.uint64) | np.uint64(1)
# One value for all that is no letter byte: digits, punctuation and white space part words and say no more.
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def counts(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, slot, times) of the n-grams of the texts of one chunk; n-grams never cross texts."""
    rows = len(offsets) - 1
    letters = _LETTERS[data]
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    blank = letters == 32
    keyed = []
    total = np.zeros(len(letters), dtype=np.uint64)
    for n in range(4):
        last = len(letters) - n
        if last <= 0:
            break
        total = total[:last] * np.uint64(0x100000001B3) + _GRAM[n][letters[n:]]
        fits = owner[:last] == owner[n:]
        if n:  # runs of blanks, and n-grams over two words, say nothing about a language
            inner = np.zeros(last, dtype=bool)
            for k in range(1, n):
                inner |= blank[k : k + last]
            fits &= ~inner & ~(blank[:last] & blank[n:])
        else:
            fits &= ~blank
        slot = (bw.mix(total[fits] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)
        keyed.append((owner[:last][fits] << bits) | slot)
    everything = np.concatenate(keyed) if keyed else np.zeros(0, np.int64)
    times = np.bincount(everything, minlength=rows << bits) if rows << bits <= 1 << 22 else None
    if times is None:
        found, times = np.unique(everything, return_counts=True)
    else:
        found = np.flatnonzero(times)
        times = times[found]
    row = found >> bits
    return np.searchsorted(row, np.arange(rows + 1)), (found & ((1 << bits) - 1)).astype(np.int32), times


def weighted(at: np.ndarray, slot: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Dense rows of unit length (zero for a text without n-grams)."""
    out = np.zeros((len(at) - 1, len(idf)), dtype=np.float32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out[row, slot] = np.log1p(times) * idf[slot]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def cluster(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts are rows far from each other, an emptied cluster keeps its centroid."""
    start = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(start) < min(k, len(rows)):
        start.append(int(np.argmin((rows @ rows[start].T).max(axis=1))))
    centroids = rows[start].copy()
    for _ in range(rounds):
        nearest = np.argmax(rows @ centroids.T, axis=1)
        for c in range(len(centroids)):
            own = rows[nearest == c]
            if len(own):
                mean = own.sum(axis=0)
                centroids[c] = mean / max(np.linalg.norm(mean), 1e-9)
    return centroids


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # language number of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    bits: int
    reject: float

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, cosine) of unit rows."""
        close = rows @ self.centroids.T
        best = np.argmax(close, axis=1)
        return self.of[best], np.clip(close[np.arange(len(rows)), best], 0, 1)


def _each_chunk(batch: pa.RecordBatch, bits: int):
    data, offsets = bw.column_bytes(batch.column("text"))
    for first, last in bw.chunks(offsets, bw.CHUNK_BYTES // 2):
        for a in range(first, last, 512):
            b = min(a + 512, last)
            own = offsets[a : b + 1]
            yield a, b, counts(data[own[0] : own[-1]], own - own[0], bits)


def _frequencies(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for _, _, (_, slot, _) in _each_chunk(batch, bits):
                seen += np.bincount(slot, minlength=1 << bits)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], ["slot", "n"])

    return run


def _sparse(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (at, slot, times) in _each_chunk(batch, bits):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("lang").slice(a, b - a),
                        pa.array([slot[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()),
                        pa.array([times[i:j].astype(np.int32).tobytes() for i, j in zip(at, at[1:])], pa.binary()),
                    ],
                    ["lang", "slot", "times"],
                )

    return run


def _cluster_task(idf: np.ndarray, params: LanguageParams):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        slots = [np.frombuffer(s, np.int32) for s in rows["slot"]]
        times = [np.frombuffer(t, np.int32) for t in rows["times"]]
        at = np.concatenate(([0], np.cumsum([len(s) for s in slots])))
        dense = weighted(at, np.concatenate(slots), np.concatenate(times), idf)
        found = cluster(dense[dense.any(axis=1)], params.centroids, params.rounds) if dense.any() else dense[:0]
        return pd.DataFrame({"lang": key[0], "centroid": [c.astype(np.float32).tobytes() for c in found]})

    return run


def train(learn: DataFrame, params: LanguageParams = LanguageParams()) -> Model:
    """``learn``: doc_id, text, lang."""
    usable = learn.filter("lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    seen = usable.select("text").mapInArrow(_frequencies(params.bits), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    frequency = np.zeros(1 << params.bits)
    for r in seen.collect():  # at most 2**bits rows
        frequency[r["slot"]] = r["n"]
    total = usable.count()
    idf = (np.log((1 + total) / (1 + frequency)) + 0.05).astype(np.float32)
    # The rows with the smallest hashes of each language: first of each of its slices, so that a language with most of
    # the rows is ranked by many tasks, then of what the slices leave. One scan, however many values ``lang`` has.
    some = usable.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    some = some.withColumn("slice", F.pmod("h", F.lit(params.slices)))
    for by in (["lang", "slice"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
        some = some.withColumn("place", place).filter(F.col("place") <= params.max_rows).drop("place")
    chosen = usable.join(counted(some.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    sparse = materialise(chosen.select("text", "lang").mapInArrow(_sparse(params.bits), "lang string, slot binary, times binary"))
    rows = sparse.groupBy("lang").applyInPandas(_cluster_task(idf, params), "lang string, centroid binary").collect()
    rows = sorted((r["lang"], bytes(r["centroid"])) for r in rows)
    languages = sorted({lang for lang, _ in rows})
    empty = np.zeros((0, 1 << params.bits), np.float32)
    centroids = np.stack([np.frombuffer(c, np.float32) for _, c in rows]) if rows else empty
    return Model(languages, np.array([languages.index(lang) for lang, _ in rows], int), centroids, idf, params.bits, params.reject)


def _predictions(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            lettered = np.array(batch.column("lettered").to_pylist(), dtype=bool)
            for a, b, (at, slot, times) in _each_chunk(batch, model.bits):
                known = lettered[a:b] & bool(model.languages)
                number, cosine = np.full(b - a, len(model.languages)), np.zeros(b - a)
                if known.any():
                    nearest, close = model.predict(weighted(at, slot, times, model.idf))
                    number, cosine = np.where(known, nearest, number), np.where(known, close, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(names[number], pa.string()),
                        pa.array(cosine, pa.float64()),
                        pa.array(cosine < model.reject, pa.bool_()),
                    ],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row; the score is the cosine to the nearest centroid."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    schema = f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    return docs.select("doc_id", "text", lettered).mapInArrow(_predictions(model), schema)
