"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text is a sparse vector: hashed lower-case words with weight log(1 + count), scaled to unit length, and a fixed set of
structure statistics. The score is the logistic of bias + linear terms + low-rank pairwise interactions, which
the sum-of-squares identity gives in linear time: half of (sum of v_i x_i)^2 - sum of (v_i x_i)^2 over each factor.

Vectors are made where the texts are. Fitting takes a bounded sample of labelled rows (``max_rows``, those with the
smallest hash of the id) in one task; the model is ``features * (1 + factors)`` floats at any input size and goes to the
scoring tasks as a closure. Ids, languages and sources are never inputs.

Defined cases: null and empty texts have all-zero words and statistics and get the score of that vector; rows with a null
label or id teach nothing; without both labels in the sample every score is the share of label 1 (0.5 without labels);
repeated rows score alike; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promiselens.llm import bytewords as bw
from promiselens.session import materialise


@dataclass(frozen=True)
class FmParams:
    word_bits: int = 16
    factors: int = 6
    max_rows: int = 12_000  # labelled rows that fit the model, at most
    epochs: int = 6
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-5


STATS = (
    "log_bytes", "log_words", "mean_word", "symbols", "upper", "digits", "breaks", "punctuation", "not_ascii",
    "distinct_words", "repeated_pairs", "top_word", "bars",
)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>@^~_=+{}[]\\/", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_PUNCT = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float32)


def vectors(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, feature, value) of the words, and the matrix of statistics, for the texts of one chunk."""
    hashes, counts = bw.word_hashes(data, offsets, bw.NOT_WHITE, bw.ASCII_FOLD)
    rows = len(counts)
    owner = np.repeat(np.arange(rows, dtype=np.uint64), counts)
    slot = hashes >> np.uint64(64 - bits)
    keyed, times = np.unique((owner << np.uint64(bits)) | slot, return_counts=True)
    row = (keyed >> np.uint64(bits)).astype(np.int64)
    feature = (keyed & np.uint64((1 << bits) - 1)).astype(np.int32)
    value = np.log1p(times).astype(np.float32)
    at = np.searchsorted(row, np.arange(rows + 1))
    norm = np.sqrt(np.concatenate(([0], np.cumsum(value.astype(np.float64) ** 2))))
    norm = np.sqrt(np.maximum(norm[at[1:]] ** 2 - norm[at[:-1]] ** 2, 1e-12))
    value /= norm[row].astype(np.float32)

    size = np.diff(offsets).astype(np.float32)
    words = counts.astype(np.float32)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    pairs = np.zeros(0, dtype=np.uint64)
    if len(hashes) > 1:
        same = owner[1:] == owner[:-1]
        pairs = bw.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same] >> np.uint64(24)
        pair_owner = owner[1:][same]
        kept = np.unique((pair_owner << np.uint64(40)) | pairs)
        distinct_pairs = np.bincount((kept >> np.uint64(40)).astype(np.int64), minlength=rows)
    else:
        distinct_pairs = np.zeros(rows, dtype=np.int64)
    n_pairs = np.maximum(counts - 1, 0)
    top = np.zeros(rows, dtype=np.float32)
    np.maximum.at(top, row, times.astype(np.float32))
    stats = np.stack(
        [
            np.log1p(size) / 12,
            np.log1p(words) / 10,
            np.minimum(size * per_word, 40) / 20,
            _sums(_SYMBOL[data], offsets) * per_byte * 5,
            _sums(_UPPER[data], offsets) * per_byte,
            _sums(_DIGIT[data], offsets) * per_byte * 5,
            _sums(data == 10, offsets) * per_byte * 10,
            _sums(_PUNCT[data], offsets) * per_byte * 5,
            _sums(data >= 128, offsets) * per_byte,
            np.diff(at) * per_word,
            (n_pairs - distinct_pairs) / np.maximum(n_pairs, 1),
            top * per_word,
            _sums(data == 124, offsets) * per_byte * 10,
        ],
        axis=1,
    ).astype(np.float32)
    return at, feature, value, stats


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # words, then statistics
    factors: np.ndarray  # one row per feature
    bits: int

    def margins(self, at: np.ndarray, feature: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Raw scores: every feature of every row is read once."""
        words = 1 << self.bits
        v = self.factors[feature] * value[:, None]
        first = _by_row(v, at) + stats @ self.factors[words:]
        squares = _by_row(v * v, at) + (stats * stats) @ (self.factors[words:] ** 2)
        linear = _by_row((self.linear[feature] * value)[:, None], at)[:, 0] + stats @ self.linear[words:]
        return self.bias + linear + 0.5 * (first * first - squares).sum(axis=1)


def _by_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows' runs of ``values``; an empty run is zero."""
    out = np.zeros((len(at) - 1, values.shape[1]), dtype=np.float32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, params: FmParams) -> Model:
    """Mini-batch gradient descent with per-weight rates over (feature, value, stats) rows; classes weigh the same."""
    words = 1 << params.word_bits
    random = np.random.default_rng(11)
    size = words + len(STATS)
    model = Model(0.0, np.zeros(size, np.float32), (random.normal(size=(size, params.factors)) * 0.01).astype(np.float32), params.word_bits)
    share = labels.mean() if len(labels) else 0.5
    if len(labels) == 0 or share in (0.0, 1.0):
        model.factors[:] = 0
        model.bias = float(np.log((share + 1e-4) / (1 - share + 1e-4)))
        return model
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-6, np.float32), np.full((size, params.factors), 1e-6, np.float32), 1e-6
    for epoch in range(params.epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(order), params.batch):
            some = order[start : start + params.batch]
            feature = np.concatenate([rows[i][0] for i in some])
            value = np.concatenate([rows[i][1] for i in some])
            stats = np.stack([rows[i][2] for i in some])
            lengths = np.array([len(rows[i][0]) for i in some])
            at = np.concatenate(([0], np.cumsum(lengths)))
            margin = model.margins(at, feature, value, stats)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) * weight[some] / len(some)
            error = error.astype(np.float32)
            row = np.repeat(np.arange(len(some)), lengths)
            # Statistics are features too: append them to the sparse entries.
            everything = np.concatenate([feature, np.tile(words + np.arange(len(STATS)), len(some))])
            values = np.concatenate([value, stats.ravel()])
            owner = np.concatenate([row, np.repeat(np.arange(len(some)), len(STATS))])
            vx = model.factors[everything] * values[:, None]
            total = np.zeros((len(some), params.factors), np.float32)
            np.add.at(total, owner, vx)
            slope = (error[owner] * values)[:, None]
            grad_v = slope * (total[owner] - vx)
            ids, where = np.unique(everything, return_inverse=True)
            sum_v = np.zeros((len(ids), params.factors), np.float32)
            np.add.at(sum_v, where, grad_v)
            sum_w = np.bincount(where, weights=slope[:, 0], minlength=len(ids)).astype(np.float32)
            sum_v += params.decay * model.factors[ids]
            sum_w += params.decay * model.linear[ids]
            seen_factors[ids] += sum_v**2
            seen_linear[ids] += sum_w**2
            model.factors[ids] -= params.rate * sum_v / np.sqrt(seen_factors[ids])
            model.linear[ids] -= params.rate * sum_w / np.sqrt(seen_linear[ids])
            step = float(error.sum())
            seen_bias += step**2
            model.bias -= params.rate * step / float(np.sqrt(seen_bias))
    return model


def _vector_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.column_bytes(batch.column("text"))
            for first, last in bw.chunks(offsets):
                own = offsets[first : last + 1]
                at, feature, value, stats = vectors(data[own[0] : own[-1]], own - own[0], bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").slice(first, last - first),
                        pa.array([feature[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                        pa.array([value[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                        pa.array([s.tobytes() for s in stats], pa.binary()),
                    ],
                    ["label", "feature", "value", "stats"],
                )

    return run


def _fit_task(params: FmParams):
    def run(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        samples = [
            (np.frombuffer(f, np.int32), np.frombuffer(v, np.float32), np.frombuffer(s, np.float32))
            for f, v, s in zip(rows["feature"], rows["value"], rows["stats"])
        ]
        model = fit(samples, rows["label"].to_numpy(dtype=np.float32), params)
        return pd.DataFrame(
            {"bias": [model.bias], "linear": [model.linear.tobytes()], "factors": [model.factors.tobytes()]}
        )

    return run


def train(docs: DataFrame, labels: DataFrame, params: FmParams = FmParams()) -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, label (0 or 1). The sample is the ``max_rows`` labelled ids of the smallest hash.

    It is drawn from the labels alone and broadcast, so the texts are read where they lie and never shuffled.
    """
    known = labels.filter("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    ordered = known.distinct().withColumn("h", F.xxhash64("doc_id", F.lit(5))).orderBy("h", "doc_id", "label")
    sample = materialise(ordered.limit(params.max_rows).select("doc_id", "label"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = materialise(
        chosen.select("text", "label").mapInArrow(_vector_rows(params.word_bits), "label int, feature binary, value binary, stats binary")
    )
    # One task by design: the sample is bounded by a parameter, at any input size.
    whole = rows.withColumn("part", F.lit(0)).groupBy("part")
    fitted = whole.applyInPandas(_fit_task(params), "bias double, linear binary, factors binary").first()
    if fitted is None:
        return fit([], np.zeros(0), params)
    factors = np.frombuffer(fitted["factors"], np.float32).reshape(-1, params.factors)
    return Model(fitted["bias"], np.frombuffer(fitted["linear"], np.float32), factors, params.word_bits)


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.column_bytes(batch.column("text"))
            for first, last in bw.chunks(offsets):
                own = offsets[first : last + 1]
                margin = model.margins(*vectors(data[own[0] : own[-1]], own - own[0], model.bits))
                score = 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(score, pa.float64())], ["doc_id", "score"]
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; a score is the chance of label 1, classes weighing the same."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scores(model), f"doc_id {kind}, score double")


def held_out(doc_id: str = "doc_id", mod: int = 3, rest: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == rest, F.lit(False))
