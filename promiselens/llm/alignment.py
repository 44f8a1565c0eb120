"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, by interval coalescing.

1. A text is encoded twice, as byte-level pieces (A) and as word pieces with byte fallback (B). Each token is an interval of the
   bytes of a space and the text.
2. All intervals of a chunk of texts are sorted by their starts (``lexsort``); the running maximum of their ends breaks them into
   groups wherever a start reaches it. Inside a group every A token is expanded to the B tokens that its bytes overlap (links).
3. A table holds each row's figures and its distinct id pairs with their numbers of links. How many documents hold a pair is
   counted from it over the whole corpus, and joined back: the ``hot_pairs`` most frequent pairs, a bounded number, are broadcast;
   the others meet their rows in an ordinary shuffle join. Sums of a row are made before anything else moves.

A's engine is a byte-pair encoder over the vocabulary and merges of the given file; the loader checks that ids follow the order of the merges, which makes
the two the same. B's words are encoded once and kept: no piece of the vocabulary holds a space after another character (checked when
it is loaded), so no merge crosses the start of a word; with any other vocabulary whole texts are encoded.

Defined cases: a null or empty text, and one whose joined A or B bytes differ from a space and the text (as where the vocabulary
writes a space for another character), has no tokens: all figures 0 and groups ''. Strings of special tokens are plain text. Each row
is a document, repeated rows and rows without an id included; an empty table gives an empty result. Very long texts are a chunk of their own. Only
``doc_id`` and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promiselens.llm import bytewords as bw
from promiselens.llm.common import counted
from promiselens.session import materialise

SPACE = "▁"  # how B's vocabulary writes a space
KEPT_WORDS = 400_000  # of B, in one worker


@dataclass(frozen=True)
class AlignParams:
    byte_vocabulary: str = "byte_bpe_50k.json"
    piece_model: str = "piece_bpe_32k.model"
    hot_pairs: int = 200_000  # most frequent pairs that are broadcast
    chunk_bytes: int = 1 << 19


def _vocabulary_bytes() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as they are and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteSide:
    """A: ids of many texts and the bytes of every id."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            model = json.load(file)
        byte_of = _vocabulary_bytes()
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        order = [vocabulary["".join(m)] for m in merges]
        if order != sorted(order):
            raise ValueError(f"{name}: ids do not follow the order of the merges")
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.encode = tiktoken.Encoding(
            "a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def ids(self, text: str) -> list[int]:
        return self.encode(" " + text)


class PieceSide:
    """B: ids of many texts and the bytes of every id."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)
        ]
        self.by_word = SPACE in names and not any(SPACE in p.lstrip(SPACE) for p in names)
        self.words = re.compile(r" +[^ ]*")
        # The model puts a space before every text but an empty one.
        self.single = {" ": [self.model.piece_to_id(SPACE)]}
        self.known = dict(self.single)

    def ids(self, text: str) -> list[int]:
        if not self.by_word or SPACE in text:
            return self.model.encode(text)
        words, known = self.words.findall(" " + text), self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > KEPT_WORDS:
                known.clear()
                known.update(self.single)
                new = [w for w in set(words) if w not in known]
            known.update(zip(new, self.model.encode([w[1:] for w in new], num_threads=1)))
        return [i for w in words for i in known[w]]


@cache
def _sides(params: AlignParams):
    """The two encoders of a worker, the byte length of every id, and the text of every id with what may follow it."""
    a, b = ByteSide(params.byte_vocabulary), PieceSide(params.piece_model)
    lengths = [np.array([len(p) for p in side.pieces], dtype=np.int64) for side in (a, b)]
    most = max(len(a.pieces), len(b.pieces))
    printed = [f"{i}{mark}" for i in range(most) for mark in ("", ",", "|", ";")]
    return a, b, lengths, printed


def coalesce(starts: np.ndarray, ends: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group of each in that order): intervals sorted by start, broken where a start reaches the running maximum of the ends."""
    order = np.lexsort((of_b, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b) whose byte ranges share a byte; each side's ranges are in order and do not overlap among themselves."""
    first = np.searchsorted(b_end, a_start, side="right")
    times = np.searchsorted(b_start, a_end, side="left") - first
    a = np.repeat(np.arange(len(a_start)), times)
    step = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    return a, first[a] + step


def align(texts: list[str], params: AlignParams) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
    """(n_a, n_b, n_groups, n_links, groups, distinct pairs as a << 32 | b, links of each) of every text."""
    a, b, (a_length, b_length), printed = _sides(params)
    ids: tuple[list, list] = ([], [])
    counts: tuple[list, list] = ([], [])
    for text in texts:
        pair = (a.ids(text), b.ids(text)) if text else ([], [])
        whole = b" " + text.encode()
        if any(b"".join([side.pieces[i] for i in own]) != whole for side, own in zip((a, b), pair)):
            pair = ([], [])
        for k in (0, 1):
            ids[k].extend(pair[k])
            counts[k].append(len(pair[k]))
    a_ids, b_ids = (np.array(v, dtype=np.int64) for v in ids)
    # The two sides of a text have the same bytes, so the ranges of all texts can be laid end to end.
    a_end, b_end = np.cumsum(a_length[a_ids]), np.cumsum(b_length[b_ids])
    a_start, b_start = a_end - a_length[a_ids], b_end - b_length[b_ids]
    of_b = np.repeat(np.array([0, 1], dtype=np.int8), [len(a_ids), len(b_ids)])
    order, group = coalesce(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]), of_b)
    left, right = overlaps(a_start, a_end, b_start, b_end)
    n = len(texts)
    text_of_a = np.repeat(np.arange(n), counts[0])
    text_of = np.concatenate([text_of_a, np.repeat(np.arange(n), counts[1])])
    # In a group the A tokens come first.
    shown = np.lexsort((of_b[order], group))
    order, group = order[shown], group[shown]
    next_group = np.append(group[1:], -1)
    next_side = np.append(of_b[order][1:], -1)
    mark = np.where(next_group != group, 3, np.where(next_side != of_b[order], 2, 1))
    edges = np.concatenate([[0], np.cumsum(np.add(*counts))])
    filled = edges[1:] > edges[:-1]
    mark[edges[1:][filled] - 1] = 0
    words = (np.concatenate([a_ids, b_ids])[order] * 4 + mark).tolist()
    n_groups = np.bincount(text_of[order][mark % 3 == 0], minlength=n)
    link_text = text_of_a[left]
    n_links = np.bincount(link_text, minlength=n)
    code = a_ids[left] << 32 | b_ids[right]
    ends = np.cumsum(n_links).tolist()
    for k in range(n):
        pairs, times = np.unique(code[ends[k] - int(n_links[k]) : ends[k]], return_counts=True)
        line = "".join([printed[w] for w in words[edges[k] : edges[k + 1]]])
        yield counts[0][k], counts[1][k], int(n_groups[k]), int(n_links[k]), line, pairs, times


_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, a array<int>, b array<int>, times array<int>"


def _aligned(params: AlignParams):
    def lists(values: list[np.ndarray]) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Kept in a written table, so that a row keeps its number.
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            _, offsets = bw.column_bytes(batch.column("text"))
            for first, last in bw.chunks(offsets, params.chunk_bytes):
                texts = [t or "" for t in batch.column("text").slice(first, last - first).to_pylist()]
                found = list(align(texts, params))
                figures = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
                digests = pa.array([f[4] and hashlib.sha256(f[4].encode()).hexdigest() for f in found], pa.string())
                a, b, times = [f[5] >> 32 for f in found], [f[5] & 0xFFFFFFFF for f in found], [f[6] for f in found]
                rows = pa.array(np.arange(row, row + len(found)))
                row += len(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), *figures, digests, rows, lists(a), lists(b), lists(times)],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row", "a", "b", "times"],
                )

    return run


def pair_counts(each: DataFrame) -> DataFrame:
    """(a, b, documents, best): how many documents hold a pair, and whether no pair of its A id is held by more."""
    counts = materialise(each.groupBy("a", "b").agg(F.count("*").alias("documents")))
    # One row for each id of A's vocabulary at most.
    highest = counted(counts.groupBy("a").agg(F.max("documents").alias("most")))
    return counts.join(highest, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _least_hot(counts: DataFrame, hot_pairs: int) -> int:
    """The smallest power of two that at most ``hot_pairs`` pairs reach in documents; the driver gets one number for each power."""
    power = F.floor(F.log2("documents")).cast("int")
    sizes = dict(counts.groupBy(power.alias("power")).count().collect())
    total, least = 0, max(sizes, default=0) + 1
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > hot_pairs:
            break
        least = k
    return 1 << least


def alignment(docs: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = materialise(docs.select("doc_id", "text").mapInArrow(_aligned(params), f"doc_id {kind}, {_COLUMNS}"))
    zipped = F.arrays_zip("a", "b", "times")
    each = stored.select("row", F.inline(zipped))
    counts = materialise(pair_counts(each))
    least = _least_hot(counts, params.hot_pairs)
    frequent = F.broadcast(counts.filter(F.col("documents") >= least))
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("documents")).alias("count_sum"),
    ]
    hot = each.join(frequent, ["a", "b"]).groupBy("row").agg(*sums)
    rest = each.join(frequent, ["a", "b"], "left_anti").join(counts.filter(F.col("documents") < least), ["a", "b"])
    found = hot.union(rest.groupBy("row").agg(*sums)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    figures = stored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row")
    return figures.join(found, "row", "left").na.fill(0, ["n_best", "count_sum"]).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
