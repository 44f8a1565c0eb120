"""Best-fit packing by bin completion with branch and bound.

Texts become token ids with a public tokenizer; only documents longer than a sequence are cut. Pieces are dealt into
groups of about ``group_pieces`` at random by their id, so a group's fill is that of the whole table, and each group is
packed in one task: sequences are opened with the largest piece left, and the undominated fillings of the rest of the
sequence (no piece in it can be swapped for a larger one that still fits) are tried in order of waste. Best-fit
decreasing gives the first incumbent; a branch is cut when its waste so far already forces as many sequences as
the incumbent has, and the search ends when the incumbent meets the volume bound. Pieces of a whole sequence are set aside first.
The search goes by bounded discrepancies: first the best filling of every sequence, then paths that leave the best fillings
by one place in all, then by two, four and so on, until nothing was left out. ``max_nodes`` (or five nodes a sequence, if that is
more) bounds the search of a group, and ``max_fillings`` that of a sequence, after which the incumbent stands; every piece is
placed in any case.

Defined cases: a null or empty text is the end token alone; equal pieces are interchangeable and ties go by id; repeated
rows are pieces of their own, told apart by their place in the group; an empty table gives an empty result. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promiselens.session import materialise

# Letters whose lower case is one letter, then ASCII signs without the apostrophe, which may begin a contraction.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
PLAIN_WORD = re.compile(f"([{LETTERS}{LETTERS.lower()}]+)([!-&(-/:-@\\[-`{{-~]*)")
CACHE_WORDS = 400_000  # encoded words a Python worker remembers, twice over: about 150 MB


@dataclass(frozen=True)
class PackParams:
    tokenizer: str = "word_bpe_49k.json"  # file of public_tokenizers, or a path
    sequence: int = 4096
    end_id: int = 1
    group_pieces: int = 4000
    max_nodes: int = 20_000
    max_fillings: int = 400  # partial fillings looked at for one sequence
    tasks_per_core: int = 16  # at most, for the search of the groups


def tokenizer_file(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Ids of words; one that is not there yet is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


class WordEncoder:
    """Ids of whole texts as bytes, for tokenizers that drop white space: one encoding per different word.

    White space is never inside a token of such a tokenizer, so the ids of a text are those of its parts between blanks and line ends,
    one after another. A part of letters and signs is parted once more, and its lower-case letters go to the model alone, which
    is the costly step; all other parts go through the whole tokenizer. Two generations of a dictionary bound the memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        # What the tokenizer makes of each letter before the model sees it.
        before = tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelled = {ord(c): "".join(part for part, _ in before(c)) for c in LETTERS.lower()}
        self.young, self.old = _Words(self.word), {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, _Words(self.word)
        ids = self.young.__getitem__
        return [b"".join(map(ids, t.replace("\n", " ").split(" "))) for t in texts]

    def word(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            m = PLAIN_WORD.fullmatch(word)
            # Letters and the signs after them are tokenized apart, and case makes no difference.
            ids = self.known(m[1].lower(), True) + self.known(m[2], False) if m else self.known(word, False)
        return ids

    def known(self, part: str, letters: bool) -> bytes:
        ids = self.young.get(part)
        if ids is None:
            ids = self.old.get(part)
            if ids is None:
                found = [t.id for t in self.merge(part.translate(self.spelled))] if letters else self.encode(part, add_special_tokens=False).ids
                ids = array("I", found).tobytes()
            self.young[part] = ids
        return ids


_encoders: dict[str, WordEncoder] = {}  # a worker keeps what it has learnt for its next tasks


def _pieces(params: PackParams, path: str):
    end = np.array([params.end_id], dtype="<u4").tobytes()
    width = 4 * params.sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                rows, piece, start, length, crc = [], [], [], [], []
                texts = pc.fill_null(some.column("text"), "").to_pylist()
                for row, ids in enumerate(encoder(texts)):
                    ids += end
                    for k in range(0, len(ids), width):
                        part = ids[k : k + width]
                        rows.append(row)
                        piece.append(k // width)
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(rows, pa.int64()))]
                    + [pa.array(v, pa.int64()) for v in (piece, start, length, crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Best-fit decreasing over ``sizes`` (largest first); lists of places in ``sizes``."""
    bins: list[list[int]] = []
    left: list[tuple[int, int]] = []  # (room left, bin), ordered
    for i, size in enumerate(sizes):
        at = bisect_right(left, (size, -1))
        if at == len(left):
            bins.append([i])
            insort(left, (room - size, len(bins) - 1))
        else:
            free, b = left.pop(at)
            bins[b].append(i)
            if free > size:
                insort(left, (free - size, b))
    return bins


def fillings(order: list[int], counts: dict[int, int], room: int, limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, sizes) of undominated fillings of ``room``, least waste first; ``order`` holds the sizes ascending.

    Sizes are tried largest first, most copies first. A filling is dominated if a size left out fits into its waste, or
    in place of a smaller one together with the waste. About ``limit`` partial fillings are looked at; one without waste is
    enough once eight were found. Of equal waste the filling with fewer, larger pieces comes first: small pieces fit anywhere,
    so the last sequences need them.
    """
    found: set[tuple[int, tuple[int, ...]]] = set()
    stack: list[tuple[int, int, tuple[int, ...]]] = [(len(order) - 1, room, ())]
    looked = 0
    while stack and (looked < limit or not found):
        k, free, chosen = stack.pop()
        looked += 1
        k = min(k, bisect_right(order, free) - 1)
        if k < 0:
            found.add((free, chosen))
            if free == 0 and len(found) >= 8:
                break
            continue
        size = order[k]
        stack.append((k - 1, free, chosen))
        for n in range(1, min(counts[size], free // size) + 1):
            stack.append((k - 1, free - n * size, chosen + (size,) * n))

    def dominated(waste: int, chosen: tuple[int, ...]) -> bool:
        for c in {0, *chosen} if waste else ():
            at = bisect_right(order, c)
            while at < len(order) and order[at] <= c + waste:
                if counts[order[at]] > chosen.count(order[at]):
                    return True
                at += 1
        return False

    def rank(filling: tuple[int, tuple[int, ...]]) -> tuple:
        return filling[0], len(filling[1]), [-s for s in filling[1]]

    return sorted((f for f in found if not dominated(*f)), key=rank) or sorted(found, key=rank)[:1]


class _Stock:
    """Sizes still to place, with counts and in ascending order."""

    def __init__(self, sizes: list[int]):
        self.counts: dict[int, int] = {}
        for s in sizes:
            self.counts[s] = self.counts.get(s, 0) + 1
        self.order = sorted(self.counts)

    def take(self, sizes: tuple[int, ...]) -> None:
        for s in sizes:
            self.counts[s] -= 1
            if not self.counts[s]:
                del self.counts[s]
                self.order.pop(bisect_right(self.order, s) - 1)

    def put_back(self, sizes: tuple[int, ...]) -> None:
        for s in sizes:
            if s not in self.counts:
                self.counts[s] = 0
                insort(self.order, s)
            self.counts[s] += 1


def least_bins(sizes: list[int], room: int) -> int:
    """Lower bound of the bins: for every cut, pieces above half a bin need one each, and what pieces from the cut up to half a
    bin do not find beside them needs more. Cut 0 is the volume."""
    size = np.sort(np.asarray(sizes, dtype=np.int64))
    if not len(size):
        return 0
    upto = np.concatenate(([0], np.cumsum(size)))
    half = int(np.searchsorted(size, room // 2, side="right"))
    cuts = np.unique(np.concatenate(([0], size[:half])))
    first = np.searchsorted(size, cuts, side="left")
    beside = np.searchsorted(size, room - cuts, side="right")  # pieces above room - cut share with none of these
    free = (beside - half) * room - (upto[beside] - upto[half])
    more = np.maximum(0, -(-(upto[half] - upto[first] - free) // room))
    return int((len(size) - half + more).max())


def pack(sizes: list[int], room: int, max_nodes: int, limit: int = 400) -> list[list[int]]:
    """Bins of places in ``sizes``. Sizes must be 1 .. room.

    At least ``max_nodes`` sequences are closed in the search, and at least five for each sequence of the group.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    full = [[i] for i in order if sizes[i] == room]
    order = order[len(full) :]
    best = [[order[i] for i in b] for b in best_fit([sizes[i] for i in order], room)]
    total = sum(sizes[i] for i in order)
    bound = least_bins([sizes[i] for i in order], room)
    stock, waste, nodes = _Stock([sizes[i] for i in order]), 0, 0
    max_nodes = max(max_nodes, 5 * len(best))
    chosen: list[tuple[int, tuple[int, ...]]] = []  # (waste, sizes) of the bins closed so far
    # Per open depth: largest size, fillings, the next to try, and how far from the first ones the bins below may go together.
    options: list[list] = []

    def open_bin(away: int) -> None:
        large = stock.order[-1]
        stock.take((large,))
        found = fillings(stock.order, stock.counts, room - large, limit)
        stock.put_back((large,))
        options.append([large, found, 0, away])

    def close_last() -> None:
        nonlocal waste
        free, some = chosen.pop()
        stock.put_back(some)
        waste -= free

    reach, cut = 0, True
    while cut and len(best) > bound and nodes < max_nodes:
        cut = False
        open_bin(reach)
        while options:
            large, found, at, away = options[-1]
            done = len(best) <= bound or nodes >= max_nodes
            cut |= away < at < len(found)
            # Bins below the incumbent's number leave this much waste; fillings come in order of theirs.
            if done or at > away or at == len(found) or waste + found[at][0] > (len(best) - 1) * room - total:
                options.pop()
                if chosen:
                    close_last()
                continue
            options[-1][2] += 1
            free, others = found[at]
            nodes += 1
            stock.take((large, *others))
            chosen.append((free, (large, *others)))
            waste += free
            if stock.order:
                open_bin(away - at)
                continue
            places: dict[int, list[int]] = {}
            for i in reversed(order):
                places.setdefault(sizes[i], []).append(i)
            best = [[places[s].pop() for s in some] for _, some in chosen]
            close_last()
        reach = 2 * reach or 1
    return full + best


def _pack_group(params: PackParams):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes = rows["length"].tolist()
        sequence = np.zeros(len(sizes), dtype=np.int64)
        offset = np.zeros(len(sizes), dtype=np.int64)
        for number, places in enumerate(pack(sizes, params.sequence, params.max_nodes, params.max_fillings)):
            at = 0
            for i in places:
                sequence[i], offset[i] = (key[0] << 32) + number, at
                at += sizes[i]
        return rows.drop(columns="group").assign(sequence_id=sequence, offset=offset)

    return run


def best_fit_packing(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, length long, ids_crc32 long"
    encode = _pieces(params, tokenizer_file(params.tokenizer))
    pieces = docs.select("doc_id", "text").mapInArrow(encode, schema)
    # Rows without an id are told apart by a number stored with them: many with equal texts are no single group.
    number = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("number")
    pieces = materialise(pieces.select("*", number))
    groups = max(1, round(pieces.count() / params.group_pieces))
    # Hashing by piece also spreads the pieces of one long document and repeated rows of small groups of ids.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "number"), F.lit(groups))).drop("number")
    # A group costs seconds of search and few bytes, so the number of tasks follows the groups and is not merged by size.
    tasks = min(4 * groups, params.tasks_per_core * docs.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, "group").groupBy("group").applyInPandas(_pack_group(params), f"{schema}, sequence_id long, offset long")
