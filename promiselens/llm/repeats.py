"""Exact removal of repeated byte strings over a whole collection, built column by column.

A byte goes if a string of ``length`` bytes over it also starts earlier (smaller id, or same document, earlier start).

1. Exact copies of a text go as a whole; only the first of each text is looked into.
2. Anchors: of every ``length`` bytes the smallest hash of ``gram`` bytes is kept (ties too). Equal strings have their
   anchor in the same place, so equal strings always meet in the group of that anchor, aligned at it, and the bytes
   around the anchor (its context) hold every string of the anchor.
3. In each group the contexts that repeat an earlier one as a whole are settled by their hash. Only where a group
   holds different contexts are bytes needed: those contexts are fetched and transformed column-wise. Each round
   inserts one symbol of every context, re-sorts the rows stably by it (a positional Burrows-Wheeler transform) and updates the
   common lengths of neighbours; neighbours with ``length`` symbols in common end in the same string, and all but the
   earliest of such a run go. Rounds are as many as a context has bytes, not as the longest document has.
4. The spans of each document are merged and cut out.

Groups of more than ``group_rows`` different contexts go another exact way: one row per string, whose earliest
place is found by an aggregation that combines on the map side.

Defined cases: null and empty texts have no bytes, nothing removed and the digest of nothing; texts below ``length`` bytes stay;
rows without an id keep all their bytes; repeated rows (same id) count as one document and give equal rows, and if their
texts differ any one of them stands for the id; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promiselens.llm import bytewords as bw
from promiselens.llm.common import counted
from promiselens.session import materialise

LAST = (1 << 63) - 1


@dataclass(frozen=True)
class RepeatParams:
    length: int = 100
    gram: int = 32
    group_rows: int = 50_000  # contexts that one transform holds at most

    @property
    def reach(self) -> int:
        """Bytes of context on either side of an anchor."""
        return self.length - self.gram


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick(values[i : i + width]) for every i, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    return pick(out[: len(out) - (width - reach)], out[width - reach :]) if reach < width else out


def anchors(data: np.ndarray, offsets: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, gram hash, context hash) of all anchors of the texts of one chunk."""
    none = np.zeros(0, np.int64)
    if len(data) < p.length:
        return none, none, none, none
    sums = bw.running_sums(data)
    begin = np.arange(len(data) - p.gram + 1)
    grams = bw.range_hash(sums, begin, begin + p.gram)
    grams |= np.uint64(1)
    owner_end = np.repeat(offsets[1:], np.diff(offsets))
    lowest = _sliding(grams, p.reach + 1, np.minimum)
    inside = np.arange(len(lowest)) + p.length <= owner_end[: len(lowest)]
    lowest = np.where(inside, lowest, np.uint64(0))
    padded = np.concatenate((np.zeros(p.reach, np.uint64), lowest, np.zeros(p.reach, np.uint64)))
    highest = _sliding(padded, p.reach + 1, np.maximum)  # over the strings that hold the gram
    at = np.flatnonzero(highest == grams)
    text = np.searchsorted(offsets, at, side="right") - 1
    left = np.maximum(at - p.reach, offsets[text])
    right = np.minimum(at + p.length, offsets[text + 1])
    context = bw.range_hash(sums, left, right)
    context = bw.mix(context + ((at - left) * 1024 + (right - at)).astype(np.uint64))
    return text, at - offsets[text], grams[at].view(np.int64), context.view(np.int64)


def _again(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Anchors of one chunk whose context is that of an earlier anchor of the chunk."""
    order = np.lexsort((at, doc, context, gram))
    out = np.zeros(len(gram), dtype=bool)
    out[order[1:]] = (gram[order][1:] == gram[order][:-1]) & (context[order][1:] == context[order][:-1])
    return out


def _joined(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of touching spans that come in order within each document: (start, end, row of the first)."""
    if not len(doc):
        return start, end, np.zeros(0, np.int64)
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])))
    row = np.flatnonzero(fresh)
    return start[row], end[np.concatenate((row[1:], [len(doc)])) - 1], row


def _anchor_rows(p: RepeatParams):
    """Anchors to compare with the whole collection (end -1), and spans that are settled within a chunk.

    A text that repeats itself, or a very common passage, has many anchors of the same context: only the first of
    a chunk goes on, so such a gram is no hot key. Settled spans take a gram of their own and spread evenly.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.column_bytes(batch.column("text"))
            ids = batch.column("doc").to_numpy()
            for first, last in bw.chunks(offsets):
                own = offsets[first : last + 1]
                text, at, gram, context = anchors(data[own[0] : own[-1]], own - own[0], p)
                doc = ids[first:last][text]
                again = _again(gram, context, doc, at)
                begin, end, row = _joined(doc[again], at[again] - p.reach, at[again] + p.length)
                once = ~again
                spread = bw.mix((begin + 1).astype(np.uint64) * np.uint64(bw.BASE) + doc[again][row].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((gram[once], spread.view(np.int64)))),
                        pa.array(np.concatenate((context[once], np.zeros(len(row), np.int64)))),
                        pa.array(np.concatenate((doc[once], doc[again][row]))),
                        pa.array(np.concatenate((at[once], begin))),
                        pa.array(np.concatenate((np.full(once.sum(), -1), end))),
                    ],
                    ["gram", "context", "doc", "at", "end"],
                )

    return run


def _context_rows(p: RepeatParams):
    """(doc, text, places) -> one row per place: its context, filled up with zeros, and the part that is text."""
    width = p.length + p.reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(batch.column("doc"), batch.column("text"), batch.column("places")):
                body = text.as_buffer().to_pybytes()
                rows = [(r["gram"], r["at"]) for r in places.as_py()]
                contexts, lows, highs = [], [], []
                for _, at in rows:
                    low, high = max(0, at - p.reach), min(len(body), at + p.length)
                    lows.append(low - at + p.reach)
                    highs.append(high - at + p.reach)
                    contexts.append(b"\0" * lows[-1] + body[low:high] + b"\0" * (width - highs[-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([doc.as_py()] * len(rows), pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array(lows, pa.int32()),
                        pa.array(highs, pa.int32()),
                        pa.array(contexts, pa.binary()),
                    ],
                    ["gram", "doc", "at", "low", "high", "bytes"],
                )

    return run


def transform(group: np.ndarray, symbols: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Column-wise transform of aligned rows, rows of a group together and in their order.

    Yields (column of the string's start, rows that repeat an earlier row of their group there).
    """
    rows, columns = symbols.shape
    order = np.arange(rows)
    common = np.zeros(rows + 1, dtype=np.int32)  # symbols that a row shares with the row before it, read backwards
    base = group.astype(np.int64) << 9
    for k in range(columns):
        key = base[order] | symbols[order, k]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        fresh = np.zeros(rows + 1, dtype=np.int32)
        start, end = moved[same - 1] + 1, moved[same]
        shared = common[end]
        apart = np.flatnonzero(start < end)
        if len(apart):
            bounds = np.stack((start[apart], end[apart] + 1), axis=1).ravel()
            shared[apart] = np.minimum.reduceat(common, bounds)[::2]
        fresh[same] = shared + 1
        order, common = order[moved], fresh
        if k >= length - 1:
            joined = common[:rows] >= length
            if joined.any():
                begins = np.flatnonzero(~joined)
                earliest = np.minimum.reduceat(order, begins)
                run = np.cumsum(~joined) - 1
                yield k - length + 1, order[order != earliest[run]]


def _repeated(p: RepeatParams, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Spans (doc, start, end) of the strings of whole groups that start earlier too."""
    table = pa.Table.from_batches(rows).sort_by([("gram", "ascending"), ("doc", "ascending"), ("at", "ascending")])
    gram, doc, at, low, high = (table.column(c).to_numpy() for c in ("gram", "doc", "at", "low", "high"))
    width = p.length + p.reach
    body = b"".join(x.as_py() for x in table.column("bytes"))
    symbols = np.frombuffer(body, np.uint8).reshape(-1, width).astype(np.int16)
    place = np.arange(width)
    symbols[(place < low[:, None]) | (place >= high[:, None])] = 256
    group = np.concatenate(([0], np.cumsum(gram[1:] != gram[:-1])))
    hit = np.zeros((len(gram), p.reach + 1), dtype=bool)
    for start, found in transform(group, symbols, p.length):
        hit[found, start] = (low[found] <= start) & (start + p.length <= high[found])
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    begin = at[row] - p.reach
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[row]), pa.array(begin + first), pa.array(begin + after - 1 + p.length)], ["doc", "start", "end"]
    )


def _group_spans(p: RepeatParams):
    """Rows sorted by gram; groups are transformed together as soon as there are enough of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            if n + len(gram) > p.group_rows and len(gram):
                # Whole groups only: what belongs to the last gram waits.
                cut = int(np.searchsorted(gram, gram[-1]))
                if cut:
                    yield _repeated(p, [*held, batch.slice(0, cut)])
                    held, n, batch = [], 0, batch.slice(cut)
                elif held and held[-1].column("gram")[-1].as_py() != int(gram[0]):
                    yield _repeated(p, held)
                    held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield _repeated(p, held)

    return run


def _strings(p: RepeatParams):
    """One row per string of a context: two hashes of it and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = p.length + p.reach
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                data = np.frombuffer(b"".join(x.as_py() for x in some.column("bytes")), np.uint8)
                sums = bw.running_sums(data)
                low, high, doc, place = (some.column(c).to_numpy() for c in ("low", "high", "doc", "at"))
                row, start = np.nonzero(
                    (np.arange(p.reach + 1) >= low[:, None]) & (np.arange(p.reach + 1) + p.length <= high[:, None])
                )
                begin = row * width + start
                half = p.length // 2
                one, two = bw.range_hash(sums, begin, begin + p.length), bw.range_hash(sums, begin, begin + half)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(doc[row]), pa.array(place[row] - p.reach + start)],
                    ["one", "two", "doc", "start"],
                )

    return run


def repeated_spans(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """(doc, spans) with all spans to remove, unmerged; ``docs``: doc, text, one row per document and per text."""
    found = docs.mapInArrow(_anchor_rows(p), "gram long, context long, doc long, at long, end long")
    # One exchange by gram serves both windows. Exact copies are gone, and so are repeats within a chunk.
    dealt = found.repartition("gram")
    same_context = W.partitionBy("gram", "context").orderBy("doc", "at")
    same_gram = W.partitionBy("gram")
    ranked = dealt.withColumn("place", F.row_number().over(same_context)).withColumn(
        "contested", F.min("context").over(same_gram) != F.max("context").over(same_gram)
    )
    repeat = ((F.col("place") > 1) | (F.col("end") >= 0)).alias("repeat")
    settled = materialise(ranked.filter("place > 1 or contested or end >= 0").select("gram", "doc", "at", "end", repeat))
    known = F.col("end") >= 0
    whole = settled.filter("repeat").select(
        "doc",
        F.when(known, F.col("at")).otherwise(F.col("at") - p.reach).alias("start"),
        F.when(known, F.col("end")).otherwise(F.col("at") + p.length).alias("end"),
    )
    contested = settled.filter("not repeat")
    places = contested.groupBy("doc").agg(F.collect_list(F.struct("gram", "at")).alias("places"))
    schema = "gram long, doc long, at long, low int, high int, bytes binary"
    contexts = docs.join(places.hint("shuffle_hash"), "doc").select("doc", "text", "places").mapInArrow(_context_rows(p), schema)
    large = counted(contested.groupBy("gram").count().filter(F.col("count") > p.group_rows).select("gram"))
    contexts = materialise(contexts)
    small = contexts.join(large, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
    partial = small.mapInArrow(_group_spans(p), "doc long, start long, end long")
    spans = whole.union(partial)
    if not large.isEmpty():
        strings = contexts.join(large, "gram", "left_semi").mapInArrow(_strings(p), "one long, two long, doc long, start long")
        by_doc = strings.groupBy("one", "two").agg(F.min("doc").alias("low"))
        firsts = strings.join(by_doc.withColumnRenamed("low", "doc"), ["one", "two", "doc"]).groupBy("one", "two", "doc").agg(F.min("start").alias("start"))
        late = strings.join(firsts, ["one", "two", "doc", "start"], "left_anti")
        spans = spans.union(late.select("doc", "start", (F.col("start") + p.length).alias("end")))
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of ``spans``, cut at the ends of the text."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        start, end = max(0, start), min(size, end)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        elif start < end:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            body = text.as_buffer().to_pybytes()
            ranges = spans.values
            gone = merged(list(zip(ranges.field("start").to_pylist(), ranges.field("end").to_pylist())), len(body))
            kept, at = hashlib.sha256(), 0
            for a, b in gone:
                kept.update(body[at:a])
                at = b
            kept.update(body[at:])
            rows.append((len(body), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [list(g) for g in gone]))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), *[pa.array(v, k) for v, k in zip(columns, kinds)]],
            ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a document to their maximal runs; ends past the text are cut off later."""
    for batch in batches:
        runs = []
        for spans in batch.column("spans"):
            pairs = spans.values
            found = merged(list(zip(pairs.field("start").to_pylist(), pairs.field("end").to_pylist())), LAST)
            runs.append([{"start": a, "end": b} for a, b in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(runs, kind)], ["doc", "spans"])


def remove_repeats(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed); ``removed`` lists the [start, end) byte runs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.col("doc_id").cast("long").alias("doc"), text.alias("text"))
    sized = keyed.select("doc_id", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    facts = materialise(sized)
    of_text = facts.groupBy("sha").agg(F.min("doc").alias("first"))
    copies = facts.filter(F.col("n_bytes") >= p.length).join(of_text, "sha").filter("doc > first").select("doc", "sha").distinct()
    copies = counted(copies)
    twice = counted(facts.groupBy("doc").count().filter("count > 1").select("doc"))
    long = keyed.filter((F.octet_length("text") >= p.length) & F.col("doc").isNotNull())
    looked = long.join(copies, "doc", "left_anti").select("doc", "text")
    if not twice.isEmpty():
        once = looked.join(twice, "doc", "left_semi").dropDuplicates(["doc"])
        looked = materialise(looked.join(twice, "doc", "left_anti").union(once))
    runs = repeated_spans(looked, p).mapInArrow(_merge, "doc long, spans array<struct<start:bigint,end:bigint>>")
    runs = counted(runs, weight=F.size("spans"))
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>"
    with_sha = looked.join(runs, "doc").select("doc", "text", "spans").mapInArrow(_cut, schema)
    cut = materialise(with_sha.drop("n_bytes"))
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    joined = facts.join(copies.withColumn("copy", F.lit(True)), ["doc", "sha"], "left").join(cut, "doc", "left")
    gone = F.col("copy").isNotNull()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, whole).otherwise(F.coalesce("removed", F.array().cast("array<array<bigint>>"))).alias("removed"),
    )
