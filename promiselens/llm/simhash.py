"""SimHash near duplicates: segment bit counts on a grid, Manhattan distance as a lower bound, then an exact check.

1. Each text becomes a 64-bit fingerprint: a bit is set if it is set in over half of the XXH64 hashes (seed 42) of its word
   shingles, repeats included. Rows with one fingerprint are one point; only distinct points go on.
2. A point is embedded as 32 counts, the set bits of each two-bit segment. One changed bit moves one count by one, so the
   Manhattan distance of two embeddings never exceeds the number of differing bits. Counts are kept in unary (0, 1, 2 as 00, 01,
   11), which makes that distance the bit count of one exclusive or.
3. A grid range join finds what may link. ``bits`` steps spread over ``bits // 2 + 1`` parts of the segments leave one part
   with one step at most, so each part has a grid of its own with cells of width one: a point lies in the cell of its counts and
   looks into the cells one count above (a pair one step apart meets from its lower side). Pairs of a cell are kept
   if the distance over all segments allows a link, and then by the differing bits themselves.
4. A cell beyond ``hot_cell`` points is dealt in blocks. Each pair of blocks is one row of work of bounded size and returns
   a spanning forest of its links, so no list of pairs grows with the square of a cell and no component falls apart.
5. Components by alternating large-star and small-star on tables; a component's id is the smallest id of its rows.

Defined cases: null, empty and white texts have fingerprint zero, which links like any other; fewer words than a shingle are
one shingle; repeated rows and rows without an id count as rows of their fingerprint (a component in which no row has an
id has a null id); an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promiselens.llm import bytewords as bw
from promiselens.llm.common import counted
from promiselens.llm.minhash import components
from promiselens.session import materialise

SEED = 42
SEGMENTS = 32  # of two bits
LOW_BITS = 0x5555555555555555  # the lower bit of every segment
COUNTED_AT_ONCE = 1 << 16  # hashes whose bits are unpacked together


@dataclass(frozen=True)
class SimParams:
    words: int = 5  # per shingle
    bits: int = 3  # link at this many differing bits or fewer
    hot_cell: int = 512  # points of a cell that a plain join may compare with all that look into it
    block: int = 4096  # points of one block of a larger cell

    @property
    def parts(self) -> list[tuple[int, int]]:
        """(first, end) bits of each part of the segments."""
        n = self.bits // 2 + 1
        edges = [2 * (k * SEGMENTS // n) for k in range(n + 1)]
        return list(zip(edges, edges[1:]))


def fingerprint(body: bytes, words: int) -> int:
    """Unsigned fingerprint of one UTF-8 text; ``bytes.split`` and ``lower`` know the six ASCII blanks and A-Z only."""
    found = body.lower().split()
    if not found:
        return 0
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    size = min(words, len(found))
    starts = (ends - lengths)[: len(found) - size + 1].tolist()
    joined = b" ".join(found)
    del found
    digest, stops, n = xxhash.xxh64_intdigest, ends[size - 1 :].tolist(), len(starts)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), "<u8", n)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, COUNTED_AT_ONCE):
        part = hashes[at : at + COUNTED_AT_ONCE].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fingerprint), the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.column_bytes(batch.column("text"))
            found = [fingerprint(data[a:b].tobytes(), words) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            signed = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def unary(point: Column) -> Column:
    """The counts of all segments, each in unary in its own two bits."""
    low, above = F.lit(LOW_BITS), F.shiftrightunsigned(point, 1)
    return point.bitwiseOR(above).bitwiseAND(low).bitwiseOR(F.shiftleft(point.bitwiseAND(above).bitwiseAND(low), 1))


def cells(points: DataFrame, params: SimParams) -> DataFrame:
    """(fp, part, cell, looks): the home cell of each point in every part, and the cells that it looks into."""
    counts = unary(F.col("fp"))
    low, free = F.lit(LOW_BITS), F.bitwise_not("counts")
    # A count of 0 grows by its lower bit, a count of 1 by its upper one.
    grows = free.bitwiseAND(low).bitwiseOR(F.shiftleft(F.col("counts").bitwiseAND(low), 1).bitwiseAND(free))
    places = []
    for part, (first, end) in enumerate(params.parts):
        own = F.col("counts").bitwiseAND(F.lit(_signed((1 << end) - (1 << first))))
        places.append(F.struct(F.lit(part).alias("part"), own.alias("cell"), F.lit(False).alias("looks")))
        for bit in range(first, end):
            step = F.lit(_signed(1 << bit))
            above = F.when(F.col("grows").bitwiseAND(step) != 0, own.bitwiseOR(step))
            places.append(F.struct(F.lit(part).alias("part"), above.alias("cell"), F.lit(True).alias("looks")))
    embedded = points.select("fp", counts.alias("counts")).withColumn("grows", grows)
    return embedded.select("fp", F.inline(F.array(*places))).filter("cell is not null")


def _forest(points: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (one side, other side) that join all points that links join; each point is compared with those still alone."""
    alone = np.unique(points)
    while len(alone):
        reached, alone = [alone[0]], alone[1:]
        while reached and len(alone):
            at = reached.pop()
            near = np.bitwise_count(alone ^ at) <= bits
            if near.any():
                found, alone = alone[near], alone[~near]
                reached.extend(found)
                yield np.full(len(found), at), found


def _forests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column("unit"):
                for a, b in _forest(unit.values.to_numpy().view(np.uint64), bits):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def links(points: DataFrame, params: SimParams) -> DataFrame:
    """(a, b) of distinct points ``fp``: verified links that keep every component connected."""
    placed = cells(points, params)
    homes = placed.filter("not looks").drop("looks")
    hot = counted(homes.groupBy("part", "cell").count().filter(F.col("count") > params.hot_cell).drop("count"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    bound = unary(F.col("a")).bitwiseXOR(unary(F.col("b")))
    plain = (
        homes.join(hot, ["part", "cell"], "left_anti")
        .withColumnRenamed("fp", "a")
        .join(placed.withColumnRenamed("fp", "b"), ["part", "cell"])
        .filter(F.col("looks") | (F.col("a") < F.col("b")))
        .filter((F.bit_count(bound) <= params.bits) & (F.bit_count(differ) <= params.bits))
        .select("a", "b")
    )
    crowded = materialise(placed.join(hot, ["part", "cell"], "left_semi").drop("looks"))
    sizes = crowded.groupBy("part", "cell").agg(F.ceil(F.count("*") / params.block).cast("int").alias("of"))
    dealt = crowded.join(counted(sizes), ["part", "cell"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("of")).cast("int"))
    units = (
        dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        .groupBy("part", "cell", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
        .agg(F.collect_list("fp").alias("unit"))
    )
    forests = units.select("unit").mapInArrow(_forests(params.bits), "a long, b long")
    return materialise(plain.union(forests).distinct())


def near_duplicates(docs: DataFrame, params: SimParams = SimParams()) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; the fingerprint's bits are those of a long."""
    printed = materialise(fingerprints(docs, params.words))
    points = materialise(printed.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("low")))
    found = components(links(points.select("fp"), params)).withColumnRenamed("node", "fp")
    # Only points with a link have another smallest id than their own rows'.
    moved = points.join(found, "fp").unionByName(
        points.join(found.select(F.col("component").alias("fp")).distinct(), "fp", "left_semi").withColumn("component", F.col("fp"))
    ).distinct()
    lowest = moved.groupBy("component").agg(F.min("low").alias("least"))
    of_point = points.join(moved.join(lowest, "component").select("fp", "least"), "fp", "left")
    labels = of_point.select(F.col("fp").alias("fingerprint"), F.coalesce("least", "low").alias("component_id"))
    return printed.join(counted(labels), "fingerprint").select("doc_id", "fingerprint", "component_id")


def hexadecimal(point: Column) -> Column:
    """16 lowercase digits."""
    return F.lower(F.lpad(F.hex(point), 16, "0"))
