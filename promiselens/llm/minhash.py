"""Near duplicates: many universal hash minima in bands, verified signatures and sets, and star components.

1. Each text becomes the set of its word shingles (64-bit hashes) and ``bands * rows`` minima of universal hash
   functions. Texts with the same set form a class; only the class's smallest id goes on.
2. Classes that agree on all minima of a band share a bucket. Small buckets compare signatures and pass on the pairs
   that may reach the threshold; those are verified on the full sets. In a large bucket every class is first verified against
   the bucket's smallest id, and the components of all links so far are taken. The largest component of a bucket
   needs no pair inside it: only the classes outside it are compared, with each other and with it. They are dealt in blocks, and
   each pair of blocks is one row of work that carries the sets: it verifies on them, skips pairs already connected
   and returns a forest. Copies of one page are one component after the first step, so their work is in proportion to
   their number; no link between parts is lost.
3. Components by alternating large-star and small-star on tables; each round is written to the shared folder.

The minima miss a pair at the threshold with a chance of (1 - t**rows)**bands; ``miss`` bounds it and sets the bands.

Defined cases: null, empty and white texts have no shingle and link with nothing; a text of fewer words than a
shingle is one shingle; repeated rows and equal sets are one class; rows with a null id are never a representative
(their component is the smallest id of their class, null if there is none); an empty table gives an empty result.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promiselens.llm import bytewords as bw
from promiselens.llm.common import as_row, by_content, content_of, counted, null_safe
from promiselens.session import materialise


@dataclass(frozen=True)
class NearParams:
    words: int = 5  # per shingle
    percent: int = 80  # link at 100 * intersection >= percent * union
    rows: int = 5  # minima per band
    miss: float = 1e-6  # highest chance that no band holds a pair at the threshold
    small_bucket: int = 64
    hot_class: int = 500  # equal sets beyond which a class is joined back apart from the others
    salts: int = 16  # copies of a large bucket's smallest id, so that its comparisons are dealt over tasks
    block_rows: int = 512
    block_shingles: int = 250_000
    slack: float = 0.15  # signatures this far below the threshold are still verified: more than four deviations

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of one chunk."""
    hashes, counts = bw.word_hashes(data, offsets, bw.NOT_WHITE, bw.ASCII_FOLD)
    factors = np.array([pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64) for k in range(words)], dtype=np.uint64)
    n = max(0, len(hashes) - words + 1)
    joined = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        joined += hashes[k : k + n] * factors[k]
    joined = bw.mix(joined)
    ends = np.cumsum(counts)
    for count, end in zip(counts.tolist(), ends.tolist()):
        start = end - count
        if count >= words:
            yield np.unique(joined[start : end - words + 1])
        elif count:
            whole = (hashes[start:end] * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)
            yield bw.mix(np.array([whole], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def _signatures(params: NearParams, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(97)
        size = params.bands * params.rows
        times = random.integers(0, 1 << 64, size, dtype=np.uint64) | np.uint64(1)
        plus = random.integers(0, 1 << 64, size, dtype=np.uint64)
        band_of = random.integers(0, 1 << 64, size, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            data, offsets = bw.column_bytes(batch.column("text"))
            for first, last in bw.chunks(offsets):
                own = offsets[first : last + 1]
                sets = list(shingle_hashes(data[own[0] : own[-1]], own - own[0], params.words))
                lengths = np.array([len(s) for s in sets])
                full = np.flatnonzero(lengths)
                minima = np.zeros((size, len(full)), dtype=np.uint64)
                if len(full):
                    joined = np.concatenate([sets[i] for i in full])
                    places = np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
                    buffer = np.empty_like(joined)
                    for k in range(size):
                        np.multiply(joined, times[k], out=buffer)
                        buffer += plus[k]
                        minima[k] = np.minimum.reduceat(buffer, places)
                minima >>= np.uint64(32)
                keyed = (minima * band_of[:, None]).reshape(params.bands, params.rows, -1).sum(axis=1, dtype=np.uint64)
                keyed = bw.mix(keyed + np.arange(params.bands, dtype=np.uint64)[:, None]).view(np.int64)
                low = (minima & np.uint64(255)).astype(np.uint8)
                bands: list = [None] * len(sets)
                signs: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                for at, i in enumerate(full.tolist()):
                    bands[i] = keyed[:, at]
                    signs[i] = low[:, at].tobytes()
                    s = sets[i]
                    keys[i] = np.array([s.sum(dtype=np.uint64), bw.mix(s).sum(dtype=np.uint64)]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(first, last - first) for c in keep],
                        pa.array(lengths, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(signs, pa.binary()),
                    ],
                    [*keep, "n", "key", "bands", "sign"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bw.column_bytes(batch.column("text"))
            for first, last in bw.chunks(offsets):
                own = offsets[first : last + 1]
                sets = [s.tobytes() for s in shingle_hashes(data[own[0] : own[-1]], own - own[0], words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(sets, pa.binary())], ["rep", "members"]
                )

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal signature bytes for all rows of ``left`` against all of ``right``, a block at a time."""
    out = np.empty((len(left), len(right)), dtype=np.float32)
    for i, row in enumerate(left):
        out[i] = (right == row).mean(axis=1)
    return out


def _candidates(params: NearParams):
    """Rows of (reps, signs) of one small bucket -> pairs whose signatures allow a link."""
    least = params.percent / 100 - params.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for bucket in batch.column("bucket"):
                rows = sorted({(r["rep"].as_py(), r["sign"].as_py()) for r in bucket.values})
                ids = [r[0] for r in rows]
                signs = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
                x, y = np.nonzero(np.triu(_agreement(signs, signs) >= least, 1))
                seen.update((ids[i], ids[j]) for i, j in zip(x.tolist(), y.tolist()) if ids[i] != ids[j])
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in seen], pa.int64()), pa.array([p[1] for p in seen], pa.int64())], ["a", "b"]
            )

    return run


def _verified(params: NearParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), params.percent)
                for x, y in zip(batch.column("set_a"), batch.column("set_b"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _forests(params: NearParams):
    """One row per pair of blocks of a large bucket -> a spanning forest of its verified links between components."""
    least = params.percent / 100 - params.slack

    def links(unit, same: bool) -> Iterator[tuple[int, int]]:
        rows = unit.values
        ids = rows.field("component").to_numpy()
        signs = np.frombuffer(b"".join(s.as_py() for s in rows.field("sign")), np.uint8).reshape(len(ids), -1)
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.field("members")]
        block = rows.field("block").to_numpy()
        x = np.arange(len(ids)) if same else np.flatnonzero(block == block.min())
        y = x if same else np.flatnonzero(block != block.min())
        close = _agreement(signs[x], signs[y])
        if same:
            close = np.triu(close, 1)
        i, j = np.nonzero(close >= least)
        _, first, known = np.unique(ids, return_index=True, return_inverse=True)
        parent = first[known].tolist()

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for k in np.argsort(-close[i, j], kind="stable").tolist():
            p, q = int(x[i[k]]), int(y[j[k]])
            rp, rq = root(p), root(q)
            if rp != rq and _linked(sets[p], sets[q], params.percent):
                parent[rp] = rq
                yield int(ids[p]), int(ids[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, i, j in zip(batch.column("unit"), batch.column("i"), batch.column("j")):
                found = sorted(set(links(unit, i.as_py() == j.as_py())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"]
                )

    return run


def linked_components(docs: DataFrame, reps: DataFrame, params: NearParams) -> DataFrame:
    """(node, component) over the links of class representatives (rep, n, bands, sign); a node without links has no row."""
    banded = reps.select("rep", "n", F.explode("bands").alias("band"))
    buckets = (
        banded.groupBy("band")
        .agg(F.count("*").alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high"))
        .filter("low < high")
        .select("band", "size", "low")
    )
    signed = reps.select("rep", "sign")
    members = materialise(banded.join(buckets, "band"))
    small = (
        members.filter(F.col("size") <= params.small_bucket)
        .join(signed, "rep")
        .groupBy("band")
        .agg(F.collect_list(F.struct("rep", "sign")).alias("bucket"))
        .select("bucket")
    )
    pairs = materialise(small.mapInArrow(_candidates(params), "a long, b long").distinct())
    large = members.filter(F.col("size") > params.small_bucket)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rep")).union(large.select("rep")).distinct()
    texts = docs.select("doc_id", "text").join(counted(needed).withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = materialise(texts.mapInArrow(_sets(params.words), "rep long, members binary").dropDuplicates(["rep"]))
    of_a = sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a"))
    of_b = sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b"))
    among_small = pairs.join(of_a, "a").join(of_b, "b")
    # A bucket's smallest id meets all its members, so its set is there once for each salt.
    star = large.filter("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    lows = of_a.join(large.select(F.col("low").alias("a")).distinct(), "a")
    salted = lows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))))
    with_low = star.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(params.salts)).cast("int")).join(salted, ["a", "salt"]).join(of_b, "b")
    compared = among_small.unionByName(with_low.drop("salt")).select("a", "b", "set_a", "set_b")
    found = components(compared.mapInArrow(_verified(params), "a long, b long"))
    return _joined(found, _left_over(large, found, sets.join(signed, "rep"), params))


def _left_over(large: DataFrame, found: DataFrame, full: DataFrame, params: NearParams) -> DataFrame:
    """Links between components of ``found`` that meet in a large bucket; ``large``: rep, band, n; ``full``: rep, members, sign."""
    placed = large.select("rep", "band", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    placed = materialise(placed.withColumn("component", F.coalesce("component", "rep")))
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    largest = F.max_by(F.struct("component", "rows", "shingles"), F.struct("rows", F.negative("component")))
    sizes = parts.groupBy("band").agg(largest.alias("main"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))

    def blocks(rows, shingles):
        return F.greatest(F.ceil(rows / params.block_rows), F.ceil(shingles / params.block_shingles), F.lit(1)).cast("int")

    apart = sizes.filter(F.col("rows") > F.col("main.rows")).select(
        "band",
        F.col("main.component").alias("main"),
        blocks(F.col("rows") - F.col("main.rows"), F.col("shingles") - F.col("main.shingles")).alias("others"),
        blocks(F.col("main.rows"), F.col("main.shingles")).alias("mains"),
    )
    hashed, inside = F.xxhash64("rep"), F.col("component") == F.col("main")
    # Blocks 0 .. others - 1 hold what is outside the largest component and meet all blocks; those of the component meet only these.
    dealt = placed.join(counted(apart), "band").select(
        "rep", "band", "component",
        F.when(inside, F.col("others") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int").alias("block"),
        F.sequence(F.lit(0), F.col("others") - 1 + F.when(inside, 0).otherwise(F.col("mains"))).alias("partners"),
    )
    units = (
        dealt.withColumn("with", F.explode("partners"))
        .join(full, "rep")
        .groupBy("band", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
        .agg(F.collect_list(F.struct("component", "block", "sign", "members")).alias("unit"))
    )
    return materialise(units.select("unit", "i", "j").mapInArrow(_forests(params), "a long, b long").distinct())


def _joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found`` with its components united along ``edges`` between them; a component goes by its smallest id."""
    if edges.isEmpty():
        return found
    united = counted(components(edges))
    moved = found.join(united.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return moved.select("node", F.coalesce("top", "component").alias("component")).unionByName(united)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): alternating large-star and small-star until nothing changes.

    Minima combine on the map side and the joins are on tables, so a node with many neighbours is no hot task.
    """

    def stars(pairs: DataFrame, source: DataFrame) -> DataFrame:
        least = source.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = stars(both, both).filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        star = stars(grown, grown)
        down = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v")))
        now = materialise(down.filter("u > v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    return _judged(docs.select("doc_id", "text"), params).drop("key")


def _judged(docs: DataFrame, params: NearParams) -> DataFrame:
    """All columns of ``docs`` but its text, n_shingles, the key of its class, component_id, kept."""
    keep = [c for c in docs.columns if c != "text"]
    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{types}, n long, key binary, bands array<long>, sign binary"
    signed = materialise(docs.mapInArrow(_signatures(params, keep), schema))
    classes = materialise(signed.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    reps = materialise(
        signed.select(F.col("doc_id").alias("rep"), "n", "key", "bands", "sign")
        .join(classes.filter("rep is not null"), ["rep", "key"], "left_semi")
        .dropDuplicates(["rep"])
    )
    found = linked_components(docs, reps, params)
    of_class = null_safe(
        classes, found.withColumnRenamed("node", "rep"), ["rep"], "left"
    ).select("key", "size", F.coalesce("component", "rep").alias("component"))
    # The rows of a large class would all meet in one task: few classes are large, so these are joined first.
    hot = counted(of_class.filter(F.col("size") > params.hot_class).drop("size"))
    cold = of_class.filter(F.col("size") <= params.hot_class).drop("size")
    rows = signed.select(*keep, "n", "key")
    joined = rows.join(hot, "key", "left_anti").join(cold, "key", "left").unionByName(rows.join(hot, "key"))
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select(*keep, F.col("n").alias("n_shingles"), "key", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def deduplicate(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id. Rows that link with nothing all stay.

    Of repeated rows of a kept id any one stays. Rows with a null id are told apart by their texts: of a class that has no other
    id one such row stays, of a class that has one none.
    """
    found = _judged(docs.select("doc_id", "text", content_of(F.col("text"))), params)
    # Groups of one are most of the table: only the rows that go are collected, and what they leave is deduplicated by class.
    gone = found.filter("not kept").select("doc_id", "content").distinct()
    left = by_content(docs, counted(gone), "left_anti")
    kept = found.filter("kept and n_shingles > 0").select("doc_id", "content", "key")
    again = kept.groupBy("doc_id", "key").count().filter("count > 1").select("doc_id", "key")
    repeated = counted(null_safe(kept, counted(again), ["doc_id", "key"], "left_semi").distinct())
    once = by_content(left, repeated, "left_anti")
    keyed = left.select(as_row(left), "doc_id", content_of(F.col("text")))
    one = null_safe(keyed, repeated, ["doc_id", "content"], "inner").dropDuplicates(["doc_id", "key"])
    return once.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
