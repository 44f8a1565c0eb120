"""Source divergence audit: how unlike the term frequencies of sources are, over a k-squared quadtree of the count matrix.

A language's groups (its sources) are the rows of a matrix of term counts, its kept terms the columns. Each count has a price
``p = 1 + floor(10**9 * (count + 1) / (total + terms))``, and two prices a distance ``f = floor((p - q)**2 / q)``. Part ``pair``
sums f over all kept terms for every ordered pair of sources; part ``term`` lists the terms that a source has too much of, against the
whole language.

1. Terms are counted per (language, source, term) inside the tasks that read the texts, flushed whenever a task
   holds ``held_terms`` entries, and added up by Spark.
2. The columns are dealt by a hash of the term in stripes of about ``stripe_terms``, most frequent first; the rows in blocks of
   ``block_rows`` sources. A unit of work is one stripe of two blocks, so its size is bounded whatever the data.
3. In a unit each block is a quadtree over its stripe: a node is a square of the matrix, halved in both directions at each level, and
   only nodes with a nonzero count are there. Two trees are walked together from the root: where both have nothing, all
   pairs of their rows get the price of their zeros times the columns, at once; otherwise the node's quarters follow, down to leaves of
   ``LEAF`` rows and columns, where f is taken cell by cell. The parts of all stripes are then summed by Spark.

All arithmetic is on integers. Prices are divided digit by digit (three times a thousand), so totals up to 9 * 10**15 occurrences a language
are exact, and the sum of a pair stays below 2**63 for up to 10**9 kept terms; beyond that Spark's ANSI mode stops instead of wrapping.

Defined cases: null text, language and source read as ''; each row is a document, repeated rows and rows without an id included; a
group without any kept term is there with count 0 everywhere; a language without kept terms has pairs of value 0 and no terms;
ties of value are ranked by the item's UTF-8 bytes; a language of one source has no pairs; an empty table gives an empty result.
Only ``text``, ``lang`` and ``source`` are read. The pairs of a language are as many as the square of its sources: that is the result
asked for, so a column of very many sources should be grouped first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promiselens.llm import bytewords as bw
from promiselens.llm.common import counted
from promiselens.session import materialise

LEAF = 8  # rows and columns of a leaf
TILES_AT_ONCE = 2048
PIECE_BYTES = 4 << 20  # a longer text is counted in pieces that end between terms

_TERM_BYTES = bytes.maketrans(
    bytes(c for c in range(128) if not chr(c).isalpha()), b" " * sum(not chr(c).isalpha() for c in range(128))
)


@dataclass(frozen=True)
class AuditParams:
    least_documents: int = 3  # of a language that hold a kept term
    top_terms: int = 200
    stripe_terms: int = 4096
    block_rows: int = 128
    held_terms: int = 300_000


def text_terms(body: bytes) -> Counter:
    """Occurrences of each term of one UTF-8 text: runs of letters A-Z, a-z and characters beyond ASCII, A-Z lower-cased."""
    body = body.lower().translate(_TERM_BYTES)
    if len(body) <= PIECE_BYTES:
        return Counter(body.split())
    found, at = Counter(), 0
    while 0 <= at < len(body):
        end = body.find(b" ", at + PIECE_BYTES)
        found.update(body[at : end if end >= 0 else len(body)].split())
        at = end
    return found


def _counted_terms(held_terms: int):
    def flushed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, documents) in held.items():
            if times:
                n = len(times)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * n, pa.string()),
                        pa.array([source] * n, pa.string()),
                        pa.array(list(times), pa.binary()).cast(pa.string()),
                        pa.array(list(times.values()), pa.int64()),
                        pa.array([documents[t] for t in times], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "documents"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0
        for batch in batches:
            data, offsets = bw.column_bytes(batch.column("text"))
            keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for key, a, b in zip(keys, offsets.tolist(), offsets[1:].tolist()):
                found = text_terms(data[a:b].tobytes())
                times, documents = held.setdefault(key, (Counter(), Counter()))
                entries -= len(times)
                times.update(found)
                documents.update(found.keys())
                entries += len(times)
                if entries > held_terms:
                    yield from flushed(held)
                    held, entries = {}, 0
        yield from flushed(held)

    return run


def price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)); 1 where there are no terms."""
    whole, rest = F.nullif(total + terms, F.lit(0)), n + 1
    value = F.lit(1)
    for power in (1_000_000, 1_000, 1):
        value = value + F.call_function("div", rest * 1000, whole) * power
        rest = rest * 1000 % whole
    return F.when(terms > 0, value).otherwise(F.lit(1)).cast("long")


class _Tree:
    """The quadtree of one block of a stripe: sorted node codes of every level, and the prices of its leaves."""

    def __init__(self, row: np.ndarray, col: np.ndarray, p: np.ndarray, zero: np.ndarray, width: int, levels: int):
        self.tiles = -(-len(zero) // LEAF)
        r, c = row // LEAF, col // LEAF
        code = self.code(r, c)
        leaves, of = np.unique(code, return_inverse=True)
        self.level = [leaves]
        for _ in range(levels):
            self.level.append(np.unique(self.level[-1] >> 2))
        padded = np.ones(self.tiles * LEAF, dtype=np.int64)
        padded[: len(zero)] = zero
        padded = padded.reshape(self.tiles, LEAF)
        leaf_row = np.zeros(len(leaves), dtype=np.int64)
        leaf_row[of] = r
        # Leaves first, then for each row of leaves one without counts.
        self.prices = np.repeat(np.concatenate([padded[leaf_row], padded])[:, :, None], LEAF, axis=2)
        self.prices[of, row % LEAF, col % LEAF] = p

    @staticmethod
    def code(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Bits of row and column in turn, so that a node's code is that of its parent and two more bits."""
        out = np.zeros(len(row), dtype=np.int64)
        for bit in range(28):
            out |= ((row >> bit & 1) << (2 * bit + 1)) | ((col >> bit & 1) << (2 * bit))
        return out

    def find(self, level: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Places of nodes in their level, -1 where there is none."""
        known, code = self.level[level], self.code(row, col)
        if not len(known):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        return np.where(known[at] == code, at, -1)

    def leaf_prices(self, place: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.prices[np.where(place >= 0, place, len(self.level[0]) + row)]


def joint_walk(a: _Tree, b: _Tree, zero_a: np.ndarray, zero_b: np.ndarray, width: int, levels: int, both: bool):
    """Sums of f over a stripe for all (row of a, row of b); with ``both`` also those of (row of b, row of a), else None."""
    sums = [np.zeros((a.tiles, b.tiles, LEAF, LEAF), dtype=np.int64) for _ in range(1 + both)]
    empty = np.zeros((a.tiles, b.tiles), dtype=np.int64)  # columns in which a pair of leaf rows has nothing
    x = y = c = np.zeros(1, dtype=np.int64)
    for level in range(levels, -1, -1):
        span = LEAF << level
        in_a, in_b = a.find(level, x, c), b.find(level, y, c)
        none = (in_a < 0) & (in_b < 0)
        here = np.zeros((-(-a.tiles >> level) + 1, -(-b.tiles >> level) + 1), dtype=np.int64)
        np.add.at(here, (x[none], y[none]), np.minimum(width, (c[none] + 1) * span) - c[none] * span)
        empty += here[np.arange(a.tiles)[:, None] >> level, np.arange(b.tiles)[None, :] >> level]
        x, y, c, in_a, in_b = (v[~none] for v in (x, y, c, in_a, in_b))
        if level:
            x, y, c = (
                (2 * v[:, None] + np.array([k >> s & 1 for k in range(8)])).ravel() for v, s in ((x, 2), (y, 1), (c, 0))
            )
            inside = (x << (level - 1) < a.tiles) & (y << (level - 1) < b.tiles) & (c * (span // 2) < width)
            x, y, c = x[inside], y[inside], c[inside]
    for at in range(0, len(x), TILES_AT_ONCE):
        now = slice(at, at + TILES_AT_ONCE)
        p = a.leaf_prices(in_a[now], x[now])[:, :, None, :]
        q = b.leaf_prices(in_b[now], y[now])[:, None, :, :]
        square = (p - q) ** 2
        # Columns beyond the last are no terms.
        square *= (c[now, None] * LEAF + np.arange(LEAF) < width)[:, None, None, :]
        np.add.at(sums[0], (x[now], y[now]), (square // q).sum(axis=3))
        if both:
            np.add.at(sums[1], (x[now], y[now]), (square // p).sum(axis=3))
    flat = [s.transpose(0, 2, 1, 3).reshape(a.tiles * LEAF, -1)[: len(zero_a), : len(zero_b)] for s in sums]
    times = empty.repeat(LEAF, 0).repeat(LEAF, 1)[: len(zero_a), : len(zero_b)]
    square = (zero_a[:, None] - zero_b[None, :]) ** 2
    ab = flat[0] + times * (square // zero_b[None, :])
    return ab, (flat[1] + times * (square // zero_a[:, None])).T if both else None


def _unit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """All ordered pairs of the sources of one unit: of its one block, or between its two blocks."""
    i, j = key[2].as_py(), key[3].as_py()
    block, gid, col, p, width = (table.column(c).to_numpy().astype(np.int64) for c in ("block", "gid", "col", "p", "width"))
    width = int(width.max())
    head = col < 0

    def side(number: int):
        own, zero_rows = (block == number) & ~head, np.flatnonzero((block == number) & head)
        zero_rows = zero_rows[np.argsort(gid[zero_rows])]
        ids, zero = gid[zero_rows], p[zero_rows]
        return np.searchsorted(ids, gid[own]), col[own], p[own], ids, zero

    sides = [side(n) for n in ((i,) if i == j else (i, j))]
    levels = (max(-(-width // LEAF), *(-(-len(s[3]) // LEAF) for s in sides), 1) - 1).bit_length()
    trees = [_Tree(row, c, q, zero, width, levels) for row, c, q, _, zero in sides]
    first, last = sides[0], sides[-1]
    ab, ba = joint_walk(trees[0], trees[-1], first[4], last[4], width, levels, i != j)
    found = []
    for left, right, value in ((first[3], last[3], ab), *(((last[3], first[3], ba),) if ba is not None else ())):
        g, h = np.repeat(left, len(right)), np.tile(right, len(left))
        found.append((g[g != h], h[g != h], value.ravel()[g != h]))
    g, h, value = (np.concatenate(v) for v in zip(*found))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(g), pa.string()), "g": g, "h": h, "value": value})


def matrix(docs: DataFrame, params: AuditParams = AuditParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, columns, cells): sources with their price of zero, kept terms with their place, nonzero counts with their price."""
    known = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    schema = "lang string, source string, term string, n long, documents long"
    tasks = known.select("lang", "source", "text").mapInArrow(_counted_terms(params.held_terms), schema)
    # A task has added up its own terms. Another sum before the shuffle would save a third of the rows (check_l) and cost more than it saves.
    dealt = tasks.repartition("lang", "source", "term")
    counts = materialise(dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents"))
    kept = materialise(in_lang.filter(F.col("documents") >= params.least_documents).drop("documents"))
    langs = counted(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")))
    stripes = F.ceil(F.col("terms") / params.stripe_terms)
    striped = kept.join(langs, "lang").withColumn("stripe", F.pmod(F.xxhash64("term"), stripes).cast("int"))
    place = Window.partitionBy("lang", "stripe").orderBy(F.col("lang_n").desc(), "term")
    lang_p = price(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("lang_p")
    columns = materialise(striped.select("lang", "term", "stripe", (F.row_number().over(place) - 1).alias("col"), lang_p))
    # Totals, pairs and excesses read the entries: they are joined once, and priced by whoever reads them.
    entries = materialise(counts.drop("documents").join(columns, ["lang", "term"]))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    gid = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = (
        known.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .na.fill(0, ["total", "terms"]).withColumn("gid", gid)
    )
    zero = price(F.lit(0), F.col("total"), F.col("terms"))
    groups = materialise(groups.select("lang", "source", "gid", "total", "terms", zero.alias("zero_p")))
    priced = entries.join(counted(groups.drop("zero_p")), ["lang", "source"])
    p = price(F.col("n"), F.col("total"), F.col("terms"))
    return groups, columns, priced.select("lang", "source", "gid", "term", "stripe", "col", p.alias("p"), "lang_p")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    own = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(own).alias("rank"))


def pairs(groups: DataFrame, columns: DataFrame, cells: DataFrame, params: AuditParams = AuditParams()) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    block = F.floor(F.col("gid") / params.block_rows).cast("int").alias("block")
    widths = columns.groupBy("lang", "stripe").agg((F.max("col") + 1).alias("width"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / params.block_rows).cast("int").alias("of"))
    heads = groups.join(widths, "lang").select("lang", "stripe", block, "gid", F.lit(-1).alias("col"), F.col("zero_p").alias("p"), "width")
    rows = heads.union(cells.select("lang", "stripe", block, "gid", "col", "p", F.lit(0).alias("width")))
    dealt = rows.join(counted(blocks), "lang").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    units = dealt.groupBy("lang", "stripe", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    parts = units.applyInArrow(_unit, "lang string, g long, h long, value long")
    summed = parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "gid", "source")
    left = names.select("lang", F.col("gid").alias("g"), "source")
    right = names.select("lang", F.col("gid").alias("h"), F.col("source").alias("item"))
    priced = summed.join(left, ["lang", "g"]).join(right, ["lang", "h"]).select("lang", "source", "item", "value")
    bare = groups.filter("terms = 0").select("lang", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    return priced.union(zeros.select("lang", "source", "item", F.lit(0).cast("long").alias("value")))


def excesses(cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has more of than its language."""
    off = F.col("p") - F.col("lang_p")
    value = F.call_function("div", off * off, F.col("lang_p"))
    return cells.filter("p > lang_p").select("lang", "source", F.col("term").alias("item"), value.alias("value"))


def audit(docs: DataFrame, params: AuditParams = AuditParams()) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs, and the ``top_terms`` terms of each source."""
    groups, columns, cells = matrix(docs, params)
    top = _ranked(excesses(cells), "term").filter(F.col("rank") <= params.top_terms)
    return _ranked(pairs(groups, columns, cells, params), "pair").union(top)
