"""Divergence audit, cross-tokenizer alignment and SimHash against plain versions, and their defined cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from brute import LOWER
from pyspark.sql import functions as F

from promiselens.llm import alignment, divergence, simhash
from promiselens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "fp part cell looks count block with unit low least term n p gid col width stripe a b times row best documents rank value".split()
RANDOM = random.Random(13)
WORDS = ["".join(RANDOM.choices("abcdefghij", k=RANDOM.randint(2, 8))) for _ in range(300)]
PLAIN = " ".join(RANDOM.choices(WORDS, k=80))
LONG = " ".join(RANDOM.choices(WORDS, k=40_000))
ROWS = [
    (1, PLAIN, "en", "a", 1),
    (2, PLAIN + " tail", "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "en", "only blanks", 4),
    (6, LONG, "de", "a", 1),
    (7, "Word word  WORD", "de", None, 4),
    (8, "12345 67", None, "a", 8),
    (9, PLAIN.upper(), "en", "c", 1),
    (9, PLAIN.upper(), "en", "c", 1),  # repeated row
    (None, PLAIN, "en", "a", 1),
    (None, None, "fr", None, None),
    (11, "ü€😀 " * 80, "fr", "b", 1),
    (12, "a\x00b <s> <0x0A> <|endoftext|>\r\n  x́ ¡\xa0 ", "fr", "c", 1),
    (13, "with ▁ its blank", "fr", "c", 1),
    (14, " lead  two   three\n\n\n    four ", "fr", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.withColumns({c: F.lit(-1) for c in CLASHING})


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def plain_fingerprint(text, n):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, bits):
    """(id, fingerprint) rows -> smallest id of each row's component, by comparing all fingerprints."""
    values = sorted({f for _, f in points})
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= bits:
            parent[root(a)] = root(b)
    least = {}
    for i, f in points:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f"{f:016x}", least.get(root(f))) for i, f in points]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def simhash_rows(df, params):
    found = simhash.near_duplicates(df, params).withColumn("fingerprint", simhash.hexadecimal(F.col("fingerprint")))
    return order(tuple(r) for r in found.select("doc_id", "fingerprint", "component_id").collect())


def test_simhash_query(spark, texts):
    rows = order(tuple(r) for r in QUERIES["op13_simhash"](spark, FOLDER).select("doc_id", "fingerprint", "component_id").collect())
    assert rows == order(plain_components([(i, plain_fingerprint(t, 3)) for i, t in texts], 3))


def test_simhash_hash_is_sparks(spark):
    text = "some words ü here"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), seed=42)


def test_simhash_cases(spark, docs):
    rows = simhash_rows(docs, simhash.SimParams(words=3))
    assert rows == order(plain_components([(r[0], plain_fingerprint(r[1], 3)) for r in ROWS], 3))
    assert sum(r[1] == "0" * 16 for r in rows) == 4
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    alone = simhash_rows(docs.filter("doc_id is null"), simhash.SimParams(words=3))
    assert len(alone) == 2 and all(r[2] is None for r in alone)


@pytest.mark.parametrize("bits", [1, 3, 6])
@pytest.mark.parametrize("hot_cell, block", [(512, 4096), (3, 8)])
def test_simhash_links_of_close_points(spark, bits, hot_cell, block):
    """Families of points a few bits apart, some of them chains, through the plain join and through dealt blocks."""
    rng = random.Random(bits)
    points = {0, 1, 2**64 - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(12):
            points.add(at)
            for _ in range(rng.randint(1, bits + 1)):
                at ^= 1 << rng.randrange(64)
    rows = list(enumerate(sorted(points)))
    signed = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    params = simhash.SimParams(bits=bits, hot_cell=hot_cell, block=block)
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(signed, params).collect()]
    assert all((a ^ b).bit_count() <= bits for a, b in edges)
    parent = {p: p for p in points}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(a)] = root(b)
    least = {}
    for i, p in rows:
        least.setdefault(root(p), i)
    assert [(i, f"{p:016x}", least[root(p)]) for i, p in rows] == plain_components(rows, bits)


def test_manhattan_is_a_lower_bound(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-(1 << 63), 1 << 63, 500)
    b = a ^ (rng.integers(-(1 << 63), 1 << 63, 500) & rng.integers(-(1 << 63), 1 << 63, 500))
    rows = spark.createDataFrame(zip(a.tolist(), b.tolist()), "a long, b long")
    bound = F.bit_count(simhash.unary(F.col("a")).bitwiseXOR(simhash.unary(F.col("b"))))
    for r in rows.select("a", "b", bound.alias("d")).collect():
        x, y = r["a"] % 2**64, r["b"] % 2**64
        steps = sum(abs((x >> s & 3).bit_count() - (y >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert r["d"] == steps <= (x ^ y).bit_count()


def plain_audit(rows, least=3, top=200):
    """rows of (text, lang, source)."""
    words = [((lang or ""), (source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        holders, groups = Counter(), defaultdict(Counter)
        for _, source, found in own:
            holders.update(set(found))
            groups[source].update(found)
        kept = sorted(t for t, n in holders.items() if n >= least)
        whole = sum(groups.values(), Counter())

        def prices(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: prices(c) for s, c in groups.items()}, prices(whole)
        for s in groups:
            pairs = [(h, sum((p[s][t] - p[h][t]) ** 2 // p[h][t] for t in kept)) for h in groups if h != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(items[:most])]
    return sorted(out)


def audit_rows(df, **params):
    return sorted(tuple(r) for r in divergence.audit(df, divergence.AuditParams(**params)).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("params", [{}, {"stripe_terms": 11, "block_rows": 3, "held_terms": 20}])
def test_audit_against_plain_version(spark, params):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "ß", "Y", "zz", "é")]
    rows = []
    for k in range(240):
        source = f"s{rng.randrange(9)}" if k % 3 else "s0"  # one source holds a third
        own = vocabulary[: 5 + rng.randrange(35)] if source != "s4" else vocabulary[-6:]
        rows.append((" ".join(rng.choices(own, k=rng.randrange(12))), rng.choice(["en", "de", None]), source))
    rows += [("1 2 3", "en", "no terms"), (None, "en", None), ("only here", "xx", "p"), ("", "xx", "q"), ("", "yy", "lone")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audit_rows(df, top_terms=5, **params) == plain_audit(rows, top=5)


def test_audit_cases(docs):
    assert audit_rows(docs, least_documents=2) == plain_audit([(r[1], r[2], r[3]) for r in ROWS], least=2)
    assert audit_rows(docs.limit(0)) == []


def test_audit_joins_counts_with_terms_once(spark, monkeypatch):
    """Totals and prices read the same stored entries; the join by term is in one stored plan only."""
    stored, write = [], divergence.materialise

    def spy(df):
        stored.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(divergence, "materialise", spy)
    rows = [(f"common w{k // 3}", "en", f"s{k % 5}") for k in range(30)]
    cells = divergence.matrix(spark.createDataFrame(rows, "text string, lang string, source string"))[2]
    plans = [*stored, cells._jdf.queryExecution().optimizedPlan().toString()]
    by_term = [re.search(r"Join Inner, .*term#\d+ = term#\d+", plan) is not None for plan in plans]
    assert sum(by_term) == 1


def test_audit_of_many_sources_walks_several_levels(spark):
    """More rows and columns than a leaf, most of the matrix empty."""
    rows = [(f"common w{k // 3} v{(k // 3) % 7}", "en", f"s{k % 45}") for k in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audit_rows(df, block_rows=20, stripe_terms=64) == plain_audit(rows)


def test_long_text_is_counted_in_pieces(monkeypatch):
    body = (LONG + " Ümlaut x1y").encode()
    whole = divergence.text_terms(body)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 1000)
    plain = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", body.decode().translate(LOWER))
    assert divergence.text_terms(body) == whole == Counter(t.encode() for t in plain)


class Encoders:
    """The two tokenizers as their own libraries run them, on whole texts."""

    def __init__(self):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in printable)}

    def sides(self, text):
        if not text:
            return [], []
        found = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in found.ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = b" " + text.encode()
        same = all(b"".join(x for _, x in side) == whole for side in (a, b))
        return (a, b) if same else ([], [])


def plain_alignment(rows):
    encoders, each, held = Encoders(), [], Counter()
    for doc, text in rows:
        spans = []
        for side in encoders.sides(text):
            at, own = 0, []
            for i, piece in side:
                own.append((i, at, at + len(piece)))
                at += len(piece)
            spans.append(own)
        a, b = spans
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, at = [], [0, 0]
        for cut in cuts:
            own = [[], []]
            for k in (0, 1):
                while at[k] < len(spans[k]) and spans[k][at[k]][2] <= cut:
                    own[k].append(str(spans[k][at[k]][0]))
                    at[k] += 1
            groups.append("|".join(map(",".join, own)))
        links, k = [], 0
        for i, s, e in a:
            while k and b[k - 1][2] > s:
                k -= 1
            while k < len(b) and b[k][1] < e:
                if b[k][2] > s:
                    links.append((i, b[k][0]))
                k += 1
        held.update(set(links))
        each.append((doc, a, b, groups, links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(n, best.get(i, 0))
    return order(
        (
            doc, len(a), len(b), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc, a, b, groups, links in each
    )


def alignment_rows(df, **params):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return order(tuple(r) for r in alignment.alignment(df, alignment.AlignParams(**params)).select(*columns).collect())


def test_alignment_query(spark, texts):
    frame = QUERIES["op12_alignment"](spark, FOLDER)
    rows = order(tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert rows == plain_alignment(texts)


def test_alignment_cases(docs):
    expected = plain_alignment([(r[0], r[1]) for r in ROWS])
    assert alignment_rows(docs, chunk_bytes=200) == expected == alignment_rows(docs, hot_pairs=7)
    found = {r[0]: r for r in expected}
    assert found[13][1:] == (0, 0, 0, 0, 0, 0, "") and found[12][1] > 0
    assert alignment_rows(docs.limit(0)) == []


def test_both_encoders_match_their_libraries():
    rng, encoders = random.Random(4), Encoders()
    own = alignment.ByteSide("byte_bpe_50k.json"), alignment.PieceSide("piece_bpe_32k.model")
    signs = [" ", "  ", "\n", "\t", "a", "B", "the", "'s", "1", "23", "é", "漢", "😀", "\x00", "​", "　", "<s>", "<0x0A>", "▁", "...", "\xad"]
    for _ in range(800):
        text = "".join(rng.choices(signs, k=rng.randint(1, 14)))
        assert own[0].ids(text) == encoders.a.encode(" " + text, add_special_tokens=False).ids
        assert own[1].ids(text) == encoders.b.encode(text)
