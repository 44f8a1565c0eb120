"""Operators and pipeline stages against plain versions at their own parameters."""

import random
import re

import numpy as np
import pytest
from brute import bench_words, components_of, hit_words, kept_lines, optimal_bins, packed_ids, shingles

from promiselens.llm import decontaminate, language, packing, quality_rules

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("room", [20, 21])
def test_lower_bound_of_bins(room):
    rng, met = random.Random(room), 0
    for _ in range(150):
        low = rng.choice([1, 5, 8])
        sizes = [rng.randint(low, room) for _ in range(rng.randint(1, 9))]
        bound, best = packing.least_bins(sizes, room), optimal_bins(sizes, room)
        assert -(-sum(sizes) // room) <= bound <= best
        assert best <= len(packing.pack(sizes, room, 2000))
        met += bound == best
    assert met > 130 and packing.least_bins([], room) == 0


def test_no_search_where_large_pieces_decide():
    sizes = [2100] * 3000  # no two fit together; the volume alone asks for half as many
    assert packing.least_bins(sizes, 4096) == 3000 == len(packing.pack(sizes, 4096, 10**9))


def test_packing_deals_equal_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "same words here")] * 300, "doc_id long, text string")
    rows = packing.best_fit_packing(docs, packing.PackParams(group_pieces=50)).collect()
    assert len(rows) == 300 and len({r["sequence_id"] >> 32 for r in rows}) > 3
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 300


def test_items_that_share_windows_and_short_items(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    license_line = " ".join(words[:20])
    items = [(i, f"{license_line} {' '.join(rng.sample(words, 8))}") for i in range(60)]
    items += [(100 + n, " ".join(words[300 : 300 + n])) for n in (1, 2, 5, 12)] + [(200, ""), (201, None), (202, "W300!")]
    texts = [" ".join(rng.sample(words[20:300], 40)) for _ in range(40)]
    texts += [f"{t} {license_line} tail" for t in texts[:20]] + [" ".join(words[298 : 298 + n]) for n in range(20)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        n_hit, held = hit_words(texts[r["doc_id"]], items)
        assert (r["n_hit"], r["item_ids"], r["n_items"]) == (n_hit, held, len(held)), r["doc_id"]
        assert r["contaminated"] == (n_hit > 0 and 20 * n_hit >= len(bench_words(texts[r["doc_id"]])))
    clean = {r["doc_id"] for r in decontaminate.clean(docs, spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert clean == {r["doc_id"] for r in found if not r["contaminated"]}


def _grams(text):
    """Plain n-grams of 1 to 4 bytes: no blank inside, and not blank on both sides."""
    body = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode())
    out = {}
    for n in range(1, 5):
        for i in range(len(body) - n + 1):
            gram = body[i : i + n]
            if gram != b" " and b" " not in gram[1:-1] and not (n > 1 and gram[0] == gram[-1] == 32):
                out[gram] = out.get(gram, 0) + 1
    return out


def test_language_by_plain_cosines(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    params = language.LanguageParams(max_rows=20, slices=3)
    model = language.train(docs, params)
    slots, slot_of = {}, {}
    rows = docs.collect()
    texts = {r["doc_id"]: r["text"] for r in rows}

    def slot(gram):
        if gram not in slot_of:
            data = np.frombuffer(gram, np.uint8)
            total = 0
            for n, c in enumerate(gram):
                total = (total * 0x100000001B3 + int(language._GRAM[n][language._LETTERS[c]])) % (1 << 64)
            mixed = language.bw.mix(np.array([(total + len(data) - 1) % (1 << 64)], dtype=np.uint64))[0]
            slot_of[gram] = int(mixed >> np.uint64(64 - params.bits))
        return slot_of[gram]

    holders = {}
    for r in rows:
        times = {}
        for gram, n in _grams(r["text"]).items():
            times[slot(gram)] = times.get(slot(gram), 0) + n
        slots[r["doc_id"]] = times
        if r["lang"] is not None:
            for s in times:
                holders[s] = holders.get(s, 0) + 1
    learned = sum(r["lang"] is not None for r in rows)
    for s, n in holders.items():
        assert model.idf[s] == pytest.approx(np.log((1 + learned) / (1 + n)) + 0.05, rel=1e-5)
    for r in language.predict(docs, model).collect():
        text, times = texts[r["doc_id"]], slots[r["doc_id"]]
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        weights = {s: np.log1p(n) * model.idf[s] for s, n in times.items()}
        norm = np.sqrt(sum(w * w for w in weights.values()))
        close = [sum(w * c[s] for s, w in weights.items()) / max(norm, 1e-9) for c in model.centroids]
        assert r["score"] == pytest.approx(max(close), abs=1e-4)
        of = [v for v, lang in zip(close, model.of) if model.languages[lang] == r["lang_pred"]]
        assert max(of) == pytest.approx(max(close), abs=1e-4)


def test_language_with_many_values_of_lang(spark):
    rows = [(i, f"text of kind {i % 300} alpha{i % 300} beta", f"x{i % 300}") for i in range(1200)] + [(5000, "lone", None)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language.LanguageParams(max_rows=2))
    assert len(model.languages) == 300 and len(model.of) <= 600


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    quality, near, benchmark, secrets, pack = [stage for _, stage in corpus_pipeline.STAGES]

    def after(stage, df):
        out = stage(spark, df, FOLDER).checkpoint()
        return out, {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}

    docs, texts = after(quality, docs)
    assert texts == kept_lines(rows, quality_rules.LineLimits()) and 0 < len(texts) < len(rows)
    docs, left = after(near, docs)
    groups = components_of({k: shingles(v, 5) for k, v in texts.items()}, 80)
    assert left == {k: v for k, v in texts.items() if groups[k] == k} and len(left) < len(texts)
    docs, clean = after(benchmark, docs)
    hits = {k: hit_words(v, items)[0] for k, v in left.items()}
    assert clean == {k: v for k, v in left.items() if not hits[k] or 20 * hits[k] < len(bench_words(v))} and len(clean) < len(left)
    docs, masked = after(secrets, docs)
    kinds = [
        (r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
        (r"AKIA[A-Z0-9]+", 0, 18),
        (r"[0-9a-f]+", 0, 16),
    ]
    changed = 0
    for k, text in clean.items():
        found = [m.group(g) for pattern, g, least in kinds for m in re.finditer(pattern, text or "") if len(m.group(g)) >= least]
        assert masked[k] != text if found else True
        assert not any(f in (masked[k] or "") for f in found)
        changed += bool(found)
    assert masked.keys() == clean.keys() and changed
    ids = packed_ids(masked)
    sums = {}
    for r in pack(spark, docs, FOLDER).collect():
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["length"]
    assert sums == {k: len(v) for k, v in ids.items()}
