"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
import random

import numpy as np
import pytest
from brute import components_of, packed_ids, removed_runs, shingles
from pyspark.sql import functions as F

from promiselens.llm import (
    chat,
    decontaminate,
    language,
    minhash,
    packing,
    quality_model,
    quality_rules,
    repeats,
    secrets,
    warc,
)

CLASHING = (
    "host content words lines hashes spans doc n key label score kept rep band sign text_ path blob drop print "
    "size of block unit places gram at low high group piece h lettered value page"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANDOM = random.Random(3)
WORDS = ["".join(RANDOM.choices("abcdefghijklmnop", k=RANDOM.randint(2, 9))) for _ in range(400)]
LONG = " ".join(RANDOM.choices(WORDS, k=30_000))
PLAIN = " ".join(RANDOM.choices(WORDS, k=60))
ROWS = [
    (1, PLAIN, "en", "a", 10),
    (2, PLAIN, "en", "b", 10),  # tie: the same text
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "en", "a", 4),
    (6, LONG, "de", "a", 1),
    (7, "word", "de", None, 4),
    (8, "12345 67", None, "a", 8),
    (9, PLAIN + " " + LONG[:500], "en", "a", 1),
    (9, PLAIN + " " + LONG[:500], "en", "a", 1),  # repeated row
    (None, PLAIN + " tail", "en", "a", 1),
    (None, None, None, None, None),
    (10, "aaaa" * 100, "en", "a", 1),
    (11, "ü€😀 " * 80, "fr", "b", 1),
]


def clashing(df):
    return df.withColumns({c: F.lit(-1) for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


def one_each(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def test_quality_rules(spark, docs, empty):
    verdict, _ = quality_rules.judge(docs)
    rows = verdict.collect()
    assert len(rows) == len(ROWS)
    found = one_each(rows)
    assert found[3]["n_words"] == found[4]["n_words"] == found[5]["n_words"] == 0 and found[3]["base_failed"]
    assert found[1]["kept"] and found[6]["n_words"] == 30_000 and found[11]["n_repeat_words"] == 80
    assert quality_rules.judge(empty)[0].collect() == [] and quality_rules.apply(empty).collect() == []
    kept = quality_rules.apply(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 2, 6, 9, 9]


def test_frequent_lines_go_and_depleted_documents_too(spark):
    line = "this line is on every page"
    rows = [(i, f"{' '.join(RANDOM.choices(WORDS, k=40))}\n  THIS line is  on every page", "en", "h", 1) for i in range(40)]
    rows += [(100 + i, f"{line}\n{line}\n{line}\n{line}\n" + " ".join(RANDOM.choices(WORDS, k=2)), "en", "h", 1) for i in range(3)]
    rows += [(200 + i, "a page of equal copies that many places hold\n" + PLAIN, "en", "h", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    limits = quality_rules.LineLimits(max_documents=30, max_share_percent=10)
    found = one_each(quality_rules.judge(docs, limits)[0].collect())
    assert all(found[i]["kept"] and found[i]["n_lines_removed"] == 1 for i in range(40))
    assert not any(found[100 + i]["kept"] for i in range(3)) and found[100]["n_words_removed"] == 24
    assert all(found[200 + i]["kept"] and found[200 + i]["n_lines_removed"] == 0 for i in range(60))  # copies are one text
    cleaned = one_each(quality_rules.apply(docs, limits).collect())
    assert "every page" not in cleaned[0]["text"] and cleaned[0]["n_chars"] == len(cleaned[0]["text"])


def test_repeats(spark, docs, empty):
    rows = repeats.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    found = one_each(rows)
    assert (found[3]["n_bytes"], found[3]["n_removed"], found[3]["kept_sha256"]) == (0, 0, hashlib.sha256(b"").hexdigest())
    texts = sorted({(r[0], r[1]) for r in ROWS if r[0]}, key=lambda r: r[0])
    for doc, runs in removed_runs(texts, 100).items():
        assert [tuple(x) for x in found[doc]["removed"]] == runs
    assert found[None]["n_removed"] == 0
    assert repeats.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("group_rows", [50_000, 1])
def test_repeats_in_families_of_copies(spark, group_rows):
    base = RANDOM.choices(WORDS, k=120)
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(RANDOM.randint(0, 6)):
            words[RANDOM.randrange(len(words))] = RANDOM.choice(WORDS)
        texts.append((i, " ".join(words[RANDOM.randint(0, 20) :])))
    texts.append((60, "ab" * 200))
    found = one_each(repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), repeats.RepeatParams(group_rows=group_rows)).collect())
    for doc, runs in removed_runs(texts, 100).items():
        assert [tuple(x) for x in found[doc]["removed"]] == runs


def test_decontamination(spark, docs, empty):
    words = PLAIN.split()
    items = spark.createDataFrame(
        [(1, " ".join(words[10:30]).upper()), (2, "ABCDEFGHIJKL, word!"), (3, None), (4, "..."), (5, "word"), (6, " ".join(words[12:25])), (None, "zzzz")],
        "item_id long, text string",
    ).withColumn("words", F.lit(1))
    found = one_each(decontaminate.contamination(docs, items).collect())
    assert found[1]["item_ids"] == ["1", "6"] and found[1]["n_hit"] == 20 and found[1]["contaminated"]
    assert found[7]["item_ids"] == ["5"] and found[7]["n_hit"] == 1 and found[7]["contaminated"]
    assert found[3]["n_words"] == 0 and not found[3]["contaminated"] and not found[6]["contaminated"]
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} >= {3, 4, 5, 6, 8, 10, 11}
    assert not {1, 2, 7, 9} & {r["doc_id"] for r in left.collect()}
    none = items.limit(0)
    assert decontaminate.clean(docs, none).count() == len(ROWS)
    assert decontaminate.contamination(empty, items).collect() == []


def test_winnowing_finds_every_shared_span(spark):
    long = RANDOM.choices(WORDS, k=300)
    texts = [(i, " ".join(RANDOM.choices(WORDS, k=30) + long[i : i + 13] + RANDOM.choices(WORDS, k=30))) for i in range(288)]
    texts += [(1000 + i, " ".join(["q"] + long[i : i + 12] + ["q"])) for i in range(50)]
    items = spark.createDataFrame([("x", " ".join(long))], "item_id string, text string")
    found = one_each(decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), items).collect())
    assert all(found[i]["n_hit"] >= 13 for i in range(288)) and all(found[1000 + i]["n_hit"] == 0 for i in range(50))


def test_secrets(spark, docs, empty, tmp_path):
    folder = str(tmp_path / "ledger")
    rows = secrets.digest(secrets.update_ledger(docs, folder)).collect()
    assert len(rows) == len(ROWS) and {r["doc_id"]: r["spans"] for r in rows if r["spans"]} == {10: "hex:0:400"}
    size = spark.read.parquet(folder).count()
    assert size == len({r[1] or "" for r in ROWS})
    extra = clashing(spark.createDataFrame([(20, "é Token: 'abcdefghijkl' AKIAABCDEFGHIJKLMN 0123456789abcdef", "", "", 1), (21, PLAIN, "", "", 1)], SCHEMA))
    found = one_each(secrets.digest(secrets.update_ledger(extra, folder)).collect())
    assert found[20]["spans"] == "assign:2:22,access:24:42,hex:43:59"
    assert spark.read.parquet(folder).count() == size + 1  # the known blob was not scanned again
    secrets.update_ledger(extra, folder, rule_version="2")
    assert spark.read.parquet(folder).filter("rule_version = '2'").count() == 2
    assert secrets.update_ledger(empty, folder).collect() == []
    clean = one_each(secrets.redact(extra, str(tmp_path / "other")).collect())
    assert clean[20]["text"] == "é [secret]' [secret] [secret]" and clean[21]["text"] == PLAIN
    assert secrets.redact(docs, str(tmp_path / "third")).count() == len(ROWS)


def test_warc(spark, tmp_path):
    tricky = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "u", "ü" * 10), (2, None, "ü" * 10), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", tricky), (5, "u", tricky), (6, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    folder = str(tmp_path / "warc")
    warc.write(pages.coalesce(1), folder)
    found = warc.read(spark, folder).collect()
    by_id = one_each(found, "page_id")
    assert len(found) == len(rows)
    assert (by_id[1]["record_type"], by_id[1]["refers_to"], by_id[1]["payload"]) == ("revisit", 2, None)
    assert bytes(by_id[2]["payload"]).decode() == "ü" * 10 and by_id[1]["payload_bytes"] == 20
    assert (by_id[3]["record_type"], by_id[3]["refers_to"], by_id[3]["target_uri"]) == ("revisit", 4, "uX: y")
    assert bytes(by_id[5]["payload"]).decode() == tricky and by_id[6]["payload_bytes"] == 3_000_000
    only = warc.read(spark, folder, "skip").filter("record_type = 'revisit'")
    assert {r["page_id"] for r in only.collect()} == {1, 3}
    assert "= revisit" not in only._jdf.queryExecution().optimizedPlan().toString()
    assert warc.round_trip(pages.limit(0)).collect() == []
    large = one_each(warc.round_trip(pages.filter("page_id < 3"), least_bytes=21).collect(), "page_id")
    assert {r["record_type"] for r in large.values()} == {"response"}


def test_near_duplicates(spark, docs, empty):
    params = minhash.NearParams(words=3, percent=85)
    rows = minhash.near_duplicates(docs, params).collect()
    assert len(rows) == len(ROWS)
    expected = components_of({r[0]: shingles(r[1], 3) for r in ROWS if r[0]}, 85)
    for r in rows:
        if r["doc_id"]:
            assert r["component_id"] == expected[r["doc_id"]]
    assert minhash.near_duplicates(empty, params).collect() == []
    left = minhash.deduplicate(docs)
    assert left.columns == docs.columns and minhash.deduplicate(empty).collect() == []
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]


@pytest.mark.parametrize("small_bucket", [64, 1])
def test_near_duplicates_in_families(spark, small_bucket):
    texts = {}
    for family in range(4):
        base = RANDOM.choices(WORDS, k=150)
        for i in range(40):
            words = list(base)
            for _ in range(RANDOM.choice([0, 1, 2, 4, 7])):
                words[RANDOM.randrange(len(words))] = RANDOM.choice(WORDS)
            texts[family * 100 + i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    params = minhash.NearParams(words=3, percent=85, small_bucket=small_bucket, block_rows=7)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, params).collect()}
    assert found == components_of({k: shingles(v, 3) for k, v in texts.items()}, 85)


@pytest.mark.parametrize("hot_class", [500, 2])
def test_near_duplicates_that_drift_and_meet_in_large_buckets(spark, hot_class):
    """Texts that link with their neighbours only, among them some without a neighbour, and copies of one text."""
    words = RANDOM.choices(WORDS, k=200)
    texts, at = {}, 0
    for i in range(90):
        for _ in range(RANDOM.choice([1, 3, 25])):
            words[at % len(words)] = RANDOM.choice(WORDS) + str(i)
            at += 1
        texts[1000 - i * 7 % 90] = " ".join(words)
    texts |= {2000 + i: texts[950] for i in range(20)}
    docs = spark.createDataFrame([*texts.items(), (None, texts[950])], "doc_id long, text string")
    params = minhash.NearParams(words=3, percent=85, small_bucket=2, block_rows=5, hot_class=hot_class)
    rows = minhash.near_duplicates(docs, params).collect()
    expected = components_of({k: shingles(v, 3) for k, v in texts.items()}, 85)
    assert 5 < len(set(expected.values())) < 60 and len(rows) == len(texts) + 1
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected | {None: expected[950]}


def test_copies_of_one_page_make_no_pairs_of_blocks(spark, monkeypatch):
    base = RANDOM.choices(WORDS, k=400)
    texts = {i: " ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(300)}
    seen, plain = [], minhash._left_over

    def counting(large, found, full, params):
        out = plain(large, found, full, params)
        seen.append((large.count(), found.select("component").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(minhash, "_left_over", counting)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = minhash.near_duplicates(docs, minhash.NearParams(block_rows=10)).collect()
    assert {r["component_id"] for r in found} == {0} and len(found) == 300
    assert seen[0][0] > 1000 and seen[0][1:] == (1, 0)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    RANDOM.shuffle(edges)
    found = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 201)) and all(found[1000 + i] == 1000 for i in range(1, 300))


def test_quality_model(spark, docs, empty):
    junk = [(i, "### $$$ " * 30 if i % 2 else " ".join(RANDOM.choices(WORDS, k=50)), 1 - i % 2) for i in range(60)]
    learn = spark.createDataFrame([*junk, (None, "x", 1), (61, "x", None)], "doc_id long, text string, label int")
    model = quality_model.train(learn, learn)
    rows = quality_model.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    found = {r["doc_id"]: r["score"] for r in quality_model.score(learn, model).collect()}
    assert min(found[i] for i in range(0, 60, 2)) > 0.5 > max(found[i] for i in range(1, 60, 2))
    assert quality_model.score(empty, model).collect() == []
    blank = quality_model.train(learn, learn.limit(0))
    assert {round(r["score"], 6) for r in quality_model.score(docs, blank).collect()} == {0.5}


def test_factorisation_identity():
    random = np.random.default_rng(1)
    model = quality_model.Model(0.3, random.normal(size=16 + 13).astype("f4"), random.normal(size=(29, 4)).astype("f4"), 4)
    feature, value = np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0], "f4")
    stats = random.normal(size=(1, 13)).astype("f4")
    x = np.zeros(29)
    x[feature] = value
    x[16:] += stats[0]
    pairs = sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i in range(29) for j in range(i + 1, 29))
    assert np.allclose(model.margins(np.array([0, 3]), feature, value, stats), 0.3 + model.linear @ x + pairs, atol=1e-3)


def test_language(spark, docs, empty):
    model = language.train(docs.filter("lang is not null"))
    rows = language.predict(docs, model).collect()
    found = one_each(rows)
    assert len(rows) == len(ROWS)
    assert found[3]["lang_pred"] == found[4]["lang_pred"] == found[8]["lang_pred"] == "und" and found[8]["score"] == 0
    assert found[11]["lang_pred"] == "fr" and found[6]["lang_pred"] == "de"
    assert language.predict(empty, model).collect() == []
    none = language.train(empty)
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}


def test_chat(spark):
    said = "\\### a: </turn> \\t ### b"
    records = [
        '{"conv_id": 1, "turn": 1, "role": "assistant", "text": "b"}',
        '{"conv_id": 1, "turn": 0, "role": "user", "text": null}',
        '{"conv_id": 1, "turn": 1, "role": "assistant", "text": "b"}',
        '{"id": 2, "messages": [{"role": "user", "content": "%s"}, {"role": "a:\\n", "content": "x"}]}' % said.replace("\\", "\\\\"),
        '{"id": 3, "prompt": "p", "response": "r"}',
        '{"id": 4, "instruction": "i", "input": "", "output": "o"}',
        '{"id": 5, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}',
        '{"id": 6, "system": "s", "data": {"question": "q", "answer": "w"}}',
        '{"odd": 1}', "[1]", "no json", None,
    ]
    source = spark.createDataFrame([(r, 0) for r in records], "record string, piece int")
    pieces = chat.format_records(source)
    found = one_each(chat.digest(pieces).collect(), "conv_id")

    def sha(*turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    assert found[1]["turns_sha256"] == sha(("user", ""), ("assistant", "b"), ("assistant", "b")) and found[1]["loss_chars"] == 2
    assert found[2]["turns_sha256"] == sha(("user", said), ("a:\n", "x")) and found[2]["loss_chars"] == 0
    assert found[3]["turns_sha256"] == sha(("user", "p"), ("assistant", "r"))
    assert found[4]["turns_sha256"] == sha(("user", "i"), ("assistant", "o"))
    assert found[5]["turns_sha256"] == sha(("user", "h"), ("assistant", "g"))
    assert found[6]["turns_sha256"] == sha(("system", "s"), ("user", "q"), ("assistant", "w"))
    assert len(found) == 6
    odd = chat.unmatched(source).collect()
    assert len(odd) == 4 and sum(r["fingerprint"] is None for r in odd) == 3
    assert chat.digest(chat.format_records(source.limit(0))).collect() == []


def test_packing(spark, docs, empty):
    rows = packing.best_fit_packing(docs).collect()
    texts = [r[1] or "" for r in ROWS]
    assert sum(r["length"] for r in rows) == sum(map(len, packed_ids(dict(enumerate(texts))).values()))
    assert max(r["piece"] for r in rows if r["doc_id"] == 6) > 5
    assert packing.best_fit_packing(empty).collect() == []


def test_word_encoder_equals_whole_texts():
    encode = packing.WordEncoder(packing.tokenizer_file("word_bpe_49k.json"))
    texts = ["It's  a\ttest\x1c of\u00a0DON'T\n\n<|endoftext|>x e\u0301 \u0301e ' s ÀÉ 中文!?", "", " ", "a\r\nb", LONG[:5000], "\x01 a\x01b \x01\x01 \x02"]
    whole = packed_ids(dict(enumerate(texts)))
    assert [list(np.frombuffer(b, "<u4")) for b in encode(texts)] == [whole[i][:-1] for i in range(len(texts))]


def test_word_encoder_takes_over_what_the_older_generation_holds(monkeypatch):
    """A word is taken apart once, also after its generation became the older one."""
    apart = []

    class Spy:
        def fullmatch(self, word, found=packing.PLAIN_WORD.fullmatch):
            apart.append(word)
            return found(word)

    monkeypatch.setattr(packing, "PLAIN_WORD", Spy())
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    encode = packing.WordEncoder(packing.tokenizer_file("word_bpe_49k.json"))
    first = encode(["Some, words. here Some, words."])
    assert encode(["Some, words. here Some, words."]) == first
    assert sorted(apart) == ["Some,", "here", "words."]


def test_bin_completion_beats_best_fit():
    random = np.random.default_rng(0)
    better = 0
    for _ in range(200):
        sizes = random.integers(15, 60, 14).tolist()
        bins = packing.pack(sizes, 100, 20_000)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        simple = len(packing.best_fit(sorted(sizes, reverse=True), 100))
        assert -(-sum(sizes) // 100) <= len(bins) <= simple
        better += len(bins) < simple
    assert better > 0


@pytest.mark.parametrize("full", [0, 3100])
def test_search_of_a_group_with_production_parameters(full):
    params = packing.PackParams()
    sizes = np.clip(np.random.default_rng(2).lognormal(6.2, 1.1, 4000), 1, params.sequence).astype(int).tolist() + [params.sequence] * full
    bins = packing.pack(sizes, params.sequence, params.max_nodes, params.max_fillings)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= params.sequence for b in bins)
    bound = -(-sum(sizes) // params.sequence)
    assert len(packing.best_fit(sorted(sizes, reverse=True), params.sequence)) > bound == len(bins)


def null_ids(spark, texts):
    return clashing(spark.createDataFrame([(None, t, "en", "a", 1) for t in texts], SCHEMA))


def some_words(n):
    return " ".join(RANDOM.choices(WORDS, k=n))


def test_quality_rules_judge_rows_without_an_id_by_their_texts(spark):
    good, other = some_words(60), some_words(60)
    left = quality_rules.apply(null_ids(spark, [good, other, other, "too short", "aa bb " * 60, None]))
    assert sorted(r["text"] for r in left.collect()) == sorted([good, other, other])


def test_deduplication_judges_rows_without_an_id_by_their_texts(spark):
    a, b, c, d = (some_words(60) for _ in range(4))
    with_id = clashing(spark.createDataFrame([(1, a, "en", "a", 1), (2, d, "en", "a", 1), (2, d, "en", "b", 1)], SCHEMA))
    rows = null_ids(spark, [a, b, c, c, f" {c}", None, "", ""])
    left = [(r["doc_id"], r["text"]) for r in minhash.deduplicate(with_id.unionByName(rows)).collect()]
    found = sorted((i or 0, (t or "").strip()) for i, t in left)
    assert found == sorted([(1, a), (2, d), (0, b), (0, c), (0, ""), (0, ""), (0, "")])
    # All rows without an id are kept ones here; unlike texts stay.
    assert sorted(r["text"] for r in minhash.deduplicate(null_ids(spark, [a, b, b])).collect()) == sorted([a, b])


def test_decontamination_judges_rows_without_an_id_by_their_texts(spark):
    passage, other, clean = some_words(20), some_words(20), [some_words(60), some_words(60)]
    items = spark.createDataFrame([("i", passage), ("j", other)], "item_id string, text string")
    docs = null_ids(spark, [*clean, f"{passage} {clean[0]}", f"{other} {clean[1]}", None])
    judged = {r["n_words"]: 0 for r in decontaminate.contamination(docs, items).collect()}
    for r in decontaminate.contamination(docs, items).collect():
        judged[r["n_words"]] += r["contaminated"]
        assert r["n_hit"] in (0, 20) and (r["n_hit"] == 20) == r["contaminated"] and r["n_items"] == r["contaminated"]
    assert judged == {60: 0, 80: 2, 0: 0}
    assert {r["text"] for r in decontaminate.clean(docs, items).collect()} == {*clean, None}
