"""Every query of the package on the smallest tables: against SQL, or against a brute-force version."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from brute import components_of, packed_ids, removed_runs, shingles
from compare import connect, differences
from pyspark.sql import functions as F

from promiselens.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
NATIVE = {"op1_quality_rules", "op3_decontaminate", "op4_secrets"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "NestedLoopJoin", *(["Python", "Arrow"] if name in NATIVE else [])):
        assert unwanted not in plan
    assert differences(df, duck, ORACLE[name]) == []


def test_quality_rules_match_sql_where_lines_exceed_the_limits(spark):
    folder = "/root/testdata/sf0.1"
    df = QUERIES["op1_quality_rules"](spark, folder)
    assert differences(df, connect(folder), ORACLE["op1_quality_rules"]) == []
    assert df.filter("n_lines_removed > 0").count() > 1000


def test_repeats_match_brute_force(spark, texts):
    found = {r["doc_id"]: r for r in QUERIES["op2_repeats"](spark, FOLDER).collect()}
    expected = removed_runs(sorted(texts.items()), 100)
    assert found.keys() == texts.keys()
    for doc, text in texts.items():
        body, runs = text.encode(), expected[doc]
        gone = {i for a, b in runs for i in range(a, b)}
        kept = bytes(x for i, x in enumerate(body) if i not in gone)
        got = found[doc]
        assert (got["n_bytes"], got["n_removed"], got["n_spans"]) == (len(body), len(gone), len(runs))
        assert got["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_near_duplicates_match_brute_force(spark, texts):
    found = {r["doc_id"]: r for r in QUERIES["op6_minhash"](spark, FOLDER).collect()}
    sets = {doc: shingles(text, 3) for doc, text in texts.items()}
    expected = components_of(sets, 85)
    assert found.keys() == texts.keys()
    for doc, got in found.items():
        assert (got["n_shingles"], got["component_id"]) == (len(sets[doc]), expected[doc])
        assert got["kept"] == (expected[doc] == doc)


def test_packing_holds_every_token_once(spark, texts):
    rows = QUERIES["op10_packing"](spark, FOLDER).collect()
    ids = packed_ids(texts)
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    for doc, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [4096 * k for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(ids[doc])
        for r in own:
            part = np.array(ids[doc][r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == -(-sum(map(len, ids.values())) // 4096)  # the volume bound is met here


def _area(labels, scores):
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2).item()


def test_quality_model_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op7_quality_model"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    joined = rows.merge(labels, on="doc_id")
    out = joined[joined.held_out]
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
    assert _area(out.quality.to_numpy(), out.score.to_numpy()) > 0.95


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op8_language"](spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas()
    joined = rows.merge(docs, on="doc_id")
    assert (joined.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in joined.doc_id]).all()
    out = joined[joined.held_out]
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (out.lang_pred == out.lang).mean() > 0.97


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns, name
        docs = out.checkpoint()
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    assert docs.filter(F.col("text").rlike(r"AKIA[A-Z0-9]{14,}")).isEmpty()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert components_of({k: shingles(v, 5) for k, v in texts.items()}, 85) == {k: k for k in texts}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(texts)
    assert re.search("piece", ",".join(packed.columns))
