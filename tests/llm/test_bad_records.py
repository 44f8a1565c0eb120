"""Chat records that fit no layout, and archives without records."""

import base64
import hashlib
import json

import pytest

from promiselens.llm import chat, warc

TURNS = [{"role": "user", "content": "q"}]
BAD = {
    "dotted key": '{"id": 1, "system": "s", "data.question": "q", "data.answer": "a"}',
    "bracketed key": '{"id": 1, "messages[].role": "user", "messages[].content": "q"}',
    "line end in a key": '{"id\\nprompt": 1, "response": "r"}',
    "half a surrogate pair": '{"id": 1, "prompt": "\\ud800", "response": "r"}',
    "half a surrogate pair in a key": '{"id": 1, "\\ud800": "x"}',
    "id beyond 64 bits": json.dumps({"id": 1 << 64, "messages": TURNS}),
    "turn of text": json.dumps({"conv_id": 1, "turn": "first", "role": "user", "text": "q"}),
    "turn of a fraction": json.dumps({"conv_id": 1, "turn": 1.5, "role": "user", "text": "q"}),
    "turn of a truth value": json.dumps({"conv_id": 1, "turn": True, "role": "user", "text": "q"}),
    "turn beyond 64 bits": json.dumps({"conv_id": 1, "turn": 1 << 70, "role": "user", "text": "q"}),
    "content of zero": json.dumps({"id": 1, "messages": [*TURNS, {"role": "user", "content": 0}]}),
    "content of false": json.dumps({"id": 1, "messages": [{"role": "user", "content": False}]}),
    "object for a text": json.dumps({"id": 1, "prompt": {}, "response": "r"}),
    "empty entry": json.dumps({"id": 1, "messages": [{}]}),
    "deep nesting": '{"id": ' + "[" * 100_000 + "]" * 100_000 + "}",
    "deep but parsed": '{"id": ' + '{"a":' * 900 + "1" + "}" * 900 + "}",
    "no object": "[1]",
    "no JSON": "{",
}
GOOD = {
    "no entries": json.dumps({"id": 5, "messages": []}),
    "text id": json.dumps({"id": "x", "messages": TURNS}),
    "null text": json.dumps({"id": 6, "messages": [{"role": "user", "content": None}]}),
    "nested": json.dumps({"id": 7, "system": "s", "data": {"question": "q", "answer": "a"}}),
}


def test_bad_records_are_returned_and_end_no_job(spark):
    source = spark.createDataFrame([(r,) for r in [*BAD.values(), *GOOD.values()]] + [(None,)], "record string")
    odd = [r["record"] for r in chat.unmatched(source).collect()]
    assert sorted(odd, key=str) == sorted([*BAD.values(), None], key=str)
    pieces = [tuple(r)[:3] for r in chat.format_records(source).collect()]
    assert sorted(pieces, key=str) == sorted(
        [
            (None, 0, "### user: q</turn>\n"),
            (6, 0, "### user: </turn>\n"),
            (7, 0, "### system: s</turn>\n"),
            (7, 1, "### user: q</turn>\n"),
            (7, 2, "### assistant: a</turn>\n"),
        ],
        key=str,
    )


def test_paths_are_unambiguous():
    records = [{"a.b": 1}, {"a": {"b": 1}}, {"a[]": 1}, {"a": [1]}, {"a": []}, {"a": {}}, {"a{}": 1}, {"": {"a": 1}}, {"a": 1}, {"a\\": 1}, {"a\nb": 1}, {"a": 1, "b": 1}]
    prints = [chat.fingerprint(chat.paths_of(r)) for r in records]
    # An empty list and a list of values differ only in having entries.
    assert prints[3] == prints[4] and len(set(prints)) == len(records) - 1


def test_archives_without_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    assert warc.round_trip(pages.limit(0)).collect() == []
    empty = tmp_path / "empty"
    empty.mkdir()
    assert warc.read(spark, str(empty)).collect() == []
    (empty / "part-0.warc").touch()
    (empty / "_SUCCESS").write_text("not an archive")
    assert warc.read(spark, str(empty)).collect() == []
    assert warc.read(spark, str(empty)).filter("record_type = 'revisit'").collect() == []


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("warc") / "a"
    rows = [(1, " u v ", "same"), (2, "w", "same"), (3, None, "other"), (4, "u: v", "x" * 100_000)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(folder))
    return folder


def test_urls_and_digests_are_pushed_down(spark, archive):
    digest = base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    for condition, expected in (
        (f"payload_digest = '{digest}'", {1, 2}),
        ("target_uri in ('w', 'u: v')", {2, 4}),
        ("target_uri = ' u v '", {1}),
        (f"payload_digest = '{digest}' and record_type = 'response'", {2}),
    ):
        found = warc.read(spark, str(archive)).filter(condition)
        assert {r["page_id"] for r in found.collect()} == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert " = " not in plan and " IN " not in plan  # only null checks are left to Spark


def test_cut_file_gives_its_whole_records(spark, archive, tmp_path):
    cut = tmp_path / "cut"
    cut.mkdir()
    for part in archive.glob("*"):
        if not part.name.startswith(("_", ".")):
            (cut / part.name).write_bytes(part.read_bytes()[:-50])
    whole = {r["page_id"]: r["payload"] for r in warc.read(spark, str(archive)).collect()}
    left = {r["page_id"]: r["payload"] for r in warc.read(spark, str(cut)).collect()}
    assert len(left) == len(whole) - 1 and left.items() <= whole.items()
