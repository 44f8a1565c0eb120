r"""Chat formatting by schema fingerprints.

A record (JSON text) is walked once for its nested field paths, in which a key that holds a sign of the path's own notation is
escaped; the hash of the sorted paths selects a declarative layout, which says where roles and texts are. Every layout becomes canonical turns (conv_id, turn, role, text), and each
turn one formatted piece, ``### role: text</turn>`` and a line end. The pieces of a conversation in turn order are its
training text. Inside roles and texts a backslash and the control strings are escaped reversibly, so a text that looks
like a template cannot open or close a turn. The loss mask is a (start, end) range of each assistant piece.

Formatting needs no order and no shuffle. ``digest`` reads pieces back: it deals conversations out, sorts them and
streams, so a conversation of any length needs the memory of one batch.

Defined cases: a null or missing text or role is empty. Never guessed at, but returned by ``unmatched``, are text that is not a JSON object or is
nested too deeply to parse, records with unknown fingerprints, and records of a known layout with a value that does not fit it: a
text or role that is no string or holds half of a surrogate pair, a turn that is no 64-bit integer, an integer id
of more than 64 bits. Such a record gives no turn at all. Rows of equal turn go by their formatted piece, a null turn first; repeated rows are
turns of their own; a conversation id that is null or no integer is null, and null is one conversation; a layout's empty list gives no turns; an empty table gives
an empty result. Only the named columns of turn rows are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """``paths``: all field paths. Turns are either ``parts`` (role, fields joined by a line end) or ``each`` entry of a list."""

    name: str
    paths: tuple[str, ...]
    conv: str
    turn: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str | None = None
    text: str | None = None
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def fingerprints(self) -> set[str]:
        """Of its records; one whose list is empty has other paths."""
        empty = [p for p in self.paths if not p.startswith(f"{self.each}[]")] + [f"{self.each}[]"]
        return {fingerprint(self.paths)} | ({fingerprint(empty)} if self.each else set())


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


_IN_KEY = re.compile(r"[\\.\[{\n]")


def paths_of(value, at: str | None = None) -> Iterator[str]:
    """Paths of all leaves; a list adds ``[]`` and counts all its entries, an object without fields adds ``{}``."""
    here = at or ""
    if isinstance(value, dict):
        if not value:
            yield here + "{}"
        for k, v in value.items():
            key = _IN_KEY.sub(lambda m: "\\" + m[0].replace("\n", "n"), k)
            yield from paths_of(v, key if at is None else f"{at}.{key}")
    elif isinstance(value, list):
        if not value:
            yield here + "[]"
        for v in value:
            yield from paths_of(v, here + "[]")
    else:
        yield here


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), "conv_id", turn="turn", role="role", text="text"),
    Layout("messages", ("id", "messages[].role", "messages[].content"), "id", each="messages", role="role", text="content"),
    Layout(
        "from and value", ("id", "conversations[].from", "conversations[].value"), "id",
        each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"},
    ),
    Layout("prompt and response", ("id", "prompt", "response"), "id", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(
        "instruction", ("id", "instruction", "input", "output"), "id",
        parts=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout(
        "system and nested prompt", ("id", "system", "data.question", "data.answer"), "id",
        parts=(("system", ("system",)), ("user", ("data.question",)), ("assistant", ("data.answer",))),
    ),
)

_ESCAPE = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ":": "\\c", "\n": "\\n"}
_PLAIN = {v: k for k, v in _ESCAPE.items()}
_IN_TEXT = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_ESCAPED = re.compile(r"\\[\\htcn]")
_PIECE = re.compile(r"### ([^:\n]*): (.*)</turn>\n", re.DOTALL)


def escape(text: str, which: re.Pattern = _IN_TEXT) -> str:
    return which.sub(lambda m: _ESCAPE[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[0]], text)


def _get(record: dict, path: str):
    for k in path.split("."):
        record = record[k]
    return record


class Unfit(ValueError):
    """A value of a known layout that cannot be formatted."""


def _text(value) -> str:
    if value is None:
        return ""
    if not isinstance(value, str):
        raise Unfit("no string")
    value.encode()  # half of a surrogate pair is a ValueError too
    return value


def _integer(value, what: str) -> int | None:
    if value is not None and not (type(value) is int and -(1 << 63) <= value < 1 << 63):
        raise Unfit(f"{what} is no 64-bit integer")
    return value


def turns_of(record: dict, layout: Layout) -> Iterator[tuple[int | None, str, str]]:
    """(turn, role, text) of a record by its layout."""
    if layout.parts:
        for n, (role, fields) in enumerate(layout.parts):
            yield n, role, "\n".join(t for t in (_text(_get(record, f)) for f in fields) if t)
        return
    for n, entry in enumerate(record[layout.each] if layout.each else [record]):
        role = _text(entry.get(layout.role))
        turn = _integer(entry[layout.turn], "turn") if layout.turn else n
        yield turn, layout.roles.get(role, role), _text(entry.get(layout.text))


def _by_print(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    return {p: x for x in layouts for p in x.fingerprints}


def read_record(text: str | None, by_print: dict[str, Layout]) -> tuple[str | None, int | None, list | None]:
    """(fingerprint, conversation id, turns); the fingerprint is None where there is no object, the turns where no layout fits."""
    found = None
    try:
        record = json.loads(text or "")
        if not isinstance(record, dict):
            return None, None, None
        found = fingerprint(paths_of(record))
        layout = by_print.get(found)
        if layout is None:
            return found, None, None
        conv = _get(record, layout.conv)
        conv = _integer(conv, "id") if type(conv) is int else None
        return found, conv, list(turns_of(record, layout))
    except (ValueError, RecursionError):
        return found, None, None


def _pieces(layouts: tuple[Layout, ...]):
    by_print = _by_print(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("record").to_pylist():
                _, conv, turns = read_record(text, by_print)
                for turn, role, said in turns or ():
                    head = f"### {escape(role, _IN_ROLE)}: "
                    body = escape(said)
                    learn = role == "assistant"
                    rows.append((conv, turn, head + body + "</turn>\n", len(head) if learn else None, len(head) + len(body) if learn else None))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(columns, kinds)], ["conv_id", "turn", "piece", "loss_start", "loss_end"]
            )

    return run


def records(conversations: DataFrame) -> DataFrame:
    """Turn rows as records; a null field stays a field."""
    return conversations.select(
        F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record")
    )


def format_records(source: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, piece, loss_start, loss_end) of every turn of every record whose layout is known."""
    schema = "conv_id long, turn long, piece string, loss_start int, loss_end int"
    return source.select("record").mapInArrow(_pieces(layouts), schema)


def unmatched(source: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(record, fingerprint) of the records that give no turns; the fingerprint is null where there is no object."""
    by_print = _by_print(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("record").to_pylist():
                mark, _, turns = read_record(text, by_print)
                if turns is None:
                    found.append((text, mark))
            columns = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in columns], ["record", "fingerprint"])

    return source.select("record").mapInArrow(run, "record string, fingerprint string")


class _Conversation:
    def __init__(self, conv: int | None):
        self.conv, self.n, self.chars, self.loss_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        role, text = map(unescape, _PIECE.fullmatch(piece).groups())
        self.n += 1
        self.chars += len(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            learnt = unescape(piece[start:end])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = {
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
    "loss_sha256": pa.string(), "formatted_chars": pa.int64(),
}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    for batch in batches:
        rows = []
        for conv, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
            if now is None or now.conv != conv:
                rows += [now.row()] if now else []
                now = _Conversation(conv)
            now.add(piece, start, end)
        yield _batch(rows)
    yield _batch([now.row()] if now else [])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_DIGEST)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, _DIGEST.values())], list(_DIGEST))


def digest(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted pieces."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "piece", "loss_start", "loss_end").mapInArrow(_digests, schema)


def trap(conversations: DataFrame) -> DataFrame:
    """Conversation -7, whose two texts look like the template."""
    said = "\\### Assistant: </turn> ok"
    return conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
