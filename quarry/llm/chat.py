"""Chat formatting: schema fingerprints choose mappings to canonical turns, a template renders them.

A record's nested field paths, sorted and hashed, are its schema fingerprint. Each known fingerprint stands
for one declarative mapping; records of an unknown one are returned with it, not dropped. The template
marks turns by control strings, and such strings inside texts are escaped so that parsing gives every text
back exactly.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import map_text

# --- schema fingerprints ------------------------------------------------------------------------


def paths_of(value: object, at: str = "") -> set[str]:
    """Nested field paths of a decoded record; ``[]`` stands for the elements of a list."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(paths_of(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The same of a Spark type."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return {at}


def fingerprint(paths: set[str]) -> str:
    """Hash of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Turns:
    """Mapping of a record with a list of turns: where the list, and in its elements role and text, stand."""

    turns: str
    role: str
    text: str
    before: tuple[tuple[str, str], ...] = ()  # (role, path) of single fields before the list


@dataclass(frozen=True)
class Fields:
    """Mapping of a record with one field for each turn: (role, paths joined by an empty line), in order."""

    turns: tuple[tuple[str, tuple[str, ...]], ...]


@dataclass(frozen=True)
class Rows:
    """Mapping of a table with a row for each turn."""

    conversation: str
    order: str
    role: str
    text: str


#: Layouts: required paths, optional paths, mapping. Optional paths beside the mapped ones carry no turn.
#: Every set of required paths with some of the optional ones has a fingerprint of its own in MAPPINGS.
LAYOUTS: tuple[tuple[frozenset[str], tuple[str, ...], Turns | Fields | Rows], ...] = (
    (frozenset({"conv_id", "turn", "role", "text"}), (), Rows("conv_id", "turn", "role", "text")),
    (frozenset({"messages[].role", "messages[].content"}), ("id", "system", "source"), Turns("messages", "role", "content", (("system", "system"),))),
    (frozenset({"conversations[].from", "conversations[].value"}), ("id", "system", "source"), Turns("conversations", "from", "value", (("system", "system"),))),
    (frozenset({"dialog.turns[].speaker", "dialog.turns[].text"}), ("id",), Turns("dialog.turns", "speaker", "text")),
    (frozenset({"instruction", "output"}), ("id", "input", "system"), Fields((("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))))),
    (frozenset({"instruction", "response"}), ("id", "context", "category"), Fields((("user", ("instruction", "context")), ("assistant", ("response",))))),
    (frozenset({"prompt", "completion"}), ("id",), Fields((("user", ("prompt",)), ("assistant", ("completion",))))),
    (frozenset({"prompt", "response"}), ("id", "system"), Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))))),
    (frozenset({"question", "answer"}), ("id",), Fields((("user", ("question",)), ("assistant", ("answer",))))),
)

#: Names of roles in known layouts and the canonical ones. Others stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _registry() -> dict[str, Turns | Fields | Rows]:
    out: dict[str, Turns | Fields | Rows] = {}
    for needed, optional, mapping in LAYOUTS:
        for n in range(len(optional) + 1):
            for extra in itertools.combinations(optional, n):
                out.setdefault(fingerprint({*needed, *extra}), mapping)
    return out


MAPPINGS = _registry()


def _get(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns_of(record: object) -> tuple[str, list[tuple[str, str]] | None]:
    """Schema fingerprint of a decoded record and its canonical (role, text) turns; None if it is unknown."""
    print_ = fingerprint(paths_of(record))
    mapping = MAPPINGS.get(print_)
    if mapping is None or isinstance(mapping, Rows):
        return print_, None
    if isinstance(mapping, Fields):
        out = []
        for role, paths in mapping.turns:
            parts = [x for p in paths if (x := _text(_get(record, p)))]
            if parts or role != "system" and _get(record, paths[0]) is not None:
                out.append((role, "\n\n".join(parts)))
        return print_, out
    out = [(role, _text(x)) for role, path in mapping.before if (x := _get(record, path))]
    for turn in _get(record, mapping.turns) or []:
        role = _text(_get(turn, mapping.role))
        out.append((ROLES.get(role, role), _text(_get(turn, mapping.text))))
    return print_, out


_TURN_SCHEMA = "conv_id long, turn long, role string, text string"


def records_to_turns(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical turns of JSON records, and the records whose layout is unknown.

    ``records`` has conv_id and record (JSON text). The first result is a row for each turn (conv_id, turn,
    role, text); the second has conv_id, record and schema_fingerprint, also for null and broken JSON
    (fingerprint null).
    """
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, turns = [], []
            for r in b.column(1).to_pylist():
                try:
                    p, t = turns_of(json.loads(r)) if r is not None else (None, None)
                except ValueError:
                    p, t = None, None
                prints.append(p)
                turns.append(None if t is None else [{"turn": i, "role": x, "text": y} for i, (x, y) in enumerate(t)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.string()), pa.array(turns, kind)], names=["conv_id", "record", "schema_fingerprint", "turns"])

    mapped = map_text(records.select(F.col("conv_id").cast("long"), F.col("record").cast("string")), run, "conv_id long, record string, schema_fingerprint string, turns array<struct<turn:long,role:string,text:string>>")
    return mapped.where("turns is not null").select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn", "t.role", "t.text"), mapped.where("turns is null").drop("turns")


def mapping_of(paths: set[str]) -> tuple[str, Turns | Fields | Rows | None]:
    """Schema fingerprint and mapping of a table's field paths.

    The fingerprint of all paths decides. If it stands for no mapping, the table has further columns: then
    that of the paths of one layout does, the first whose fingerprint stands for a mapping.
    """
    whole = fingerprint(paths)
    if whole in MAPPINGS:
        return whole, MAPPINGS[whole]
    for needed, optional, _ in LAYOUTS:
        if (part := fingerprint(paths & {*needed, *optional})) in MAPPINGS:
            return part, MAPPINGS[part]
    return whole, None


def rows_to_turns(rows: DataFrame) -> DataFrame:
    """Canonical turns of a table whose schema fingerprint stands for a mapping of rows.

    Further columns do no harm and are not read; a table whose fingerprint stands for no such mapping is an error.
    """
    print_, m = mapping_of(schema_paths(rows.schema))
    if not isinstance(m, Rows):
        raise ValueError(f"no mapping of rows for a table with fingerprint {print_}")
    return rows.select(F.col(m.conversation).cast("long").alias("conv_id"), F.col(m.order).cast("long").alias("turn"), F.col(m.role).cast("string").alias("role"), F.col(m.text).cast("string").alias("text"))


# --- template -----------------------------------------------------------------------------------

TURN, END = "<|turn|>", "<|end|>"
#: Starts of control strings in texts (ours and those of common templates), and the escape character itself.
_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])")
_CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "\n": "\\n"}
_PLAIN = {v[1]: k for k, v in _CODES.items()}
_TURN = re.compile(rf"{re.escape(TURN)}((?:[^\\\n]|\\.)*)\n(.*?){re.escape(END)}\n", re.S)


def escape(text: str) -> str:
    """Put a backslash code for each start of a control string, and each backslash."""
    return _CONTROL.sub(lambda m: _CODES[m.group()], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m.group(1)], text)


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A formatted turn, and first character and end of its loss span (equal unless the assistant speaks)."""
    role, body = (role or "").replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "\\l|"), escape(text or "")
    head = f"{TURN}{role}\n"
    out = f"{head}{body}{END}\n"
    return out, len(head), len(head) + len(body) * (role == "assistant")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    return [(unescape(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(formatted)]


def format_turns(turns: DataFrame) -> DataFrame:
    """Formatted turns: conv_id, turn, role, text, formatted, loss_start, loss_end (characters within formatted).

    The turns of a conversation, joined in the order of (turn, role, text), are its formatted text. Null
    roles and texts count as empty. Each row is rendered by itself, before any shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _, _ in done], pa.string()), pa.array([x for _, x, _ in done], pa.int64()), pa.array([x for _, _, x in done], pa.int64())], names=["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])

    return map_text(turns.select("conv_id", "turn", "role", "text"), run, _TURN_SCHEMA + ", formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """What each formatted row holds: conv_id, turn, role and text as parsed, loss (its text under the mask) and chars.

    ``loss`` is null where it is just ``text``, so that no text travels twice. Rows are read where they stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken, roles, texts, losses, chars = [], [], [], [], []
            for i, (text, a, e) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                loss, size = unescape(text[a:e]), len(text)
                for role, said in parse(text):
                    taken.append(i)
                    roles.append(role)
                    texts.append(said)
                    losses.append(None if loss == said else loss)
                    chars.append(size)
                    loss, size = "", 0  # of further turns of the same row
            at = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(losses, pa.string()), pa.array(chars, pa.int64())], names=["conv_id", "turn", "role", "text", "loss", "chars"])

    return map_text(formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end"), run, _TURN_SCHEMA + ", loss string, chars long")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back of each formatted conversation, in one pass over its turns in order.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Formatted rows are parsed where
    they stand; only what was read is shuffled. Hashes run on from turn to turn, so a conversation of any
    length needs the memory of one turn, and its one task does nothing but hash. Conversations whose id is
    null are one conversation; turns with equal numbers go by role, then text; repeated turns count each.
    """
    dealt = read_back(formatted).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now: list | None = None
        done: list[list] = []

        def close() -> None:
            if now is not None:
                conv, n, turns, loss_chars, loss, chars = now
                done.append([conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
            done.clear()
            return out

        for b in batches:
            for conv, role, text, loss, chars in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                loss = text if loss is None else loss
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += chars
            if len(done) > 1000:
                yield flush()
        close()
        if done:
            yield flush()

    return map_text(dealt.select("conv_id", "role", "text", "loss", "chars"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
