r"""Chat formatting by schema fingerprint.

A record's nested field paths (array elements as ``[]``), sorted and hashed, are its fingerprint; a registry maps each
fingerprint to a declarative mapping that reads canonical turns out of the record. Turns are rendered by a template that
escapes its own control strings inside texts, so that rendering can be parsed back exactly.

Template of a turn: ``<turn ROLE>\n`` TEXT ``\n</turn>\n``. In a text or role every backslash is doubled and ``<`` and ``>``
become ``\l`` and ``\g``; a role's newline becomes ``\n``. The loss mask covers assistant texts.

Defined results: null text is empty, null role is the empty role; a record whose fingerprint has no mapping, or that is no JSON
object, keeps its row with ``fingerprint`` and a null ``turns``; turns with equal order keys are ordered by role, then text;
an empty table gives no rows; other columns are carried by ``canonical`` only if named as keys.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertia.llm.common import column, materialize, slices

ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "\n": "\\n"}
PLAIN = {v: k for k, v in ESCAPES.items()}
_TEXT, _ROLE, _BACK = re.compile(r"[\\<>]"), re.compile(r"[\\<>\n]"), re.compile(r"\\[\\lgn]")
_TURN = re.compile(r"<turn ([^<>\n]*)>\n([^<>]*)\n</turn>\n")
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Mapping:
    """Where a layout's turns are. ``each``: path of an array whose elements are turns, with ``role`` and ``text`` paths
    inside an element; or ``fields``: pairs of a fixed role and a path from the record's top. ``roles`` renames roles."""

    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: Known layouts: example field paths and their mapping.
LAYOUTS: tuple[tuple[tuple[str, ...], Mapping], ...] = (
    (("messages[].content", "messages[].role"), Mapping("messages[]", "role", "content")),
    (("conversations[].from", "conversations[].value"), Mapping("conversations[]", "from", "value", roles=(("human", "user"), ("gpt", "assistant")))),
    (("role", "text"), Mapping("", "role", "text")),
    (("prompt", "response"), Mapping(fields=(("user", "prompt"), ("assistant", "response")))),
    (("completion", "prompt"), Mapping(fields=(("user", "prompt"), ("assistant", "completion")))),
    (("instruction", "output"), Mapping(fields=(("user", "instruction"), ("assistant", "output")))),
    (("input", "instruction", "output"), Mapping(fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")))),
    (("output", "prompt", "system"), Mapping(fields=(("system", "system"), ("user", "prompt"), ("assistant", "output")))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of all leaves; null, numbers and texts are leaves alike, an empty array or object is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


def registry(layouts: Iterable[tuple[tuple[str, ...], Mapping]] = LAYOUTS) -> dict[str, Mapping]:
    return {fingerprint(paths): mapping for paths, mapping in layouts}


def _reach(value: object, path: str) -> list:
    """Values at a path; ``[]`` fans out."""
    found = [value]
    for step in filter(None, path.split(".")):
        fan, name = step.endswith("[]"), step.removesuffix("[]")
        found = [v[name] for v in found if isinstance(v, dict) and name in v]
        if fan:
            found = [x for v in found if isinstance(v, list) for x in v]
    return found


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def apply_mapping(mapping: Mapping, record: object) -> list[tuple[str, str]]:
    names = dict(mapping.roles)
    if mapping.fields:
        return [(role, _text(v)) for role, path in mapping.fields for v in _reach(record, path)]
    out = []
    for element in _reach(record, mapping.each):
        role, text = (next(iter(_reach(element, p)), None) for p in (mapping.role, mapping.text))
        out.append((names.get(_text(role), _text(role)), _text(text)))
    return out


def render(role: str, text: str) -> str:
    return f"<turn {_ROLE.sub(lambda m: ESCAPES[m[0]], role)}>\n{_TEXT.sub(lambda m: ESCAPES[m[0]], text)}\n</turn>\n"


def _plain(escaped: str) -> str:
    return _BACK.sub(lambda m: PLAIN[m[0]], escaped)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text; anything else than whole turns is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        turns.append((_plain(m[1]), _plain(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """Spans of the formatted text that are trained on: the escaped assistant texts."""
    return [m.span(2) for m in _TURN.finditer(formatted) if _plain(m[1]) == LOSS_ROLE]


def canonical(df: DataFrame, record_col: str, keys: list[str], layouts=LAYOUTS) -> DataFrame:
    """JSON records to ``(keys, fingerprint, turns array<struct<role,text>>)``."""
    kept = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry(layouts)
        for batch in slices(batches, "__record"):
            prints, turns = [], []
            for raw in column(batch, "__record").to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    prints.append(None)
                    turns.append(None)
                    continue
                key = fingerprint(field_paths(record))
                prints.append(key)
                turns.append([{"role": r, "text": t} for r, t in apply_mapping(known[key], record)] if key in known else None)
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keys), pa.array(prints, pa.string()), pa.array(turns, turn)], [*keys, "fingerprint", "turns"])

    cols = [F.col(k) for k in keys]
    return df.select(*cols, F.col(record_col).alias("__record")).mapInArrow(run, f"{kept}, fingerprint string, turns array<struct<role:string,text:string>>")


def format_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """The written output ``(keys, pos, segment)``: each canonical turn rendered, row by row. A conversation's formatted text is its segments in
    the order of its keys, then ``pos``; a conversation of any length is thus spread over tasks until it is joined. A record without a mapping keeps
    a row, with a null ``pos`` and ``segment``."""
    kept = ", ".join(f"`{k}` {turns.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = zip(*(column(batch, c).to_pylist() for c in ("pos", "role", "text")), strict=True)
            segments = [None if at is None else render(r or "", t or "") for at, r, t in rows]
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keys), column(batch, "pos"), pa.array(segments, pa.string())], [*keys, "pos", "segment"])

    flat = turns.select(*keys, F.posexplode_outer("turns").alias("pos", "__turn")).select(*keys, "pos", "__turn.role", "__turn.text")
    return materialize(flat.mapInArrow(run, f"{kept}, pos int, segment string"), "formatted")


def turn_records(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table with a row for each turn as one JSON record a row, in three layouts by turn: a bare ``role, text``; a list of one message; and a list of one
    ``from, value`` pair, for the roles that this layout renames. Each says the same, and their mappings bring back the same turn."""
    role, text = F.col(role_col).cast("string"), F.col(text_col).cast("string")
    given = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))[role]
    kind = F.pmod(F.coalesce(F.col(turn_col).cast("long"), F.lit(0)), F.lit(3))
    options = {"ignoreNullFields": "false"}
    bare = F.to_json(F.struct(role.alias("role"), text.alias("text")), options)
    messages = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")), options)
    pairs = F.to_json(F.struct(F.array(F.struct(given.alias("from"), text.alias("value"))).alias("conversations")), options)
    record = F.when((kind == 1) & given.isNotNull(), pairs).when(kind == 2, messages).otherwise(bare)
    return conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), record.alias("record"))


def read_back(segments: DataFrame) -> DataFrame:
    """Parses each conversation's stored output again and digests it, as a stream over sorted rows: nothing of a
    conversation is held but the digests' states. Records without a mapping add no turn."""
    id_type = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, begun, done = None, None, False, []

        def close():
            done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            kind["id"] = column(batch, "conv_id").type
            for conv, segment in zip(column(batch, "conv_id").to_pylist(), column(batch, "segment").to_pylist(), strict=True):
                if not begun or conv != current:
                    if begun:
                        close()
                    state, current, begun = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv, True
                if segment is None:
                    continue
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for a, b in loss_spans(segment):
                    text = _plain(segment[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(segment)
            if len(done) >= 10_000:
                yield _rows(done, kind["id"], names)
                done = []
        if begun:
            close()
        if done:
            yield _rows(done, kind["id"], names)

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment", "pos")
    return dealt.mapInArrow(run, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(done: list[tuple], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    ids, *rest = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(x) for x in rest)], names)
