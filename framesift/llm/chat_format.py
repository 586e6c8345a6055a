"""Chat formatting: schema fingerprints select mappings to canonical turns; a reversible template marks them.

A record is a JSON object of any known layout. Its nested field paths (list
items as []) are sorted and hashed; the fingerprint selects a declarative
mapping, which says where roles and texts stand. A fingerprint of no mapping selects
the mapping with the most paths of those whose paths it all has, so further fields
(an id, a name) change nothing. Turns are then formatted as
<turn> role, newline, text </turn> newline, with control strings inside roles
and texts escaped, so that the output alone gives back every turn.

Defined results. A null or missing text is empty; a null or missing role is the
empty role; any other value that isn't a string is its JSON text, and so is a list
item that isn't an object. Halves of surrogate pairs become U+FFFD. A record
that isn't a JSON object, that is nested too deeply to be read, or whose layout is
unknown gives no turns: its conversation is reported with what else it has, and
its fingerprint is counted by unknown_layouts(). Turns of a conversation are
ordered by turn (nulls first), then by part, role and text; rows that repeat stay.
A null conversation id is one conversation. Extra columns are ignored. A
conversation of any length is streamed through one sorted partition and never
held as a whole.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layouts by name: (example record, list of turns or None for the record itself, [(role field or constant, text field), ...]).
#: A constant role is written with a leading '='; a missing or empty optional text gives no turn.
MAPPINGS = {
    "turn rows": ({"role": "", "text": "", "turn": 0}, None, [("role", "text")]),
    "messages": ({"messages": [{"role": "", "content": ""}]}, "messages", [("role", "content")]),
    "conversations": ({"conversations": [{"from": "", "value": ""}]}, "conversations", [("from", "value")]),
    "turns": ({"turns": [{"speaker": "", "utterance": ""}]}, "turns", [("speaker", "utterance")]),
    "prompt": ({"prompt": "", "response": ""}, None, [("=user", "prompt"), ("=assistant", "response")]),
    "completion": ({"prompt": "", "completion": ""}, None, [("=user", "prompt"), ("=assistant", "completion")]),
    "question": ({"question": "", "answer": ""}, None, [("=user", "question"), ("=assistant", "answer")]),
    "instruction": ({"instruction": "", "output": ""}, None, [("=user", "instruction"), ("=assistant", "output")]),
    "instruction with input": ({"instruction": "", "input": "", "output": ""}, None, [("=user", "instruction+input"), ("=assistant", "output")]),
    "system prompt": ({"system": "", "prompt": "", "response": ""}, None, [("=system", "system"), ("=user", "prompt"), ("=assistant", "response")]),
}
#: Other names of the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
OPEN, CLOSE = "<turn>", "</turn>\n"
_ESCAPED, _BACK = re.compile(r"\\|<(?=/?turn>)|###(?= )"), re.compile(r"\\(.)", re.S)
_CODES = {"\\": "\\", "<": "l", "#": "h"}
_CHARS = {"\\": "\\", "l": "<", "h": "###", "n": "\n"}


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}") for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(record) -> str:
    """Hash of a record's nested field paths."""
    return hashlib.sha256("\n".join(sorted(field_paths(record))).encode()).hexdigest()[:16]


LAYOUTS = {fingerprint(example): name for name, (example, _, _) in MAPPINGS.items()}
_PATHS = {name: field_paths(example) - {".turn"} for name, (example, _, _) in MAPPINGS.items()}


def layout_of(paths: set[str]) -> str | None:
    """The mapping with the most paths, all of which are there or lead further; of equals the first in text order."""
    there = lambda p: p in paths or any(q.startswith((p + ".", p + "[")) for q in paths)
    fits = [(-len(own), name) for name, own in _PATHS.items() if all(map(there, own))]
    return min(fits)[1] if fits else None


def _whole(text: str) -> str:
    """text with the halves of surrogate pairs that stand alone as U+FFFD."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _said(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(text: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """(fingerprint, turns) of a JSON record."""
    try:
        record = json.loads(text)
        if not isinstance(record, dict):
            return None, []
        paths = field_paths(record)
    except (TypeError, ValueError, RecursionError):
        return None, []
    mark = hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]
    if (name := LAYOUTS.get(mark) or layout_of(paths)) is None:
        return mark, []
    _, items, fields = MAPPINGS[name]
    turns = []
    for item in record[items] if items else [record]:
        if not isinstance(item, dict):
            turns.append(("", _said(item)))
            continue
        for role, field in fields:
            said = "\n".join(x for f in field.split("+") if (x := _said(item.get(f))) or "+" not in field)
            turns.append((role[1:] if role[0] == "=" else _said(item.get(role)), said))
    return mark, [(_whole(r), _whole(t)) for r, t in turns]


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + _CODES[m[0][0]], text)


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: _CHARS[m[1]], text)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{CLOSE}"


def read_turn(line: str) -> tuple[str, str, str]:
    """(role, text, text as it stands) of one formatted turn."""
    assert line.startswith(OPEN) and line.endswith(CLOSE)
    role, _, raw = line[len(OPEN) : -len(CLOSE)].partition("\n")
    return unescape(role), unescape(raw), raw


def read_back(formatted: str) -> list[tuple[str, str, str]]:
    """Turns of a formatted conversation: no text holds an unescaped mark, so cutting at the marks is safe."""
    parts = formatted.split(CLOSE + OPEN)
    return [read_turn((OPEN if i else "") + p + (CLOSE if i < len(parts) - 1 else "")) for i, p in enumerate(parts)] if formatted else []


def turns_of(records: DataFrame) -> DataFrame:
    """(conv_id, turn, part, fingerprint, role, text) of (conv_id, turn, record): canonical turns, in order of turn and part."""

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for conv, turn, record in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                mark, turns = canonical(record)
                out += [(conv, turn, i, mark, ROLES.get(r, r), t) for i, (r, t) in enumerate(turns)] or [(conv, turn, None, mark, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "turn", "part", "fingerprint", "role", "text"])

    return records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record").mapInArrow(each, "conv_id long, turn long, part int, fingerprint string, role string, text string")


def unknown_layouts(turns: DataFrame) -> DataFrame:
    return turns.filter("part is null").groupBy("fingerprint").count()


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, part, formatted, loss): a row per turn, and an empty one per record without turns; loss is the character range under the mask, within the row's piece."""

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = [format_turn(r or "", t or "") if p is not None else "" for r, t, p in zip(c["role"], c["text"], c["part"], strict=True)]
            loss = [len(f) - len(CLOSE) - len(escape(t or "")) if r == "assistant" else None for f, r, t in zip(out, c["role"], c["text"], strict=True)]
            ends = [None if at is None else len(f) - len(CLOSE) for at, f in zip(loss, out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("part"), pa.array(out, pa.string()), pa.array(loss, pa.int64()), pa.array(ends, pa.int64()), batch.column("role"), batch.column("text")], names=["conv_id", "turn", "part", "formatted", "loss_from", "loss_to", "role", "text"])

    rows = turns.select("conv_id", "turn", "part", "role", "text")
    return rows.mapInArrow(each, "conv_id long, turn long, part int, formatted string, loss_from long, loss_to long, role string, text string")


def digest(formatted: DataFrame) -> DataFrame:
    """The columns of the op5 query, read back from the formatted pieces in order; conversations are streamed."""

    def each(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now = None

        def done():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        for batch in batches:
            out = []
            for conv, piece, start, to in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(done())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _ in read_back(piece):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    said = unescape(piece[start:to])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(done(), kinds, strict=True)], names=names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "role", "text").select("conv_id", "formatted", "loss_from", "loss_to")
    return ordered.mapInArrow(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, record): each row of (conv_id, turn, role, text) as a JSON record of the layout 'turn rows'."""
    record = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"))
    return conversations.select("conv_id", "turn", F.to_json(record).alias("record"))
