"""Chat formatting: heterogeneous records to canonical turns, and turns to templated text.

Method: schema fingerprinting. The nested field paths of a record are hashed;
the fingerprint selects a declarative mapping that says where turns, roles and
texts stand. Turns are then written with a template whose control strings are
escaped inside texts, reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Canonical names of roles; others are kept as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of all fields below a value; list elements share the path with ``[]``."""
    if isinstance(value, dict):
        return set().union({f"{at}.{k}" for k in value}, *(field_paths(v, f"{at}.{k}") for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return set()


def fingerprint(paths: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode("utf-8", "replace")).hexdigest()


def _list(name: str, role: str, text: str) -> dict:
    return {"paths": {f".{name}", f".{name}[].{role}", f".{name}[].{text}"}, "turns": name, "role": role, "text": text}


def _fields(*parts: tuple[str, str]) -> dict:
    """Fields that are turns themselves; parts of one role in a row make one turn."""
    return {"paths": {f".{name}" for name, _ in parts}, "parts": parts}


#: Known layouts. Fields named here decide the fingerprint; other fields of a record don't.
LAYOUTS = (
    _list("messages", "role", "content"),
    _list("conversations", "from", "value"),
    _list("turns", "role", "text"),
    _list("dialog", "speaker", "utterance"),
    _fields(("prompt", "user"), ("response", "assistant")),
    _fields(("prompt", "user"), ("completion", "assistant")),
    _fields(("system", "system"), ("prompt", "user"), ("response", "assistant")),
    _fields(("question", "user"), ("answer", "assistant")),
    _fields(("instruction", "user"), ("output", "assistant")),
    _fields(("instruction", "user"), ("input", "user"), ("output", "assistant")),
    _fields(("instruction", "user"), ("context", "user"), ("response", "assistant")),
    {"paths": {".role", ".text"}, "role": "role", "text": "text"},
)
MAPPINGS = {fingerprint(x["paths"]): x for x in LAYOUTS}
_KNOWN = set().union(*(x["paths"] for x in LAYOUTS))
#: The layout selected for each fingerprint seen; there are no more of them than sets of known fields.
_SELECTED = {key: (key, x) for key, x in MAPPINGS.items()}


def mapping_of(paths: set[str]) -> tuple[str | None, dict | None]:
    """Fingerprint and mapping of the layout of a record with these paths.

    Where none has just these, it is the one with most of them that needs no others; fields of other layouts are then extra ones.
    """
    known = paths & _KNOWN
    key = fingerprint(known)
    if key not in _SELECTED:
        fits = [x for x in LAYOUTS if x["paths"] <= known]
        best = max(fits, key=lambda x: len(x["paths"]), default=None)
        _SELECTED[key] = (None, None) if best is None else (fingerprint(best["paths"]), best)
    return _SELECTED[key]


def _text(value: object) -> str:
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    return text.encode("utf-8", "replace").decode()  # JSON can name half a surrogate pair


def turns_of(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """Fingerprint of a JSON record, null if no mapping knows it, and its canonical turns."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        return None, []
    if not isinstance(value, dict):
        return None, []
    key, mapping = mapping_of(field_paths(value))
    if mapping is None:
        return None, []
    if "turns" in mapping:
        pairs = [(x.get(mapping["role"]), x.get(mapping["text"])) for x in value[mapping["turns"]] if isinstance(x, dict)]
    elif "parts" in mapping:
        pairs = []
        for name, role in mapping["parts"]:
            text = _text(value[name])
            if pairs and pairs[-1][0] == role:
                pairs[-1] = role, "\n\n".join(x for x in (pairs[-1][1], text) if x)
            else:
                pairs.append((role, text))
    else:
        pairs = [(value[mapping["role"]], value[mapping["text"]])]
    if "system" in value and ".system" not in mapping["paths"]:
        # Instructions beside the turns come before them.
        pairs.insert(0, ("system", value["system"]))
    return key, [(ROLES.get(_text(role), _text(role)), _text(text)) for role, text in pairs]


def canonical_turns(records: DataFrame, record: str = "record", keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """(keys..., fingerprint, part, role, text): a row for each turn of each JSON record.

    A record that is null, no JSON object or of an unknown layout gives one row with null
    fingerprint, part, role and text. Null texts and roles are empty strings; values that are not
    strings are written as JSON. Fields that no layout names do not matter. A record with fields of several layouts has the layout that takes
    most of them; a ``system`` field beside turns is a turn before them.
    """
    fields = records.select(*keys).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], ([], [], [], [])
            for i, value in enumerate(batch.column(len(keys)).to_pylist()):
                key, turns = turns_of(value)
                for part, (role, text) in enumerate(turns):
                    at.append(i)
                    for column, x in zip(out, (key, part, role, text), strict=True):
                        column.append(x)
                if key is None:
                    at.append(i)
                    for column in out:
                        column.append(None)
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            new = [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*keys, "fingerprint", "part", "role", "text"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return records.select(*keys, record).mapInArrow(run, f"{shape}, fingerprint string, part long, role string, text string")


# A control string starts with <| ; inside a text a backslash goes between, one more for each that is there.
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def template(role: str, text: str) -> tuple[str, int, int]:
    """One turn's text, and the span of the turn's own text in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of templated text."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


_FORMATTED = "conv_id long, position long, formatted string, loss_start long, loss_end long"


def format_turns(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """Templated turns: (conv_id, position, formatted, loss_start, loss_end).

    A conversation's text is its rows' ``formatted`` joined by position. The loss covers the span
    from loss_start to loss_end (code points of ``formatted``): the assistant's texts; null for
    others. Rows go by turn, part, role and text, so equal turns and repeated rows keep a fixed order and
    nulls come first. Turns of one conversation meet in one task, which
    streams them: it never holds a conversation.
    """
    ordered = turns.select("conv_id", "turn", "part", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartition(partitions, "conv_id") if partitions else ordered.repartition("conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, position = object(), 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                position = position + 1 if conv == last else 0
                last = conv
                formatted, start, end = template(role, text)
                masked = (start, end) if role == "assistant" else (None, None)
                rows.append((conv, position, formatted, *masked))
            types = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["conv_id", "position", "formatted", "loss_start", "loss_end"],
            )

    return ordered.sortWithinPartitions("conv_id", "turn", "part", "role", "text").mapInArrow(run, _FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from each conversation's formatted text.

    Rows of a conversation must be together and in order, as format_turns leaves them.
    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def row() -> tuple:
            conv, n, turns, chars, loss, size = now
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            rows = []
            for conv, text, start, end in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    masked = unescape(text[start:end])
                    now[3] += len(masked)
                    now[4].update(masked.encode())
                now[5] += len(text)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(), types, strict=True)], names=names)

    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(run, shape)
