"""Chat formatting by schema fingerprints.

A record's layout is told by the hash of its nested field paths (names and kinds, without values). The fingerprint selects
a declarative mapping, which says where the turns, roles and texts are; so prompt and completion, instruction, nested
message lists and one-row-per-turn tables all become canonical turns (conversation, turn, role, text). A fingerprint that is met for the first time
is resolved once, to the mapping that has most of its fields among the paths (of equal ones the first); more fields than a mapping names do no harm.
JSON records are mapped one by one, tables with typed columns by column functions.

The template marks a turn as `<|im_start|>role\\ntext<|im_end|>\\n`. In roles and texts, every `<|` that could be read as a
control string is written `<\\|`, and a `<` before backslashes and a bar gets one more backslash; taking one away restores the text exactly.

Cases: a null text or role is empty; a null or tied turn number is ordered by role, then text; a null conversation id is a
conversation of its own; a record whose layout no mapping names gives no turns and is returned by `unmapped`, and a table whose layout none names is an
error; empty tables give empty results; columns that the mapping doesn't name are not read. One conversation is one task's, streamed in chunks.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: A formatted chunk holds whole turns and is closed from this many characters on.
CHUNK_CHARS = 1 << 20
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """The text without anything that could be read as a control string; reversible."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """What escape() was given."""
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role as one line: also without line feeds."""
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    """What escape_role() was given."""
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


# --- fingerprints and mappings ------------------------------------------------------------------------------------


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type, with `[]` for list items and the kind of each leaf."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [f"{at}:{'number' if isinstance(kind, T.NumericType) else 'text'}"]


def value_paths(value: object, at: str = "") -> list[str]:
    """The nested field paths of a parsed JSON value, as schema_paths() names them."""
    if isinstance(value, dict):
        return sorted({p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)})
    if isinstance(value, list):
        return sorted({p for v in value for p in value_paths(v, f"{at}[]")})
    return [f"{at}:{'number' if isinstance(value, (int, float)) and not isinstance(value, bool) else 'text'}"]


def fingerprint(paths: list[str]) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How a layout that has the field paths `needs` becomes turns.

    rows: one row per turn (conversation, turn, role, text columns). turns: a list of (role field, text field) in a list field; a text may itself be
    a list of parts, joined by line feeds. fields: (role, fields whose texts are joined by an empty line) in order. `roles` renames roles.
    """

    kind: str
    needs: tuple[str, ...]
    conversation: str | None = None
    turn: str | None = None
    role: str | None = None
    text: str | None = None
    items: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


def _fields(*parts: tuple[str, tuple[str, ...]]) -> Mapping:
    return Mapping("fields", tuple(f"{p}:text" for _, names in parts for p in names), fields=parts)


def _listed(items: str, role: str, text: str, parts: str | None = None) -> Mapping:
    return Mapping("turns", (f"{items}[].{role}:text", f"{items}[].{text}{f'[].{parts}' if parts else ''}:text"), items=items, role=role, text=f"{text}.{parts}" if parts else text)


def default_mappings() -> list[Mapping]:
    """The layouts known from the start."""
    return [
        Mapping("rows", ("conv_id:number", "role:text", "text:text", "turn:number"), "conv_id", "turn", "role", "text"),
        _fields(("user", ("prompt",)), ("assistant", ("completion",))),
        _fields(("user", ("prompt",)), ("assistant", ("response",))),
        _fields(("user", ("question",)), ("assistant", ("answer",))),
        _fields(("user", ("instruction",)), ("assistant", ("output",))),
        _fields(("user", ("instruction", "input")), ("assistant", ("output",))),
        _fields(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",))),
        _fields(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
        _fields(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
        _listed("messages", "role", "content"),
        _listed("messages", "role", "content", "text"),
        _listed("conversations", "from", "value"),
        _listed("turns", "speaker", "text"),
    ]


class Mappings:
    """Fingerprint -> mapping; a fingerprint that is not there is resolved from its paths and remembered."""

    def __init__(self, mappings: list[Mapping] | None = None) -> None:
        self.all = default_mappings() if mappings is None else mappings
        self.known: dict[str, Mapping | None] = {fingerprint(list(m.needs)): m for m in reversed(self.all)}

    def find(self, paths: list[str]) -> Mapping | None:
        name = fingerprint(paths)
        if name not in self.known:
            have = set(paths)
            fit = [m for m in self.all if have.issuperset(m.needs)]
            self.known[name] = max(fit, key=lambda m: len(m.needs)) if fit else None
        return self.known[name]


def _dig(value: object, path: str) -> str:
    """The text at a path; the items of a list are joined by line feeds."""
    name, _, rest = path.partition(".")
    value = value.get(name) if isinstance(value, dict) else None
    if isinstance(value, list):
        return "\n".join(t for t in (_dig(x, rest) if isinstance(x, dict) else str(x) for x in value if x is not None) if t)
    return _dig(value, rest) if rest and isinstance(value, dict) else "" if value is None else str(value)


def record_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of a parsed record."""
    names = dict(mapping.roles)
    if mapping.kind == "rows":
        return [(names.get(r := _dig(record, mapping.role), r), _dig(record, mapping.text))]
    if mapping.kind == "turns":
        items = record.get(mapping.items) or []
        return [(names.get(r := _dig(x, mapping.role), r), _dig(x, mapping.text)) for x in items if isinstance(x, dict)]
    out = []
    for role, paths in mapping.fields:
        text = "\n\n".join(t for t in (_dig(record, p) for p in paths) if t)
        if text or role != "system":
            out.append((role, text))
    return out


_TURNS = "conv_id long, turn long, role string, text string"


def table_turns(df: DataFrame, mappings: list[Mapping] | None = None, id_col: str | None = None, rename: bool = True) -> DataFrame:
    """Canonical turns of a table; its mapping is found by the fingerprint of its schema.

    A table without one row per turn needs a number as id: `id_col`, or conv_id or id, else each row gets a number of its own. `rename`
    says whether roles are renamed as the mapping says.
    """
    m = Mappings(mappings).find(schema_paths(df.schema))
    if m is None:
        raise ValueError(f"no mapping for {schema_paths(df.schema)}")
    names = F.create_map(*(F.lit(x) for pair in m.roles for x in pair)) if m.roles and rename else None
    named = lambda role: F.coalesce(F.element_at(names, role), role) if names is not None else role
    if m.kind == "rows":
        return df.select(F.col(m.conversation).cast("long").alias("conv_id"), F.col(m.turn).cast("long").alias("turn"), named(F.col(m.role).cast("string")).alias("role"), F.col(m.text).cast("string").alias("text"))
    own = id_col or next((c for c in ("conv_id", "id") if c in df.columns and isinstance(df.schema[c].dataType, T.NumericType)), None)
    conv = F.col(own).cast("long") if own else F.monotonically_increasing_id()
    if m.kind == "turns":
        name, _, part = m.text.partition(".")

        def text(x):
            found = x[name][part] if part else x[name]
            return F.array_join(F.filter(found, lambda t: t != ""), "\n") if part else found.cast("string")

        turns = F.transform(m.items, lambda x: F.struct(named(x[m.role].cast("string")).alias("role"), text(x).alias("text")))
    else:
        empty = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
        said = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(empty(c) for c in parts)).alias("text")) for role, parts in m.fields]
        turns = F.filter(F.array(*said), lambda x: (x["role"] != "system") | (x["text"] != ""))
    out = df.select(conv.alias("conv_id"), F.posexplode(turns).alias("turn", "said"))
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "said.role", "said.text")


def json_turns(df: DataFrame, id_col: str, json_col: str, mappings: list[Mapping] | None = None) -> DataFrame:
    """Canonical turns of JSON records of mixed layouts, each mapped by its own fingerprint."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Mappings(mappings)
        for b in it:
            out = []
            for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                record = _record(raw)
                if m := known.find(value_paths(record)) if record is not None else None:
                    out += [(c, int(record.get(m.turn) or 0) if m.turn else k, r, t) for k, (r, t) in enumerate(record_turns(record, m))]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)], ["conv_id", "turn", "role", "text"])

    return df.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(run, _TURNS)


def _record(raw: str | None) -> dict | None:
    try:
        value = json.loads(raw or "")
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def unmapped(df: DataFrame, id_col: str, json_col: str, mappings: list[Mapping] | None = None) -> DataFrame:
    """(id, fingerprint) of the JSON records whose layout no mapping names; unreadable ones have an empty fingerprint."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Mappings(mappings)
        for b in it:
            paths = [value_paths(r) if (r := _record(x)) is not None else None for x in b.column(1).to_pylist()]
            lost = [k for k, p in enumerate(paths) if p is None or known.find(p) is None]
            prints = [fingerprint(paths[k]) if paths[k] is not None else "" for k in lost]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lost, pa.int64())), pa.array(prints, pa.string())], ["id", "fingerprint"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(json_col).cast("string")).mapInArrow(run, "id long, fingerprint string")


# --- template -----------------------------------------------------------------------------------------------------

_CHUNK_SCHEMA = "conv_id long, chunk long, formatted string, loss_spans array<long>"


def format_turns(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, chunk, formatted, loss_spans) of all conversations, in order within each partition.

    A conversation's turns are sorted on disk and streamed, never gathered; a long conversation gives several chunks of
    whole turns. loss_spans holds start and end of each span under the loss mask: code points of `formatted`.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])
        conv, chunk, parts, spans, size, begun = None, 0, [], [], 0, False
        out: list[dict] = []
        held = 0

        def close() -> None:
            out.append({"conv_id": conv, "chunk": chunk, "formatted": "".join(parts), "loss_spans": list(spans)})

        for b in it:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if begun and (c != conv or size >= CHUNK_CHARS):
                    close()
                    held += size
                    chunk = chunk + 1 if c == conv else 0
                    parts, spans, size = [], [], 0
                conv, begun = c, True
                head, body = f"{START}{escape_role(role or '')}\n", escape(text or "")
                if (role or "") in trained:
                    spans += [size + len(head), size + len(head) + len(body)]
                turn = f"{head}{body}{END}\n"
                parts.append(turn)
                size += len(turn)
                if held >= CHUNK_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
        if begun:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, _CHUNK_SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted chunk."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the formatted chunks and their loss spans alone.

    It expects format_turns()'s order of rows, so it streams too: digests are updated chunk by chunk.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        out: list[dict] = []
        state: dict | None = None

        def close() -> None:
            out.append({k: v.hexdigest() if k.endswith("sha256") else v for k, v in state.items()})

        for b in it:
            for c, text, spans in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if state is None or state["conv_id"] != c:
                    if state is not None:
                        close()
                    state = {"conv_id": c, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                for role, said in parse(text):
                    state["n_turns"] += 1
                    state["turns_sha256"].update(f"{role}\n{said}\n".encode())
                for a, z in zip(spans[::2], spans[1::2], strict=True):
                    said = unescape(text[a:z])
                    state["loss_chars"] += len(said)
                    state["loss_sha256"].update(said.encode())
                state["formatted_chars"] += len(text)
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if state is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, with conversation -1, whose texts are made of control strings."""
    turns = table_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"), rename=False)
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], _TURNS)
    return read_back(format_turns(turns.unionByName(extra)))
