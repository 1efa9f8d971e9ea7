r"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the fingerprint selects a declarative mapping that turns the record's layout
(prompt and completion, instruction with input, lists of messages, rows by turn) into canonical turns (role, text).
A template marks the turns and escapes control strings inside them, so that the text reads back exactly:

    ### role: text </turn>\n

A backslash stands before each backslash and `#`, and inside `</`; in a role also before a space after `:`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Mapping:
    """paths: those that a record must have; also: those that it may have.

    each = (list of turns, field of the role, field of the text); parts = ((role, (fields joined by an empty line)), ...);
    parts come before the turns of each. roles: canonical names of a layout's own. Fields are paths like `chat.messages` or
    `content[].text`; texts at one path join without a break.
    """

    name: str
    paths: frozenset[str]
    also: frozenset[str] = frozenset()
    each: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


def _listed(name: str, items: str, role: str, text: str, system: str = "system", roles: tuple = ()) -> Mapping:
    return Mapping(name, frozenset({f"{items}[].{role}", f"{items}[].{text}"}), frozenset({system}), (items, role, text), (("system", (system,)),), roles)


MAPPINGS = (
    _listed("turn rows", "turns", "role", "text"),
    _listed("messages", "messages", "role", "content"),
    _listed("message parts", "messages", "role", "content[].text"),
    _listed("message objects", "messages", "role", "content.text"),
    _listed("from and value", "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("instruction", frozenset({"instruction", "output"}), frozenset({"input", "system"}), None, (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt", frozenset({"prompt", "completion"}), frozenset({"system"}), None, (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", frozenset({"prompt", "response"}), frozenset({"system", "context"}), None, (("system", ("system",)), ("user", ("context", "prompt")), ("assistant", ("response",)))),
    Mapping("question", frozenset({"question", "answer"}), frozenset({"system", "context"}), None, (("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
)


def field_paths(record: object) -> set[str]:
    """Paths of a record's leaves; all items of a list share one path; nulls and empty lists have none."""
    out, left = set(), [("", record)]
    while left:
        at, value = left.pop()
        if isinstance(value, dict):
            left += ((f"{at}.{k}" if at else str(k), v) for k, v in value.items())
        elif isinstance(value, list):
            left += ((f"{at}[]", v) for v in value)
        elif value is not None:
            out.add(at)
    return out


def values_at(record: object, path: str) -> list:
    """Values at a path of names and `[]`, in order; what is no object or list on the way gives none."""
    found = [record]
    for step in path.replace("[]", ".[]").split("."):
        if step == "[]":
            found = [y for x in found if isinstance(x, list) for y in x]
        else:
            found = [x[step] for x in found if isinstance(x, dict) and x.get(step) is not None]
    return found


def as_text(value: object) -> str:
    """A value as the text that it says: strings as they are, numbers and booleans as in JSON, lists item by item without a break, objects by
    their `text`, `content` or `value`, the first that they have. Nulls, and objects without these, say nothing."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return next((as_text(value[k]) for k in ("text", "content", "value") if value.get(k) is not None), "")
    if isinstance(value, list):
        return "".join(map(as_text, value))
    return "" if value is None else json.dumps(value)


def text_at(record: object, path: str) -> str | None:
    found = values_at(record, path)
    return "".join(map(as_text, found)) if found else None


def turn_text(turn: dict, path: str) -> str:
    """Text of a turn at a path whose first field may hold a text, an object, or a list that mixes both: each item gives what is at the rest
    of the path, or else what it says itself."""
    head, _, rest = path.replace("[]", "").partition(".")
    value = turn.get(head)
    if not rest:
        return as_text(value)
    items = value if isinstance(value, list) else [value]
    found = ((text_at(x, rest), x) for x in items)
    return "".join(as_text(x) if text is None else text for text, x in found)


def wrapped(paths: set[str]) -> str:
    """The object that all paths lie in, like `data.` or `data.chat.`; else nothing."""
    out = ""
    while len(heads := {p[len(out) :].partition(".")[0] for p in paths}) == 1 and "[]" not in (head := heads.pop()) and all(len(p) > len(out) + len(head) for p in paths):
        out += head + "."
    return out


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def select_mapping(paths: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping that covers all of the paths, else the one that uses most of them; ties: the first."""
    fit = [m for m in mappings if m.paths <= paths]
    return max(fit, key=lambda m: (paths <= m.paths | m.also, len(paths & (m.paths | m.also))), default=None)


def canonical_turns(record: object, mapping: Mapping) -> list[tuple[str, str]]:
    """Turns (role, text) of a record; items of the list that are no objects have no role and no text and are left out.

    The texts of a list may be plain, objects or lists of parts, mixed from turn to turn and from part to part (turn_text).
    """
    names = dict(mapping.roles)
    turns = []
    for role, fields in mapping.parts:
        found = [x for x in (text_at(record, f) for f in fields) if x is not None]
        if found:
            turns.append((role, "\n\n".join(x for x in found if x) if len(found) > 1 else found[0]))
    if mapping.each:
        items, role, text = mapping.each
        for item in values_at(record, f"{items}[]"):
            if isinstance(item, dict):
                said = text_at(item, role) or ""
                turns.append((names.get(said, said), turn_text(item, text)))
    return turns


def escape(text: str) -> str:
    return re.sub(r"[\\#]|(?<=<)/", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[dict]]:
    """The formatted text, and the spans of the loss mask: code points of the texts of role `learn`."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role).replace(': ', ':' + chr(92) + ' ')}: ", escape(text)
        if role == learn:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += (head, body, " </turn>\n")
        at += len(head) + len(body) + 9
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """render() backwards."""
    turns = []
    for turn in formatted.split(" </turn>\n")[:-1]:
        role, _, text = turn[4:].partition(": ")
        turns.append((unescape(role), unescape(text)))
    return turns


def _formatted(batches: Iterable[pa.RecordBatch], mappings: tuple[Mapping, ...]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[Mapping | None, str]] = {}  # and the object around its fields
    for part in common.slices(batches, "record"):
        rows: dict[str, list] = {k: [] for k in ("fingerprint", "layout", "n_turns", "formatted", "loss_spans")}
        for text in part.column("record").to_pylist():
            try:
                record = json.loads(text) if text else None
            except (ValueError, RecursionError):
                record = None
            paths = field_paths(record) if isinstance(record, dict) else set()
            key = fingerprint(paths)
            if key not in known:
                if len(known) > 10_000:
                    known.clear()
                inside = wrapped(paths)
                known[key] = select_mapping(paths, mappings), ""
                if known[key][0] is None and inside:
                    known[key] = select_mapping({p[len(inside) :] for p in paths}, mappings), inside[:-1]
            mapping, inside = known[key]
            if mapping and inside:
                record = values_at(record, inside)[0]
            turns = canonical_turns(record, mapping) if mapping else []
            formatted, spans = render(turns)
            for k, v in zip(rows, (key, mapping.name if mapping else None, len(turns), formatted if mapping else None, spans), strict=True):
                rows[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(rows["fingerprint"], pa.string()), pa.array(rows["layout"], pa.string()), pa.array(rows["n_turns"], pa.int64()),
             pa.array(rows["formatted"], pa.string()), pa.array(rows["loss_spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["id", *rows],
        )


def format_chats(records: DataFrame, id_col: str, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records(id, JSON text) -> id, fingerprint, layout, n_turns, formatted, loss_spans.

    A record that is null, no JSON object, nested too deeply for JSON, or of a layout without a mapping stays, with a null layout
    and text and no turns; items of a list of turns that are null or no objects are left out. A record inside a wrapper object is
    read from there. Repeated and null ids stay. Other columns are not read. One pass without a shuffle; a task holds a batch of records.
    """
    id_type = records.schema[id_col].dataType.simpleString()
    return records.select(F.col(id_col).alias("id"), F.col(record_col).alias("record")).mapInArrow(
        lambda batches: _formatted(batches, mappings),
        f"id {id_type}, fingerprint string, layout string, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>",
    )


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) -> one JSON record a conversation, turns in order of (turn, role, text).

    Null roles and texts are empty; null turns come first; repeated rows stay; a null conv_id is a conversation.
    A conversation is one document and meets in one task, as its digest needs.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", F.to_json(F.struct("turns")).alias("record"))


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, "formatted"):
        out = []
        for formatted, spans in zip(common.texts(part, "formatted"), part.column("loss_spans").to_pylist(), strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            out.append((len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        n, said, chars, loss, size = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays(
            [part.column("conv_id"), pa.array(n, pa.int64()), pa.array(said), pa.array(chars, pa.int64()), pa.array(loss), pa.array(size, pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = common.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    formatted = format_chats(conversation_records(rows), "conv_id", "record").select(F.col("id").alias("conv_id"), "formatted", "loss_spans")
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(cast(sum(length(text)) filter (where role = 'assistant') as bigint), 0) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(15 + length(role) + (length(role) - length(replace(role, ': ', ''))) / 2 + 2 * length(text)
                - length(replace(replace(text, '\', ''), '#', ''))
                + (length(text) - length(replace(text, '</', ''))) / 2) as bigint) as formatted_chars
from c group by conv_id
"""
