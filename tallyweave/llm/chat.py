r"""Operator 7, chat formatting by schema fingerprints.

Records come in any layout: lists of messages, prompt and completion, instruction, input and output.
The sorted paths of a record's fields, with list indices left out, are hashed; the hash selects a
declarative mapping that turns the record into canonical turns (role, text).

The template marks a turn as ``### role: text </turn>\n``. Inside texts every backslash and every
character of ``###`` and ``</turn>`` gets a backslash before it, in roles ``:`` and line ends too;
so no control string can be formed by a text and unescaping gives the text back exactly.

Records are formatted each for itself, without a shuffle, and written; a reader deals the written
pieces by conversation and puts them in order.

Defined cases: a null text is empty, a null role is the empty role, turns with equal numbers go in
the order of their records, a null turn number comes first; an empty list of messages has no turns; a
record that is null, no JSON object, of a layout in no mapping or with anything but strings where texts
belong isn't formatted, and `rejected` says why. A conversation is streamed turn by turn through one task
(a digest over its turns is sequential) in constant memory, however long it is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import lean, table, written

Turn = tuple[str, str]
CONTROL = re.compile(r"\\|###|</turn>")
TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*): ((?:[^\\]|\\.)*?) </turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "".join("\\" + c for c in m[0]), text)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:").replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    head, body = f"### {escape_role(role)}: ", escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a record; [] stands for any index of a list."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"}, *(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(names) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:16]


#: Mappings: fields of a record, and the turns they make. "each" is a list of messages with the
#: names of its role and text fields; "turns" gives a role and the fields that are joined into its
#: text. Empty fields but the last are left out.
MAPPINGS = [
    {"fields": ["role", "text"], "one": ("role", "text")},
    {"fields": ["role", "content"], "one": ("role", "content")},
    {"fields": ["messages[]", "messages[].role", "messages[].content"], "each": ("messages", "role", "content")},
    {"fields": ["conversations[]", "conversations[].from", "conversations[].value"], "each": ("conversations", "from", "value")},
    {"fields": ["turns[]", "turns[].role", "turns[].text"], "each": ("turns", "role", "text")},
    {"fields": ["messages[]"], "each": ("messages", "role", "content")},
    {"fields": ["conversations[]"], "each": ("conversations", "from", "value")},
    {"fields": ["turns[]"], "each": ("turns", "role", "text")},
    {"fields": ["prompt", "completion"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"fields": ["prompt", "response"], "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"fields": ["question", "answer"], "turns": [("user", ["question"]), ("assistant", ["answer"])]},
    {"fields": ["instruction", "output"], "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"fields": ["instruction", "input", "output"], "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"fields": ["system", "prompt", "response"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
BY_PRINT = {fingerprint(m["fields"]): m for m in MAPPINGS}
#: Fields beside a conversation that say nothing in it.
IGNORED = frozenset({"id", "uuid", "source", "dataset", "metadata", "meta", "tags", "created_at", "score", "lang", "language"})


def said(value) -> str:
    if value is not None and not isinstance(value, str):
        raise ValueError(f"{type(value).__name__} in place of a text")
    return value or ""


def prints(mappings: list[dict]) -> dict[str, dict]:
    """Mappings by the fingerprint of their fields."""
    return {fingerprint(m["fields"]): m for m in mappings}


def canonical(record: dict, by_print: dict[str, dict] = BY_PRINT, ignored: frozenset[str] | set[str] = IGNORED) -> list[Turn]:
    """The turns of a record by the mapping that its fingerprint selects: that of all its fields or, where there
    is none, of those whose first name isn't an ignored one."""
    names = paths(record)
    m = by_print.get(fingerprint(names)) or by_print.get(fingerprint(n for n in names if n.partition(".")[0].partition("[")[0] not in ignored))
    if m is None or not isinstance(record, dict):
        raise ValueError(f"no mapping for the fields {sorted(names)}")
    if "one" in m:
        role, text = m["one"]
        return [(said(record[role]), said(record[text]))]
    if "each" in m:
        several, role, text = m["each"]
        if not all(isinstance(x, dict) and role in x and text in x for x in record[several]):
            raise ValueError(f"not all of {several} have {role} and {text}")
        return [(ROLES.get(said(x[role]), said(x[role])), said(x[text])) for x in record[several]]
    return [(role, "\n".join(v for i, f in enumerate(fields) if (v := said(record[f])) or i == len(fields) - 1 and len(fields) == 1)) for role, fields in m["turns"]]


FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("record", pa.string()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64())), ("rejected", pa.string())])


def format_records(records: DataFrame, mappings: list[dict] | None = None, ignored: frozenset[str] | set[str] = IGNORED) -> DataFrame:
    """records (conv_id, turn, record: JSON of any known layout) as a written table of pieces, one for
    each record: conv_id, turn, place (a digest of the record, which orders equal turns), the formatted
    text, the spans under the loss mask (assistant texts as they stand escaped in the piece), and, in
    place of these, why a record was rejected: no layout that the mappings (by default MAPPINGS) know, or texts that
    no encoding holds."""
    by_print = BY_PRINT if mappings is None else prints(mappings)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in FORMATTED.names}
            for conv, turn, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, starts, ends, why = "", [], [], None
                try:
                    for role, words in canonical(json.loads(record or "null"), by_print, ignored):
                        (role + words).encode()  # a lone surrogate raises here
                        piece, a, b = render(role, words)
                        if role == "assistant":
                            starts.append(len(text) + a)
                            ends.append(len(text) + b)
                        text += piece
                except (ValueError, RecursionError) as e:
                    text, starts, ends, why = None, None, None, str(e)
                for n, v in zip(FORMATTED.names, (conv, turn, record, text, starts, ends, why), strict=True):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, FORMATTED)

    made = records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "record").mapInArrow(lean(stream), "conv_id long, turn long, record string, formatted string, loss_start array<long>, loss_end array<long>, rejected string")
    return written(made, "chat")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, from nothing but its formatted pieces and their loss masks;
    rejected records take no part."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def closed() -> tuple:
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now[0]:
                    if now is not None:
                        done.append(closed())
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(r["formatted"]):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for a, b in zip(r["loss_start"], r["loss_end"], strict=True):
                    text = unescape(r["formatted"][a:b])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(r["formatted"])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), DIGESTS, strict=True)], schema=DIGESTS)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(closed(), DIGESTS, strict=True)], schema=DIGESTS)

    pieces = formatted.where("rejected is null").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "record").select("conv_id", "formatted", "loss_start", "loss_end")
    return pieces.mapInArrow(lean(stream), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = c.union(more)
    records = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return read_back(format_records(records))


SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (select *, replace(replace(replace(t, '\', '\\'), '###', '\#\#\#'), '</turn>', '\<\/\t\u\r\n\>') as x from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(x) + length(role) + 15) as bigint) as formatted_chars
from e group by conv_id
"""
