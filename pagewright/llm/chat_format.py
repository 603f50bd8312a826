"""Chat formatting from an event log.

A conversation is stored as events.  The log is partitioned by conversation,
sorted by sequence within each partition and folded in one pass: streamed deltas
grow a message, edits replace it, regenerations start it anew, deletions take it
away.  The final messages are rendered by a template that marks turns.

A table of turns becomes such a log first, with one running sequence for each
conversation: users send a draft and edit it after the next turn has begun, an
assistant's answer is regenerated, which drops what was begun after it, and streamed,
and notes that lie between turns are deleted late.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.columns import record
from pagewright.llm import rows
from pagewright.plans.session import table

NAME = "op4_chat_format"

#: Fixed values of the template: marks of begin, text, end of text and end of turn.
BEGIN, TEXT, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)

#: Kinds of events, in the order in which those of one seq apply.
EVENTS = ("message", "edit", "regenerate", "delta", "delete")


def escape(text: str) -> str:
    """``text`` without control strings: a backslash follows their first character; backslashes are doubled."""
    return _CONTROL.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: Iterable[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) of one conversation from its events (seq, kind, message, role, text) in order.

    ``message`` starts a message (a null id: one of its own), ``delta`` appends
    to one, and starts it where it is unknown, ``edit`` replaces its text,
    ``regenerate`` empties it so that deltas can fill it again, and drops what
    began at a later seq; ``delete`` takes it away.  A start of a message that is
    known already replaces its text and, if it names one, its role.  Edits,
    regenerations and deletions of unknown messages, and unknown kinds, change
    nothing.  Messages that begin at one seq come in the order of their final role
    and text.
    """
    order: list[list | None] = []  # seq, role, parts of the text
    at: dict = {}
    for number, (seq, kind, message, role, text) in enumerate(events):
        if message is None:
            message = ("event", number)
        place = at.get(message)
        if kind in ("message", "delta") and place is None:
            at[message] = len(order)
            order.append([seq, role or "", [text or ""], message])
        elif place is None:
            continue
        elif kind == "delta":
            order[place][2].append(text or "")
        elif kind in ("edit", "message"):
            order[place][2] = [text or ""]
            if kind == "message" and role:
                order[place][1] = role
        elif kind == "regenerate":
            while len(order) > place + 1 and (order[-1] is None or order[-1][0] != order[place][0]):
                later = order.pop()
                if later:
                    del at[later[3]]
            order[place][2] = [text or ""]
        elif kind == "delete":
            del at[message]
            order[place] = None
    out: list[tuple[str, str]] = []
    for _, tied in groupby((x for x in order if x), key=itemgetter(0)):
        out += sorted((role, "".join(parts)) for _, role, parts, _ in tied)
    return out


def render(messages: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string, and the spans of it under the loss mask: the assistant's texts."""
    out, at, mask = [], 0, []
    for role, text in messages:
        body = escape(text)
        head = f"{BEGIN}{escape(role)}{TEXT}"
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{CLOSE}{END}")
        at += len(out[-1])
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that ``formatted`` was rendered from."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def format_chats(events: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Rows (conversation, formatted, loss_mask) from events (conversation, seq, kind, message, role, text).

    loss_mask is an array of structs (begin, end), in code points.  Events of
    equal seq apply in the order start, edit, regeneration, delta, deletion, then by
    message, role and text, so repeated rows stay and have one order.
    seq and the conversation may have any type with an order.  A null conversation is one of its own; null
    role and text are empty; an empty table gives no rows; other columns are not
    read and may have any names.  A conversation is one row of the result: a task holds one conversation's messages
    at a time, however many it has and however long they are.
    """
    own = rows.chosen(events, conv=conversation, **{c: c for c in ("seq", "kind", "message", "role", "text")})
    parts = own.repartition("conv").sortWithinPartitions("conv", "seq", F.array_position(F.lit(list(EVENTS)), F.col("kind")), "message", "kind", "role", "text")
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done, size = object(), [], [], 0

        def close() -> int:
            formatted, mask = render(fold(held))
            done.append((now, formatted, [{"begin": a, "end": b} for a, b in mask]))
            return len(formatted)

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), spans), strict=True)], ["conv", "formatted", "loss_mask"])

        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, *event in zip(*(batch.column(c).to_pylist() for c in ("conv", "seq", "kind", "message", "role", "text")), strict=True):
                if conv != now and (conv == conv or now == now):  # not a number is one conversation as well
                    if held:
                        size += close()
                    now, held = conv, []
                held.append(event)
                if size > 8 << 20:
                    yield batch_of(kind)
                    done, size = [], 0
        if held:
            close()
        if done:
            yield batch_of(kind)

    made = rows.schema(("conv", rows.kind(events, conversation)), ("formatted", "string"), ("loss_mask", "array<struct<begin:bigint,end:bigint>>"))
    return parts.mapInArrow(run, made).withColumnRenamed("conv", conversation)


#: What a draft says before it is edited or regenerated, and places of a log for each turn.
DRAFT, PLACES = "...", 10


def turn_events(turns: DataFrame) -> DataFrame:
    """An event log of a table of turns (conv_id, turn, role, text), from which folding restores the turns.

    Turns are whole numbers, below 10**17; a null one is before all others.  Each
    takes ten places of its conversation's sequence.  An assistant's message starts
    as a draft, is followed by another that its regeneration drops, and is streamed
    in two deltas; any other starts as a draft that is edited once the next turn has
    begun.  After each turn a note begins that is deleted during the next one.  Each
    row is a message of its own, so repeated rows stay; texts are in the log once.
    """
    none, text, role = F.lit(None).cast("string"), F.coalesce("text", F.lit("")), F.col("role")
    said, noted = F.lit(DRAFT), F.lit("system")

    def event(place: int, kind: str, who: Column, what: Column, message: str = "") -> Column:
        return record(seq=F.col("seq") + place, kind=F.lit(kind), message=F.concat("message", F.lit(message)), role=who, text=what)

    half = F.floor(F.length(text) / 2).cast("int")
    parts = [F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))]
    note = [event(6, "message", noted, said, "note"), event(PLACES + 7, "delete", none, none, "note")]
    streamed = [event(0, "message", role, said), event(1, "message", role, said, "other"), event(2, "regenerate", none, none), *(event(3 + i, "delta", none, p) for i, p in enumerate(parts))]
    edited = [event(0, "message", role, said), event(PLACES + 5, "edit", none, text)]
    log = F.when(role == "assistant", F.array(*streamed, *note)).otherwise(F.array(*edited, *note))
    own = rows.chosen(turns, conv_id="conv_id", seq="turn", role="role", text="text").withColumn("message", F.monotonically_increasing_id().cast("string"))
    placed = own.withColumn("seq", F.coalesce(F.col("seq").cast("bigint"), F.lit(-(10**17))) * PLACES)
    return placed.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted chats: turns, what lies under the loss mask, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, mask in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                turns = parse(text)
                lossy = "".join(unescape(text[x["begin"] : x["end"]]) for x in mask)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                found.append((len(turns), _hex(whole), len(lossy), _hex(lossy), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*found, strict=True) if found else [[]] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=DIGESTS)

    made = rows.schema(("conv_id", rows.kind(formatted, "conv_id")), *zip(DIGESTS[1:], ("bigint", "string", "bigint", "string", "bigint"), strict=True))
    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(run, made)


DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return digests(format_chats(turn_events(turns.unionByName(own))))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<(/?s>)|\[(/?INST\])', '_\\\1\2', 'g'))
    + length(regexp_replace(replace(role, '\', '\\'), '<(/?s>)|\[(/?INST\])', '_\\\1\2', 'g')) + 20 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
