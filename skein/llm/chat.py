r"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " label ": " body " </turn>\n"
    label        := "User" | "Assistant" | "System" | "=" role      (role: any but ":", or "\" and any character)
    body         := what has no control string ("### ", "</turn>"), where "\" and a character stand for it

Each turn is rendered, parsed again by the grammar, and compared with its source; while they differ, the text is
escaped more: not at all, backslashes and control strings, all characters of these, every character. The loss mask
covers the bodies of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import arrow_batches, cut, strings, table

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
LABELS = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {label: role for role, label in LABELS.items()}
LOSS_ROLE = "assistant"

_HEAD = re.compile(r"### (User|Assistant|System|=(?:[^\\:]|\\.)*): ", re.DOTALL)
_SIGN = re.compile(r"\\(.)|( </turn>\n)|(### |</turn>)", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_LEVELS = [None, re.compile(r"\\|### |</turn>"), re.compile(r"[\\#<]"), re.compile(r".", re.DOTALL)]


class Unparsable(ValueError):
    """Text that isn't of the grammar."""


def label(role: str) -> str:
    return LABELS.get(role) or "=" + re.sub(r"([^A-Za-z0-9])", r"\\\1", role, flags=re.DOTALL)


def escape(text: str, level: int) -> str:
    return text if level == 0 else _LEVELS[level].sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(text: str, at: int = 0) -> tuple[str, int, int, int] | None:
    """The turn that begins at `at`: its role, where its body starts and ends, and where the turn ends. None if
    the text ends before the turn does; Unparsable if no turn begins there."""
    head = _HEAD.match(text, at)
    if not head:
        if OPEN.startswith(text[at : at + 4]) or text.startswith(OPEN, at) and MIDDLE not in text[at:]:
            return None
        raise Unparsable(text[at : at + 40])
    name = head[1]
    role = ROLES.get(name) if name in ROLES else unescape(name[1:])
    for sign in _SIGN.finditer(text, head.end()):
        if sign[2]:
            return role, head.end(), sign.start(), sign.end()
        if sign[3]:
            raise Unparsable(f"control string in a body: {text[sign.start() : sign.start() + 40]!r}")
    return None


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted text and where in it the body starts and ends: with the least escapes with which it
    parses back to the same role and text."""
    for level in range(len(_LEVELS)):
        out = OPEN + label(role) + MIDDLE + escape(text, level) + CLOSE
        try:
            found = parse(out)
        except Unparsable:
            continue
        if found and found[0] == role and found[3] == len(out) and unescape(out[found[1] : found[2]]) == text:
            return out, found[1], found[2]
    raise Unparsable(f"role {role!r} can't be written")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start and loss_end (code points in `formatted`, null where nothing is
    learned) of each row. The formatted conversation is its rows' formatted texts by turn; rows that share a turn
    follow in the order of their formatted texts, a null turn comes first. Null roles and texts count as empty;
    rows with a null conv_id are one conversation. No row is moved: long conversations cost no shuffle here."""
    arrow_batches(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            formatted, starts, ends = [], [], []
            for role, text in zip(strings(batch.column(2)), strings(batch.column(3)), strict=True):
                out, start, end = render(role, text)
                formatted.append(out)
                starts.append(start if role == LOSS_ROLE else None)
                ends.append(end if role == LOSS_ROLE else None)
            columns = [batch.column(0), batch.column(1), pa.array(formatted, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    kinds = [conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, formatted string, loss_start long, loss_end long")


class Reader:
    """Reads one conversation's formatted text as it comes, and what the mask covers; holds one turn at a time."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.loss = "", 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss_start: int | None, loss_end: int | None) -> None:
        self.chars += len(text)
        if loss_start is not None:
            covered = unescape(text[loss_start:loss_end])
            self.loss += len(covered)
            self.loss_sha.update(covered.encode())
        self.rest += text
        at = 0
        while at < len(self.rest) and (found := parse(self.rest, at)):
            role, start, end, at = found
            self.turns += 1
            self.turns_sha.update(f"{role}\n{unescape(self.rest[start:end])}\n".encode())
        self.rest = self.rest[at:]

    def row(self, conv_id: object) -> tuple:
        if self.rest:
            raise Unparsable(f"conversation {conv_id} ends within a turn: {self.rest[:40]!r}")
        return conv_id, self.turns, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from format_turns()'s rows alone: conv_id, n_turns, turns_sha256 (of role, newline,
    text, newline a turn), loss_chars, loss_sha256 (of the text under the mask, unescaped) and formatted_chars.

    A digest over a conversation is sequential, so its rows go to one task, in order; that task streams them and
    holds one turn, however long the conversation is."""
    arrow_batches(formatted.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    ordered = ordered.select("conv_id", "formatted", "loss_start", "loss_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, reader, now = None, None, None
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for conv_id, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or conv_id != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    reader, now = Reader(), conv_id
                reader.feed(text, start, end)
            if done:
                yield _rows(done, kinds, names)
        if reader is not None:
            yield _rows([reader.row(now)], kinds, names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


#: A conversation whose texts hold the template's own control strings.
CONFLICT = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    planted = planted.select(*[F.col(f.name).cast(f.dataType) for f in source.schema.fields])
    return read_back(cut(format_turns(source.unionByName(planted))))


def oracle() -> str:
    return r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), t AS (
        SELECT conv_id, turn, role, text, length(text) AS n,
            CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role) ELSE 1 + length(regexp_replace(role, '([^A-Za-z0-9])', '..', 'g')) END AS named,
            length(text) - length(replace(text, '\', '')) AS slashes, (length(text) - length(replace(text, '### ', ''))) // 4 AS opens,
            (length(text) - length(replace(text, '</turn>', ''))) // 7 AS closes,
            2 * length(text) - length(translate(text, '\#<', '')) - length(text) AS signs
        FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        CAST(coalesce(sum(n) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(4 + named + 2 + n + CASE WHEN text LIKE '%###' THEN signs ELSE slashes + opens + closes END + 9) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
    """
