"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm.common import map_arrow, table

END = "</turn>"
HEAD = "### "
#: What a text may not hold unescaped: the escape sign itself, a turn's end and a turn's head.
_CONTROL = re.compile(r"\\|</turn>|### ")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Nothing is tried again once it has matched, so a turn takes no memory beside its text.
_TURN = re.compile(r"### ((?:[^:\\]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)

EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    """Puts a backslash before each backslash, turn end and turn head."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, str, str]:
    """Head, escaped body and end of one turn."""
    return f"{HEAD}{escape(role).replace(':', chr(92) + ':')}: ", escape(text), f"{END}\n"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples from rows sorted by conversation and turn; holds the turns of one conversation."""
    out: list[tuple] = []
    size = 0
    now, before, n, open_tail = object(), "", 0, False

    def flush() -> pa.RecordBatch:
        nonlocal out, size
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "example", "text", "loss_start", "loss_end"])
        out, size = [], 0
        return batch

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != now:
                if open_tail:
                    out.append((now, n, before, None, None))
                now, before, n, open_tail = conv, "", 0, False
            head, body, end = turn(role or "", text or "")
            if role == "assistant":
                start = len(before) + len(head)
                before += head + body + end
                out.append((conv, n, before, start, start + len(body)))
                n, open_tail = n + 1, False
                size += len(before)
            else:
                before += head + body + end
                open_tail = True
            if size > 8 << 20:
                yield flush()
    if open_tail:
        out.append((now, n, before, None, None))
    yield flush()


def format_conversations(rows: DataFrame) -> DataFrame:
    """One example for every assistant turn: all turns up to it as text, loss on that reply alone (code points
    loss_start to loss_end of the text). Turns after the last reply make a last example without a loss.

    Turns go by number, then role, then text; null numbers come first. Null texts and roles count as empty;
    rows without a conv_id form one conversation. Repeated rows are turns of their own. Other columns are
    not read. A conversation is held whole by one task, as its last example is; an empty table gives no examples.
    """
    some = rows.select(F.col("conv_id").cast("long"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(some.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), _expand, EXAMPLES)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of one formatted example; it must be one from start to end."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("no turn at " + repr(text[at : at + 40]))
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    now, any_yet, last, loss, loss_chars, total = None, False, "", None, 0, 0

    def close() -> None:
        turns = hashlib.sha256()
        got = parse(last)
        for role, text in got:
            turns.update(f"{role}\n{text}\n".encode())
        rows.append((now, len(got), turns.hexdigest(), loss_chars, loss.hexdigest(), total))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        rows.clear()
        return batch

    for batch in batches:
        for conv, _, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not any_yet or conv != now:
                if any_yet:
                    close()
                now, any_yet, loss, loss_chars, total = conv, True, hashlib.sha256(), 0, 0
            if start is not None:
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                loss_chars += len(reply)
            last = text
            total += len(text)
        yield flush()
    if any_yet:
        close()
    yield flush()


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(examples: DataFrame, in_order: bool = False) -> DataFrame:
    """What the examples of each conversation say, parsed from their text and loss spans.

    in_order: the examples come straight from format_conversations(), so conversations are already together.
    """
    rows = examples if in_order else examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return map_arrow(rows.select("conv_id", "example", "text", "loss_start", "loss_end"), _digest, DIGEST)


PLANTED = "\\### Assistant: </turn> ok"


def op8_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all conversations and the planted one say, read back from their examples; see format_conversations()."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return read_back(format_conversations(rows.unionByName(more)), in_order=True)


SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### '))
    + length(role) + 4 + 2 + 8 AS n FROM r),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
