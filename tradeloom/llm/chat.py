"""Chat formatting: conversations become one text with a loss mask aligned to its tokens.

A turn is written as ``<|turn|>role<|text|>text<|end|>`` and a line break. Markers are tokens of their own; a text that
holds anything like a marker is escaped with one more backslash between ``<`` and ``|``, which reading takes away again. A
conversation is rendered whole and encoded once with offsets; the sorted spans of the turns meet the sorted spans of the
tokens by binary search, and the tokens inside an assistant's text carry the loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer
from tokenizers.processors import ByteLevel

from tradeloom.llm.common import map_rows, table
from tradeloom.llm.packing import vocabulary_path

TURN, TEXT, STOP, AFTER = "<|turn|>", "<|text|>", "<|end|>", "\n"
LEARNED = "assistant"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ONE_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation and the (start, end) places of its learned texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{STOP}{AFTER}")
        at += len(parts[-1])
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def loss_mask(token_spans: np.ndarray, turn_spans: np.ndarray) -> np.ndarray:
    """True for the tokens that lie in a turn span. Both are sorted; a token belongs to the last span that starts before its end."""
    if not len(turn_spans) or not len(token_spans):
        return np.zeros(len(token_spans), dtype=bool)
    turn = np.searchsorted(turn_spans[:, 0], token_spans[:, 1], side="left") - 1
    start, end = turn_spans[turn, 0], turn_spans[turn, 1]
    return (turn >= 0) & (token_spans[:, 0] >= start) & (token_spans[:, 1] <= end) & (token_spans[:, 1] > token_spans[:, 0])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _ONE_TURN.findall(formatted)]


def learned_texts(formatted: str, token_spans: np.ndarray, mask: np.ndarray) -> list[str]:
    """Texts under the mask, read from the places of its tokens: one per run of tokens without a gap."""
    spans = token_spans[mask]
    texts: list[str] = []
    start = end = -1
    for a, b in spans.tolist():
        if a > end:
            if start >= 0:
                texts.append(unescape(formatted[start:end]))
            start = a
        end = max(end, b)
    if start >= 0:
        texts.append(unescape(formatted[start:end]))
    return texts


def chat_tokenizer(vocabulary: str) -> Tokenizer:
    """The vocabulary with the markers as tokens; offsets cover the blanks that tokens begin with."""
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.post_processor = ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(m, normalized=False) for m in (TURN, TEXT, STOP)])
    return tokenizer


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns of a conversation in order; a conversation is one row of the result by its nature.

    Null roles and texts are empty. Turns are ordered by turn, nulls first, ties by role and text; a repeated row is a
    turn of its own. Rows without conv_id form one conversation.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, vocabulary: str) -> DataFrame:
    """Return per conversation: conv_id, formatted, ids, mask (array of boolean), starts, ends (places of the tokens).

    Other columns are ignored; an empty table gives no rows; texts are whole whatever their length.
    """
    state: dict = {}  # filled once per task

    def run(part: list) -> Iterator[tuple]:
        if not state:
            state["tokenizer"] = chat_tokenizer(vocabulary)
        for conv_id, turns in part:
            formatted, spans = render([(t["role"], t["text"]) for t in turns])
            found = state["tokenizer"].encode(formatted, add_special_tokens=False)
            places = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
            yield conv_id, formatted, found.ids, loss_mask(places, spans).tolist(), places[:, 0].tolist(), places[:, 1].tolist()

    return map_rows(conversations(rows).select("conv_id", "turns"), run, "conv_id long, formatted string, ids array<int>, mask array<boolean>, starts array<int>, ends array<int>", chunk=32)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in formatted conversations: turns and learned texts, counted and digested."""

    def run(part: list) -> Iterator[tuple]:
        for conv_id, text, mask, starts, ends in part:
            turns = read_turns(text)
            whole = "".join(f"{r}\n{t}\n" for r, t in turns)
            learned = "".join(learned_texts(text, np.column_stack((starts, ends)).astype(np.int64).reshape(-1, 2), np.array(mask, dtype=bool)))
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, learned)]
            yield conv_id, len(turns), sha[0], len(learned), sha[1], len(text)

    return map_rows(formatted.select("conv_id", "formatted", "mask", "starts", "ends"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", chunk=32)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return digests(format_chats(rows.unionByName(extra), vocabulary_path("byte_bpe_50k.json")))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
