"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered once, with the character spans of its turns' texts known from rendering; it is encoded
once, with offsets; and each span of a turn that carries loss is cut against the sorted token spans by binary search.
Control strings that occur inside a text are escaped by a backslash after their first character, one more where there are
some already, and reading back takes one away; so a text can neither open nor close a turn.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

from kinweave.llm.arrow import map_batches

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
#: Markers of this template and of others in use, all escaped inside texts and roles.
CONTROLS = (TURN, SAY, END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|startoftext|>")
_RAW = re.compile("|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    return _RAW.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


@dataclass
class Rendered:
    text: str
    #: Spans of the escaped texts of turns with loss, in order.
    spans: list[tuple[int, int]]


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> Rendered:
    """<|turn|>role<|say|>text<|end|>, with a line feed after each turn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = TURN + escape(role) + SAY, escape(text), END + "\n"
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return Rendered("".join(parts), spans)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for turn in text.split(END + "\n")[:-1]:
        role, _, body = turn.removeprefix(TURN).partition(SAY)
        out.append((unescape(role), unescape(body)))
    return out


def loss_ranges(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each span (first token, starts, ends): its tokens in a row, cut to the span; a token of two turns gives each its own part."""
    if not spans:
        return []
    at = np.array(offsets, np.int32).reshape(-1, 2)
    starts, ends = at[:, 0], at[:, 1]
    out = []
    for a, b in spans:
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        last = max(first, last)
        out.append((first, np.maximum(starts[first:last], a), np.minimum(ends[first:last], b)))
    return out


def covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The characters that sorted tokens cover, merged: tokens that share a character count it once."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(starts[1:] > reach[:-1]) + 1
    return list(zip(starts[np.concatenate([[0], new])].tolist(), reach[np.concatenate([new - 1, [len(ends) - 1]])].tolist(), strict=True))


@cache
def load(path: str) -> Tokenizer:
    """A byte-level tokenizer whose control strings in a text are ordinary text and whose offsets keep white space.

    A worker process loads it once: a copy for each task would leave its memory scattered.
    """
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


def format_conversations(turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_col, formatted, ids, loss): each conversation rendered and encoded once.

    loss: for each turn of `loss_role` its first token under the mask, and where each of its tokens starts and ends in
    `formatted`, as far as the turn reaches.
    Rows are ordered by turn, then role and text, nulls first; repeated rows are turns of their own; null roles and texts
    are empty; rows with a null conversation form one. A conversation is one record, so it is the unit that must fit a
    task. Extra columns are not read.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(conv_col).alias("id")).agg(F.array_sort(F.collect_list(row)).alias("t"))
    whole = whole.select(F.col("id").cast("long"), F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def make():
        tokenizer = load(tokenizer_path)

        def step(cols):
            out = {"id": cols["id"], "formatted": [], "ids": []}
            first, starts, ends, tokens, turns = [], [], [], [0], [0]
            for roles, texts in zip(cols["roles"], cols["texts"], strict=True):
                r = render(list(zip(roles, texts, strict=True)), loss_role)
                code = tokenizer.encode(r.text, add_special_tokens=False)
                out["formatted"].append(r.text)
                out["ids"].append(np.array(code.ids, np.int32))
                for i, a, b in loss_ranges(code.offsets if r.spans else [], r.spans):
                    first.append(i)
                    starts.append(a)
                    ends.append(b)
                    tokens.append(tokens[-1] + len(a))
                turns.append(len(first))
            flat = lambda parts: pa.ListArray.from_arrays(pa.array(tokens, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))
            each = pa.StructArray.from_arrays([pa.array(first, pa.int32()), flat(starts), flat(ends)], ["token", "starts", "ends"])
            return out | {"loss": pa.ListArray.from_arrays(pa.array(turns, pa.int32()), each)}

        return step

    out = map_batches(whole, make, "id long, formatted string, ids array<int>, loss array<struct<token: int, starts: array<int>, ends: array<int>>>")
    return out.withColumnRenamed("id", conv_col)


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from format_conversations() alone."""

    def make():
        from hashlib import sha256

        def step(cols):
            out = {"id": cols["id"], "n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for text, loss in zip(cols["formatted"], cols["loss"], strict=True):
                turns = parse(text)
                spans = [covered(t["starts"].values.to_numpy(), t["ends"].values.to_numpy()) for t in loss]
                said = [unescape("".join(text[a:b] for a, b in parts)) for parts in spans]
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(sum(map(len, said)))
                out["loss_sha256"].append(sha256("".join(said).encode()).hexdigest())
                out["formatted_chars"].append(len(text))
            return out

        return step

    rows = formatted.select(F.col(conv_col).alias("id"), "formatted", "loss")
    return map_batches(rows, make, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", raw=("loss",)).withColumnRenamed("id", conv_col)
