"""Chat formatting on token level.

A turn is ``### role: text</turn>`` and a line end. Role and text are encoded separately; the marks between them are reserved
ids beyond the vocabulary, so no text can produce one. In the rendered text the same holds by escaping: a backslash is
doubled, and one is put into each control string that occurs in content. The loss mask is a prefix sum over the ids: +1 at
the id after the colon mark of an assistant turn, -1 at its end mark.

Rows are formatted one by one, in parallel; a conversation is the sequence of its rows. What has to run over a conversation
in order (places, digests) streams over sorted partitions and holds one row at a time, so a conversation of any length fits
in memory; its digests are sequential by nature.

Nulls: a null role or text is empty, rows without conversation id are one conversation of their own, rows without turn come
first. Ties of ``turn`` are ordered by role and text; repeated rows are formatted once each. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, slices

#: Marks of the rendered text, and the offsets of their ids beyond the vocabulary.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
OPEN_ID, COLON_ID, CLOSE_ID = 0, 1, 2
TRAINED = "assistant"


def escape(text: str) -> str:
    """Neither ``###`` nor ``</turn>`` is left, and :func:`unescape` restores the text."""
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@functools.lru_cache(maxsize=2)
def loaded(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def loss_mask(ids: np.ndarray, base: int, trained: bool) -> np.ndarray:
    """1 for the ids of the text of a trained turn."""
    steps = np.zeros(len(ids) + 1, np.int8)
    if trained:
        steps[1:][ids == base + COLON_ID] += 1
        steps[:-1][ids == base + CLOSE_ID] -= 1
    return np.cumsum(steps)[:-1].astype(np.int8)


def render(ids: np.ndarray, tokenizer) -> str:
    """The text of formatted ids."""
    base, marks = tokenizer.get_vocab_size(), (OPEN, COLON, CLOSE)
    out, begin = [], 0
    for at in [*np.flatnonzero(ids >= base), len(ids)]:
        out.append(tokenizer.decode(ids[begin:at].tolist(), skip_special_tokens=False))
        if at < len(ids):
            out.append(marks[ids[at] - base])
        begin = at + 1
    return "".join(out)


def format_turns(rows: DataFrame, tokenizer: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn: ``conversation``, ``turn``, ``ids``, ``loss_mask`` (as many) and ``formatted`` (the rendered text)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            known = loaded(tokenizer)
            base = known.get_vocab_size()
            roles, texts = ([x or "" for x in part.column(c).to_pylist()] for c in ("role", "text"))
            heads = known.encode_batch_fast([escape_role(r) for r in roles], add_special_tokens=False)
            bodies = known.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)
            ids, masks, formatted = [], [], []
            for r, t, head, body in zip(roles, texts, heads, bodies, strict=True):
                one = np.array([base + OPEN_ID, *head.ids, base + COLON_ID, *body.ids, base + CLOSE_ID], np.int32)
                ids.append(one)
                masks.append(loss_mask(one, base, r == TRAINED))
                formatted.append(f"{OPEN}{escape_role(r)}{COLON}{escape(t)}{CLOSE}")
            yield {"conversation": part.column("conversation"), "turn": part.column("turn"), "ids": ids, "loss_mask": masks, "formatted": formatted}

    narrow = rows.select(*[F.col(c).alias(n) for c, n in ((conversation, "conversation"), (turn, "turn"), (role, "role"), (text, "text"))])
    kinds = [narrow.schema[c].dataType.simpleString() for c in ("conversation", "turn")]
    return map_batches(narrow, run, f"conversation {kinds[0]}, turn {kinds[1]}, ids array<int>, loss_mask array<tinyint>, formatted string")


def read_back(turns: DataFrame, tokenizer: str) -> DataFrame:
    """``role``, ``text``, ``trained`` (text under the mask, null if nothing is) and ``chars`` (rendered length) from the ids."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        known = loaded(tokenizer)
        base = known.get_vocab_size()
        out: dict[str, list] = {"role": [], "text": [], "trained": [], "chars": []}
        for ids, mask in zip(batch.column("ids"), batch.column("loss_mask"), strict=True):
            ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
            whole = render(ids, known)
            role, text = re.fullmatch(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", whole, re.DOTALL).groups()
            under = unescape(known.decode(ids[mask == 1].tolist(), skip_special_tokens=False))
            for column, value in zip(out.values(), (unescape(role), unescape(text), under if mask.any() else None, len(whole)), strict=True):
                column.append(value)
        yield {"conversation": batch.column("conversation"), "turn": batch.column("turn")} | out

    kinds = [turns.schema[c].dataType.simpleString() for c in ("conversation", "turn")]
    return map_batches(turns.select("conversation", "turn", "ids", "loss_mask"), run,
                       f"conversation {kinds[0]}, turn {kinds[1]}, role string, text string, trained string, chars bigint")


def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of :func:`read_back`: number of turns, digests of all turns and of the trained texts."""
    kind = turns.schema["conversation"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    arrow = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None  # state: turns, digest, trained characters, digest, characters

        def close(out: list[list]) -> None:
            if state:
                for column, value in zip(out, (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), strict=True):
                    column.append(value)

        for batch in batches:
            out: list[list] = [[] for _ in names]
            columns = (batch.column(c).to_pylist() for c in ("conversation", "role", "text", "trained", "chars"))
            for conversation, role, text, trained, chars in zip(*columns, strict=True):
                if state is None or conversation != current:
                    close(out)
                    current, state = conversation, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(trained or "")
                state[3].update((trained or "").encode())
                state[4] += chars
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow, strict=True)], names)
        out = [[] for _ in names]
        close(out)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow, strict=True)], names)

    ordered = turns.repartition("conversation").sortWithinPartitions("conversation", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conversation {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
